"""Cutting source files into structural chunks: declarations with their comments, members of large ones, headings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmith.functions import rules
from corpusmith.functions.code import names_of

MAX_CHARS = 2400
OVERLAP, FRAGMENT, BARE_LINES = 2, 28, 40


@dataclass(frozen=True)
class Profile:
    """How a language's declarations begin and end."""

    start: re.Pattern
    end: str  # brace, indent or heading
    indent: int
    comments: tuple[str, ...]
    decorators: tuple[str, ...] = ()


# The words that begin declarations, how they end, how far they may be indented, and comment marks.
_C = ("//", "/*", "*", "*/")
_SCRIPT = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:{})\s+"
_PREPROCESSOR = r"^#\s*(?:include|define|ifdef|ifndef|endif|pragma)\b"
_OBJECTIVE = Profile(re.compile(r"^(?:@interface|@implementation|@protocol)\b|^[-+]\s*\("), "brace", 0, _C)
PROFILES = {
    "typescript": Profile(re.compile(_SCRIPT.format(r"function\*?|class|interface|type|enum|namespace|const|let|var")), "brace", 2, _C),
    "tsx": Profile(re.compile(_SCRIPT.format(r"function\*?|class|interface|type|enum|const|let|var")), "brace", 2, _C),
    "javascript": Profile(re.compile(_SCRIPT.format(r"function\*?|class|const|let|var")), "brace", 2, _C),
    "python": Profile(re.compile(r"^(?:async\s+)?(?:def|class)\s+|^@[\w.]+"), "indent", 0, ("#",), ("@",)),
    "ruby": Profile(re.compile(r"^(?:module|class|def)\s+"), "indent", 0, ("#",)),
    "go": Profile(re.compile(r"^(?:func|type|const|var)\s+"), "brace", 0, _C, ("//go:",)),
    "rust": Profile(re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod|const|type|static)\s+"), "brace", 0, (*_C, "///", "#["), ("#[", "#!")),
    "java": Profile(re.compile(r"^(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|@\w+(?:\([^)]*\))?)\s+)*(?:class|interface|enum|record|@interface)\s+\w+"), "brace", 2, (*_C, "@"), ("@", "[")),
    "kotlin": Profile(re.compile(r"^(?:(?:public|private|protected|internal|open|abstract|sealed|data|inner|companion|suspend|override|final)\s+)*(?:fun|class|interface|object|enum\s+class|data\s+class|sealed\s+class)\s+"), "brace", 2, (*_C, "@"), ("@", "[")),
    "scala": Profile(re.compile(r"^(?:(?:private|protected|override|final|abstract|sealed|case|implicit|lazy)\s+)*(?:class|object|trait|def|val|var|type)\s+"), "brace", 2, (*_C, "@")),
    "csharp": Profile(re.compile(r"^(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async|override|virtual|extern)\s+)*(?:class|interface|struct|enum|record|namespace|void|[\w<>,\[\]]+)\s+\w+"), "brace", 2, (*_C, "["), ("@", "[")),
    "c": Profile(re.compile(_PREPROCESSOR + r"|^(?:typedef\s+)?(?:struct|enum|union)\s+\w+|^(?!(?:if|for|while|switch)\b)(?:(?:static|inline|extern|const|unsigned|signed|volatile|_Noreturn)\s+)*(?:struct\s+\w+|enum\s+\w+|union\s+\w+|[A-Za-z_]\w*)(?:\s+|\s*\*+\s*)[A-Za-z_]\w*\s*\("), "brace", 0, _C),
    "cpp": Profile(re.compile(_PREPROCESSOR + r"|^namespace\s+|^template\s*<|^(?:(?:inline|static|virtual|constexpr|explicit|friend|const|volatile)\s+)*(?:class|struct|enum|using)\s+|^(?:template\s*<[^;{]*>\s*)?[\w:<>*&~\s]+\s+[A-Za-z_~]\w*\s*\("), "brace", 0, _C),
    "objective-c": _OBJECTIVE,
    "objective-cpp": _OBJECTIVE,
    "swift": Profile(re.compile(r"^(?:(?:public|private|internal|open|fileprivate|static|final|override|mutating|async)\s+)*(?:func|class|struct|enum|protocol|extension|actor|typealias)\s+"), "brace", 2, (*_C, "@")),
    "dart": Profile(re.compile(r"^(?:abstract|class|mixin|extension|enum|typedef)\s+|^(?:(?:static|final|const|Future|void|[\w<>,\s?]+)\s+)?[A-Za-z_]\w*\s*\("), "brace", 2, (*_C, "@")),
    "php": Profile(re.compile(r"^(?:(?:public|private|protected|static|final|abstract)\s+)*(?:function|class|interface|trait|enum)\s+"), "brace", 2, (*_C, "#")),
    "markdown": Profile(re.compile(r"^#{1,3}\s+"), "heading", 0, ()),
}
#: Of all other languages.
_PLAIN = Profile(re.compile(r"^(?:function|class|def|fn|func|struct|type|interface|enum)\s+", re.IGNORECASE), "brace", 2, ("//", "#", "/*", "*"))
_KEYWORD = re.compile(r"\b(?:function|class|def|fn|func|interface|type|enum|struct|impl|trait|module|namespace)\b", re.IGNORECASE)
_MEMBER = re.compile(r"^\s+(?:(?:public|private|protected|static|async|override|abstract|final|export|pub|get|set|virtual|inline|suspend|open|internal|readonly|def|fn|func|fun|function)\s+)*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\(")
_NOT_MEMBERS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "assert", "await", "new", "throw", "with", "elif", "print", "constructor_"}
_SKIPPED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.DOTALL)


@dataclass
class Span:
    """Lines [start, end) of a file; members have a symbol and a line that says where they are from."""

    start: int
    end: int
    symbol: str | None = None
    prefix: str = ""
    overlaps: bool = True


class Chunker:
    """Cuts one file."""

    def __init__(self, path: str, content: str, language: str, limit: int) -> None:
        self.path, self.language, self.limit = path, language, limit
        self.lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.profile = PROFILES.get(language, _PLAIN)
        self.most = max(40, limit // 40)
        self.indents = [len(x) - len(x.lstrip()) for x in self.lines]
        # the text without strings and comments, of the same lines, shows braces only
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        self.bare = _SKIPPED.sub(blank, "\n".join(self.lines)).split("\n") if self.profile.end == "brace" else self.lines

    def _decorates(self, i: int) -> bool:
        return self.lines[i].strip().startswith(self.profile.decorators) if self.profile.decorators else False

    def _idle(self, i: int) -> bool:
        text = self.lines[i].strip()
        return not text or bool(self.profile.comments) and text.startswith(self.profile.comments)

    def _starts(self, i: int) -> bool:
        return self.indents[i] <= self.profile.indent and (not self._idle(i) or self._decorates(i)) and bool(self.profile.start.search(self.lines[i].lstrip()))

    def _head(self, i: int) -> int:
        """The first of the comments and decorators above a line."""
        while i and (self._idle(i - 1) or self._decorates(i - 1)):
            i -= 1
        return i

    def end_of(self, start: int) -> int:
        """The line after the declaration that begins at ``start``."""
        n = len(self.lines)
        if self.profile.end == "heading":
            level = len(self.lines[start]) - len(self.lines[start].lstrip("#"))
            heads = (len(m.group(1)) for m in [re.match(r"(#{1,6})\s", self.lines[start])] if m)
            level = next(heads, level)
            return next((i for i in range(start + 1, n) if (m := re.match(r"(#{1,6})\s", self.lines[i])) and len(m.group(1)) <= level), n)
        if self.profile.end == "indent":
            body = start
            while body < n - 1 and (self._decorates(body) or self._idle(body)):
                body += 1
            depth = self.indents[body]
            return next((i for i in range(body + 1, n) if not self._idle(i) and self.indents[i] <= depth), n)
        depth, inner, opened = 0, 0, False
        for i in range(start, n):
            for ch in self.bare[i]:
                if ch in "([":
                    inner += 1
                elif ch in ")]":
                    inner = max(0, inner - 1)
                elif ch == "{":
                    opened |= depth == 0 and inner == 0
                    depth += 1
                elif ch == "}":
                    depth -= 1
                    if opened and depth <= 0:
                        return i + 1
            if not opened and i > start:
                if not self.lines[i].strip() or self.profile.start.search(self.lines[i].strip()):
                    return i
                if i - start > BARE_LINES:
                    return i + 1
        return n

    def _text(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a:b])

    def _large(self, a: int, b: int) -> bool:
        return b - a > self.most or len(self._text(a, b)) > 1.5 * self.limit

    def _windows(self, a: int, b: int, **more) -> list[Span]:
        """Fixed windows of lines; none is over the size if it can be helped."""
        step = self.most
        if b > a:
            step = max(4, min(step, int((b - a) * self.limit / max(1, len(self._text(a, b))))))
        return [Span(p, min(b, p + step), **more) for p in range(a, b, step)]

    def _members(self, a: int, b: int) -> list[Span]:
        """The members of a large declaration, named after it; none if it has fewer than two."""
        found = [(i, m.group(1)) for i in range(a + 1, b) if self.indents[i] > self.indents[a] and (m := _MEMBER.match(self.lines[i])) and m.group(1) not in _NOT_MEMBERS and not self.lines[i].rstrip().endswith(";")]
        if found:
            least = min(self.indents[i] for i, _ in found)
            found = [(i, name) for i, name in found if self.indents[i] <= least + 2]
        if len(found) < 2:
            return []
        owner = next(iter(names_of(self._text(a, min(b, a + 5)), self.language)), None)
        mark = "#" if "#" in self.profile.comments else "//"
        prefix = f"{mark} Context: {self.lines[a].strip()[:160]}\n"
        out, before = [], a
        for k, (i, name) in enumerate(found):
            start = max(a + 1, self._head(i))
            if i < before:
                continue
            end = min(self.end_of(i), b, found[k + 1][0] if k + 1 < len(found) else b)
            end = max(end, i + 1)
            if start > before:
                out.append(Span(before, start, owner, prefix if before > a else "", False))
            symbol = f"{owner}.{name}" if owner else name
            out += self._windows(start, end, symbol=symbol, prefix=prefix, overlaps=False) if self._large(start, end) else [Span(max(start, before), end, symbol, prefix, False)]
            before = end
        if before < b:
            out.append(Span(before, b, owner, prefix, False))
        return out

    def spans(self) -> list[Span]:
        """The spans that cover the file."""
        n = len(self.lines)
        starts = [i for i in range(n) if self._starts(i)]
        units: list[tuple[int, int]] = []
        at = 0
        for k, first in enumerate(starts):
            a = max(at, self._head(first))
            z = min(self.end_of(first), self._head(starts[k + 1]) if k + 1 < len(starts) else n)
            if z > a:
                if a > at:
                    units.append((at, a))
                units.append((a, z))
                at = z
        if at < n:
            units.append((at, n))
        out: list[Span] = []
        for a, z in units:
            for span in (self._members(a, z) or self._windows(a, z)) if self._large(a, z) else [Span(a, z)]:
                text = self._text(span.start, span.end).strip()
                if out and text and len(text) < FRAGMENT and not span.symbol and not _KEYWORD.search(text):
                    out[-1].end = span.end
                elif text:
                    out.append(span)
        return out

    def chunks(self) -> list[dict]:
        """The chunks with id, lines, content, symbol and hash."""
        made = []
        for k, span in enumerate(self.spans()):
            a = max(0, span.start - OVERLAP) if k and span.overlaps else span.start
            text = span.prefix + self._text(a, span.end)
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            name = "\0".join((self.path, str(a + 1), str(span.end), digest[:8]))
            made.append(
                {
                    "id": hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()[:16], "path": self.path, "language": self.language, "start_line": a + 1, "end_line": span.end,
                    "content": text, "symbol": span.symbol or next(iter(names_of(text, self.language)), None), "hash": digest,
                }
            )
        return made


def language_by_name(path: str) -> str:
    """The language by a path's name or extension, else ``text``."""
    base = path.rsplit("/", 1)[-1].lower()
    if base.startswith("dockerfile."):
        return "dockerfile"
    extension = base.rsplit(".", 1)[-1] if "." in base[1:] else ""
    return rules.LANGUAGE_BY_NAME.get(base) or rules.LANGUAGE_BY_EXTENSION.get(extension) or extension or "text"


def chunk_file(path: str, content: str | None, limit: int = MAX_CHARS, language: str | None = None) -> list[dict]:
    """The chunks of a file; none if it is null or blank.

    Every line with text comes out. (The published engine drops lines when it shortens a chunk
    that is too large; here such ranges are cut into windows instead.)
    """
    return Chunker(path, content, language or language_by_name(path), limit).chunks() if content and content.strip() else []


_SCHEMA = "path string, id string, language string, start_line int, end_line int, content string, symbol string, hash string"


def chunk_files(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """The chunks of files (path, content); other columns are ignored, rows without path left out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            made = [c for path, text in zip(batch["path"], batch["content"], strict=True) for c in chunk_file(path, text, limit)]
            yield pd.DataFrame(made, columns=columns).astype({"start_line": "int32", "end_line": "int32"})

    return files.where("path is not null and content is not null").select(F.col("path").cast("string").alias("path"), "content").mapInPandas(cut, _SCHEMA)
