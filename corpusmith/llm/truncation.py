"""Problem 9: texts that were cut off on their way from the source.

A stack automaton reads each text and says what is still open at its end: a code fence, inline
code, a quotation, a bracket, a tag, a table row, an escape, a multibyte character. Texts whose
end is closed but has no terminator are held against baselines of the whole corpus (how long
sentences with the same opening are, and which words end sentences) and of their source (which
lengths pile up there, which closing lines it is used to).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmith.session import materialize

#: Marks that sources put behind a cut (fixed values).
MARKS = re.compile(r"\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\]|[\[(<{]\s*(?:truncated|cut|more|continued|snip|read more|message clipped)\s*[\])>}]|read more|\(more\))\s*$", re.IGNORECASE)
#: Characters that a mark has at most.
MARK = 200
TERMINATORS = ".!?。！？؟।｡;；"
CLOSERS = "\"'”’»)]}`）】」』*_>|"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】"}
_ENDS = {v: k for k, v in _PAIRS.items()}
_LEAD = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]\s+|\d+[.)]\s+|#+\s+)?")
_SENTENCES = re.compile(r"(?<=[.!?])[\"'”’)\]*_`]*\s+|(?<=[。！？])")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_WORDS = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\s぀-ヿ㐀-鿿가-힯]+")
_DIGITS = re.compile(r"\d+")
#: Characters of no width, and what looks like a tokenizer's special token; neither is part of a word.
_HIDDEN, _TOKEN = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff]"), re.compile(r"<\|\w+\|>")
_FENCES = re.compile(r"```|~~~")
_LAST_FENCE = re.compile(r"(?:^|\n)\s*(?:```|~~~)$")
_BROKEN = re.compile(r"(?:�|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&#?[a-zA-Z0-9]{0,8})$")
#: An opening or a closing line is known if it occurs this often.
SEEN = 5
#: A length piles up in a source if so many texts have it, and so many times the mean of the four lengths around it.
PILE, PILE_X = 5, 8
COUNTS_KEPT, WORDS_KEPT = 200_000, 200_000


def visible_end(text: str) -> str:
    """``text`` without white space, control and format characters at its end."""
    end = len(text)
    while end and (text[end - 1].isspace() or unicodedata.category(text[end - 1]) in ("Cc", "Cf", "Zs") or text[end - 1] in "︎️"):
        end -= 1
    return text[:end]


def open_at_end(text: str) -> str | None:
    """What the text leaves open: fence, escape, table, code, quote, bracket or tag; else None."""
    if _LAST_FENCE.search(text):
        return None
    if len(_FENCES.findall(text)) % 2:
        return "fence"
    if _BROKEN.search(text[-12:]):  # none is longer
        return "escape"
    line = text[text.rfind("\n") + 1 :]
    if line.lstrip().startswith("|"):
        above = text[: text.rfind("\n") + 1].rstrip("\n")
        above = above[above.rfind("\n") + 1 :]
        cells = above.count("|") if above.lstrip().startswith("|") else 0
        if not line.endswith("|") or line.count("|") < cells:
            return "table"
        return None
    paragraph = text[text.rfind("\n\n") + 1 :]
    if paragraph.count("`") % 2:
        return "code"
    prose = re.sub(r"`[^`]*`", " ", paragraph)
    if prose.count('"') % 2:
        return "quote"
    stack: list[str] = []
    for ch in prose:
        if ch in _PAIRS:
            stack.append(ch)
        elif ch in _ENDS and _ENDS[ch] in stack:
            while stack.pop() != _ENDS[ch]:
                pass
    if stack:
        return "bracket"
    tag = prose.rfind("<")
    if tag >= 0 and re.match(r"</?[a-zA-Z][^<>\n]*$", prose[tag:]):
        return "tag"
    return None


class _Spelling(dict):
    """Words as they count: in lower case, numbers as 0, without marks at their ends; a bounded memory of those seen."""

    def __missing__(self, word: str) -> str:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = "" if _TOKEN.fullmatch(word) else _DIGITS.sub("0", _HIDDEN.sub("", word).lower()).strip("\"'”’“«»()[]{}.,;:!?*_~`。，、；：！？")
        return found


_spelled = _Spelling()


def _words(sentence: str) -> list[str]:
    return [w for w in map(_spelled.__getitem__, sentence.split() if sentence.isascii() or not _CJK.search(sentence) else _WORDS.findall(sentence)) if w]


def _final(words: list[str]) -> str:
    """The key of a sentence's end: its last word, or its last two characters where words aren't spaced."""
    return "".join(words[-2:]) if _CJK.match(words[-1]) else words[-1]


def _sentences(text: str) -> list[tuple[str, bool, bool]]:
    """Sentences outside code: text, whether the line ends with it, whether it has a terminator."""
    out: list[tuple[str, bool, bool]] = []
    code = False
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        fences = len(_FENCES.findall(line)) if "```" in line or "~~~" in line else 0
        if fences or code or line.lstrip().startswith("|"):
            code ^= fences % 2 == 1
            continue
        parts = [s.strip() for s in _SENTENCES.split(line[_LEAD.match(line).end() :]) if s and not s.isspace()]
        last = len(parts) - 1
        for i, s in enumerate(parts):
            bare = s.rstrip(CLOSERS)
            out.append((s, i == last, bare[-1:] in TERMINATORS and bool(bare)))
    return out


def examine(text: str) -> dict:
    """What is known of a text's end from the text alone, and the last sentence's keys."""
    shown = visible_end(text)
    found = {"verdict": None, "marked": False, "open3": None, "open2": None, "open1": None, "n": 0, "final": None, "style": None}
    if not shown:
        return found | {"verdict": "whole"}
    while m := MARKS.search(shown, len(shown) - MARK):
        found["marked"] = True
        shown = visible_end(shown[: m.start()])
    if not shown:
        return found | {"verdict": "cut"}
    if what := open_at_end(shown):
        return found | {"verdict": "cut", "style": what}
    last = shown[-1]
    line = shown[shown.rfind("\n") + 1 :]
    if not found["marked"]:
        if last in TERMINATORS or line.lstrip().startswith("|") or _LAST_FENCE.search(shown):
            return found | {"verdict": "whole"}
        if last in CLOSERS and shown.rstrip(CLOSERS)[-1:] in TERMINATORS:
            return found | {"verdict": "whole"}
        if unicodedata.category(last) in ("So", "Sk") or last in "‍":
            return found | {"verdict": "whole"}
        if last in ",:(-–—/=+&[{<“«，：、":
            return found | {"verdict": "cut", "style": "comma"}
    parts = [s for s in _SENTENCES.split(_LEAD.sub("", line)) if s and s.strip()]
    words = _words(parts[-1]) if parts else []
    while len(words) > 1 and len(words[0]) <= 3 and not _CJK.match(words[0]) and not re.search(r"[a-z0-9]", unicodedata.normalize("NFC", words[0])):
        words.pop(0)  # stray symbols before the sentence
    if not words:
        return found | {"verdict": "cut" if found["marked"] else "whole"}
    return found | {
        "open3": " ".join(words[:3]), "open2": " ".join(words[:2]), "open1": words[0], "n": len(words), "final": _final(words),
        "style": "sentence" if len(parts) > 1 else "item" if _LEAD.match(line).group().strip() else "line",
    }


_SCHEMA = (
    "kind string, key string, n int, cnt long, doc_id long, source string, chars int, text_hash long, "
    "verdict string, marked boolean, open3 string, open2 string, open1 string, final string, style string"
)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    words_: Counter = Counter()
    ends: Counter = Counter()
    opens: tuple[Counter, ...] = (Counter(), Counter(), Counter())

    def flush() -> pd.DataFrame:
        rows = [("word", w, 0, c) for w, c in words_.items()] + [("end", w, 0, c) for w, c in ends.items()]
        rows += [(f"open{k}", key, n, c) for k, own in enumerate(opens, 1) for (key, n), c in own.items()]
        for own in (words_, ends, *opens):
            own.clear()
        out = pd.DataFrame(rows, columns=columns[:4]).astype({"n": "int32"})
        return out.assign(**dict.fromkeys(columns[4:]))

    for batch in batches:
        docs = []
        for doc, text, source, hashed in zip(batch["doc_id"], batch["text"], batch["source"], batch["text_hash"], strict=True):
            e = examine(text)
            docs.append(("doc", None, e["n"], None, doc, source, len(text), hashed, e["verdict"], e["marked"], e["open3"], e["open2"], e["open1"], e["final"], e["style"]))
            told = _sentences(visible_end(text))
            last = len(told) - 1
            for i, (s, whole_line, terminated) in enumerate(told):
                words = _words(s)
                if not words:
                    continue
                words_.update(words)
                if _CJK.match(words[-1]):
                    words_.update(map("".join, zip(words, words[1:], strict=False)))
                if (i < last and (whole_line or terminated)) or (i == last and terminated and e["verdict"] == "whole"):
                    n = min(len(words), 200)
                    ends[_final(words)] += 1
                    opens[0][words[0], n] += 1
                    opens[1][" ".join(words[:2]), n] += 1
                    opens[2][" ".join(words[:3]), n] += 1
            if len(words_) + len(opens[2]) > COUNTS_KEPT:
                yield flush()
        if docs:
            yield pd.DataFrame(docs, columns=columns)
    if words_:
        yield flush()


def find_truncated(documents: DataFrame) -> DataFrame:
    """doc_id, source, truncated and reason of documents (doc_id, text, source), one row per row.

    A document is truncated if its end is open, or has a cut mark or no terminator and can't be
    the end of a sentence: its last sentence is shorter than sentences with the same opening are
    (fifth percentile), or ends on a word that doesn't end sentences. Lines that many different
    texts of the corpus close with (greetings, trailers) are whole; where nothing is known of
    the last line, the word's record decides, and at a length that piles up in the source the
    text counts as cut, also when only the missing terminator speaks for it. Null and blank texts are whole; other columns are ignored.
    """
    texts = documents.select("doc_id", "text", "source")
    rows = texts.where("text is not null").select("doc_id", "text", "source", F.xxhash64("text").alias("text_hash"))
    read = materialize(rows.mapInPandas(_read, _SCHEMA), "ends")
    docs = read.where("kind = 'doc'").drop("kind", "key", "cnt")
    ends = read.where("kind in ('end', 'word')").groupBy(F.col("key").alias("final")).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "end", F.col("cnt"))), F.lit(0)).alias("ends"),
        F.coalesce(F.sum(F.when(F.col("kind") == "word", F.col("cnt"))), F.lit(0)).alias("occurs"),
    )
    lengths = (
        read.where("kind in ('open1', 'open2', 'open3')")
        .groupBy("kind", "key")
        .agg(F.sum("cnt").alias("seen"), F.expr("percentile(n, 0.05, cnt)").alias("least"))
        .where(F.col("seen") >= SEEN)
    )
    closing = (
        docs.where("verdict is null and style = 'line'")
        .select("open1", "n", "text_hash")
        .distinct()
        .groupBy("open1", "n")
        .agg(F.count("*").alias("closes"))
        .where(F.col("closes") >= SEEN)
    )
    texts_of = docs.groupBy("source", "chars").agg(F.count("*").alias("here"))
    span = F.sequence(F.col("chars") - 2, F.col("chars") + 2)
    around = texts_of.select("source", F.explode(span).alias("chars"), "here").groupBy("source", "chars").agg(F.sum("here").alias("near"))
    piles = texts_of.join(around, ["source", "chars"]).where((F.col("here") >= PILE) & (F.col("here") * 4 >= (F.col("near") - F.col("here")) * PILE_X)).select("source", "chars", F.lit(True).alias("piled"))
    known = docs.where("verdict is null")
    for k in (3, 2, 1):
        part = lengths.where(F.col("kind") == f"open{k}").select(F.col("key").alias(f"open{k}"), F.col("least").alias(f"least{k}"))
        known = known.join(part, f"open{k}", "left")
    known = known.join(ends, "final", "left").join(closing, ["open1", "n"], "left").join(piles, ["source", "chars"], "left")
    least = F.coalesce("least3", "least2", "least1")
    ended = (F.coalesce("ends", F.lit(0)) >= 2) & (F.col("ends") >= 0.01 * F.col("occurs"))
    formula = (F.col("style") == "line") & F.col("closes").isNotNull() & F.col("least2").isNull() & (least.isNull() | ~F.col("marked") & (F.col("n") >= least))
    reason = (
        F.when(formula, None)
        .when(least.isNotNull() & (F.col("n") < least), "short")
        .when(~ended, "word")
        .when((least.isNull() | (F.col("style") == "sentence")) & F.coalesce("piled", F.lit(False)), "length")
        .when(least.isNull() & F.col("marked"), "mark")
    )
    judged = known.select("doc_id", "source", reason.alias("reason"))
    settled = docs.where("verdict is not null").select("doc_id", "source", F.when(F.col("verdict") == "cut", F.coalesce("style", F.lit("mark"))).alias("reason"))
    empty = texts.where("text is null").select("doc_id", "source", F.lit(None).cast("string").alias("reason"))
    return judged.unionByName(settled).unionByName(empty).select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source: n_docs, n_truncated and their share; documents without source form a row of their own."""
    cut = F.count_if("truncated")
    return found.groupBy("source").agg(F.count("*").alias("n_docs"), cut.alias("n_truncated"), F.round(cut / F.count("*"), 6).alias("share"))
