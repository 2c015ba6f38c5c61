"""What source code declares and imports."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# The forms of declarations in the order in which they are looked for, words that aren't names, and import forms.
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|readonly|override|abstract|async|get|set|final|open|suspend)\s+)*"
_TYPED = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|virtual|async|open|sealed|extern)\s+)*"
_NATIVE = r"(?:(?:static|inline|extern|const|unsigned|signed|volatile|constexpr|virtual|explicit|friend)\s+)*"
_VALUE = r"(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"
_DECLARATIONS = [
    re.compile(p, re.MULTILINE | re.ASCII)
    for p in (
        r"(?:function\*?|class|interface|type|enum|def|fn|func|struct|trait|mod|fun|protocol|extension|namespace|record|object|actor)\s+([A-Za-z_$][\w$]*)",
        r"(?:const|let|var|val)\s+([A-Za-z_$][\w$]*)\s*=",
        r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)",
        r"\bfunc\s+\([^)]*\)\s+([A-Za-z_$][\w$]*)\s*\(",
        rf"^\s*{_MODIFIERS}\*?([A-Za-z_$][\w$]*)\s*(?:<[^>{{}}]*>)?\s*\([^;{{}}]*\)\s*(?::[^{{]+)?\{{",
        rf"^\s*{_TYPED}(?:[\w$<>\[\],.?]+\s+)+([A-Za-z_$][\w$]*)\s*\([^;{{}}]*\)\s*(?:throws\s+[^{{]+)?\{{",
        rf"^\s*([A-Za-z_$][\w$]*)\s*:\s*{_VALUE}",
        rf"\b(?:exports|module\.exports|prototype)\.([A-Za-z_$][\w$]*)\s*=\s*{_VALUE}",
        rf"^\s*(?!(?:if|for|while|switch|catch|return)\b){_NATIVE}(?:[\w:<>*&~\s]+?)\s+([A-Za-z_~][\w]*)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{",
        r"\b([A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*\{",
        r"^#+\s+(.+)$",
    )
]
_NOT_NAMES = {"catch", "constructor", "describe", "for", "if", "it", "return", "switch", "test", "while"}
NAME_CHARS = 120
_SCRIPT_IMPORT = re.compile(r"(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)[\"']([^\"'\n]+)[\"']")
_PYTHON_IMPORT = re.compile(r"^\s*(?:from\s+([.\w]+)\s+import\b|import\s+([\w., ]+))", re.MULTILINE)
_GO_IMPORT = re.compile(r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"|^\s*import\s*\(([^)]*)\)", re.MULTILINE)


def _uncommented(content: str, language: str | None) -> str:
    """The text in which names are looked for: without comments, but for documents."""
    if language == "markdown":
        return content
    code = re.sub(r"//.*", "", re.sub(r"/\*[\s\S]*?\*/", "\n", content))
    return re.sub(r"(?m)^\s*#.*$", "", code) if language in ("python", "ruby") else code


def names_of(content: str | None, language: str | None = None) -> list[str]:
    """The declared names, each once, form by form and in each in the order in which they come; at most NAME_CHARS characters of each."""
    if not content:
        return []
    code = _uncommented(content, language)
    found = (n.strip()[:NAME_CHARS] for form in _DECLARATIONS for n in form.findall(code))
    return list(dict.fromkeys(n for n in found if n and n.lower() not in _NOT_NAMES))


def _below(path: str, target: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), target)) if target.startswith(".") else target


def imports_of(path: str | None, content: str | None) -> list[str]:
    """The targets of a file's imports; relative ones as paths, without extension for Python."""
    if not path or not content:
        return []
    kind = path.rsplit(".", 1)[-1].lower()
    out: list[str] = []
    if kind in ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue", "svelte"):
        out = [_below(path, t) for t in _SCRIPT_IMPORT.findall(content)]
    elif kind in ("py", "pyi"):
        for source, plain in _PYTHON_IMPORT.findall(content):
            for name in [source] if source else [n.split()[0] for n in plain.split(",") if n.strip()]:
                dots = len(name) - len(name.lstrip("."))
                steps = "./" + "../" * (dots - 1) if dots else ""
                out.append(_below(path, steps + name[dots:].replace(".", "/")) if dots else name.replace(".", "/"))
    elif kind == "go":
        for one, many in _GO_IMPORT.findall(content):
            out += [one] if one else re.findall(r"\"([^\"]+)\"", many)
    return list(dict.fromkeys(t for t in out if t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def names(content: pd.Series, language: pd.Series) -> pd.Series:
    """:func:`names_of` of two columns."""
    return pd.Series([names_of(c, l) for c, l in zip(content, language, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def imports(path: pd.Series, content: pd.Series) -> pd.Series:
    """:func:`imports_of` of two columns."""
    return pd.Series([imports_of(p, c) for p, c in zip(path, content, strict=True)])
