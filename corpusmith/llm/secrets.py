"""Problem 6: credentials in source code and configuration, by a conditional random field.

Lines that may hold one (an assignment to a telling name, a user's password in a URL, a known
prefix, a key block) are cut into lexical tokens. A linear-chain field labels the tokens from
the shape of their value and its context; the most likely labels' spans are the credentials.
The field is trained on lines made by rule from word lists, keys and value forms.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmith.llm.crf import LinearChain

OUT, BEGIN, INSIDE = 0, 1, 2
#: Training lines, all made by rule from SEED.
TRAINING_LINES, SEED = 16_000, 20240817

# Parts of names that tell of secrets, and of names that don't hold any.
_SECRET = "password passwd passphrase pass pwd pw secret token key apikey cred credential credentials auth authorization bearer session signing sig".split()
_PUBLIC = "sha sha1 sha256 sha512 hash digest etag checksum integrity commit ref rev revision id uuid public pub cert name field label path url file column index type prefix header ttl length size count limit hint policy fingerprint".split()
_KNOWN = {*_SECRET, *_PUBLIC}
_ENDINGS = sorted((w for w in _KNOWN if len(w) > 3), key=lambda w: (-len(w), w))
_TELLING = r"(?:pass(?:w|p|\b|_|word)|pwd|(?<![a-z])pw(?![a-z])|_pass\b|\.pass\b|secret|token|key|cred|auth|session|bearer)"
_PREFIXED = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|gl[a-z]{2,4}-|xox[a-z]-|xapp-|[srp]k_(?:live|test|prod)_|sk-|eyJ|ya29\.|npm_|hf_|SG\.|dop_v1_|shp[a-z]{2}_)[A-Za-z0-9_\-]{8,}"

#: A quoted literal given to any name that has small and capital letters and digits, as keys have: at least 20 characters of one run.
_DENSE = r"[\w\]\)][\"']?\s*(?::=|=>|[:=(,])\s*[\"'`](?!sha\d+-)(?=[^\"'`\n]{0,60}[a-z])(?=[^\"'`\n]{0,60}[A-Z])(?=[^\"'`\n]{0,60}\d)[A-Za-z0-9+/_=\-]{20,}[\"'`]"
_LINE = re.compile(
    rf"(?im)(?:{_TELLING}[\w.\-]*[\"'`\])]*\s*(?::=|=>|[:=,]|\s(?:to|is|as)\s|\s)\s*(?:[a-z&.:]{{0,12}}\(?)?[\"'`][^\"'`\n]+[\"'`]"
    rf"|{_TELLING}[\w.\-]*[\"'`\])]*\s*(?::=|=>|[:=])\s*(?:(?:basic|bearer|token)\s+)?[^\s\"'`(){{}}\[\],;]{{4,}}"
    rf"|<[\w.:\-]*{_TELLING}[\w.\-]*(?:\s[^<>\n]*)?>[^<>\s]{{4,}}</"
    rf"|--?[\w\-]*{_TELLING}[\w\-]*\s+[^\s\"'`\-]\S{{3,}}"
    rf"|\b(?:login|machine|account)\s+\S+\s+(?:login\s+\S+\s+)?password\s+\S{{4,}}"
    rf"|hooks\.slack\.com/services/\S{{8,}}"
    rf"|[?&]sig=[^\s&\"'`]{{8,}}"
    rf"|\b(?:creds?|credentials?|login|user(?:name)?|account)\b[:\s]+\S+\s+[/|]\s+\S{{6,}}"
    rf"|(?:password|passphrase|pwd|\bpw)\s+(?:is|was)\s+\S{{5,}}"
    rf"|(?:authorization|auth|bearer)\W{{1,4}}(?:basic|bearer|token)\s+\S{{8,}}"
    rf"|://[^/\s:@\"'`]*:[^@/\s\"'`]+@"
    rf"|(?-i:{_PREFIXED})"
    rf"|(?-i:{_DENSE})"
    rf"|-----BEGIN )"
)
#: Characters of a long line that are labelled at a time, and at least so many more on both sides that are read with them.
WINDOW, AROUND = 20_000, 2_000
_BREAK = re.compile(r"[\s\"'`(){}\[\],;]")
#: What a line must have before it is looked at closely, in lower case.
_QUICK = re.compile(r"login|user|account|pass|pwd|pw|secret|token|key|cred|auth|session|bearer|://[^/\s]*@|-----begin |akia|asia|aiza|gh[pousr]_|glpat|xox|xapp|[sr]k_|sk-|eyj|ya29|npm_|hf_|sg\.|dop_v1|shp|gl[a-z]{2,4}-|pk_|hooks\.slack|[?&]sig=|[\"'`][a-z0-9+/_=\-]{20}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]+-----|[A-Za-z0-9+/=\s\\]*)")
_TOKEN = re.compile(r"[A-Za-z0-9]+|\n|[^\sA-Za-z0-9]")
_FIELD = re.compile(r"[^\s\"'`(){}\[\],;]+|[{<][^\s\"'`]*")
_ASSIGN = re.compile(r"^(-{0,2}[A-Za-z_][A-Za-z0-9_.\-]*)(:=|=>|=|:)(?=[^=/\s:])")
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^:@/\s]*)(:)([^@\s/]+)(@)")
_TAG = re.compile(r"^<([\w.:\-]+)>([^<>\s]+)</")
_PARAM = re.compile(r"[?&]([\w.\-]+)=([^&\s#]+)")
_HOOK = re.compile(r"hooks\.slack\.com/services/([^\s?#]+)")
_NAME = re.compile(r"^-{0,2}[A-Za-z_][A-Za-z0-9_.\-]*$")
_KEYED = re.compile(r"[\"'`\])]*\s*(?::=|=>|[:=](?!=))|[\"'`]?\s(?:to|is|as)\s|[\"'`]\]?\s*[\"'`]")
_LISTED = re.compile(r"[\"'`]\s*,")
_DONE = re.compile(r"[\"'`)\]}]*\s*[,;]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CONTINUES = re.compile(r"(?:[\"'`]\s*(\+|\.|\\|&)?|(\\))\s*$")
_LITERAL = re.compile(r"[ \t]*[+.&]?[ \t]*[\"'`][^\"'`\n]*[\"'`][ \t]*[+.&\\;,)]*[ \t]*\r?(?=\n|$)")
_JOIN = re.compile(r"^[\"'`\s+.\\&]*$")
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|%\(|<[a-z]|\*{3,}|x{5,}|\.{3}|your|example|change.?me|placeholder|insert|dummy|todo|redact|fake|sample_|^(?:none|null|nil|true|false|undefined|empty)$")
_REFERENCE = re.compile(r"(?i)^\$\{?[a-z_]\w*\}?$|env|vault|secrets?\.|config\.|settings\.|getsecret|ssm:|op://|keyring|lookup|read\(")
_WHO = {"creds", "cred", "credentials", "login", "user", "username", "account", "password", "passphrase", "pwd", "pw"}
_PLAIN = {"to", "was", "is", "as", "string", "const", "let", "var", "final", "static", "set", "export", "run", "with", "basic", "bearer", "the", "new", "return", "h", "d"}


@lru_cache(maxsize=50_000)
def parts_of(name: str) -> tuple[str, ...]:
    """The words of a name in snake, camel or kebab case."""
    out: list[str] = []
    for p in _PARTS.findall(name):
        low = p.lower()
        end = next((w for w in _ENDINGS if low != w and low.endswith(w)), None) if low not in _KNOWN else None
        out += [low[: -len(end)], end] if end else [low]
    return tuple(out)


_STYLES = [
    ("snake", re.compile(r"[a-z]+(?:_[a-z]+)*\d{0,3}")), ("camel", re.compile(r"[a-z]+(?:[A-Z][a-z]+)+\d{0,3}")), ("pascal", re.compile(r"(?:[A-Z][a-z]+)+")),
    ("upper", re.compile(r"[A-Z]+(?:_[A-Z]+)*\d{0,3}")), ("kebab", re.compile(r"[a-z]+(?:[\-.][a-z]+)+")),
    ("number", re.compile(r"-?\d+(?:\.\d+)*")), ("path", re.compile(r"[\w.\-]*(?:/[\w.\-]+)+")),
]
#: Runs of a value that its pattern tells; longer ones are as good as random.
RUNS = 7


_RUN = re.compile(r"[A-Z][a-z]{2,}|[a-z]{3,}|[a-z]+|[A-Z]+|\d+|[^A-Za-z0-9]+")


def pattern_of(value: str) -> str:
    """The kinds of a value's runs in order: w a small word, l few small letters, T a capitalized word, U capitals, d digits, s other characters."""
    out = []
    for m in _RUN.finditer(value):
        run = m.group()
        out.append("d" if run.isdigit() else "s" if not run.isalpha() else "U" if run.isupper() else "T" if run[0].isupper() else "w" if len(run) > 2 else "l")
    return "".join(out) if len(out) <= RUNS else "many"


# What the shape of a value is told by.
_SYLLABLES = re.compile(r"[A-Za-z]{3,}")
_VOWEL = re.compile(r"[aeiouyAEIOUY]")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAMELIKE = re.compile(r"[A-Za-z]+(?:[_\-.][A-Za-z]+)*[0-9]{0,3}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_INTEGRITY = re.compile(r"sha\d+-")
_PREFIX = re.compile(_PREFIXED)
_LEAD = re.compile(r"[a-z]{2,5}[-_](?=\S{12,})")
_CAPITAL = re.compile(r"[A-Z]")
_SIGNED = re.compile(r"[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+")


@lru_cache(maxsize=50_000)
def _shape(value: str) -> tuple[str, ...]:
    """Features of a whole value."""
    n = len(value)
    letters = [c for c in value if c.isalpha()]
    lower = sum(c.islower() for c in letters)
    digits = sum(c.isdigit() for c in value)
    special = n - len(letters) - digits
    classes = [("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s") for c in value]
    turns = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    words = _SYLLABLES.findall(value)
    vowels = [len(_VOWEL.findall(w)) / len(w) for w in words]
    spoken = sum(len(w) for w, v in zip(words, vowels, strict=True) if 0.2 <= v <= 0.7 and (w[1:].islower() or w.isupper())) / max(1, len(letters))
    kind = (
        "hex" if n >= 8 and _HEX.fullmatch(value) and digits else
        "digits" if digits and not letters and not special else
        "name" if _NAMELIKE.fullmatch(value) and (spoken > 0.75 or lower == len(letters) and turns <= 6) else
        "alnum" if not special else "base64" if _BASE64.fullmatch(value) else "mixed"
    )
    size = next(b for b in (3, 5, 7, 9, 11, 15, 19, 23, 31, 39, 47, 63, 95, 10**9) if n <= b)
    rough = min(5, int(6 * turns / max(n, 1)))
    out = [f"kind={kind}", f"size={size}", f"turns={rough}", f"spoken={int(4 * spoken)}", f"digits={min(3, digits)}", f"special={min(3, special)}"]
    style = next((n for n, p in _STYLES if p.fullmatch(value)), "none")
    pattern = pattern_of(value)
    out += [f"pattern={pattern}", f"marked={''.join(sorted(set(pattern))) if pattern != 'many' else pattern}"]
    out += [f"style={style}", f"style={style}&size={size}", f"kind={kind}&size={size}", f"kind={kind}&spoken={int(4 * spoken)}", f"kind={kind}&turns={rough}"]
    if kind == "hex" and n in (32, 40, 56, 64, 96, 128):
        out.append(f"hex={n}")
    if _UUID.fullmatch(value):
        out.append("uuid")
    if _INTEGRITY.match(value):
        out.append("sha-")
    if _PREFIX.match(value):
        out.append("prefixed")
    if m := _LEAD.match(value):
        out.append("lead" if len(_CAPITAL.findall(value[m.end() :])) > 2 else "leadlow")
    if _PLACEHOLDER.search(value):
        out.append("placeholder")
    if _REFERENCE.search(value):
        out.append("reference")
    if _SIGNED.fullmatch(value) and value.startswith("eyJ"):
        out.append("jwt")
    return tuple(out)


def tokens_of(text: str, key: str = "", head: str = "", names: list[tuple[int, str, str]] | None = None) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Places and features of the lexical tokens of a line (or of lines that continue it).

    ``key`` and ``head`` are those that hold where the text begins; ``names`` is filled with those at each field.
    """
    fields: list[tuple[int, int, str, str]] = []  # begin, end, key, role
    for m in _FIELD.finditer(text):
        a, b = m.span()
        if names is not None:
            names.append((a, key, head))
        own = text[a:b]
        named = _ASSIGN.match(own)
        if named:
            key, head = named.group(1), ""
            fields.append((a, a + named.end(1), "", "key"))
            a += named.end()
            own = text[a:b]
        url = _URL.match(own)
        if url:
            fields.append((a, a + url.end(2), key, "url"))
            fields.append((a + url.start(4), a + url.end(4), key, "login"))
            fields.append((a + url.end(5), b, key, "host"))
            head = ""
            continue
        tag = _TAG.match(own)
        if tag:
            fields += [(a, a + tag.end(1), "", "key"), (a + tag.start(2), a + tag.end(2), tag.group(1), "value"), (a + tag.end(2), b, "", "plain")]
            key, head = "", ""
            continue
        given = [(x.start(1), x.end(1), "webhook_secret") for x in _HOOK.finditer(own)] + [(x.start(2), x.end(2), x.group(1)) for x in _PARAM.finditer(own)] if "?" in own or "hooks." in own else []
        if given:
            begun = a
            for x, y, name in given:
                fields += [(begun, a + x, key, "url"), (a + x, a + y, name, "value")]
                begun = a + y
            if begun < b:
                fields.append((begun, b, key, "url"))
            head = ""
            continue
        bare = own.rstrip(".:=")
        quoted = a > 0 and text[a - 1] in "\"'`"
        if bare and _NAME.match(bare) and (text[b - 1] in ":=" or _KEYED.match(text, b) or quoted and _LISTED.match(text, b) or bare.startswith("-")):
            if bare.lower() in _PLAIN:
                head = bare.lower()
                fields.append((a, b, key, "plain"))
                continue
            fields.append((a, b, key, "value"))
            key, head = bare, ""
            continue
        if own.lower().strip(":") in _WHO:
            key, head = own.strip(":"), ""
            fields.append((a, b, key, "plain"))
            continue
        if own in ("/", "|"):
            head = "slash"
            fields.append((a, b, key, "plain"))
            continue
        if own.lower().strip(":") in _PLAIN:
            head = own.lower().strip(":")
            fields.append((a, b, key, "plain"))
            continue
        fields.append((a, b, key, "value" + (f"&{head}" if head in ("basic", "bearer", "slash") else "")))
        if _DONE.match(text, b):
            key, head = "", ""
    places: list[tuple[int, int]] = []
    feats: list[list[str]] = []
    at = 0
    cached: dict[int, list[str]] = {}
    block = "block" if "-----BEGIN" in text else ""
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while at < len(fields) and fields[at][1] <= a:
            at += 1
        piece = text[a:b]
        own = [f"t={piece}" if not piece.isalnum() else "t=word", "bias"]
        if block:
            own += [block, "start" if a == text.find("-----BEGIN") else "later", f"w={piece}", "private" if "PRIVATE KEY" in text else "open"]
        elif at < len(fields) and fields[at][0] <= a < fields[at][1]:
            begin, end, named, role = fields[at]
            if at not in cached:
                value = text[begin:end]
                ordered = [w for w in parts_of(named) if not w.isdigit()]
                words = set(ordered)
                told = [w for w in ordered if w in _SECRET or w in _PUBLIC]
                # what comes last says what the name holds, but for public keys
                side = "-" if not told else "P" if told[-1] in _PUBLIC or words & {"public", "pub"} else "S"
                others = min(2, len(ordered) - len(told))
                side += "d" if re.search(r"\d$", named) else ""
                quote = text[begin - 1] if begin and text[begin - 1] in "\"'`" else ""
                closed = end < len(text) and text[end] in "\"'`"
                after = text[end : end + 1]
                shape = _shape(value)
                whole = f"in={'q' if quote else 'n'}{'q' if closed else 'e' if end == len(text) or after == chr(10) else 's' if after.isspace() else 'o'}"
                base = [f"role={role}", f"side={side}", whole, *shape]
                base += [f"side={side}&{s}" for s in shape]
                base += [f"role={role}&{s}" for s in shape if not s.startswith("kind=") or "&" not in s] + [f"side={side}&{whole}", f"side={side}&{whole}&{shape[0]}"]
                base += [f"key={w}" for w in words if w in _SECRET or w in _PUBLIC]
                base += [f"others={others}&{side}", f"others={others}&{side}&{shape[0]}"]
                if ordered:
                    base.append(f"last={ordered[-1] if ordered[-1] in _SECRET or ordered[-1] in _PUBLIC else '-'}&{shape[0]}")
                # what stands on both sides, but for blanks and quotes
                beside = text[end : end + 8].lstrip(" \t\"'`")[:1] if not after or after not in "\r\n" else ""
                before = text[max(0, begin - 8) : begin].rstrip(" \t\"'`")[-2:]
                before = "word" if before[-1:].isalnum() else before
                beside = "word" if beside.isalnum() else beside
                base += [f"beside={beside}", f"before={before}", f"beside={beside}&{whole}", f"before={before}&{whole}", f"before={before}&beside={beside}"]
                if after == "(" or after == "[":
                    base += ["call", f"call&{whole}"]
                if not value[0].isalnum():
                    base += [f"lead={value[0]}", f"lead&{whole}"]
                cached[at] = base
            own += cached[at]
            own.append("start" if a == begin else "later")
            own.append(f"start&{cached[at][0]}&{cached[at][1]}" if a == begin else "later&" + cached[at][0])
        else:
            own.append("outside")
        places.append((a, b))
        feats.append(own)
    return places, feats


# --- training lines, made by rule -------------------------------------------------------------

_VOCABULARY = (
    "account action agent amount anchor answer area array asset audio badge banner barrel basket beacon binary block border bottle branch bridge buffer button "
    "cable camera candle canvas carbon carrier castle center chain chart circle client cloud cluster coffee column corner cotton counter cradle crystal "
    "damage danger dealer degree demand desert device dinner doctor domain dragon drawer editor effect engine escape estate export fabric factor family "
    "farmer father figure filter finger flight flower forest format frozen garden gentle ground growth guitar hammer handle harbor hidden hollow hunter "
    "island jacket jungle kernel ladder launch lawyer leader legend letter linear little loader locker magnet market master matrix meadow member memory "
    "method middle mirror mobile moment monkey mother narrow nature needle number object office option orange origin output oxygen packet palace parent "
    "people pepper period person planet player pocket policy portal powder prefix prince public puzzle rabbit random record region remote report result "
    "ribbon river rocket rounded salmon sample school screen season second sector server shadow signal silver simple singer socket source spider spring "
    "square stable status stream street string strong summer supply switch symbol system tablet target temple theory thread throne ticket timber tissue "
    "tunnel upper useful valley vector velvet vessel violet vision volume wallet window winter wonder worker yellow zebra"
).split()


def _password(r: random.Random) -> str:
    """A password as people and tools make them: random characters, or one to three words in any case, joined and followed by digits and marks."""
    marks = "!*#%-_?.@$+~"
    while True:
        if r.random() < 0.4:
            out = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(8, 20)))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randint(1, len(out))
                out = out[:at] + r.choice(marks) + out[at:]
        else:
            joint = lambda: r.choice(["", "", r.choice(marks), str(r.randint(0, 9)), str(r.randint(0, 99))])
            out = ""
            for i in range(r.choice([1, 2, 2, 3])):
                word = r.choice(_VOCABULARY)
                out += (joint() if i else "") + r.choice([word, word, word.title(), word.upper()])
            digits = "".join(r.choice(string.digits) for _ in range(r.choice([0, 1, 2, 2, 3, 4])))
            out += r.choice([digits, digits, r.choice(marks) + digits, digits + r.choice(marks)])
        # a bare word or name is no password to learn from
        if len(out) >= 8 and (re.search(r"\d", out) or re.search(r"[^A-Za-z0-9_.\-]", out) or pattern_of(out) == "many"):
            return out


def _value_kinds(r: random.Random) -> dict[str, str]:
    w = lambda: r.choice(_VOCABULARY)
    alnum = string.ascii_letters + string.digits
    run = lambda n, s=alnum: "".join(r.choice(s) for _ in range(n))
    hexa = "0123456789abcdef"
    return {
        "random": run(r.choice([16, 20, 24, 32, 36, 40, 43, 48])),
        "aws": r.choice(["AKIA", "ASIA"]) + run(16, string.ascii_uppercase + string.digits),
        "prefixed": r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "sk_test_", "xoxb-" + run(11, string.digits) + "-", "tok-", "npm_", "hf_", "key-", run(3, string.ascii_lowercase) + "_", run(4, string.ascii_lowercase) + "-"]) + run(r.choice([20, 24, 28, 32, 36])),
        "hexkey": run(r.choice([32, 32, 40, 48, 64]), hexa),
        "jwt": "eyJ" + run(17) + "." + "eyJ" + run(r.randint(40, 80)) + "." + run(r.randint(40, 45), alnum + "-_"),
        "password": _password(r),
        "base64key": base64.b64encode(bytes(r.getrandbits(8) for _ in range(r.choice([24, 32, 48])))).decode(),
    }


def _name(r: random.Random, words: list[str]) -> str:
    style = r.randrange(5)
    if style == 0:
        return "_".join(words)
    if style == 1:
        return words[0] + "".join(x.title() for x in words[1:])
    if style == 2:
        return "_".join(words).upper()
    if style == 3:
        return "-".join(words)
    return "".join(words) if len(words) < 3 else ".".join(words)


def _assign(r: random.Random, key: str, value: str) -> tuple[str, str, str]:
    """A line that gives ``key`` a literal: before, value, after."""
    q = r.choice("\"\"'")
    ident = re.sub(r"[^A-Za-z0-9_]", "_", key)
    forms = [
        (f"{ident} = {q}", f"{q}"), (f'  const {ident} = "', '";'), (f"let {ident} = '", "';"), (f'\t{ident} := "', '"'), (f'    String {ident} = "', '";'), (f'private static final String {ident} = "', '";'),
        (f"  {key}: ", ""), (f"  {key}: {q}", f"{q}"), (f"- {key}={''}", ""), (f"{key}=", ""), (f"export {ident}={q}", f"{q}"), (f"this.{ident} = {q}", f"{q};"), (f"  {ident}: {q}", f"{q},"), (f'os.environ.setdefault("{key}", "', '")'),
        (f"client.configure({ident}={q}", f"{q})"), (f'  "{key}": "', '",'), (f"Set `{key}` to `", "` on the host."), (f"# run with --{key}=", ""), (f"<!-- run with --{key}=", " -->"), (f"// {r.choice(_VOCABULARY)}.{key}=", ""), (f"# db.{r.choice(_VOCABULARY)}.{key}=", ""), (f"run --{key} {q}", f"{q}"), (f"-- {key}: ", ""),
        (f'options.put("{key}", "', '");'), (f'{ident}="', '" \\'), (f"| {key} | `", "` |"), (f'let {ident}: &str = "', '";'), (f'headers["{key}"] = "', '"'),
    ]
    a, b = r.choice(forms)
    return a, value, b


def training_lines(count: int = TRAINING_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the places of the credentials in them."""
    r = random.Random(seed)
    w = lambda: r.choice(_VOCABULARY)
    out: list[tuple[str, list[tuple[int, int]]]] = []
    secret_names = [["password"], ["pass"], ["key"], ["passwd"], ["pwd"], ["passphrase"], ["admin", "pass"], ["login", "pw"], ["secret"], ["client", "secret"], ["webhook", "secret"], ["token"], ["access", "token"], ["auth", "token"], ["api", "key"], ["x", "api", "key"], ["signing", "key"], ["svc", "key"], ["credential"], ["db", "password"], ["pg", "password"], ["proxy", "auth"], ["session"], ["service", "token"], ["private", "key"]]
    public_names = [["sha256"], ["checksum"], ["digest"], ["etag"], ["integrity"], ["commit"], ["base", "ref"], ["blob", "hash"], ["request", "id"], ["workspace", "id"], ["public", "key"], ["key", "id"], ["token", "type"], ["content", "hash"], ["key", "fingerprint"], ["session", "id"]]
    name_like = [["secret", "name"], ["password", "field"], ["key", "column"], ["token", "type"], ["tokenizer"], ["auth", "header"], ["token", "label"], ["password", "hint"], ["key", "prefix"], ["session", "name"], ["secret", "path"], ["author"], ["passage"], ["key", "path"]]

    def add(parts: tuple[str, str, str], secret: bool) -> None:
        line = "".join(parts)
        out.append((line, [(len(parts[0]), len(parts[0]) + len(parts[1]))] if secret else []))

    while len(out) < count:
        kind = r.random()
        values = _value_kinds(r)
        extra = [w()] if r.random() < 0.25 else []
        if kind < 0.30:  # credentials under telling names
            name = r.choice(secret_names)
            pick = r.choice(["password"] * 6 + ["random", "random", "hexkey", "hexkey", "prefixed", "prefixed", "aws", "aws", "jwt", "base64key"])
            add(_assign(r, _name(r, extra + name), values[pick]), True)
        elif kind < 0.36:  # prefixed and random keys under any name
            pick = r.choice(["prefixed", "prefixed", "aws", "random"])
            parts = _assign(r, _name(r, [w(), w()][: r.randint(1, 2)]), values[pick])
            while pick == "random" and not (parts[0].endswith(("'", '"', "`")) and re.search(_DENSE, "".join(parts))):
                parts = _assign(r, _name(r, [w(), w()][: r.randint(1, 2)]), "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.choice([24, 32, 40, 48]))))
            add(parts, True)
        elif kind < 0.44:  # passwords in URLs
            scheme = r.choice(["postgres", "mysql", "redis", "amqp", "https", "mongodb"])
            host = r.choice([f"{w()}.{w()}.{r.choice(['test', 'example', 'invalid', 'local'])}"] * 3 + ["localhost", w(), ".".join(str(r.randint(1, 254)) for _ in range(4))]) + f":{r.randint(80, 9999)}/{w()}"
            user = r.choice([w(), w() + "_" + w(), w() + str(r.randint(1, 99)), "admin", "root"])
            a, v, b = _assign(r, _name(r, r.choice([["remote"], ["database", "url"], ["endpoint"], ["broker"], ["dsn"], [w(), "url"]])), f"{scheme}://{user}:")
            if r.random() < 0.6:
                add((a + v, values["password"] if r.random() < 0.7 else values["random"][:20], f"@{host}{b}"), True)
            else:
                fill = r.choice(["${PGPASSWORD}", "${DB_PASS}", "$PASSWORD", "<password>", "****", "{password}", "%s", "xxxxx", "$(cat pw)"])
                add((a + v, fill, f"@{host}{b}"), False)
        elif kind < 0.49:  # headers
            scheme = r.choice(["Basic", "Bearer", "Bearer", "token"])
            value = base64.b64encode(f"{w()}:{values['password']}".encode()).decode() if scheme == "Basic" else r.choice([values["random"], values["jwt"], values["prefixed"]])
            form = r.choice(
                [("curl -H 'Authorization: {} ", "' https://{}.example/v1"), ('  Authorization: "{} ', '"'), ("- Authorization={} ", ""), ('headers = {{"Authorization": "{} ', '"}}'), ('String proxyAuth = "{} ', '";'), ("# curl -H 'Authorization: {} ", "' https://x.test/{}"), ('req.Header.Set("Authorization", "{} ', '")'), ('auth_header = "{} ', '"')]
            )
            if r.random() < 0.8:
                add((form[0].format(scheme), value, form[1].format(w())), True)
            else:
                add((form[0].format(scheme), r.choice(["${TOKEN}", "$TOKEN", "<token>", "<your-token>", "{token}"]), form[1].format(w())), False)
        elif kind < 0.62:  # placeholders and references under telling names
            name = _name(r, extra + r.choice(secret_names))
            if r.random() < 0.55:
                fill = r.choice(["", "changeme", "CHANGE_ME", "<YOUR_API_KEY>", "<your-token>", "insert token here", "********", "xxxxxxxxxxxxxxxx", "xxxx-xxxx-xxxx", "your-secret-here", "REDACTED", "placeholder", "example", "${DB_PASSWORD}", "${TOKEN}", "{{ vault.token }}", "$SECRET_KEY", f"${w().upper()}_{w().upper()}{r.randint(1, 99)}", f"${w().upper()}_{w().upper()}", f"${w()}", "%(password)s", "TODO", "none", "null", "dummy", "put-your-key-here", "example-key", "********************", "...", "<secret>", "YOUR_TOKEN", "test", "{{secret}}", "00000000000000000000", "op://vault/item/field", "vault:secret/data/app#key", "arn:aws:secretsmanager:eu:1:secret:app", "/run/secrets/" + w(), "secretRef:" + w()])
                add(_assign(r, name, fill), False)
            else:
                ident = re.sub(r"[^A-Za-z0-9_]", "_", name)
                ref = r.choice([f"process.env.{w().upper()}_TOKEN", 'getenv("TOKEN")', f'os.environ["{w().upper()}"]', "vault.read(path)", f"config.{w()}.{w()}", f"settings.get('{w()}')", f'System.getenv("{w().upper()}")', f"secrets.{w()}", f"read_secret('{w()}')", f"get_{w()}({w()})", f"{w()}.{w()}[{r.randint(0, 9)}]", 'os.Getenv("API_KEY")', f"load{w().title()}()"])
                form = r.choice(["{} = {}", "const {} = {};", "{} := {}", "  {}: {},", "String {} = {};", "let {} = {};", "{}={}", "  {}: {}"])
                add(("", form.format(r.choice([name, ident]), ref), ""), False)
        elif kind < 0.72:  # digests, identifiers
            hexa = "0123456789abcdef"
            run = lambda n: "".join(r.choice(hexa) for _ in range(n))
            value = r.choice([run(40), run(64), run(32), f"{run(8)}-{run(4)}-{run(4)}-{run(4)}-{run(12)}", "sha512-" + base64.b64encode(bytes(r.getrandbits(8) for _ in range(64))).decode(), "sha256-" + base64.b64encode(bytes(r.getrandbits(8) for _ in range(32))).decode(), run(7)])
            add(_assign(r, _name(r, extra + r.choice(public_names)), value), False)
        elif kind < 0.84:  # names under telling names, and other words
            value = r.choice([f"{w()}_{w()}{r.choice(['', str(r.randint(1, 99))])}", w() + w().title(), f"{w()}-{w()}", f"{w()} {w()} for the {w()}", w(), f"{w()}_{w()}_{w()}", f"/{w()}/{w()}.pem", f"{w().upper()}_{w().upper()}"])
            if r.random() < 0.5:
                add(_assign(r, _name(r, (extra or [w()]) * r.randint(0, 1) + r.choice(name_like)) + r.choice(["", "", str(r.randint(1, 99))]), value), False)
            else:  # nouns of the code that only sound telling
                noun = [w(), r.choice(["token", "session", "key", "tokenizer", "author", "passage", "secret", "auth"])]
                r.shuffle(noun)
                value = r.choice([value, value, value, f"${w().upper()}_{w().upper()}{r.randint(1, 99)}", str(r.randint(1, 99999)), f"{r.randint(1, 99)}.{r.randint(10, 999)}"])
                add(_assign(r, _name(r, ([w()] if r.random() < 0.5 else []) + noun) + r.choice(["", str(r.randint(1, 99))]), value), False)
        elif kind < 0.86:  # users and passwords in comments
            lead, end = r.choice([("# ", ""), ("// ", ""), ("-- ", ""), ("<!-- ", " -->"), ("", ""), ("/* ", " */")])
            told = r.choice(["creds", "credentials", "login", "user", "username", "account"])
            which = r.choice(["", "", r.choice(["test", "default", "shared", "local", "admin", "db", "staging", "new", "old", "prod", w()]) + " "])
            who = f"{which}{told}{r.choice([' ', ': ', ' : '])}{r.choice([w(), w() + str(r.randint(1, 99)), w() + '_' + w(), w()[:3] + '-' + w(), w() + '.' + w()])} {r.choice('/|')} "
            if r.random() < 0.25:
                add((f"{lead}{r.choice(['the', 'old', 'staging', 'db'])} {r.choice(['password', 'pw', 'passphrase'])} {r.choice(['is', 'was'])} ", values["password"], end), True)
            elif r.random() < 0.7:
                add((lead + who, values[r.choice(["password", "password", "random"])], end), True)
            else:
                add(("", lead + r.choice([who + r.choice([w(), "read-only", "<password>", "********", f"{w()}_{w()}", "see vault"]), f"user {w()} / {w()} {w()}", f"login / {w()} {w()}", f"the password is {r.choice(['rotated', 'stored', 'kept', 'optional', 'required'])} {w()}"]) + end, ""), False)
        elif kind < 0.91:  # code
            a, b, c, d = w(), w(), w(), w()
            n = r.choice(["token", "key", "session", "tokenizer", "author", "passage", "secret", "password"])
            form = r.choice(
                [f'log.info("{a} {n} for the {b}: %s", {c}_{d})', f'if {n}_{a} is None: raise ValueError("{b} {c} {d}")', f'{n}_{a}{r.randint(1, 99)} "$1" --{b} {r.randint(1, 9999)} || exit {r.randint(1, 99)}', f'{a}{n.title()}.set({b}.{c}, {{ {d}: {r.randint(1, 999)} }});', f"# rotate the {n} of the {a} weekly", f"// never log the {n} of a {b}", f'return {{"{a}_{n}": {b}_{c}, "{d}": {r.randint(1, 999)}}}', f"{a}_{n}: {{ {b}_{c}{r.choice(['', str(r.randint(1, 99))])}: {r.randint(1, 99999)}, {d}_{a}: {c}_{d} }}", f"{a}_{n}{r.randint(1, 99)}: {r.randint(10, 99999)}", f'let {n}_{a} = {b}_{c}.get("{d}_{a}");', f'{n}_{a}[{b}] = {c}("{d}")', f'UPDATE {a}_{n} SET {b} = {c} WHERE {n}_{d} = \'{a}_{b}\'', f'for {n} in "${a.upper()}"/*; do {b}_{c} "${n}"; done', f'endpoint := "https://api.{a}.test/{b}?{n}_type={c}"', f'this.{a} = Objects.requireNonNull({n}{b.title()}, "{c} {d} for the {a}");']
            )
            add(("", form, ""), False)
        elif kind < 0.95:  # key blocks
            name = r.choice(["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP PUBLIC KEY BLOCK"])
            mark = f"-----BEGIN {name}-----"
            add((r.choice(["", "  ", f'{w()} = """', f'const {w()} = "', "# "]), mark, ""), "PRIVATE" in name)
        elif kind < 0.965:  # encoded data under names that don't tell
            data = base64.b64encode(bytes(r.getrandbits(8) for _ in range(r.choice([48, 60, 75, 96, 120])))).decode()
            add(_assign(r, _name(r, [*extra, r.choice(["data", "body", "payload", "image", "icon", "font", "blob", "sample", "fixture", "bytes", w()])]), data), False)
        else:  # bare encoded data
            data = base64.b64encode(bytes(r.getrandbits(8) for _ in range(r.choice([48, 60, 75])))).decode()
            add(("", r.choice([f'    "{data}"', data, f"  {data},"]), ""), False)
    return out + _further_lines(random.Random(seed + 1), count // 3)


def _further_lines(r: random.Random, count: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Values without quotes that end before the line does: connection strings, shells, tags, parameters; and code that looks like them."""
    w = lambda: r.choice(_VOCABULARY)
    out: list[tuple[str, list[tuple[int, int]]]] = []
    while len(out) < count:
        values = _value_kinds(r)
        name = ([w()] if r.random() < 0.25 else []) + r.choice([["password"], ["passwd"], ["pwd"], ["secret"], ["token"], ["api", "token"], ["access", "token"], ["api", "key"], ["client", "secret"], ["db", "password"], ["auth", "token"]])
        key, upper, snake = _name(r, name), "_".join(name).upper(), "_".join(name)
        forms = [
            (f"Server={w()};{r.choice(['Password', 'Pwd'])}=", f";Database={w()}"), (f'"Host={w()};User Id={w()};Password=', ';"'), (f"{key}: ", f" # {w()} {w()}"), (f"{key} = ", f" ; {w()}"), (f"{upper}=", f" ./{w()}.sh"), (f"export {upper}=", ";"),
            (f"{upper}=", f" && {w()}"), (f"{w()} --{'-'.join(name)} ", f" --{w()} {w()}"), (f"{w()} --{'-'.join(name)} ", ""), (f"{w()} --{'-'.join(name)}=", f" --{w()} {w()}"), (f"<{snake}>", f"</{snake}>"), (f"  <{key}>", f"</{key}>"),
            (f"{key}: ", "\\"), (f"# {w()}.{w()}.{r.choice(['key', snake])}=", ""), (f"machine {w()}.test login {w()} password ", ""), (f"login {w()} password ", ""), (f"https://{w()}.test/{w()}?{snake}=", f"&{w()}={r.randint(1, 99)}"), (f"{{{w()}: {r.randint(1, 9)}, {key}: ", f", {w()}: {w()}}}"),
        ]
        kind = r.random()
        if kind < 0.08:
            a, v, b = f'{w()} = "https://{w()}.test/{w()}?sv={r.randint(2015, 2024)}&sig=', r.choice([values["base64key"].replace("=", "%3D"), values["random"]]), r.choice(['"', f'&se={r.randint(1, 99)}"'])
        elif kind < 0.14:
            upper_ = "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16))
            a, v, b = r.choice(["", "url: ", f"{w()}="]) + "https://hooks.slack.com/services/", f"T{upper_[:8]}/B{upper_[8:]}/{''.join(r.choice(string.ascii_letters + string.digits) for _ in range(24))}", ""
        elif kind < 0.17:
            a, v, b = f'{{"{w()}": "{w()}", "{r.choice(["private_key", "key", "privateKey"])}": "', "-----BEGIN PRIVATE KEY-----", ""
        elif kind < 0.42:
            a, b = r.choice(forms)
            v = r.choice([values["password"], values["password"], values["random"], values["hexkey"], values["prefixed"], *(f"{x}{r.randint(1000, 999999)}" for x in (w(), w()[:3], w()[:3])), f"{w()}{r.randint(0, 99)}{r.choice(string.ascii_lowercase)}{r.randint(0, 9)}"])
            v = re.sub(r"[#;&<>%?]", "-", v)
        else:
            n = r.choice(["token", "key", "session", "tokenKey", "secret", "password", "author", f"{w()}_key", f"{w()}Token"])
            d = lambda: r.choice(["", "", str(r.randint(0, 99))])
            camel = lambda: w() + "".join(w().title() for _ in range(r.randint(1, 2))) + d()
            any_ = lambda: r.choice([camel, camel, lambda: w().title() + w().title() + w().title(), lambda: f"{w()}_{w()}{d()}"])()
            dotted = lambda: r.choice([""] * 8 + ["&", "*", "<-", "!", "-", "&mut "]) + any_() + "".join("." + r.choice([w(), camel(), w().title() + w().title()]) for _ in range(r.randint(0, 2)))
            if kind < 0.5:
                a, b = r.choice(forms)
                fill = r.choice(["${TOKEN}", f"${upper}", "changeme", "<password>", f"{w()}_{w()}", f"{w()}{w().title()}", f"{w()}.{w()}", f"{w()}-{w()}", w(), "********", f"your-{w()}", "null", "true", str(r.randint(1, 99999)), "string", "string", f"{w()}.{w()}{w().title()}"])
                line = a + fill + b
            elif kind < 0.85:  # names with numbers in code
                t = r.choice([n, w() + n[:1].upper() + n[1:], w() + w().title() + n[:1].upper() + n[1:] + d(), f"{camel()}.{w().title()}{n.title()}", f"{w()}_{n}_{w()}{d()}", f"{n}{w().title()}{d()}.{w()}", f"{camel()}[{w()}.{n.title()}]"])
                call = f"{dotted()}({dotted()}, {r.choice([str(r.randint(1, 99999)), camel(), f'{r.randint(1, 99)}.{r.randint(1, 999)}'])})"
                line = r.choice(
                    [f"{t} = {call};", f"const {t} = await {call};", f"let {t} = {dotted()} ?? {call};", f"{t} = {dotted()} {r.choice('+-*')} {r.randint(1, 99999)}", f"for _, {n} := range {dotted()} {{ {t} = append({dotted()}, {dotted()}) }}", f"for ({any_()} {n} : {camel()}) {{ {call}; }}", f"return {dotted()}.map(({n}) => {call});", f"const {t} = {dotted()}.filter(({w()}) => {dotted()} > {r.randint(1, 99999)});", f"const {camel()} = {dotted()}.filter(({n}) => {dotted()} {r.choice('<>')} {r.choice([str(r.randint(1, 99999)), f'{r.randint(1, 99)}.{r.randint(1, 999)}'])});", f"for ({any_()} {n} : {camel()}) {{ {dotted()}.{w()}({dotted()}()); }}", f"select {{ case {camel()} <- {t}: case <-{dotted()}({r.randint(1, 9999)}): }}", f"{camel()} := {n}({dotted()}, {dotted()})", f"if {n} {r.choice(['>', '<', '=='])} {dotted()} {{ return {dotted()}() }}", f"{dotted()}.set({dotted()}, {{ {camel()}: {r.randint(1, 999)}, {t}: {dotted()} }});", f"export async function {camel()}({camel()}: {any_()}, {t}: number): Promise<{any_()}> {{", f"def {any_()}({t}: {any_()}, {camel()}: int = 3):", f"{t}: {dotted()}, {camel()}: {dotted()} }}", f"if {t} is None: raise ValueError({dotted()})", f"let {t} = {call}?;", f"  {t}: {dotted()},", f"public {any_()} {camel()}({any_()} {t}, int {camel()}) {{", f"{t}={dotted()}, {camel()}={dotted()})", f"{t} = {camel()}[{camel()}], {w()}"]
                )
            else:
                line = r.choice(
                    [f"if ({n} == null || {w()} != {w()}) {{", f"const {n} = {w()}.{w()}({w()});", f"{n}: {w()}.{w()}, {w()}: {w()}", f"def {w()}({n}: str = None, {w()}: int = {r.randint(1, 9)}):", f"let {n} = {w()}_{w()}; // {w()} {w()}", f"{n} = {w()}[{w()}], {w()}", f"for {n}, {w()} in {w()}.items():", f"{n}: {w().title()}{w().title()}, {w()}: string;", f"{n} := {w()}.{w().title()}{w().title()}({w()}{r.randint(1, 99)})", f"const {{ {n}: {w()}{w().title()}{r.randint(1, 99)}, {w()} }} = {w()};", f"{n} = {w()}_{w()}{r.randint(1, 99)} + {r.randint(1, 99)};", f"fn {w()}({n}: &{w().title()}, {w()}: usize) -> {w().title()} {{", f"https://{w()}.test/{w()}?{n}={w()}&page={r.randint(1, 9)}"]
                )
            out.append((line, []))
            continue
        out.append((a + v + b, [(len(a), len(a) + len(v))]))
    return out


@lru_cache(maxsize=1)
def model() -> LinearChain:
    """The field, trained on the lines made by rule; the same on every call."""
    seqs, labels = [], []
    for line, spans in training_lines():
        places, feats = tokens_of(line)
        seqs.append(feats)
        labels.append([next((BEGIN if a == s else INSIDE for s, e in spans if s <= a < e), OUT) for a, _ in places])
    return LinearChain(3).fit(seqs, labels, rounds=5, rate=0.2)


# --- finding -----------------------------------------------------------------------------------


def _continued(text: str, a: int, b: int) -> int:
    """The end of the line [a, b) with the lines on which its last literal goes on."""
    while True:
        m = _CONTINUES.search(text[max(a, b - 200) : b])
        if b >= len(text) or not m:
            return b
        more = text.find("\n", b + 1)
        more = len(text) if more < 0 else more
        if m.group(2):
            if not re.match(r"[ \t]*[A-Za-z0-9+/_\-=.!*#%]+[ \t\\\"'`;,]*\r?$", text[b + 1 : more]):
                return b
        elif not _LITERAL.match(text, b + 1) or _QUICK.search(text[b + 1 : more].lower()) and not m.group(1):
            return b
        b = more


def _sections(text: str) -> list[tuple[int, int]]:
    """Places of the lines that may hold a credential, each with the lines that continue it."""
    blocks = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    out: list[tuple[int, int]] = []
    lower = text.lower()
    if len(lower) != len(text):  # some capitals become two characters
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    at = 0
    while m := _QUICK.search(lower, at):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        at = b
        if out and a < out[-1][1] or not _LINE.search(text, a, b):
            continue
        inside = next((s for s in blocks if s[0] < a < s[1]), None)
        if inside and text.find("\n", inside[0], a) >= 0:
            continue
        if "-----BEGIN" not in text[a:b]:
            b = _continued(text, a, b)
        out.append((a, b))
        at = b
    return out


def _windows(text: str, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of [a, b): where to read from, the part whose labels count, and where to read to; no value lies across a border."""
    at = a
    while at < b:
        ends = []
        for far in (at + WINDOW, at + WINDOW + AROUND):
            m = _BREAK.search(text, far, b) if far < b else None
            ends.append(m.end() if m else b)
        since = max(a, at - AROUND)
        while since > a and not _BREAK.match(text, since - 1):
            since -= 1
        yield since, at, ends[0], ends[1]
        at = ends[0]


def find(texts: list[str], field: LinearChain) -> list[list[tuple[int, int]]]:
    """The places of the credentials in each text."""
    where: list[tuple[int, int, int, int, int]] = []
    places: list[list[tuple[int, int]]] = []
    seqs: list[list[list[str]]] = []
    for i, text in enumerate(texts):
        for a, b in _sections(text):
            names: list[tuple[int, str, str]] = []
            for since, begin, end, to in _windows(text, a, b):
                # the name that holds where the window begins may stand far before
                _, key, head = next((x for x in reversed(names) if x[0] <= since), (0, "", ""))
                seen: list[tuple[int, str, str]] | None = [] if to < b else None
                p, f = tokens_of(text[since:to], key, head, seen)
                names = [(x + since, k, h) for x, k, h in seen or []]
                where.append((i, a, since, begin, end))
                places.append(p)
                seqs.append(f)
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    labelled: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for (i, section, since, begin, end), place, labels in zip(where, places, field.decode(seqs), strict=True):
        labelled.setdefault((i, section), []).extend((a + since, b + since, y) for (a, b), y in zip(place, labels, strict=True) if begin <= a + since < end)
    for (i, _), tokens in labelled.items():
        text = texts[i]
        spans: list[list[int]] = []
        for a, b, y in tokens:
            if y == OUT:
                continue
            if y == BEGIN or not spans or spans[-1][1] < a and text[spans[-1][1] : a].strip():
                spans.append([a, b])
            else:
                spans[-1][1] = b
        for a, b in spans:
            if m := _PEM.match(text, text.rfind("-----BEGIN", 0, a + 11) if text.rfind("-----BEGIN", 0, a + 11) >= 0 else a):
                if m.start() <= a < m.end():
                    if "PRIVATE" in m.group(1):
                        found[i].append((m.start(), m.end()))
                    continue
            if found[i] and _JOIN.match(text[found[i][-1][1] : a]) and "\n" in text[found[i][-1][1] : a]:
                found[i][-1] = (found[i][-1][0], b)  # the same literal goes on in the next line
            else:
                found[i].append((a, b))
    return [sorted(set(x)) for x in found]


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the characters of credentials replaced by X, of the same length and with the same lines.

    Frames of key blocks, quotes, joins, backslashes and white space stay.
    """
    out = list(text)
    for a, b in spans:
        body = text[a:b]
        block = _PEM.match(body)
        keep = [(m.start(), m.end()) for m in re.finditer(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----", body)] if block else [(m.start(), m.end()) for m in re.finditer(r"[\"'`\\]?[ \t]*[+.&\\]?[ \t]*\r?\n[ \t+.&]*[\"'`]?", body)]
        for k in range(a, b):
            if not out[k].isspace() and out[k] not in "\"'`\\" and not any(s <= k - a < e for s, e in keep):
                out[k] = "X"
    return "".join(out)


def credentials(chunks: DataFrame, redacted: bool = False) -> DataFrame:
    """id, line, start, end of every credential in chunks (id, start_line, content), or id and redacted content.

    line is start_line plus the line feeds before the credential; start and end are code points in
    the content. With ``redacted``, every chunk with a credential gives its content with the
    credentials' characters replaced. Null and empty contents hold none; a null start_line gives
    null lines; repeated rows give repeated results.
    """
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(model())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            texts = batch["content"].tolist()
            for key, first, text, spans in zip(batch["id"], batch["start_line"], texts, find(texts, sent.value), strict=True):
                known = first is not None and first == first
                if redacted:
                    if spans:
                        rows.append((key, redact(text, spans)))
                    continue
                for a, b in spans:
                    rows.append((key, int(first) + text.count("\n", 0, a) if known else None, a, b))
            if redacted:
                yield pd.DataFrame(rows, columns=["id", "content"])
            else:
                yield pd.DataFrame(rows, columns=["id", "line", "start", "end"]).astype({"line": "Int32", "start": "int32", "end": "int32"})

    rows = chunks.select(F.col("id").cast("string").alias("id"), F.col("start_line").cast("int").alias("start_line"), "content").where("content is not null and content != ''")
    return rows.mapInPandas(read, "id string, content string" if redacted else "id string, line int, start int, end int")
