"""Web pages: links, text, canonical addresses, robots rules, and crawling over recorded pages."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusmith.session import materialize

# Elements whose content isn't text, elements that end a line, what isn't a page, white space and entities.
_HIDDEN = ["script", "style", "noscript", "template", "svg", "canvas"]
_BLOCKS = "article|aside|blockquote|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul"
_NO_PAGE = r"(?i)\.(?:avif|bmp|css|csv|docx?|eot|epub|gif|gz|ico|jpe?g|json|mp3|mp4|pdf|png|pptx?|rar|rss|svg|tar|tgz|ttf|webm|webp|woff2?|xlsx?|xml|zip)$"
_SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_NAMED = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
MAX_LINKS, LINK_CHARS = 500, 2048
_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z]+);", re.IGNORECASE)


def decode_entities(text: str) -> str:
    """Text with numeric entities and six named ones as characters; others stay."""

    def one(m: re.Match) -> str:
        name = m.group(1).lower()
        if name[0] != "#":
            return _NAMED.get(name, m.group())
        code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m.group()

    return _ENTITY.sub(one, text) if "&" in text else text


@F.pandas_udf(T.StringType())
def entities_decoded(text: pd.Series) -> pd.Series:
    """:func:`decode_entities` of a column."""
    return text.map(lambda t: None if t is None else decode_entities(t))


def absolute_link(href: str, base: str) -> str | None:
    """What an anchor's address means on a page; None for other schemes and what isn't an address."""
    href = decode_entities(href).strip()
    if not href or len(href) > LINK_CHARS or re.match(r"(?:data|javascript|mailto|tel):", href, re.IGNORECASE):
        return None
    try:
        parts = urlsplit(urljoin(base, re.sub(r"[\t\r\n]", "", href)))
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if not parts.scheme or parts.scheme in ("http", "https") and not host:
        return None
    if parts.scheme not in ("http", "https"):
        return urlunsplit(parts)
    at = f"{parts.netloc.rpartition('@')[0]}@" if "@" in parts.netloc else ""
    place = host if port is None or port == {"http": 80, "https": 443}[parts.scheme] else f"{host}:{port}"
    folded: list[str] = []
    segments = parts.path.split("/")[1:] if parts.path else [""]
    for i, segment in enumerate(segments):
        if segment in (".", ".."):
            if segment == ".." and folded:
                folded.pop()
            if i == len(segments) - 1:
                folded.append("")
        else:
            folded.append(segment)
    return urlunsplit((parts.scheme, at + place, quote("/" + "/".join(folded), safe="/%:@!$&'()*+,;=-._~|[]^"), quote(parts.query, safe="/%:@!$&()*+,;=-._~?|[]{}^`\\"), quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?|[]{}#^\\")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _absolute(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    def one(found: list | None, url: str | None) -> list[str]:
        kept: dict[str, None] = {}
        for href in found if found is not None and url is not None else []:
            if len(kept) < MAX_LINKS and (link := absolute_link(href.strip("\"'") if href[:1] in "\"'" else href, url)):
                kept[link] = None
        return sorted(kept)

    return pd.Series([one(f, u) for f, u in zip(hrefs, base, strict=True)])


def links_of(page: Column, base: Column) -> Column:
    """The first MAX_LINKS different addresses that a page's anchors name, absolute and sorted; mail, script, data and phone links don't count."""
    hrefs = F.regexp_extract_all(page, F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"), 1)
    return _absolute(hrefs, base)


def canonical(url: Column, origin: str | None = None, prefix: str = "/") -> Column:
    """An address as it is crawled: host in lower case, a path; null for those that aren't crawled.

    These are other schemes and origins, addresses with a query, a fragment or a user, outside the
    path prefix, with a broken escape, or of files that aren't pages by their extension.
    """
    bare = F.trim(url)
    scheme, host, path = (F.regexp_extract(bare, r"^(?i)(https?)://([^/?#@]+)(/[^?#]*)?$", i) for i in (1, 2, 3))
    path = F.when(path == "", "/").otherwise(path)
    made = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path)
    good = (scheme != "") & ~path.rlike("%(?![0-9A-Fa-f]{2})") & (path.startswith(prefix) | (path == F.lit(prefix.rstrip("/")))) & ~F.url_decode(F.regexp_replace(F.regexp_replace(path, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")).rlike(_NO_PAGE)
    if origin:
        good = good & (F.concat(F.lower(scheme), F.lit("://"), F.lower(host)) == origin.lower().rstrip("/"))
    return F.when(good, made)


def document_path(url: Column) -> Column:
    """The path under which a page is kept: ``website/<path>.md``, ``index`` for folders, other characters as ``-``."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)?", 1), "^/+", "")
    path = F.url_decode(F.regexp_replace(F.regexp_replace(path, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25"))
    path = F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path)
    safe = F.transform(F.split(path, "/"), lambda s: F.when(s == "", "page").otherwise(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "-")))
    return F.concat(F.lit("website/"), F.array_join(safe, "/"), F.lit(".md"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def title(page: Column, fallback: Column | None = None) -> Column:
    """The title on one line, without tags and with its entities as characters; where there is no element the fallback."""
    found = F.regexp_extract_all(page, F.lit(r"(?i)<title\b[^>]*>([\s\S]*?)</title\s*>"), 1)
    plain = entities_decoded(F.regexp_replace(F.get(found, F.lit(0)), "<[^>]+>", " "))
    return F.coalesce(_trimmed(F.regexp_replace(plain, f"{_SPACE}+", " ")), fallback if fallback is not None else F.lit(None))


def text_of(page: Column) -> Column:
    """The text of a page: without comments and hidden elements, a space for each tag and a line for each block, lines that aren't blank joined by a blank line."""
    plain = F.regexp_replace(page, r"<!--[\s\S]*?-->", " ")
    for tag in _HIDDEN:
        plain = F.regexp_replace(plain, rf"(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}\s*>", " ")
    plain = F.regexp_replace(plain, r"(?i)<(?:br|hr)\b[^>]*/?\s*>", "\n")
    plain = F.regexp_replace(plain, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    plain = F.regexp_replace(entities_decoded(F.regexp_replace(plain, "<[^>]+>", " ")), "\r\n?", "\n")
    lines = F.transform(F.split(plain, "\n", -1), lambda line: _trimmed(F.regexp_replace(line, "[\t ]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n\n")


def document(page: Column, url: Column) -> Column:
    """The document of a page: its title (else its path, else its host), where it is from, and its text."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    head = title(page, F.when(path == "", "/").otherwise(path))
    head = F.when(head == "", F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)).otherwise(head)
    return F.concat(F.lit("# "), head, F.lit("\n\nSource: "), url, F.lit("\n\n"), text_of(page), F.lit("\n"))


def documents(pages: DataFrame) -> DataFrame:
    """url, path, content, revision and bytes of pages (url, html), one row per address.

    Of pages that are kept under one path, the smallest address has it; the others' paths carry
    the first eight digits of their address's digest. Of repeated addresses the smallest content
    counts; rows without address or page are left out.
    """
    rows = pages.where("url is not null and html is not null").select("url", document_path(F.col("url")).alias("path"), document(F.col("html"), F.col("url")).alias("content"))
    once = rows.groupBy("url", "path").agg(F.min("content").alias("content"))
    firsts = once.groupBy("path").agg(F.min("url").alias("_first"))
    marked = F.concat(F.regexp_replace("path", r"\.md$", "--"), F.substring(F.sha2("url", 256), 1, 8), F.lit(".md"))
    placed = once.join(firsts, "path").withColumn("path", F.when(F.col("url") == F.col("_first"), F.col("path")).otherwise(marked))
    return placed.select("url", "path", "content", F.sha2("content", 256).alias("revision"), F.octet_length("content").alias("bytes"))


def robots_rules(text: str, agent: str) -> list[tuple[str, bool]]:
    """The rules (pattern, allow) for an agent in a robots.txt: those of the groups that name it, else of ``*``."""
    groups: list[tuple[set[str], list[tuple[str, bool]]]] = []
    open_ = False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((value, key == "allow"))
    named = [r for agents, r in groups if any(a != "*" and a in agent.lower() for a in agents)]
    chosen = named or [r for agents, r in groups if "*" in agents]
    return [rule for r in chosen for rule in r]


def robots_allowed(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the longest rule that a path meets allows it; allowing wins ties, and nothing met allows."""
    best = F.struct(F.lit(-1).alias("n"), F.lit(True).alias("allow"))
    for pattern, allow in rules:
        expression = "^" + re.escape(pattern.removesuffix("$")).replace(r"\*", ".*") + ("$" if pattern.endswith("$") else "")
        best = F.greatest(best, F.when(path.rlike(expression), F.struct(F.lit(len(pattern)).alias("n"), F.lit(allow).alias("allow"))).otherwise(F.struct(F.lit(-1).alias("n"), F.lit(True).alias("allow"))))
    return best["allow"]


def crawl(pages: DataFrame, root: str, depth: int = 3, most: int = 100_000, rules: list[tuple[str, bool]] | None = None, prefix: str = "/", most_bytes: int | None = None) -> DataFrame:
    """url and depth of the pages reached from the root within ``depth`` steps, at most ``most``, nearest and smallest first.

    ``pages`` (url, html) holds what was fetched; addresses that aren't in it are reached but lead
    nowhere. Links are followed within the root's origin and the path prefix, as far as the robots
    rules allow. Each step is a join of the frontier with the links. With ``most_bytes``, a page
    comes out while it and those before it have no more bytes than that.
    """
    origin = "/".join(root.split("/")[:3])
    own = pages.withColumn("_source", canonical(F.col("url"), origin, prefix)).where("_source is not null")
    edges = own.select(F.col("_source").alias("source"), F.explode(links_of(F.col("html"), F.col("url"))).alias("l")).select("source", canonical(F.col("l"), origin, prefix).alias("url"))
    keep = F.col("url").isNotNull()
    if rules:
        keep = keep & robots_allowed(F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1), rules)
    found = reach(edges.where(keep), root, depth)
    if most_bytes is not None:
        sizes = own.groupBy(F.col("_source").alias("url")).agg(F.max(F.octet_length("html")).alias("_bytes"))
        before = Window.orderBy("depth", "url").rowsBetween(Window.unboundedPreceding, 0)  # most rows at most are left of it
        sized = found.join(sizes, "url", "left").orderBy("depth", "url").limit(most)
        found = sized.withColumn("_sum", F.sum(F.coalesce("_bytes", F.lit(0))).over(before)).where(F.col("_sum") <= most_bytes).select("url", "depth")
    return found.orderBy("depth", "url").limit(most)


def reach(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """url and depth of what is reached from the root by edges (source, url) within ``depth`` steps."""
    edges = materialize(edges.distinct(), "edges")
    seen = edges.sparkSession.createDataFrame([(root, 0)], "url string, depth int")
    frontier = seen
    for step in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("url").alias("source")), "source").select("url").distinct().join(seen.select("url"), "url", "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(step)), "frontier")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen
