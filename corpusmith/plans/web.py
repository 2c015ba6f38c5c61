"""Queries on pages and commits that are made from the documents by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.operators import reports
from corpusmith.plans.registry import Registry
from corpusmith.sources import commits, web
from corpusmith.sources.tables import table

WEB = Registry()

# Pages are made from the documents: each text is escaped and cut into paragraphs, its first line is the title, and the address is made from the id.
_ADDRESS = "'https://Docs.Site.test/' || (doc_id % 7) || '/' || case when doc_id % 5 = 0 then '' when doc_id % 11 = 0 then 'page ' || doc_id || '.PDF' else 'page+' || doc_id || case when doc_id % 3 = 0 then '.html' else '' end end || case when doc_id % 13 = 0 then '?x=1' else '' end"
_TEXT = "coalesce(text, '')"
_SPACES = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^{_SPACES}+', ''), '{_SPACES}+$', '')"
_LINES = "string_split(regexp_replace(string_split(" + _TEXT + ", chr(10))[1] || chr(10) || " + _TEXT + ", '\\r\\n?', chr(10), 'g'), chr(10))"
_BODY = "array_to_string(list_filter(list_transform(" + _LINES + ", lambda l: " + _TRIM("regexp_replace(l, '[\\t ]+', ' ', 'g')") + "), lambda l: l != ''), chr(10) || chr(10))"
_FIRST = _TRIM("regexp_replace(string_split(" + _TEXT + ", chr(10))[1], '" + _SPACES + "+', ' ', 'g')")
_LINKS = "list_sort(list_distinct(['https://docs.site.test/' || (doc_id * 2 % 7) || '/page' || (doc_id * 2 % 1000) || '?a=1&b=2', 'https://docs.site.test/' || (doc_id * 3 % 7) || '/page+' || (doc_id * 3 % 1000), 'https://docs.site.test/' || (doc_id % 7) || '/up' || (doc_id % 10)]))"


def _pages(spark, directory):
    """doc_id, url and html of every document."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    number = lambda c: c.cast("string")
    last = F.when(n % 5 == 0, "").when(n % 11 == 0, F.concat(F.lit("page "), number(n), F.lit(".PDF"))).otherwise(F.concat(F.lit("page+"), number(n), F.when(n % 3 == 0, ".html").otherwise("")))
    url = F.concat(F.lit("https://Docs.Site.test/"), number(n % 7), F.lit("/"), last, F.when(n % 13 == 0, "?x=1").otherwise(""))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;")), F.lit(">"), F.lit("&#x3E;"))
    first = F.regexp_extract(escaped, r"^([^\n]*)", 1)
    body = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<P class='x'>")), F.lit("</p>"))
    anchors = F.concat(
        F.lit('<a class="l" href="/'), number(n * 2 % 7), F.lit("/page"), number(n * 2 % 1000), F.lit('?a=1&amp;b=2"></a><a href=/'), number(n * 3 % 7), F.lit("/page+"), number(n * 3 % 1000),
        F.lit("></a><A HREF='./x/../up"), number(n % 10), F.lit("'></A><a href=\"mailto:x@y.test\"></a><a href=\"JavaScript:go()\"></a><a href=\"./up"), number(n % 10), F.lit('"></a>'),
    )
    html = F.concat(F.lit("<html><head><title>"), first, F.lit("\n</title><style>p {}</style><script>if (a < b) c();</script></head><body><!-- <p>no</p> -->"), body, anchors, F.lit("</body></html>"))
    return table(spark, directory, "documents").select("doc_id", url.alias("url"), html.alias("html"))


_CANON = f"case when doc_id % 13 = 0 or doc_id % 11 = 0 and doc_id % 5 <> 0 then null else replace({_ADDRESS}, 'https://Docs.Site', 'https://docs.site') end"


@WEB.add(f"""select doc_id, {_CANON} url, 'website/' || (doc_id % 7) || '/' || case when doc_id % 5 = 0 then 'index' when doc_id % 11 = 0 then 'page-' || doc_id || '.PDF' else 'page-' || doc_id || case when doc_id % 3 = 0 then '.html' else '' end end || '.md' path from documents""")
def url_canonical(spark, directory):
    """The address under which each page is crawled, and the path it is kept under."""
    return _pages(spark, directory).select("doc_id", web.canonical(F.col("url")).alias("url"), web.document_path(F.col("url")).alias("path"))


@WEB.add(f"select doc_id, {_FIRST} title from documents")
def html_title(spark, directory):
    """The title of every page."""
    return _pages(spark, directory).select("doc_id", web.title(F.col("html")).alias("title"))


@WEB.add(f"select doc_id, array_to_string({_LINKS}, ' ') links from documents")
def html_links(spark, directory):
    """The absolute links of every page."""
    return _pages(spark, directory).select("doc_id", F.array_join(web.links_of(F.col("html"), F.col("url")), " ").alias("links"))


@WEB.add(f"select doc_id, {_BODY} as text from documents")
def html_text(spark, directory):
    """The text of every page."""
    return _pages(spark, directory).select("doc_id", web.text_of(F.col("html")).alias("text"))


@WEB.add(f"""with d as (select doc_id, {_ADDRESS} url, {_FIRST} t, {_BODY} b from documents)
select doc_id, '# ' || case when t = '' then 'Docs.Site.test' else t end || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || b || chr(10) as content from d""")
def html_document(spark, directory):
    """The document of every page."""
    return _pages(spark, directory).select("doc_id", web.document(F.col("html"), F.col("url")).alias("content"))


@WEB.add(f"""with d as (select doc_id, {_ADDRESS} url, {_FIRST} t, {_BODY} b, 'website/' || (doc_id % 7) || '/' || case when doc_id % 5 = 0 then 'index' when doc_id % 11 = 0 then 'page-' || doc_id || '.PDF' else 'page-' || doc_id || case when doc_id % 3 = 0 then '.html' else '' end end as stem from documents),
o as (select url, stem, min('# ' || case when t = '' then 'Docs.Site.test' else t end || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || b || chr(10)) content from d group by 1, 2)
select url, stem || case when url = min(url) over (partition by stem) then '' else '--' || substr(sha256(url), 1, 8) end || '.md' path, sha256(content) revision, strlen(content)::bigint bytes from o""")
def web_snapshot(spark, directory):
    """The files that a crawl lists, each path once."""
    return web.documents(_pages(spark, directory)).select("url", "path", "revision", F.col("bytes").cast("long").alias("bytes"))


@WEB.add(f"""with recursive p as (select {_CANON} s, unnest({_LINKS}) t from documents), e as (select distinct s, t from p where s is not null and t not like '%?%'),
w as (select 'https://docs.site.test/2/page+2' url, 0 depth union select e.t, w.depth + 1 from w join e on e.s = w.url where w.depth < 4)
select url, min(depth)::int as depth from w group by 1""")
def crawl_links(spark, directory):
    """The pages within four steps of a page; the bound is the feature."""
    return web.crawl(_pages(spark, directory), "https://docs.site.test/2/page+2", 4, 1 << 30)


_ROBOTS = "User-agent: *\nDisallow: /3/\nAllow: /3/page+1*5$\nDisallow: /*.html$\nAllow: /4/\n\nUser-agent: other\nDisallow: /"


@WEB.add(f"""with d as (select doc_id, regexp_replace({_ADDRESS}, '^https://[^/]+', '') p from documents)
select doc_id, case when regexp_matches(p, '^/3/page\\+1.*5$') then true when p like '%.html' and not (p like '/4/%' and length('/4/') > length('/*.html$')) then false when p like '/3/%' then false else true end allowed from d""")
def robots(spark, directory):
    """Whether the rules of a robots file allow each page."""
    rules = web.robots_rules(_ROBOTS, "corpusbot")
    return _pages(spark, directory).select("doc_id", web.robots_allowed(F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1), rules).alias("allowed"))


_SUBJECT = "trim(regexp_replace(coalesce(nullif(string_split(coalesce(text, ''), chr(10))[1], ''), 'empty'), '[\\x{1e}\\x{1f}\\s]+', ' ', 'g'), ' ')"


def _commits(spark, directory):
    """The commits of logs, one log for each source: a line of each document's first line, and the lines of two files."""
    n, s = F.col("doc_id"), commits.SEPARATOR
    subject = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1), F.lit("")), F.lit("empty")), r"[\x{1e}\x{1f}\s]+", " "))
    head = F.concat(F.lit(f"{commits.MARK}{s}"), F.md5(n.cast("string")), F.lit(s), F.substring(F.md5(n.cast("string")), 1, 7), F.lit(f"{s}Ann "), (n % 9).cast("string"), F.lit(f"{s}2025-01-01{s}"), subject)
    names = [head, F.lit(""), F.concat(F.lit("src/a"), n.cast("string"), F.lit(".ts")), F.concat(F.lit("src/b"), (n % 10).cast("string"), F.lit(".ts"))]
    rows = table(spark, directory, "documents").select(F.coalesce("source", F.lit("none")).alias("log"), n, F.posexplode(F.array(*names)).alias("k", "value"))
    return commits.parse_log(rows.select("log", (F.col("doc_id") * 4 + F.col("k")).alias("n"), "value"))


@WEB.add(f"select md5(doc_id::varchar) hash, 'Ann ' || doc_id % 9 author, {_SUBJECT} subject, 'src/a' || doc_id || '.ts src/b' || doc_id % 10 || '.ts' files from documents")
def commit_log(spark, directory):
    """Commits parsed from logs."""
    return _commits(spark, directory).select("hash", "author", "subject", F.array_join("files", " ").alias("files"))


@WEB.add(f"""with c as (select md5(doc_id::varchar) h, substr(md5(doc_id::varchar), 1, 7) s, 'Ann ' || doc_id % 9 a, {_SUBJECT} t, doc_id from documents),
x as (select h, s, t, 'commit ' || s || ' 2025-01-01' || chr(10) || 'author: ' || a || chr(10) || 'subject: ' || t || chr(10) || 'files:' || chr(10) || '- src/a' || doc_id || '.ts' || chr(10) || '- src/b' || doc_id % 10 || '.ts' as content from c)
select substr(sha256('commit' || chr(0) || h), 1, 16) id, '.git/commits/' || s as path, 'git-commit' as language, 1 as start_line, 6 as end_line, content, substr(t, 1, 120) symbol, sha256(content) hash from x""")
def commit_chunks(spark, directory):
    """The chunk of every commit."""
    return commits.commit_chunks(_commits(spark, directory))


@WEB.add("""select count(*) filter (status = 'committed') committed, count(*) filter (status = 'aborted') aborted, (select count(*) from events) requests, (select count(*) filter (value >= 40) from events) errors, (select quantile_disc(value, 0.95) from events) p95_ms
from (select distinct id, status from sync_sessions)""")
def operator_overview(spark, directory):
    """One row on jobs and requests."""
    jobs = table(spark, directory, "sync_sessions").select("id", "status").distinct().select(F.when(F.col("status") == "committed", "succeeded").when(F.col("status") == "aborted", "failed").alias("status"))
    asked = table(spark, directory, "events").select(F.when(F.col("value") >= 40, 500).otherwise(200).alias("status"), F.col("value").alias("duration_ms"))
    return reports.overview(jobs, asked).select(F.col("succeeded").alias("committed"), F.col("failed").alias("aborted"), "requests", "errors", "p95_ms")
