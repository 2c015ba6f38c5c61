"""Queries on source code: chunks, names, imports, and search over the index of all chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.functions.chunker import chunk_files
from corpusmith.functions.code import names
from corpusmith.operators import context, retrieval
from corpusmith.plans.registry import Registry
from corpusmith.session import still_there
from corpusmith.sources.tables import table

CODE = Registry()

TASKS = [
    (1, "where is the stale cursor merged before the lease expires"), (2, "EmptyQueryCursor handler"), (3, "packages/baba-moor-graph/outline webhook budget"), (4, "why was the tokenizer checksum changed in history"),
    (5, "Fix the snapshot publish job so that the replica retries, and then update the ledger_window cache while keeping RawRangeDiff untouched"),
]


def _tasks(spark):
    return spark.createDataFrame(TASKS, "query_id long, raw string")


@CODE.add()
def chunk_documents(spark, directory):
    """Every document cut at its headings."""
    docs = table(spark, directory, "documents").where("text is not null")
    return chunk_files(docs.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")))


@CODE.add()
def chunk_source(spark, directory):
    """The contents of all chunks of code cut again by their structure."""
    rows = table(spark, directory, "chunks").groupBy("id").agg(F.min_by("path", "content").alias("path"), F.min("content").alias("content"))
    return chunk_files(rows.select(F.concat_ws("/", "id", "path").alias("path"), "content"))


_MODIFIERS = r"(?:(?:public|private|protected|internal|static|readonly|override|abstract|async|get|set|final|open|suspend)\s+)*"
_TYPED = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|virtual|async|open|sealed|extern)\s+)*"
_NATIVE = r"(?:(?:static|inline|extern|const|unsigned|signed|volatile|constexpr|virtual|explicit|friend)\s+)*"
_VALUE = r"(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)"
#: The forms of declarations for the SQL; the one that must not begin with a word of control flow is met by leaving such lines out.
_FORMS = [
    r"(?:function\*?|class|interface|type|enum|def|fn|func|struct|trait|mod|fun|protocol|extension|namespace|record|object|actor)\s+([A-Za-z_$][\w$]*)", r"(?:const|let|var|val)\s+([A-Za-z_$][\w$]*)\s*=",
    r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)", r"\bfunc\s+\([^)]*\)\s+([A-Za-z_$][\w$]*)\s*\(", rf"(?m)^\s*{_MODIFIERS}\*?([A-Za-z_$][\w$]*)\s*(?:<[^>{{}}]*>)?\s*\([^;{{}}]*\)\s*(?::[^{{]+)?\{{",
    rf"(?m)^\s*{_TYPED}(?:[\w$<>\[\],.?]+\s+)+([A-Za-z_$][\w$]*)\s*\([^;{{}}]*\)\s*(?:throws\s+[^{{]+)?\{{", rf"(?m)^\s*([A-Za-z_$][\w$]*)\s*:\s*{_VALUE}", rf"\b(?:exports|module\.exports|prototype)\.([A-Za-z_$][\w$]*)\s*=\s*{_VALUE}",
    rf"(?m)^\s*{_NATIVE}(?:[\w:<>*&~\s]+?)\s+([A-Za-z_~][\w]*)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{", r"\b([A-Za-z_$][\w$]*)\s*\([^;{]*\)\s*\{", r"(?m)^#+\s+(.+)$",
]
_ALL_FORMS = " || ".join("regexp_extract_all(t, '" + f.replace("'", "''") + "', 1)" for f in _FORMS)


@CODE.add(rf"""with c as (select distinct id, content, language from chunks where content is not null), u as (select id, language, case when language = 'markdown' then content else regexp_replace(regexp_replace(content, '/\*[\s\S]*?\*/', chr(10), 'g'), '//.*', '', 'g') end t from c),
v as (select id, case when language in ('python', 'ruby') then regexp_replace(t, '(?m)^\s*#.*$', '', 'g') else t end t from u), n as (select id, unnest({_ALL_FORMS}) raw from v),
m as (select id, trim(substr(regexp_replace(raw, '^\s+|\s+$', '', 'g'), 1, 120)) as name from n) select distinct id, name, lower(name) name_lower from m where name <> '' and lower(name) not in ('catch', 'constructor', 'describe', 'for', 'if', 'it', 'return', 'switch', 'test', 'while')""")
def symbol_names(spark, directory):
    """The names that every chunk declares."""
    rows = table(spark, directory, "chunks").select("id", F.explode(names("content", "language")).alias("name"))
    return rows.distinct().withColumn("name_lower", F.lower("name"))


_kept: dict[tuple[str, str], retrieval.Index] = {}


def _index(spark, directory):
    """The index over all chunks of a folder; it is kept for the session as long as its tables are there, so later queries read them."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _kept or not all(map(still_there, _kept[key].values())):
        _kept[key] = retrieval.build_index(table(spark, directory, "chunks"))
    return _kept[key]


@CODE.add()
def hybrid_search(spark, directory):
    """Ten hits of each task over all chunks."""
    hits = retrieval.search(_tasks(spark), _index(spark, directory), 10)
    return hits.withColumn("final", F.round("final", 6)).drop("content")


@CODE.add()
def symbol_search(spark, directory):
    """Chunks that declare what the tasks name."""
    plans = retrieval.plan_queries(_tasks(spark))
    return retrieval.symbol_channel(plans, _index(spark, directory)).withColumn("score", F.round("score", 6))


@CODE.add()
def path_hint_search(spark, directory):
    """First chunks of the files that the tasks' words name."""
    plans = retrieval.plan_queries(_tasks(spark))
    return retrieval.path_channel(plans, _index(spark, directory)).withColumn("score", F.round("score", 6))


@CODE.add()
def task_subqueries(spark, directory):
    """The focused parts of the tasks."""
    return retrieval.planned_subqueries(_tasks(spark))


@CODE.add()
def task_context(spark, directory):
    """The context packed for each task, its subqueries' discoveries included."""
    hits = retrieval.search_with_subqueries(_tasks(spark), _index(spark, directory), 12)
    rows = hits.withColumn("start_line", F.col("start_line").cast("int")).withColumn("end_line", F.coalesce("end_line", "start_line").cast("int"))
    return context.pack_contexts(rows, 2000)
