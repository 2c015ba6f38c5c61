"""Queries on manifests, chunks, sources and their policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.operators import context, evaluation, manifest, policy
from corpusmith.plans.registry import Registry
from corpusmith.sources.tables import table

MANIFESTS = Registry()


@MANIFESTS.add("""select coalesce(f.workspace_id, s.workspace_id) workspace_id, coalesce(f.path, s.path) path, case when f.path is null then 'delete' else 'upsert' end change
from (select distinct workspace_id, path, hash from files) f full join (select distinct workspace_id, path, blob_hash from workspace_sources) s using (workspace_id, path) where f.hash is distinct from s.blob_hash""".replace("f.workspace_id, s.workspace_id", "workspace_id, workspace_id").replace("coalesce(f.path, s.path) path", "path"))
def manifest_difference(spark, directory):
    """What turns the sources' manifest into the indexed one."""
    now = table(spark, directory, "files").select("workspace_id", "path", F.col("hash").alias("digest"))
    was = table(spark, directory, "workspace_sources").select("workspace_id", "path", F.col("blob_hash").alias("digest"))
    return manifest.difference(now, was, ["workspace_id", "path"], "digest")


@MANIFESTS.add("""select workspace_id, path, hash, size from (select distinct workspace_id, path, hash, size from files f where not exists (select 1 from workspace_sources s where s.workspace_id = f.workspace_id and s.path = f.path))
union all select distinct workspace_id, path, blob_hash, size from workspace_sources""")
def manifest_upsert(spark, directory):
    """The indexed manifest with the sources' rows in place of its own."""
    base = table(spark, directory, "files").select("workspace_id", "path", "hash", "size").distinct()
    changes = table(spark, directory, "workspace_sources").select("workspace_id", "path", F.col("blob_hash").alias("hash"), "size").distinct()
    return manifest.upsert(base, changes, ["workspace_id", "path"])


@MANIFESTS.add("""select workspace_id, path, hash from (select distinct workspace_id, path, hash from files)
union all select distinct workspace_id, path, blob_hash from workspace_sources s where not exists (select 1 from files f where f.workspace_id = s.workspace_id and f.path = s.path)""")
def insert_if_absent(spark, directory):
    """Source rows that the index lacks."""
    base = table(spark, directory, "files").select("workspace_id", "path", "hash").distinct()
    return manifest.insert_absent(base, table(spark, directory, "workspace_sources").select("workspace_id", "path", F.col("blob_hash").alias("hash")), ["workspace_id", "path"])


@MANIFESTS.add("""select distinct id, workspace_id, path from chunks c where not exists (select 1 from workspace_sources s where s.workspace_id = c.workspace_id and s.path = c.path)""")
def replace_chunks(spark, directory):
    """The chunks left when those of changed files are taken out."""
    chunks = table(spark, directory, "chunks").select("id", "workspace_id", "path").distinct()
    return manifest.without(chunks, table(spark, directory, "workspace_sources"), ["workspace_id", "path"])


@MANIFESTS.add("""select coalesce(f.workspace_id, i.workspace_id) workspace_id, coalesce(f.path, i.path) path, case when f.path is null then 'drop' when i.path is not null and f.hash is not distinct from i.h and i.v = 2 then 'keep' else 'index' end action
from (select distinct workspace_id, path, hash from files) f full join (select distinct workspace_id, path, blob_hash h, 2 - (size % 3 = 0)::int v from workspace_sources) i on f.workspace_id = i.workspace_id and f.path = i.path""")
def incremental_reindex(spark, directory):
    """K2, K3: which files to index again, to keep or to drop."""
    index = table(spark, directory, "workspace_sources").select("workspace_id", "path", F.col("blob_hash").alias("digest"), (2 - (F.col("size") % 3 == 0).cast("int")).alias("tokenizer_version"))
    files = table(spark, directory, "files").select("workspace_id", "path", F.col("hash").alias("digest"))
    return manifest.reindex_plan(files, index, ["workspace_id", "path"], "digest", 2)


@MANIFESTS.add("select id, content from (select id, content, row_number() over (partition by id order by content) n from chunks) where n = 1 and contains(lower(content), 'checksum') order by id limit 50")
def substring_filter(spark, directory):
    """The first 50 chunks by id that contain a word; the limit is the feature."""
    rows = table(spark, directory, "chunks").where(F.contains(F.lower("content"), F.lit("checksum")))
    return rows.groupBy("id").agg(F.min("content").alias("content")).orderBy("id").limit(50)


@MANIFESTS.add("select distinct workspace_id, path from files where (workspace_id, path) > ('ws-70058b9494c5', 'packages/m') order by workspace_id, path limit 100")
def keyset_page(spark, directory):
    """A page of 100 files after a key; the page size is the feature."""
    rows = table(spark, directory, "files").select("workspace_id", "path").distinct()
    return manifest.page(rows, ["workspace_id", "path"], ("ws-70058b9494c5", "packages/m"), 100)


_POLICY = [("packages", "allow"), ("packages/baba-moor-graph", "deny"), ("./packages/baba-cove-hint/", "deny"), ("packages/baba-cove-hint/src", "allow"), ("packages/baba-cove-hint/src", "deny"), ("docs", "deny")]
_POLICY_SQL = "(values " + ", ".join(f"('{p}', '{e}')" for p, e in _POLICY) + ") r(prefix, effect)"


@MANIFESTS.add(f"""with r as (select regexp_replace(regexp_replace(prefix, '^(\\./)+', ''), '/+$', '') p, effect from {_POLICY_SQL}),
f as (select distinct workspace_id, path from files),
d as (select workspace_id, path, effect, row_number() over (partition by workspace_id, path order by length(p) desc, effect = 'deny' desc) n from f join r on path = p or starts_with(path, p || '/'))
select f.workspace_id, f.path, coalesce(d.effect, 'deny') effect from f left join d on d.workspace_id = f.workspace_id and d.path = f.path and n = 1""")
def acl_longest_prefix(spark, directory):
    """What a policy says of every file; the longest prefix decides."""
    rules_ = spark.createDataFrame(_POLICY, "prefix string, effect string")
    return policy.allowed(table(spark, directory, "files").select("workspace_id", "path").distinct(), rules_, "deny")


@MANIFESTS.add("""with f as (select distinct workspace_id, path, regexp_extract(path, '^[^/]*/[^/]*') prefix from files), m as (select workspace_id, min(prefix) prefix from f group by 1)
select f.workspace_id, f.path from f join m on f.workspace_id = m.workspace_id where f.path = m.prefix or starts_with(f.path, m.prefix || '/')""")
def path_prefix(spark, directory):
    """The files of each workspace below its first folder of packages."""
    rows = table(spark, directory, "files").select("workspace_id", "path").distinct()
    first = rows.groupBy("workspace_id").agg(F.concat(F.lit("./"), F.min(F.regexp_extract("path", "^[^/]*/[^/]*", 0)), F.lit("/")).alias("prefix"))
    return rows.join(first, "workspace_id").where(policy.under(F.col("path"), F.col("prefix"))).select("workspace_id", "path")


@MANIFESTS.add("select distinct id from chunks where language = 'python' and language <> 'git-commit'")
def language_filter(spark, directory):
    """The chunks of a language."""
    return table(spark, directory, "chunks").where("language = 'python' and language <> 'git-commit'").select("id").distinct()


@MANIFESTS.add("select distinct workspace_id, path from files where not list_has_any(string_split(path, '/'), ['node_modules', '.git', '.index']) and string_split(path, '/')[1] <> 'dist'")
def watch_filter(spark, directory):
    """The files whose changes concern the index."""
    return table(spark, directory, "files").where(policy.watched(F.col("path"))).select("workspace_id", "path").distinct()


@MANIFESTS.add("select id, min(p) preview from (select id, case when length(t) > 220 then substr(t, 1, 219) || '…' else t end p from (select id, trim(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) t from chunks)) group by id")
def previews(spark, directory):
    """C11: a line of every chunk."""
    rows = table(spark, directory, "chunks").select("id", context.preview(F.col("content")).alias("p"))
    return rows.groupBy("id").agg(F.min("p").alias("preview"))


@MANIFESTS.add("select id, min(array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10))) lines from chunks where len(string_split(content, chr(10))) >= 4 group by id")
def line_ranges(spark, directory):
    """Lines 2 to 4 of every chunk that has them."""
    rows = table(spark, directory, "chunks").where(F.size(F.split("content", "\n", -1)) >= 4)
    return rows.select("id", context.line_range(F.col("content"), F.lit(2), F.lit(4)).alias("l")).groupBy("id").agg(F.min("l").alias("lines"))


@MANIFESTS.add("select id, min(t) tokens from (select id, ceil((length(content) + list_sum(list_transform(regexp_extract_all(content, '[\\x{10000}-\\x{10FFFF}]'), lambda c: 1)::int[] || [0])) / 4.0)::bigint t from chunks) group by id")
def token_estimates(spark, directory):
    """The estimated tokens of every chunk."""
    return table(spark, directory, "chunks").select("id", context.estimated_tokens(F.col("content")).alias("t")).groupBy("id").agg(F.min("t").alias("tokens"))


@MANIFESTS.add("select distinct sha256(content) hash, count(distinct id) copies, min(id) first from chunks where content is not null group by content")
def exact_copies(spark, directory):
    """Contents by digest, with the number of ids that hold them."""
    rows = table(spark, directory, "chunks").where("content is not null").select("id", F.sha2("content", 256).alias("hash"))
    return rows.groupBy("hash").agg(F.count_distinct("id").alias("copies"), F.min("id").alias("first"))


@MANIFESTS.add("select id, min(substr(sha256(path || chr(0) || start_line || chr(0) || coalesce(end_line, start_line) || chr(0) || substr(sha256(content), 1, 8)), 1, 16)) chunk_id from chunks group by id")
def chunk_identity(spark, directory):
    """Chunk ids from path, lines and content."""
    nul = F.lit("\0")
    parts = F.concat("path", nul, F.col("start_line").cast("string"), nul, F.coalesce("end_line", "start_line").cast("string"), nul, F.substring(F.sha2("content", 256), 1, 8))
    return table(spark, directory, "chunks").select("id", F.substring(F.sha2(parts, 256), 1, 16).alias("c")).groupBy("id").agg(F.min("c").alias("chunk_id"))


@MANIFESTS.add("select distinct workspace_id, path from files f where not exists (select 1 from chunks c where c.workspace_id = f.workspace_id and c.path = f.path and c.start_line > 60)")
def files_without_chunks(spark, directory):
    """Files of which no chunk begins behind line 60."""
    return manifest.without(table(spark, directory, "files").select("workspace_id", "path").distinct(), table(spark, directory, "chunks").where("start_line > 60"), ["workspace_id", "path"])


@MANIFESTS.add("""select (select count(*) from (select distinct workspace_id, path from files)) files, (select count(distinct id) from chunks) chunks, (select count(distinct vec_id) from chunk_vectors) vectors,
(select count(*) from (select distinct chunk_id from chunk_vectors) v where not exists (select 1 from chunks c where c.id = v.chunk_id)) orphan_vectors""")
def integrity_counts(spark, directory):
    """Row counts of the index and vectors without chunk."""
    chunks, vectors = table(spark, directory, "chunks").select("id").distinct(), table(spark, directory, "chunk_vectors")
    orphans = vectors.select(F.col("chunk_id").alias("id")).where("id is not null").distinct().join(chunks, "id", "left_anti")
    files = table(spark, directory, "files").select("workspace_id", "path").distinct()
    counted = {"files": files, "chunks": chunks, "vectors": vectors.select("vec_id").distinct(), "orphan_vectors": orphans}
    return spark.range(1).select(*(df.agg(F.count("*").alias("n")).scalar().alias(name) for name, df in counted.items()))


@MANIFESTS.add("""with h(hint) as (values ('ledger'), ('backoff'), ('token')), b as (select distinct workspace_id, path, regexp_extract(path, '[^/]+$') base from files),
m as (select hint, workspace_id, path, row_number() over (partition by hint order by length(path), path, workspace_id) n from h join b on contains(lower(base), hint))
select hint, workspace_id, path, n::bigint n from m where n <= 20""")
def topn_per_hint(spark, directory):
    """The 20 shortest paths of each hint; the number is the feature."""
    hints = F.explode(F.array(*map(F.lit, ("ledger", "backoff", "token")))).alias("hint")
    files = table(spark, directory, "files").select("workspace_id", "path").distinct().select("workspace_id", "path", hints)
    met = files.where(F.contains(F.lower(F.regexp_extract("path", "[^/]+$", 0)), F.col("hint")))
    from pyspark.sql import Window

    order = Window.partitionBy("hint").orderBy(F.length("path"), "path", "workspace_id")
    return met.withColumn("n", F.row_number().over(order).cast("long")).where("n <= 20").select("hint", "workspace_id", "path", "n")


@MANIFESTS.add("""with f as (select workspace_id, path, min((start_line, id)) m from chunks group by all) select workspace_id, path, m[2] id from f""")
def first_chunks(spark, directory):
    """The first chunk of every file."""
    return table(spark, directory, "chunks").groupBy("workspace_id", "path").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))


@MANIFESTS.add("""with c as (select distinct workspace_id w, path p, id, start_line a, coalesce(end_line, start_line) z, symbol from chunks),
s as (select w, p, symbol nm, a + 1 sa, a + 4 + a % 3 sz, a % 2 = 0 ex, row_number() over (partition by w, p order by a, id, symbol) ord from c where symbol is not null),
m as (select c.id, s.nm, row_number() over (partition by c.id order by ex desc, sz - sa desc, ord) n from c join s on c.w = s.w and c.p = s.p and s.sa <= greatest(c.z, c.a) and s.sz >= c.a)
select distinct c.id, m.nm as name from c left join m on m.id = c.id and n = 1""")
def interval_overlap(spark, directory):
    """The widest exported symbol that overlaps each chunk."""
    from pyspark.sql import Window

    key = F.concat_ws(":", "workspace_id", "path")
    rows = table(spark, directory, "chunks").select(key.alias("path"), "id", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "symbol").distinct()
    symbols = rows.where("symbol is not null").select(
        "path", F.col("symbol").alias("name"), (F.col("start_line") + 1).alias("start_line"), (F.col("start_line") + 4 + F.col("start_line") % 3).alias("end_line"),
        (F.col("start_line") % 2 == 0).alias("exported"), F.row_number().over(Window.partitionBy("path").orderBy("start_line", "id", "symbol")).alias("ordinal"),
    )
    spans = rows.select("path", "id", "start_line", "end_line").distinct()
    return manifest.widest_overlap(spans, symbols).select("id", "name").distinct()


@MANIFESTS.add("""select id, provider, workspace_id, name from (select s.id, provider, s.workspace_id, w.name from connector_sources s join workspaces w on w.id = s.workspace_id)""")
def sources_of_workspaces(spark, directory):
    """Connector sources with their workspace."""
    spaces = table(spark, directory, "workspaces").select(F.col("id").alias("workspace_id"), "name")
    return table(spark, directory, "connector_sources").select("id", "provider", "workspace_id").join(spaces, "workspace_id").select("id", "provider", "workspace_id", "name")


@MANIFESTS.add("""select workspace_id, id, status, base_revision from (select *, row_number() over (partition by workspace_id order by status = 'committed' desc, base_revision desc, id) n from (select distinct id, workspace_id, status, base_revision from sync_sessions)) where n = 1""")
def latest_per_workspace(spark, directory):
    """The newest session of each workspace, committed ones first."""
    rows = table(spark, directory, "sync_sessions").select("id", "workspace_id", "status", "base_revision").distinct()
    return manifest.newest(rows, ["workspace_id"], [F.desc(F.col("status") == "committed"), F.desc("base_revision"), F.col("id")]).select("workspace_id", "id", "status", "base_revision")


@MANIFESTS.add("""select session_id, sequence::bigint as sequence, epoch_us(received_at) received_us from (select session_id, sequence, received_at, row_number() over (partition by session_id order by received_at desc, sequence desc) n from (select distinct session_id, sequence, received_at from sync_changes)) where n <= 3""")
def newest_events_per_job(spark, directory):
    """the three newest changes of each session; the number is the feature."""
    rows = table(spark, directory, "sync_changes").select("session_id", F.col("sequence").cast("long").alias("sequence"), "received_at").distinct()
    return manifest.newest(rows, ["session_id"], [F.desc("received_at"), F.desc("sequence")], 3).select("session_id", "sequence", F.unix_micros("received_at").alias("received_us"))


@MANIFESTS.add("""select hash from (select distinct blob_hash hash from workspace_sources) where hash not in (select hash from files where hash is not null and size % 3 <> 0) and hash is not null""")
def missing_blobs(spark, directory):
    """Blobs that sources name and the index lacks, once a third of its files is taken out."""
    wanted = table(spark, directory, "workspace_sources").select(F.col("blob_hash").alias("hash")).where("hash is not null").distinct()
    return manifest.unreferenced(wanted, table(spark, directory, "files").where("size % 3 != 0").select("hash"), spark.createDataFrame([], "hash string"), "hash")


@MANIFESTS.add("""select id, workspace_id, epoch_us(created_at) created_us from (select *, row_number() over (partition by workspace_id order by created_at desc, id desc) n from (select distinct id, workspace_id, created_at from sync_sessions)) where n > 2 and created_at < timestamptz '2025-01-15 00:00:00+00'""")
def prunable_snapshots(spark, directory):
    """Sessions beyond the newest two of a workspace that are also old."""
    rows = table(spark, directory, "sync_sessions").select("id", "workspace_id", "created_at").distinct()
    return manifest.prunable(rows, "workspace_id", "created_at", 2, F.to_timestamp(F.lit("2025-01-15 00:00:00")), "id").select("id", "workspace_id", F.unix_micros("created_at").alias("created_us"))


@MANIFESTS.add("""select id, base_revision as revision, coalesce(revision_ok, false) promote from (select distinct s.id, s.base_revision, s.base_revision >= w.revision revision_ok from sync_sessions s join workspaces w on w.id = s.workspace_id)""")
def promotable(spark, directory):
    """Sessions whose revision isn't older than their workspace's."""
    spaces = table(spark, directory, "workspaces").select(F.col("id").alias("workspace_id"), F.concat(F.lit("rev:"), F.col("revision").cast("string")).alias("active"))
    rows = table(spark, directory, "sync_sessions").select("id", "workspace_id", F.col("base_revision").alias("revision")).distinct().join(spaces, "workspace_id")
    return rows.select("id", "revision", manifest.may_promote(F.col("revision").cast("string"), F.col("active")).alias("promote"))


@MANIFESTS.add("""with f as (select distinct workspace_id, path, hash, size from files), o as (select workspace_id, count(*) n, sum(size)::bigint bytes from f group by 1)
select workspace_id, n, bytes, case when bytes <= 50000 then 'small' when bytes <= 500000 then 'medium' else 'large' end tier from o""")
def corpus_tiers(spark, directory):
    """The size of every workspace and its tier."""
    rows = table(spark, directory, "files").select("workspace_id", "path", "hash", "size").distinct().groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return rows.withColumn("tier", F.when(F.col("bytes") <= 50000, "small").when(F.col("bytes") <= 500000, "medium").otherwise("large"))


@MANIFESTS.add("""select distinct f.workspace_id, f.path from files f where exists (select 1 from (values ('record_path'), ('graph'), ('src/rank'), ('packages/baba-cove-hint')) s(spec) where lower(f.path) = spec or starts_with(lower(f.path), spec || '.') or starts_with(lower(f.path), spec || '/') or contains(lower(f.path), '/' || spec || '/'))""")
def files_of_imports(spark, directory):
    """The files that an import's target may mean: the path itself, or one with its segments."""
    from corpusmith.operators.graph import resolve_targets

    files = table(spark, directory, "files").select("workspace_id", "path").distinct()
    targets = spark.createDataFrame([("record_path",), ("graph",), ("src/rank",), ("packages/baba-cove-hint",)], "target string")
    return resolve_targets(files, targets).select("workspace_id", "path").distinct()


@MANIFESTS.add("""select distinct workspace_id, path, evaluation from (select workspace_id, path, case when path like '%/src/%' then 1.0::double else 0.0::double end evaluation from files)""")
def path_coverage(spark, directory):
    """Whether each file's path covers a wanted fragment."""
    rows = table(spark, directory, "files").select("workspace_id", "path").distinct()
    return rows.select("workspace_id", "path", evaluation.path_coverage(F.array("path"), F.array(F.lit("/src/"))).alias("evaluation"))
