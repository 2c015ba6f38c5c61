"""Queries on what an engine does around its index: sources, leases, logs, joins of its tables, cases and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.functions.chunker import chunk_files
from corpusmith.operators import context, evaluation, graph, history, manifest, models, policy, retrieval
from corpusmith.plans.registry import Registry
from corpusmith.session import materialize
from corpusmith.sources import files as scanning
from corpusmith.sources.tables import table

ENGINE = Registry()

# --- files -------------------------------------------------------------------------------------

_BASE = "lower(regexp_extract(path, '[^/]*$'))"
_EXT = f"regexp_extract({_BASE}, '^.+\\.([^.]*)$', 1)"


@ENGINE.add(f"""select workspace_id, path, case when b like 'dockerfile.%' or b = 'dockerfile' then 'dockerfile' when b in ('makefile', 'gnumakefile') then 'makefile' when b = 'cmakelists.txt' then 'cmake'
 when b in ('build.gradle', 'build.gradle.kts') then 'gradle' when b = 'pom.xml' then 'xml'
 when x in ('ts', 'mts', 'cts') then 'typescript' when x = 'tsx' then 'tsx' when x in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when x in ('py', 'pyi') then 'python' when x = 'go' then 'go' when x = 'rs' then 'rust'
 when x = 'java' then 'java' when x in ('kt', 'kts') then 'kotlin' when x = 'scala' then 'scala' when x = 'groovy' then 'groovy' when x = 'rb' then 'ruby' when x = 'php' then 'php' when x in ('c', 'h') then 'c'
 when x in ('cc', 'cpp', 'cxx', 'c++', 'hh', 'hpp', 'hxx', 'h++', 'inl', 'ipp') then 'cpp' when x = 'cs' then 'csharp' when x = 'fs' then 'fsharp' when x = 'swift' then 'swift' when x = 'm' then 'objective-c' when x = 'mm' then 'objective-cpp'
 when x in ('vue', 'svelte', 'json', 'toml', 'sql', 'css', 'scss', 'html', 'dart', 'hcl') then x when x in ('md', 'mdx') then 'markdown' when x in ('yaml', 'yml') then 'yaml' when x in ('sh', 'bash', 'zsh') then 'shell'
 when x = 'sol' then 'solidity' when x = 'proto' then 'protobuf' when x = 'tf' then 'terraform' when x <> '' then x else 'text' end language
 from (select workspace_id, path, {_BASE} b, {_EXT} x from (select distinct workspace_id, case when size % 11 = 0 then path || '.tsx' when size % 13 = 0 then path || '.proto' when size % 17 = 0 then regexp_replace(path, '[^/]*$', 'Dockerfile.dev') else path end path from files))""")
def language_detection(spark, directory):
    """A4: the language of every file by its name; some names are changed to rarer ones."""
    n, path = F.col("size"), F.col("path")
    odd = F.when(n % 11 == 0, F.concat(path, F.lit(".tsx"))).when(n % 13 == 0, F.concat(path, F.lit(".proto"))).when(n % 17 == 0, F.regexp_replace(path, "[^/]+$", "Dockerfile.dev")).otherwise(path)
    return table(spark, directory, "files").select("workspace_id", odd.alias("path")).distinct().withColumn("language", scanning.language_of(F.col("path")))


_TEXTS = "'" + "','".join(
    "ts tsx js jsx mjs cjs mts cts py pyi go rs java kt kts scala groovy c cc cpp cxx c++ h hh hpp hxx h++ inl ipp cs fs fsx vb swift m mm vue svelte astro rb php pl pm lua r jl ex exs erl hrl hs lhs clj cljs cljc edn zig nim dart sol "
    "md mdx rst txt json jsonc json5 yaml yml toml ini cfg conf xml html htm css scss less sass sql graphql gql proto thrift avsc cmake gradle tf hcl bicep nix sh bash zsh fish ps1 bat cmd dockerfile".split()
) + "'"


@ENGINE.add(f"""select workspace_id, path, size > 0 and size <= 4000 and (x in ({_TEXTS}) or not regexp_matches(b, '^.+\\.[^.]*$') or b in ('dockerfile', 'makefile', 'gnumakefile', 'cmakelists.txt', 'build.gradle', 'build.gradle.kts', 'pom.xml') or b like 'dockerfile.%') readable
from (select *, {_BASE} b, {_EXT} x from (select workspace_id, case when size % 7 = 0 then path || '.weird' when size % 5 = 0 then regexp_replace(path, '\\.[^./]*$', '') else path end path, min(size) size from files group by 1, 2))""")
def readable_files(spark, directory):
    """A1: which files a scan reads by name and size."""
    n, path = F.col("size"), F.col("path")
    odd = F.when(n % 7 == 0, F.concat(path, F.lit(".weird"))).when(n % 5 == 0, F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)
    rows = table(spark, directory, "files").groupBy("workspace_id", odd.alias("path")).agg(F.min("size").alias("size"))
    return rows.select("workspace_id", "path", scanning.readable(F.col("path"), F.col("size"), 4000).alias("readable"))


@ENGINE.add("""with f as (select distinct workspace_id, path from files),
n as (select *, lower(path) l, regexp_extract(lower(path), '[^/]*$') b from f)
select workspace_id, path, regexp_matches(l, '(^|/)(node_modules|bower_components|vendor|dist|build|out|output|bin|obj|target|coverage|generated|gen|third_party|third-party|debug|release|benchmarks|fuzzing|testdata|test-data|venv|pods|carthage)/')
 or regexp_matches(b, '\\.(min\\.js|min\\.css|map|lock|pem|key|png|jpg|svg|pdf|zip|bin|so|a|o|lib|obj|class|jar)$') or regexp_matches(b, '(_generated\\.|\\.generated\\.)') or b in ('package-lock.json', 'pnpm-lock.yaml', 'go.sum') or regexp_matches(b, '^\\.env(\\..*)?$') and b not in ('.env.example', '.env.sample')
 or regexp_matches(l, '^packages/[^/]*/docs/[^/]*\\.md$') and b not like 'a%' or regexp_matches(l, '^packages/[^/]*/src/[^/]*_test\\.[^/]*$') excluded from n""")
def excluded_files(spark, directory):
    """A2: which files default rules and ignore files exclude; each workspace has an ignore file, and every ``src`` folder one of its own."""
    rows = table(spark, directory, "files").select("workspace_id", "path").distinct()
    none = F.lit(None).cast("string")
    top = rows.select(F.col("workspace_id").alias("root"), F.lit(".gitignore").alias("path"), F.lit("# documents\npackages/*/docs/*.md\n!a*.md\n").alias("content")).distinct()
    nested = rows.select(F.col("workspace_id").alias("root"), F.regexp_extract("path", r"^(packages/[^/]*/src)/", 1).alias("f")).where("f != ''").distinct().select("root", F.concat("f", F.lit("/.gitignore")).alias("path"), F.lit("*_test.*\n").alias("content"))
    every = rows.select(F.col("workspace_id").alias("root"), "path", none.alias("content")).unionByName(top).unionByName(nested)
    return scanning.excluded(every).where("content is null").select(F.col("root").alias("workspace_id"), "path", "excluded")


@ENGINE.add("""with b as (select doc_id, repeat(chr(0), (doc_id % 5)::int) || repeat(chr(1), (doc_id % 7 * 40)::int) || coalesce(text, '') t from documents),
h as (select doc_id, regexp_extract_all(substr(hex(encode(t)), 1, 4096), '..') p from b)
select doc_id, len(list_filter(p, lambda x: x = '00')) <= 2 and len(list_filter(p, lambda x: (x < '20' or x = '7F') and x not in ('09', '0A', '0D'))) <= 0.3 * greatest(len(p), 1) textual from h""")
def sniffed_texts(spark, directory):
    """A3: which bytes look like text; NULs and control characters are put before the texts by rule."""
    n = F.col("doc_id")
    odd = F.concat(F.repeat(F.lit("\x00"), (n % 5).cast("int")), F.repeat(F.lit("\x01"), (n % 7 * 40).cast("int")), F.coalesce("text", F.lit("")))
    return table(spark, directory, "documents").select("doc_id", scanning.decoded(F.encode(odd, "UTF-8")).isNotNull().alias("textual"))


@ENGINE.add("""with f as (select distinct workspace_id, path, coalesce(nullif(root_alias, ''), 'main') a from files), n as (select workspace_id, count(distinct a) n from f group by 1)
select workspace_id, case when n > 1 then a || '/' || path else path end path, a as root from f join n using (workspace_id)""")
def rooted_paths(spark, directory):
    """A5: the paths of every workspace, with their root's name where it has several."""
    rows = table(spark, directory, "files").select("workspace_id", "path", F.coalesce(F.nullif("root_alias", F.lit("")), F.lit("main")).alias("root")).distinct()
    several = rows.groupBy("workspace_id").agg(F.count_distinct("root").alias("_n"))
    return scanning.rooted(rows.join(several, "workspace_id"), F.col("_n") > 1).select("workspace_id", "path", "root")


@ENGINE.add("""with s as (select distinct workspace_id, id path, upper(sha256(content)) h from chunks where content is not null and start_line % 3 <> 0), b as (select distinct sha256(content) h, content from chunks where start_line % 4 <> 0 and content is not null)
select s.workspace_id, s.path, length(b.content) chars, md5(b.content) digest from s join b on lower(s.h) = b.h""")
def virtual_documents(spark, directory):
    """Manifest entries with their blobs; every chunk's content is a blob, and a third of either side is missing."""
    rows = table(spark, directory, "chunks").where("content is not null")
    sources = rows.where("start_line % 3 <> 0").select("workspace_id", F.col("id").alias("path"), F.upper(F.sha2("content", 256)).alias("blob_hash")).distinct()
    blobs = rows.where("start_line % 4 <> 0").select(F.sha2("content", 256).alias("hash"), "content")
    return manifest.virtual_documents(sources, blobs).select("workspace_id", "path", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@ENGINE.add("""select source, path, doc_id from (select coalesce(source, 'none') source, 'd' || doc_id path, doc_id from documents) where source = 'website/moor-docs0' or source = 'none'""")
def workspace_filter(spark, directory):
    """The rows of one partition, read through a partition filter of a written table."""
    rows = table(spark, directory, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    return rows.where(F.col("source").isin("website/moor-docs0", "none"))


# --- leases, queues, logs ----------------------------------------------------------------------

_NOW = "timestamptz '2025-01-20 00:00:00+00'"


def _now():
    return F.to_timestamp(F.lit("2025-01-20 00:00:00"))


@ENGINE.add(f"""select id, coalesce(expires_at <= {_NOW}, false) expired, coalesce(expires_at > {_NOW} and epoch_us(expires_at) - epoch_us({_NOW}) <= 864000000000, false) due from (select distinct id, expires_at from sync_sessions)""")
def leases(spark, directory):
    """Leases that are over, and those that end within ten days."""
    rows = table(spark, directory, "sync_sessions").select("id", "expires_at").distinct()
    return rows.select("id", history.expired(F.col("expires_at"), _now()).alias("expired"), history.due_within(F.col("expires_at"), _now(), 864_000_000).alias("due"))


@ENGINE.add(f"""with q as (select distinct id, case when status = 'planned' then 'pending' else 'processing' end status, created_at next_attempt_at, expires_at locked_at from sync_sessions)
select id, 'processing' as status, 3::bigint attempts from q where (status = 'pending' and next_attempt_at <= {_NOW}) or (status = 'processing' and epoch_us(locked_at) + 300000000 <= epoch_us({_NOW})) order by next_attempt_at, id limit 25""")
def claim_queue(spark, directory):
    """The next 25 rows of a queue that may be claimed; the number is the feature."""
    rows = table(spark, directory, "sync_sessions").select("id", F.when(F.col("status") == "planned", "pending").otherwise("processing").alias("status"), F.col("created_at").alias("next_attempt_at"), F.col("expires_at").alias("locked_at"), F.lit(2).cast("long").alias("attempts")).distinct()
    return history.claim(rows, _now(), 300_000, 25, ["id"]).select("id", "status", "attempts")


@ENGINE.add(f"""select count(*) filter (status = 'planned' and epoch_us(expires_at) + 864000000000 > epoch_us({_NOW})) active, count(*) filter (status = 'planned' and not epoch_us(expires_at) + 864000000000 > epoch_us({_NOW})) expired, count(*) filter (status <> 'planned') closed
from (select distinct id, status, expires_at from sync_sessions)""")
def session_states(spark, directory):
    """Live, expired and closed sessions."""
    rows = table(spark, directory, "sync_sessions").select("id", F.when(F.col("status") == "planned", "active").otherwise("closed").alias("status"), "expires_at").distinct()
    return history.session_states(rows, "status", "expires_at", _now(), 864_000_000)


_ROUTES = ["/webhooks/{provider}", "/workspaces/{workspace}/files/{path}", "/workspaces/{workspace}/search", "/workspaces/{workspace}", "/health"]


@ENGINE.add("""with r as (select event_id, case event_id % 6 when 0 then '/webhooks/' || event_type when 1 then '/workspaces/w' || user_id || '/search?q=' || event_type when 2 then '/workspaces/w' || user_id when 3 then '/health' when 4 then '/workspaces/w' || user_id || '/files/f' || event_id || '#x' else '/other/' || event_id end url, ['get', 'Post', 'PUT', 'TRACE', null][event_id % 5 + 1] m from events)
select event_id, case event_id % 6 when 0 then '/webhooks/{provider}' when 1 then '/workspaces/{workspace}/search' when 2 then '/workspaces/{workspace}' when 3 then '/health' when 4 then '/workspaces/{workspace}/files/{path}' else '/{unmatched}' end route, case when upper(m) in ('GET', 'HEAD', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS') then upper(m) else 'OTHER' end as method from r""")
def route_templates(spark, directory):
    """The template and method of every request."""
    n, user, kind = F.col("event_id"), F.concat(F.lit("/workspaces/w"), F.col("user_id").cast("string")), F.col("event_type")
    url = F.when(n % 6 == 0, F.concat(F.lit("/webhooks/"), kind)).when(n % 6 == 1, F.concat(user, F.lit("/search?q="), kind)).when(n % 6 == 2, user).when(n % 6 == 3, "/health").when(n % 6 == 4, F.concat(user, F.lit("/files/f"), n.cast("string"), F.lit("#x"))).otherwise(F.concat(F.lit("/other/"), n.cast("string")))
    method = F.array(*map(F.lit, ("get", "Post", "PUT", "TRACE", None)))[(n % 5).cast("int")]
    return table(spark, directory, "events").select("event_id", history.normal_route(url, [history.route_template(t) for t in _ROUTES], "/{unmatched}").alias("route"), history.normal_method(method).alias("method"))


@ENGINE.add("""select event_id, user_id, event_type from events where event_id > 4321 order by event_id limit 500""")
def event_feed(spark, directory):
    """The next 500 events after a cursor; the number is the feature."""
    return manifest.after_cursor(table(spark, directory, "events"), "event_id", 4321, 500).select("event_id", "user_id", "event_type")


@ENGINE.add("""select event_id, case when hour * 60 + minute < 150 then make_timestamp(epoch_us(date_trunc('day', l)) + 9000000000) else make_timestamp(epoch_us(date_trunc('day', l)) + 9000000000 + 86400000000) end - interval 3 hour as next_run
from (select event_id, l, date_part('hour', l) as hour, date_part('minute', l) + date_part('second', l) / 60.0 as minute from (select event_id, ts + interval 3 hour l from events))""")
def nightly_runs(spark, directory):
    """The next 02:30 in a time zone of three hours' offset."""
    run = history.next_nightly_run(F.col("ts").cast("timestamp"), "02:30", "+03:00")
    return table(spark, directory, "events").select("event_id", run.cast("timestamp_ntz").alias("next_run"))


@ENGINE.add("""with c as (select event_id, [null, null, {'c': 'ENOSPC', 'n': 'Error', 's': null}, {'c': null, 'n': 'AccessDenied', 's': 403}, {'c': null, 'n': 'ExpiredToken', 's': 403}, {'c': null, 'n': 'Odd', 's': 404}, {'c': 'ETIMEDOUT', 'n': null, 's': 500}, {'c': null, 'n': 'AbortError', 's': null}][event_id % 8 + 1] x, [null, {'c': 'EROFS', 'n': null, 's': null}, {'c': null, 'n': null, 's': 507}][event_id % 3 + 1] y from events)
select event_id, case event_id % 8 when 2 then 'capacity' when 3 then 'permission' when 4 then 'transient' when 5 then 'not_found' when 6 then 'timeout' when 7 then 'aborted' else case event_id % 3 when 1 then 'permission' when 2 then 'capacity' else 'transient' end end kind,
 case event_id % 8 when 2 then false when 3 then false when 4 then true when 5 then true when 6 then true when 7 then true else event_id % 3 = 0 end retry from c""")
def store_errors(spark, directory):
    """The kind of a store's error along its causes, and whether to try again."""
    cause = "struct<code:string,name:string,status:int>"
    make = lambda code=None, name=None, status=None: F.struct(F.lit(code).cast("string").alias("code"), F.lit(name).cast("string").alias("name"), F.lit(status).cast("int").alias("status"))
    first = F.array(make(), make(name="Error"), make("ENOSPC", "Error"), make(None, "AccessDenied", 403), make(None, "ExpiredToken", 403), make(None, "Odd", 404), make("ETIMEDOUT", None, 500), make(None, "AbortError"))
    second = F.array(make(name="Error"), make("EROFS"), make(None, None, 507))
    chain = F.array(first[(F.col("event_id") % 8).cast("int")], second[(F.col("event_id") % 3).cast("int")]).cast(f"array<{cause}>")
    rows = table(spark, directory, "events").select("event_id", history.error_kind(chain).alias("kind"))
    return rows.withColumn("retry", history.retryable(F.col("kind")))


@ENGINE.add("""select id, case when indexed is null then true else indexed <> revision - 1 end rebuild from (select id, revision, case when revision % 3 = 0 then null when revision % 3 = 1 then revision - 1 else revision - 2 end indexed from workspaces)""")
def rebuilds(spark, directory):
    """K4: workspaces whose index can't follow by changes alone."""
    from corpusmith.operators import reports

    n = F.col("revision")
    indexed = F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, n - 1).otherwise(n - 2)
    return table(spark, directory, "workspaces").select("id", reports.rebuild_needed(indexed, n).alias("rebuild"))


# --- joins -------------------------------------------------------------------------------------


@ENGINE.add("""select v.model, c.language, count(*) vectors, count(distinct c.id) chunks from (select distinct vec_id, chunk_id, model from chunk_vectors where model is not null) v join (select id, min(language) as language from chunks group by id) c on c.id = v.chunk_id group by all""")
def vectors_of_chunks(spark, directory):
    """Vectors with their chunks, counted by model and language."""
    vectors = table(spark, directory, "chunk_vectors").where("model is not null").select("vec_id", F.col("chunk_id").alias("id"), "model").distinct()
    chunks = table(spark, directory, "chunks").groupBy("id").agg(F.min("language").alias("language"))
    return vectors.join(chunks, "id").groupBy("model", "language").agg(F.count("*").alias("vectors"), F.count_distinct("id").alias("chunks"))


@ENGINE.add("""select model, count(distinct vec_id) n, row_number() over (order by count(distinct vec_id) desc, model) = 1 most from chunk_vectors where model is not null group by model""")
def vectors_of_models(spark, directory):
    """Vectors of every model, and which has most."""
    counts = table(spark, directory, "chunk_vectors").where("model is not null").groupBy("model").agg(F.count_distinct("vec_id").alias("n"))
    top = counts.orderBy(F.desc("n"), "model").limit(1).select(F.col("model").alias("m"))
    return counts.join(top, counts["model"] == top["m"], "left").select("model", "n", F.col("m").isNotNull().alias("most"))


@ENGINE.add("""with p as (select event_id, user_id, '{"artifact": ' || case event_id % 4 when 0 then 'null' when 1 then '{"key": "k' || event_id % 50 || '"}' when 2 then '{"key": 7}' else '"text"' end || '}' as manifest from events)
select distinct 'k' || event_id % 50 as key from p where event_id % 4 = 1 and user_id % 2 = 0""")
def json_joins(spark, directory):
    """Keys in the JSON of publications whose job qualifies, where the JSON has the right types."""
    n = F.col("event_id")
    inner = F.when(n % 4 == 0, "null").when(n % 4 == 1, F.concat(F.lit('{"key": "k'), (n % 50).cast("string"), F.lit('"}'))).when(n % 4 == 2, '{"key": 7}').otherwise('"text"')
    events = table(spark, directory, "events")
    published = events.select("event_id", F.parse_json(F.concat(F.lit('{"artifact": '), inner, F.lit("}"))).alias("m"))
    jobs = events.where("user_id % 2 = 0").select("event_id")
    key = F.when(F.schema_of_variant(F.try_variant_get("m", "$.artifact.key", "variant")) == "STRING", F.try_variant_get("m", "$.artifact.key", "string"))
    return published.join(jobs, "event_id").select(key.alias("key")).where("key is not null").distinct()


@ENGINE.add("""with g as (select distinct session_id, lower(blob_hash) blob_hash from sync_changes where blob_hash is not null), b as (select distinct lower(hash) h from files where hash is not null)
select session_id, blob_hash, blob_hash in (select h from b) stored from g""")
def granted_blobs(spark, directory):
    """The blobs that each session was granted, and which are there."""
    return manifest.granted(table(spark, directory, "sync_changes"), table(spark, directory, "files").select("hash"))


@ENGINE.add("""with k as (select distinct lower(blob_hash) h from sync_changes where blob_hash is not null), r as (select distinct lower(hash) h from files where hash is not null), p as (select distinct lower(blob_hash) h from workspace_sources where size % 2 = 0)
select h as hash from k where h not in (select h from r) and h not in (select h from p where h is not null)""")
def unreferenced_blobs(spark, directory):
    """Blobs of changes that no file refers to and that aren't preserved."""
    listed = table(spark, directory, "sync_changes").where("blob_hash is not null").select(F.lower("blob_hash").alias("hash")).distinct()
    return manifest.unreferenced(listed, table(spark, directory, "files").select(F.lower("hash").alias("hash")), table(spark, directory, "workspace_sources").where("size % 2 = 0").select(F.lower("blob_hash").alias("hash")), "hash")


@ENGINE.add("""select workspace_id, count(distinct id) chunks from chunks c where not exists (select 1 from files f where f.workspace_id = c.workspace_id and f.path = c.path and f.size % 3 <> 0) group by 1""")
def chunks_without_file(spark, directory):
    """How many chunks of each workspace have no file; a third of the files is taken out."""
    kept = table(spark, directory, "files").where("size % 3 <> 0")
    return manifest.without(table(spark, directory, "chunks"), kept, ["workspace_id", "path"]).groupBy("workspace_id").agg(F.count_distinct("id").alias("chunks"))


@ENGINE.add("""with i as (select distinct workspace_id query_id, id from chunks where start_line % 2 = 0), r as (select *, row_number() over (partition by query_id order by md5(id)) as rank from i)
select r.query_id, r.rank, r.id, c.path, c.start_line from r join (select id, min(path) as path, min(start_line) start_line from chunks group by id) c using (id)""")
def ids_in_order(spark, directory):
    """Chunks by ranked ids, with their rank."""
    from corpusmith.operators.ordered import ranked

    rows = table(spark, directory, "chunks")
    ids = ranked(rows.where("start_line % 2 = 0").select(F.col("workspace_id").alias("query_id"), "id").distinct().withColumn("_m", F.md5("id")), ["query_id"], [F.col("_m")])
    return manifest.in_order(ids.select("query_id", "rank", "id"), rows.groupBy("id").agg(F.min("path").alias("path"), F.min("start_line").alias("start_line")))


# --- code --------------------------------------------------------------------------------------

_FOLDER = "regexp_replace(path, '[^/]*$', '')"
_FIRSTS = f"(select {_FOLDER} folder, min(path) first from chunks where path like '%/%' group by 1)"


def _importing(spark, directory):
    """id, path, language, start_line and content of chunks, each with a line before it that imports the first file of its folder."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    rows = table(spark, directory, "chunks").where("content is not null and path like '%/%'").withColumn("folder", folder)
    firsts = rows.groupBy("folder").agg(F.min("path").alias("first"))
    stem = F.regexp_replace(F.regexp_extract("first", "[^/]*$", 0), r"\.[^.]*$", "")
    low = F.lower(F.col("path"))
    line = F.when(low.rlike(r"\.(ts|tsx|js|jsx)$"), F.concat(F.lit("import { x } from './"), stem, F.lit("';\n"))).when(low.endswith(".py"), F.concat(F.lit("from ."), stem, F.lit(" import x\n"))).when(low.endswith(".go"), F.concat(F.lit('import "'), F.col("folder"), stem, F.lit('"\n'))).otherwise("")
    own = rows.join(firsts, "folder").select("id", "path", "language", "symbol", "start_line", F.concat(line, F.col("content")).alias("content"))
    return own.distinct()


_EDGES = f"(select distinct path source_path, regexp_replace(first, '\\.[^./]*$', '') target from (select distinct path, {_FOLDER} folder from chunks where content is not null and path like '%/%') join {_FIRSTS} using (folder) where regexp_matches(lower(path), '\\.(ts|tsx|js|jsx|py|go)$'))"


@ENGINE.add(f"select source_path, target from {_EDGES}")
def import_edges(spark, directory):
    """What every file imports; each chunk gets a line that imports the first file of its folder."""
    return graph.imports_of(_importing(spark, directory))


@ENGINE.add(f"""select distinct e.source_path, s.path seed from {_EDGES} e join (select distinct path from chunks where start_line % 5 = 0) s on e.target = s.path or e.target = regexp_replace(s.path, '\\.[^.]+$', '')""")
def reverse_imports(spark, directory):
    """The files that import each of a set of files."""
    edges = graph.imports_of(_importing(spark, directory))
    seeds = table(spark, directory, "chunks").where("start_line % 5 = 0").select("path").distinct()
    names = F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.[^.]+$", "")))).alias("target")
    return seeds.select(F.col("path").alias("seed"), names).join(edges, "target").select("source_path", "seed").distinct()


@ENGINE.add(f"""with c as (select id, min(path) as path, min(start_line) start_line, min(symbol) symbol from chunks where content is not null and path like '%/%' group by id), h as (select path, arg_min(id, (start_line, id)) id from c group by 1),
s as (select query_id, id, path, symbol from (select c.*, language query_id, row_number() over (partition by language order by c.id) n from c join (select id, min(language) as language from chunks group by id) l using (id) where language is not null) where n <= 6),
a as (select query_id, id, 0 stage, row_number() over (partition by query_id order by start_line, id) pos from (select distinct s.query_id, c.id, c.start_line from s join c on lower(c.symbol) = lower(s.symbol))),
t as (select query_id, target from (select query_id, target, row_number() over (partition by query_id order by target) n from (select distinct s.query_id, e.target from s join {_EDGES} e on e.source_path = s.path)) where n <= 32),
f as (select query_id, id, 1 stage, row_number() over (partition by query_id order by path) pos from (select distinct t.query_id, h.path, h.id from h join t on lower(h.path) = lower(t.target) or starts_with(lower(h.path), lower(t.target) || '.') or starts_with(lower(h.path), lower(t.target) || '/') or contains(lower(h.path), '/' || lower(t.target) || '/'))),
i as (select query_id, path from (select query_id, path, row_number() over (partition by query_id order by path) n from (select distinct s.query_id, e.source_path path from s join {_EDGES} e on e.target in (s.path, regexp_replace(s.path, '\\.[^.]+$', '')))) where n <= 40),
r as (select query_id, id, 2 stage, row_number() over (partition by query_id order by path, start_line, id) pos from i join c using (path)),
u as (select * from a where pos <= 10 union all select * from f where pos <= 10 union all select * from r where pos <= 20),
m as (select query_id, id, min((stage, pos)) k from u where (query_id, id) not in (select (query_id, id) from s) group by 1, 2)
select query_id, id, k[1] as stage, place from (select *, row_number() over (partition by query_id order by k, id) place from m) where place <= 10""")
def graph_expansion(spark, directory):
    """Ten chunks one step from the first six of each language; the numbers are the feature."""
    from pyspark.sql import Window

    rows = materialize(_importing(spark, directory), "importing")
    once = rows.groupBy("id").agg(F.min("path").alias("path"), F.min("start_line").alias("start_line"), F.min("symbol").alias("symbol"), F.min("language").alias("language"))
    first = once.where("language is not null").withColumn("_n", F.row_number().over(Window.partitionBy("language").orderBy("id"))).where("_n <= 6")
    seeds = first.select(F.col("language").alias("query_id"), "id", "path", F.array_compact(F.array("symbol")).alias("names"))
    symbols = once.where("symbol is not null").select(F.col("symbol").alias("name"), "id")
    found = graph.expand(seeds, once.select("id", "path", "start_line"), symbols, graph.imports_of(rows), 10)
    return found.select("query_id", "id", "stage", F.col("place").cast("long").alias("place"))


_HINTS = [(1, True, ["finalpolicyanalyzer", "encoderawmetric"]), (2, False, ["policy", "metric"]), (3, False, ["encode", "raw", "drain"])]
_HINT_SQL = "(values " + ", ".join(f"({q}, {'true' if e else 'false'}, '{h}')" for q, e, hs in _HINTS for h in hs) + ") a(query_id, exact, hint)"


@ENGINE.add(f"""with s as (select id, min(symbol) symbol from chunks group by id), m as (select query_id, id, hint, case when lower(symbol) = hint then 3.0 when not exact and length(hint) >= 4 and starts_with(lower(symbol), hint) then 1.5 when not exact and length(hint) >= 4 and contains(lower(symbol), hint) then 0.8 end sc from s, {_HINT_SQL}),
t as (select query_id, id, max(sc) + least(1.0, 0.25 * (sum(sc) - max(sc))) score from m where sc is not null group by 1, 2)
select query_id::bigint query_id, id, round(score, 6)::double score, rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from t) where rank <= 200""")
def symbol_scores(spark, directory):
    """The 200 chunks whose symbol answers the hints of each query best; the number is the feature."""
    own = table(spark, directory, "chunks").groupBy("id").agg(F.min("symbol").alias("name")).where("name is not null")
    index = {"symbols": own.withColumn("name_lower", F.lower("name"))}
    plans = spark.createDataFrame([(q, h, e) for q, e, h in _HINTS], "query_id long, symbols array<string>, exact boolean")
    return retrieval.symbol_channel(plans, index).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@ENGINE.add("""with a as (select distinct lower(symbol) hint from chunks where symbol is not null and start_line % 50 = 0), s as (select id, lower(min(symbol)) l, min(start_line) a from chunks group by id)
select hint, id, 3.0::double score, rank from (select hint, id, row_number() over (partition by hint order by a, id) as rank from a join s on l = hint) where rank <= 10""")
def exact_symbols(spark, directory):
    """The first ten chunks that declare each wanted symbol, by line; the number is the feature."""
    rows = table(spark, directory, "chunks")
    wanted = rows.where("symbol is not null and start_line % 50 = 0").select(F.lower("symbol").alias("hint")).distinct()
    own = rows.groupBy("id").agg(F.min("symbol").alias("name"), F.min("start_line").alias("start_line")).where("name is not null")
    return retrieval.exact_symbols(wanted, own, 10)


_PATH_HINTS = [(1, ["policy", "src/rank"]), (2, ["ledger_window", "ts"]), (3, ["queue", "metric", "record"])]
_PATH_SQL = "(values " + ", ".join(f"({q}, '{h}')" for q, hs in _PATH_HINTS for h in hs) + ") a(query_id, hint)"


@ENGINE.add(f"""with h as (select path, arg_min(id, (start_line, id)) id from chunks group by 1),
m as (select query_id, hint, path, id, row_number() over (partition by query_id, hint order by length(path), path) n from h join {_PATH_SQL} on contains(lower(path), hint)),
p as (select *, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '') raw, regexp_extract(lower(path), '[^/]*$') base, '/' || regexp_replace(lower(path), '\\.[^./]+$', '') || '/' whole from m where n <= 100),
s as (select query_id, id, case when contains(hint, '/') and contains(whole, '/' || hint || '/') then 4.0 when lower(raw) = hint then 3.2 when lower(raw) in (hint || 's', hint || 'es') then 3.1 when starts_with(base, hint || '.') then 3.0
 when list_contains(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z0-9]+'), lambda w: length(w) >= 2), hint) then 2.9 when length(hint) >= 4 and starts_with(lower(raw), hint) then 2.7 else 2.0 end sc from p),
t as (select query_id, id, max(sc) + least(0.8, 0.1 * (sum(sc) - max(sc))) score from s group by 1, 2)
select query_id::bigint query_id, id, round(score, 6)::double score, rank from (select *, row_number() over (partition by query_id order by round(score, 6) desc, id) as rank from t) where rank <= 200""")
def path_scores(spark, directory):
    """First chunks of the 100 shortest paths that hold a hint, by how the name answers it; the numbers are the feature."""
    index = retrieval.build_index(table(spark, directory, "chunks"))
    plans = spark.createDataFrame(_PATH_HINTS, "query_id long, hints array<string>")
    return retrieval.path_channel(plans, index).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TEXT_LINE = "regexp_matches(x, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]')"
_COVERED = f"select key, n as lines, true as sound from (select key, len(list_filter(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {_TEXT_LINE}))::bigint n from rows) where n > 0"


def _covered(files):
    """key, the lines with text that the chunks of files (key, path, content) cover, and whether every chunk ends with its lines and has its digest and id."""
    cut = chunk_files(files.select("path", "content")).withColumnRenamed("content", "chunk")
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    own = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    nul = F.lit("\0")
    identity = F.concat("path", nul, F.col("start_line").cast("string"), nul, F.col("end_line").cast("string"), nul, F.substring(F.sha2("chunk", 256), 1, 8))
    sound = F.col("chunk").endswith(own) & (F.col("hash") == F.sha2("chunk", 256)) & (F.col("id") == F.substring(F.sha2(identity, 256), 1, 16))
    text = r"[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x0b]"
    placed = cut.join(files, "path").select("key", sound.alias("sound"), F.explode(F.filter(F.transform(F.sequence("start_line", "end_line"), lambda i: F.when(F.get(lines, i - 1).rlike(text), i)), lambda i: i.isNotNull())).alias("line"))
    return placed.groupBy("key").agg(F.count_distinct("line").alias("lines"), F.every("sound").alias("sound"))


@ENGINE.add(f"with rows as (select 'd' || doc_id as key, text as content from documents where text is not null) {_COVERED}")
def chunk_coverage(spark, directory):
    """How many lines with text the chunks of each document cover, and whether every chunk holds its lines, under its digest and id."""
    docs = table(spark, directory, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("content"))
    return _covered(docs.withColumn("path", F.concat(F.lit("documents/"), F.col("key"), F.lit(".md"))))


@ENGINE.add(f"with rows as (select id as key, min(content) as content from chunks where content is not null group by id) {_COVERED}")
def source_coverage(spark, directory):
    """The same for the contents of all chunks, cut again by the structure of their language."""
    rows = table(spark, directory, "chunks").where("content is not null").groupBy(F.col("id").alias("key")).agg(F.min("content").alias("content"), F.min("path").alias("path"))
    return _covered(rows.withColumn("path", F.concat_ws("/", "key", "path")))


# --- texts for models and prompts --------------------------------------------------------------


@ENGINE.add("""select id, md5(case when length(t) > 600 then substr(t, 1, 599) || '…' else t end) rerank, md5('File: ' || path || chr(10) || 'Symbol: ' || coalesce(symbol, '') || chr(10) || chr(10) || substr(coalesce(content, ''), 1, 6000)) embed
from (select id, path, symbol, content, concat_ws(chr(10), 'path: ' || path, 'symbol: ' || nullif(symbol, ''), 'language: ' || nullif(language, ''), trim(regexp_replace(coalesce(content, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) t
from (select id, min(path) as path, min(symbol) symbol, min(language) as language, min(content) as content from chunks group by id))""")
def model_texts(spark, directory):
    """What a reranker and an embedder read of every chunk."""
    rows = table(spark, directory, "chunks").groupBy("id").agg(*(F.min(c).alias(c) for c in ("path", "symbol", "language", "content")))
    c = {n: F.col(n) for n in ("path", "symbol", "language", "content")}
    return rows.select("id", F.md5(models.rerank_text(c["path"], c["symbol"], c["language"], c["content"], 600)).alias("rerank"), F.md5(models.embedding_text(c["path"], c["symbol"], c["content"])).alias("embed"))


@ENGINE.add("""with l as (select id, string_split(content, chr(10)) l from (select id, min(content) as content from chunks group by id) where content is not null),
m as (select id, l, list_transform(l, lambda x: contains(lower(x), 'lease') or contains(lower(x), 'quota') or contains(lower(x), 'return')) m from l),
k as (select id, l, list_transform(range(1, len(l) + 1), lambda i: list_bool_or(list_slice(m, greatest(i - 1, 1), i + 1))) k from m)
select id, md5(array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: case when k[i] then l[i] when i = len(l) or k[i + 1] then '… [unrelated lines omitted]' end), lambda x: x is not null), chr(10))) salient
from k where len(l) > 3 and list_bool_or(k) and not list_bool_and(k)""")
def salient_lines(spark, directory):
    """The lines of every chunk that hold a term, with their neighbours."""
    rows = table(spark, directory, "chunks").groupBy("id").agg(F.min("content").alias("content"))
    kept = context.salient_part(F.col("content"), F.array(*map(F.lit, ("lease", "quota", "return", "if"))))
    return rows.select("id", F.md5(kept).alias("salient")).where("salient is not null")


# --- policies, cases, comparisons --------------------------------------------------------------


@ENGINE.add("""select c_custkey, rank >= 2 may from (select c_custkey, case c_custkey % 5 when 1 then 1 when 2 then 2 when 3 then 3 else 0 end rank from customer)""")
def permissions(spark, directory):
    """Whose permission is at least writer."""
    held = F.array(*map(F.lit, ("admin", "reader", "writer", "owner", None)))[(F.col("c_custkey") % 5).cast("int")]
    return table(spark, directory, "customer").select("c_custkey", policy.permission_at_least(held, "writer").alias("may"))


@ENGINE.add("""with p as (select workspace_id, regexp_replace(regexp_replace(case when size % 2 = 0 then './' || regexp_extract(path, '^[^/]*/[^/]*') || '/' else path end, '^(\\./)+', ''), '/+$', '') prefix from files), a as (select workspace_id, count(*) n, count(distinct prefix) d from p group by 1)
select workspace_id policy_id, case when n > 256 then 'too many rules' else 'prefix occurs twice' end problem from a where n > 256 or d < n""")
def policy_problems(spark, directory):
    """Policies with too many rules or a prefix twice; every file is a rule."""
    prefix = F.when(F.col("size") % 2 == 0, F.concat(F.lit("./"), F.regexp_extract("path", "^[^/]*/[^/]*", 0), F.lit("/"))).otherwise(F.col("path"))
    return policy.invalid_policies(table(spark, directory, "files").select(F.col("workspace_id").alias("policy_id"), prefix.alias("prefix")))


@ENGINE.add("""select distinct s.id, w.id as workspace_id, case w.source_mode when 'blob' then 'writer' else 'reader' end as access from connector_sources s join workspaces w on w.id = s.workspace_id where w.source_mode = 'blob' or s.status = 'idle'""")
def accessible_sources(spark, directory):
    """Sources of the workspaces that a list of grants opens, with the permission."""
    spaces = table(spark, directory, "workspaces").select(F.col("id").alias("workspace_id"), F.when(F.col("source_mode") == "blob", "writer").otherwise("reader").alias("access")).distinct()
    rows = table(spark, directory, "connector_sources").select("id", "workspace_id", "status").join(spaces, "workspace_id")
    return rows.where(policy.permission_at_least(F.col("access"), "writer") | (F.col("status") == "idle")).select("id", "workspace_id", "access").distinct()


@ENGINE.add("""select 'd' || doc_id case_id, text query, ['a' || doc_id % 7 || '.ts', 'b.ts'] expected, []::varchar[] symbols, case when doc_id % 2 = 0 then 5 else 8 end top_k from documents where text is not null""")
def case_files(spark, directory):
    """The cases of case files; each document makes a file of one case."""
    n = F.col("doc_id")
    fields = F.struct(F.concat(F.lit("d"), n.cast("string")).alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("a"), (n % 7).cast("string"), F.lit(".ts")), F.lit("b.ts")).alias("expectPaths"), F.when(n % 2 == 0, 5).alias("topK"))
    made = table(spark, directory, "documents").select(F.concat(F.lit("["), F.to_json(fields), F.lit("]")).alias("value"))
    return evaluation.cases_of(made)


@ENGINE.add("""with r as (select l_orderkey case_id, 'p' || l_partkey % 9 as path, min(l_linenumber) as rank from lineitem group by 1, 2), o as (select *, row_number() over (partition by case_id order by rank, path) n from r), g as (select o_orderkey case_id, ['p' || o_custkey % 9, 'p4'] neg from orders),
m as (select case_id, min(n) f from o join g using (case_id) where n <= 5 and list_contains(neg, path) group by 1) select g.case_id, coalesce(f = 1, false) negative_top1, f is not null negative_at_k from (select distinct case_id from g) g left join m using (case_id)""")
def hard_negatives(spark, directory):
    """I32: whether rankings put a hard negative first or among their first five."""
    results = table(spark, directory, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")).alias("path"))
    gold = table(spark, directory, "orders").select(F.col("o_orderkey").alias("case_id"), F.array(F.concat(F.lit("p"), (F.col("o_custkey") % 9).cast("string")), F.lit("p4")).alias("negatives"), F.lit(5).alias("top_k"))
    return evaluation.hard_negatives(results, gold)


@ENGINE.add("""with r as (select l_returnflag variant, l_linenumber repetition, ['passed', 'failed', 'timeout', 'error'][l_partkey % 4 + 1] status, case when l_suppkey % 3 = 0 then null else l_quantity end tokens, l_extendedprice cost from lineitem)
select variant, count(*) runs, count(distinct repetition) repetitions, count(*) filter (status = 'passed') passed, count(*) filter (status = 'failed') failed, count(*) filter (status = 'timeout') timeouts, count(*) filter (status = 'error') errors,
round(count(*) filter (status = 'passed') / count(*), 6) pass_rate, round(avg(tokens), 6)::double mean_tokens, round(avg(cost), 6)::double mean_cost from r group by 1""")
def variant_means(spark, directory):
    """Outcomes and means of every variant."""
    states = F.array(*map(F.lit, ("passed", "failed", "timeout", "error")))
    runs = table(spark, directory, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("repetition"), states[(F.col("l_partkey") % 4).cast("int")].alias("status"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_quantity")).alias("tokens"), F.col("l_extendedprice").alias("cost"))
    return evaluation.variant_means(runs, ["tokens", "cost"])


@ENGINE.add("""select c_custkey suite, case when least(a, b, c, d) >= -0.01 and (a > 0.005 or b > 0.005 or c > 0.005) then 'candidate-for-default' else 'keep-opt-in' end advice from (select c_custkey, (c_custkey % 7 - 1) / 100.0 a, (c_custkey % 5 - 1) / 200.0 b, (c_custkey % 3 - 1) / 150.0 c, (c_custkey % 11 - 1) / 90.0 d from customer)""")
def delta_gate(spark, directory):
    """Whether a reranker's gains make it the default."""
    n = F.col("c_custkey")
    deltas = {"recall": (n % 7 - 1) / 100.0, "mrr": (n % 5 - 1) / 200.0, "ndcg": (n % 3 - 1) / 150.0, "top5": (n % 11 - 1) / 90.0}
    return table(spark, directory, "customer").select(n.alias("suite"), evaluation.delta_gate(deltas).alias("advice"))


@ENGINE.add("""with g as (select o_orderkey // 2 case_id, case o_orderkey % 5 when 0 then '../x' when 1 then '/abs' else 'packages/p' || o_orderkey % 50 end e, case when o_orderkey % 4 = 0 then 'packages/p' || o_orderkey % 50 else 'n' end neg from orders), f as (select distinct regexp_extract(path, '^[^/]*/[^/]*') p from files union select 'packages/p' || i from range(40) r(i))
select case_id, 'doubled case' problem from g group by 1 having count(*) > 1 union select case_id, 'path isn''t canonical' from g where starts_with(e, '/') or contains(e, '..') union select case_id, 'expected and negative' from g where e = neg union select case_id, 'path is absent' from g where e not in (select p from f)""")
def gold_problems(spark, directory):
    """Cases that occur twice, name bad or absent paths, or contradict themselves."""
    n = F.col("o_orderkey")
    named = F.concat(F.lit("packages/p"), (n % 50).cast("string"))
    gold = table(spark, directory, "orders").select(F.floor(n / 2).alias("case_id"), F.array(F.when(n % 5 == 0, "../x").when(n % 5 == 1, "/abs").otherwise(named)).alias("expected"), F.array(F.when(n % 4 == 0, named).otherwise("n")).alias("negatives"))
    known = table(spark, directory, "files").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("path")).unionByName(spark.range(40).select(F.concat(F.lit("packages/p"), F.col("id").cast("string")).alias("path")))
    return evaluation.invalid_gold(gold, known)


# --- versions and archives ---------------------------------------------------------------------


def _folder(spark):
    import uuid

    from corpusmith.session import kept_folder

    return kept_folder(spark, f"store-{uuid.uuid4().hex}")


@ENGINE.add("""with f as (select workspace_id, path, max(hash) hash from files where workspace_id is not null and path is not null group by 1, 2), c as (select workspace_id, path, max(blob_hash) hash from workspace_sources group by 1, 2)
select workspace_id, path, hash from c where workspace_id is not null and path is not null union all select * from f where not exists (select 1 from c where c.workspace_id = f.workspace_id and c.path = f.path) and path not like '%.md'""")
def generations(spark, directory):
    """The active generation after a copy with changes was promoted over the first."""
    from corpusmith.operators.generations import Store

    keys = ["workspace_id", "path"]
    first = table(spark, directory, "files").where("workspace_id is not null and path is not null").groupBy(*keys).agg(F.max("hash").alias("hash"))
    put = table(spark, directory, "workspace_sources").where("workspace_id is not null and path is not null").groupBy(*keys).agg(F.max("blob_hash").alias("hash"))
    store = Store(spark, _folder(spark))
    one = store.begin({"files": first})
    store.promote(one, 1)
    store.promote(store.begin_from_active({"files": (put, first.where("path like '%.md'").select(*keys), keys)}), 2, one)
    return store.read("files")


def _archived(spark, directory):
    """Files, chunks and vectors as an archive has them, and that archive's folder."""
    from corpusmith.sources import snapshots

    name = F.concat_ws("/", "workspace_id", "path").alias("path")
    chunks = table(spark, directory, "chunks")
    rows = {
        "file": table(spark, directory, "files").groupBy(name).agg(F.max("hash").alias("hash"), F.max("language").alias("language"), F.max("mtime_ms").alias("mtime_ms"), F.max("size").alias("size")),
        "chunk": chunks.groupBy("id").agg(F.min(F.concat_ws("/", "workspace_id", "path")).alias("path"), *(F.min(c).alias(c) for c in ("language", "start_line", "end_line", "content", "symbol", "hash"))).select("id", "path", "language", "start_line", "end_line", "content", "symbol", "hash"),
        "embedding": table(spark, directory, "chunk_vectors").where("vector is not null and model is not null and dim is not null").join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select("chunk_id", "model", "dim", F.transform("vector", lambda x: F.when(~F.isnan(x), x)).alias("vector")).distinct(),
    }
    folder = _folder(spark)
    snapshots.export_snapshot(rows, folder)
    return folder


@ENGINE.add("""select id, min(workspace_id || '/' || path) as path, min(start_line) start_line, md5(min(content)) digest from chunks group by id""")
def snapshot_round_trip(spark, directory):
    """The chunks of an archive that was written, checked and read."""
    from corpusmith.sources import snapshots

    return snapshots.import_snapshot(spark, _archived(spark, directory))[1]["chunk"].select("id", "path", "start_line", F.md5("content").alias("digest"))


@ENGINE.add("""select workspace_id || '/' || path as path, max(hash) hash, max(size) size from files group by 1""")
def replicated_files(spark, directory):
    """The files of an archive's published copy."""
    from corpusmith.sources import snapshots

    target = _folder(spark)
    snapshots.replicate(spark, _archived(spark, directory), target, "main", 7)
    return snapshots.import_snapshot(spark, snapshots.published(spark, target, "main"))[1]["file"].select("path", "hash", "size")


# --- connectors and overviews ------------------------------------------------------------------


@ENGINE.add("""with f as (select workspace_id || '/' || path as path, max(hash) revision, max(size) bytes from files where hash is not null group by 1), w as (select workspace_id || '/' || path as path, max(blob_hash) revision from workspace_sources where blob_hash is not null group by 1)
select coalesce(f.path, w.path) as path, case when f.path is null then 'delete' else 'upsert' end change from f full join w on f.path = w.path where f.revision is distinct from w.revision""")
def connector_sync(spark, directory):
    """What a recorded tree of all files, read in pages, changes in what is stored."""
    from corpusmith.sources import connectors

    named = F.concat_ws("/", "workspace_id", "path").alias("path")
    rows = table(spark, directory, "files").where("hash is not null").groupBy(named).agg(F.max("hash").alias("sha"), F.max("size").alias("size"))
    entry = F.struct("path", F.lit("blob").alias("type"), "sha", "size")
    pages = rows.groupBy(F.substring(F.md5("path"), 1, 3).alias("page")).agg(F.collect_list(entry).alias("tree")).select(F.to_json(F.struct(F.lit(False).alias("truncated"), "tree")).alias("value"))
    folder = _folder(spark)
    pages.write.text(folder)
    listed = connectors.list_files(spark, "github", {"location": folder, "lines": True, "most": 1 << 60})
    stored = table(spark, directory, "workspace_sources").where("blob_hash is not null").select(named, F.col("blob_hash").alias("remote_revision"))
    return connectors.sync_plan(listed, stored)


@ENGINE.add("""select id as path, case when start_line % 5 = 0 then null else md5(c) end digest, case when start_line % 5 = 0 then 'missing' end problem from (select id, min(content) c, min(start_line) start_line from chunks where content is not null group by id)""")
def connector_blobs(spark, directory):
    """The contents of files by their recorded blobs; a fifth of the blobs is missing."""
    from corpusmith.sources import connectors

    rows = table(spark, directory, "chunks").where("content is not null").groupBy("id").agg(F.min("content").alias("content"), F.min("start_line").alias("start_line"))
    folder, data = _folder(spark), F.encode("content", "UTF-8")
    rows.where("start_line % 5 != 0").select(F.concat_ws("-", "id", F.sha2("content", 256)).alias("sha"), F.lit("base64").alias("encoding"), F.base64(data).alias("content"), F.octet_length(data).cast("long").alias("size")).write.json(folder)
    files = rows.select(F.col("id").alias("path"), F.concat_ws("-", "id", F.sha2("content", 256)).alias("revision"), F.octet_length(data).cast("long").alias("bytes"))
    return connectors.read_files(spark, "gitlab", {"blobs": folder}, files).select("path", F.md5("content").alias("digest"), "problem")


@ENGINE.add("""with f as (select workspace_id, count(distinct path) n from files group by 1), c as (select workspace_id, count(distinct id) n from chunks group by 1), j as (select workspace_id, count(distinct id) n, max(created_at) t from sync_sessions group by 1)
select coalesce(f.workspace_id, c.workspace_id, j.workspace_id) workspace_id, coalesce(f.n, 0) files, coalesce(c.n, 0) chunks, coalesce(j.n, 0) jobs, epoch_us(j.t) last_us from f full join c on c.workspace_id = f.workspace_id full join j on j.workspace_id = coalesce(f.workspace_id, c.workspace_id)""")
def workspace_overview(spark, directory):
    """Files, chunks and jobs of every workspace."""
    from corpusmith.operators import reports

    found = reports.workspace_overview(table(spark, directory, "files"), table(spark, directory, "chunks"), table(spark, directory, "sync_sessions"))
    return found.select("workspace_id", "files", "chunks", "jobs", F.unix_micros("last_job").alias("last_us"))
