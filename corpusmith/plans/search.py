"""Lexical, vector and fused search over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmith.functions.query import analyzed
from corpusmith.functions.tokens import plain_tokens, search_text, tokens
from corpusmith.operators import fusion, lexical, similarity
from corpusmith.plans.registry import Registry
from corpusmith.session import materialize
from corpusmith.sources.tables import table

SEARCH = Registry()

#: The batch of queries that the search queries ask.
ASKED = [(1, "lease expires before the worker"), (2, "publish snapshot to the replica"), (3, "stale cursor"), (4, "token budget of the generation"), (5, "quota quota limit")]

_SPLIT = "regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_TOK = f"list_filter(regexp_extract_all(lower({_SPLIT}), '[a-z0-9]+'), lambda w: length(w) >= 2)"
_DOC_TOK = _TOK.format("text")
_ASKED = "(values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") q(query_id, raw)"
_BM25 = f"""
with d as (select doc_id, {_DOC_TOK} t from documents where text is not null),
post as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from d) group by all),
dl as (select doc_id, len(t) dl from d), st as (select count(*) n, avg(len(t)) avgdl from d), df as (select term, count(distinct doc_id) df from post group by term),
ask as (select query_id::bigint query_id, term, count(*) times from (select query_id, unnest({_TOK.format("raw")}) term from {_ASKED}) group by all),
sc as (select query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.75 + 0.75 * greatest(dl, 1) / avgdl))) score
  from ask join df using (term) join post using (term) join dl using (doc_id), st group by query_id, doc_id),
bm as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) rank from sc where score > 0)
"""


def _asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, raw string")


def _documents(spark, directory):
    return table(spark, directory, "documents").where("text is not null").select("doc_id", "text")


@SEARCH.add(f"select doc_id, array_to_string({_DOC_TOK}, ' ') as tokens from documents where text is not null")
def tokenize_plain(spark, directory):
    """I1 for ASCII: tokens of every document by built-in functions."""
    return _documents(spark, directory).select("doc_id", F.array_join(plain_tokens(F.col("text")), " ").alias("tokens"))


_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _exact(column: str) -> str:
    """SQL for the exact tokens of a column, as a list; of compatibility forms, the letters and numbers that the tables have."""
    split = _SPLIT.format(f"nfc_normalize(replace(replace(replace({column}, 'ﬁ', 'fi'), '½', '1⁄2'), '™', 'TM'))")
    words = f"regexp_extract_all(regexp_replace(regexp_replace(lower({split}), '[_\\-./\\\\]+', ' ', 'g'), '({_UNSPACED}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "case when length(w) < 2 then [w] else list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) end"
    return f"flatten(list_transform({words}, lambda w: case when regexp_matches(w, '{_UNSPACED}') then {pairs} when length(strip_accents(w)) >= 2 then [strip_accents(w)] else [] end))"


@SEARCH.add(f"select doc_id, array_to_string({_exact('text')}, ' ') tokens from documents where text is not null")
def tokenize_documents(spark, directory):
    """Tokens of every document, with unified forms, stripped accents and character pairs."""
    return _documents(spark, directory).select("doc_id", F.array_join(tokens("text"), " ").alias("tokens"))


@SEARCH.add(f"""with c as (select id, min(path) as path, min(symbol) symbol, min(language) as language, min(content) as content from chunks group by id),
t as (select id, concat_ws(chr(10), path, path, symbol, symbol, language, content) t from c) select id, md5(array_to_string({_exact('t')}, ' ')) tokens from t""")
def indexed_tokens(spark, directory):
    """The tokens under which every chunk is indexed."""
    rows = table(spark, directory, "chunks").groupBy("id").agg(*(F.min(c).alias(c) for c in ("path", "symbol", "language", "content")))
    return rows.select("id", F.md5(F.array_join(tokens(search_text(*map(F.col, ("path", "symbol", "language", "content")))), " ")).alias("tokens"))


@SEARCH.add(f"select term, count(distinct doc_id) df, count(*)::bigint tf from (select doc_id, unnest({_DOC_TOK}) term from documents where text is not null) group by term")
def term_statistics(spark, directory):
    """In how many documents each term occurs, and how often."""
    words = _documents(spark, directory).select("doc_id", F.explode(plain_tokens(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("tf"))


def _bm25(spark, directory):
    docs = _documents(spark, directory)
    cut = plain_tokens(F.col("text"))
    queries = _asked(spark).select("query_id", plain_tokens(F.col("raw")).alias("terms"))
    index = lexical.asked_postings(docs, "doc_id", cut, queries.select(F.explode("terms").alias("term")))
    return lexical.bm25(index, lexical.corpus_statistics(docs, cut), queries, "doc_id")


@SEARCH.add(_BM25 + "select query_id, doc_id, rank, round(score, 6) score from bm where rank <= 10")
def bm25_topk(spark, directory):
    """The ten best documents of each query by BM25."""
    return lexical.top_k(_bm25(spark, directory), 10, "doc_id").withColumn("score", F.round("score", 6))


_IDENT = r"\b[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b|\b[a-z]+[A-Z][A-Za-z0-9]*\b|\b[A-Z][A-Z0-9_]{1,}\b|\b[A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)+\b|\b[A-Z][a-z][A-Za-z0-9]{1,}\b"
_PATH = r"(?:[\w.-]+\/)+[\w.-]+|\b[\w-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|md)\b"


@SEARCH.add(rf"""with r as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_PATH}') p, list_filter(regexp_extract_all(coalesce(text, ''), '{_IDENT}'), lambda n: length(n) > 2 and lower(n) not in ('explain', 'find', 'given', 'how', 'locate', 'show', 'the', 'this', 'what', 'when', 'where', 'which', 'why')) n from documents),
u as (select doc_id, t, list_filter(p, lambda x, i: list_position(p, x) = i) p, list_filter(n, lambda x, i: list_position(n, x) = i) n,
 len(list_filter({_exact('t')}, lambda w: w not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'how', 'in', 'into', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'with', 'where'))) k,
 regexp_matches(t, '(?i)\b(?:commit|history|why|when|blame|lineage|changelog|introduced|regression)\b') h from r)
select doc_id, md5(array_to_string(n, ' ')) identifiers, md5(array_to_string(p, ' ')) paths, k tokens, h history,
 case when h then 'history' when len(p) > 0 then case when len(list_filter(n, lambda x: length(x) >= 8 or contains(x, '_') or x <> lower(x))) > 0 then 'mixed' else 'path' end
 when len(list_filter(n, lambda x: length(x) >= 8 or contains(x, '_') or x <> lower(x))) > 0 then case when k <= 6 then 'symbol' else 'mixed' end else 'concept' end intent from u""")
def analyzed_queries(spark, directory):
    """What every document's text asks for, read as a query."""
    q = table(spark, directory, "documents").select("doc_id", analyzed("text").alias("q"))
    return q.select("doc_id", F.md5(F.array_join("q.identifiers", " ")).alias("identifiers"), F.md5(F.array_join("q.paths", " ")).alias("paths"), F.size("q.tokens").cast("long").alias("tokens"), F.col("q.history").alias("history"), F.col("q.intent").alias("intent"))


@SEARCH.add(_BM25.replace(_DOC_TOK, _exact("text")).replace(_TOK.format("raw"), _exact("raw")) + "select query_id, doc_id, rank, round(score, 6) score from bm where rank <= 10")
def bm25_exact_tokens(spark, directory):
    """BM25 over the exact tokens."""
    docs = _documents(spark, directory)
    cut = materialize(docs.select("doc_id", tokens("text").alias("t")), "tokens")
    queries = _asked(spark).select("query_id", tokens("raw").alias("terms"))
    scores = lexical.bm25(lexical.asked_postings(cut, "doc_id", F.col("t"), queries.select(F.explode("terms").alias("term"))), lexical.corpus_statistics(cut, F.col("t")), queries, "doc_id")
    return lexical.top_k(scores, 10, "doc_id").withColumn("score", F.round("score", 6))


@SEARCH.add(f"select 1::bigint query_id, doc_id from (select doc_id, {_DOC_TOK} t from documents) where list_has_any(t, ['lease', 'worker']) and list_has_any(t, ['expires', 'frame', 'window'])")
def fts_anchor_support(spark, directory):
    """Documents that hold an anchor term and a support term."""
    groups = spark.createDataFrame([(1, [["lease", "worker"], ["expires", "frame", "window"]])], "query_id long, groups array<array<string>>")
    terms = groups.select(F.explode(F.flatten("groups")).alias("term"))
    index = lexical.asked_postings(_documents(spark, directory), "doc_id", plain_tokens(F.col("text")), terms)
    return lexical.boolean_matches(index, groups, "doc_id")


_ANY = [(1, "lease"), (1, "expires"), (1, "before"), (1, "worker"), (2, "publish"), (2, "snapshot"), (2, "replica"), (3, "stale"), (3, "cursor"), (4, "token"), (4, "budget"), (4, "generation"), (5, "quota"), (5, "limit")]


@SEARCH.add(f"""with d as (select doc_id, {_DOC_TOK} t from documents where text is not null), a as (select * from (values {", ".join(map(str, _ANY))}) a(query_id, term)),
e as (select query_id, doc_id, term, p from (select doc_id, unnest(t) term, generate_subscripts(t, 1) p from d) join a using (term)), k as (select query_id, doc_id, count(distinct term) k, count(*) n from e group by all),
l as (select e.query_id, e.doc_id, e.p, x.term, max(x.p) seen from e join e x on x.query_id = e.query_id and x.doc_id = e.doc_id and x.p <= e.p group by all),
s as (select query_id, doc_id, p, count(*) c, min(seen) start from l group by all),
f as (select s.*, k.k, k.n, lag(case when s.c = k.k then s.start end) over (partition by s.query_id, s.doc_id order by s.p) prev from s join k on k.query_id = s.query_id and k.doc_id = s.doc_id),
t as (select query_id, doc_id, case when any_value(k) = 1 then any_value(n) * 0.1 else sum(case when c = k and (prev is null or start > prev) then k::double / (p - start + 1) else 0 end) end score from f group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from t) select query_id::bigint query_id, doc_id, round(score, 6)::double score, rank from r where rank <= 10""")
def fts_cover_density(spark, directory):
    """The ten best documents of each query's boolean form by cover density."""
    groups = materialize(_asked(spark).select("query_id", lexical.query_groups("raw").alias("groups")), "groups")
    terms = groups.select(F.explode(F.flatten("groups")).alias("term"))
    index = lexical.asked_postings(_documents(spark, directory), "doc_id", plain_tokens(F.col("text")), terms, positions=True)
    return lexical.top_k(lexical.cover_density_scores(index, groups, "doc_id"), 10, "doc_id").withColumn("score", F.round("score", 6))


@SEARCH.add(_BM25 + """, len_rank as (select query_id, doc_id, row_number() over (partition by query_id order by length(text), doc_id) rank from sc join documents using (doc_id)),
lists as (select query_id, doc_id, rank from bm where rank <= 100 union all select query_id, doc_id, rank from len_rank where rank <= 100)
select query_id, doc_id, round(sum(1 / (60 + rank)), 6) rrf from lists group by all""")
def rrf_two_channels(spark, directory):
    """Ranks by BM25 and by length, fused."""
    from pyspark.sql import Window

    scores = _bm25(spark, directory)
    short = scores.join(_documents(spark, directory), "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("text"), "doc_id")))
    lists = lexical.top_k(scores, 100, "doc_id").select("query_id", "doc_id", "rank").unionByName(short.where("rank <= 100").select("query_id", "doc_id", "rank"))
    return fusion.reciprocal_ranks(lists, "doc_id").withColumn("rrf", F.round("rrf", 6))


@SEARCH.add(_BM25 + "select query_id, doc_id, round(score / max(score) over (partition by query_id), 6) share, round((score - min(score) over (partition by query_id)) / nullif(max(score) over (partition by query_id) - min(score) over (partition by query_id), 0), 6) place from bm where score > 0")
def score_normalization(spark, directory):
    """scores as shares of the greatest, and between the least and the greatest."""
    scores = fusion.normalized(_bm25(spark, directory), "score")
    return scores.select("query_id", "doc_id", F.round("share", 6).alias("share"), F.round("place", 6).alias("place"))


_COS = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"


@SEARCH.add(f"""select * from (select q.vec_id query_id, e.vec_id, round({_COS}, 6) score, row_number() over (partition by q.vec_id order by round({_COS}, 6) desc, e.vec_id) rank
from embeddings q, embeddings e where q.vec_id % 20 = 0) where rank <= 5""")
def knn_cosine_topk(spark, directory):
    """The five vectors of the greatest cosine for each vector whose id is divisible by 20, of all."""
    rows = table(spark, directory, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return similarity.nearest_to(asked, rows, 5, "vec_id", "embedding")


@SEARCH.add("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) norm, len(embedding)::bigint dim from embeddings")
def vector_norms(spark, directory):
    """I16: the length of every vector."""
    return table(spark, directory, "embeddings").select("vec_id", F.round(similarity.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").cast("long").alias("dim"))


@SEARCH.add("select vec_id, true same from embeddings")
def vector_round_trip(spark, directory):
    """Vectors through bytes and text come back as they were."""
    rows = table(spark, directory, "embeddings")
    back = similarity.from_bytes(similarity.to_bytes("embedding"))
    text = similarity.from_text(similarity.to_text(F.col("embedding"))).cast("array<float>")
    return rows.select("vec_id", ((back == F.col("embedding")) & (text == F.col("embedding"))).alias("same"))


@SEARCH.add("select c.id, m.model from (select distinct id from chunks) c, (values ('lumen-small'), ('lumen-wide')) m(model) where not exists (select 1 from chunk_vectors v where v.chunk_id = c.id and v.model = m.model)")
def missing_vectors(spark, directory):
    """Chunks without a vector of a model."""
    models = F.explode(F.array(F.lit("lumen-small"), F.lit("lumen-wide"))).alias("model")
    wanted = table(spark, directory, "chunks").select("id").distinct().select("id", models)
    have = table(spark, directory, "chunk_vectors").select(F.col("chunk_id").alias("id"), "model")
    return wanted.join(have, ["id", "model"], "left_anti")


@SEARCH.add("""with r as (select source, doc_id, n_chars s, row_number() over (partition by source order by n_chars desc, doc_id) round, max(n_chars) over (partition by source) best from documents where n_chars is not null and source is not null)
select source, doc_id, round, row_number() over (order by round, best desc, s desc, doc_id) place from r""")
def round_robin(spark, directory):
    """Documents in rounds, one of each source at a time."""
    rows = table(spark, directory, "documents").where("n_chars is not null and source is not null").select(F.lit(1).alias("query_id"), "source", "doc_id", "n_chars")
    return fusion.rounds(rows, "source", "n_chars", "doc_id").select("source", "doc_id", "round", "place")


@SEARCH.add("select source, round(max(v) + least(0.8, 0.1 * (sum(v) - max(v))), 6) score from (select source, n_chars / 1000.0 v from documents where n_chars is not null) group by source")
def hint_bonus(spark, directory):
    """A group's best score and a bounded share of the others."""
    rows = table(spark, directory, "documents").where("n_chars is not null").select("source", (F.col("n_chars") / 1000.0).alias("score"))
    return fusion.hint_bonus(rows, ["source"]).withColumn("score", F.round("score", 6))


@SEARCH.add("""with s as (select source, n_chars, doc_id, ['symbol', 'path', 'concept', 'history', 'mixed'][doc_id % 5 + 1] intent, (doc_id % 10) / 10.0 sem, doc_id % 7 - 2.0 feat, 1.0 / (60 + doc_id % 50) rrf from documents)
select doc_id, round(case when sem <= 0 then 0.45 * rrf + 0.55 * tanh(feat / 2.2) when intent in ('symbol', 'path') then 0.24 * rrf + 0.48 * tanh(feat / 2.2) + 0.28 * sem when intent = 'concept' then 0.2 * rrf + 0.4 * tanh(feat / 2.2) + 0.4 * sem
 when intent = 'history' then 0.32 * rrf + 0.5 * tanh(feat / 2.2) + 0.18 * sem else 0.22 * rrf + 0.4 * tanh(feat / 2.2) + 0.38 * sem end + case when sem >= 0.85 and feat >= 0.8 then 0.06 else 0 end, 6) final from s""")
def combined_scores(spark, directory):
    """Weights by intent and agreement of meaning and features."""
    intents = F.array(*map(F.lit, ("symbol", "path", "concept", "history", "mixed")))
    rows = table(spark, directory, "documents").select("doc_id", intents[(F.col("doc_id") % 5).cast("int")].alias("intent"), ((F.col("doc_id") % 10) / 10.0).alias("sem"), (F.col("doc_id") % 7 - 2.0).alias("feat"), (1.0 / (60 + F.col("doc_id") % 50)).alias("rrf"))
    return rows.select("doc_id", F.round(fusion.combined(F.col("rrf"), F.col("feat"), F.col("sem"), F.col("intent")), 6).alias("final"))
