"""Search over an index of chunks: channels, fusion, scoring by file, and graph and neural steps, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpusmith.functions import ranking
from corpusmith.functions.code import names
from corpusmith.functions.query import Query, analyze, fts_groups, path_hints, priority_terms, strong_identifier, subqueries, symbol_hints
from corpusmith.functions.tokens import plain_tokens, search_text, tokens
from corpusmith.operators import evaluation, fusion, graph, lexical
from corpusmith.operators.models import Breaker
from corpusmith.session import materialize

CHANNEL_ROWS = 200
#: Hints of paths are sent to all tasks up to so many characters; more are met by a sort. Spark's own choice would be the paths' pieces, of whose number it has no estimate.
SENT_HINTS = 4_000_000
#: Candidates of a query that are reranked, and how far their scores move.
RERANK_TOP, RERANK_WEIGHT = 20, 0.32


#: Tables of an index.
TABLES = ("chunks", "postings", "statistics", "symbols", "heads", "imports")


class Index(dict):
    """The tables that search reads, by name, each made and written to the shared folder when it is first read."""

    def __init__(self, chunks: DataFrame) -> None:
        super().__init__()
        self._source = chunks

    def __missing__(self, name: str) -> DataFrame:
        made = self[name] = materialize(getattr(self, f"_{name}")(), name)
        return made

    def _chunks(self) -> DataFrame:
        columns = ("path", "language", "symbol", "start_line", "end_line", "content", "hash")
        first = self._source.groupBy("id").agg(F.min(F.struct("path", "start_line", "content", "language", "symbol", "end_line", "hash")).alias("c"))
        return first.select("id", *(F.col(f"c.{c}").alias(c) for c in columns))

    def _cut(self) -> DataFrame:
        return self["chunks"].select("id", tokens(search_text(F.col("path"), F.col("symbol"), F.col("language"), F.col("content"))).alias("t"))

    def _postings(self) -> DataFrame:
        return lexical.postings(self["cut"], "id", F.col("t"))

    def _statistics(self) -> DataFrame:
        return lexical.corpus_statistics(self["cut"], F.col("t"))

    def _symbols(self) -> DataFrame:
        own = F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>"))
        named = self["chunks"].select("id", "path", "start_line", F.explode(F.array_distinct(F.concat(names("content", "language"), own))).alias("name"))
        return named.withColumn("name_lower", F.lower("name"))

    def _heads(self) -> DataFrame:
        return self._source.where("id is not null").groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("id"))

    def _imports(self) -> DataFrame:
        return graph.imports_of(self["chunks"].select("path", "content"))


def build_index(chunks: DataFrame) -> Index:
    """The tables that search reads: chunks (each id once), postings, symbols, heads of files, imports and corpus statistics.

    Each is written to the shared folder when a search first needs it, and read by all later ones.
    """
    return Index(chunks)


def save_index(index: Index, folder: str) -> None:
    """Writes the tables of an index, so that later sessions can read them."""
    for name in TABLES:
        index[name].write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that :func:`save_index` wrote."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in TABLES}


def plan_queries(queries: DataFrame) -> DataFrame:
    """query_id with the analyzed query, the vocabularies of its channels, and whether it names a strong identifier."""

    def plan(batches):
        for batch in batches:
            out = []
            for key, raw in zip(batch["query_id"], batch["raw"], strict=True):
                q = analyze(raw)
                groups = [] if q.paths else fts_groups(q.raw, priority_terms(q))
                out.append((key, q.raw, q.intent, groups, [s.lower() for s in symbol_hints(q)], bool(q.identifiers), path_hints(q), any(map(strong_identifier, q.identifiers))))
            yield pd.DataFrame(out, columns=["query_id", "raw", "intent", "groups", "symbols", "exact", "hints", "strong"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "raw").mapInPandas(plan, f"query_id {kind}, raw string, intent string, groups array<array<string>>, symbols array<string>, exact boolean, hints array<string>, strong boolean")


def _ranked(scores: DataFrame, channel: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "id", F.lit(channel).alias("channel"), "score", "rank")


def text_channel(plans: DataFrame, index: dict[str, DataFrame], k: int = CHANNEL_ROWS) -> DataFrame:
    """Chunks that hold a term of every group, by BM25 over all terms. Queries with explicit paths have no groups."""
    matched = lexical.boolean_matches(index["postings"], plans.select("query_id", "groups"), "id")
    terms = plans.select("query_id", F.array_distinct(F.flatten("groups")).alias("terms"))
    scores = lexical.bm25(index["postings"], index["statistics"], terms, "id")
    return _ranked(scores.join(matched, ["query_id", "id"], "left_semi"), "fts", k)


def symbol_channel(plans: DataFrame, index: dict[str, DataFrame], k: int = CHANNEL_ROWS) -> DataFrame:
    """Chunks that declare a wanted symbol: 3 where it is equal, 1.5 where it begins, 0.8 where it contains the hint.

    Identifiers and hints of under four letters count only if equal. Beginnings and contained
    hints are met over the distinct names, whose pieces join the hints by equality.
    """
    asked = plans.select("query_id", "exact", F.explode("symbols").alias("hint"))
    exact = index["symbols"].join(asked, F.col("name_lower") == F.col("hint")).select("query_id", "id", "hint", F.lit(3.0).alias("s"))
    loose = asked.where("not exact and length(hint) >= 4")
    sizes = F.transform(F.sequence(F.lit(1), F.length("name_lower") - 3), lambda i: F.substring(F.col("name_lower"), i, F.length("name_lower")))
    tails = index["symbols"].select("name_lower").distinct().where("length(name_lower) > 4").select("name_lower", F.posexplode(sizes).alias("at", "tail"))
    # a hint is contained if a tail of the name begins with it: tails meet hints by their first four letters
    met = tails.withColumn("k", F.substring("tail", 1, 4)).join(loose.withColumn("k", F.substring("hint", 1, 4)), "k").where(F.col("tail").startswith(F.col("hint")) & (F.col("name_lower") != F.col("hint")))
    fuzzy = met.groupBy("query_id", "name_lower", "hint").agg(F.max(F.when(F.col("at") == 0, 1.5).otherwise(0.8)).alias("s"))
    fuzzy = fuzzy.join(index["symbols"].select("name_lower", "id"), "name_lower").select("query_id", "id", "hint", "s")
    best = exact.unionByName(fuzzy).groupBy("query_id", "id", "hint").agg(F.max("s").alias("s"))
    total = best.groupBy("query_id", "id").agg((F.max("s") + F.least(F.lit(1.0), 0.25 * (F.sum("s") - F.max("s")))).alias("score"))
    return _ranked(total, "symbol", k)


def exact_symbols(hints: DataFrame, symbols: DataFrame, each: int) -> DataFrame:
    """hint, id, score 3 and rank of the first ``each`` chunks (name, id, start_line) that declare each hint, by line and id; case doesn't count."""
    met = symbols.select(F.lower("name").alias("hint"), "id", "start_line").join(hints.select(F.lower("hint").alias("hint")).distinct(), "hint")
    once = met.groupBy("hint", "id").agg(F.min("start_line").alias("start_line"))
    order = Window.partitionBy("hint").orderBy("start_line", "id")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= each).select("hint", "id", F.lit(3.0).alias("score"), "rank")


def hint_score(path: Column, hint: Column) -> Column:
    """How closely a path's file name answers a hint in lower case: from 4 for a fragment of several segments to 2 for any substring."""
    base = F.regexp_extract(path, "[^/]*$", 0)
    raw = F.regexp_replace(base, r"\.[^.]+$", "")
    stem = F.lower(raw)
    whole = F.concat(F.lit("/"), F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"\.[^./]+$", ""), F.lit("/"))
    return (
        F.when(F.contains(hint, F.lit("/")) & F.contains(whole, F.concat(F.lit("/"), hint, F.lit("/"))), 4.0)
        .when(stem == hint, 3.2)
        .when((stem == F.concat(hint, F.lit("s"))) | (stem == F.concat(hint, F.lit("es"))), 3.1)
        .when(F.lower(base).startswith(F.concat(hint, F.lit("."))), 3.0)
        .when(F.array_contains(plain_tokens(raw), hint), 2.9)
        .when((F.length(hint) >= 4) & stem.startswith(hint), 2.7)
        .otherwise(2.0)
    )


def path_channel(plans: DataFrame, index: dict[str, DataFrame], k: int = CHANNEL_ROWS, each: int = 100) -> DataFrame:
    """First chunks of files whose path contains a hint, by how closely the name answers it; ``each`` files a hint, shortest first.

    Paths are cut into pieces of four letters, on which they meet hints by equality; hints of
    under four letters are held against every path. The hints are sent to the pieces if they are
    few, and never the pieces to the hints.
    """
    asked = materialize(plans.select("query_id", F.explode("hints").alias("hint")), "hints")
    few = (asked.agg(F.sum(F.length("hint") + 64)).first()[0] or 0) <= SENT_HINTS
    sent = lambda rows: rows.hint("broadcast" if few else "merge")
    heads = index["heads"].withColumn("low", F.lower("path"))
    grams = heads.where("length(low) >= 4").select("path", "id", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 3), lambda i: F.substring(F.col("low"), i, F.lit(4))))).alias("k"))
    long = grams.join(sent(asked.where("length(hint) >= 4").withColumn("k", F.substring("hint", 1, 4))), "k").where(F.contains("low", F.col("hint"))).select("query_id", "hint", "path", "id")
    pairs = heads.select("path", "id", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 1), lambda i: F.substring(F.col("low"), i, F.lit(2))))).alias("k"))
    short = pairs.join(sent(asked.where("length(hint) between 2 and 3").withColumn("k", F.substring("hint", 1, 2))), "k").where(F.contains("low", F.col("hint"))).select("query_id", "hint", "path", "id")
    order = Window.partitionBy("query_id", "hint").orderBy(F.length("path"), "path")
    near = long.unionByName(short).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    scores = near.select("query_id", "id", hint_score(F.col("path"), F.col("hint")).alias("score"))
    return _ranked(fusion.hint_bonus(scores, ["query_id", "id"]), "path", k)


def _features(path, language, symbol, content, raw):
    known: dict[str, Query] = {}
    out = []
    for p, lang, s, c, r in zip(path, language, symbol, content, raw, strict=True):
        if r not in known:
            known[r] = analyze(r)
        out.append(ranking.feature_score(p, lang, s, c, known[r]))
    return pd.Series(out)


def candidates(plans: DataFrame, channels: list[DataFrame], index: dict[str, DataFrame], k: int) -> DataFrame:
    """The max(8k, 96) best chunks of each query by fused ranks, with features and final score.

    Texts are joined only to these. Commits don't count unless the query asks for history.
    """
    lists = channels[0]
    for c in channels[1:]:
        lists = lists.unionByName(c)
    lists = materialize(lists, "lists")
    meaning = lists.where("channel = 'semantic'").groupBy("query_id", "id").agg(F.max("score").alias("semantic"))
    fused = fusion.reciprocal_ranks(lists, "id").join(meaning, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "id")
    capped = fused.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(8 * k, 96)).drop("_n")
    full = capped.join(index["chunks"], "id").join(plans.select("query_id", "raw", "intent"), "query_id")
    full = full.where((F.coalesce("language", F.lit("")) != "git-commit") | (F.col("intent") == "history"))
    scored = full.withColumn("features", F.pandas_udf(_features, T.DoubleType())("path", "language", "symbol", "content", "raw"))
    rank = fusion.max_normalized("rrf")
    sense = fusion.max_normalized("semantic")
    return scored.withColumn("final", fusion.combined(rank, F.col("features"), sense, F.col("intent")))


#: Rank share of candidates that only the graph gives.
GRAPH_RANK = 0.12


def with_neighbours(scored: DataFrame, plans: DataFrame, index: dict[str, DataFrame], k: int, always: bool = False) -> DataFrame:
    """Scored candidates and the chunks one step from the best of each query, but for queries that name a strong identifier.

    The max(2k, 8) best are the seeds and at most max(2k, 12) chunks are added, with a fixed share
    of rank and without meaning.
    """
    scored = materialize(scored, "scored")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 9)), "id")
    wide = plans if always else plans.where("not strong")
    best = scored.join(wide.select("query_id"), "query_id", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(2 * k, 8))
    own = F.when(F.col("symbol").isNotNull(), F.array("symbol")).otherwise(F.array().cast("array<string>"))
    seeds = materialize(best.select("query_id", "id", "path", F.array_distinct(F.concat(names("content", "language"), own)).alias("names")), "seeds")
    near = graph.expand(seeds, index["chunks"], index["symbols"].select("name", "id"), index["imports"], max(2 * k, 12)).select("query_id", "id")
    new = near.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti").join(index["chunks"], "id").join(plans.select("query_id", "raw", "intent"), "query_id")
    new = new.where((F.coalesce("language", F.lit("")) != "git-commit") | (F.col("intent") == "history"))
    new = new.withColumn("features", F.pandas_udf(_features, T.DoubleType())("path", "language", "symbol", "content", "raw"))
    new = new.withColumn("rrf", F.lit(GRAPH_RANK)).withColumn("final", fusion.combined(F.lit(GRAPH_RANK), F.col("features"), F.lit(0.0), F.col("intent")))
    return scored.unionByName(new, allowMissingColumns=True)


_HIT = "place int, id string, path string, language string, symbol string, start_line int, end_line int, content string, hash string, final double"


def select_hits(scored: DataFrame, k: int, diverse: bool = True, semantic: bool = False) -> DataFrame:
    """The ``k`` hits of each query: one for each file, in the order of preference, then chosen for diversity.

    Candidates are bounded for each query, so a query is one group. They are given in the order of
    final score and id, which fixes the result of the preference that isn't transitive. Where
    meaning was searched (``semantic``), diversity weighs less.
    """
    kind = scored.schema["query_id"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        q = analyze(group["raw"].iloc[0])
        rows = group.sort_values(["final", "id"], ascending=[False, True], kind="stable").to_dict("records")
        hits = ranking.collapse(rows, q)
        hits = ranking.diversify(hits, k, 0.88 if semantic else 0.8) if diverse else hits[:k]
        out = pd.DataFrame(hits)
        out["place"] = range(1, len(out) + 1)
        out["query"] = q.raw
        return out[["query_id", "query", *(c.split()[0] for c in _HIT.split(", "))]]

    cols = ["query_id", "raw", "id", "path", "language", "symbol", "start_line", "end_line", "content", "hash", "final"]
    rows = scored.select(*cols[:6], F.col("start_line").cast("int").alias("start_line"), F.coalesce("end_line", "start_line").cast("int").alias("end_line"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("hash", F.lit("")).alias("hash"), "final")
    return rows.groupBy("query_id").applyInPandas(one, f"query_id {kind}, query string, {_HIT}")


def search(queries: DataFrame, index: dict[str, DataFrame], k: int = 10, semantic: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, diverse: bool = True, expand: bool | None = None) -> DataFrame:
    """The ``k`` hits of each query (query_id, raw).

    ``expand`` adds neighbours in the graph always or never; by default for queries without a strong identifier.

    ``semantic`` may give a channel (query_id, id, score, rank); ``rerank`` gets the scored
    candidates and adds a column neural, which is blended in.
    """
    plans = materialize(plan_queries(queries), "plans")
    channels = [text_channel(plans, index), symbol_channel(plans, index), path_channel(plans, index)]
    if semantic is not None:
        channels.append(semantic.select("query_id", "id", F.lit("semantic").alias("channel"), "score", "rank"))
    scored = candidates(plans, channels, index, k)
    if expand is not False:
        scored = with_neighbours(scored, plans, index, k, bool(expand))
    if rerank is not None:
        scored = reranked(scored, rerank, RERANK_TOP, RERANK_WEIGHT)
    return select_hits(scored, k, diverse, semantic is not None)


def reranked(scored: DataFrame, rerank: Callable[[DataFrame], DataFrame], top: int, weight: float) -> DataFrame:
    """Scored candidates whose ``top`` best of each query are given to ``rerank``, which adds neural, and moved towards its scores by ``weight``; the others keep theirs."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 9)), "id")
    placed = materialize(scored.withColumn("_n", F.row_number().over(order)), "placed")
    best = fusion.blend_scores(rerank(placed.where(F.col("_n") <= top).drop("_n")), weight)
    return best.drop("neural").unionByName(placed.where(F.col("_n") > top).drop("_n"))


def search_reliably(
    queries: DataFrame, index: dict[str, DataFrame], k: int = 10, semantic: Callable[[DataFrame], DataFrame] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None,
    breakers: dict[str, Breaker] | None = None,
) -> tuple[DataFrame, list[str]]:
    """The hits of :func:`search` and the steps that had to be left out.

    ``semantic`` makes a channel of queries and ``rerank`` adds scores, both by services that may
    fail: each is run at once, under its breaker of ``breakers`` (semantic, rerank), and where it
    fails or is kept back, the search goes on without it.
    """
    breakers = breakers if breakers is not None else {}
    own = lambda name: breakers.setdefault(name, Breaker())
    degraded: list[str] = []
    channel = own("semantic").call(lambda: materialize(semantic(queries), "semantic"), None, degraded, "semantic") if semantic else None
    safe = None
    if rerank:

        def safe(scored: DataFrame) -> DataFrame:
            scored = materialize(scored, "scored")
            return own("rerank").call(lambda: materialize(rerank(scored), "reranked"), scored.withColumn("neural", F.lit(None).cast("double")), degraded, "rerank")

    return search(queries, index, k, channel, safe), degraded


def planned_subqueries(queries: DataFrame) -> DataFrame:
    """query_id, sub (from 1), raw and reason of the focused parts of long queries."""

    def plan(batches):
        for batch in batches:
            rows = [(key, n + 1, text, reason) for key, raw in zip(batch["query_id"], batch["raw"], strict=True) for n, (text, reason) in enumerate(subqueries(analyze(raw)))]
            yield pd.DataFrame(rows, columns=["query_id", "sub", "raw", "reason"]).astype({"sub": "int32"})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "raw").mapInPandas(plan, f"query_id {kind}, sub int, raw string, reason string")


def search_with_subqueries(queries: DataFrame, index: dict[str, DataFrame], k: int = 12) -> DataFrame:
    """The hits of each query, followed by what only its subqueries found (a fifth of ``k`` at most)."""
    primary = search(queries, index, k)
    subs = planned_subqueries(queries)
    own = subs.select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub").cast("string")).alias("query_id"), "raw")
    found = search(own, index, max(4, k // 2), diverse=False)
    parts = F.split("query_id", "#")
    kind = queries.schema["query_id"].dataType
    others = found.select(parts[0].cast(kind).alias("query_id"), parts[1].cast("int").alias("sub"), "id", F.col("place").alias("rank"))
    merged = fusion.append_discoveries(primary.select("query_id", "id", F.col("final").alias("score")), others, "id", k)
    order = Window.partitionBy("query_id").orderBy("discovered", F.desc("score"), "id")
    placed = merged.withColumn("place", F.row_number().over(order))
    return placed.join(index["chunks"], "id").join(queries.select("query_id", F.col("raw").alias("query")), "query_id")



def evaluate(cases: DataFrame, index: dict[str, DataFrame], with_subqueries: bool = False, strict: bool = False) -> DataFrame:
    """Metrics of each case (case_id, query, expected, top_k): its query is searched for the most that any case wants, and the files found are held against what it expects."""
    most = cases.agg(F.max("top_k")).first()[0] or 1
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("raw"))
    hits = search_with_subqueries(asked, index, most) if with_subqueries else search(asked, index, most)
    found = hits.select(F.col("query_id").alias("case_id"), F.col("place").alias("rank"), "path")
    return evaluation.ranking_metrics(found, cases.select("case_id", "expected", "top_k"), strict)


def compare_subqueries(cases: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Per case: recall with one query and with subqueries, their difference and the outcome."""
    runs = lambda name, more: evaluate(cases, index, more).select("case_id", F.lit(1).alias("repetition"), F.lit(name).alias("variant"), F.lit("ok").alias("status"), "recall")
    return evaluation.paired_deltas(runs("single", False).unionByName(runs("subqueries", True)), "single", "subqueries", "recall")
