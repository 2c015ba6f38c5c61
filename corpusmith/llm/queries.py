"""The queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusmith.llm import bpe, handwritten, neardup, packing, secrets, splitting, truncation, vectors
from corpusmith.plans.registry import Registry
from corpusmith.sources.tables import table

LLM = Registry()


@LLM.add("select distinct id from chunks where length(content) > 2400")
def p2_found(spark, directory):
    """Problem 2: the chunks that come out in several pieces."""
    big = table(spark, directory, "chunks").where(splitting.oversized(F.col("content")))
    return splitting.split_oversized(big).where("pieces > 1").select("id").distinct()


@LLM.add()
def p2_pieces(spark, directory):
    """Problem 2: the pieces of every oversized chunk, each id once."""
    big = table(spark, directory, "chunks").where(splitting.oversized(F.col("content")))
    return splitting.split_oversized(big.dropDuplicates(["id"]))


@LLM.add("""select id, length(c)::bigint chars, true as "within", true as covered, true as numbered, true as shared, true as "natural" from (select id, min(content) c, min(start_line) a from chunks group by id) where length(c) > 2400""")
def p2_sound(spark, directory):
    """Problem 2: of every oversized chunk, whether its pieces keep the limit, cover it, bear the right lines, share what is stated, and end where the text breaks."""
    import pandas as pd

    rows = table(spark, directory, "chunks").groupBy("id").agg(F.min("content").alias("content"), F.min("start_line").alias("start_line")).where(splitting.oversized(F.col("content")))
    pieces = splitting.split_oversized(rows).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "start_line", "end_line", "content"))).alias("p"))

    def examined(batches):
        for batch in batches:
            out = []
            for key, text, first, own in zip(batch["id"], batch["content"], batch["start_line"], batch["p"], strict=True):
                ends, before, begun = [], 0, 0
                flags = dict.fromkeys(("within", "covered", "numbered", "shared", "natural"), True)
                for n, piece in enumerate(own):
                    body = piece["content"]
                    # it begins where it shares most with the piece before, which is where its text is found first
                    at = text.find(body, begun + 1 if n else 0)
                    flags["within"] &= len(body) <= splitting.LIMIT
                    flags["covered"] &= 0 <= at <= before and at + len(body) > before and (n < len(own) - 1 or at + len(body) == len(text))
                    flags["numbered"] &= piece["start_line"] == first + text.count("\n", 0, at) and piece["end_line"] == first + text.count("\n", 0, at + len(body) - 1)
                    both = text[at:before]
                    flags["shared"] &= not n or both.count("\n") == splitting.OVERLAP_LINES and (at == 0 or text[at - 1] == "\n") or len(both) == splitting.OVERLAP_CHARS
                    begun, before = at, at + len(body)
                    # inside a line only where the piece's new part has no line's end near its end
                    flags["natural"] &= before == len(text) or text[before - 1] == "\n" or "\n" not in text[max(at, before - splitting.LIMIT // 4) : before]
                out.append((key, len(text), *flags.values()))
            yield pd.DataFrame(out, columns=["id", "chars", "within", "covered", "numbered", "shared", "natural"])

    return rows.join(pieces, "id").mapInPandas(examined, "id string, chars long, within boolean, covered boolean, numbered boolean, shared boolean, natural boolean")


@LLM.add()
def p7_ids(spark, directory):
    """Problem 7: token ids of every document."""
    return bpe.encode_texts(table(spark, directory, "documents"), "doc_id", "text")


@LLM.add("select doc_id, md5(coalesce(text, '')) digest from documents")
def p7_round_trip(spark, directory):
    """Problem 7: the texts of all documents' ids, decoded again."""
    ids = bpe.encode_texts(table(spark, directory, "documents"), "doc_id", "text")
    return bpe.decode_ids(ids, "doc_id").select("doc_id", F.md5("text").alias("digest"))


@LLM.add()
def p8_containers(spark, directory):
    """Problem 8: container and place of every document."""
    sizes = bpe.count_tokens(table(spark, directory, "documents"), "doc_id", "text")
    return packing.pack_items(sizes.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))).withColumnRenamed("item", "doc_id")


@LLM.add("select doc_id, true as whole, true as fits, true as apart from documents")
def p8_sound(spark, directory):
    """Problem 8: of every document, whether all its tokens are placed, split only beyond the capacity, in containers that hold no more than it and no two pieces in one place."""
    docs = table(spark, directory, "documents")
    sizes = bpe.count_tokens(docs, "doc_id", "text")
    placed = packing.pack_items(sizes.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")))
    order = Window.partitionBy("container").orderBy("offset")  # a container holds no more pieces with tokens than tokens
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = placed.where("size > 0").withColumn("apart", F.col("offset") == before).unionByName(placed.where("size = 0").withColumn("apart", F.lit(True)))
    checked = apart.withColumn("fits", F.col("offset") + F.col("size") <= packing.CAPACITY)
    own = checked.groupBy("item").agg(F.sum("size").alias("placed"), F.count("*").alias("pieces"), F.every("apart").alias("apart"), F.every("fits").alias("fits"))
    whole = (F.col("placed") == F.col("n_tokens")) & ((F.col("pieces") == 1) | (F.col("n_tokens") > packing.CAPACITY))
    return sizes.join(own, sizes["doc_id"] == own["item"]).select("doc_id", whole.alias("whole"), "fits", "apart")


@LLM.add()
def p9_found(spark, directory):
    """Problem 9: documents that were cut off."""
    return truncation.find_truncated(table(spark, directory, "documents")).where("truncated").select("doc_id").distinct()


@LLM.add()
def p9_sources(spark, directory):
    """Problem 9: the share of cut documents of each source."""
    return truncation.truncation_rates(truncation.find_truncated(table(spark, directory, "documents")))


@LLM.add()
def p4_found(spark, directory):
    """Problem 4: pairs of chunks that differ by small edits."""
    return neardup.expand(*neardup.near_duplicates(table(spark, directory, "chunks"), 0.7))


@LLM.add()
def p4_groups(spark, directory):
    """Problem 4: the group of every chunk."""
    return neardup.groups(*neardup.near_duplicates(table(spark, directory, "chunks")))


@LLM.add()
def p3_found(spark, directory):
    """Problem 3: pairs of vectors that point nearly in the same direction."""
    near = vectors.nearest(table(spark, directory, "chunk_vectors"), 5, 0.88)
    return near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


@LLM.add()
def p3_queries(spark, directory):
    """Problem 3: the five most similar vectors of all for each vector whose id is divisible by 20."""
    rows = table(spark, directory, "chunk_vectors")
    return vectors.search_queries(rows, rows.where("vec_id % 20 = 0"))


@LLM.add()
def p6_found(spark, directory):
    """Problem 6: lines of chunks on which a credential begins."""
    return secrets.credentials(table(spark, directory, "chunks")).where("line is not null").select("id", "line").distinct()


@LLM.add()
def p6_redacted(spark, directory):
    """Problem 6: the contents of chunks with credentials, redacted; each id once."""
    return secrets.credentials(table(spark, directory, "chunks").dropDuplicates(["id"]), redacted=True)


@LLM.add("""select id, true as same_length, true as same_lines from (select distinct id from chunks)""")
def p6_sound(spark, directory):
    """Problem 6: of every chunk, whether its redacted content has its length, and each line its own."""
    rows = table(spark, directory, "chunks").groupBy("id").agg(F.min("content").alias("content"), F.min("start_line").alias("start_line"))
    found = secrets.credentials(rows, redacted=True).withColumnRenamed("content", "redacted")
    both = rows.join(found, "id", "left").withColumn("redacted", F.coalesce("redacted", "content"))
    lines = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.length(x))
    return both.select("id", F.coalesce(F.length("redacted") == F.length("content"), F.lit(True)).alias("same_length"), F.coalesce(lines("redacted") == lines("content"), F.lit(True)).alias("same_lines"))


@LLM.add()
def p5_found(spark, directory):
    """Problem 5: files that nobody wrote by hand in their workspace."""
    return handwritten.not_handwritten(table(spark, directory, "files"), table(spark, directory, "chunks")).select("workspace_id", "path")
