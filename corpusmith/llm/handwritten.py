"""Problem 5: files of a source tree that nobody wrote by hand in it.

Chunks become sequences of masked tokens: every identifier, number and string is one mark. Their
runs of five are sketched by MinHash; chunks whose sketches share two bands form families, which
are verified against representatives. Families whose masked lines follow one another in a few
fixed ways, and masks that many different contents of one workspace share, come from generators,
those that are mostly literals are data, those without layout are minified.

What these families decide labels files, and from the labels the words are learned that tell of
origin in the comments at the edges of files: lines with the same telling words form families,
too, and those whose files are labelled often enough tell of all their files. Besides, a file's
own statement of its origin and folders for third parties hold; these two are plain lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusmith.llm.shingles import WORDS

#: Values of a sketch, and the bands they are grouped in: sets of similarity s meet with 1 - (1 - s ** (BINS / BANDS)) ** BANDS.
BINS, BANDS = 32, 8
#: A member agrees with its family's representative in this share of the sketch.
SIMILAR = 0.8
#: Share of a file's characters that must lie in families of a kind.
SHARE = 0.5
#: A generator's lines: at least so many, each pair of neighbours repeated so often, and pairs at most so many times the line forms.
LINES, REPEATED, BRANCHES = 6, 2.5, 2.2
#: Different contents of one workspace with one mask from which a template dealt them, whatever their layout; masks of fewer marks are alike by chance.
DEALT, MARKS = 20, 40
#: Literal share of data; white space share and line length of minified text.
LITERAL, SPACE, LONG = 0.55, 0.05, 150
#: Comment lines among the first so many count even behind code.
HEAD_LINES = 8
#: A word tells of origin, and a family of lines with the same telling words decides, if so many labelled files have it, in so many workspaces, and they are this share of all.
TELLING, TELLING_SPACES, TELLING_SHARE = 3, 2, 0.25

# Fixed values, an addition to the method: folders that hold third parties' files, and forms in which a file states its origin.
THIRD_PARTY = "vendor vendored third_party third-party thirdparty 3rdparty node_modules bower_components deps external extern site-packages pods carthage".split()
_FOREIGN = re.compile(r"\bupstream\b|\bdistribution\b|\bbundled\b|\bvendored (?:from|copy)\b|\bcontributors\b|\breleased under\b|\b(?:copied|imported|forked|ported|adapted|taken) (?:\w+ )?from\b|\bthird[- ]party\b|all rights reserved")
_OWN = re.compile(r"\bthis tree\b|\bours\b|\bour own\b|\bunlike\b|\bthis (?:project|repository)\b|\bsee the generated\b")
_MADE = re.compile(
    r"^\W*(?:code |file |this file (?:is|was) |this (?:is|was) )?(?:auto(?:matically)?[- ]?|machine[- ])?generated\b(?: code)?(?: (?:by|from|with|file|using|do)\b|\W|$)"
    r"|^\W*@generated\b|<auto-?generated\W|\bgenerated\b.*\bdo not (?:edit|modify)\b|^\W*automatisch (?:erzeugt|generiert)\b|^\W*(?:fichier )?g[ée]n[ée]r[ée] (?:par|automatiquement)\b"
    r"|^\W*(?:archivo |fichero )?generado (?:por|autom[áa]ticamente)\b|^\W*自动生成|^\W*此文件由"
    r"|^\W*this file (?:is|was) (?:produced|created|written|built|compiled) by\b|^\W*(?:built|compiled|derived|rendered) from (?:[\w.\-]+ ){0,3}(?:grammar|schema|template|spec|contract|idl|proto)\b"
)
#: Documents; the lines of prose are alike too.
_PROSE = re.compile(r"\.(?:md|mdx|markdown|rst|txt|adoc|org|tex)$", re.IGNORECASE)
_COMMENT = re.compile(r"^\s*(?:/\*+!?|//+!?|#+!?|--+|<!--+|\*+|;+|%+|\"\"\"|''')")
#: Comment lines behind the code: without stars and quotes, which there belong to code; in documents only one form is a comment.
_BEHIND = re.compile(r"^\s*(?:/\*|//|#|--|<!--|;|%)")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
#: Lines of code that may stand among the comments that begin a file.
_PREAMBLE = re.compile(r"^\s*(?:(?:package|import|from|using|use|require|module|namespace|library)\b|[\"']use strict|<\?|<!doctype)", re.IGNORECASE)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`")
_NAME = re.compile(r"[^\W\d][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_BLANK = re.compile(r"[^\S\n]+")


def masked(text: str) -> str:
    """The text with strings, names and numbers as S, i and 0, and without blanks."""
    text = _STRING.sub("\x01", text)
    text = _NAME.sub("i", text)
    text = _NUMBER.sub("0", text)
    return _BLANK.sub("", text).replace("\x01", "S")


def layout(text: str) -> dict:
    """Features of a chunk: how regular its lines are, and how much of it is literals or white space."""
    mask = masked(text)
    lines = [line for line in mask.split("\n") if line]
    n = len(lines)
    pairs = len(set(zip(lines, lines[1:], strict=False)))
    forms = len(set(lines))
    solid = len(text) - sum(map(str.isspace, text)) if len(text) < 64 else len("".join(text.split()))
    literal = sum(len(m) - 2 for m in _STRING.findall(text)) + sum(map(len, _NUMBER.findall(_NAME.sub("", _STRING.sub("", text)))))
    prose = sum("iiiii" in line for line in lines)  # sentences, also in comments, are nobody's template
    return {
        "regular": bool(n >= LINES and 2 * prose < n and (n - 1) >= REPEATED * pairs and pairs <= BRANCHES * forms + 1),
        "literal": literal / max(1, solid), "space": 1 - solid / max(1, len(text)), "line": len(text) / max(1, n), "mask": mask,
        "coded": bool(2 * prose < n and len(mask) >= MARKS),
    }


def minhash(mask: str) -> np.ndarray:
    """One-permutation MinHash of the runs of five marks; empty bins take the next filled one's value."""
    marks = np.frombuffer(mask.replace("\n", "~").encode("latin-1", "replace"), dtype=np.uint8).astype(np.uint64)
    if len(marks) < WORDS:
        marks = np.concatenate([marks, np.full(WORDS - len(marks), 126, dtype=np.uint64)])
    count = len(marks) - WORDS + 1
    runs = np.zeros(count, dtype=np.uint64)
    for i in range(WORDS):
        runs = (runs << np.uint64(8)) | marks[i : i + count]
    h = np.unique(runs)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    bins = (h % np.uint64(BINS)).astype(np.int64)
    out = np.full(BINS, np.iinfo(np.int32).max, dtype=np.int64)
    np.minimum.at(out, bins, (h >> np.uint64(33)).astype(np.int64))
    filled = np.flatnonzero(out < np.iinfo(np.int32).max)
    nearest = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
    return (out[nearest] + np.where(nearest == np.arange(BINS), 0, 0)).astype(np.int32)


_SAID = re.compile(r"[@<]?[^\W\d_]+(?:['’][^\W\d_]+)?")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")


def words_said(line: str) -> list[str]:
    """The words of a comment line in order; pairs of characters where words aren't spaced."""
    out: list[str] = []
    for word in _SAID.findall(_UNSPACED.sub(lambda m: " " + " ".join(m.group()[i : i + 2] for i in range(max(1, len(m.group()) - 1))) + " ", line)):
        out.append(word)
    return out


#: Where a comment line stands: in the first lines of a file, in the comments that begin a chunk, in those that end it.
FIRST, OPENING, CLOSING = 1, 2, 4


def _edges(lines: list[str], prose: bool, inside: str = "") -> tuple[dict[int, int], bool]:
    """Places of the comment lines that begin and end a text, however many, and whether it has no other lines but preamble."""
    places: dict[int, int] = {}
    block, whole = inside, True
    for i, line in enumerate(lines):
        bare = line.strip()
        if block:
            places[i] = OPENING
            block = "" if block in bare else block
            continue
        if not bare:
            continue
        begun = next((x for x in _BLOCKS if bare.startswith(x)), None)
        if begun == "<!--" if prose else _COMMENT.match(line):
            places[i] = OPENING
            if begun and _BLOCKS[begun] not in bare[len(begun) :]:
                block = _BLOCKS[begun]
        elif not _PREAMBLE.match(line):
            whole = False
            break
    i = len(lines) - 1
    while i >= 0:
        bare = lines[i].strip()
        ended = next((x for x in ("/*", "<!--") if bare.endswith(_BLOCKS[x])), None)
        at = i
        while ended and at >= 0 and ended not in lines[at]:
            at -= 1
        if ended and (at < 0 or not lines[at].strip().startswith(ended)):
            break
        if bare and not ended and (prose or not _BEHIND.match(lines[i])):
            break
        if bare:
            for j in range(at, i + 1):
                places[j] = places.get(j, 0) | CLOSING
        i = at - 1
    return places, whole


def head_lines(text: str, start: int | None = 1, prose: bool = False) -> tuple[list[tuple[list[str], bool, bool, int]], bool]:
    """The comment lines at the edges of a chunk: their words, whether they state that a tool made the file or that it came from elsewhere, and where they stand; and whether the chunk is nothing else."""
    lines = text.split("\n")
    inside = ""
    if start is not None and start > 1 and (end := text.find("*/")) >= 0 and not 0 <= text.find("/*") < end:
        inside = "*/"  # the comment began in the chunk before
    places, whole = _edges(lines, prose, inside)
    if start is None or start <= HEAD_LINES:
        for i in range(min(HEAD_LINES, len(lines))):
            if _COMMENT.match(lines[i]):
                places[i] = places.get(i, 0) | FIRST
    out = []
    for i, place in sorted(places.items()):
        said = _COMMENT.sub("", lines[i]).strip().lower()
        if not re.search(r"\w", said):
            continue
        own = bool(_OWN.search(said))
        named = bool(re.search(r"\d|\bupstream\b|\bdistribution\b|[a-z]+(?:kit|lib|js|core)\b", said))
        out.append((words_said(said), not own and bool(_MADE.search(said)), not own and named and bool(_FOREIGN.search(said)), place))
    return out, whole


def head_of(text: str) -> tuple[bool, bool]:
    """Whether the comments at a file's edges by themselves say that it was made by a tool, or came from elsewhere."""
    lines, _ = head_lines(text)
    return any(x[1] for x in lines), any(x[2] for x in lines)


def features(chunks: DataFrame) -> DataFrame:
    """One row per chunk row: its place, size, layout, head and sketch."""
    schema = "workspace_id string, path string, id string, size int, print long, form long, regular boolean, coded boolean, literal float, space float, line float, start int, whole boolean, heads array<struct<words:array<string>,made:boolean,foreign:boolean,place:int>>, sketch array<int>"
    head_type = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("made", pa.bool_()), ("foreign", pa.bool_()), ("place", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            laid = [layout(t) for t in texts]
            prose = [bool(_PROSE.search(path)) for path in batch.column(1).to_pylist()]
            for document, x in zip(prose, laid, strict=True):
                x["regular"] &= not document
                x["coded"] &= not document
            edges = [head_lines(*x) for x in zip(texts, firsts, prose, strict=True)]
            heads = [[dict(zip(("words", "made", "foreign", "place"), x, strict=True)) for x in lines] for lines, _ in edges]
            sketches = [minhash(x["mask"]) for x in laid]
            flat = np.concatenate(sketches) if sketches else np.zeros(0, dtype=np.int32)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BINS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(list(map(len, texts)), pa.int32()), *(pa.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in x], pa.int64()) for x in (texts, [x["mask"] for x in laid])),
                    *(pa.array([x[k] for x in laid], pa.bool_()) for k in ("regular", "coded")),
                    *(pa.array([x[k] for x in laid], pa.float32()) for k in ("literal", "space", "line")),
                    pa.array([1 if x is None else x for x in firsts], pa.int32()), pa.array([x for _, x in edges], pa.bool_()), pa.array(heads, head_type), pa.ListArray.from_arrays(ends, pa.array(flat)),
                ],
                names=["workspace_id", "path", "id", "size", "print", "form", "regular", "coded", "literal", "space", "line", "start", "whole", "heads", "sketch"],
            )

    rows = chunks.where("content is not null and content != '' and path is not null")
    return rows.select("workspace_id", "path", F.col("id").cast("string").alias("id"), F.col("start_line").cast("int").alias("start_line"), "content").mapInArrow(read, schema)


def third_party(path: Column) -> Column:
    """Whether a folder of the path holds third parties' files."""
    return F.arrays_overlap(F.split(F.lower(F.translate(path, "\\", "/")), "/"), F.array(*map(F.lit, THIRD_PARTY)))


def told_families(said: DataFrame) -> DataFrame:
    """workspace_id and path of files whose comments at the edges are of a family that tells of origin, with made or foreign.

    ``said`` has workspace_id, path, line (unique), words (array), and the labels made and foreign
    of the file. All counts are of files, over the whole corpus.
    """
    from corpusmith.session import materialize

    placed = said.select("workspace_id", "path", "line", "made", "foreign", F.posexplode("words").alias("at", "word"))
    enough = [
        ((F.col(f"{k}_files") >= TELLING) & (F.col(f"{k}_spaces") >= TELLING_SPACES) & (F.col(f"{k}_files") >= share * F.col("files"))).alias(k)
        for k, share in (("made", TELLING_SHARE), ("foreign", 2 * TELLING_SHARE))
    ]

    def counted(rows: DataFrame, key: str) -> DataFrame:
        once = rows.groupBy(key, "workspace_id", "path").agg(F.max("made").alias("made"), F.max("foreign").alias("foreign"))
        by_space = once.groupBy(key, "workspace_id").agg(F.count("*").alias("n"), F.count_if("made").alias("m"), F.count_if("foreign").alias("f"))
        sums = by_space.groupBy(key).agg(
            F.sum("n").alias("files"), F.sum("m").alias("made_files"), F.sum("f").alias("foreign_files"), F.count_if(F.col("m") > 0).alias("made_spaces"), F.count_if(F.col("f") > 0).alias("foreign_spaces"),
        )
        return sums.select(key, *enough).where("made or foreign")

    telling = counted(placed, "word").select("word")
    keyed = placed.join(telling, "word", "left_semi").groupBy("workspace_id", "path", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("key"), F.max("made").alias("made"), F.max("foreign").alias("foreign")
    )
    keyed = materialize(keyed, "keyed")
    families = counted(keyed, "key").withColumnRenamed("made", "family_made").withColumnRenamed("foreign", "family_foreign")
    return keyed.join(families, "key").groupBy("workspace_id", "path").agg(F.max("family_made").alias("family_made"), F.max("family_foreign").alias("family_foreign"))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows in the order of their first one, in parts that no key goes on from; lists are rows of BINS values."""
    held: list[list[np.ndarray]] = []
    whole = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.flatten().to_numpy().reshape(-1, BINS) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns])
        if held[-1][0][-1] != held[0][0][0]:  # the last key may go on
            parts = whole()
            begun = np.searchsorted(parts[0], parts[0][-1])
            yield [x[:begun] for x in parts]
            held = [[x[begun:] for x in parts]]
    if held:
        yield whole()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, code), in order, whose key another has."""
    for keys, codes in _buckets(batches):
        again = keys[1:] == keys[:-1]
        kept = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(codes[kept])], names=["key", "code"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """head and code of sketches that agree, of rows (key, code, sketch) in order.

    In each bucket the first sketch that agrees with no representative becomes one, until all are
    done. One that only agrees with such as others represent gets these as its family, so that none
    which agrees with another is left by itself.
    """

    def families(codes: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        left = np.ones(len(codes), dtype=bool)
        for i in range(len(codes)):
            if left[i]:
                alike = np.count_nonzero(sketches == sketches[i], axis=1) >= SIMILAR * BINS
                own = alike & left
                left &= ~alike
                if np.count_nonzero(alike) > 1:
                    yield codes[i], codes[own if np.count_nonzero(own) > 1 else alike]

    for keys, codes, sketches in _buckets(batches):
        ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        found = [x for lo, hi in zip(ends, ends[1:], strict=False) if hi - lo > 1 for x in families(codes[lo:hi], sketches[lo:hi])]
        heads = np.repeat(np.array([h for h, _ in found], dtype=np.int64), [len(m) for _, m in found])
        yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(np.concatenate([m for _, m in found]) if found else heads)], names=["head", "code"])


def mask_families(table: DataFrame) -> DataFrame:
    """code and family (what is the mean of its chunks) of each sketch of chunks (code, regular, literal, space, line, sketch): the largest of the families that it is in.

    A family is a sketch with all that agree with it in SIMILAR of the values, for those that
    :func:`_led` chooses, and each sketch's own chunks. Sketches that agree differ in at most six
    values, so at least two of their bands are the same, and all of them meet under some pair of bands.
    """
    from corpusmith.session import materialize

    kinds, width = ("regular", "literal", "space", "line"), BINS // BANDS
    masks = materialize(table.groupBy("code").agg(F.first("sketch").alias("sketch"), F.count("*").alias("n"), *(F.sum(F.col(k).cast("int") if k == "regular" else F.col(k)).alias(k) for k in kinds)), "masks")
    band = [F.slice("sketch", b * width + 1, width) for b in range(BANDS)]
    pairs = F.array(*(F.xxhash64(F.lit(BANDS * a + b), band[a], band[b]) for b in range(BANDS) for a in range(b)))
    placed = masks.select(F.explode(pairs).alias("key"), "code").repartition("key").sortWithinPartitions("key")
    met = placed.mapInArrow(_met, "key long, code long").join(masks.select("code", "sketch"), "code").select("key", "code", "sketch")
    led = met.repartition("key").sortWithinPartitions("key", "code").mapInArrow(_led, "head long, code long")
    members = materialize(led.unionByName(masks.select(F.col("code").alias("head"), "code")).distinct(), "members")
    families = members.join(masks.drop("sketch"), "code").groupBy("head").agg(F.sum("n").alias("members"), *((F.sum(k) / F.sum("n")).alias(k) for k in kinds))
    return members.join(families, "head").groupBy("code").agg(F.max_by(F.struct(*kinds), F.struct("members", "head")).alias("family"))


def not_handwritten(files: DataFrame, chunks: DataFrame, lists: bool = True) -> DataFrame:
    """workspace_id, path and reason of the files (workspace_id, path) not written by hand in their workspace.

    ``chunks`` has workspace_id, path, id, start_line and content. The reason is third_party,
    copied, generated, data or minified; the first of these that holds. A file counts as generated,
    data or minified if at least SHARE of its characters lie in chunks of families of these kinds;
    a chunk that is like no other is a family of its own. Without ``lists``, neither folders nor
    statements of origin count, and only what families tell is left. Repeated rows count once;
    files without chunks are judged by their path.
    """
    from corpusmith.session import materialize

    table = materialize(features(chunks).dropDuplicates(["id"]).withColumn("code", F.xxhash64("sketch")), "features")
    # masks of many different contents in one workspace; copies of one content count once
    forms = table.where("coded").select("workspace_id", "form", "print").distinct().groupBy("workspace_id", "form").count().where(F.col("count") >= DEALT).select("workspace_id", "form", F.lit(True).alias("dealt"))
    known = table.drop("sketch", "heads", "start", "whole", "print").join(mask_families(table), "code", "left").join(forms, ["workspace_id", "form"], "left")
    of = lambda c, own: F.coalesce(F.col(f"family.{c}"), own)
    regular = of("regular", F.col("regular").cast("int"))
    kind = (
        F.when((F.least(of("space", F.col("space")), F.col("space")) < SPACE) & (F.col("line") >= LONG) & (F.col("size") >= 200), "minified")
        .when((of("literal", F.col("literal")) >= LITERAL) & ((regular >= 0.5) | F.col("regular")), "data")
        .when((regular >= 0.5) & F.col("regular") | (regular >= 0.9) | F.col("coded") & F.col("dealt"), "generated")
    )
    judged = known.select("workspace_id", "path", "size", kind.alias("kind"))
    share = lambda k: F.sum(F.when(F.col("kind").isin(*k), F.col("size")).otherwise(0)) / F.sum("size")
    by_file = judged.groupBy("workspace_id", "path").agg(
        share(["minified"]).alias("minified"), share(["data"]).alias("data"), share(["minified", "data", "generated"]).alias("any"),
    )
    by_file = materialize(by_file, "judged")
    # a file's opening comments go on over chunks that are nothing else, and so do its closing ones
    code = F.when(~F.col("whole"), F.col("start"))
    bounds = table.groupBy("workspace_id", "path").agg(F.min(code).alias("begun"), F.max(code).alias("ended"))
    at_edge = (
        (F.col("place").bitwiseAND(FIRST) != 0)
        | (F.col("place").bitwiseAND(OPENING) != 0) & (F.col("start") <= F.coalesce("begun", "start"))
        | (F.col("place").bitwiseAND(CLOSING) != 0) & (F.col("start") >= F.coalesce("ended", "start"))
    )
    lines = table.select("workspace_id", "path", "start", "id", F.posexplode("heads").alias("n", "h")).select("workspace_id", "path", "start", F.struct("id", "n").alias("line"), "h.*")
    said = lines.join(bounds.join(by_file.select("workspace_id", "path", (F.col("any") >= SHARE).alias("decided")), ["workspace_id", "path"]), ["workspace_id", "path"]).where(at_edge)
    stated = said.select("workspace_id", "path", "line", "words", "decided", *(F.col(c) & F.lit(lists) for c in ("made", "foreign"))).toDF("workspace_id", "path", "line", "words", "decided", "made", "foreign")
    stated = materialize(stated, "stated")
    # labels are of files: what clusters decide or the file states, and for copies also its folder
    own = stated.groupBy("workspace_id", "path").agg(F.max("made").alias("made"), F.max("foreign").alias("foreign"))
    labels = own.select("workspace_id", "path", F.col("made").alias("own_made"), (F.col("foreign") | (third_party(F.col("path")) & F.lit(lists))).alias("own_foreign"))
    labelled = stated.select("workspace_id", "path", "line", "words", "decided").join(labels, ["workspace_id", "path"]).select(
        "workspace_id", "path", "line", "words", (F.col("decided") | F.col("own_made")).alias("made"), F.col("own_foreign").alias("foreign")
    )
    by_file = by_file.join(own, ["workspace_id", "path"], "left").join(told_families(labelled), ["workspace_id", "path"], "left")
    manifest = files.where("workspace_id is not null and path is not null").select("workspace_id", "path").distinct()
    reason = (
        F.when(third_party(F.col("path")) & F.lit(lists), "third_party")
        .when(F.col("foreign"), "copied")
        .when(F.col("made"), "generated")
        .when(F.col("minified") >= SHARE, "minified")
        .when(F.col("data") >= SHARE, "data")
        .when(F.col("any") >= SHARE, "generated")
        .when(F.col("family_made"), "generated")
        .when(F.col("family_foreign"), "copied")
    )
    return manifest.join(by_file, ["workspace_id", "path"], "left").select("workspace_id", "path", reason.alias("reason")).where("reason is not null")
