"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs' 64-bit digests; with ``finer`` cuts, repeats
are salted with their occurrence number. A sketch has three
sub-tables; each digest falls into one cell of each, and a cell holds the count,
the XOR of its digests and the XOR of their checksums. Subtracting two sketches
cancels what both texts share; peeling then recovers the differing digests, one
pure cell (count +-1, checksum fits) after another.

Every fingerprint has the same small size. When a difference does not peel, it is
retried larger: the digests are dealt by their own bits into blocks of a few
digests, every block gets a sketch, and blocks that still fail get a larger one.
Work stays proportional to the number of paragraphs, so long texts need no cap.

All of it is SQL expressions over arrays; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import shuffle_partitions
from riskframe.operators.windowing import _rank_value, search_sorted

#: A paragraph is a line; a line longer than this is cut after the next '. ', with ``finer`` cuts also at other places of its content.
LONG_LINE = 120
#: Sentence ends of several scripts.
SENTENCE_END = r"\. |[!?\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u2026]"
#: Cells per sub-table of the fingerprint, of a retried block, and of that block's own retries.
BASE, BLOCK_SIZES = 8, (4, 16, 64)
CELL = "struct<n:int,k:bigint,h:bigint>"
KEY = "struct<d:bigint,s:int>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _check(d: Column) -> Column:
    return F.xxhash64(F.lit(7), d)


def _places(d: Column, c: int) -> Column:
    """The digest's cell in each of the three sub-tables of ``c`` cells."""
    return F.array(*[(F.shiftrightunsigned(d, 14 * t).bitwiseAND(F.lit(16383)) % F.lit(c) + F.lit(t * c)).cast("int") for t in range(3)])


def _numbered(digests: Column) -> Column:
    """The digests in order, the n-th repeat of one salted with n."""
    def runs(s):
        starts = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(x != F.get(s, i - 1), F.lit(True)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda st: F.flatten(F.transform(st, lambda i, r: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(st, r + 1), F.size(s)) - i - 1),
            lambda j: F.when(j == 0, F.get(s, i)).otherwise(F.xxhash64(F.get(s, i), j))))))

    return _let(F.array_sort(digests), runs)


def paragraphs(text: Column, long_line: int = LONG_LINE, finer: bool = False) -> Column:
    """Digests of the text's paragraphs (empty array for an empty text): distinct ones, or with ``finer`` all, repeats salted.

    With ``finer`` a longer line is cut after the first sentence end from ``long_line`` to twice that; where there is none, from half of it on after
    a character that comes again within six characters (a place that depends on the content only), at 1.5 times at the latest.
    """
    if not finer:
        parts = F.regexp_extract_all(text, F.lit(r"[^\n]{%d,}?\. |[^\n]+" % long_line), F.lit(0))
        return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))
    n, least, most = long_line, max(1, long_line // 2), long_line + long_line // 2
    pattern = (rf"[^\n]{{{n},{2 * n}}}?(?:{SENTENCE_END})|[^\n]{{1,{n}}}(?=\n|\z)"
               rf"|[^\n]{{{least},{most}}}?([^\n])(?=[^\n]{{0,5}}\1)|[^\n]{{1,{most}}}")
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _numbered(F.transform(parts, lambda p: F.xxhash64(p)))


def sketch(digests: Column, c: int = BASE) -> Column:
    """Sketch of ``3 * c`` cells (count, digest XOR, checksum XOR)."""
    keys = F.transform(digests, lambda d: F.struct(d.alias("d"), _check(d).alias("h"), _places(d, c).alias("at")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cell(ks, j):
        return F.aggregate(ks, zero, lambda a, x: F.when(F.array_contains(x["at"], j), F.struct(
            (a["n"] + 1).alias("n"), a["k"].bitwiseXOR(x["d"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))).otherwise(a))

    return _let(keys, lambda ks: F.transform(F.sequence(F.lit(0), F.lit(3 * c - 1)), lambda j: cell(ks, j)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(diff: Column, c: int) -> Column:
    """struct(cells left, found array of (digest, +1 only in the first / -1 only in the second), pure).

    Steps alternate: collect the digests of all pure cells, then take them out of every cell they are in.
    """

    def collect(state):
        pure = F.array_distinct(F.transform(
            F.filter(state["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"]))),
            lambda x: F.struct(x["k"].alias("d"), x["n"].alias("s"), x["h"].alias("h"), _places(x["k"], c).alias("at"))))
        return F.struct(state["cells"].alias("cells"), state["found"].alias("found"), pure.alias("pure"))

    def take_out(state):
        cells = F.transform(state["cells"], lambda x, j: F.aggregate(state["pure"], x, lambda a, p: F.when(
            F.array_contains(p["at"], j), F.struct((a["n"] - p["s"]).alias("n"), a["k"].bitwiseXOR(p["d"]).alias("k"),
                                                   a["h"].bitwiseXOR(p["h"]).alias("h"))).otherwise(a)))
        found = F.concat(state["found"], F.transform(state["pure"], lambda p: F.struct(p["d"].alias("d"), p["s"].alias("s"))))
        return F.struct(cells.alias("cells"), found.alias("found"), state["pure"].alias("pure"))

    def step(state, i):
        return F.when((i > 0) & (F.size(state["pure"]) == 0), state).when(i % 2 == 0, collect(state)).otherwise(take_out(state))

    start = F.struct(diff.alias("cells"), F.array().cast(f"array<{KEY}>").alias("found"),
                     F.array().cast("array<struct<d:bigint,s:int,h:bigint,at:array<int>>>").alias("pure"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(6 * c - 1)), start, step)


def _clean(cells: Column) -> Column:
    return F.forall(cells, lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["h"] == 0))


def _blocks(digests: Column, nb: Column) -> Column:
    """The digests dealt into ``nb`` arrays by their high bits (one sort, then slices)."""
    marks = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.struct(b.cast("int").alias("b"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("d")))
    keys = F.transform(digests, lambda d: F.struct(
        (F.shiftrightunsigned(d, 42) % nb).cast("int").alias("b"), F.lit(1).alias("r"), d.alias("d")))

    def cut(rows):
        starts = F.filter(F.transform(rows, lambda x, i: F.when(x["r"] == 0, i)), lambda i: i.isNotNull())
        return _let(starts, lambda st: F.transform(st, lambda s, b: F.slice(
            rows, s + 2, F.coalesce(F.get(st, b + 1), F.size(rows)) - s - 1)["d"]))

    return _let(F.array_sort(F.concat(marks, keys)), cut)


def _outcome(p: Column) -> Column:
    return F.struct(_clean(p["cells"]).alias("ok"), p["found"].alias("found"))


def add_difference(rows: DataFrame, out: str, digests_a: str, sketch_a: str, digests_b: str, sketch_b: str) -> DataFrame:
    """Adds ``out`` = struct(ok, found): digests only in one text, recovered from the sketches.

    A block whose largest sketch fails too is compared digest by digest, so ``found`` is always the whole difference;
    ``ok`` says that the sketches alone gave it.
    """
    none = F.array().cast("array<array<bigint>>")
    keep = rows.columns
    total = F.size(digests_a) + F.size(digests_b)
    nb = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(total, F.lit(4)) / 4))).cast("int")
    rows = rows.withColumn("__p", _let(peel(subtract(F.col(sketch_a), F.col(sketch_b)), BASE), _outcome)).withColumn("__nb", nb)
    blocks = lambda d: F.when(F.col("__p.ok"), none).otherwise(_blocks(F.col(d), F.col("__nb")))
    rows = rows.withColumns({"__x": blocks(digests_a), "__y": blocks(digests_b)})
    failed = F.struct(F.lit(False).alias("ok"), F.array().cast(f"array<{KEY}>").alias("found"))
    empty = F.struct(F.lit(True).alias("ok"), F.array().cast(f"array<{KEY}>").alias("found"))
    rows = rows.withColumn("__r", F.zip_with("__x", "__y", lambda x, y: F.when((F.size(x) == 0) & (F.size(y) == 0), empty).otherwise(failed)))
    for c in BLOCK_SIZES:
        rows = rows.withColumn("__r", F.transform("__r", lambda r, i: F.when(r["ok"], r).otherwise(_let(
            peel(subtract(sketch(F.col("__x")[i], c), sketch(F.col("__y")[i], c)), c), _outcome))))
    signed = lambda d, s: F.transform(d, lambda x: F.struct(x.alias("d"), F.lit(s).alias("s")))
    apart = lambda i: F.concat(signed(F.array_except(F.col("__x")[i], F.col("__y")[i]), 1), signed(F.array_except(F.col("__y")[i], F.col("__x")[i]), -1))
    whole = F.transform("__r", lambda r, i: F.when(r["ok"], r["found"]).otherwise(apart(i)))
    larger = F.struct(F.forall("__r", lambda r: r["ok"]).alias("ok"), F.flatten(whole).alias("found"))
    return rows.select(*keep, F.when(F.col("__p.ok"), F.col("__p")).otherwise(larger).alias(out))


def likeness(n_a: Column, n_b: Column, diff: Column) -> Column:
    """Jaccard likeness of the paragraph sets, from their sizes and the recovered difference; 1 for two empty texts."""
    d = F.size(diff["found"])
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - d) / (n_a + n_b + d))


def as_text(cells: Column) -> Column:
    """The fingerprint as a string: per cell count:digest XOR:checksum XOR in hex, comma-joined."""
    return F.array_join(F.transform(cells, lambda x: F.concat(
        x["n"].cast("string"), F.lit(":"), F.lower(F.hex(x["k"])), F.lit(":"), F.lower(F.hex(x["h"].bitwiseAND(F.lit(0xFFFFFFFF)))))), ",")


def with_next(docs: DataFrame, id_col: str, carried: list[str], rows_per_bucket: int = 10_000) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: the value of the next row by descending id, the last row's next being the first.

    Rows are dealt into id ranges, one window per range; the first row of a range
    is copied to the end of the range before it, so that no row's neighbour is
    missed and the texts move once. Ids that repeat are ordered by the carried
    columns' values. A NULL id has no place in the order: its next values are NULL.
    """
    spark = docs.sparkSession
    n = docs.count()
    buckets = int(min(65_536, max(8 * shuffle_partitions(spark), n // rows_per_bucket, 2)))
    levels = [i / buckets for i in range(1, buckets)]
    place = _rank_value(docs, id_col)  # grows with the id, whatever its type
    edges = docs.agg(F.percentile_approx(place, levels, 10 * buckets)).first()[0] or []
    edges = sorted(set(edges))
    b = search_sorted(place, F.array(*[F.lit(e) for e in edges]), len(edges)) if edges else F.lit(0)
    spread = F.lit(-1) - F.pmod(F.xxhash64(*[F.col(c) for c in carried]), F.lit(buckets)).cast("int")
    # first row (largest id) of each non-empty range, and the range that comes before it by descending id
    heads = docs.select(id_col).filter(F.col(id_col).isNotNull()).groupBy(b.alias("__nb")).agg(F.max(id_col).alias("__head"))
    down = Window.partitionBy().orderBy(F.col("__nb").desc())
    every = Window.partitionBy()
    heads = heads.select("__nb", "__head", F.coalesce(F.lag("__nb").over(down), F.min("__nb").over(every)).alias("__to"))
    rows = docs.withColumn("__nb", F.when(F.col(id_col).isNull(), spread).otherwise(b))
    rows = rows.join(F.broadcast(heads), "__nb", "left")  # at most 65,536 rows of three numbers
    own = F.struct(F.col("__nb").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("__to").alias("b"), F.lit(True).alias("copy"))
    rows = rows.withColumn("__in", F.explode(F.when(F.col(id_col) == F.col("__head"), F.array(own, copy)).otherwise(F.array(own))))
    w = Window.partitionBy("__in.b").orderBy(F.col("__in.copy"), F.col(id_col).desc_nulls_last(), *[F.col(c) for c in carried])
    rows = rows.withColumns({f"next_{c}": F.when(F.col(id_col).isNotNull(), F.lead(c).over(w)) for c in carried})
    return rows.filter(~F.col("__in.copy")).drop("__nb", "__head", "__to", "__in")


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", finer: bool = False) -> DataFrame:
    """One row per document: fingerprint of its text and of an edited version, and likenesses.

    ``finer`` cuts long lines without '. ' too and counts repeated paragraphs (see ``paragraphs``).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document by descending id; the last document's next is the first.

    Columns: id, n_chars, n_paragraphs, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_added and edited_removed (recovered digests, only in the edited / only in the
    original text), decoded (both differences came from the sketches alone).

    * NULL text is empty: no paragraphs, an all-zero fingerprint, likeness 1 with another empty text, else 0.
    * A NULL id has no next document: the edited text is cut, near_next compares with an empty text.
    * A single document is its own next; repeated ids are ordered by text; an empty table gives no rows.
    * Other columns of ``docs`` are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = with_next(base, "id", ["t"])
    n = F.length("t")
    rows = rows.select("id", "t", n.alias("n"), F.coalesce("next_t", F.lit("")).alias("next_t"))
    rows = rows.withColumn("e", F.concat(F.left("t", F.col("n") - F.floor(F.col("n") / 2).cast("int")),
                                         F.left("next_t", F.floor(F.col("n") / 2).cast("int"))))
    rows = rows.withColumns({"pt": paragraphs(F.col("t"), finer=finer), "pe": paragraphs(F.col("e"), finer=finer), "pn": paragraphs(F.col("next_t"), finer=finer),
                             "sha": F.sha2(F.col("e").cast("binary"), 256)})
    rows = rows.select("id", "n", "sha", "pt", "pe", "pn", sketch(F.col("pt")).alias("st"), sketch(F.col("pe")).alias("se"),
                       sketch(F.col("pn")).alias("sn"))
    rows = add_difference(rows, "de", "pt", "st", "pe", "se")
    rows = add_difference(rows, "dn", "pt", "st", "pn", "sn")
    side = lambda s: F.transform(F.filter(F.col("de.found"), lambda x: x["s"] == s), lambda x: x["d"])
    return rows.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.size("pt").alias("n_paragraphs"),
        F.col("sha").alias("edited_sha256"), as_text(F.col("st")).alias("fingerprint"), as_text(F.col("se")).alias("edited_fingerprint"),
        likeness(F.size("pt"), F.size("pe"), F.col("de")).alias("near_edited"),
        likeness(F.size("pt"), F.size("pn"), F.col("dn")).alias("near_next"),
        side(-1).alias("edited_added"), side(1).alias("edited_removed"),
        (F.col("de.ok") & F.col("dn.ok")).alias("decoded"))
