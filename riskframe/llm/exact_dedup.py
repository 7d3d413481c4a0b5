"""Exact dedup: 128-bit content hash, byte comparison inside hash groups, one row stays.

Rows are grouped by (128-bit hash, whole normalised text). The hash spreads the
rows, and the text in the key is the byte comparison: two texts that share a
hash but differ fall into two classes. Grouping is partially aggregated before
the shuffle, so a text held by a third of all rows costs one row per map task.
Only when some hash really holds several texts are rows matched to classes by
(hash, text); otherwise the hash alone is proven to name the class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower
from riskframe.session import cut_lineage


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _classes(rows: DataFrame, keep: str, text_is_key: bool) -> DataFrame:
    pick = F.max if keep == "largest" else F.min
    groups = rows.groupBy("__xh", "__xt").agg(pick("__xid").alias("__xkeep"), F.count(F.lit(1)).alias("__xn"))
    if text_is_key:
        return groups
    return groups.groupBy("__xh").agg(
        pick("__xkeep").alias("__xkeep"), F.sum("__xn").alias("__xn"), F.count(F.lit(1)).alias("__xclasses"))


def _match(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, hash_fn):
    """(rows with __xh/__xt/__xid, class table, join keys)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumns({"__xt": norm, "__xid": F.col(id_col)}).withColumn("__xh", hash_fn(F.col("__xt")))
    one = cut_lineage(_classes(rows.select("__xh", "__xt", "__xid"), keep, False))
    if one.filter(F.col("__xclasses") > 1).isEmpty():
        return rows, one, ["__xh"]
    return rows, _classes(rows.select("__xh", "__xt", "__xid"), keep, True), ["__xh", "__xt"]


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 normalise: Callable[[Column], Column] = ascii_lower,
                 hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are equal; ``keep_id`` is the
    smallest (or largest) id among them.

    * NULL text counts as empty; empty texts form one group.
    * NULL ids never win; a group without any id has a NULL keep_id and keeps its rows.
    * Repeated rows each get their own output row and count in group_size.
    * Other columns of ``docs`` are ignored, whatever their names; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows, classes, keys = _match(src, "__id", "__text", keep, normalise, hash_fn)
    slim = rows.select(*keys, "__xid", F.sha2(F.col("__xt").cast("binary"), 256).alias("text_sha256"))
    return slim.join(classes, keys).select(
        F.col("__xid").alias(id_col),
        F.col("__xkeep").alias("keep_id"),
        F.col("__xn").alias("group_size"),
        F.col("__xid").eqNullSafe(F.col("__xkeep")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                normalise: Callable[[Column], Column] = ascii_lower,
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs`` that stay (same columns): one per distinct normalised text.

    Rows join their class on (hash, id), which is unique per class, so no join
    key is hot. Rows repeated with the same id and text collapse to one.
    """
    rows, classes, keys = _match(docs, id_col, text_col, keep, normalise, hash_fn)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    on = [*keys, "__xk"]  # the id as a struct: equal where NULL, and one partitioning for the join and the last step
    kept = classes.select(*keys, F.struct(F.col("__xkeep").alias("id")).alias("__xk"))
    stay = rows.select(*cols, *keys, F.struct(F.col("__xid").alias("id")).alias("__xk")).join(kept, on, "left_semi")
    return stay.dropDuplicates(on).select(*cols)
