"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's rows are put in a stable pseudo-random order and cut into blocks
of ``block_rows``. A source with ``q`` of the period's ``h`` blocks has weight
``q / h``; its block k (from 0) may start at slot ``floor(k * h / q)`` (release)
and is due by slot ``ceil((k + 1) * h / q)`` (deadline). Earliest deadline first
over the released blocks fills every slot and meets every deadline, so after any
number of slots each source is less than one block away from its weight, while
no source has run out.

The windows repeat every ``h`` slots, so one period is scheduled and every block
finds its slot by arithmetic: cycle ``k div q`` times ``h`` plus the slot of block
``k mod q``. The period is long enough that the smallest weight gets ``FINEST``
blocks, whatever the number of sources. Sources of equal quota q are one class:
m of them share ``q * m`` blocks in turn, which keeps each of them less than one
block from its weight (the class is less than one block away, and turns share
that out). So the schedule is a fold over ``h`` slots of at most about
``sqrt(2 h)`` classes, independent of the rows; beyond ``MOST_STEPS`` slots times
classes it is refused with an error.

Row order uses a two-level rank (hash prefix bucket, then inside the bucket), so
a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

#: Blocks of a period that the smallest positive weight gets at least.
FINEST = 10
#: Slots times classes that a schedule may take; more is refused.
MOST_STEPS = 1_000_000_000


def _ranked(rows: DataFrame, prefix_digits: int) -> DataFrame:
    """Adds ``__mk``, the 0-based rank inside the source by (``__mh``, ``__mid``)."""
    rows = rows.withColumn("__mb", F.substring("__mh", 1, prefix_digits))
    sizes = rows.groupBy("__ms", "__mb").agg(F.count(F.lit(1)).alias("__mn"))
    before = Window.partitionBy("__ms").orderBy("__mb").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__ms", "__mb", F.coalesce(F.sum("__mn").over(before), F.lit(0)).alias("__mo"))
    inside = Window.partitionBy("__ms", "__mb").orderBy("__mh", "__mid")
    return rows.withColumn("__mr", F.row_number().over(inside)).join(starts, ["__ms", "__mb"]).withColumn(
        "__mk", F.col("__mo") + F.col("__mr") - 1).drop("__mb", "__mr", "__mo")


def quotas(rows: DataFrame, weights: dict[str, float] | None, alpha: float, period: int) -> DataFrame:
    """(source key, quota ``__mq`` of blocks per period, period length ``__mh_len``), one row per source.

    Without ``weights`` a source weighs rows ** alpha. A source missing from
    ``weights``, or with a weight of 0, still gets the smallest quota, 1, so that no row is lost.
    """
    sizes = rows.groupBy("__ms").agg(F.count(F.lit(1)).alias("__mn"))
    if weights is None:
        w: Column = F.pow(F.col("__mn").cast("double"), F.lit(float(alpha)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("__ms") == F.lit("s" + name), F.lit(float(value))).otherwise(w)
    sizes = sizes.withColumn("__mw", w)
    whole = sizes.agg(F.sum("__mw").alias("total"), F.min(F.when(F.col("__mw") > 0, F.col("__mw"))).alias("least"))
    total, least = whole.select("total").scalar(), whole.select("least").scalar()
    length = F.greatest(F.lit(period), F.ceil(F.lit(float(FINEST)) * total / least))  # NULL without a positive weight: the period as given
    q = F.greatest(F.lit(1), F.floor(length * F.col("__mw") / F.greatest(total, F.lit(1e-300)) + 0.5))
    quota = sizes.select("__ms", q.cast("long").alias("__mq"))
    return quota.withColumn("__mlen", quota.agg(F.sum("__mq")).scalar())


def one_period(quota: DataFrame) -> DataFrame:
    """Earliest-deadline-first schedule of one period: (source key, quota, length, block in period, slot)."""
    quota = cut_lineage(quota)  # one row per source
    classes = quota.groupBy("__mq").agg(F.min("__ms").alias("__first"), F.count(F.lit(1)).alias("__mm"), F.max("__mlen").alias("__mlen"))
    size = classes.agg(F.count(F.lit(1)).alias("classes"), F.max("__mlen").alias("slots")).first()
    if size.classes * (size.slots or 0) > MOST_STEPS:
        raise ValueError(f"a period of {size.slots} slots for {size.classes} different weights is too long to schedule: round the weights or raise the smallest")
    part = max(1, int((size.slots or 0) ** 0.5))  # slots are written in parts, so that no long array grows slot by slot
    table = classes.agg(F.array_sort(F.collect_list(F.struct("__first", "__mq", "__mm"))).alias("__ss"), F.max("__mlen").alias("__mlen")).filter(F.size("__ss") > 0)
    table = table.withColumn("__qs", F.transform("__ss", lambda x: x["__mq"] * x["__mm"]))

    def step(state, slot):
        due = F.transform(
            F.arrays_zip(F.col("__qs").alias("q"), state["next"].alias("k")),
            lambda x, i: F.when(
                F.floor(x["k"] * F.col("__mlen") / x["q"]) <= slot,
                F.struct(F.ceil((x["k"] + 1) * F.col("__mlen") / x["q"]).alias("d"), i.alias("i"))))
        pick = F.array_min(due)["i"]
        return F.transform(F.array(pick), lambda p: F.struct(
            F.transform(state["next"], lambda k, i: F.when(i == p, k + 1).otherwise(k)).alias("next"),
            F.concat(state["out"], F.array(p)).alias("out")))[0]

    def steps(state, first):
        slots = F.sequence(first, F.least(first + part, F.col("__mlen")) - 1)
        fresh = F.struct(state["next"].alias("next"), F.array().cast("array<int>").alias("out"))
        done = F.aggregate(slots, fresh, step)
        return F.transform(F.array(done), lambda d: F.struct(d["next"].alias("next"), F.concat(state["out"], F.array(d["out"])).alias("out")))[0]

    start = F.struct(F.transform("__ss", lambda s: F.lit(0).cast("long")).alias("next"),
                     F.array().cast("array<array<int>>").alias("out"))
    plan = table.select("__ss", F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("__mlen") - 1, F.lit(part).cast("long")), start, steps, lambda s: s["out"]).alias("__mout"))
    parts = plan.select("__ss", F.posexplode("__mout").alias("__mpart", "__mis"))
    slots = parts.select("__ss", "__mpart", F.posexplode("__mis").alias("__min", "__mi")).select(
        F.col("__ss")[F.col("__mi")].alias("__s"), (F.col("__mpart").cast("long") * part + F.col("__min")).alias("__mslot"))
    own = Window.partitionBy("__s").orderBy("__mslot")
    turns = slots.select(F.col("__s.__mq").alias("__mq"), F.col("__s.__mm").alias("__mm"), "__mslot", (F.row_number().over(own) - 1).cast("long").alias("__mb"))
    turns = turns.select("__mq", "__mslot", F.expr("__mb div __mm").alias("__mj"), (F.col("__mb") % F.col("__mm")).alias("__mturn"))
    members = quota.withColumn("__mturn", (F.row_number().over(Window.partitionBy("__mq").orderBy("__ms")) - 1).cast("long"))
    return turns.join(members, ["__mq", "__mturn"]).select("__ms", "__mq", "__mlen", "__mslot", "__mj")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                weights: dict[str, float] | None = None, alpha: float = 0.5, block_rows: int = 64,
                period: int = 1000, prefix_digits: int = 3) -> DataFrame:
    """``docs`` plus mix_block, mix_release, mix_deadline, mix_slot, mix_offset (all rows stay).

    Sorting by (mix_slot, mix_offset) gives the mix. ``weights`` maps source
    names to target weights; by default a source weighs rows ** alpha. Weights
    are rounded to ``period`` parts, or to as many as give the smallest one ``FINEST`` of them. Once a source has run out, its slots stay
    empty and the others keep their order.

    * A NULL source is a source of its own; NULL ids are ordinary rows, ordered first.
    * Rows with equal ids (repeated rows) lie side by side; an empty table gives no rows.
    * Helper columns have the prefix ``__m``, so that other columns may have any name; existing
      columns named like an added one are replaced.
    """
    added = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")
    keep = [c for c in docs.columns if c not in added]
    rows = docs.withColumns({
        "__ms": F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string"))),
        "__mid": F.col(id_col),
        "__mh": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
    })
    period_plan = cut_lineage(one_period(quotas(rows.select("__ms"), weights, alpha, period)))
    quota = period_plan.select("__ms", "__mq", "__mlen").distinct()
    k = _ranked(rows, prefix_digits).join(quota, "__ms")
    k = k.withColumn("mix_block", F.floor(F.col("__mk") / F.lit(block_rows)).cast("long"))
    k = k.withColumn("__mj", F.col("mix_block") % F.col("__mq"))
    placed = k.join(period_plan.select("__ms", "__mj", "__mslot"), ["__ms", "__mj"])
    return placed.select(
        *[F.col(f"`{c}`") for c in keep],
        "mix_block",
        F.expr("(mix_block * __mlen) div __mq").alias("mix_release"),
        F.expr("((mix_block + 1) * __mlen + __mq - 1) div __mq").alias("mix_deadline"),
        F.expr("(mix_block div __mq) * __mlen + __mslot").alias("mix_slot"),
        (F.col("__mk") % F.lit(block_rows)).cast("int").alias("mix_offset"),
    )


def in_mix_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` (same columns, all rows), sorted into the mix."""
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"))
    return mix_sources(rows, "__id", "__source", **options).orderBy("mix_slot", "mix_offset").select("__row.*")
