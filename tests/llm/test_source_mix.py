import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskframe.llm import source_mix as S


def test_less_than_one_block_from_target(docs_of):
    sizes = {"a": 700, "b": 90, "c": 30, "d": 5, None: 40}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "t", "en", s))
            i += 1
    got = S.mix_sources(docs_of(rows, clash=True), block_rows=1, period=100).collect()
    assert len(got) == len(rows)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert len({r.mix_slot for r in got}) == len(got)
    period = S.one_period(S.quotas(docs_of(rows).selectExpr("coalesce('s' || source, 'n') as __ms"), None, 0.5, 100)).collect()
    share = {r["__ms"]: Fraction(r["__mq"], r["__mlen"]) for r in period}
    assert sorted(r["__mslot"] for r in period) == list(range(period[0]["__mlen"]))
    total = math.fsum(math.sqrt(n) for n in sizes.values())
    for s, n in sizes.items():
        assert abs(float(share["n" if s is None else "s" + s]) - math.sqrt(n) / total) < 0.02
    by_slot = {r.mix_slot: "n" if r.source is None else "s" + r.source for r in got}
    first_out = min(max(t for t, s in by_slot.items() if s == x) for x in share)
    done = dict.fromkeys(share, 0)
    for t in range(first_out):
        done[by_slot[t]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in share.items())


def test_weights_blocks_and_order(docs_of):
    rows = [(i, "t", "en", "big" if i % 4 else "small") for i in range(400)]
    df = docs_of(rows)
    got = S.mix_sources(df, weights={"small": 0.5, "big": 0.5, "unused": 0.0}, block_rows=10, period=10)
    head = [r.source for r in got.orderBy("mix_slot", "mix_offset").limit(200).collect()]
    assert head.count("small") == 100
    out = S.in_mix_order(docs_of(rows, clash=True), weights={"small": 0.5}, block_rows=10, period=10)
    assert out.columns == docs_of([], clash=True).columns and out.count() == 400  # a source without weight loses nothing


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    rows = [(None, None, None, None)] * 3 + [(1, "a", "en", "s")] * 5
    assert S.mix_sources(docs_of(rows), block_rows=2).count() == 8
    assert S.mix_sources(docs_of([])).count() == 0
    assert S.in_mix_order(docs_of([])).count() == 0


def shares(spark, weights_of):
    """{source: (share of the schedule, its slots)} of one period for {source: rows}."""
    rows = spark.createDataFrame([(s, n) for s, n in weights_of.items()], "__ms string, n int").selectExpr("explode(array_repeat(__ms, n)) as __ms")
    got = S.one_period(S.quotas(rows, None, 1.0, 1000)).collect()
    length = got[0]["__mlen"]
    assert sorted(r["__mslot"] for r in got) == list(range(length))
    slots = {}
    for r in got:
        slots.setdefault(r["__ms"], []).append((r["__mslot"], r["__mj"], r["__mq"]))
    return length, slots


def test_two_thousand_sources_and_a_hot_one_keep_their_weights(spark):
    sizes = {f"s{i:04}": 2 if i % 2 else 3 for i in range(2000)} | {"hot": 2500}
    length, slots = shares(spark, sizes)
    total = sum(sizes.values())
    for s, n in sizes.items():
        q = len(slots[s])
        assert abs(q / length - n / total) <= 0.06 * n / total
        # less than one block from the weight after every slot
        for t, j, quota in slots[s]:
            assert quota == q and j * length <= (t + 1) * q + q and -1 < Fraction(q * (t + 1), length) - (j + 1) < 1
            assert -1 < Fraction(q * t, length) - j < 1


def test_tiny_weights_keep_their_ratio(docs_of):
    rows = [(i, "t", "en", "abcd"[i % 4]) for i in range(40)]
    quota = S.quotas(docs_of(rows).selectExpr("'s' || source as __ms"), {"a": 0.9999, "b": 0.00005, "c": 0.00005, "d": 0.0}, 0.5, 1000).collect()
    share = {r["__ms"]: r["__mq"] / r["__mlen"] for r in quota}
    assert abs(share["sa"] - 0.9999) < 1e-4 and abs(share["sb"] - 0.00005) < 0.000003 and share["sb"] == share["sc"] and share["sd"] < 0.00001


def test_a_hundred_thousand_sources(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("concat('s', id) as __ms").unionByName(spark.range(n // 9).selectExpr("'hot' as __ms"))
    got = S.one_period(S.quotas(rows, None, 1.0, 1000)).groupBy((F.col("__ms") == "hot").alias("hot")).agg(
        F.count("*").alias("blocks"), F.count_distinct("__ms").alias("sources"), F.max("__mlen").alias("length"), F.count_distinct("__mslot").alias("slots"),
        F.max("__mq").alias("most"), F.min("__mq").alias("least")).collect()
    by = {r.hot: r for r in got}
    assert by[True].blocks + by[False].blocks == by[True].length and by[False].sources == n and by[True].slots == by[True].blocks
    assert abs(by[True].blocks / by[True].length - 0.1) < 1e-3 and by[False].most == by[False].least


def test_a_schedule_beyond_the_bound_is_refused(docs_of, monkeypatch):
    monkeypatch.setattr(S, "MOST_STEPS", 1000)
    with pytest.raises(ValueError, match="too long"):
        S.mix_sources(docs_of([(i, "t", "en", "ab"[i % 3 > 0]) for i in range(30)]))
