"""Source divergence audit: how far the word use of each source of a language lies from the others.

One ``CountVectorizer`` fit with ``minDF`` and the largest integer ``vocabSize`` learns the vocabularies of all
languages together: every term carries its language, so document frequencies, and with them the kept terms, are per
language. Texts are cut into terms batch by batch in Arrow; the fit gets each document's distinct terms, the vectors are made of
all terms that a batch has of one (language, source), and are summed per (language, source) as sparse (term, count) rows. Pairs of sources
are then evaluated in blocks: sources of a language in blocks of about ``BLOCK_SOURCES``, kept terms in blocks of about
``BLOCK_TERMS``; a task holds one block pair for one term block as a small matrix and returns one number per pair.

A fit brings its vocabulary to the driver and to every executor. A kept term is in at least ``minDF`` documents, so a
sample of the documents holds most kept terms, and the number of distinct terms in it bounds the number of kept ones from
above. From that estimate the terms are split by hash into as many fits as keep each below ``max_terms``; results do
not depend on it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import LOWER, UPPER, give_back, ship_by_value
from riskframe.session import cut_lineage

ship_by_value(__name__)

#: In UTF-8, A-Z becomes a-z and every other ASCII character but a-z a blank.
LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b) in UPPER + LOWER else 32 for b in range(256))
TAG = "\0"  # cannot occur in a term
SAMPLED = 1 / 16
MOST_WORDS = 2**31 - 1
SCALE = 1_000_000_000
PRIOR = 5
BLOCK_SOURCES = 64
BLOCK_TERMS = 4096
EMPTY_VOCABULARY = "vocabulary size should be > 0"


def term_rows(rows: DataFrame, distinct: bool) -> DataFrame:
    """(lang, source, terms) of lang, source, text; a term is a maximal run of letters (every character beyond ASCII counts as one), A-Z lower-cased,
    after the language in hex and ``TAG``.

    ``distinct``: a row a document, each of its terms once, as document frequencies ask. Otherwise all occurrences, the documents that one
    Arrow batch has of a (lang, source) in one row, as sums ask.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined: dict[tuple, list[bytes]] = {}
            held: Counter = Counter()
            columns = batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()
            for i, (lang, source, text) in enumerate(zip(*columns)):
                words = text.translate(LETTERS).split()
                words, key = (dict.fromkeys(words), (lang, source, i)) if distinct else (words, (lang, source))
                parts = joined.setdefault(key, [])
                if words:
                    held[key] += len(words)
                    tag = (lang.encode().hex() + TAG).encode()
                    parts.append(tag + (b" " + tag).join(words))
            whole = b" ".join(x for parts in joined.values() for x in parts)
            terms = pc.split_pattern(pa.array([whole], pa.binary()), b" ").flatten() if whole else pa.array([], pa.binary())
            ends = pa.array(np.cumsum([0, *(held[k] for k in joined)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in joined], pa.string()), pa.array([k[1] for k in joined], pa.string()),
                                              pa.ListArray.from_arrays(ends, terms.view(pa.string()))], ["lang", "source", "terms"])
        give_back()

    return rows.select("lang", "source", "text").mapInArrow(cut, "lang string, source string, terms array<string>")


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in whole numbers; NULL without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over, under = whole(F.lit(SCALE)) * (whole(n) + F.lit(PRIOR)), whole(total) + whole(kept) * F.lit(PRIOR)
    return F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(20,0)"))).cast("long") + F.lit(1)


def kept_counts(rows: DataFrame, min_df: int, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """((lang, term, term_id), (lang, source, term, term_id, n)) of the kept terms; ``rows``: lang, source, text, without NULLs."""
    spark = rows.sparkSession
    distinct = term_rows(rows.sample(SAMPLED, seed=1), True).select(F.explode("terms").alias("t")).agg(F.approx_count_distinct("t", 0.02)).first()[0]
    held = 1.0 - (1.0 - SAMPLED) ** min_df  # the share of the rarest kept terms that a sample holds
    fits = max(1, math.ceil(1.1 * distinct / held / max_terms))
    vocabulary, counts = spark.createDataFrame([], "lang string, term string, term_id long"), None
    for k in range(fits):
        sets, bags = term_rows(rows, True), term_rows(rows, False)
        if fits > 1:
            mine = F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(fits)) == k)
            sets, bags = sets.withColumn("terms", mine), bags.withColumn("terms", mine)
        try:
            model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(min_df), vocabSize=MOST_WORDS).fit(sets)
        except IllegalArgumentException as e:
            if EMPTY_VOCABULARY not in str(e):
                raise
            continue  # no term of this part is frequent enough
        words = pd.DataFrame({"i": np.arange(len(model.vocabulary), dtype=np.int32), "t": model.vocabulary})
        both = F.split("t", TAG)
        known = spark.createDataFrame(words, "i int, t string").select(
            "i", F.unhex(both[0]).cast("string").alias("lang"), both[1].alias("term"), (F.col("i").cast("long") * fits + k).alias("term_id"))
        vector = F.unwrap_udt("v")
        sums = model.transform(bags).select("lang", "source", F.explode(F.arrays_zip(vector.indices.alias("i"), vector["values"].alias("n"))).alias("e")) \
            .groupBy("lang", "source", F.col("e.i").alias("i")).agg(F.sum(F.col("e.n").cast("long")).alias("n"))
        sums = cut_lineage(sums)
        found = sums.join(known.select("i", "term", "term_id"), "i").select("lang", "source", "term", "term_id", "n")
        vocabulary = vocabulary.unionByName(known.drop("i"))
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, term string, term_id long, n long")
    return vocabulary, counts


def pair_distances(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of different sources of a language.

    ``sizes``: lang, source, total, kept, n_sources; ``counts``: lang, source, term_id, n. A pair's value is
    kept * |z_a - z_b| plus, over the terms that one of a task's sources holds, |p_a - p_b| - |z_a - z_b|, where z is
    the probability of a term that the source does not hold.
    """
    sizes = sizes.withColumns({
        "z": F.coalesce(probability(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)),
        "s_blocks": F.ceil(F.col("n_sources") / BLOCK_SOURCES).cast("int"),
        "t_blocks": F.greatest(F.ceil(F.col("kept") / BLOCK_TERMS), F.lit(1)).cast("int")})
    sizes = sizes.withColumn("own", F.pmod(F.xxhash64("source"), F.col("s_blocks")).cast("int"))
    marks = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("tb"), F.lit(-1).cast("long").alias("term_id"), F.col("z").alias("p"))
    held = counts.join(sizes, ["lang", "source"]).select(
        *sizes.columns, F.pmod(F.xxhash64("term_id"), F.col("t_blocks")).cast("int").alias("tb"), "term_id",
        probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    dealt = marks.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))).select(
        "lang", "tb", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "source", "z", "term_id", "p")

    def evaluate(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        lang, _, b1, b2 = key
        own = part[part.term_id < 0].sort_values("source")
        names = own["source"].to_numpy()
        z, block = own["z"].to_numpy(np.int64), own["own"].to_numpy()
        held = part[part.term_id >= 0]
        columns, at = np.unique(held["term_id"].to_numpy(), return_inverse=True)
        p = np.repeat(z[:, None], len(columns), axis=1)
        p[own["source"].searchsorted(held["source"]), at] = held["p"].to_numpy(np.int64)
        first, second, value = [], [], []
        for a in np.flatnonzero(block == b1):
            others = np.flatnonzero(block == b2)
            if b1 == b2:
                others = others[others > a]
            value.append(np.abs(p[others] - p[a]).sum(axis=1) - len(columns) * np.abs(z[others] - z[a]))
            first.append(np.full(len(others), a))
            second.append(others)
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (first, second))
        give_back()
        return pd.DataFrame({"lang": lang, "source": names[a], "item": names[b], "d": np.concatenate(value) if value else np.zeros(0, np.int64),
                             "far": np.abs(z[a] - z[b])})

    parts = dealt.groupBy("lang", "tb", "b1", "b2").applyInPandas(evaluate, "lang string, source string, item string, d long, far long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("d").alias("d"), F.max("far").alias("far"))
    kept = sizes.groupBy("lang").agg(F.max("kept").alias("kept"))
    one = sums.join(kept, "lang").select("lang", "source", "item", (F.col("d") + F.col("kept") * F.col("far")).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return one.select("lang", both.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_df: int = 30,
                  top_terms: int = 50, max_terms: int = 2_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources, and the terms used more than in the language.

    Part ``pair`` lists every other source of the language; part ``term`` the first ``top_terms`` kept terms with a
    larger share than in the whole language. Ranks go by value descending, then item in UTF-8 order.

    * NULL text, language and source count as ''; '' is a language and a source like any other.
    * Empty texts have no terms, but their (language, source) is a group; where a language keeps no term, distances are 0.
    * Very long texts and repeated rows count in full: each row is one document. An empty table gives no rows; columns
      other than the three are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    vocabulary, counts = kept_counts(rows, min_df, max_terms)
    counts = cut_lineage(counts)
    groups = rows.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(
        totals.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang", "left").join(kept, "lang", "left")
    sizes = cut_lineage(groups.join(totals, ["lang", "source"], "left").join(per_lang, "lang").na.fill(0))

    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(counts, sizes.select("lang", "source", "total", "kept", "n_sources")).withColumn("rank", rank())
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = counts.join(in_lang, ["lang", "term"]).join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")) \
        .filter(F.col("value") > 0).withColumn("rank", rank()).filter(F.col("rank") <= top_terms)
    order = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return order(pairs, "pair").unionByName(order(terms, "term"))
