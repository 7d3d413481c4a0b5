"""Near-dedup by MinHash banding with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a signature (one byte per MinHash)
   and its band keys. Texts with equal sets are one class from here on, so a group
   of copies costs one row however large it is.
2. Classes that share a band key form a bucket. Instead of all pairs of a bucket,
   its members are compared with one hub; pairs are first compared signature batch
   by signature batch, and dropped as soon as the posterior probability of reaching
   the threshold falls below ``miss``; survivors are verified on their full sets.
   Verified links are joined into components. Further star rounds, if asked for, take
   other hubs and look only at buckets that still hold several components.
3. What is still open is compared completely: the members of such a bucket are dealt
   into blocks, pairs of blocks are compared and verified inside tasks, and only the
   links that join different components leave the task. So no link that shares a
   band is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskframe.llm.common import give_back, shuffle_partitions, ship_by_value
from riskframe.llm.components import connected_components
from riskframe.llm.shingles import Banding, at_least, intersection_size, shingle_set, survives, verification_steps
from riskframe.session import cut_lineage

ship_by_value(__name__)

#: Classes whose ids may be broadcast to fetch their texts (a row is under 40 bytes); beyond it the texts are joined by shuffle.
BROADCAST_CLASSES = 200_000


def sketches(docs: DataFrame, id_col: str, text_col: str, banding: Banding) -> DataFrame:
    """(id, node, n, sig, bands) per row; node is a 128-bit digest of the shingle set, NULL for an empty set."""
    @pandas_udf("node binary, n long, sig binary, bands array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        co = banding.coefficients()

        def one(text):
            s = shingle_set(text, banding.words)
            if not len(s):
                return None, 0, None, None
            sig, keys = banding.sketch(s, co)
            return xxhash.xxh3_128_digest(s.tobytes()), len(s), sig.tobytes(), keys

        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["node", "n", "sig", "bands"])
        give_back()

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("s")).select("id", "s.*")


def shared_bands(sketched: DataFrame) -> DataFrame:
    """(key, node): the classes' band keys that at least two classes share."""
    classes = sketched.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"))
    rows = classes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("key")
    return rows.join(shared, "key")


def class_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, shingles): the full sets of ``classes`` (node, id), made again from one document of each."""
    want = classes.select("node", "id")
    if want.count() <= BROADCAST_CLASSES:
        want = F.broadcast(want)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(want, F.col("d").eqNullSafe(F.col("id"))).select("node", "t")

    @pandas_udf("set binary, same boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for nodes, ts in batches:
            sets = [shingle_set(t, words).tobytes() for t in ts]
            yield pd.DataFrame({"set": sets, "same": [xxhash.xxh3_128_digest(s) == bytes(n) for s, n in zip(sets, nodes)]})
        give_back()

    # as if non-deterministic: else the filter would be pushed below and the sets be made twice
    made = texts.select("node", run.asNondeterministic()("node", "t").alias("r")).filter("r.same")
    return made.groupBy("node").agg(F.first("r.set").alias("shingles"))


def likely(pairs: DataFrame, sigs: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""
    @pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            width = len(x.iloc[0]) if len(x) else 1
            as_rows = lambda col: np.frombuffer(b"".join(col), np.uint8).reshape(-1, width)
            yield pd.Series(survives(as_rows(x), as_rows(y), steps))

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").filter(run("sa", "sb")).select("a", "b")


def linked(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
        return False
    inter = intersection_size(x, y)
    return at_least(numerator, denominator, inter, len(x) + len(y) - inter)


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) with denominator * |intersection| >= numerator * |union| on the full sets."""
    @pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), numerator, denominator) for p, q in zip(xs, ys)])
        give_back()

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    return pairs.join(left, "a").join(right, "b").filter(run("xa", "xb")).select("a", "b")


def open_buckets(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, comp) of the buckets that hold more than one component."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    now = members.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    return now.join(mixed, "key")


def star_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """(a, b, ca, cb): every member with its bucket's hub of this turn, if their components differ."""
    hubs = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("r"), "node", "comp")).alias("hub"))
    met = buckets.join(hubs, "key").filter(F.col("comp") != F.col("hub.comp"))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def block_links(buckets: DataFrame, classes: DataFrame, sets: DataFrame, steps: list[tuple[int, int]], numerator: int,
                denominator: int, block: int, block_bytes: int = 1 << 24) -> DataFrame:
    """(a, b): verified links between the components of open buckets, enough to join all that are linked.

    A bucket is dealt into blocks of at most about ``block`` members and ``block_bytes`` bytes of sets; every two
    blocks meet in one group. A pair that shares several bands is compared only where its first shared band is
    the group's. It is verified on the full sets inside the task, unless its components are joined already, so
    a task returns fewer links than it has components.
    """
    rows = buckets.join(classes.select("node", "n", "sig", "bands"), "node")
    sizes = rows.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / block_bytes)).cast("int").alias("nb"))
    rows = rows.drop("n").join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    rows = rows.select("key", "lo", "hi", "node", "comp", "i", "sig", "bands").join(sets, "node")

    def compare(key: int, group: list[tuple]) -> list[tuple[bytes, bytes]]:
        nodes, comps, blocks, sig, bands, full = zip(*group)
        m = np.frombuffer(b"".join(sig), np.uint8).reshape(len(nodes), -1)
        band = np.array(bands)
        here = int(np.flatnonzero(band[0] == key)[0])
        code = {x: k for k, x in enumerate(dict.fromkeys(comps))}
        root = list(range(len(code)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        c, blocks = np.array([code[x] for x in comps]), np.array(blocks)
        apart, found = blocks.min() != blocks.max(), []
        for k in range(len(nodes) - 1):
            other = np.arange(k + 1, len(nodes))
            other = other[c[other] != c[k]]
            if apart:
                other = other[blocks[other] != blocks[k]]
            if here and len(other):
                other = other[~(band[other, :here] == band[k, :here]).any(axis=1)]
            if not len(other):
                continue
            other = other[survives(np.broadcast_to(m[k], (len(other), m.shape[1])), m[other], steps)]
            x = np.frombuffer(full[k], np.uint64)
            for o in other[np.argsort(-(m[other] == m[k]).sum(axis=1), kind="stable")]:
                a, b = find(c[k]), find(c[o])
                if a != b and linked(x, np.frombuffer(full[o], np.uint64), numerator, denominator):
                    root[a] = b
                    found.append((min(nodes[k], nodes[o]), max(nodes[k], nodes[o])))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, group = None, []

        def done():
            return pd.DataFrame(compare(name[0], group) if len(group) > 1 else [], columns=["a", "b"])

        for batch in batches:
            for key, lo, hi, *member in zip(*(batch[c] for c in ("key", "lo", "hi", "node", "comp", "i", "sig", "bands", "shingles"))):
                if (key, lo, hi) != name:
                    if group:
                        yield done()
                    name, group = (key, lo, hi), []
                group.append((bytes(member[0]), bytes(member[1]), *member[2:]))
        if group:
            yield done()
        group.clear()
        give_back()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInPandas(run, "a binary, b binary").distinct()


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """New (node, component) table after adding verified links; a component is its smallest node."""
    if labels is None:
        return cut_lineage(connected_components(links))
    name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias("c" + c))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = connected_components(cut_lineage(between))
    step = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(labels, "node", "left_anti")
    return cut_lineage(old.union(new))


def link_classes(docs: DataFrame, sketched: DataFrame, id_col: str, text_col: str, banding: Banding, numerator: int, denominator: int,
                 batch: int, miss: float, star_rounds: int, block: int) -> DataFrame | None:
    """(node, component) of all classes that link to another one; None without any candidate."""
    members = cut_lineage(shared_bands(sketched))
    active = members.select("node").distinct()
    sigs = cut_lineage(sketched.join(active, "node", "left_semi").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    sets = cut_lineage(class_sets(docs, sigs, id_col, text_col, banding.words))
    steps = verification_steps(banding.hashes, batch, numerator / denominator, miss)
    labels = None
    for turn in range(star_rounds + 1):
        buckets = cut_lineage(open_buckets(members, labels))
        if buckets.isEmpty():
            break
        if turn < star_rounds:
            links = verified(likely(star_pairs(buckets, turn), sigs, steps), sets, numerator, denominator)
        else:
            links = block_links(buckets, sigs, sets, steps, numerator, denominator, block)
        links = cut_lineage(links)
        if not links.isEmpty():
            labels = _merge(labels, links)
    return labels


def label_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, numerator: int = 80,
                      denominator: int = 100, bands: int = 30, rows: int = 5, batch: int = 30, miss: float = 1e-6,
                      star_rounds: int = 1, block: int = 1024) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Two texts are linked when denominator * |intersection| >= numerator * |union| of their shingle sets.
    A pair at similarity J shares a band with probability 1 - (1 - J^rows)^bands (0.8, 30 x 5: all but 7 in
    a million); a true pair fails the sequential test with probability ``miss`` per batch at most.

    * NULL, empty and wordless texts have an empty set and link with nothing: each is its own component.
    * A text with fewer than ``words`` words is one shingle.
    * Copies and repeated rows are one class and get one component. NULL ids never name a component; if a
      component has no id at all, component_id is NULL and its rows are kept.
    * Other columns of ``docs`` are ignored, whatever their names; an empty table gives no rows.
    """
    banding = Banding(words, bands, rows)
    sketched = cut_lineage(sketches(docs, id_col, text_col, banding))
    labels = link_classes(docs, sketched, id_col, text_col, banding, numerator, denominator, batch, miss, star_rounds, block)
    slim = sketched.select("id", "node", "n")
    if labels is None:
        slim = slim.withColumn("comp", F.col("node"))
    else:
        slim = slim.join(labels, "node", "left").select("id", "node", "n", F.coalesce("component", "node").alias("comp"))
    least = slim.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("id").alias("cid"))
    out = slim.join(least, "comp", "left")
    cid = F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("cid"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), cid.alias("component_id"),
                      F.col("id").eqNullSafe(cid).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (same columns) whose id names their component. Rows that share an id stay if one of them does."""
    stay = label_near_copies(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col("__stay")), "left_semi")
