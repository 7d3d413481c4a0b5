import random
import re

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import minhash_dedup as M
from riskframe.llm import shingles as S
from riskframe.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num=80, den=100):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def family(rnd, size, words, edits, vocab):
    """A hot group: many edited copies of one text, at similarities around the threshold."""
    base = [rnd.choice(vocab) for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(words)] = rnd.choice(vocab)
        out.append(" ".join(w))
    return out


def test_equals_brute_force_with_a_hot_group(docs_of):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    texts = family(rnd, 220, 120, 14, vocab) + family(rnd, 40, 30, 4, vocab) + [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 200))) for _ in range(60)]
    texts += ["one", "ONE", "one two", None, "", " \t\n", " ", "Été été", "x " * 50_000, "a b " * 3, "a b a b"] + texts[:30]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    for k in (2, 5):
        got = M.label_near_copies(docs_of(rows, clash=True), words=k)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert result(got) == brute(rows, k)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_block_comparison_alone_finds_the_same_links(docs_of):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    rows = list(enumerate(family(rnd, 150, 100, 16, vocab)))
    assert result(M.label_near_copies(docs_of(rows), words=2, star_rounds=0, block=16)) == brute(rows, 2)


def test_null_and_repeated_ids(docs_of):
    rows = [(None, "a b c d"), (None, "q r"), (4, "a b c d"), (4, "a b c d"), (7, "a b c d")]
    got = M.label_near_copies(docs_of(rows), words=2)
    assert result(got) == brute(rows, 2)
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(None, 4, False), (None, None, True), (4, 4, True), (7, 4, False)}


def test_drop_keeps_columns_and_one_row_per_group(docs_of):
    rows = [(3, "a b c d e f"), (1, "A B C D E F"), (2, "z"), (5, None), (6, "")]
    df = docs_of(rows, clash=True)
    got = M.drop_near_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 6]
    assert M.drop_near_copies(docs_of([])).count() == 0 and M.label_near_copies(docs_of([])).count() == 0


def test_signature_agreement_estimates_similarity():
    rng, band = np.random.default_rng(1), S.Banding(2, 60, 5)
    co = band.coefficients()
    for j in (0.5, 0.8, 0.95):
        common, own = int(2000 * j), int(2000 * (1 - j) / 2)
        x = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
        a, _ = band.sketch(np.sort(np.concatenate([x[:common], x[common:common + own]])), co)
        b, _ = band.sketch(np.sort(np.concatenate([x[:common], x[common + own:]])), co)
        assert abs((a == b).mean() - (j + (1 - j) / 256)) < 0.09


def test_posterior_floor_is_the_beta_tail():
    rng = np.random.default_rng(2)
    for n, miss in ((30, 1e-2), (90, 5e-2)):
        m = S.posterior_floor(n, 0.8, miss)
        t = 0.8 + 0.2 / 256
        tail = lambda k: (rng.beta(k + 1, n - k + 1, 200_000) >= t).mean()
        assert tail(m) >= 0.7 * miss and tail(m - 2) < miss


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    rnd.shuffle(edges)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: (0 if i < 100 else 100 if i < 200 else 200) for i in [*range(61), *range(100, 150), *range(200, 209)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F is not None
