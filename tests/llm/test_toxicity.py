import math
import os
import pickle
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import toxicity as X
from riskframe.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_quality_and_brute_force_neighbours(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit_examples(docs, labels, "toxic", ~held_out(F.col("doc_id"), 4, 2))
    got = X.score_toxicity(docs, model).join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"), 4, 2)).toPandas()
    test = got[got.held]
    assert (((test.score >= 0.3).astype(int)) == test.toxic).mean() > 0.93 and got.score.between(0, 1).all()
    # the same cosines from plain dictionaries, no index
    texts, counter = {r.doc_id: r.text for r in docs.collect()}, X.TermCounter(model.terms)
    vec = {i: dict(X.unit_vector(counter(t), model.idf)) for i, t in texts.items()}
    for r in got.head(150).itertuples():
        q = vec[r.doc_id]
        cos = [(-round(sum(w * vec[e].get(t, 0.0) for t, w in q.items()), 12), k, e) for k, e in enumerate(model.ids)]
        best = [(s, e) for s, k, e in sorted(cos) if s < 0][:3]
        assert list(r.evidence_ids) == [e for _, e in best]
        assert math.isclose(r.nearest, -best[0][0] if best else 0.0, abs_tol=1e-9)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vecs = []
    for _ in range(700):
        t = rng.choice(60, rng.integers(0, 9), replace=False)
        w = rng.random(len(t)) + 0.01
        vecs.append(sorted(zip(t.tolist(), (w / max(1e-9, np.linalg.norm(w))).tolist())))
    vecs[10] = vecs[500] = vecs[11]
    index = X.BlockMaxIndex(vecs, 60)
    for q in range(0, 700, 7):
        want = sorted(((-round(sum(w * dict(v).get(t, 0.0) for t, w in vecs[q]), 12), i) for i, v in enumerate(vecs) if i != q))
        want = [(s, i) for s, i in want if s < 0][:15]
        got = index.nearest(vecs[q], 15, without=q)
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_frequencies_count_every_document(docs_of):
    rows = [(i, "idiot here" if i % 3 else "idiotic Idiot") for i in range(30)] + [(99, None)]
    terms = {"idiot": 0, "idiot*": 1, "here": 2}
    assert X.document_frequencies(X.count_terms(docs_of(rows), terms)) == {0: 30, 1: 10, 2: 20}


def test_inflected_forms_edge_rows_and_evidence(spark, docs_of):
    rnd = random.Random(8)
    clean = lambda n: " ".join("w" + "".join(rnd.choice("abcdefg") for _ in range(3)) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        rows.append((i, clean(40) + (" grumbl" + rnd.choice(["er", "ing", "ed", "y", "est"]) if bad else "")))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic long")
    model = X.fit_examples(docs_of(rows), lab, "toxic", F.lit(True))
    asked = [(1, "so grumblous " + clean(20)), (2, clean(20)), (3, None), (4, ""), (5, clean(60_000)), (None, "GRUMBLING"), (7, "GRUMBLING")]
    got = X.score_toxicity(docs_of(asked, clash=True), model).collect()
    assert got[0].score > 0.3 and got[5].score == got[6].score > 0.3 and got[0].evidence_ids and all(e % 4 == 0 for e in got[0].evidence_ids)
    assert any(t.startswith("grum") for t in got[0].evidence_terms)
    assert got[1].score == got[2].score == got[3].score < 0.3 and got[4].score < 0.3
    assert X.score_toxicity(docs_of([]), model).count() == 0


def test_without_labels_scores_are_a_small_constant(spark, docs_of):
    model = X.fit_examples(docs_of([(1, "a")]), spark.createDataFrame([], "doc_id long, toxic long"), "toxic", F.lit(True))
    assert {r.score < 0.3 for r in X.score_toxicity(docs_of([(1, "a"), (2, None)]), model).collect()} == {True}


def test_a_rare_toxic_word_is_indexed_and_copies_are_found(spark, docs_of):
    rows = [(i, f"calm text number {i} about gardens") for i in range(60)] + [(100 + i, f"zorgle{chr(97 + i)} blat") for i in range(12)]
    lab = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic long")
    lab = lab.union(spark.createDataFrame([(200, 1)], lab.schema))
    model = X.fit_examples(docs_of(rows + [(200, "quxnog vlim")]), lab, "toxic", F.lit(True))
    got = X.score_toxicity(docs_of([(1, "quxnog vlim"), (2, "calm gardens")]), model).orderBy("doc_id").collect()
    assert got[0].evidence_ids[0] == 200 and math.isclose(got[0].nearest, 1.0, abs_tol=1e-9) and got[0].score > got[1].score
    assert {"calm", "quxnog", "quxn*"} <= set(model.terms)  # one toxic example alone holds quxnog


def test_words_with_combining_marks_are_one_term_when_learned_and_when_scored(spark, docs_of):
    bad = ["\u0917\u093e\u0932\u0940", "\u0e14\u0e35\u0e44\u0e21\u0e48", "re\u0301sume\u0301x"]  # Devanagari, Thai, decomposed accents
    assert [X.WORD.findall(w) for w in bad] == [[w] for w in bad]
    rows = [(i, f"calm words {i}" + (f" {bad[i % 3]}" if i % 4 == 0 else "")) for i in range(120)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic long")
    model = X.fit_examples(docs_of(rows), lab, "toxic", F.lit(True))
    got = X.score_toxicity(docs_of([*enumerate(bad), (9, "calm words")]), model).orderBy("doc_id").collect()
    assert all(r.score > 0.3 and w in r.evidence_terms for r, w in zip(got, bad)) and got[3].score < 0.3


def test_a_sent_model_scores_alike_without_its_dictionary(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache(), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit_examples(docs, labels, "toxic", F.lit(True))
    sent = X.Examples.unpacked(pickle.loads(pickle.dumps(model.packed())))
    counter = X.TermCounter(model.terms)
    assert sent.terms == {} and sent.index.vectors[1][1].base is not None  # views of the arrays that were sent, no copies
    for r in docs.limit(40).collect():
        assert sent.score(counter(r.text)) == model.score(counter(r.text))


def test_many_texts_at_a_time_give_what_single_ones_give(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache(), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit_examples(docs, labels, "toxic", F.lit(True))
    texts = [r.text for r in docs.collect()] + [None, "", "über-groß — quux naïve " * 3, "Σίσυφος ΣΑΣ", "a" * 50_000]
    counter = X.TermCounter(model.terms, remember=50)
    counted = counter.batch(texts)
    ends = np.cumsum([0, *counted[2]])
    for i, text in enumerate(texts):  # cut by the tokenizer alone
        words = X.WORD.findall((text or "").lower())
        want = Counter(model.terms[t] for w in words for t in X.word_terms(w) if t in model.terms)
        assert dict(zip(counted[0][ends[i]:ends[i + 1]].tolist(), counted[1][ends[i]:ends[i + 1]].tolist())) == want
        assert counted[3][i] == sum(not any(t in model.terms for t in X.word_terms(w)) for w in words)
    got = model.scored(*counted).to_pylist()
    for r, text in zip(got, texts):
        assert list(r.values()) == [*model.score(counter(text))]


def test_nearest_of_many_vectors_is_exact_with_rows_blocks_and_ties(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(X, "STEP", 40)
    monkeypatch.setattr(X, "AT_ONCE", 128)
    vecs = []
    for _ in range(500):
        t = np.unique(np.minimum(rng.zipf(1.4, rng.integers(0, 20)), 300) - 1)
        w = rng.random(len(t)) + 0.01
        vecs.append((t, w / max(1e-9, np.linalg.norm(w))))
    vecs[7] = vecs[450] = vecs[8]
    dense = np.zeros((500, 300))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    index = X.BlockMaxIndex(vecs, 300)
    assert 0 < len(index.common_rows()) < 300
    for k in (1, 15, 600):
        for i, near in enumerate(index.nearest_many(vecs, k, list(range(500)))):
            cos = np.round(dense @ dense[i], 12)
            cos[i] = 0
            want = [e for e in np.argsort(-cos, kind="stable")[:k] if cos[e] > 0]
            assert [e for _, e in near] == want and np.allclose([s for s, _ in near], cos[want])


def test_stored_counts_are_small_and_read_back(spark, docs_of):
    rng = np.random.default_rng(4)
    terms = {f"w{i:05d}": i for i in range(50_000)}
    rows = [(i, " ".join(f"w{t:05d}" for t in rng.choice(50_000, 400, replace=False))) for i in range(300)]
    counted = X.count_terms(docs_of(rows), terms)
    kept = X.stored(counted)
    assert kept.select("doc_id", "__terms").orderBy("doc_id").collect() == counted.select("doc_id", "__terms").orderBy("doc_id").collect()
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in kept.inputFiles())
    assert size < 300 * 400 * 1.7  # bytes a term and its number; over 4 when stored plainly


def test_blocks_that_cannot_hold_a_nearest_example_are_not_multiplied():
    rng = np.random.default_rng(12)
    vecs = []
    for e in range(640):  # two languages, each with common and rare words of its own
        t = np.unique(np.concatenate([rng.choice(40, 15), 40 + rng.choice(2000, 5)])) + (2040 if e >= 320 else 0)
        w = rng.random(len(t)) + 0.1
        vecs.append((t, w / np.linalg.norm(w)))
    index = X.BlockMaxIndex(vecs, 4080)
    want = index.nearest_many(vecs[:320], 15)
    assert all(len(near) == 15 and max(e for _, e in near) < 320 for near in want)
    index.common_rows()[:, 320:] = np.nan  # a product with these would spoil every score
    assert index.nearest_many(vecs[:320], 15) == want


def test_each_distinct_word_of_a_step_is_looked_up_once_and_cut_as_the_tokenizer_does():
    class Asked(dict):
        asked = 0

        def get(self, *a):
            Asked.asked += 1
            return super().get(*a)

    texts = ["Über naïve_1 été \U00010400\U00010401x", "ΣΑΣ İstanbul-izmir x", "a\ud800b गाली!", None, "", " ", "straße\x00straße*"] * 40
    words = [X.WORD.findall((t or "").lower()) for t in texts]
    terms = {t: i for i, t in enumerate(sorted({s for w in words[0] + words[1] + words[6] for s in X.word_terms(w)}))}
    counter = X.TermCounter(terms)
    counter.known = {cut: Asked(known) for cut, known in counter.known.items()}
    t, n, sizes, rest = counter.batch(texts)
    assert 0 < Asked.asked <= 3 * len({w for ws in words for w in ws})
    ends = np.cumsum([0, *sizes])
    for i, ws in enumerate(words):
        want = Counter(terms[s] for w in ws for s in X.word_terms(w) if s in terms)
        assert dict(zip(t[ends[i]:ends[i + 1]].tolist(), n[ends[i]:ends[i + 1]].tolist())) == want
        assert rest[i] == sum(not any(s in terms for s in X.word_terms(w)) for w in ws)
