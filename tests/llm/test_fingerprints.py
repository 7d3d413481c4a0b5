import hashlib
import random
import re

from pyspark.sql import functions as F

from riskframe.llm import fingerprints as P

PARAGRAPH = re.compile(r"[^\n]{120,}?\. |[^\n]+")


def jaccard(a, b):
    x, y = set(PARAGRAPH.findall(a)), set(PARAGRAPH.findall(b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(t, edited), 9), round(jaccard(t, nxt), 9))
    return out


def texts(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(rnd.randrange(1, 8)))
    line = lambda: " ".join(word() for _ in range(rnd.randrange(1, 60))) + rnd.choice(["", ".", ". "])
    return [(7 * i, "\n".join(line() for _ in range(rnd.choice([1, 2, 5, 40, 400])))) for i in range(n)]


def test_equals_brute_force_with_edge_texts(docs_of):
    rows = texts(25) + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a\na\na"), (1004, "a\na\na"), (-5, "x" * 200_000)]
    got = P.fingerprint_versions(docs_of(rows, clash=True)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == brute(rows)
    assert all(r.decoded for r in got)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1003] == same[1004] and same[1000] == same[1001] and len(set(same.values())) > 20


def test_recovered_digests_are_the_differing_paragraphs(spark, docs_of):
    rows = texts(8, seed=3)
    got = P.fingerprint_versions(docs_of(rows)).collect()
    order = sorted(rows, key=lambda r: -r[0])
    digest = lambda ps: {r.h for r in spark.createDataFrame([(p,) for p in ps] or [("",)], "p string").select(
        F.xxhash64("p").alias("h")).collect()} if ps else set()
    by_id = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        a, b = set(PARAGRAPH.findall(t)), set(PARAGRAPH.findall(e))
        assert set(by_id[i].edited_removed) == digest(a - b) and set(by_id[i].edited_added) == digest(b - a)


def test_sketch_subtraction_peels_only_the_difference(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda x: F.xxhash64(x)).alias("a"))
    df = df.select("a", F.concat(F.slice("a", 4, 2000), F.array(F.lit(11).cast("long"))).alias("b"))
    r = df.select(P.peel(P.subtract(P.sketch(F.col("a")), P.sketch(F.col("b"))), P.BASE).alias("p"), F.slice("a", 1, 3).alias("gone")).first()
    assert {(x.d, x.s) for x in r.p.found} == {(d, 1) for d in r.gone} | {(11, -1)}


def test_null_and_repeated_ids_and_tiny_tables(docs_of):
    got = P.fingerprint_versions(docs_of([(None, "abcd"), (None, "abcd"), (3, "wx\nyz")])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 3 and by[3].near_next == 1.0  # a single document is its own next
    assert by[None].edited_sha256 == hashlib.sha256(b"ab").hexdigest() and by[None].near_next == 0.0
    twice = P.fingerprint_versions(docs_of([(5, "aa\nbb"), (5, "aa\nbb"), (4, "cc\ndd")])).collect()
    assert len(twice) == 3 and sorted(r.near_next for r in twice) == [0.0, 0.0, 1.0]
    assert P.fingerprint_versions(docs_of([])).count() == 0


def test_texts_without_line_or_sentence_ends_and_repeated_sentences(docs_of):
    rnd = random.Random(12)
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(3000))
    thai = "".join(chr(0x0E01 + rnd.randrange(46)) for _ in range(3000))
    code = "".join(rnd.choice("abcxyz019(){};=,") for _ in range(3000))
    again = ("x" * 130 + ". ") * 20
    rows = [(i, t) for i, t in enumerate([han, thai, code, "!" * 3000, again])]
    got = {r.doc_id: r for r in P.fingerprint_versions(docs_of(rows), finer=True).collect()}
    for i, t in rows:
        assert got[i].n_paragraphs >= 15 and got[i].near_edited > 0.2 and got[i].decoded, i
    assert got[4].n_paragraphs == 20


def test_a_block_that_never_peels_is_compared_whole(docs_of, monkeypatch):
    texts = ["\n".join(f"line {i}" for i in range(a, b)) for a, b in ((0, 60), (5, 90), (200, 260), (30, 31))]
    want = [r.asDict() for r in P.fingerprint_versions(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()]
    monkeypatch.setattr(P, "BLOCK_SIZES", ())  # every block that the first sketch leaves fails
    got = [r.asDict() for r in P.fingerprint_versions(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert any(w["decoded"] and not g["decoded"] for w, g in zip(want, got))
    for w, g in zip(want, got):
        assert (g["near_edited"], g["near_next"]) == (w["near_edited"], w["near_next"])
        assert sorted(g["edited_added"]) == sorted(w["edited_added"]) and sorted(g["edited_removed"]) == sorted(w["edited_removed"])


def test_ids_may_be_text(spark):
    rows = [(f"doc-{i:03}", f"text number {i}") for i in range(40)]
    got = P.fingerprint_versions(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    byte = {r.doc_id: r for r in got}
    assert len(byte) == 40
    numbered = P.fingerprint_versions(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {f"doc-{r.doc_id:03}": r.edited_sha256 for r in numbered} == {k: r.edited_sha256 for k, r in byte.items()}
