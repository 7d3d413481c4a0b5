import hashlib

from pyspark.sql import functions as F

from riskframe.llm import exact_dedup as X

ROWS = [(1, "Hello World"), (2, "hello world"), (3, None), (4, ""), (5, "Été"), (6, "été"), (7, "x" * 300_000), (8, "X" * 300_000),
        (None, "hello world"), (9, "only"), (9, "only"), (None, "no id")]


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(_lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[_lower(t)] if x is not None]
        best = (max(ids) if keep == "largest" else min(ids)) if ids else None
        out.append((i, best, len(groups[_lower(t)]), i == best, hashlib.sha256(_lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_labels_equal_brute_force(docs_of):
    for keep in ("smallest", "largest"):
        got = X.label_copies(docs_of(ROWS, clash=True), keep=keep)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS, keep)


def test_hash_collisions_are_split_by_bytes(docs_of):
    one_bucket = lambda t: F.unhex(F.lit("00"))
    got = X.label_copies(docs_of(ROWS), keep="largest", hash_fn=one_bucket)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS, "largest")
    assert X.drop_copies(docs_of(ROWS), hash_fn=one_bucket).count() == len({_lower(t) for _, t in ROWS})


def test_drop_keeps_one_whole_row_per_text(docs_of):
    df = docs_of(ROWS, clash=True)
    got = X.drop_copies(df, keep="largest")
    assert got.columns == df.columns
    assert sorted(_lower(r.text)[:20] for r in got.collect()) == sorted({_lower(t)[:20] for _, t in ROWS})
    assert {r.doc_id for r in got.collect() if r.text and r.text.lower() == "hello world"} == {2}


def test_empty_table(docs_of):
    assert X.label_copies(docs_of([])).count() == 0
    assert X.drop_copies(docs_of([])).count() == 0
