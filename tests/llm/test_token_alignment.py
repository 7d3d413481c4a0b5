import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import token_alignment as X
from riskframe.llm.queries import BYTE_BPE, PIECE_MODEL

TEXTS = [None, "", " ", "\n", "hello", " hello  world ", "The quick brown fox.\n\nJumps -- over 12345 lazy dogs!", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>",
         "漢字とかな", "é́\U0001F600\U0001F469‍\U0001F4BB", "tab\tand\x00null\r\n", "x" * 300, "   ", "def f(a_b):\n    return a_b**2  # ok", "don't we'll I'm",
         " nbsp wide", "ไทย ภาษา हिन्दी", "hello", "1 22 333 4444"]


@pytest.fixture(scope="module")
def files():
    return X.load_tokenizers(BYTE_BPE, PIECE_MODEL)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def brute(texts, libraries, files):
    """By the definition: token byte ranges, all overlaps by comparison, groups between common ends."""
    a, b = libraries
    docs, count = [], Counter()
    for t in texts:
        want = (" " + t).encode() if t else b""
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ra, rb = [files.a_bytes[i] for i in ia], [files.b_bytes[i] for i in ib]
        if b"".join(ra) != want or b"".join(rb) != want:
            ia, ib, ra, rb = [], [], [], []
        ea, eb = np.cumsum([0] + [len(x) for x in ra]), np.cumsum([0] + [len(x) for x in rb])
        links = [(i, j) for i in range(len(ia)) for j in range(len(ib)) if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]]
        common = sorted(set(ea[1:].tolist()) & set(eb[1:].tolist()))
        groups = []
        for lo, hi in zip([0, *common], common):
            groups.append(",".join(str(x) for x, e in zip(ia, ea[1:]) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(ib, eb[1:]) if lo < e <= hi))
        docs.append((ia, ib, ";".join(groups), len(groups), [(ia[i], ib[j]) for i, j in links]))
        count.update(docs[-1][4])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(ia), len(ib), n, len(ls), hashlib.sha256(g.encode()).hexdigest() if g else "", sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls))
            for ia, ib, g, n, ls in docs]


def run(docs_of, texts, files, **kw):
    from pyspark.sql import functions as F

    df = docs_of(list(enumerate(texts)), clash=True).repartition(3)
    out = X.align_tokens(df, files)
    out = X.link_support(out.withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))), **kw)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.sha, r.n_best, r.count_sum) for r in out.orderBy("doc_id").collect()]


def random_texts(n, seed):
    rnd = random.Random(seed)
    bits = ["the ", "token", "ization ", "é", "漢", " ", "  ", "\n", "Hello", "123", "_", "don't", "\U0001F600", "ab", "zq", ".", "ing", "▁", "\x00"]
    return ["".join(rnd.choice(bits[:-2] if rnd.random() < 0.97 else bits) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("kw", [dict(), dict(frequent=20), dict(frequent=1)])
def test_equals_brute_force(docs_of, libraries, files, kw):
    texts = TEXTS + random_texts(60, 4) + ["the same copy of a text"] * 25
    assert run(docs_of, texts, files, **kw) == brute(texts, libraries, files)


def test_some_texts_have_no_tokens(libraries, files):
    assert [brute([t], libraries, files)[0][0] > 0 for t in ("a▁b", "a b")] == [False, True]


def test_pieces_of_any_size_give_one_alignment():
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randrange(1, 40)
        ea, eb = (np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randrange(0, n))}), np.int64) for _ in range(2))
        ends = sorted({*ea.tolist(), *eb.tolist()})
        want = [(int((ea < e).sum()), int((eb < e).sum())) for e in ends]
        for steps in (1, 2, 3, 7, 1000):
            left, right, ca, cb = X.align(ea, eb, steps)
            assert list(zip(left.tolist(), right.tolist())) == want
            assert ea[ca].tolist() == eb[cb].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
    left, right, ca, cb = X.align(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(left) == len(right) == len(ca) == len(cb) == 0


def test_diagonals_divide_the_work_equally():
    ea, eb = np.arange(1, 1001) * 7, np.arange(1, 3501) * 2
    cuts = X.diagonals(ea, eb, 100)
    assert set(np.diff(cuts.sum(axis=0)).tolist()) == {100}
    for i, j in cuts.T:
        assert (i == 0 or j == len(eb) or ea[i - 1] <= eb[j]) and (j == 0 or i == len(ea) or eb[j - 1] < ea[i])


def test_parts_of_long_texts_encode_like_the_whole(libraries, files):
    assert files.may_cut
    long = " ".join(random_texts(200, 2)).replace("▁", "").replace("\x00", "") + " tail words here" * 50
    parts = X.parts_of(long, True)
    a, b = libraries
    assert len(parts) > 100 and " ".join(parts) == long
    assert [i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + long, add_special_tokens=False).ids
    assert [i for p in parts for i in b.encode(p)] == b.encode(long)
    assert X.parts_of("x" * 1000, True) == ["x" * 1000] and X.parts_of(long, False) == [long]


def test_merge_ranks_give_the_ids_of_the_tokenizer(libraries, files):
    assert files.a_ranks is not None
    rnd = random.Random(3)
    bits = ["the", "The", " ", "  ", "\t", "\n", "\r\n", "'s", "'LL", "n't", "12", "3456", "...", "!?", "_x", "ization", "zzzz", "<|endoftext|>", "a" * 40, "{", "==", "é", "Ärger", "ñ", "ǅ", "ßœ", "ə"]
    parts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(3000)] + ["é", "漢字 and", "\x1c\x0b", "x" * 5000]
    aligner = X.Aligner(files)
    assert aligner.encode_a(parts) == [libraries[0].encode(" " + p, add_special_tokens=False).ids for p in parts]


def test_forgetting_and_small_steps_change_nothing(files, monkeypatch):
    texts = [t or "" for t in TEXTS] + random_texts(80, 7)
    whole = X.Aligner(files).align_texts(texts)
    monkeypatch.setattr(X, "REMEMBERED", 5)
    monkeypatch.setattr(X, "PART_CHARS", 30)
    aligner = X.Aligner(files)
    each = [aligner.align_texts([t]) for t in texts]
    assert [r["groups"][0] for r in each] == whole["groups"]
    assert np.concatenate([r["n_links"] for r in each]).tolist() == whole["n_links"].tolist()


def test_very_long_text_and_empty_table(docs_of, files):
    word = "alignment of very long texts "
    got = run(docs_of, [word * 60_000, word], files)
    assert got[0][2] > 200_000 and got[0][3] == got[0][0] + got[0][1] - got[0][2] and got[0][6] > got[0][5] > 0
    assert run(docs_of, [], files) == []
