import math
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from riskframe.llm import sentencepiece_codec as S
from riskframe.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def bpe():
    return S.load_pieces(PIECE_MODEL)


def samples(n, seed=3):
    rnd = random.Random(seed)
    chars = "aaabeinrstlo  .,\n\té漢0019AB\U0001F600"
    parts = ["in", "ing", "er", "the", "aa", "  ", "\n", "he", "re", "tion", "11", "aaaa", " the", "é"]
    out = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    return out + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30))) for _ in range(n)] + ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa"]


def test_bpe_ids_equal_the_library(bpe):
    lib, codec, texts = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), S.Codec(bpe), samples(4000)
    ids, ends = codec.encode_batch(texts)
    for a, b, t in zip(ends, ends[1:], texts):
        assert ids[a:b].tolist() == lib.encode(t), t
        assert codec.decode(ids[a:b]) == t


def test_unigram_scores_equal_the_library():
    proto = pb.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    rnd = random.Random(1)
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -math.log(i + 10) - rnd.random()
    raw = proto.SerializeToString()
    pieces, lib, texts = S.load_pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), samples(1500, 7)
    ids, ends = S.Codec(pieces).encode_batch(texts)
    same = [ids[a:b].tolist() == lib.encode(t) for a, b, t in zip(ends, ends[1:], texts)]
    assert np.mean(same) > 0.98  # the library adds 32-bit scores: where two segmentations nearly tie, it may take the other one
    total = lambda xs: sum(pieces.score[i] for i in xs if pieces.text[i])
    assert all(abs(total(ids[a:b].tolist()) - total(lib.encode(t))) < 1e-2 for a, b, t in zip(ends, ends[1:], texts))


def test_shared_prefixes_do_not_change_a_word(bpe):
    words = sorted({w for t in samples(300) for w in S.Codec(bpe).words.findall(S.MARK + t.replace(" ", S.MARK))})
    one = S.WordEncoder(bpe)
    assert [one.encode(w) for w in words] == [S.WordEncoder(bpe).encode(w) for w in words]


def test_documents_round_trip_with_edge_rows(bpe, docs_of):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, "a▁b"), (None, "é 漢\n"), (6, "same"), (6, "same"), (7, "<s> <0x0A>")]
    got = S.encode_documents(docs_of(rows, clash=True), bpe)
    back = S.decode_documents(got, bpe).collect()
    assert [r.decoded for r in back] == ["", "", rows[2][1], "a b", *[t for _, t in rows[4:]]]
    assert [r.round_trip for r in back] == [True, True, True, False, True, True, True, True]
    assert all(r.n_tokens == len(r.token_ids) for r in back) and back[0].token_ids == []
    assert S.encode_documents(docs_of([]), bpe).count() == 0


def test_small_memory_and_parts_give_the_same_ids(bpe):
    texts = samples(200)
    big, small = S.Codec(bpe), S.Codec(bpe, remember=3)
    want = big.encode_batch(texts)
    got = [small.encode_batch(texts[a:b]) for a, b in S._in_parts(texts, 50)]
    assert np.concatenate([g[0] for g in got]).tolist() == want[0].tolist()


def test_models_that_cross_words_or_normalise_are_refused():
    proto = pb.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError, match="word boundary"):
        S.load_pieces(proto.SerializeToString())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normaliser"):
        S.load_pieces(proto.SerializeToString())
