"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Text is marked as SentencePiece does (a leading blank, blanks written as U+2581)
and cut into marked words that no piece can cross. The distinct words of a batch
are sorted, which is the depth-first order of their trie; the forward pass keeps
its state for every prefix of the current word, and the next word starts from
the longest common prefix. A word's pieces are read back from the end.

The forward state depends on the model's kind:
* unigram: the best score of a segmentation of the prefix;
* BPE: the last piece of the prefix's encoding. A piece can follow it exactly when
  the merge order leaves the boundary between the two alone. The result is the
  merge-order encoding, where the sum of piece scores would not be.

Characters without a piece are written as byte pieces (or the unknown piece).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import give_back, ship_by_value

ship_by_value(__name__)

MARK = "▁"
OTHER = -1  # state of a character without a piece
BATCH_CHARS = 4_000_000


@dataclass
class Pieces:
    """The vocabulary, read on the driver and sent with the tasks (about 1 MB for 32,000 pieces)."""

    kind: str  # "bpe" or "unigram"
    text: list[str]  # by id; "" for control, unknown and byte pieces
    score: list[float]
    ids: dict[str, int]  # ordinary pieces that an encoding can contain
    byte_ids: list[int]  # 256 ids, or empty
    unknown: int
    left: list[int]  # BPE: the two pieces of a piece's last merge; -1 for single characters
    right: list[int]


def merge_order(word: str, ids: dict[str, int], score: list[float]) -> list[tuple[str, str]]:
    """Merges of ``word`` in BPE order (best score, then leftmost), by direct simulation; for single pieces only."""
    parts, done = list(word), []
    while True:
        best = max(((score[ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
        if best is None:
            return done
        i = -best[1]
        done.append((parts[i], parts[i + 1]))
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def load_pieces(model: str | bytes) -> Pieces:
    """Read a SentencePiece model (path or serialized proto) with an identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    if isinstance(model, bytes):
        proto.ParseFromString(model)
    else:
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only models with an identity normaliser and a leading blank are supported")
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    ordinary = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
    if any(MARK in p.lstrip(MARK) for p in ordinary):
        raise ValueError("a piece of this model crosses a word boundary")
    score = [p.score for p in proto.pieces]
    left, right = [-1] * len(score), [-1] * len(score)
    ids = dict(ordinary)
    if kind == 2:
        for p, i in ordinary.items():
            if len(p) > 1:
                merges = merge_order(p, ordinary, score)
                if merges and merges[-1][0] + merges[-1][1] == p and all(x in ordinary for x in merges[-1]):
                    left[i], right[i] = ordinary[merges[-1][0]], ordinary[merges[-1][1]]
                else:
                    del ids[p]  # no merge order ends in this piece, so no encoding contains it
    byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == 6]
    text = [p.piece if p.type == 1 else "" for p in proto.pieces]
    return Pieces("bpe" if kind == 2 else "unigram", text, score, ids, byte_ids if len(byte_ids) == 256 else [],
                  next(i for i, p in enumerate(proto.pieces) if p.type == 2), left, right)


class WordEncoder:
    """Encodes sorted distinct marked words, keeping the forward state of the current word's prefixes."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.by_text = pieces.ids
        # every ending of a piece -> the piece it is, or OTHER: a longer look back stops at the first miss
        self.endings: dict[str, int] = {}
        for t in pieces.ids:
            for k in range(len(t)):
                self.endings.setdefault(t[k:], OTHER)
        self.endings.update(pieces.ids)
        self.fits: dict[tuple[int, int], bool] = {}
        self.word = ""
        # per prefix length: state, piece that ends there, start of that piece
        self.state: list = [None]
        self.piece: list[int] = [OTHER]
        self.start: list[int] = [0]
        self.penalty = min(pieces.score, default=0.0) - 10.0

    def boundary_stays(self, a: int, b: int) -> bool:
        """BPE: whether pieces a, b next to each other are left unmerged at their boundary.

        Undo the later of the two pieces' last merges, again and again, and look whether the parts that
        then touch would have merged earlier than the merge just undone (at equal rank the left merge goes first).
        """
        key = (a, b)
        p, limit, strict, stays = self.p, -float("inf"), True, True
        while True:
            joined = self.by_text.get(p.text[a] + p.text[b])
            if joined is not None and (p.score[joined] > limit or (not strict and p.score[joined] == limit)):
                stays = False
                break
            if p.left[a] < 0 and p.left[b] < 0:
                break
            if p.left[b] < 0 or (p.left[a] >= 0 and p.score[a] < p.score[b]):
                limit, strict, a = p.score[a], True, p.right[a]
            else:
                limit, strict, b = p.score[b], False, p.left[b]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = stays
        return stays

    def extend(self, word: str, end: int) -> None:
        """Append the state of ``word[:end]``."""
        get, at = self.endings.get, end - 1
        t = get(word[at:end])
        ending = []  # (start, piece) of the pieces that end here, shortest first
        while t is not None:
            if t != OTHER:
                ending.append((at, t))
            if at == 0:
                break
            at -= 1
            t = get(word[at:end])
        state, piece, start = None, OTHER, end - 1
        if self.p.kind == "bpe":
            for at, t in reversed(ending):
                before = self.piece[at]
                if at == 0 or before == OTHER:
                    piece, start = t, at
                    break
                stays = self.fits.get((before, t))
                if stays or (stays is None and self.boundary_stays(before, t)):
                    piece, start = t, at
                    break
        else:
            state = self.state[end - 1] + self.penalty
            for at, t in reversed(ending):
                if self.state[at] + self.p.score[t] > state:
                    state, piece, start = self.state[at] + self.p.score[t], t, at
        self.state.append(state)
        self.piece.append(piece)
        self.start.append(start)

    def encode(self, word: str) -> list[int]:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        if not self.word:
            self.state[0] = 0.0
        del self.state[shared + 1:], self.piece[shared + 1:], self.start[shared + 1:]
        self.word = word
        for end in range(shared + 1, len(word) + 1):
            self.extend(word, end)
        out: list[int] = []
        end = len(word)
        while end > 0:
            start, t = self.start[end], self.piece[end]
            if t != OTHER:
                out.append(t)
            elif self.p.byte_ids:
                out.extend(self.p.byte_ids[b] for b in reversed(word[start:end].encode("utf-8")))
            else:
                out.append(self.p.unknown)
            end = start
        out.reverse()
        return out


class Codec:
    """Encodes and decodes whole texts, with a bounded memory of encoded words."""

    def __init__(self, pieces: Pieces, remember: int = 300_000):
        self.p, self.remember, self.encoder = pieces, remember, WordEncoder(pieces)
        line = "" if "\n" in pieces.ids else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + (f"|{line}" if line else ""))
        self.raw = [t.encode("utf-8") for t in pieces.text]
        for b, i in enumerate(pieces.byte_ids):
            self.raw[i] = bytes([b])
        self.raw[pieces.unknown] = " ⁇ ".encode()
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat: list[int] = []
        self.ends: list[int] = [0]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after each other, offsets of the texts)."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.code) > self.remember:
            self.forget()
        new = sorted({w for ws in split for w in ws} - self.code.keys())
        for w in new:
            self.code[w] = len(self.ends) - 1
            self.flat.extend(self.encoder.encode(w))
            self.ends.append(len(self.flat))
        code, ends, flat = self.code, np.array(self.ends, np.int64), np.array(self.flat, np.int32)
        codes = np.array([code[w] for ws in split for w in ws], np.int64)
        size = ends[codes + 1] - ends[codes]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(ends[codes] - at[:-1], size) + np.arange(at[-1])] if len(codes) else np.zeros(0, np.int32)
        word_ends = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
        return ids, at[word_ends]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces and bytes after each other, marks to blanks, without the leading blank."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _in_parts(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` characters (one row at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    yield start, len(texts)


def encode_documents(docs: DataFrame, pieces: Pieces, text_col: str = "text", verify: bool = True) -> DataFrame:
    """``docs`` plus n_tokens, token_ids and round_trip (decoding gives the text back; NULL without ``verify``).

    * NULL and empty texts have no tokens; their round trip is true.
    * A text that itself holds U+2581 decodes with blanks there, as in SentencePiece: its round_trip is false.
    * Texts are encoded whole; repeated rows alike; an empty table gives no rows; other columns pass through, and
      existing columns named like an added one are replaced.
    """
    added = ("n_tokens", "token_ids", "round_trip")
    keep = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(keep + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                                  T.StructField("round_trip", T.BooleanType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(pieces)
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text_col)).to_pylist()]
            for lo, hi in _in_parts(texts):
                ids, ends = codec.encode_batch(texts[lo:hi])
                same = [codec.decode(ids[a:b]) == t for a, b, t in zip(ends, ends[1:], texts[lo:hi])] if verify else [None] * (hi - lo)
                part = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(names))] + [pa.array(np.diff(ends), pa.int64()), lists, pa.array(same, pa.bool_())],
                    names=names + list(added))
        codec.forget()
        give_back()

    return docs.select(*[docs[f"`{n}`"] for n in names]).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, pieces: Pieces, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` plus decoded text; NULL ids give NULL, no ids the empty text."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(pieces)
        for batch in batches:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch], dtype=object)

    keep = [F.col(f"`{c}`") for c in docs.columns if c != "decoded"]
    return docs.select(*keep, run(F.col(ids_col)).alias("decoded"))
