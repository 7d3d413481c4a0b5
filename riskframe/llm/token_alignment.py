"""Cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece model (B) over the same bytes.

Both tokenizers write blank + text. The byte offsets at which tokens end are merged: two tokens overlap exactly where
one stretch between neighbouring ends lies in both, and a group closes where tokens of both end. The merge is cut
by merge-path partitioning: a binary search on every ``PIECE_STEPS``-th diagonal finds how many ends of A and B lie before
it, so pieces have equal work whatever the texts look like, and are merged independently. Only an end of A whose twin of
B opens the next piece has to be looked at again when the pieces are stitched together.

``align_tokens`` gives each document its groups and its linked id pairs; ``link_support`` counts the pairs over
all documents and looks the counts up again. Pairs with at least a ``1 / FREQUENT`` share of all links are at most
``FREQUENT`` many: they are broadcast and settle most links where they are. The rest is joined by a shuffle.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import give_back, ship_by_value
from riskframe.session import checkpoint_dir, cut_lineage

ship_by_value(__name__)

PIECE_STEPS = 65_536
PART_CHARS = 1_000_000
FREQUENT = 1_000_000
MARK = "▁"
#: A blank between ASCII letters: tokens of both kinds end there, and what follows is encoded as after a fresh start.
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Encoded parts that an encoder remembers, and the tokens they may have in all.
REMEMBERED, REMEMBERED_TOKENS = 400_000, 8_000_000


def byte_letters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tokenizers:
    """Both vocabularies as their files' contents, read on the driver (bounded by the files: some MB)."""

    a_json: str
    b_model: bytes

    @cached_property
    def a_bytes(self) -> list[bytes]:
        letters, model = byte_letters(), json.loads(self.a_json)
        vocab = dict(model["model"]["vocab"])
        raw = [b""] * (1 + max([*vocab.values(), *[t["id"] for t in model["added_tokens"]]]))
        for t in model["added_tokens"]:
            raw[t["id"]] = t["content"].encode("utf-8")
        for piece, i in vocab.items():
            if all(c in letters for c in piece):
                raw[i] = bytes(letters[c] for c in piece)
        return raw

    @cached_property
    def b_bytes(self) -> list[bytes]:
        p = self._b_proto
        return [bytes([int(x.piece[3:5], 16)]) if x.type == 6 else x.piece.replace(MARK, " ").encode("utf-8") for x in p.pieces]

    @cached_property
    def _b_proto(self):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(self.b_model)
        return proto

    @cached_property
    def a_ranks(self) -> dict[bytes, int] | None:
        """A's merge ranks by token, where the vocabulary is numbered in merge order over plain byte-level splitting; else None."""
        whole = json.loads(self.a_json)
        pre, model, special = whole.get("pre_tokenizer") or {}, whole["model"], {t["id"] for t in whole["added_tokens"]}
        plain = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
        if not plain or whole.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            return None
        return {t: i for i, t in enumerate(self.a_bytes) if i not in special}

    @cached_property
    def may_cut(self) -> bool:
        """Whether texts may be encoded in parts cut at ``SAFE_CUT``."""
        pre = json.loads(self.a_json).get("pre_tokenizer") or {}
        norm = self._b_proto.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and json.loads(self.a_json).get("normalizer") is None and plain and \
            not any(MARK in x.piece.lstrip(MARK) for x in self._b_proto.pieces)


#: Fixed value: how byte-level BPE parts a text.
BYTE_LEVEL_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts in these characters (ASCII and Latin letters) mean the same to every version of Unicode.
COMMON = re.compile(r"[\t\n\r\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]*")


def load_tokenizers(a_json: str, b_model: str) -> Tokenizers:
    """Read both vocabulary files (paths on the driver)."""
    with open(a_json, encoding="utf-8") as a, open(b_model, "rb") as b:
        return Tokenizers(a.read(), b.read())


def diagonals(ea: np.ndarray, eb: np.ndarray, steps: int) -> np.ndarray:
    """Number of ends of A before each ``steps``-th step of the merge, by one binary search per diagonal (A first at equal ends)."""
    d = np.append(np.arange(0, len(ea) + len(eb), steps), len(ea) + len(eb))
    lo, hi = np.maximum(d - len(eb), 0), np.minimum(d, len(ea))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        i, j = np.where(open_, mid, 0), np.where(open_, d - mid - 1, 0)
        before = open_ & (ea[i] <= eb[j])
        lo, hi = np.where(before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return np.stack([lo, d - lo])


def merge_piece(ea: np.ndarray, eb: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece by itself: overlapping (token of A, token of B) in order, and the tokens of A that are seen to end with one of B."""
    a, b = ea[i0:i1], eb[j0:j1]
    of_a, of_b = np.searchsorted(b, a, "left"), np.searchsorted(a, b, "left")
    twin_a = np.zeros(len(a), bool)
    inside = of_a < len(b)
    twin_a[inside] = b[of_a[inside]] == a[inside]
    new_b = np.ones(len(b), bool)  # an end of B after its twin of A makes no new stretch
    inside = of_b < len(a)
    new_b[inside] = a[of_b[inside]] != b[inside]
    left = np.concatenate([np.arange(i0, i1), i0 + of_b[new_b]])
    right = np.concatenate([j0 + of_a, np.arange(j0, j1)[new_b]])
    order = np.argsort(np.concatenate([np.arange(len(a)) + of_a, np.flatnonzero(new_b) + np.searchsorted(a, b[new_b], "right")]), kind="stable")
    return left[order], right[order], i0 + np.flatnonzero(twin_a)


def align(ea: np.ndarray, eb: np.ndarray, steps: int = PIECE_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B) of every overlap in order, and which tokens of A and of B close a group.

    ``ea``, ``eb``: strictly increasing byte offsets of token ends, with the same last one.
    """
    cuts = diagonals(ea, eb, steps)
    links, closing = [], []
    for (i0, j0), (i1, j1) in zip(cuts.T, cuts.T[1:]):
        left, right, closed = merge_piece(ea, eb, i0, i1, j0, j1)
        if i0 > 0 and j0 < len(eb) and ea[i0 - 1] == eb[j0]:  # stitch: the piece opens with the twin of the last end before it
            left, right = left[1:], right[1:]
            closing.append([i0 - 1])
        links.append((left, right))
        closing.append(closed)
    none = np.zeros(0, np.int64)
    left, right = (np.concatenate([none, *[x[k] for x in links]]) for k in (0, 1))
    close_a, close_b = np.zeros(len(ea), bool), np.zeros(len(eb), bool)
    close_a[np.concatenate([none, *closing]).astype(np.int64)] = True
    close_b[np.searchsorted(eb, ea[close_a])] = True
    return left, right, close_a, close_b


def parts_of(text: str, may_cut: bool) -> list[str]:
    """The text in parts, mostly words, without the blanks it is cut at; whole where there is no safe place."""
    return SAFE_CUT.split(text) if may_cut else [text]


class Aligner:
    """Encodes and aligns lists of texts."""

    def __init__(self, tokenizers: Tokenizers):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.t = tokenizers
        self.quick_a = None
        if tokenizers.a_ranks:
            import tiktoken

            self.quick_a = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PARTS, mergeable_ranks=tokenizers.a_ranks, special_tokens={})
        self.a = Tokenizer.from_str(tokenizers.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b_model)
        self.raw = [np.array(x, dtype=object) for x in (tokenizers.a_bytes, tokenizers.b_bytes)]
        self.size = [np.array([len(t) for t in x], np.int64) for x in (tokenizers.a_bytes, tokenizers.b_bytes)]
        written = [f"{i}{mark}" for i in range(len(self.size[0])) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.size[1])) for mark in ",;"]
        self.written = np.array(written, dtype=object)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.ends = (array("i"), array("i")), (array("q", [0]), array("q", [0]))

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        """A's ids of blank + part: by its merge ranks where the characters are ``COMMON``, which gives the same, else by the tokenizer itself."""
        if self.quick_a is None:
            return [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        quick = self.quick_a.encode_ordinary
        out = [quick(" " + p) if COMMON.fullmatch(p) else None for p in parts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.a.encode_batch([" " + parts[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def learn(self, parts: list[str]) -> None:
        """Encode parts that are not remembered, by both tokenizers, some at a time."""
        if len(self.code) > REMEMBERED or len(self.flat[0]) > REMEMBERED_TOKENS:
            self.forget()
        new = sorted({p for p in parts} - self.code.keys())
        lo = 0
        while lo < len(new):
            hi, chars = lo + 1, len(new[lo])
            while hi < len(new) and chars + len(new[hi]) <= PART_CHARS:
                chars += len(new[hi])
                hi += 1
            some = new[lo:hi]
            self.code.update(zip(some, range(len(self.code), len(self.code) + len(some))))
            for k, lists in ((0, self.encode_a(some)), (1, self.b.encode(some, num_threads=1))):
                self.ends[k].extend((len(self.flat[k]) + np.cumsum([len(ids) for ids in lists])).tolist())
                self.flat[k].extend(chain.from_iterable(lists))
            lo = hi

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, offsets of the texts) for A and B; a text that does not decode to itself has no ids.

        Parts repeat, so each is encoded once while it is remembered.
        """
        cut = [parts_of(t, self.t.may_cut) if t else [] for t in texts]
        parts = [p for ps in cut for p in ps]
        self.learn(parts)
        code = np.fromiter(map(self.code.__getitem__, parts), np.int64, len(parts))
        in_text = np.concatenate([[0], np.cumsum([len(ps) for ps in cut])]).astype(np.int64)
        found = []
        for k in (0, 1):
            raw, size = self.raw[k], self.size[k]
            ends, flat = np.array(self.ends[k], np.int64), np.frombuffer(self.flat[k], np.int32) if len(self.flat[k]) else np.zeros(0, np.int32)
            n = ends[code + 1] - ends[code]
            starts = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(ends[code] - starts[:-1], n) + np.arange(starts[-1])].astype(np.int64)
            del flat  # the array can grow again
            at = starts[in_text]
            found.append((ids, at, np.concatenate([[0], np.cumsum(size[ids])])[at], b"".join(raw[ids].tolist())))
        want = [b" " + t.encode("utf-8") if t else b"" for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in want])])
        if all((f[2] == ends).all() and f[3] == b"".join(want) for f in found):
            return [f[:2] for f in found]
        good = np.array([all(joined[at[k]:at[k + 1]] == w for _, _, at, joined in found) for k, w in enumerate(want)], bool)
        out = []
        for ids, at, _, _ in found:
            n = np.diff(at)
            out.append((ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(np.where(good, n, 0))]).astype(np.int64)))
        return out

    def align_texts(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        (a, at_a), (b, at_b) = self.encode(texts)
        left, right, close_a, close_b = align(np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b]))
        n_groups = np.concatenate([[0], np.cumsum(close_a)])[at_a]
        link_at = np.searchsorted(left, at_a, "left")
        # groups written out: a group's tokens of A, then those of B
        first_b = np.concatenate([[0], np.flatnonzero(close_b) + 1])
        past_a = np.flatnonzero(close_a) + 1
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + first_b[np.cumsum(close_a) - close_a]] = 2 * a + close_a
        code[np.arange(len(b)) + past_a[np.cumsum(close_b) - close_b]] = 2 * (len(self.size[0]) + b) + close_b
        written = self.written[code].tolist()
        at = (at_a + at_b).tolist()
        groups = ["".join(written[x:y])[:-1] for x, y in zip(at, at[1:])]
        # distinct linked id pairs of each text, with how often they are linked
        n_b = len(self.size[1])
        in_text = np.repeat(np.arange(len(texts)), np.diff(link_at))
        pair, times = np.unique((in_text * len(self.size[0]) + a[left]) * n_b + b[right], return_counts=True)
        text_of, id_a = np.divmod(pair // n_b, len(self.size[0]))
        return {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(n_groups), "n_links": np.diff(link_at), "groups": groups,
                "pair_at": np.searchsorted(text_of, np.arange(len(texts) + 1)), "a": id_a, "b": pair % n_b, "times": times}


ADDED = ("row_id", "n_a", "n_b", "n_groups", "n_links", "groups", "link_a", "link_b", "link_times")


def align_tokens(docs: DataFrame, tokenizers: Tokenizers, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus row_id, n_a, n_b, n_groups, n_links, groups, and the linked id pairs (link_a, link_b, link_times).

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B between common ends. Pairs are distinct per document and sorted.
    ``row_id`` tells rows of one evaluation apart; write the result before using it as a key.

    * A text that is NULL or empty, or whose tokens of A or B do not give blank + text back, has no tokens: zeros,
      '' and empty lists. Strings of special tokens are plain text.
    * Texts are encoded in parts cut where both tokenizers must end a token, and aligned whole.
    * Repeated rows are aligned alike; an empty table gives no rows; other columns pass through, and
      columns named like an added one are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((tokenizers.a_json, tokenizers.b_model))
    keep = [f for f in docs.schema.fields if f.name not in ADDED and f.name != text_col]
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    schema = T.StructType(keep + [T.StructField(n, T.StringType() if n == "groups" else ints if n.startswith("link_") else long) for n in ADDED])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(*sent.value))
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo + 1, len(texts[lo])
                while hi < len(texts) and chars + len(texts[hi]) <= PART_CHARS:
                    chars += len(texts[hi])
                    hi += 1
                r = aligner.align_texts(texts[lo:hi])
                at = pa.array(r["pair_at"], pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(r[c], pa.int32())) for c in ("a", "b", "times")]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(names))] + [pa.array(np.arange(row, row + hi - lo), pa.int64())]
                    + [pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [pa.array(r["groups"], pa.string()), *lists],
                    names=names + list(ADDED))
                row += hi - lo
                lo = hi
        del aligner
        give_back()

    return docs.select(*[docs[f"`{n}`"] for n in names], docs[f"`{text_col}`"].cast("string").alias(text_col)).mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared checkpoint folder, and read again."""
    spark: SparkSession = df.sparkSession
    path = f"{checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): links of every id pair over all documents, and whether no pair of the same b has more."""
    links = aligned.select(F.explode(F.arrays_zip("link_a", "link_b", "link_times")).alias("l"))
    counts = links.groupBy(F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b")).agg(F.sum(F.col("l.link_times").cast("long")).alias("n"))
    counts = cut_lineage(counts)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most one row per id of B
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_support(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of ``align_tokens`` plus n_best and count_sum; the lists of pairs are dropped.

    ``n_best`` counts the links whose pair has its B id's highest count over all documents (ties included);
    ``count_sum`` sums those counts over the document's links. Documents without links have zeros.
    """
    aligned = stored(aligned)
    support = count_pairs(aligned)
    total = support.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * F.lit(frequent) >= F.lit(total)
    links = aligned.select("row_id", F.explode(F.arrays_zip("link_a", "link_b", "link_times")).alias("l")).select(
        "row_id", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"), F.col("l.link_times").cast("long").alias("times"))
    known = links.join(F.broadcast(support.filter(often)), ["a", "b"], "left")
    rest = known.filter(F.col("n").isNull()).select("row_id", "a", "b", "times").join(support.filter(~often), ["a", "b"])

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0).cast("long"))).alias("n_best"),
                                        F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    both = sums(known.filter(F.col("n").isNotNull())).unionByName(sums(rest)).groupBy("row_id").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    keep = [c for c in aligned.columns if c not in ("link_a", "link_b", "link_times", "n_best", "count_sum")]
    return aligned.select(*[f"`{c}`" for c in keep]).join(both, "row_id", "left").na.fill(0, ["n_best", "count_sum"])
