"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows. A word's terms are the word
itself and its proper beginnings of 4 and 5 characters (written with ``*``), so
that inflected and compound forms share terms. Every term of every example is
indexed, with a TF-IDF weight (document frequencies over all documents) times an
emphasis of 0.05 to 1 that grows with the term's tie to label 1. Words of a text that
share no term with any example cannot match; they count in its length, each with
weight 1. A text's nearest examples are found exactly, for many texts at a time: the
postings of terms that few examples hold give every example a first score; terms that many
hold are whole rows of weights. A block of examples whose best first score plus upper bound
(sum over the text's common terms of term weight times the block's largest weight) is below
the k-th best, for all texts of a group, is passed over; to the other blocks' scores a matrix
product adds the rows. Those sums are in single precision; every example within their error
of the k-th best is summed again in double precision. Documents are cut into terms once;
frequencies and scores use the stored counts.
Similarity-weighted votes of the neighbours, calibrated by a logistic curve on
leave-one-out votes, give the score; the neighbours and the terms that bind the
text to them are its evidence. Every whole text is scored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from riskframe.llm.common import give_back, labelled_sample, ship_by_value
from riskframe.session import checkpoint_dir

ship_by_value(__name__)


def _marks() -> str:
    """Character ranges of all combining marks, which Python's ``\\w`` leaves out."""
    at = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    ends = [i for i, c in enumerate(at) if i + 1 == len(at) or at[i + 1] != c + 1]
    return "".join(f"\\U{at[a]:08x}-\\U{at[b]:08x}" for a, b in zip([0, *[i + 1 for i in ends[:-1]]], ends))


#: Letters, digits, combining marks and underscores; the one tokenizer of learning, frequencies and scores.
WORD = re.compile(rf"[\w{_marks()}]+")
#: Starts and ends of the ranges of code points that ``WORD`` takes.
RANGES = np.array([m.span() for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1))))])
BLOCK = 64
#: A term that at least one example in so many holds is common.
COMMON_SHARE = 32
#: Texts that a matrix product takes at once; postings that are added in one step, unless one text alone has more.
AT_ONCE, STEP = 256, 60_000
#: Tasks that the examples' texts are dealt to: they are bounded, and each task builds the counter of terms.
FEW = 16
#: Lengths of word beginnings that are terms.
STEMS = (4, 5)


def word_terms(w: str) -> list[str]:
    """The word and its proper beginnings."""
    return [w, *(w[:n] + "*" for n in STEMS if n < len(w))]


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(code_points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Words of the given numbers of characters, each character as 4 bytes."""
    ends = np.cumsum(np.append(0, sizes)) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(code_points)])


class TermCounter:
    """Counts terms and words without a term of whole lower-cased texts; remembers the words of so many characters at a time."""

    def __init__(self, terms: dict[str, int], remember: int = 2_000_000):
        self.terms, self.remember = terms, remember
        self.letters = np.zeros(sys.maxunicode + 1, bool)
        self.letters[spread(*RANGES.T)[0]] = True
        names, numbers = list(terms), np.fromiter(terms.values(), np.int32, len(terms))
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        words, star = _words(_code_points(names), sizes), np.fromiter((t.endswith("*") for t in names), bool, len(names))
        self.known = {}  # by length of a beginning, 0 for whole words
        for cut in (0, *STEMS):
            some = np.flatnonzero(star & (sizes == cut + 1) if cut else ~star)
            keys = words.take(pa.array(some))
            keys = pc.binary_slice(keys, 0, 4 * cut) if cut else keys
            self.known[cut] = dict(zip(keys.to_numpy(zero_copy_only=False).tolist(), numbers[some].tolist()))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of many texts: terms (in order inside a text), their occurrences, number of terms of each text, its words without a term."""
        done, part, held = [self._count([])], [], 0
        for text in texts:
            part.append(f"{text.lower()} " if text else " ")
            held += len(part[-1])
            if held >= self.remember:
                done.append(self._count(part))
                part, held = [], 0
        done.append(self._count(part))
        return tuple(np.concatenate(x) for x in zip(*done))

    def _count(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Counts of texts that end with a blank: all are cut at once, and each distinct word is looked up once."""
        points = _code_points(texts)
        inside = self.letters[points]
        starts, stops = np.flatnonzero(np.diff(inside, prepend=False)).reshape(-1, 2).T
        coded = _words(points[inside], stops - starts).dictionary_encode()
        held = np.searchsorted(starts, np.cumsum([len(x) for x in texts]))
        owner, code = np.repeat(np.arange(len(texts)), np.diff(held, prepend=0)), coded.indices.to_numpy()
        found = self._found(coded.dictionary)
        rest = np.bincount(owner, (found < 0).all(axis=0)[code], minlength=len(texts))
        width = max(1, len(self.terms))
        key = [(owner * width + at)[at >= 0] for at in (f[code] for f in found)]
        key, n = np.unique(np.concatenate(key), return_counts=True)
        return (key % width).astype(np.int32), n.astype(np.int32), np.bincount(key // width, minlength=len(texts)), rest.astype(np.int32)

    def _found(self, words: pa.Array) -> np.ndarray:
        """Numbers of the terms of distinct words, -1 for none: a row for whole words and one for each length of beginnings."""
        sizes, found = pc.binary_length(words).to_numpy(), []
        for cut, known in self.known.items():
            coded = pc.binary_slice(words, 0, 4 * cut).dictionary_encode() if cut else None
            keys = (coded.dictionary if cut else words).to_numpy(zero_copy_only=False)
            at = np.fromiter((known.get(x, -1) for x in keys.tolist()), np.int32, len(keys))
            found.append(np.where(sizes > 4 * cut, at[coded.indices.to_numpy()], -1) if cut else at)
        return np.array(found)

    def __call__(self, text: str | None) -> tuple[dict[int, int], int]:
        """({term number: occurrences}, words without a term) of one text."""
        t, n, _, rest = self.batch([text])
        return dict(zip(t.tolist(), n.tolist())), int(rest[0])


def weighed(t: np.ndarray, tf: np.ndarray, rest: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and their weights: (1 + ln tf) * idf (emphasis included) over the vector's length (other words included)."""
    order = np.argsort(t)
    return weighed_many(t[order], tf[order], np.array([len(t)]), np.array([rest]), idf)[0]


def weighed_many(t: np.ndarray, tf: np.ndarray, sizes: np.ndarray, rest: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``weighed`` of many texts whose terms are in order."""
    owner, raw = np.repeat(np.arange(len(sizes)), sizes), (1.0 + np.log(tf)) * idf[t]
    w = raw / np.sqrt(np.bincount(owner, raw * raw, minlength=len(sizes)) + rest)[owner]
    ends = np.cumsum([0, *sizes]).tolist()
    return [(t[a:b], w[a:b]) for a, b in zip(ends, ends[1:])]


def counted_vector(counted: tuple[dict[int, int], int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, rest = counted
    return weighed(np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)), rest, idf)


def unit_vector(counted: tuple[dict[int, int], int], idf: np.ndarray) -> list[tuple[int, float]]:
    """``counted_vector`` as (term, weight) pairs."""
    t, w = counted_vector(counted, idf)
    return list(zip(t.tolist(), w.tolist()))


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range that each belongs to."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner], owner


def _arrays(vec) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a vector given so or as pairs."""
    if isinstance(vec, tuple):
        return vec
    return np.array([t for t, _ in vec], np.int64), np.array([w for _, w in vec], np.float64)


def _joined(vecs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of all vectors, and the vector that each belongs to."""
    t, q = (np.concatenate([np.empty(0, kind), *[v[j] for v in vecs]]) for j, kind in ((0, np.int64), (1, np.float64)))
    return t, q, np.repeat(np.arange(len(vecs)), [len(t) for t, _ in vecs])


class BlockMaxIndex:
    """Postings of unit vectors, by term and example; the postings of one term in a block of 64 examples are an entry with its largest weight."""

    def __init__(self, vectors: list, terms: int):
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        parts = [_arrays(v) for v in vectors]
        t = np.concatenate([np.empty(0, np.int64), *[p[0] for p in parts]])
        w = np.concatenate([np.empty(0), *[p[1] for p in parts]])
        self.own_terms, self.own_weights, self.own_ends = t.astype(np.int32), w, np.cumsum([0, *[len(p[0]) for p in parts]])
        e = np.repeat(np.arange(self.size), np.diff(self.own_ends)).astype(np.int64)
        order = np.argsort(t, kind="stable")  # examples stay in order inside a term
        t, self.weights, self.examples = t[order], w[order].astype(np.float32), e[order].astype(np.int32)
        key = t * max(1, self.blocks) + self.examples // BLOCK
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.starts = np.append(starts, len(t)).astype(np.int32)
        self.block = (self.examples[starts] // BLOCK).astype(np.int32)
        self.largest = np.maximum.reduceat(self.weights, starts) if len(starts) else np.empty(0, np.float32)
        self.first = np.searchsorted(t[starts], np.arange(terms + 1)).astype(np.int32)
        held = np.bincount(t, minlength=terms)
        common = np.flatnonzero(held * COMMON_SHARE >= max(1, self.size))
        common = common[np.argsort(-held[common], kind="stable")]
        self.row_of = np.full(terms, -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        self.rows = self.peaks = None

    def __getstate__(self):
        return self.__dict__ | {"rows": None, "peaks": None}  # built again where they are used

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example, as views."""
        return [(self.own_terms[a:b], self.own_weights[a:b]) for a, b in zip(self.own_ends, self.own_ends[1:])]

    def common_rows(self) -> np.ndarray:
        """Weights of the common terms in all examples (at most COMMON_SHARE times the postings), in single precision."""
        if self.rows is None:
            common = np.argsort(self.row_of, kind="stable")[int((self.row_of < 0).sum()):]
            rows = np.zeros((len(common), self.size), np.float32)
            at, _ = spread(self.first[common], self.first[common + 1])
            p, owner = self._postings(at)
            term = np.repeat(np.arange(len(common)), self.first[common + 1] - self.first[common])
            rows[term[owner], self.examples[p]] = self.weights[p]
            self.rows, self.peaks = rows, np.maximum.reduceat(rows, self.block_starts(), axis=1) if self.size else rows
        return self.rows

    def block_starts(self) -> np.ndarray:
        return np.arange(0, self.size, BLOCK)

    def _postings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spread(self.starts[at], self.starts[at + 1])

    def nearest(self, vec, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine as (cosine, example), ties by example; ``without`` is left out."""
        return self.nearest_many([_arrays(vec)], k, [without])[0]

    def nearest_many(self, vecs: list, k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of many (terms, weights)."""
        if not self.size:
            return [[] for _ in vecs]
        out: list = [None] * len(vecs)
        self.common_rows()
        asked, ids, weights, ends = np.zeros(len(self.row_of)), self.own_terms, self.own_weights, self.own_ends.tolist()
        for group in self._alike(vecs):
            left = np.array([without[i] if without is not None else -1 for i in group])
            for i, near in zip(group, self._near([vecs[i] for i in group], k, left)):
                if not len(near):
                    out[i] = []
                    continue
                t, q = vecs[i]
                asked[t] = q
                spans = [(ends[e], ends[e + 1]) for e in near.tolist()]
                part = asked.take(np.concatenate([ids[a:b] for a, b in spans])) * np.concatenate([weights[a:b] for a, b in spans])
                score = np.round(np.add.reduceat(part, np.cumsum([0, *[b - a for a, b in spans[:-1]]])), 12)
                asked[t] = 0.0
                best = np.argsort(-score, kind="stable")[:k]
                out[i] = [(x, e) for x, e in zip(score[best].tolist(), near[best].tolist()) if x > 0]
        return out

    def _alike(self, vecs: list) -> list[list[int]]:
        """The vectors in groups of at most AT_ONCE whose blocks have like bounds (by common terms): a group then needs few of the blocks."""
        bounds = np.zeros((len(vecs), max(1, self.blocks)), np.float32)
        for a in range(0, len(vecs), AT_ONCE):
            t, q, d = _joined(vecs[a:a + AT_ONCE])
            bounds[a:a + AT_ONCE] = self._asked(t, q, d, AT_ONCE)[:len(vecs) - a] @ self.peaks
        bounds /= np.maximum(bounds.max(axis=1, keepdims=True), 1e-30)
        done, left = [], [np.arange(len(vecs))]
        while left:  # halved by the block whose bounds differ most
            group = left.pop()
            if len(group) <= AT_ONCE:
                done.append(group.tolist())
            else:
                by = bounds[group]
                group = group[np.argsort(by[:, np.argmax(by.var(axis=0))], kind="stable")]
                left += np.array_split(group, 2)
        return done

    def _asked(self, t: np.ndarray, q: np.ndarray, d: np.ndarray, vectors: int) -> np.ndarray:
        """Weights of the common terms of joined vectors, a row for each vector."""
        row = self.row_of[t]
        asked = np.zeros((vectors, len(self.rows)), np.float32)
        asked[d[row >= 0], row[row >= 0]] = q[row >= 0]
        return asked

    def _near(self, vecs: list, k: int, left: np.ndarray) -> Iterator[np.ndarray]:
        """Per vector the examples, in order, that can be among its k nearest: no sum of products in single precision is off by more than a share ``slack``."""
        rows, peaks = self.rows, self.peaks
        slack = 4.0 * (len(rows) + 8) * 2.0**-24
        t, q, d = _joined(vecs)
        asked, rare = self._asked(t, q, d, len(vecs)), self.row_of[t] < 0
        score = self._rare(t[rare], q[rare], d[rare], len(vecs))
        used = np.flatnonzero(asked.any(axis=0))
        if 5 * len(used) < 4 * len(rows):
            asked, rows, peaks = asked[:, used], rows[used], peaks[used]
        bound = np.maximum.reduceat(score, self.block_starts(), axis=1) + asked @ peaks
        kth = lambda s: np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else np.zeros((len(s), 1), s.dtype)
        some = np.zeros(self.blocks, bool)  # blocks of large bounds come first: their k-th best score lets others be passed over
        some[np.argsort(-bound.sum(axis=0), kind="stable")[:-(-self.blocks // 4)]] = True
        for seen in (np.repeat(some, BLOCK)[:self.size], slice(None)):
            edges = np.flatnonzero(np.diff(some, prepend=False, append=False)).reshape(-1, 2) * BLOCK
            for a, b in edges.tolist():
                score[:, a:b] += asked @ rows[:, a:b]
            score[np.flatnonzero(left >= 0), left[left >= 0]] = 0.0
            best = kth(score[:, seen])
            bound[:, some] = 0.0  # done
            some = ((bound > 0) & (bound >= best * (1.0 - slack) - 1e-9)).any(axis=0)
        near = (score > 0) & (score >= best * (1.0 - slack) - 1e-11)
        yield from (np.flatnonzero(x) for x in near)

    def _rare(self, t: np.ndarray, q: np.ndarray, d: np.ndarray, vectors: int) -> np.ndarray:
        """First scores of all examples: the sums over terms (in order of their vectors ``d``) that are no rows."""
        score = np.empty((vectors, self.size), np.float32)
        starts = self.starts[self.first[t]].astype(np.int64)
        sizes = self.starts[self.first[t + 1]] - starts
        ends = np.cumsum(np.bincount(d, sizes, minlength=vectors))
        a = 0
        while a < vectors:  # as many vectors as have STEP postings
            b = max(a + 1, int(np.searchsorted(ends, STEP + (ends[a - 1] if a else 0), "right")))
            here = slice(*np.searchsorted(d, [a, b]))
            n = sizes[here]
            p = np.repeat(starts[here] - (np.cumsum(n) - n), n)
            p += np.arange(len(p))
            cell = np.repeat((d[here] - a) * self.size, n)
            cell += self.examples.take(p)
            score[a:b] = np.bincount(cell, np.repeat(q[here], n) * self.weights.take(p), minlength=(b - a) * self.size).reshape(b - a, self.size)
            a = b
        return score

    def shared(self, vec, examples: list[int]) -> np.ndarray:
        """What each of the vector's terms adds to the cosines with these examples."""
        return self.shared_many([_arrays(vec)], [examples])[0]

    def shared_many(self, vecs: list, examples: list[list[int]]) -> list[np.ndarray]:
        """``shared`` of many (terms, weights), each with examples of its own."""
        out, place, ends = [], np.full(len(self.row_of), -1, np.int32), self.own_ends.tolist()
        for (t, q), some in zip(vecs, examples):
            place[t] = np.arange(len(t), dtype=np.int32)
            at = place.take(np.concatenate([self.own_terms[:0], *[self.own_terms[ends[e]:ends[e + 1]] for e in some]]))
            w = np.concatenate([self.own_weights[:0], *[self.own_weights[ends[e]:ends[e + 1]] for e in some]])
            hit = np.flatnonzero(at >= 0)
            at = at.take(hit)
            out.append(np.bincount(at, q.take(at) * w.take(hit), minlength=len(t)))
            place[t] = -1
        return out


@dataclass
class Examples:
    """The fitted model: bounded by the labelled examples and their words, whatever the size of the corpus."""

    terms: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list
    y: np.ndarray
    weight: np.ndarray
    k: int
    slope: float = 0.0
    offset: float = 0.0
    names: object = None  # of the terms, by number
    id_type: pa.DataType = pa.int64()

    def __post_init__(self) -> None:
        if self.names is None:
            self.names = list(self.terms)

    def packed(self) -> dict:
        """All that scoring counted terms needs, as plain arrays: a worker that receives them holds them once."""
        return {"index": self.index.__getstate__(), "names": pa.array(self.names, pa.string()),
                "idf": self.idf, "ids": self.ids, "y": self.y, "weight": self.weight, "k": self.k, "slope": self.slope, "offset": self.offset,
                "id_type": self.id_type}

    @classmethod
    def unpacked(cls, p: dict) -> Examples:
        """The model of ``packed`` arrays, without copies of them and without the dictionary of terms, which only cutting texts needs."""
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        index.__dict__.update(p["index"])
        return cls({}, p["idf"], index, p["ids"], p["y"], p["weight"], p["k"], p["slope"], p["offset"], p["names"], p["id_type"])

    def votes(self, vecs: list, without: list[int] | None = None) -> list[tuple[float, list[tuple[float, int]]]]:
        """Per vector the mean of similarity times +-1 over the neighbours, each weighted by its class's share and its similarity; and those.

        0, the lowest evidence, without any neighbour or if label 0 prevails: a text like clean ones is no less toxic than an empty one.
        """
        out = []
        for near in self.index.nearest_many(vecs, self.k, without):
            mass = sum(s * self.weight[i] for s, i in near)
            total = sum(s * s * self.weight[i] * (2.0 * self.y[i] - 1.0) for s, i in near)
            out.append((max(0.0, total / mass) if mass > 0 else 0.0, near))
        return out

    def score_vectors(self, vecs: list, evidence: int = 3, shown: int = 20) -> list[tuple[float, float, list, list[int]]]:
        """Per (terms, weights): score, largest cosine, nearest examples, numbers of the terms that add most."""
        out, votes = [], self.votes(vecs)
        parts = self.index.shared_many(vecs, [[i for _, i in near[:evidence]] for _, near in votes])
        for vec, (v, near), part in zip(vecs, votes, parts):
            score = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.slope * v + self.offset))))
            if not near:
                out.append((score, 0.0, [], []))
                continue
            some = np.flatnonzero(part > 0)
            top = some[np.argsort(-part[some], kind="stable")[:shown]]
            out.append((score, near[0][0], [self.ids[i] for _, i in near[:evidence]], vec[0][top].tolist()))
        return out

    def score(self, counts: tuple[dict[int, int], int], evidence: int = 3, shown: int = 20) -> tuple[float, float, list, list[str]]:
        found = self.score_vectors([counted_vector(counts, self.idf)], evidence, shown)[0]
        return *found[:3], [str(self.names[i]) for i in found[3]]

    def scored(self, t: np.ndarray, tf: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> pa.StructArray:
        """Scores and evidence of a batch of counted texts."""
        names = self.names if isinstance(self.names, pa.Array) else pa.array(self.names, pa.string())
        found = self.score_vectors(weighed_many(t, tf, sizes, rest, self.idf))
        score, nearest, ids, terms = zip(*found) if found else ((), (), (), ())
        cut = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
        shown = names.take(pa.array([i for x in terms for i in x], pa.int32()))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(nearest, pa.float64()), pa.array(ids, pa.list_(self.id_type)),
                                           pa.ListArray.from_arrays(cut, shown)], ["score", "nearest", "evidence_ids", "evidence_terms"])


def emphasis(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float, full: float = 14.0, least: float = 0.05) -> np.ndarray:
    """A term's factor, ``least`` to 1 and never 0: the signed log-likelihood ratio of its counts in the classes (positive: tied to label 1) over ``full``."""
    n = pos + neg
    e1, e0 = n * n_pos / max(1.0, n_pos + n_neg), n * n_neg / max(1.0, n_pos + n_neg)
    part = lambda o, e: np.where((o > 0) & (e > 0), o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    return np.clip(np.sign(pos - e1) * 2 * (part(pos, e1) + part(neg, e0)) / full, least, 1.0)


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve from votes to label 1 (weighted, lightly ridged, Newton steps)."""
    if len(y) == 0:
        return 0.0, -3.0
    x = np.column_stack([votes, np.ones(len(votes))])
    w = weight / weight.sum() * len(y)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * len(y) * beta * [1, 0.01]
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([1, 0.01]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(0.0, beta[0])), float(beta[1])


def count_terms(docs: DataFrame, terms: dict[str, int], text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``__terms`` = struct(t, n, rest): the terms of each whole text, their numbers, other words."""
    @arrow_udf("t array<int>, n array<int>, rest int")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TermCounter(terms)
        for batch in texts:
            t, n, sizes, rest = counter.batch(batch.to_pylist())
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(t)), pa.ListArray.from_arrays(ends, pa.array(n)), pa.array(rest)],
                                             ["t", "n", "rest"])
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "__terms")], count(F.col(text_col)).alias("__terms"))


def document_frequencies(counted: DataFrame) -> dict[int, int]:
    """Number of documents that hold each term, over all documents."""
    rows = counted.select(F.explode("__terms.t").alias("t")).groupBy("t").count().toArrow()  # at most one row per term
    return dict(zip(rows["t"].to_pylist(), rows["count"].to_pylist()))


def fit_examples(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                 max_per_label: int = 2500, k: int = 15) -> Examples:
    """Index all terms of at most ``2 * max_per_label`` labelled rows for which ``usable`` (an expression on ``labels``) holds.

    Equal texts are one example (the smallest id, the rounded mean label).
    """
    return _fit(docs, labels, label_col, usable, id_col, text_col, [], max_per_label, k)[0]


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str, text_col: str, keep, max_per_label: int,
         k: int) -> tuple[Examples, DataFrame]:
    """The model, and the documents' columns ``keep`` with their stored term counts (``__terms``)."""
    sample = labelled_sample(labels, label_col, usable, id_col, max_per_label)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(sample), "id")
    texts = texts.groupBy(F.md5(F.lower("t").cast("binary")).alias("h")).agg(
        F.min("id").alias("id"), (F.avg("y") >= 0.5).cast("int").alias("y"), F.min_by("t", F.struct("id", "t")).alias("t")).coalesce(FEW).cache()

    @pandas_udf("array<string>")
    def all_terms(batch: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for w in set(WORD.findall(t.lower())) for s in word_terms(w)}) for t in batch], dtype=object)

    names = texts.select(F.explode(all_terms("t")).alias("w")).distinct().toArrow()["w"].to_pylist()  # bounded by the examples' words
    terms = {w: t for t, w in enumerate(sorted(names))}
    counted = stored(count_terms(docs.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(text_col).alias("__text")), terms, "__text"))
    df, n = document_frequencies(counted), counted.count()
    rows = count_terms(texts.select("id", "y", F.col("t").alias("text")), terms).select("id", "y", "__terms.*").toArrow()
    texts.unpersist()
    ids, ys, id_type = rows["id"].to_pylist(), rows["y"].to_pylist(), rows["id"].type
    counts = [(t.values.to_numpy(), n.values.to_numpy(), r.as_py()) for t, n, r in zip(rows["t"], rows["n"], rows["rest"])]
    holders = lambda lab: np.bincount(np.concatenate([np.empty(0, np.int32), *[c[0] for c, y in zip(counts, ys) if y == lab]]), minlength=len(terms))
    pos, neg = holders(1), holders(0)
    held = pos + neg
    idf = np.array([math.log((n + 1) / (df.get(t, 0) + 1)) + 1.0 for t in range(len(terms))])
    idf = idf * emphasis(pos, neg, sum(ys), len(ys) - sum(ys))
    vecs = [weighed(*c, idf) for c in counts]
    del counts, rows

    def likeness(v):  # like examples share blocks: the heaviest term that many hold
        t, w = v
        common = held[t] >= BLOCK
        return int(t[common][np.argmax(w[common])]) if common.any() else -1

    order = sorted(range(len(vecs)), key=lambda i: (likeness(vecs[i]), ids[i]))
    vecs, y = [vecs[i] for i in order], np.array([ys[i] for i in order], float)
    shares = labels.filter(usable & F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
    rate = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, shares / max(rate, 1e-9), (1 - shares) / max(1 - rate, 1e-9))
    model = Examples(terms, idf, BlockMaxIndex(vecs, len(terms)), [ids[i] for i in order], y, weight, k, id_type=id_type)
    votes = np.array([v for v, _ in model.votes(vecs, list(range(len(vecs))))])
    model.slope, model.offset = calibrate(votes, y, weight)
    return model, counted


def score_toxicity(docs: DataFrame, model: Examples, text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """The other columns of ``docs`` plus score (0 to 1, higher: label 1 likelier), nearest (largest cosine),
    evidence_ids (up to three nearest examples) and evidence_terms (up to 20 terms that add most to those cosines).

    * NULL and empty texts, and texts without any term of an example, have no neighbour: vote 0, the lowest evidence.
    * Equal cosines are ordered by example; without labels every score is the same small constant.
    * Repeated rows get equal scores; an empty table gives no rows; existing columns named like an added one are replaced.
    """
    @arrow_udf(f"score double, nearest double, evidence_ids array<{id_type}>, evidence_terms array<string>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TermCounter(model.terms)
        for batch in texts:
            yield model.scored(*counter.batch(batch.to_pylist()))
        give_back()

    added = ("score", "nearest", "evidence_ids", "evidence_terms")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*added, text_col)]
    scored = docs.select(*keep, score(F.col(text_col)).alias("__p"))
    return scored.select(*keep, *[F.col(f"__p.{c}") for c in added])


def fit_and_score(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                  max_per_label: int = 2500, k: int = 15) -> DataFrame:
    """``fit_examples``, then ``score_toxicity`` of the same documents from the term counts that the fit has stored."""
    added = ("score", "nearest", "evidence_ids", "evidence_terms")
    keep = [c for c in docs.columns if c not in (*added, text_col)]
    model, counted = _fit(docs, labels, label_col, usable, id_col, text_col, keep, max_per_label, k)
    sent = docs.sparkSession.sparkContext.broadcast(model.packed())
    del model
    id_type = dict(docs.dtypes)[id_col]

    @arrow_udf(f"score double, nearest double, evidence_ids array<{id_type}>, evidence_terms array<string>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Examples.unpacked(sent.value)
        for b in batches:
            t, n, rest = b.flatten()
            yield m.scored(t.flatten().to_numpy(), n.flatten().to_numpy(), t.value_lengths().to_numpy(), rest.to_numpy())
        give_back()

    scored = counted.select(*[F.col(f"`{c}`") for c in keep], score(F.col("__terms")).alias("__p"))
    return scored.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__p.{c}") for c in added])


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared checkpoint folder, and read again; numbers in order are stored as differences."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/counted-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
