"""Quality classifier: random-indexing word vectors, pooled per document, and a small numpy network.

Random indexing gives every token a sparse random index vector from a hash of
the token; a token's word vector is its index vector plus the normalised sum of
the index vectors of its neighbours in the training sample. A document is pooled
to the mean of its word vectors and the mean product of neighbouring index
vectors (high where tokens repeat side by side). A network with one hidden layer
scores the pooled vector; its logit is divided by a temperature fitted on
held-back training rows.

Only the fit uses a bounded sample (``max_per_label`` labelled rows of each
class, ``max_words`` word vectors); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskframe.llm.common import give_back, labelled_sample, ship_by_value
from riskframe.session import cut_lineage

ship_by_value(__name__)

#: Word runs and symbol runs.
TOKEN = re.compile(r"\w+|[^\w\s]+")
DIMS, NONZERO, BUCKETS, CHUNK = 64, 8, 8192, 8192
SIZE = 2 * DIMS + 1
#: A text of this many tokens is moved half-way to the average text: a few tokens say little about quality.
HALF_TOKENS = 16.0


def index_vectors() -> np.ndarray:
    """(BUCKETS, DIMS) sparse random vectors of unit length, from a fixed seed."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out / math.sqrt(NONZERO)


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def neighbour_sums(words: dict[str, int]):
    """Pandas function (texts) -> (row, v): the task's sum of the neighbours' index vectors of each known word it has met."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_vectors()
        total = np.zeros((len(words), DIMS), np.float64)
        for batch in batches:
            for text in batch["t"]:
                tokens = TOKEN.findall(text or "")
                rows = np.array([words.get(w, -1) for w in tokens], np.int64)
                vec = index[[bucket(w) for w in tokens]] if tokens else np.zeros((0, DIMS), np.float32)
                for at, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                    known = rows[at] >= 0
                    np.add.at(total, rows[at][known], vec[other][known])
        met = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"row": met, "v": pd.Series(list(total[met]), dtype=object)})
        give_back()

    return run


def pool(text: str | None, rows: dict[str, int], table: np.ndarray, index: np.ndarray, seen: dict[str, tuple[int, int]]) -> np.ndarray:
    """Pooled vector of a whole text (SIZE): mean word vector, mean neighbour product, share of words; then the number of tokens."""
    out = np.zeros(SIZE + 1, np.float64)
    n = words = 0
    carry: list[str] = []
    known = len(rows)
    tokens = TOKEN.findall(text or "")
    for at in range(0, len(tokens), CHUNK):
        part = tokens[at:at + CHUNK]
        ids = []
        for w in part:
            p = seen.get(w)
            if p is None:
                b = bucket(w)
                p = (rows.get(w, known + b), b)
                if len(seen) > 100_000:
                    seen.clear()
                seen[w] = p
            ids.append(p)
        a = np.array(ids, np.int64)
        out[:DIMS] += table[a[:, 0]].sum(0)
        buckets = np.concatenate([np.array([bucket(w) for w in carry], np.int64), a[:, 1]])
        v = index[buckets]
        out[DIMS:2 * DIMS] += np.einsum("ij,ij->j", v[1:], v[:-1])
        carry = part[-1:]
        n += len(part)
        words += sum(w[0].isalnum() for w in part)
    if n:
        out[:DIMS] /= n
        out[DIMS:2 * DIMS] /= max(1, n - 1)
        out[SIZE - 1] = words / n
    out[SIZE] = n
    return out


def centred(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised pooled vectors, shrunk to the average text by their number of tokens."""
    n = x[:, SIZE:]
    return (x[:, :SIZE] - mean) / scale * (n / (n + HALF_TOKENS))


@dataclass
class Model:
    """Everything that scoring needs; a few megabytes, whatever the size of the corpus."""

    rows: dict[str, int]
    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def table(self, index: np.ndarray) -> np.ndarray:
        """Word vectors of the known words, then the index vectors for all others."""
        return np.concatenate([self.context, index])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(centred(x, self.mean, self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, prior: float, hidden: int = 32, epochs: int = 80, batch: int = 128,
                rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> dict:
    """Two-layer network (Adam, weighted to the classes' true shares) and its temperature, fitted on a fifth held back.

    With no rows or one class the network is a constant: the share of label 1.
    """
    d = SIZE
    flat = {"mean": np.zeros(d), "scale": np.ones(d), "w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros(1),
            "b2": 0.0, "temperature": 1.0}
    if len(y) == 0:
        return flat
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return flat | {"b2": float(np.log(share / (1 - share)))}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, train = order[:max(1, len(y) // 5)], order[max(1, len(y) // 5):]
    mean, scale = x[train, :SIZE].mean(0), x[train, :SIZE].std(0) + 1e-3
    z = centred(x, mean, scale)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    p = [rng.normal(0, 1 / math.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            h = np.tanh(z[at] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[at]) * weight[at] / len(at)
            gh = np.outer(err, p[2]) * (1 - h * h)
            grads = [z[at].T @ gh + decay * p[0], gh.sum(0), h.T @ err + decay * p[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = np.tanh(z[back] @ p[0] + p[1]) @ p[2] + p[3][0]

    def loss(temp):
        s = logit / temp
        return float(np.sum(weight[back] * (np.logaddexp(0, s) - y[back] * s)))

    temperature = min((2.0 ** (k / 4) for k in range(-8, 17)), key=loss)
    return {"mean": mean, "scale": scale, "w1": p[0], "b1": p[1], "w2": p[2], "b2": float(p[3][0]), "temperature": temperature}


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                max_per_label: int = 2500, max_words: int = 8192, min_count: int = 5) -> Model:
    """Fit on at most ``2 * max_per_label`` labelled rows for which ``usable`` (an expression on ``labels``) holds."""
    sample = labelled_sample(labels, label_col, usable, id_col, max_per_label)
    shares = labels.filter(usable & F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(sample), "id")
    texts = cut_lineage(texts.select("t", "y").repartition(4))  # a bounded sample, read from the documents once
    counts = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))).alias("w"))
    top = counts.groupBy("w").count().filter(F.col("count") >= min_count).orderBy(F.col("count").desc(), "w").limit(max_words).collect()
    rows = {r["w"]: k for k, r in enumerate(top)}
    index = index_vectors()
    context = np.zeros((len(rows), DIMS))
    sums = texts.select("t").mapInPandas(neighbour_sums(rows), "row long, v array<double>").groupBy("row").agg(
        F.array(*[F.sum(F.col("v")[i]) for i in range(DIMS)]).alias("v"))
    for r in sums.collect():  # at most ``max_words`` vectors
        context[r["row"]] = np.round(r["v"], 9)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = index[[bucket(w) for w in rows]] if rows else np.zeros((0, DIMS), np.float32)
    model = Model(rows, (context + own).astype(np.float32), **fit_network(np.zeros((0, SIZE + 1)), np.zeros(0), 0.5))
    pooled = texts.select("y", pooled_vector(model)(F.col("t")).alias("x")).collect()
    x = np.array([np.frombuffer(r["x"], np.float64) for r in pooled]).reshape(-1, SIZE + 1)
    y = np.array([r["y"] for r in pooled], np.float64)
    order = np.lexsort(np.column_stack([x, y]).T[::-1])  # rows arrive in any order; the fit must not depend on it
    return Model(rows, model.context, **fit_network(x[order], y[order], float(shares or 0.5)))


def pooled_vector(model: Model):
    @pandas_udf("binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_vectors()
        table, seen = model.table(index), {}
        for batch in texts:
            yield pd.Series([pool(t, model.rows, table, index, seen).tobytes() for t in batch], dtype=object)
        seen.clear()
        give_back()

    return run


def scorer(model: Model):
    """Column function: text -> score."""
    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_vectors()
        table, seen = model.table(index), {}
        for batch in texts:
            x = np.array([pool(t, model.rows, table, index, seen) for t in batch]).reshape(-1, SIZE + 1)
            yield pd.Series(model.scores(x))
        seen.clear()
        give_back()

    return score


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus score (0 to 1, higher: label 1 likelier).

    * NULL and empty texts get the average text's score, the same for all of them.
    * Repeated rows get equal scores; an empty table gives no rows; other columns pass through, and an existing
      column named ``score`` is replaced.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    return docs.select(*keep, scorer(model)(F.col(text_col)).alias("score"))
