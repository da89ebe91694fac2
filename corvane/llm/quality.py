"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded to a fixed
vector of surface measures; a small network maps the vector to a hidden state, gated
attention (tanh and sigmoid branches, softmax over the document's passages) weighs the
states, and a logistic layer scores their weighted sum. Only documents have labels; which
passages matter is learnt from them.

The network is fitted on a bounded sample of labelled documents (``max_documents``, and of
each ``bag_passages`` passages drawn at random where they lie); scoring reads every document
and every passage where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PASSAGE_WORDS = 64
#: Documents encoded at once: so few that the working arrays stay in a core's cache.
SLICE = 32
#: Byte classes; other bytes of ASCII punctuation are one class of their own.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"%", b"*&#", b"$", b"'\"", b"()[]{}", b"<>", b"-_", b":;", b"/\\", b"=+~^", b"@")
N_CLASSES = len(CLASSES) + 1
WORD_MEASURES = 8
WIDTH = N_CLASSES + WORD_MEASURES
_TABLE = np.full(256, N_CLASSES - 1, np.int64)
for _i, _c in enumerate(CLASSES):
    _TABLE[list(_c)] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_POWERS = [np.zeros(0, np.uint64)] * 2
#: Powers that a worker keeps; more are made anew for a long text.
_KEEP = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) >= n:
        return [p[:n] for p in _POWERS]
    made = [np.cumprod(np.full(n, base, np.uint64)) for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))]
    if n <= _KEEP:
        _POWERS[:] = made
    return made


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a batch and the row each belongs to, in order of rows; a text without words is one passage of zeros."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = offsets[0] if len(texts) else 0
    n = int(offsets[-1] - base) if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + n] if n else np.zeros(0, np.uint8)
    bounds = offsets - base
    gap = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    row = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(row, minlength=len(texts))
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    new = nth % PASSAGE_WORDS == 0
    passage = np.cumsum(new) - 1
    owner, first = row[new], np.flatnonzero(new)
    k = len(owner)
    x = np.zeros((k, WIDTH))
    if k:
        count = np.diff(np.append(first, len(starts)))
        # Each byte from a passage's first word up to the next passage or the end of the text belongs to it.
        to = np.append(starts[first[1:]], n)
        to = np.minimum(to, bounds[owner + 1])
        size = to - starts[first]
        which = np.repeat(np.arange(k), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[first], size)
        x[:, :N_CLASSES] = np.bincount(which * N_CLASSES + _TABLE[data[at]], minlength=k * N_CLASSES).reshape(k, N_CLASSES) / size[:, None]
        # A polynomial hash of every word from wrapping prefix sums.
        with np.errstate(over="ignore"):
            power, inverse = _powers(n + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * power[:n])])
            code = (total[ends] - total[starts]) * inverse[starts]
            pair = code[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + code[:-1]
        mean = lambda v, p=passage: np.bincount(p, v, minlength=k) / count
        length = ends - starts
        same = np.zeros(len(starts))
        same[1:] = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
        last, head = data[ends - 1], data[starts]
        inner = passage[1:] == passage[:-1]

        def distinct(p: np.ndarray, h: np.ndarray) -> np.ndarray:
            if not len(p):
                return np.zeros(k)
            key = np.sort((p.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=k)

        upper = (data >= 65) & (data <= 90)
        uppers = np.concatenate([[0], np.cumsum(upper)])
        measures = (
            mean(length) / 10,
            np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)) / 10,
            mean(same),
            distinct(passage, code) / count,
            distinct(passage[1:][inner], pair[inner]) / np.maximum(1, count - 1),
            mean((head >= 65) & (head <= 90)),
            mean((uppers[ends] - uppers[starts]) * 2 > length),
            mean((_TABLE[last] != 0) & (_TABLE[last] != 1) & (_TABLE[last] != 3)),
        )
        x[:, N_CLASSES:] = np.stack(measures, axis=1)
    empty = np.flatnonzero(words == 0)
    x, owner = np.vstack([x, np.zeros((len(empty), WIDTH))]), np.concatenate([owner, empty])
    order = np.argsort(owner, kind="stable")
    return x[order], owner[order]


@dataclass
class Model:
    """Weights of the network; ``prior`` alone answers where nothing could be learnt."""

    prior: float
    weights: dict | None = None

    def score(self, x: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        if self.weights is None:
            return np.full(rows, self.prior)
        return _forward(self.weights, (x - self.weights["mean"]) / self.weights["scale"], owner, rows)["p"]


def _forward(w: dict, x: np.ndarray, owner: np.ndarray, rows: int) -> dict:
    h = np.tanh(x @ w["W"] + w["b"])
    a, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (a * g) @ w["w"]
    first = np.searchsorted(owner, np.arange(rows))
    e = np.exp(s - np.maximum.reduceat(s, first)[owner])
    alpha = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(alpha[:, None] * h, first)
    return {"h": h, "a": a, "g": g, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))}


def gradients(w: dict, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of bags, with respect to every weight."""
    rows = len(y)
    f = _forward(w, x, owner, rows)
    dy = (f["p"] - y) / rows
    dz = dy[:, None] * w["c"]
    dh = f["alpha"][:, None] * dz[owner]
    da = (f["h"] * dz[owner]).sum(1)
    ds = f["alpha"] * (da - np.bincount(owner, f["alpha"] * da, minlength=rows)[owner])
    dag = ds[:, None] * w["w"]
    dta = dag * f["g"] * (1 - f["a"] ** 2)
    dtg = dag * f["a"] * f["g"] * (1 - f["g"])
    dh = (dh + dta @ w["V"].T + dtg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ dy, "d": dy.sum(), "w": (f["a"] * f["g"]).T @ ds, "V": f["h"].T @ dta, "U": f["h"].T @ dtg, "W": x.T @ dh, "b": dh.sum(0)}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the mean log loss over all bags, with the gradients of the network written out."""
    rows = len(y)
    prior = float((y.sum() + 1) / (rows + 2))
    if rows == 0 or y.min() == y.max():
        return Model(prior)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    init = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
    w = {"W": init(x.shape[1], hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(t) for k, t in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        grad = gradients(w, x, owner, y)
        for k in w:
            grad[k] = grad[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(prior, w | {"mean": mean, "scale": scale})


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = 3000, bag_passages: int = 64) -> Model:
    """Fits the network on at most ``max_documents`` labelled documents for which ``use`` (over the labels) holds.

    They are those of smallest hash of the id, so a rerun takes the same ones. Of a document
    with more than ``bag_passages`` passages so many are drawn at random for the fit, in the
    task that reads it and alike on every run, so that a long text pushes no other out and
    the driver gets ``max_documents * bag_passages`` vectors at most. Rows with a null id or
    label teach nothing. Without both labels the model is the labels' share.
    """
    chosen = (
        labels.filter(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("string").alias("_id"))
        .agg(F.max(F.col(label_col).cast("double")).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_documents)
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, _ = encode(b.column(2).slice(i, 1))
                if len(x) > bag_passages:
                    x = x[np.sort(np.random.default_rng(len(x)).choice(len(x), bag_passages, replace=False))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["id", "y", "x"])

    bags = docs.select(F.col(id_col).cast("string").alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text").mapInArrow(encoded, "id string, y double, x binary")
    # Of rows with one id the smallest bag counts.
    bags = bags.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("id")
    if not len(bags):
        return Model(0.5)
    bags["x"] = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in bags["x"]]
    owner = np.repeat(np.arange(len(bags)), bags["x"].map(len))
    return fit(np.vstack(bags["x"]).astype(float), owner, bags["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, score in 0 to 1, passages. Null and empty texts are one empty passage and get a score too."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, passages = [], []
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                x, owner = encode(part.column(1))
                out.append(model.score(x, owner, part.num_rows))
                passages.append(np.bincount(owner, minlength=part.num_rows))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out)), pa.array(np.concatenate(passages).astype(np.int64))], names=["id", "score", "passages"])

    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(scored, f"id {base.schema['id'].dataType.simpleString()}, score double, passages bigint").withColumnRenamed("id", id_col)
