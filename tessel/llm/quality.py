"""Quality scores: random-indexing word vectors, pooled, and a two-layer numpy network.

Words fall into BUCKETS by a hash, and their shapes (first and last character, capitals,
length, whether the word before is the same) into SHAPES.  Every bucket and shape has a
sparse random index vector; its context vector is the sum of the index vectors of the
words within NEAR places of it, over all documents of the corpus.  A document is the mean
of its words' unit context vectors and the mean and spread of its words' shapes' vectors.
The network (one hidden layer) learns from at most FIT_ROWS rows of each label; a part of
them is set aside to choose the temperature that calibrates its probabilities.

Defined results: null and empty texts, and texts without words, are the zero vector and
score as such; with fewer than two labels in the training rows every score is the label's
share (0 without any).  Rows with a null id are scored like others and aren't held out;
repeated rows give a row each, and count in the corpus each time; of repeated labels of one
id the largest counts; other columns of docs don't matter, whatever their names; an empty
table gives an empty one.

BUCKETS is a size of the model at every size of the corpus: rarer words share vectors, and
the more words there are the more a bucket's vector tends to the corpus' mean; the shapes
then tell most.  README says what each part gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .labelled import held_out, row_weights, sample, sigmoid
from .store import Store

FIT_ROWS = 4000
SHAPES, BUCKETS, SIZE, NEAR, HIDDEN = 512, 3584, 32, 2, 32
#: Bytes of text in a block, and words whose vectors are held at once.
BLOCK_BYTES, SLICE = 1 << 19, 1 << 15

_rng = np.random.default_rng(4711)
INDEX = ((_rng.random((SHAPES + BUCKETS, SIZE)) < 0.25) * _rng.choice([-1.0, 1.0], (SHAPES + BUCKETS, SIZE))).astype(np.float32)

#: Kinds of bytes: capital, small letter, digit, mark of a sentence, other sign, not ASCII.
_KIND = np.full(256, 4, dtype=np.int64)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 5
_KIND[[ord(c) for c in ".,;:?"]] = 3
_LENGTH = np.searchsorted([2, 4, 7, 11, 16], np.arange(64), side="right")


def describe(block: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape, bucket, row) of each word; buckets come after the shapes."""
    rows = block.word_rows()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    kinds = _KIND[block.buf]
    small = np.concatenate([[0], np.cumsum(kinds == 1)])
    large = np.concatenate([[0], np.cumsum(kinds == 0)])
    hashes = block.hashes()
    same = np.zeros(len(rows), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    caps = ((small[block.ends] - small[block.starts] == 0) & (large[block.ends] - large[block.starts] >= 2)).astype(np.int64)
    first, last = np.minimum(kinds[block.starts], 4), kinds[block.ends - 1]
    last = np.select([last <= 1, last == 5, last == 2], [0, 0, 1], last - 1)
    length = _LENGTH[np.minimum(block.ends - block.starts, 63)]
    shape = (((first * 4 + last) * 2 + caps) * 6 + length) * 2 + same
    return shape, SHAPES + (hashes % np.uint64(BUCKETS)).astype(np.int64), rows


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vectors of all shapes and buckets, over all documents.

    A task adds up its own sums and emits one row of numbers for each name it met; the
    rows, SHAPES + BUCKETS at most for each task, are summed by name.
    """

    def run(batches):
        total = np.zeros((SHAPES + BUCKETS, SIZE))
        for batch in batches:
            for _, _, block in tx.blocks(batch.column(0), tx.NOT_SPACE, max_bytes=BLOCK_BYTES):
                shape, bucket, rows = describe(block)
                if not len(rows):
                    continue
                for lo in range(0, len(rows), SLICE):
                    hi = min(lo + SLICE, len(rows))
                    a, b = max(0, lo - NEAR), min(len(rows), hi + NEAR)
                    own, at = INDEX[shape[a:b]] + INDEX[bucket[a:b]], rows[a:b]
                    near = np.zeros_like(own)
                    for k in range(1, NEAR + 1):
                        if len(at) > k:
                            inside = (at[k:] == at[:-k])[:, None]
                            near[:-k] += own[k:] * inside
                            near[k:] += own[:-k] * inside
                    near = near[lo - a : hi - a]
                    for name in (shape[lo:hi], bucket[lo:hi]):
                        by = np.argsort(name, kind="stable")
                        ids, first = np.unique(name[by], return_index=True)
                        total[ids] += np.add.reduceat(near[by], first, axis=0)
        met = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(total[met, i]) for i in range(SIZE))], names=["name", *(f"x{i}" for i in range(SIZE))])

    sums = docs.select(F.col(text_col)).mapInArrow(run, "name long, " + ", ".join(f"x{i} double" for i in range(SIZE))).groupBy("name").agg(*(F.sum(f"x{i}") for i in range(SIZE)))
    out = np.zeros((SHAPES + BUCKETS, SIZE))
    for row in sums.collect():
        out[row[0]] = row[1:]
    # unit vectors; summation order alters the last digits, so they are rounded
    return np.round(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), 6)


def pool(block: tx.Block, vectors: np.ndarray) -> np.ndarray:
    """One row of 5 * SIZE numbers for each document."""
    shape, bucket, rows = describe(block)
    out = np.zeros((len(block), 5 * SIZE))
    for lo in range(0, len(rows), SLICE):
        at, k, v = rows[lo : lo + SLICE], shape[lo : lo + SLICE], vectors[bucket[lo : lo + SLICE]]
        full, first = np.unique(at, return_index=True)
        for i, x in enumerate((v, vectors[k], INDEX[k], INDEX[bucket[lo : lo + SLICE]], v * v)):
            out[full, i * SIZE : (i + 1) * SIZE] += np.add.reduceat(x, first, axis=0, dtype=np.float64)
    out /= np.maximum(np.diff(block.first), 1)[:, None]
    mean, squares = out[:, :SIZE], out[:, 4 * SIZE :]
    out[:, 4 * SIZE :] = np.sqrt(np.maximum(squares - mean**2, 0))
    return out


class Network:
    """Two layers of weights; tanh between them; a logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, hidden: int = HIDDEN, steps: int = 400):
        rng = np.random.default_rng(1)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        aside = np.arange(len(y)) % 5 == 4
        if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
            aside[:] = False
        self.p = [rng.standard_normal((z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        a, b, w = z[~aside], y[~aside], weights[~aside] / len(y[~aside])
        self.temperature = 1.0
        for step in range(1, steps + 1):
            h = np.tanh(a @ self.p[0] + self.p[1])
            d = w * (sigmoid(h @ self.p[2] + self.p[3]) - b)
            back = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-3 * self.p[0] / len(b) ** 0.5, back.sum(axis=0), h.T @ d + 1e-3 * self.p[2] / len(b) ** 0.5, np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
        if aside.any():
            logits, own, w = self._logits(z[aside]), y[aside], weights[aside]
            # targets as far from 0 and 1 as so few rows can tell, or rows without errors would ask for no temperature at all
            target = np.where(own == 1, (own.sum() + 1) / (own.sum() + 2), 1 / ((1 - own).sum() + 2))
            loss = lambda t: -(w * (target * np.log(sigmoid(logits / t)) + (1 - target) * np.log(sigmoid(-logits / t)))).sum()
            self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._logits(self._scaled(x)) / self.temperature)


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _pooled(rows: DataFrame, keep: list[str], vectors: np.ndarray, finish) -> tuple:
    sent = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            for lo, hi, block in tx.blocks(batch.column("text"), tx.NOT_SPACE, max_bytes=BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), finish(pool(block, sent.value))], names=[*keep, "out"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network | Constant]:
    """(the context vectors, the network)."""
    store = Store(docs.sparkSession, "quality")
    vectors = contexts(docs, text_col)
    rows, counts = sample(store, docs, labels, label_col, fit_rows, id_col, text_col)
    listed = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    known = rows.mapInArrow(_pooled(rows, ["y"], vectors, listed), "y int, out array<float>").collect()
    store.drop(*store.paths)
    known.sort(key=lambda r: (r.y, r.out))
    order = np.random.default_rng(2).permutation(len(known))
    x, y = np.array([known[i].out for i in order], dtype=np.float64), np.array([known[i].y for i in order])
    if len(set(y.tolist())) < 2:
        total = sum(counts.values())
        return vectors, Constant(counts.get(1, 0) / total if total else 0.0)
    return vectors, Network(x, y, row_weights(y, counts))


def score(docs: DataFrame, model: tuple[np.ndarray, Network | Constant], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row."""
    vectors, network = model
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _pooled(rows, ["id"], vectors, lambda x: pa.array(network.scores(x)))
    return rows.mapInArrow(run, f"id {kind}, out double").select(F.col("id").alias(id_col), F.col("out").alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
