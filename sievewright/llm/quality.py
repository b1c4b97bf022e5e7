"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import bucket, sample
from .util import map_batches, slices

#: Labelled documents that the network is fitted on at most: those with the smallest hashes of their ids.
TRAIN_DOCS = 20_000
#: Words share this many vectors, by hash; what a corpus adds up to is a table of this size.
ROWS = 16_384
#: Dimensions of a word vector, and how many of them an index vector sets.
DIMS, ONES = 32, 4
#: Words to either side that a word's vector adds up.
WINDOW = 2
#: Ids whose surroundings are added up at a time.
SLAB = 200_000
HIDDEN = 32
#: Rows kept for what no word is: capitals, punctuation by kind, digits, repeats.
MARKS = 64
REMEMBERED = 500_000

CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def index_vectors(seed: int = 7) -> np.ndarray:
    """[ROWS, DIMS] of -1, 0, 1: ONES entries of each row are set, signs in balance."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIMS), np.int16)
    at = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :ONES]
    out[np.arange(ROWS)[:, None], at] = np.tile([1, -1], ONES // 2)
    return out


def token_ids(token: str) -> tuple[int, ...]:
    """Ids of a token between blanks: its word in lower case, then a mark for each oddity of its form."""
    before, core, after = CORE.match(token).groups()
    word = core.lower()
    ids = [MARKS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (ROWS - MARKS)] if core else []
    if len(core) > 1 and core == core.upper() and core != word:
        ids.append(0)
    if any(c.isdigit() for c in core):
        ids.append(1)
    ids += [2 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (MARKS - 3) for x in (before, after) if x]
    return tuple(ids)


class Reader:
    """Texts to ids; remembers the tokens it has seen."""

    def __init__(self) -> None:
        self.memory: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str | None) -> np.ndarray:
        memory, flat, last = self.memory, [], None
        if len(memory) > REMEMBERED:
            memory.clear()
        for token in (text or "").split():
            got = memory.get(token)
            if got is None:
                got = memory[token] = token_ids(token)
            flat += got
            if token == last:
                flat.append(MARKS - 1)
            last = token
        return np.array(flat, np.int64)


def contexts(docs: DataFrame, seed: int = 7) -> np.ndarray:
    """[ROWS, DIMS + 1]: for each id the sum of the index vectors of the words around it, over all documents, and
    its count. Every task adds up its own table; the tables meet row by row before the driver sees one of them."""
    index = index_vectors(seed)

    def run(batches: Iterator[pa.RecordBatch]):
        reader, total = Reader(), np.zeros((ROWS, DIMS + 1), np.int64)
        held: list[np.ndarray] = []
        size = 0
        for b in slices(batches, 256):
            for text in b.column(0).to_pylist():
                ids = reader.ids(text)
                if len(ids) > SLAB:  # a text of any length in bounded memory: a slab at a time, with what stands around it
                    for at in range(0, len(ids), SLAB):
                        low = max(0, at - WINDOW)
                        add(total, ids[low : at + SLAB + WINDOW], at - low, at - low + SLAB)
                    continue
                held += [ids, np.full(WINDOW, -1)]
                size += len(ids)
                if size > SLAB:
                    add(total, np.concatenate(held))
                    held, size = [], 0
        if held:
            add(total, np.concatenate(held))
        rows = np.nonzero(total[:, DIMS])[0]
        yield {"row": rows} | {f"c{k}": total[rows, k] for k in range(DIMS + 1)}

    def add(total: np.ndarray, ids: np.ndarray, start: int = 0, end: int | None = None) -> None:
        vectors = np.concatenate([index, np.zeros((1, DIMS), np.int16)])[ids]
        around = np.zeros_like(vectors)
        for k in range(1, WINDOW + 1):
            around[k:] += vectors[:-k]
            around[:-k] += vectors[k:]
        ids, around = ids[start:end], around[start:end]
        order = np.argsort(ids, kind="stable")
        order = order[np.searchsorted(ids[order], 0) :]
        if not len(order):
            return
        ranked = ids[order]
        starts = np.concatenate([[0], np.nonzero(ranked[1:] != ranked[:-1])[0] + 1])
        total[ranked[starts], :DIMS] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)
        total[ranked[starts], DIMS] += np.diff(np.concatenate([starts, [len(ranked)]]))

    cols = [f"c{k}" for k in range(DIMS + 1)]
    parts = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "row int, " + ", ".join(f"{c} long" for c in cols))
    sums = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    out = np.zeros((ROWS, DIMS + 1))
    out[sums["row"].to_numpy(int)] = sums[cols].to_numpy(float)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of what sets a word's surroundings apart from the corpus's."""
    count = sums[:, DIMS]
    mean = sums[:, :DIMS] / np.maximum(count, 1)[:, None]
    mean -= (sums[:, :DIMS].sum(axis=0) / max(1.0, count.sum()))[None, :]
    mean[count == 0] = 0
    own = index_vectors(11).astype(float) / np.sqrt(ONES)  # the word itself, beside its surroundings
    v = mean / np.maximum(np.sqrt((mean**2).sum(axis=1, keepdims=True)), 1e-12)
    return np.concatenate([v, own], axis=1).astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, shares of the marks, and the logarithm of its length."""
    d = vectors.shape[1]
    out = np.zeros(2 * d + 5, np.float64)
    if len(ids):
        n = np.bincount(ids, minlength=ROWS)
        at = np.nonzero(n)[0]
        w, v = n[at] / len(ids), vectors[at]
        out[:d] = w @ v
        out[d : 2 * d] = np.sqrt(np.maximum(w @ (v * v) - out[:d] ** 2, 0))
        out[2 * d] = np.log1p(len(ids)) / 10
        out[2 * d + 1] = n[0] / len(ids)
        out[2 * d + 2] = n[MARKS - 1] / len(ids)
        out[2 * d + 3] = n[2 : MARKS - 1].sum() / len(ids)
        out[2 * d + 4] = len(at) / len(ids)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60, decay: float = 1e-3) -> Network:
    """Adam on the cross-entropy of nine tenths of the rows; the last tenth sets the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x[(order := rng.permutation(len(x)))], y[order].astype(float)
    own = max(1, len(x) // 10)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if len(np.unique(y)) < 2:
        net.w2[:] = 0
        net.b2 = 3.0 if y.mean() > 0.5 else -3.0
        return net
    z, t = ((x - net.mean) / net.scale)[own:], y[own:]
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for s in range(0, len(z), 128):
            a, target = z[order[s : s + 128]], t[order[s : s + 128]]
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - target) / len(a)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [a.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    logits, truth = net.logit(x[:own]), y[:own]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / g).mean() for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Word vectors come from all documents' texts; the network learns from at most `limit` labelled documents of
    the other folds, by text only. Null or empty texts pool to zeros and get the score of that. Labels that are
    null or of unknown documents are unused; without any labels every document scores 0.5. Repeated rows get
    equal results; no rows give no rows; other columns are ignored, whatever their names. A null doc_id counts as
    empty text in the fold's crc32."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(contexts(base)))

    def feature(batches: Iterator[pa.RecordBatch]):
        reader = Reader()
        for b in batches:
            yield {"x": [pooled(reader.ids(t), vectors.value).tolist() for t in b.column("text").to_pylist()], "y": b.column("y")}

    rows = sample(base, labels, "quality", bucket(F.col("doc_id"), 3) != 1, limit)
    got = map_batches(rows.select("text", "y"), feature, "x array<double>, y int").toPandas()
    net = None
    if len(got):
        x = np.array(got["x"].tolist())
        order = np.lexsort(np.concatenate([x.T, got["y"].to_numpy()[None, :]]))  # whatever order the rows came in
        net = train(x[order], got["y"].to_numpy()[order])
    known = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]):
        reader = Reader()
        for b in batches:
            ids = b.column(0)
            x = np.array([pooled(reader.ids(t), vectors.value) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            p = known.value.probability(x) if known.value and len(x) else np.full(len(x), 0.5)
            yield {"doc_id": ids, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    out = map_batches(base, run, "doc_id long, score double, predicted int")
    return out.withColumn("held_out", bucket(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "score", "predicted")
