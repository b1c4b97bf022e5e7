"""Toxicity: log-odds of words under Dirichlet priors, maximum-scoring segments, extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import map_batches, slices

#: Labelled documents that the model is fitted on at most: those with the smallest hashes of their ids.
TRAIN_DOCS = 20_000
#: Pseudo-documents of the prior, spread over units as the labelled documents have them.
PRIOR = 50.0
#: A unit is listed if its log-odds are this many standard deviations above zero.
Z_MIN = 3.0
#: What a word that isn't listed takes from a segment's score.
DRIFT = 0.5
#: Tokens that a worker remembers; units that a training task counts before it sends them on.
REMEMBERED, COUNTED = 200_000, 500_000
#: Documents of a batch that are scored at a time.
SLICE = 256

LETTERS = re.compile(r"[^\W\d_]+")
#: Scores of tokens of a few words, none of them listed.
PLAIN = [(-DRIFT,) * k for k in range(8)]


def units(word: str) -> list[str]:
    """A word counts as itself and as its beginnings of four and five letters, for inflected and compound forms."""
    return [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n)]


def words(token: str) -> list[str]:
    return LETTERS.findall(token.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time: each candidate keeps the sums up to
    its two ends and the nearest earlier candidate with a smaller sum before it; whatever a search passes over is
    never looked at again, since the candidate that searched links past it or takes it in."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before start, sum at end, link
    upto = np.concatenate([[0.0], np.cumsum(scores)]).tolist()
    for at in np.nonzero(scores > 0)[0].tolist():
        start, before, total, k = at, upto[at], upto[at + 1], len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            start, _, before, _, link = found[k]
            del found[k:]
            k = link
        found.append((start, at + 1, before, total, k))
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


@dataclass
class Model:
    """listed: log-odds by unit; rate, scale: the extreme-value law of a clean text's best segment, whose
    chance of a score S in n words is 1 - exp(-scale * n * exp(-rate * S)); weights: the logistic calibration."""

    listed: dict[str, float]
    rate: float
    scale: float
    weights: tuple[float, float]

    def word_score(self, word: str) -> float:
        return max((self.listed[u] for u in units(word) if u in self.listed), default=-DRIFT)

    def features(self, texts: list[str | None], memory: dict[str, tuple[float, ...]]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Per text the evidence (excess of the significant segments over what clean texts of that length
        reach, repeats damped) and these segments, not damped, in words counted from 0."""
        for text in texts:
            flat: list[float] = []
            for token in (text or "").split():
                got = memory.get(token)
                if got is None:
                    if len(memory) > REMEMBERED:
                        memory.clear()
                    got = tuple([self.word_score(w) for w in words(token)])
                    got = memory[token] = PLAIN[len(got)] if got in PLAIN else got  # one object for all unlisted words
                flat += got
            scores = np.array(flat)
            out, excess = [], 0.0
            if len(scores) and scores.max() > 0:
                noise = math.log(max(self.scale * len(scores), 1.0))
                out = [x for x in segments(scores) if self.rate * x[2] > noise]
                excess = sum(max(0.0, self.rate * fresh - noise) for fresh in self.damped(text, scores, out))
            yield math.log1p(excess), out

    @staticmethod
    def damped(text: str | None, scores: np.ndarray, found: list[tuple[int, int, float]]) -> list[float]:
        """The segments' scores where a word's k-th occurrence in them scores a k-th of the first: repeats are no
        independent evidence, though every one is a passage."""
        seen: Counter[str] = Counter()
        flat = [w for token in (text or "").split() for w in words(token)] if found else []
        out = []
        for s, e, score in found:
            for at in (np.nonzero(scores[s:e] > 0)[0] + s).tolist():
                seen[flat[at]] += 1
                score -= scores[at] * (1 - 1 / seen[flat[at]])
            out.append(float(score))
        return out

    def probability(self, evidence: float) -> float:
        z = self.weights[0] + self.weights[1] * evidence
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the penalty keeps separable classes finite."""
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(2), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """doc_id, text, y of the training documents: at most `limit` labelled ids (a bounded table, so it may be
    broadcast), the smallest by hash. Of contradictory labels of an id, the larger holds."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(train)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, limit: int = TRAIN_DOCS) -> Model:
    rows = sample(docs, labels, label, bucket(F.col("doc_id"), folds) != held_out, limit)
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text"))  # copies weigh once

    def count(batches: Iterator[pa.RecordBatch]):
        # u null: the number of documents and words
        seen: list[Counter[str]] = [Counter(), Counter()]
        docs_words = np.zeros((2, 2), np.int64)
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                own: set[str] = set()
                tokens = (text or "").split()
                for token in set(tokens):
                    for w in words(token):
                        own.update(units(w))
                seen[y].update(own)
                docs_words[y] += 1, len(tokens)
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield from flush(seen)
        yield from flush(seen)
        yield {"u": [None, ""], "n0": docs_words[0], "n1": docs_words[1]}

    def flush(seen: list[Counter[str]]):
        for y in (0, 1):
            yield {"u": list(seen[y]), "n0": [0 if y else n for n in seen[y].values()], "n1": [n if y else 0 for n in seen[y].values()]}
            seen[y].clear()

    counts = map_batches(rows, count, "u string, n0 long, n1 long").groupBy("u").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts.persist()
    try:
        totals = {r.u: (r.n0, r.n1) for r in counts.where("u is null or u = ''").collect()}
        if not totals:
            return Model({}, 1.0, 1.0, (-2.0, 1.0))
        (clean_docs, toxic_docs), (clean_words, _) = totals[None], totals[""]
        # The counts are of documents, so that a word that one document repeats weighs once; the prior's counts
        # follow the unit's share of all labelled documents.
        alpha = F.lit(PRIOR / max(1, clean_docs + toxic_docs)) * (F.col("n0") + F.col("n1"))
        c1, c0 = F.col("n1") + alpha, F.col("n0") + alpha
        delta = F.log(c1 / (toxic_docs + PRIOR - c1)) - F.log(c0 / (clean_docs + PRIOR - c0))
        z = delta / F.sqrt(1 / c1 + 1 / c0)
        listed = counts.where("u <> ''").select("u", "n0", "n1", delta.alias("delta"), z.alias("z")).where((F.col("z") >= Z_MIN) & (F.col("delta") > 2 * DRIFT)).collect()
    finally:
        counts.unpersist()
    table = {r.u: float(r.delta) for r in listed}
    # Under the clean law a word scores delta with its smoothed clean share, else -DRIFT: the rate solves E[exp(rate * s)] = 1.
    shares = [(float(r.delta), (r.n0 + 0.5) / (clean_words + 1.0)) for r in listed]
    clean = lambda rate: sum(p * math.exp(min(700, rate * s)) for s, p in shares) + max(0.0, 1 - sum(p for _, p in shares)) * math.exp(-rate * DRIFT) - 1
    low, high = 1e-3, 1.0
    while clean(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if clean(mid) < 0 else (low, mid)
    rate = max(low, 1e-2)
    model = Model(table, rate, max(1e-6, sum(p for _, p in shares)), (0.0, 1.0))

    def feature(batches: Iterator[pa.RecordBatch]):
        memory: dict[str, tuple[float, ...]] = {}
        for b in batches:
            yield {"x": [x for x, _ in model.features(b.column("text").to_pylist(), memory)], "y": b.column("y")}

    got = map_batches(rows.select("text", "y"), feature, "x double, y int").toPandas()
    if got["y"].nunique() == 2:
        model.weights = logistic(got["x"].to_numpy(), got["y"].to_numpy().astype(float))
    else:
        model.weights = (-2.0 if not got["y"].any() else 2.0, 1.0)
    return model


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns in `keep`, score, predicted and passages: JSON-like "start-end:score" of every significant
    segment, in words from 0, comma-joined. Null and empty texts score as texts without evidence."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int, passages string"])
    sent = [*keep, *([] if text in keep else [text])]

    def run(batches: Iterator[pa.RecordBatch]):
        m, memory, at = known.value, {}, sent.index(text)
        for b in slices(batches, SLICE):
            got = list(m.features(b.column(at).to_pylist(), memory))
            p = [m.probability(x) for x, _ in got]
            yield {c: b.column(k) for k, c in enumerate(keep)} | {
                "score": p, "predicted": [int(x >= 0.5) for x in p], "passages": [",".join(f"{s}-{e}:{v:.3f}" for s, e, v in segs) for _, segs in got]
            }

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in sent]), run, ddl)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, as they are. Every column goes through the scoring once."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names may clash or hold signs that a schema's text can't

    def run(batches: Iterator[pa.RecordBatch]):
        m, memory, at = known.value, {}, names.index(text)
        for b in slices(batches, SLICE):
            good = b.filter(pa.array([m.probability(x) < 0.5 for x, _ in m.features(b.column(at).to_pylist(), memory)], pa.bool_()))
            yield {f"c{k}": good.column(k) for k in range(good.num_columns)}

    return map_batches(numbered, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)).toDF(*names)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every document.

    The model learns only from labelled rows of the other folds, texts only. Null or empty texts get the score of
    no evidence. Labels that are null, of unknown or of held-out documents are unused; without any labels every
    document gets one low score. Repeated rows get equal results; no rows give no rows; other columns are ignored,
    whatever their names. A null doc_id counts as empty text in the fold's crc32 (held out)."""
    model = fit(docs, labels, limit=limit)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, ["doc_id"])
    return out.withColumn("held_out", bucket(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "score", "predicted", "passages")
