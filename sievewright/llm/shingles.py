"""Near-duplicate documents by the Jaccard similarity of their word shingles: candidates from SimHash fingerprints (bit
slices) and from MinHash bands, then exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import links as close_fingerprints
from .util import components, cut, map_batches, slices

#: A pair of similarity s shares a band with the chance 1 - (1 - s ** ROWS) ** BANDS: 0.999997 at 0.8, more above.
BANDS, ROWS = 24, 4
#: Shingles that are hashed at a time.
SLAB = 4096

_made = np.random.default_rng(42).integers(0, 2**63, (3, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
XOR, TIMES, JOIN = _made[0], _made[1], _made[2].reshape(BANDS, ROWS)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles; words end and are lowered as for fingerprints. A text
    of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((digest(joined[starts[i] : ends[min(i + size, len(words)) - 1] - 1]) for i in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key per band, which two sets share if their least values under all of the band's hashes are equal."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLAB):
        least = np.minimum(least, ((hashes[at : at + SLAB, None] ^ XOR) * TIMES).min(axis=0))
    keys = ((least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * JOIN).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))) * TIMES[:BANDS] + XOR[:BANDS]


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            keep = np.zeros(len(x), bool)
            for k, (p, q) in enumerate(zip(x, y, strict=True)):
                both = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                keep[k] = both >= threshold * ((len(p) + len(q)) // 8 - both) - 1e-9
            yield {"a": b.column(0).to_numpy()[keep], "b": b.column(1).to_numpy()[keep]}

    n = lambda c: F.octet_length(c)
    wide = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(F.least(n("x"), n("y")) >= threshold * F.greatest(n("x"), n("y")) - 1e-6)
    return map_batches(wide.select("a", "b", "x", "y"), run, "a long, b long")


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: the bits set in over half of them."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, h (hash of the text), component_id (smallest doc_id reachable), kept (the first row of its component, by
    doc_id, those without one last, then h); links are pairs of at least the threshold.

    Equal sets are one node before any comparison, so copies are never paired up; texts without words are one node
    too. Candidates are fingerprints within the radius and sets that share a MinHash band. Every such pair is checked
    unless links found before connect it already: first each node against the least of its bands and fingerprints,
    then what is left between different components. Rows that repeat another's doc_id and text are kept or not as it
    is; rows that share a doc_id with different texts are told apart by h. No rows give no rows; other columns are
    ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 512):
            made = [shingles(t, size) for t in b.column(1).to_pylist()]
            yield {
                "doc_id": b.column(0), "h": b.column(2), "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in made], np.uint64).view(np.int64),
                "fp": np.array([fingerprint(s) for s in made], np.uint64).view(np.int64), "keys": [bands(s).view(np.int64) if len(s) else None for s in made], "text": b.column(1),
            }

    def hashed(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 512):
            yield {"node": b.column(0), "s": [shingles(t, size).tobytes() for t in b.column(1).to_pylist()]}

    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    prints, _ = cut(map_batches(base, run, "doc_id long, h long, node long, fp long, keys array<long>, text string"), "shingles")
    once = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("first"))
    entries = prints.select("node", F.explode("keys").alias("key")).distinct()
    shared = entries.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    met, _ = cut(entries.join(shared, "key"), "bands")
    # fingerprints: equal ones by their least node, close ones by the least nodes of both
    by_print = prints.select("fp", "node").distinct()
    least = by_print.groupBy("fp").agg(F.min("node").alias("least"))
    equal = by_print.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = close_fingerprints(by_print.select("fp").distinct(), radius).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    banded = met.select(F.col("node").alias("a"), F.col("least").alias("b"))
    either = banded.union(equal).union(close).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars, _ = cut(either.distinct(), "stars")
    wanted = met.select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    # any text of a node has the node's set
    sets, _ = cut(map_batches(prints.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]), hashed, "node long, s binary"), "sets")
    links, _ = cut(similar(stars, sets, threshold), "links")
    roots = components(links, "stars")
    apart = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left, _ = cut(apart.join(mixed, "key", "left_semi"), "apart")
    pairs = left.toDF("key", "a", "p").join(left.toDF("key", "b", "q"), "key").where("a > b and p <> q").select("a", "b").distinct()
    more = similar(pairs.join(stars, ["a", "b"], "left_anti"), sets, threshold)
    joined = once.join(components(links.unionByName(more), "shingles").withColumnRenamed("root", "top"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    named = joined.groupBy("top").agg(F.min("first_id").alias("component_id"), F.min("first").alias("first"))
    by_node = joined.select("node", "top").join(named, "top").select("node", "component_id", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return prints.select("doc_id", "h", "node").join(by_node, "node").select("doc_id", "h", "component_id", kept.alias("kept"))
