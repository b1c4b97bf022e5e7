"""SimHash near-dedup: fingerprints, then bit-sliced comparison of the fingerprints that share bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import components, cut, map_batches

#: The 64 bits are cut into this many runs; two fingerprints within the radius agree on BLOCKS - radius of them.
BLOCKS = 5
#: Rows of a bucket that one chunk takes; larger buckets are compared chunk by chunk.
CHUNK = 4096
#: Pairs of words of 64 fingerprints that are compared at a time.
SLAB = 2048


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words (null and empty ones too)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        shingles = [joined[starts[i] : ends[i + size - 1] - 1] for i in range(len(words) - size + 1)]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(shingles)
    for at in range(0, n, 65536):  # bounded memory for the longest texts
        h = np.array([digest(s, seed) for s in shingles[at : at + 65536]], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fps = np.array([fingerprint(t, size, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """[words, 64 bits]: in row w, word b holds bit b of each of the 64 fingerprints of word w."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8").reshape(-1, 64)


def within(vertical: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """For pairs of words (i, j): [pairs, 64] words whose bit k tells if lane k of word j is within the radius of
    the query lane of word i. Differences are counted by carry-save adders across all lanes at once; pairs whose
    lanes have all passed the radius are abandoned."""
    depth = int(radius).bit_length()
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    result = np.zeros((len(i), 64), np.uint64)
    live = np.arange(len(i))
    count = [np.zeros((len(i), 64), np.uint64) for _ in range(depth)]
    over = np.zeros((len(i), 64), np.uint64)
    queries, words = fps.reshape(-1, 64)[i], vertical[j]
    for b in range(64):
        carry = words[:, b, None] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))
        for c in count:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7 and b < 63:
            keep = (over != ones).any(axis=1)
            if keep.sum() < 0.7 * len(keep):
                live, over, queries, words = live[keep], over[keep], queries[keep], words[keep]
                count = [c[keep] for c in count]
                if not len(live):
                    return result
    exact = ~over
    if radius + 1 < 1 << depth:  # the counters hold more than the radius: take off the counts in between
        for value in range(radius + 1, 1 << depth):
            match = np.full_like(over, ones)
            for k, c in enumerate(count):
                match &= c if value >> k & 1 else ~c
            exact &= ~match
    result[live] = exact
    return result


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest label, in place."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the links within each group (rows in order of group) connect: (row, root row)."""
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pad = -n % 64
    fps = np.concatenate([fps, np.zeros(pad, np.uint64)])
    group = np.concatenate([group, np.full(pad, -1, np.int64)])
    vertical, words = planes(fps), len(fps) // 64
    first, last = group[::64], group[63::64].copy()
    if pad:
        last[-1] = group[n - 1]
    label = np.arange(n)
    i = np.arange(words)
    for offset in range(words):
        if offset:
            i = i[i + offset < words]
            i = i[first[i + offset] == last[i]]
            if not len(i):
                break
        for at in range(0, len(i), SLAB):
            part = i[at : at + SLAB]
            hit = within(vertical, fps, part, part + offset, radius)
            pair, lane = np.nonzero(hit)
            if not len(pair):
                continue
            for s in range(0, len(pair), 65536):
                p, q = pair[s : s + 65536], lane[s : s + 65536]
                x, k = np.nonzero(np.unpackbits(hit[p, q].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = part[p[x]] * 64 + q[x], (part[p[x]] + offset) * 64 + k
                ok = (a < b) & (b < n)
                a, b = a[ok], b[ok]
                ok = group[a] == group[b]
                unite(label, a[ok], b[ok])
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def keys(radius: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(table, mask) of every choice of blocks on which two fingerprints within the radius may agree."""
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    runs = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(blocks)]
    masks = [sum(c) for c in combinations(runs, blocks - radius)]
    return [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(masks)]


def links(prints: DataFrame, radius: int = 3, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that span the same components as all links at the radius.
    Buckets hold the fingerprints that agree on a choice of blocks; a bucket above `chunk` rows is compared as a
    grid of chunk pairs, so no task takes more than two chunks of one bucket."""
    spread = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in keys(radius, blocks)])).alias("x")).select("fp", "x.t", "x.k")
    sizes = spread.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    near = (
        spread.join(sizes, ["t", "k"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("fp", F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    )

    def run(batches: Iterator[pa.RecordBatch]):
        g, f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            g = np.concatenate([g, b.column(1).to_numpy()])
            f = np.concatenate([f, b.column(0).to_numpy().view(np.uint64)])
            if len(g) < 200_000:
                continue
            end = int(np.searchsorted(g == g[-1], True)) if g[0] != g[-1] else 0
            yield span(g[:end], f[:end])
            g, f = g[end:], f[end:]
        yield span(g, f)

    def span(g: np.ndarray, f: np.ndarray) -> dict:
        group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])).astype(np.int64) if len(g) else g
        moved, root = forest(group, f, radius)
        signed = f.view(np.int64)
        return {"a": signed[moved], "b": signed[root]}

    dealt = near.repartition("g").sortWithinPartitions("g", "fp").select("fp", "g")
    return map_batches(dealt, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, seed: int = 42, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), kept.

    Texts without words (null, empty, blank) have fingerprint zero and link like others. Equal texts meet as one
    fingerprint before any comparison, so copies are never paired up. Rows with a null doc_id get a result too,
    but can't name a component; one of only such rows has a null component_id. Repeated rows give repeated rows.
    No rows give no rows. Other columns of docs are ignored, whatever their names."""
    prints, _ = cut(with_fingerprints(docs, size, seed), "fingerprints")
    once = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(once.select("fp"), radius, blocks), "simhash").withColumnRenamed("node", "fp")
    joined = once.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = joined.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
