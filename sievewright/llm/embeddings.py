"""Embedding near-dedup: tiles of vectors in PCA order, compared leading dimensions first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import unite
from .util import components, cut, map_batches

#: Distinct vectors of one label in a tile; a task compares two tiles.
TILE = 2048
#: Dimensions that each step of a comparison adds.
STEP = 16
#: Slack of the bounds, far above the rounding of double sums; pairs this near to the threshold are decided on the
#: vectors as stored.
SLACK = 1e-9
#: Leading axes by which a large label is cut into cells at most, and tiles from which each axis more is used.
CELLS, LARGE = 3, 4


def matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By number of dimensions, the principal axes (columns, leading first) of all unit vectors. Each task sends
    one sum of products per dimensionality; the sums meet element by element before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list[np.ndarray]] = {}
            for v in matrix(b.column(0)):
                by.setdefault(len(v), []).append(v)
            for d, rows in by.items():
                x = unit(np.array(rows))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield {"d": [d] * (d * d), "at": range(d * d), "s": m.ravel()}

    sums = map_batches(vectors.select("embedding"), run, "d int, at int, s double").groupBy("d", "at").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for d, part in sums.toPandas().groupby("d"):
        m = np.zeros(int(d) * int(d))
        m[part["at"]] = part["s"]
        m = m.reshape(int(d), int(d))
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows as they are stored; scaling by powers of two is exact."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (i, j) of unit vectors with cosine >= threshold or hardly less, and their cosines; i < j if both sides
    are the same. Products of the leading dimensions come first; a pair goes on only while its product plus that of
    the norms of what is left can reach the threshold."""
    d = a.shape[1]
    rest = lambda x, at: np.sqrt((x[:, at:] ** 2).sum(axis=1))
    at = min(step, d)
    s = a[:, :at] @ b[:, :at].T
    may = s + np.outer(rest(a, at), rest(b, at)) >= threshold - SLACK
    if same:
        may &= np.triu(np.ones(may.shape, bool), 1)
    i, j = np.nonzero(may)
    s = s[i, j]
    while at < d and len(i):
        to = min(at + step, d)
        s = np.concatenate([s[k : k + 65536] + np.einsum("ij,ij->i", a[i[k : k + 65536], at:to], b[j[k : k + 65536], at:to]) for k in range(0, len(s), 65536)])
        at = to
        keep = s + rest(a, at)[i] * rest(b, at)[j] >= threshold - SLACK
        i, j, s = i[keep], j[keep], s[keep]
    return i, j, s


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, large: int = LARGE) -> DataFrame:
    """vec_id, label, n_links, component_id, kept: links join vectors of one label with cosine >= threshold.

    Vectors are compared only when their labels are equal and not null and they have as many dimensions. A vector
    that is null, empty, zero or holds null or non-finite components links with nothing: n_links 0, component_id
    its own vec_id. Equal vectors of a label meet as one row before the comparison; each copy counts as a link.
    Repeated rows count as copies, rows that share a vec_id get a result each. A null vec_id can't name a component.
    No rows give no rows. Other columns are ignored, whatever their names.

    The distinct vectors of a label are dealt into tiles, and every pair of tiles is one group, so that a large label
    spreads over as many tasks as it has pairs of tiles. A label of many tiles is first cut into cells along the
    leading axes, as wide as two linked unit vectors can be apart: tiles of cells that don't touch are never paired."""
    e = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    once = (
        base.where(fit)
        .withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
        .select("*", F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("d"))  # told apart by number from here on
    )
    once, _ = cut(once, "vectors")
    axes = bases(once)
    width = math.sqrt(2 * max(0.0, 1 - threshold)) + SLACK

    def place(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = matrix(b.column("embedding"))
            at = np.zeros((len(rows), CELLS), np.int64)
            for k, v in enumerate(rows):
                lead = unit(v[None, :])[0] @ axes[len(v)][:, :CELLS]
                at[k, : len(lead)] = np.floor(lead / width)
            yield {c: b.column(c) for c in ("label", "d", "node", "copies")} | {f"c{k}": at[:, k] for k in range(CELLS)} | {"x": [v.tobytes() for v in rows]}

    own = [f"c{k}" for k in range(CELLS)]
    ddl = f"label {once.schema['label'].dataType.simpleString()}, d int, node long, copies long, {', '.join(f'{c} long' for c in own)}, x binary"
    # axes that cut a label: each more from three times as many tiles
    used = F.greatest(F.lit(0), F.least(F.lit(CELLS), F.floor(F.log(F.col("n") / F.lit(tile * large)) / F.lit(math.log(3))).cast("int")))
    sizes = once.groupBy("label", "d").agg(F.count("*").alias("n")).select("label", "d", used.alias("used"))
    placed = map_batches(once.select("label", "d", "node", "copies", "embedding"), place, ddl).join(sizes, ["label", "d"])
    placed = placed.select("label", "d", "used", "node", "copies", "x", *[F.when(F.col("used") > k, F.col(c)).otherwise(0).alias(c) for k, c in enumerate(own)])
    cells = placed.groupBy("label", "d", "used", *own).agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles")).withColumn("cell", F.monotonically_increasing_id())
    cells, _ = cut(cells, "cells")
    beside = cells
    for k, c in enumerate(own):
        beside = beside.withColumn(f"to{k}", F.explode(F.when(F.col("used") > k, F.array(*[F.col(c) + F.lit(x) for x in (-1, 0, 1)])).otherwise(F.array(F.col(c)))))
    other = cells.select("label", "d", *[F.col(c).alias(f"to{k}") for k, c in enumerate(own)], F.col("tiles").alias("to_tiles"), F.col("cell").alias("to_cell"))
    beside = beside.join(other, ["label", "d", *[f"to{k}" for k in range(CELLS)]]).select("label", "d", *own, "cell", "tiles", "to_cell", "to_tiles")
    mine, yours = F.struct("cell", "t"), F.struct(F.col("to_cell").alias("cell"), F.col("to_t").alias("t"))
    dealt = (
        placed.join(beside, ["label", "d", *own])
        .withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")))
        .withColumn("to_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_tiles") - 1)))
        # a tile paired with itself is one side only
        .select(F.least(mine, yours).alias("low"), F.greatest(mine, yours).alias("high"), (mine > yours).cast("int").alias("side"), "d", "node", "copies", "x")
        .select(F.col("low.cell").alias("a"), F.col("low.t").alias("at"), F.col("high.cell").alias("b"), F.col("high.t").alias("bt"), "side", "d", "node", "copies", "x")
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        side = part["side"].to_numpy()
        raw = np.frombuffer(b"".join(part["x"]), np.float64).reshape(len(part), -1)
        x = unit(raw) @ axes[raw.shape[1]]
        node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        same = not len(right)
        right = left if same else right
        linked, label = np.zeros(len(part), np.int64), np.arange(len(part))
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            others = left[s:] if same else right
            i, j, cosine = pairs(x[rows], x[others], threshold, same)
            i, j = rows[i], others[j]
            close = np.nonzero(cosine < threshold + SLACK)[0]
            cosine[close] = cosines(raw[i[close]], raw[j[close]])
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            unite(label, i, j)
        some, moved = np.nonzero(linked)[0], np.nonzero(label != np.arange(len(part)))[0]
        return pd.DataFrame({"a": np.concatenate([node[some], node[moved]]), "links": np.concatenate([linked[some], np.full(len(moved), -1)]), "b": np.concatenate([node[some], node[label[moved]]])})

    found, _ = cut(dealt.groupBy("a", "at", "b", "bt").applyInPandas(compare, "a long, links long, b long"), "links")
    roots = components(found.where("links < 0").select("a", "b"), "vectors")
    counted = found.where("links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    done = (
        once.join(counted, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .select("label", "embedding", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root")
    )
    named = done.groupBy("root").agg(F.min("first_id").alias("component_id"))
    done = done.join(named, "root").select("label", "embedding", "n_links", "component_id")
    fitting = base.where(fit).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    linked = fitting.join(done, ["label", "embedding"]).select("vec_id", "label", "n_links", "component_id", kept)
    alone = base.where(~fit).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.unionByName(alone)
