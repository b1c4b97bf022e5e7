"""The matchers: a score in 0..1 for a pair of names, each an Arrow UDF over distinct pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, prepare


def exact(a: str, b: str) -> float:
    return float(a == b)


def tokens(a: str, b: str) -> float:
    """Shared words over all words, as multisets; then a single letter pairs with a longer word that it starts."""
    x, y = Counter(a.split()), Counter(b.split())
    if not x or not y:
        return float(not x and not y)
    total, shared = x.total() + y.total(), (x & y).total()
    left, right = sorted((x - y).elements()), sorted((y - x).elements())
    for w in left:
        mate = next((k for k, v in enumerate(right) if 1 in (len(w), len(v)) and len(w) != len(v) and (v.startswith(w) or w.startswith(v))), None)
        if mate is not None:
            del right[mate]
            shared += 1
    return shared / (total - shared)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine, theirs = set(range(len(b))), [], []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j in free and b[j] == c), None)
        if j is not None:
            free.remove(j)
            mine.append(c)
            theirs.append(j)
    if not mine:
        return 0.0
    m, moved = len(mine), sum(b[j] != c for j, c in zip(sorted(theirs), mine, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return j + same * 0.1 * (1 - j)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance, a row at a time."""
    rows = [[], list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        last, row = rows[1], [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[0][j - 2] + 1)
            row.append(best)
        rows = [last, row]
    return rows[1][-1]


def alignment(a: str, b: str) -> float:
    return 1.0 if a == b else 1 - osa(a, b) / max(len(a), len(b))


def phonetic(a: str, b: str) -> float:
    x, y = name_key(a), name_key(b)
    return alignment(x, y) if x or y else 0.0


def trigrams(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (f" {a} ", f" {b} "))
    if not x or not y:
        return 0.0
    norm = [sqrt(sum(v * v for v in c.values())) for c in (x, y)]
    return min(1.0, sum(v * y[g] for g, v in x.items()) / (norm[0] * norm[1]))


@dataclass(frozen=True)
class Matcher:
    """score: of two prepared names. Callers may register their own."""

    id: str
    rank: int
    description: str
    score: Callable[[str, str], float]

    def checked(self, a: str, b: str) -> float:
        s = self.score(prepare(a), prepare(b))
        if not 0 <= s <= 1:
            raise ValueError(f"{self.id} gave {s}")
        return s


REGISTRY = {
    m.id: m
    for m in (
        Matcher("exact", 1, "equal once prepared", exact),
        Matcher("tokens", 2, "shared words, whatever their order; initials count", tokens),
        Matcher("jaro-winkler", 3, "shared letters nearby, with a bonus for equal starts", jaro_winkler),
        Matcher("damerau", 4, "edits and swaps over the longer length", alignment),
        Matcher("phonetic", 5, "the same over consonant skeletons", phonetic),
        Matcher("ngrams", 6, "cosine of trigram counts", trigrams),
    )
}
#: Matchers that need what isn't here, and what that is.
ABSENT = {"embed": "needs sentence-embedding weights", "logic-v2": "needs an external matching library"}


def scored(pairs: DataFrame, a: str = "a", b: str = "b", registry: dict[str, Matcher] | None = None) -> DataFrame:
    """pairs with a column per matcher. Each distinct pair is scored once; null names score as empty ones."""
    registry = registry or REGISTRY
    matchers = sorted(registry.values(), key=lambda m: m.rank)
    names = pairs.select(F.coalesce(a, F.lit("")).alias("__a"), F.coalesce(b, F.lit("")).alias("__b"))
    fields = ", ".join(f"`{m.id}` double" for m in matchers)

    @F.pandas_udf(fields)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({m.id: [m.checked(p, q) for p, q in zip(x, y, strict=True)] for m in matchers})

    once = names.distinct().withColumn("__s", run("__a", "__b"))
    keyed = pairs.withColumns({"__a": F.coalesce(a, F.lit("")), "__b": F.coalesce(b, F.lit(""))})
    return keyed.join(once, ["__a", "__b"]).select(*pairs.columns, *[F.col(f"__s.`{m.id}`").alias(m.id) for m in matchers])


def long(scores: DataFrame, keep: list[str], registry: dict[str, Matcher] | None = None) -> DataFrame:
    """One row per pair and matcher: the columns in `keep`, tier, rank, score."""
    parts = [F.struct(F.lit(m.id).alias("tier"), F.lit(m.rank).alias("rank"), F.col(f"`{m.id}`").alias("score")) for m in (registry or REGISTRY).values()]
    return scores.select(*keep, F.explode(F.array(*parts)).alias("s")).select(*keep, "s.*")
