"""Recall and false alerts at every threshold, and the cheapest cell under a floor or a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.intervals import rate_columns

MIN_ALERTS, MIN_PAIRS, MIN_MATCHES = 30, 40, 5
REQUIRED = ("alert_id", "screened_name", "list_name", "list_source", "disposition")
OPTIONAL = ("engine_score", "decided_at")
# Assumed costs: minutes an alert, dollars a year, productive hours a day, days a year.
MINUTES_PER_ALERT, ANALYST_COST, HOURS_PER_DAY, DAYS_PER_YEAR = 5, 62_000, 6, 220


def threshold_grid(scores: DataFrame, verdict: str = "verdict", match: str = "match", volume: int | None = None) -> DataFrame:
    """From long scores (tier, rank, score, verdict): per tier and threshold what fires, recall and false alerts.

    Each score is counted once, at the highest threshold that it reaches; a running sum from the top, over at most
    51 rows a tier, gives every cell. Raw scores are compared, so 0.99996 doesn't fire at 1.00."""
    hit = (F.col(verdict) == match).cast("long")
    # the highest grid point up to the score: truncation, corrected where hundredths aren't exact
    raw = F.floor(F.col("score") * 100).cast("int")
    step = F.when(F.col("score") >= (raw + 1) / F.lit(100.0), raw + 1).when(F.col("score") < raw / F.lit(100.0), raw - 1).otherwise(raw)
    counted = scores.select("tier", "rank", F.least(F.lit(100), F.greatest(F.lit(49), step)).alias("step"), hit.alias("m")).groupBy("tier", "rank", "step").agg(F.sum("m").alias("m"), F.count("*").alias("n"))
    tiers = counted.groupBy("tier", "rank").agg(F.sum("m").alias("matches"), F.sum("n").alias("total"))
    grid = tiers.withColumn("step", F.explode(F.sequence(F.lit(50), F.lit(100))))
    w = Window.partitionBy("tier").orderBy(F.desc("step"))
    cells = (
        grid.join(counted, ["tier", "rank", "step"], "left")
        .withColumn("tp", F.sum(F.coalesce("m", F.lit(0))).over(w))
        .withColumn("fired", F.sum(F.coalesce("n", F.lit(0))).over(w))
    )
    out = cells.select(
        "tier", "rank", (F.col("step") / F.lit(100.0)).alias("threshold"), "fired",
        *[c.alias(k) for k, c in rate_columns("recall", F.col("tp"), F.col("matches")).items()],
        *[c.alias(k) for k, c in rate_columns("false_alert", F.col("fired") - F.col("tp"), F.col("total") - F.col("matches")).items()],
    )
    return out if volume is None else out.withColumn("per_thousand", F.floor(F.col("fired") / F.lit(float(volume)) * 100_000 + 0.5) / 100)


def best_under_recall(cells: DataFrame, floor: float) -> DataFrame:
    """The cell that fires least while the lower bound of recall holds the floor."""
    fits = cells.where((F.col("recall_n") >= MIN_MATCHES) & (F.col("recall_low") >= floor))
    return fits.orderBy("fired", "rank", F.desc("threshold")).limit(1)


def best_under_budget(cells: DataFrame, per_month: float, days: int) -> DataFrame:
    """The cell with the best lower bound of recall among those within the alerts a month."""
    fits = cells.where((F.col("recall_n") >= MIN_MATCHES) & (F.col("fired") * F.lit(30.0 / days) <= per_month))
    return fits.orderBy(F.desc("recall_low"), "fired", "rank", "threshold").limit(1)


def strongest_bound(cells: DataFrame) -> DataFrame:
    """The best lower bound of recall that any cell holds: what a floor can ask for at most."""
    return cells.where(F.col("recall_n") >= MIN_MATCHES).agg(F.max("recall_low").alias("recall_low"))


def analyst_hours(alerts: float) -> tuple[float, float]:
    """Hours that so many alerts take, and what they cost."""
    hours = alerts * MINUTES_PER_ALERT / 60
    return hours, hours * ANALYST_COST / (DAYS_PER_YEAR * HOURS_PER_DAY)


# The lowest level that is shown, the most false alerts of the strong level on written and on real pairs
# (upper bounds), and the recall that the lowest level is to hold (lower bound).
POSSIBLE, WRITTEN_MAX, REAL_MAX, RECALL_MIN = 0.80, 0.05, 0.01, 0.90


def choose_thresholds(written: DataFrame, real: DataFrame, possible: float = POSSIBLE, written_max: float = WRITTEN_MAX, real_max: float = REAL_MAX, recall_min: float = RECALL_MIN) -> DataFrame:
    """tier, possible, strong, holds_recall from the cells of written pairs and of real neighbours, on one grid.

    possible: the first threshold from `possible` on, else the last there is; strong: the lowest above it whose upper
    bounds of false alerts hold on both tables, else the last there is."""
    near = F.col("false_alert_high").alias("real_high")
    cells = written.join(real.select("tier", "threshold", near), ["tier", "threshold"], "full_outer")
    if cells.where("real_high is null or false_alert_high is null").limit(1).count():
        raise ValueError("the two tables don't share one grid of thresholds")
    last = F.max("threshold")
    levels = cells.groupBy("tier").agg(F.coalesce(F.min(F.when(F.col("threshold") >= possible - 1e-9, F.col("threshold"))), last).alias("possible"), last.alias("last"))
    good = (F.col("threshold") > F.col("possible")) & (F.col("false_alert_high") <= written_max) & (F.col("real_high") <= real_max)
    both = cells.join(levels, "tier")
    recall = F.max(F.when(F.col("threshold") == F.col("possible"), F.col("recall_low")))
    return both.groupBy("tier").agg(F.max("possible").alias("possible"), F.coalesce(F.min(F.when(good, F.col("threshold"))), F.max("last")).alias("strong"), (recall >= recall_min).alias("holds_recall"))


def period(times: DataFrame, column: str) -> DataFrame:
    """from_day, to_day, days (at least 1, rounded half up), unreadable."""
    t = (F.col(column) if dict(times.dtypes)[column].startswith("timestamp") else F.try_to_timestamp(F.col(column))).cast("timestamp")
    read = times.where(F.col(column).isNotNull()).select(t.alias("t"))
    span = F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))
    return read.agg(
        F.date_format(F.min("t"), "yyyy-MM-dd").alias("from_day"), F.date_format(F.max("t"), "yyyy-MM-dd").alias("to_day"),
        F.greatest(F.lit(1).cast("long"), F.floor(span / F.lit(86_400_000_000.0) + 0.5)).alias("days"), F.count_if(F.col("t").isNull()).alias("unreadable"),
    )


def checked_alerts(rows: DataFrame) -> DataFrame:
    """Alerts that keep the contract; raises with the reason for any others."""
    unknown = [c for c in rows.columns if c not in (*REQUIRED, *OPTIONAL) and not c.startswith("_")]
    missing = [c for c in REQUIRED if c not in rows.columns]
    if unknown or missing:
        raise ValueError(f"unknown columns: {unknown}; missing columns: {missing}")
    t = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    alerts = rows.select(*[t(c).alias(c) for c in (*REQUIRED, *[o for o in OPTIONAL if o in rows.columns])]).withColumn("disposition", F.lower("disposition"))
    bad = alerts.agg(F.count("*").alias("n"), F.count_if(~F.col("disposition").isin("match", "false_positive")).alias("odd"), F.count_if(F.col("alert_id") == "").alias("empty")).first()
    if bad.odd or bad.empty:
        raise ValueError(f"{bad.odd} rows with another disposition than match or false_positive, {bad.empty} without alert_id")
    if bad.n < MIN_ALERTS:
        raise ValueError(f"{bad.n} alerts; at least {MIN_ALERTS} are needed")
    if twice := alerts.groupBy("alert_id").count().where("count > 1").limit(6).collect():
        raise ValueError(f"alert_id occurs twice: {[r.alert_id for r in twice]}")
    if "engine_score" in alerts.columns:
        score = F.expr("try_cast(engine_score as double)")
        alerts = alerts.withColumn("engine_score", F.when(F.abs(score) < float("inf"), score))
    return alerts


def duplicate_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs that occur more than once, and how often."""
    return pairs.groupBy(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).agg(F.count("*").alias("n")).where("n > 1")


def checked_pairs(pairs: DataFrame) -> DataFrame:
    """Labelled pairs a, b, verdict, nature, or the reason why they can't be measured."""
    counts = {r.verdict: r.n for r in pairs.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    short = [v for v in ("match", "different") if counts.get(v, 0) < MIN_PAIRS]
    empty = pairs.where("trim(coalesce(a, '')) = '' or trim(coalesce(b, '')) = '' or trim(coalesce(nature, '')) = ''").limit(1).count()
    if short or empty or duplicate_pairs(pairs).limit(1).count():
        raise ValueError(f"under {MIN_PAIRS} pairs of {short}, or an empty name or nature, or a pair that occurs twice")
    return pairs


def by_nature(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("verdict", "nature").agg(F.count("*").alias("n"))


def document_frequency(entries: DataFrame, entry: str, words: Column) -> DataFrame:
    """word, df (entries that have it), weight 1 + ln((N + 1) / (df + 1)); N is a one-row table."""
    n = entries.agg(F.countDistinct(entry).alias("entries"))
    df = entries.select(entry, F.explode(F.array_distinct(words)).alias("word")).where("word <> ''").groupBy("word").agg(F.countDistinct(entry).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", (1 + F.log((F.col("entries") + 1) / (F.col("df") + 1))).alias("weight"))
