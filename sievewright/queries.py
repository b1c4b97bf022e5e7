"""Queries over the shared tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import keys
from .functions.intervals import rate_columns
from .functions.text import latin_normalise
from .operators import matchers, measure, screen, synthetic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(latin_normalise(F.col("p_name")).alias("name")).distinct()


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", latin_normalise(F.col("p_name")).alias("name"))


def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = measure.document_frequency(normalised(spark, sf_dir), "p_partkey", F.split("name", " "))
    return df.select("word", "df", F.round("weight", 6).alias("weight"))


def trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of trigram counts of every two names that share a trigram: a join on trigrams, no cross join."""
    grams = part_names(spark, sf_dir).select("name", F.explode(keys.trigrams(F.col("name"))).alias("g")).groupBy("name", "g").agg(F.count("*").alias("n"))
    norm = grams.groupBy("name").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    both = grams.toDF("a", "g", "na").join(grams.toDF("b", "g", "nb"), "g").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    out = both.join(norm.toDF("a", "x"), "a").join(norm.toDF("b", "y"), "b")
    return out.select("a", "b", F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("x") * F.col("y"))), 6).alias("score"))


def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest partners of each name, and how many more there are."""
    p = trigram_pairs(spark, sf_dir).where("score >= 0.3")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = Window.partitionBy("a")
    return both.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "b"))).withColumn("others", F.greatest(F.lit(0).cast("long"), F.count("*").over(w) - 5)).where("place <= 5")


def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores of two numeric tiers over the labelled documents; quality 1 is a match."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    tier = lambda name, rank, s: F.struct(F.lit(name).alias("tier"), F.lit(rank).alias("rank"), s.alias("score"))
    parts = F.array(tier("length", 1, F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0))), tier("clean", 2, F.lit(1.0) - F.col("toxic") / F.lit(4.0)))
    return d.select(F.when(F.col("quality") == 1, "match").otherwise("different").alias("verdict"), F.explode(parts).alias("s")).select("verdict", "s.*")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measure.threshold_grid(verdict_scores(spark, sf_dir), volume=100_000)
    return g.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])


def best_under_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.best_under_recall(threshold_grid(spark, sf_dir), 0.30).select("tier", "threshold", "fired")


def best_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.best_under_budget(threshold_grid(spark, sf_dir), 300.0, 30).select("tier", "threshold", "fired")


def alert_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.period(table(spark, sf_dir, "events").select("ts"), "ts")


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.duplicate_pairs(table(spark, sf_dir, "part"), "p_brand", "p_type")


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    cols = {k: F.round(c, 9) if k.endswith(("rate", "low", "high")) else c for k, c in rate_columns("high_value", F.col("k"), F.col("n")).items()}
    return counts.select("event_type", *[c.alias(k) for k, c in cols.items()])


def ship_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    imo = F.lpad((F.col("o_orderkey") * 7919 % 10_000_000).cast("string"), 7, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", imo.alias("imo"), keys.imo_valid(imo).alias("valid"))


def nature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return measure.by_nature(labels.select(F.when(F.col("quality") == 1, "match").otherwise("different").alias("verdict"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("nature")))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two screenings of the customers: by balance, then by segment and nation."""
    c = table(spark, sf_dir, "customer")
    shape = lambda df: df.select(F.col("c_custkey").cast("string").alias("ref"), F.col("c_name").alias("name"), F.array(F.struct(F.lit("L").alias("source"), F.array((F.col("c_nationkey") % F.col("m")).cast("string")).alias("ids"))).alias("candidates"))
    return shape(c.where("c_acctbal > 0").withColumn("m", F.lit(5))), shape(c.where("c_mktsegment <> 'BUILDING'").withColumn("m", F.lit(7)))


def screening_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen.changes(*snapshots(spark, sf_dir))


def person_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = trigram_pairs(spark, sf_dir).select("a", "b")
    return matchers.scored(pairs)


def neighbours(names: DataFrame, most: int = 1000) -> DataFrame:
    """name and another, a: the next in the order of a hash, each name once. The order is cut into rings of about
    `most` names, so that no task sorts them all; a name alone has none."""
    h = F.xxhash64("name")
    w = Window.partitionBy("ring").orderBy(h, "name")
    rings = names.withColumn("ring", F.pmod(h, F.lit(names.count() // most + 1)))
    return rings.select("name", F.coalesce(F.lead("name").over(w), F.first("name").over(w)).alias("a")).where("a <> name")


def matcher_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matcher's frontier on synthetic variants of the part names against each name's neighbour."""
    made = synthetic.synthetic(part_names(spark, sf_dir), "name")
    good = made.select(F.col("name").alias("a"), F.col("variant").alias("b"), F.lit("match").alias("verdict"))
    bad = made.select(F.col("variant").alias("b"), "name").join(neighbours(part_names(spark, sf_dir)), "name")
    pairs = good.unionByName(bad.select("a", "b", F.lit("different").alias("verdict")))
    return measure.threshold_grid(matchers.long(matchers.scored(pairs), ["verdict"]))


def synthetic_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.synthetic(part_names(spark, sf_dir), "name")


def check_digit(number: Column) -> Column:
    """Six digits with the seventh that makes them a ship number."""
    return F.concat(number, (sum(F.substring(number, k, 1).cast("int") * (8 - k) for k in range(1, 7)) % 10).cast("string"))


def ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as a list of ships, each with a number; every third has an alias, every fourth a weak one."""
    key, none = F.col("s_suppkey"), F.array().cast("array<string>")
    number = check_digit(F.lpad((key * 7919 % 1_000_000).cast("string"), 6, "0"))
    alias = lambda k, text: F.when(key % k == 0, F.array(F.concat(F.lit(text), key.cast("string")))).otherwise(none)
    return table(spark, sf_dir, "supplier").select(
        F.lit("S").alias("source"), key.cast("string").alias("id"), F.col("s_name").alias("name"), alias(3, "Alias Ship ").alias("alias"), alias(4, "Weak Ship ").alias("weak"),
        F.lit("vessel").alias("type"), F.concat(F.lit("P"), (F.col("s_nationkey") % 5).cast("string")).alias("programme"), number.alias("imo"), none.alias("other_imo"),
    )


def party(line: Column, name: Column, ref: Column, imo: Column, kind: Column) -> list[Column]:
    return [line.alias("line"), name.alias("name"), ref.alias("ref"), imo.alias("imo"), kind.alias("type")]


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names' variants, the suppliers' names with another ship's number, and their weak aliases, against a list made
    of the part names and of the suppliers as ships."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    listed = part_names(spark, sf_dir).select(F.lit("L").alias("source"), F.md5("name").alias("id"), "name", none.alias("alias"), none.alias("weak"), F.lit("entity").alias("type"), null.alias("programme"), null.alias("imo"), none.alias("other_imo"))
    fleet = ships(spark, sf_dir)
    variants = synthetic_variants(spark, sf_dir).select(F.col("variant").alias("name")).distinct()
    sent = variants.select(*party(F.xxhash64("name"), F.col("name"), null, null, null))
    other = fleet.select(*party(F.xxhash64(F.lit("imo"), "id"), F.col("name"), F.concat(F.lit("s"), "id"), F.when(F.col("id").cast("long") % 2 == 0, F.col("imo")).otherwise("1234567"), F.lit("vessel")))
    weak = fleet.where(F.size("weak") > 0).select(*party(F.xxhash64(F.lit("weak"), "id"), F.col("weak")[0], null, null, null))
    return screen.screen(sent.unionByName(other).unionByName(weak), listed.unionByName(fleet))


def screened_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ships under other names, found by their numbers: line, status, what the list names them, and the names that the
    list knows and the ship no longer bears."""
    fleet = ships(spark, sf_dir)
    sent = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.md5(F.col("c_custkey").cast("string")).alias("name"), ((F.col("c_custkey") * 13) % 400).cast("string").alias("id"))
    sent = sent.join(fleet.select("id", "imo"), "id", "left")
    none = F.lit(None).cast("string")
    got = screen.screen(sent.select(*party(F.col("line"), F.col("name"), none, F.col("imo"), none)), fleet)
    one = F.get("candidates", F.lit(0))
    return got.select("line", "status", F.coalesce(F.size("candidates"), F.lit(0)).alias("n"), one["listed_name"].alias("listed_name"), one["list"].alias("list"), one["by"].alias("by"), F.array_join(one["renamed"], "|").alias("renamed"), "vessel_without_imo")


def grown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that grow with the tables: two to four words of each document."""
    words = F.split(latin_normalise(F.substring("text", 1, 400)), " ")
    some = F.slice(words, (1 + F.col("doc_id") % 7).cast("int"), (2 + F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(some, " ").alias("name")).where("name <> ''")


def screening_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book of names with a letter lost or exchanged, every tenth document's, against all documents' names."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    names = grown_names(spark, sf_dir)
    listed = names.groupBy("name").agg(F.min("doc_id").cast("string").alias("id")).select(F.lit("D").alias("source"), "id", "name", none.alias("alias"), none.alias("weak"), F.lit("entity").alias("type"), null.alias("programme"), null.alias("imo"), none.alias("other_imo"))
    at = (2 + F.col("doc_id") % 5).cast("int")
    wrong = F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.lit(400)))
    sent = names.where("doc_id % 10 = 3").select(*party(F.col("doc_id"), wrong, null, null, null))
    return screen.screen(sent, listed)


def chosen_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two levels that the grid's false alerts allow, on the labelled documents as either table."""
    cells = threshold_grid(spark, sf_dir)
    return measure.choose_thresholds(cells, cells, possible=0.6, written_max=0.9, real_max=0.9, recall_min=0.2)


def vessel_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names with and without a mark of a vessel, and with types that say so."""
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("M/V "), "c_name")).when(key % 5 == 1, F.concat("c_name", F.lit(" (tug)"))).when(key % 5 == 2, F.concat(F.lit("MV"), "c_name")).otherwise(F.col("c_name"))
    kind = F.when(key % 7 == 0, " Tanker ").when(key % 7 == 1, "company")
    return table(spark, sf_dir, "customer").select("c_custkey", keys.is_vessel(name, kind).alias("vessel"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalise": normalised, "word_weights": word_weights, "trigram_cosine": trigram_pairs, "top_five": top_five, "threshold_grid": threshold_grid,
    "best_under_recall": best_under_recall, "best_under_budget": best_under_budget, "alert_period": alert_period, "duplicate_pairs": duplicate_pairs,
    "wilson_rates": event_rates, "imo_check": ship_numbers, "nature_counts": nature_counts, "screening_changes": screening_changes,
    "screening_by_number": screened_by_number, "choose_thresholds": chosen_thresholds, "vessel_marks": vessel_marks, "person_matchers": person_matchers, "matcher_grid": matcher_grid, "synthetic_variants": synthetic_variants, "screening": screened, "screening_books": screening_books,
}

NORM = "trim(regexp_replace(strip_accents(lower(p_name)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
TRIGRAMS = f"""
names AS (SELECT DISTINCT {NORM} AS name FROM part),
g AS (SELECT name, g, count(*) AS n FROM (SELECT name, unnest(list_transform(range(1, length(name) + 1), lambda i: substr(' ' || name || ' ', i, 3))) AS g FROM names) GROUP BY ALL),
norm AS (SELECT name, sqrt(sum(n * n)) AS norm FROM g GROUP BY name),
pairs AS (SELECT a.name AS a, b.name AS b, sum(a.n * b.n) AS dot FROM g a JOIN g b ON a.g = b.g AND a.name < b.name GROUP BY ALL),
scores AS (SELECT a, b, round(least(1.0, dot / (x.norm * y.norm)), 6) AS score FROM pairs JOIN norm x ON x.name = a JOIN norm y ON y.name = b)"""


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    p, d = f"({k} / CAST({n} AS DOUBLE))", f"(1 + 3.8416 / {n})"
    centre, spread = f"(({p} + 3.8416 / (2.0 * {n})) / {d})", f"(1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, least({centre} - {spread}, {p})) END", f"CASE WHEN {n} <= 0 THEN 1.0 ELSE least(1.0, greatest({centre} + {spread}, {p})) END"


def sql_rate(prefix: str, k: str, n: str) -> str:
    low, high = sql_wilson(k, n)
    return f"""{k} AS {prefix}_successes, {n} AS {prefix}_n, round(CASE WHEN {n} <= 0 THEN 0.0 ELSE {k} / CAST({n} AS DOUBLE) END, 9) AS {prefix}_rate,
round(CAST({low} AS DOUBLE), 9) AS {prefix}_low, round(CAST({high} AS DOUBLE), 9) AS {prefix}_high, {n} >= 20 AS {prefix}_reportable"""


GRID = f"""
d AS (SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
s AS (SELECT 'length' AS tier, 1 AS rank, least(1.0, n_chars / CAST(4000 AS DOUBLE)) AS score, quality FROM d
  UNION ALL SELECT 'clean', 2, 1 - toxic / CAST(4 AS DOUBLE), quality FROM d),
t AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(50, 101) r(i)),
c AS (SELECT tier, rank, threshold, CAST(count(*) FILTER (score >= threshold) AS BIGINT) AS fired, CAST(count(*) FILTER (score >= threshold AND quality = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (quality = 1) AS BIGINT) AS m, CAST(count(*) AS BIGINT) AS total FROM s CROSS JOIN t GROUP BY ALL),
e AS (SELECT *, fired - tp AS fp, total - m AS dn FROM c),
grid AS (SELECT tier, rank, round(threshold, 9) AS threshold, fired, {sql_rate("recall", "tp", "m")}, {sql_rate("false_alert", "fp", "dn")},
  round(floor(fired / CAST(100000 AS DOUBLE) * 100000 + 0.5) / 100, 9) AS per_thousand FROM e)"""

ORACLE_SQL = {
    "normalise": f"SELECT p_partkey, {NORM} AS name FROM part",
    "word_weights": f"""
WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split({NORM}, ' ')) AS word FROM part)
SELECT word, count(DISTINCT p_partkey) AS df, round(1 + ln(((SELECT count(DISTINCT p_partkey) FROM part) + 1) / (count(DISTINCT p_partkey) + 1.0)), 6) AS weight FROM w WHERE word <> '' GROUP BY word""",
    "trigram_cosine": f"WITH {TRIGRAMS} SELECT a, b, score FROM scores",
    "top_five": f"""
WITH {TRIGRAMS}, both_ AS (SELECT a, b, score FROM scores WHERE score >= 0.3 UNION ALL SELECT b, a, score FROM scores WHERE score >= 0.3)
SELECT a, b, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY a) - 5) AS others
FROM both_ QUALIFY place <= 5""",
    "threshold_grid": f"WITH {GRID} SELECT * FROM grid",
    "best_under_recall": f"WITH {GRID} SELECT tier, threshold, fired FROM grid WHERE recall_n >= 5 AND recall_low >= 0.3 ORDER BY fired, rank, threshold DESC LIMIT 1",
    "best_under_budget": f"WITH {GRID} SELECT tier, threshold, fired FROM grid WHERE recall_n >= 5 AND fired <= 300 ORDER BY recall_low DESC, fired, rank, threshold LIMIT 1",
    "alert_period": """
SELECT strftime(min(ts), '%Y-%m-%d') AS from_day, strftime(max(ts), '%Y-%m-%d') AS to_day,
  greatest(1, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(86400000000 AS DOUBLE) + 0.5) AS BIGINT)) AS days, CAST(0 AS BIGINT) AS unreadable FROM events""",
    "duplicate_pairs": "SELECT least(p_brand, p_type) AS first, greatest(p_brand, p_type) AS second, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "wilson_rates": f"WITH c AS (SELECT event_type, CAST(count(*) FILTER (value > 50) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, {sql_rate('high_value', 'k', 'n')} FROM c",
    "imo_check": """
WITH i AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS imo FROM orders)
SELECT o_orderkey, imo, list_sum(list_transform(range(1, 7), lambda k: CAST(substr(imo, CAST(k AS INTEGER), 1) AS INTEGER) * (8 - k))) % 10 = CAST(substr(imo, 7, 1) AS INTEGER) AS valid FROM i""",
    "nature_counts": "SELECT CASE WHEN quality = 1 THEN 'match' ELSE 'different' END AS verdict, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS nature, count(*) AS n FROM labels GROUP BY ALL",
    "screening_changes": """
WITH b AS (SELECT 'ref:' || c_custkey AS key, 'L|' || (c_nationkey % 5) AS candidate FROM customer WHERE c_acctbal > 0),
a AS (SELECT 'ref:' || c_custkey AS key, 'L|' || (c_nationkey % 7) AS candidate FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT 'new candidate' AS change, a.key, a.candidate FROM a JOIN b USING (key) WHERE a.candidate <> b.candidate
UNION ALL SELECT 'candidate gone', b.key, b.candidate FROM a JOIN b USING (key) WHERE a.candidate <> b.candidate
UNION ALL SELECT 'party added', key, NULL FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT 'party removed', key, NULL FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "screening_by_number": """
WITH n AS (SELECT s_suppkey AS k, s_name, 'P' || (s_nationkey % 5) AS list, lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS d FROM supplier),
ship AS (SELECT *, d || (list_sum(list_transform(range(1, 7), lambda i: CAST(substr(d, CAST(i AS INTEGER), 1) AS INTEGER) * (8 - i))) % 10) AS imo FROM n),
sent AS (SELECT c_custkey AS line, s.imo FROM customer LEFT JOIN ship s ON s.k = c_custkey * 13 % 400),
c AS (SELECT line, list, s_name, ship.imo, min(k) AS first FROM sent JOIN ship USING (imo) GROUP BY ALL)
SELECT sent.line, CASE WHEN c.line IS NULL THEN 'no-match' ELSE 'strong' END AS status, CAST(c.line IS NOT NULL AS INTEGER) AS n, c.s_name AS listed_name, c.list,
  CASE WHEN c.line IS NOT NULL THEN 'imo' END AS by, CASE WHEN c.line IS NOT NULL THEN c.s_name || CASE WHEN first % 3 = 0 THEN '|Alias Ship ' || first ELSE '' END END AS renamed, false AS vessel_without_imo
FROM sent LEFT JOIN c ON c.line = sent.line""",
    "choose_thresholds": f"""
WITH {GRID}, p AS (SELECT tier, min(threshold) FILTER (threshold >= 0.6 - 1e-9) AS possible, max(threshold) AS last FROM grid GROUP BY tier)
SELECT tier, possible, coalesce(min(threshold) FILTER (threshold > possible AND false_alert_high <= 0.9), last) AS strong, max(recall_low) FILTER (threshold = possible) >= 0.2 AS holds_recall
FROM grid JOIN p USING (tier) GROUP BY tier, possible, last""",
    "vessel_marks": "SELECT c_custkey, c_custkey % 5 IN (0, 1) OR c_custkey % 7 = 0 AS vessel FROM customer",
}
