"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import lines, packing, secrets, shingles, toxicity
from sievewright.llm.util import cut, remove, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows among docs, doesn't call toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are similar to an earlier one."""
    return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by the shingles of five words and similarity 0.8: that with the
    smallest doc_id, those without one last. Rows that share a doc_id stay if their texts are no near-duplicates; of
    rows that repeat doc_id and text one stays. Candidates come from the bit-sliced comparison of SimHash fingerprints,
    and from MinHash bands, as fingerprints of texts of that similarity differ in up to 14 bits."""
    kept = shingles.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("h").alias("hash")).distinct()
    columns = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*columns.values()).withColumns({"doc": F.col(columns["doc_id"]).cast("long"), "h": F.xxhash64(F.col(columns["text"]).cast("string"))})
    once = rows.join(kept, F.col("h").eqNullSafe(F.col("hash")) & F.col("doc").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["doc", "h"])
    return once.select(*columns.values()).toDF(*columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a sign."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, and its place in a sequence of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Fitted models, hashes of shingles and subword ids are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before has written. What a stage and its predecessor wrote is removed as soon
    as its own result is there; the last stage's tables stay until its caller has read them."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, place = cut(stage(spark, docs, sf_dir), name)
            keep.append(place)
        if last:
            remove(spark, last)
        last = place
    return STAGES[-1][1](spark, docs, sf_dir)
