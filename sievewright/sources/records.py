"""Files: strict CSV with an account of every odd row, sealed JSON records."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import read_imo

MEGABYTE = 1 << 20


@dataclass
class Table:
    header: list[str]
    rows: list[list[str]] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    too_long: list[int] = field(default_factory=list)
    short: list[int] = field(default_factory=list)
    oversized: list[int] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        data = [(line, *(r + [""] * (len(self.header) - len(r)))) for line, r in zip(self.lines, self.rows, strict=True)]
        return spark.createDataFrame(data, ", ".join(["_line int", *(f"`{h}` string" for h in self.header)]))


def read_table(text: str) -> Table:
    """A small CSV file: quotes as in RFC 4180, any line ends, rows of blanks dropped, rows longer than the header set
    aside, shorter ones padded, cells of a megabyte noted; empty files, open quotes and equal headers are errors."""
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=True)
    csv.field_size_limit(1 << 30)
    table, last = None, 0
    try:
        for row in reader:
            line, last = last + 1, reader.line_num
            if not any(c.strip() for c in row):
                continue
            if table is None:
                table = Table([c.strip() for c in row])
                if len(set(table.header)) < len(row):
                    raise ValueError("two columns have one name")
                continue
            if len(row) > len(table.header):
                table.too_long.append(line)
                continue
            if len(row) < len(table.header):
                table.short.append(line)
            if any(len(c) >= MEGABYTE for c in row):
                table.oversized.append(line)
            table.rows.append(row)
            table.lines.append(line)
    except csv.Error as e:
        raise ValueError(f"a quote that opens after line {last} doesn't close: {e}") from e
    if table is None:
        raise ValueError("the file is empty")
    return table


def read_parties(spark: SparkSession, text: str) -> DataFrame:
    """line, name, ref, imo, type, country; rows without a name are dropped, unreadable ship numbers null."""
    df = read_table(text).frame(spark)
    df = df.toDF(*[c.lower() for c in df.columns])
    if "name" not in df.columns:
        raise ValueError("the file has no column called name")
    opt = lambda c: (F.nullif(F.trim(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")).alias(c)
    out = df.select(F.col("_line").alias("line"), F.trim("name").alias("name"), opt("ref"), opt("imo"), opt("type"), opt("country")).where("name <> ''")
    return out.withColumn("imo", read_imo(F.col("imo")))


def seal(record: dict) -> str:
    """First 16 hex digits of the SHA-256 of the record's JSON, keys sorted, without its own seal."""
    body = {k: v for k, v in record.items() if k != "seal"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def sealed(record: dict) -> dict:
    return record | {"seal": seal(record)}


def intact(record: dict) -> bool:
    return record.get("seal") == seal(record)
