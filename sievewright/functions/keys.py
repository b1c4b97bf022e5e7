"""Keys as Column expressions: ship numbers, vessel marks, unordered words, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types, and openings and endings of names, that name a vessel.
VESSEL_TYPES = ["vessel", "ship", "navire", "bateau", "boat", "tanker", "barge", "tug", "tugboat", "yacht", "schiff", "buque", "navio", "nave", "schip", "vaartuig"]
VESSEL_MARK = r"(?i)^(?:m/v|m/t|m/s|m/y|s/y|f/v|r/v|t/b|lpg/c|lng/c|b/m|n/m|r/m|t/h|t/kh)\b\.?\s*\S|^motor\s+(?:vessel|tanker|ship|yacht)\s+\S|\((?:vessel|tanker|barge|tug|ship)\)\s*$"


def imo_valid(imo: Column) -> Column:
    """Seven digits whose last is the last of the others weighted 7 to 2; null for null."""
    weighted = sum((F.substring(imo, k + 1, 1).cast("int") * (7 - k) for k in range(1, 6)), F.substring(imo, 1, 1).cast("int") * 7)
    return F.when(F.rlike(imo, F.lit(r"^\d{7}$")), weighted % 10 == F.substring(imo, 7, 1).cast("int")).when(imo.isNotNull(), F.lit(False))


def read_imo(text: Column) -> Column:
    """The seven digits of a ship number, with or without its letters; null if it reads otherwise."""
    found = F.regexp_extract(F.trim(text), r"^(?i:imo\s*)?(\d{7})$", 1)
    return F.when(found != "", found)


def is_vessel(name: Column, kind: Column) -> Column:
    """Whether the type or a mark in the name says so; a null says nothing."""
    said = F.lower(F.trim(kind)).isin(VESSEL_TYPES) | F.rlike(F.trim(name), F.lit(VESSEL_MARK))
    return F.coalesce(said, F.lower(F.trim(kind)).isin(VESSEL_TYPES), F.rlike(F.trim(name), F.lit(VESSEL_MARK)), F.lit(False))


def trigrams(name: Column) -> Column:
    s = F.concat(F.lit(" "), name, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))


def csv_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(F.rlike(value, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), value)).otherwise(value)
