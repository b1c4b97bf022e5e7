"""What a screening gives out: a CSV of one line per candidate, a sealed JSON record, and its text in Markdown."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import csv_safe
from .records import intact, read_table, sealed

# The columns of the CSV, and what is said where a list gives no date.
COLUMNS = (
    "ref", "name", "imo", "level", "vessel_without_imo", "listed_name", "list_source", "list", "list_ids", "via_alias", "weak_alias", "listed_imo", "score", "matched_on",
    "designated_on", "designation_field", "named_parties", "renamed_ship_listed_names", "list_licence",
)
UNDATED = {"OFAC": "not published by OFAC", "OFAC-CONS": "not published by OFAC"}


def volume(spark: SparkSession, text: str) -> int:
    """Names that a file of screened volume holds: its rows, if it has the column screened_name."""
    table = read_table(text)
    if "screened_name" not in table.header:
        raise ValueError("the file has no column called screened_name")
    if not table.rows:
        raise ValueError("the file has no rows")
    return len(table.rows)


def lines(screened: DataFrame, licences: dict[str, str] | None = None) -> DataFrame:
    """The CSV's rows: one per candidate, one for a name without any; every cell a text that no spreadsheet takes for a
    formula. `licences` has the licence note of a list by its source."""
    c, text = F.col("c"), lambda x: F.coalesce(x.cast("string"), F.lit(""))
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), "yes").otherwise("")
    undated, licence = F.concat(F.lit("not stated by "), c["source"], F.lit(" for this entry")), F.lit("")
    for source, said in UNDATED.items():
        undated = F.when(c["source"] == source, said).otherwise(undated)
    for source, said in (licences or {}).items():
        licence = F.when(c["source"] == source, said).otherwise(licence)
    parties = F.array_join(F.transform(c["parties"], lambda p: F.concat(p["role"], F.lit(": "), p["name"])), "; ")
    cells = [
        text(F.col("ref")), text(F.col("name")), text(F.col("imo")), F.col("status"), yes(F.col("vessel_without_imo")), text(c["listed_name"]), text(c["source"]), text(c["list"]), text(F.array_join(c["ids"], " ")),
        text(c["alias"]), yes(c["is_weak"]), text(c["listed_imo"]), text(F.when(c.isNotNull(), F.format_string("%.3f", c["score"]))), text(c["by"]), F.when(c.isNotNull(), F.coalesce(c["designated_on"], undated)).otherwise(""), text(c["designation_field"]),
        text(parties), text(F.array_join(c["renamed"], " | ")), F.when(c.isNotNull(), licence).otherwise(""),
    ]
    rows = screened.select("line", "ref", "name", "imo", "status", "vessel_without_imo", F.posexplode_outer("candidates").alias("at", "c"))
    return rows.select("line", "at", *[csv_safe(x).alias(n) for x, n in zip(cells, COLUMNS, strict=True)])


def write_csv(screened: DataFrame, place: str, licences: dict[str, str] | None = None) -> None:
    """The rows as CSV files in the folder `place`, in the order of lines."""
    lines(screened, licences).sort("line", F.col("at")).select(*COLUMNS).write.option("header", True).option("escape", '"').option("emptyValue", "").option("quoteAll", False).csv(place)


def record(screened: DataFrame, lists: list[str], made_on: date) -> dict:
    """A sealed record of a screening: counts by status, the lists, and the candidates of every name that has any.
    For files of names that a person reads: the candidates come to the driver."""
    counts = {r["status"]: r["n"] for r in screened.groupBy("status").agg(F.count("*").alias("n")).collect()}
    found = screened.where("status <> 'no-match'").select(F.to_json(F.struct("line", "ref", "name", "imo", "status", "candidates", "others", "set_aside")).alias("j")).orderBy("line").collect()
    return sealed({"made_on": made_on.isoformat(), "lists": sorted(lists), "names": sum(counts.values()), "by_status": counts, "results": [json.loads(r.j) for r in found]})


def markdown(of: dict) -> str:
    """A record as text. One whose seal is broken is refused."""
    if not intact(of):
        raise ValueError("the record was changed after it was sealed")
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    out = [f"# Screening of {of['made_on']}", "", f"{of['names']} names against {', '.join(of['lists'])}. Seal {of['seal']}.", "", "A candidate is no finding: a person decides.", ""]
    out += ["| status | names |", "|-|-|", *(f"| {k} | {v} |" for k, v in sorted(of["by_status"].items()))]
    for r in of["results"]:
        out += ["", f"## {cell(r['name'])}" + (f" ({cell(r['ref'])})" if r.get("ref") else ""), "", f"{r['status']}; {r['others']} more candidates.", "", "| listed name | list | ids | score | by |", "|-|-|-|-|-|"]
        out += [f"| {cell(c['listed_name'])} | {cell(c['source'])} {cell(c['list'])} | {cell(' '.join(c['ids']))} | {c['score']:.3f} | {cell(c['by'])} |" for c in r["candidates"]]
        out += [f"Set aside by ship number: {cell(x['listed_name'])} ({x['listed_imo']})." for x in r.get("set_aside") or []]
    return "\n".join(out) + "\n"
