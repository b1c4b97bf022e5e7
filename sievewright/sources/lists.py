"""Sanctions lists: nine published formats, read to one schema of entries.

Every reader gives source, id, name, alias, weak (aliases said to be weak), type (person, entity, vessel or other),
programme, imo, other_imo, designated_on, designation_field, parties (role, name) and regulations. What a list doesn't
say is null or an empty array. Entries without a name or an id are no entries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.entity import prepared_entity
from ..functions.keys import read_imo

NAMES, PARTIES = "array<string>", "array<struct<role:string,name:string>>"
TYPES = {"Individual": "person", "Entity": "entity", "Vessel": "vessel", "Ship": "vessel"}


def none() -> Column:
    return F.lit(None).cast("string")


def empty(kind: str = NAMES) -> Column:
    return F.array().cast(kind)


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def filled(names: Column) -> Column:
    """The names that aren't blank, trimmed."""
    return F.filter(F.transform(F.coalesce(names, empty()), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def joined(*cols: str | Column) -> Column:
    return tidy(F.concat_ws(" ", *cols))


def presence(text: Column) -> Column:
    """The text trimmed, or null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def kind(said: Column, types: dict[str, str] = TYPES) -> Column:
    out = F.lit("other")
    for name, type_ in types.items():
        out = F.when(F.trim(said) == name, type_).otherwise(out)
    return out


def parties(role: str, names: Column) -> Column:
    named = F.filter(F.transform(F.coalesce(names, empty()), tidy), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.transform(named, lambda x: F.struct(F.lit(role).alias("role"), x.alias("name")))


def entry(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    default = {"alias": empty(), "weak": empty(), "programme": none(), "imo": none(), "other_imo": empty(), "designated_on": none(), "designation_field": none(), "parties": empty(PARTIES), "regulations": empty()}
    made = {"source": F.lit(source), "id": None, "name": None, "alias": None, "weak": None, "type": None} | default | columns
    made["designation_field"] = F.when(made["designated_on"].isNotNull(), made["designation_field"])
    return df.select(*[c.alias(n) for n, c in made.items()]).where("name <> '' and id <> ''")


def xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


OFAC = """uid string, firstName string, lastName string, sdnType string, remarks string,
programList struct<program:array<string>>, vesselInfo struct<vesselOwner:string>,
akaList struct<aka:array<struct<category:string,firstName:string,lastName:string>>>,
idList struct<id:array<struct<idType:string,idNumber:string>>>"""


def read_ofac(spark: SparkSession, path: str, source: str = "OFAC") -> DataFrame:
    """The US Treasury's XML lists. The ship number is the first registration of the form "IMO nnnnnnn"."""
    aka = F.coalesce("akaList.aka", empty("array<struct<category:string,firstName:string,lastName:string>>"))
    said = lambda rows: filled(F.transform(rows, lambda x: joined(x["firstName"], x["lastName"])))
    ids = F.coalesce("idList.id", empty("array<struct<idType:string,idNumber:string>>"))
    ships = F.filter(ids, lambda x: F.coalesce((x["idType"] == "Vessel Registration Identification") & F.rlike(F.trim(x["idNumber"]), F.lit(r"^IMO\s*\d{7}$")), F.lit(False)))
    remarks = F.regexp_replace(F.trim(F.coalesce("remarks", F.lit(""))), r"(?s)^\((.*)\)$", "$1")
    linked = F.filter(F.transform(F.split(remarks, ";"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit("^(?i:Linked To:)")))
    linked = F.transform(linked, lambda x: F.regexp_replace(x, r"^(?i:Linked To:)\s*", ""))
    return entry(
        xml(spark, path, "sdnEntry", OFAC), source, id=F.coalesce("uid", F.lit("")), name=joined("firstName", "lastName"), alias=said(aka), weak=said(F.filter(aka, lambda x: F.coalesce(x["category"] == "weak", F.lit(False)))),
        type=kind(F.col("sdnType")), programme=presence(F.array_join("programList.program", "+")), imo=F.get(F.transform(ships, lambda x: F.right(F.trim(x["idNumber"]), F.lit(7))), 0),
        parties=F.concat(parties("vesselOwner", F.array("vesselInfo.vesselOwner")), parties("Linked To", linked)),
    )


def announced(spark: SparkSession, path: str, read: int) -> str | None:
    """What is odd about the number of records that the Treasury's file announces; null if nothing is."""
    said = xml(spark, path, "publshInformation", "Record_Count string").select(F.expr("try_cast(Record_Count as long)")).first()
    if said is None or not said[0] or said[0] <= 0:
        return "the file announces no number of records"
    return None if said[0] == read else f"the file announces {said[0]} records, {read} were read"


UN = """DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string,
LISTED_ON string, {kind}_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>"""


def read_un(spark: SparkSession, path: str) -> DataFrame:
    """The United Nations' XML list: persons and entities."""
    parts = []
    for tag, type_ in (("INDIVIDUAL", "person"), ("ENTITY", "entity")):
        parts.append(entry(
            xml(spark, path, tag, UN.format(kind=tag)), "UN", id=F.coalesce("DATAID", F.lit("")), name=joined("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME"), alias=filled(F.col(f"{tag}_ALIAS.ALIAS_NAME")),
            type=F.lit(type_), programme=presence(F.col("UN_LIST_TYPE")), designated_on=presence(F.col("LISTED_ON")), designation_field=F.lit("LISTED_ON"),
        ))
    return parts[0].unionByName(parts[1])


EU = """_logicalId string, nameAlias array<struct<_wholeName:string>>, subjectType array<struct<_code:string>>,
regulation array<struct<_programme:string,_entryIntoForceDate:string,_numberTitle:string>>"""


def read_eu(spark: SparkSession, path: str) -> DataFrame:
    """The European Union's XML list, whose fields are attributes. The first regulation dates the entry."""
    names, rules = filled(F.col("nameAlias._wholeName")), F.col("regulation")
    first = lambda field: F.get(rules[field], F.lit(0))
    number = first("_numberTitle")
    field = F.concat(F.lit("regulation entryIntoForceDate"), F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit(" ("), number, F.lit(")"))).otherwise(""))
    return entry(
        xml(spark, path, "sanctionEntity", EU), "EU", id=F.coalesce("_logicalId", F.lit("")), name=F.coalesce(F.get(names, F.lit(0)), F.lit("")), alias=F.slice(names, 2, 1 << 30),
        type=kind(F.get(F.col("subjectType._code"), F.lit(0)), {"person": "person", "enterprise": "entity"}), programme=presence(first("_programme")), designated_on=presence(first("_entryIntoForceDate")),
        designation_field=field, regulations=filled(rules["_numberTitle"]),
    )


UK = """UniqueID string, RegimeName string, IndividualEntityShip string, DateDesignated string,
Names struct<Name:array<struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string,AliasStrength:string>>>,
NonLatinNames struct<NonLatinName:array<struct<NameNonLatinScript:string>>>,
ShipDetails struct<Ship:array<struct<IMONumbers:struct<IMONumber:array<string>>,CurrentOwnerOperators:struct<CurrentOwnerOperator:array<string>>,PreviousOwnerOperators:struct<PreviousOwnerOperator:array<string>>>>>"""


def read_uk(spark: SparkSession, path: str) -> DataFrame:
    """The United Kingdom's XML list. Names in other scripts are aliases, those of low quality weak ones; a ship's
    further numbers are kept beside the first."""
    name = lambda x: joined(*[F.trim(x[f"Name{k}"]) for k in range(1, 7)])
    says = lambda x, c, pattern: F.rlike(F.trim(F.coalesce(x[c], F.lit(""))), F.lit(pattern))
    rows = F.transform(F.coalesce("Names.Name", empty("array<struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string,AliasStrength:string>>")),
                       lambda x: F.struct(name(x).alias("name"), says(x, "NameType", "^(?i:primary name)$").alias("main"), says(x, "AliasStrength", "^(?i:low quality)").alias("weak")))
    df = xml(spark, path, "Designation", UK).withColumn("rows", F.filter(rows, lambda x: x["name"] != ""))
    at = F.greatest(F.lit(1), F.array_position(F.col("rows.main"), F.lit(True)).cast("int"))
    df = df.withColumn("main", F.coalesce(F.get("rows.name", at - 1), F.lit(""))).withColumn("rest", F.filter("rows", lambda x, k: k != at - 1))
    imos = F.array_distinct(F.filter(F.transform(F.flatten(F.col("ShipDetails.Ship.IMONumbers.IMONumber")), read_imo), lambda x: x.isNotNull()))
    imos = F.coalesce(imos, empty())
    own = lambda which: F.coalesce(F.flatten(F.filter(F.col(f"ShipDetails.Ship.{which}OwnerOperators.{which}OwnerOperator"), lambda x: x.isNotNull())), empty())
    native = filled(F.col("NonLatinNames.NonLatinName.NameNonLatinScript"))
    return entry(
        df, "UK", id=F.coalesce("UniqueID", F.lit("")), name=F.col("main"), alias=F.array_remove(F.array_distinct(F.concat("rest.name", native)), F.col("main")),
        weak=F.array_distinct(F.transform(F.filter("rest", lambda x: x["weak"]), lambda x: x["name"])), type=kind(F.col("IndividualEntityShip")), programme=presence(F.col("RegimeName")),
        imo=F.get(imos, F.lit(0)), other_imo=F.slice(imos, 2, 1 << 30), designated_on=presence(F.col("DateDesignated")), designation_field=F.lit("DateDesignated"),
        parties=F.concat(parties("CurrentOwnerOperator", own("Current")), parties("PreviousOwnerOperator", own("Previous"))),
    )


#: XML's own entities, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&"))


def cell_text(cell: Column) -> Column:
    out = F.regexp_replace(cell, "<[^>]+>", " ")
    for coded, sign in ENTITIES:
        out = F.replace(out, F.lit(coded), F.lit(sign))
    return tidy(out)


def read_eu_vessels(spark: SparkSession, path: str) -> DataFrame:
    """The ships of Annex XLII to regulation 833/2014, a table of an XHTML page: rank, name, ship number, reason, date.
    A number that returns keeps its first row; other names of it are aliases."""
    page = spark.read.text(path, wholetext=True)
    annex = F.regexp_extract("value", r"(?s)(ANNEX\s+XLII\b.*?)(?:ANNEX\s+XLIII\b|\z)", 1)
    rows = page.select(F.posexplode(F.regexp_extract_all(annex, F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("at", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?s)<td\b[^>]*>(.*?)</td>"), F.lit(1)), cell_text)
    cell = lambda k: F.coalesce(F.get("c", F.lit(k)), F.lit(""))
    ships = rows.select("at", cells.alias("c")).where(F.rlike(cell(0), F.lit(r"^\d+\.?$")) & F.rlike(cell(2), F.lit(r"^\d{7}$")) & (cell(1) != ""))
    ships = ships.select(F.struct("at", cell(1).alias("name"), cell(4).alias("day")).alias("r"), cell(2).alias("number"))
    by = ships.groupBy("number").agg(F.array_sort(F.collect_list("r")).alias("rows"))  # as many rows as names that one ship has had
    names = F.col("rows.name")
    return entry(
        by, "EU-VESSELS", id=F.concat(F.lit("IMO"), "number"), name=F.get(names, F.lit(0)), alias=F.array_remove(F.array_distinct(names), F.get(names, F.lit(0))), type=F.lit("vessel"),
        programme=F.lit("833/2014 Annex XLII"), imo=F.col("number"), designated_on=presence(F.get("rows.day", F.lit(0))), designation_field=F.lit("Date of application"),
    )


CA = """`Country-Pays` string, `LastName-NomDeFamille` string, `GivenName-Prenom` string, `EntityOrShip-EntiteOuNavire` string,
`Aliases-Alias` string, `Schedule-Annexe` string, `Item-NumeroDarticle` string, `ShipIMONumber-NumeroOMIDuNavire` string,
`DateOfListing-DateDinscription` string"""


def read_ca(spark: SparkSession, path: str) -> DataFrame:
    """Canada's XML list. An entry is named by country, schedule and item; what returns gets a number. A record with a
    person's name is a person, another with a legible ship number a vessel."""
    field = lambda c: F.coalesce(tidy(F.col(f"`{c}`")), F.lit(""))
    last, given, other = field("LastName-NomDeFamille"), field("GivenName-Prenom"), field("EntityOrShip-EntiteOuNavire")
    person = (last != "") | (given != "")
    country = F.trim(F.get(F.split(field("Country-Pays"), " / "), F.lit(0)))
    df = xml(spark, path, "record", CA).withColumns({
        "name": F.when(person, joined(given, last)).otherwise(other), "person": person, "country": country,
        "key": F.concat_ws("|", country, field("Schedule-Annexe"), field("Item-NumeroDarticle")), "at": F.monotonically_increasing_id(),
    }).where("name <> ''")
    again = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    df = df.withColumn("again", again).withColumn("number", F.when(~F.col("person"), read_imo(field("ShipIMONumber-NumeroOMIDuNavire"))))
    alias = F.transform(F.split(field("Aliases-Alias"), "[;,]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[A-Z][A-Za-z]+:\s*", "")))
    return entry(
        df, "CA", id=F.when(F.col("again") == 1, F.col("key")).otherwise(F.concat("key", F.lit("#"), "again")), name=F.col("name"),
        alias=F.array_distinct(F.filter(alias, lambda x: (F.char_length(x) > 1) & (x != F.col("name")))), type=F.when(F.col("person"), "person").when(F.col("number").isNotNull(), "vessel").otherwise("entity"),
        programme=presence(F.col("country")), imo=F.col("number"), designated_on=presence(F.col("`DateOfListing-DateDinscription`")), designation_field=F.lit("DateOfListing"),
    )


def read_csl(spark: SparkSession, path: str) -> DataFrame:
    """The US consolidated CSV but for the Treasury's rows, which its own files hold."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if lacking := [c for c in ("_id", "source", "type", "programs", "name", "alt_names") if c not in df.columns]:
        raise ValueError(f"the list has no column {lacking[0]}: its format changed")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) if c in df.columns else F.lit("")
    origin = F.trim(F.get(F.split(text("source"), " - "), F.lit(0)))
    programme = F.when(origin != "", F.concat(origin, F.when(text("programs") != "", F.concat(F.lit(": "), text("programs"))).otherwise("")))
    return entry(
        df.where(~F.contains(text("source"), F.lit("Treasury Department"))), "CSL", id=text("_id"), name=text("name"), alias=filled(F.split(text("alt_names"), ";")), type=kind(F.col("type"), {k: v for k, v in TYPES.items() if k != "Ship"}),
        programme=programme, designated_on=presence(text("start_date")), designation_field=F.lit("start_date"), parties=parties("vessel_owner", F.array(text("vessel_owner"))),
    )


# A workbook's built-in formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
MAIN, RELATIONS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def is_date(number: int, codes: dict[int, str]) -> bool:
    """A cell format that writes days, months or years."""
    bare = re.sub(r'\[[^\]]*\]|"[^"]*"|\\.', "", codes.get(number, ""))
    return number in DATE_FORMATS or bool(re.search("[dmy]", bare, re.I)) and not re.search("[#0?]", bare)


def sheet_rows(data: bytes, wanted: str | int) -> Iterator[list[str]]:
    """The rows of a workbook's sheet, by name or position, that hold anything: cells as text, dates as YYYY-MM-DD."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise ValueError(f"not a workbook: {e}") from e
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name", ""), targets.get(s.get(f"{RELATIONS}id"), "")) for s in root.iter(f"{MAIN}sheet")]
    found = sheets[wanted : wanted + 1] if isinstance(wanted, int) else [s for s in sheets if s[0] == wanted]
    if not found:
        raise ValueError(f"the workbook has no sheet {wanted!r}, but {[s for s, _ in sheets]}: its layout changed")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
    shared, dates = [], []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    if "xl/styles.xml" in book.namelist():
        styles = ElementTree.fromstring(book.read("xl/styles.xml"))
        codes = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        dates = [is_date(int(x.get("numFmtId", 0)), codes) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf")]

    def value(cell: ElementTree.Element) -> str:
        how, v = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if how == "inlineStr":
            return text(cell)
        if v is None:
            return ""
        if how == "s":
            return shared[int(v)] if int(v) < len(shared) else ""
        if how == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(v, "")
        style = int(cell.get("s", -1))
        if how == "n" and 0 <= style < len(dates) and dates[style]:
            return str(date(1899, 12, 30) + timedelta(days=int(float(v))))
        return v

    path = found[0][1]
    with book.open(path[1:] if path.startswith("/") else f"xl/{path}") as stream:
        for _, row in ElementTree.iterparse(stream):  # row by row: a sheet may be long
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str] = []
            for cell in row.iter(f"{MAIN}c"):
                letters, column = re.match("[A-Z]*", cell.get("r", ""))[0], 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                if column:
                    cells += [""] * (column - len(cells))
                    cells[column - 1] = value(cell)
            row.clear()
            if any(c.strip() for c in cells):
                yield cells


def read_sheet(spark: SparkSession, path: str, sheet: str | int, columns: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """at (from 0) and the named columns, as text, of a sheet: the first row that holds all of `columns` is the header;
    columns in `more` may lack."""
    same = lambda x: " ".join(x.split()).lower()
    every = [*columns, *more]

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in files:
            for data in part["content"]:
                header, out = None, []
                for cells in sheet_rows(data, sheet):
                    if header is None:
                        names = {same(c): k for k, c in enumerate(cells)}
                        header = names if all(same(c) in names for c in columns) else None
                        continue
                    own = [header.get(same(c), len(cells)) for c in every]
                    out.append((len(out), *(cells[k].strip() if k < len(cells) else "" for k in own)))
                if header is None:
                    raise ValueError(f"sheet {sheet!r} has no row with the columns {columns}: its layout changed")
                yield pd.DataFrame(out, columns=["at", *every])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(["at long", *(f"`{c}` string" for c in every)]))


def read_au(spark: SparkSession, path: str) -> DataFrame:
    """Australia's workbook: a row per name, the rows of one reference number an entry."""
    rows = read_sheet(spark, path, 0, ["Reference", "Name of Individual or Entity", "Type", "Name Type", "Alias Strength", "Listing Information", "IMO Number", "Committees"])
    rows = rows.select("at", F.regexp_extract("Reference", r"^(\d+)", 1).alias("ref"), F.col("`Name of Individual or Entity`").alias("name"), "Type", F.rlike("`Name Type`", F.lit("^(?i:primary name)$")).alias("main"),
                       F.rlike("`Alias Strength`", F.lit("^(?i:weak)$")).alias("weak"), F.col("`Listing Information`").alias("listing"), read_imo(F.col("`IMO Number`")).alias("number"), "Committees")
    # first the principal name, else the first row; an entry has as many rows as names
    by = rows.where("ref <> '' and name <> ''").groupBy("ref").agg(F.array_sort(F.collect_list(F.struct((~F.col("main")).alias("later"), "at", "name", "Type", "weak", "listing", "number", "Committees"))).alias("rows"))
    by = by.withColumn("first", F.get("rows", F.lit(0))).withColumn("rest", F.slice("rows", 2, 1 << 30))
    day = F.regexp_extract(F.col("first.listing"), r"\bListed\b.{0,80}?\bon (\d{1,2} [A-Za-z]{3,9}\.? \d{4})", 1)
    others = lambda rows: F.array_remove(F.array_distinct(F.transform(rows, lambda x: x["name"])), F.col("first.name"))
    return entry(
        by, "AU", id=F.col("ref"), name=F.col("first.name"), alias=others(F.col("rest")), weak=others(F.filter("rest", lambda x: x["weak"])), type=kind(F.col("first.Type")), programme=presence(F.col("first.Committees")),
        imo=F.get(F.filter(F.transform(F.array_sort(F.transform("rows", lambda x: F.struct(x["at"], x["number"]))), lambda x: x["number"]), lambda x: x.isNotNull()), F.lit(0)),
        designated_on=presence(day), designation_field=F.lit("Listing Information"),
    )


def read_nz(spark: SparkSession, path: str) -> DataFrame:
    """New Zealand's register: persons, entities, banks and assets under sanctions, and the sheet of ships."""
    rule = F.lit("Russia Sanctions Regulations 2022")
    split = lambda c, at, own: F.array_remove(F.array_distinct(filled(F.split(F.col(c), at))), own)
    types = {"Individual": "person", "Entity": "entity", "Bank": "entity", "Asset": "other"}
    main = read_sheet(spark, path, "Russia Sanctions Register", ["Type", "Unique Identifier", "First name", "Last name", "Sanction Status", "Date of Sanction"], ("Middle name(s)", "Name of Asset", "Alias/Alternate Spellings", "Associates/Relatives"))
    asset = F.col("Type") == "Asset"
    main = main.where(F.col("Type").isin(*types) & F.rlike("`Sanction Status`", F.lit("^(?i:sanctioned)$"))).withColumn("name", F.when(asset, F.coalesce(presence(F.col("`Name of Asset`")), F.col("`First name`"))).otherwise(joined("`First name`", "`Middle name(s)`", "`Last name`")))
    one = entry(
        main, "NZ", id=F.col("`Unique Identifier`"), name=F.col("name"), alias=split("`Alias/Alternate Spellings`", ";", F.col("name")), type=kind(F.col("Type"), types), programme=rule,
        designated_on=presence(F.col("`Date of Sanction`")), designation_field=F.lit("Date of Sanction"), parties=parties("Associates/Relatives", F.array("`Associates/Relatives`")),
    )
    ship = "Name of Ship as of Date of Sanction"
    ships = read_sheet(spark, path, "Ships", ["Type", "Unique Identifier", "IMO Number", ship, "Date of Sanction"], ("Record Deleted Flag", "Sanction Status", "Alias/Alternate Names"))
    gone = F.rlike("`Record Deleted Flag`", F.lit("^(?i:yes)$")) | (F.col("`Sanction Status`") != "") & ~F.rlike("`Sanction Status`", F.lit("^(?i:sanctioned)$"))
    two = entry(
        ships.where(~gone), "NZ", id=F.col("`Unique Identifier`"), name=F.col(f"`{ship}`"), alias=split("`Alias/Alternate Names`", "[;,]", F.col(f"`{ship}`")), type=F.lit("vessel"), programme=rule,
        imo=read_imo(F.col("`IMO Number`")), designated_on=presence(F.col("`Date of Sanction`")), designation_field=F.lit("Date of Sanction"),
    )
    return one.unionByName(two)


#: Readers by the name of the format.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ofac-sdn-xml": read_ofac,
    "un-consolidated-xml": read_un,
    "eu-fsf-xml": read_eu,
    "uk-sanctions-xml": read_uk,
    "eu-833-annex-xlii-xhtml": read_eu_vessels,
    "gac-sema-xml": read_ca,
    "trade-csl-csv": read_csl,
    "dfat-consolidated-xlsx": read_au,
    "mfat-russia-register-xlsx": read_nz,
}


def read_list(spark: SparkSession, path: str, format: str, source: str | None = None) -> DataFrame:
    """The entries of a list. One without entries is an error: that is the sign of another format, not of a short list."""
    if format not in FORMATS:
        raise ValueError(f"{format} is no known format: {', '.join(FORMATS)}")
    out = read_ofac(spark, path, source) if format == "ofac-sdn-xml" and source else FORMATS[format](spark, path)
    if out.isEmpty():
        raise ValueError(f"the file doesn't look like {format}: it has no entry that can be read")
    return out


def not_in_feed(supplement: DataFrame, feed: DataFrame, act: str) -> DataFrame:
    """The entries of a supplement that the feed doesn't hold yet: none of its entries under the act's number (say
    2026/2193, at the head of a regulation's title) has, as name or alias, the same words in any order."""
    key = lambda text: F.array_join(F.array_sort(F.split(text, " ")), " ")
    under = F.exists("regulations", lambda r: F.rlike(r, F.lit(rf"^\s*{re.escape(act)}(?![\d/])")))
    held = feed.where(under).select(F.explode(F.concat(F.array("name"), "alias")).alias("listed"))
    held = held.select(key(prepared_entity("listed")[0]).alias("words")).distinct()
    own = supplement.withColumn("words", key(prepared_entity("name")[0]))
    return own.join(held, "words", "left_anti").drop("words")
