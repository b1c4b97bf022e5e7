import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from sievewright import queries
from sievewright.functions import entity, keys, text
from sievewright.functions.intervals import distinguishable, sign_test, wilson, wilson_columns, z_for
from sievewright.operators import matchers, measure, screen, synthetic
from sievewright.sources import lists, records, reports


def test_normalise_and_prepare():
    assert text.normalise("  José-MARÍA  O'Neil ") == "jose maria o neil"
    assert text.prepare("Мухаммед") == "mukhammed"
    assert text.prepare("") == ""


@pytest.mark.parametrize("a,b,expected", [("ca", "abc", 3), ("abc", "acb", 1), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_restricted_distance(a, b, expected):
    assert matchers.osa(a, b) == expected


def test_matchers_by_hand():
    s = {k: m.checked for k, m in matchers.REGISTRY.items()}
    assert s["jaro-winkler"]("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert s["tokens"]("J Smith", "John Smith") == 1.0
    assert s["tokens"]("a b c", "c b") == pytest.approx(2 / 3)
    assert s["phonetic"]("", "") == 0 and s["exact"]("", "") == 1 and s["damerau"]("", "") == 1
    assert s["ngrams"]("acme", "acme") == 1.0
    assert text.phonetic_key("knight") == "nt" and text.phonetic_key("aaron") == "rn" and text.phonetic_key("philip") == "flp"


def test_matchers_are_symmetric_bounded_and_reflexive():
    names = ["acme ltd", "ltd acme", "acmee", "", "ab", "Société Générale", "шахтер"]
    for m in matchers.REGISTRY.values():
        for a in names:
            assert m.id == "phonetic" or m.checked(a, a) == 1
            for b in names:
                assert 0 <= m.checked(a, b) <= 1
                assert m.checked(a, b) == pytest.approx(m.checked(b, a))


def test_intervals(spark):
    low, high = wilson(8, 10)
    assert (low, high) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4)) and wilson(0, 0) == (0, 1)
    with pytest.raises(ValueError):
        wilson(3, 2)
    cells = spark.createDataFrame([(8, 10), (0, 0), (5, 5)], "k long, n long")
    for r in cells.select("k", "n", *[c.alias(x) for c, x in zip(wilson_columns(F.col("k"), F.col("n")), ("l", "h"), strict=True)]).collect():
        assert (r.l, r.h) == pytest.approx(wilson(r.k, r.n))
    assert z_for(0.97) == 1.96 and distinguishable((0, 0.1), (0.2, 0.3)) and sign_test(0, 0) is None
    assert sign_test(5, 0) == pytest.approx(0.0625)


def test_grid_against_counting(spark):
    rows = [("m", 1, s / 37, "match" if s % 3 else "different") for s in range(38)] + [("m", 1, 0.99996, "match"), ("m", 1, 0.57, "match")]
    grid = {r.threshold: r for r in measure.threshold_grid(spark.createDataFrame(rows, "tier string, rank int, score double, verdict string")).collect()}
    assert len(grid) == 51
    for i in range(50, 101):
        t = i / 100
        assert grid[t].fired == sum(s >= t for _, _, s, _ in rows)
        assert grid[t].recall_successes == sum(s >= t and v == "match" for _, _, s, v in rows)


def test_alert_contract(spark):
    good = [(str(i), "a", "b", "L", " Match " if i % 2 else "FALSE_POSITIVE") for i in range(30)]
    schema = "alert_id string, screened_name string, list_name string, list_source string, disposition string"
    assert measure.checked_alerts(spark.createDataFrame(good, schema)).where("disposition = 'match'").count() == 15
    for bad in (good[:29], good[:29] + good[:1], [*good[:29], ("x", "a", "b", "L", "pending")], [*good[:29], ("", "a", "b", "L", "match")]):
        with pytest.raises(ValueError):
            measure.checked_alerts(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        measure.checked_alerts(spark.createDataFrame(good, schema).withColumn("other", F.lit(1)))


def test_ship_numbers(spark):
    rows = spark.createDataFrame([("9074729",), ("9074728",), ("12",), (None,)], "imo string").select(keys.imo_valid(F.col("imo")).alias("v")).collect()
    assert [r.v for r in rows] == [True, False, False, None]
    assert spark.range(1).select(keys.read_imo(F.lit("IMO 9074729")).alias("v")).first().v == "9074729"


def test_csv(spark):
    t = records.read_table('﻿name,ref\r\n"a, ""b""\nc",1\r\n\r\nshort\r\nlong,2,3\r\n')
    assert t.header == ["name", "ref"] and t.rows == [['a, "b"\nc', "1"], ["short"]] and len(t.too_long) == len(t.short) == 1
    for bad in ("", 'a\n"open', "a,a\n1,2"):
        with pytest.raises(ValueError):
            records.read_table(bad)
    assert records.read_parties(spark, "Name,IMO\nAcme,IMO 9074729\n,1\nB,zz\n").select("name", "imo").collect() == [("Acme", "9074729"), ("B", None)]
    r = records.sealed({"b": 1, "a": [1.5, None]})
    assert records.intact(r) and not records.intact(r | {"b": 2})


def test_synthetic_variants():
    v = synthetic.variants("José Haddad", 7)
    assert len(v) == 6 and len({x for x, _ in v}) == 6 and ("Jose Haddad", "no-diacritics") in v and all(x != "José Haddad" for x, _ in v)
    assert synthetic.variants("José Haddad", 7) == v and {k for _, k in v} <= set(synthetic.KINDS)


ENTRIES = [
    ("L", "1", "Acme Trading Company", ["Acme Commerce"], ["AT Co"], "entity", "P", None, []),
    ("L", "2", "Ocean Star", [], [], "vessel", "P", "9074729", []),
    ("L", "3", "Globex Industries", [], [], "entity", "P", None, []),
]


def test_screening_and_changes(spark):
    entries = spark.createDataFrame(ENTRIES, screen.ENTRY)
    parties = spark.createDataFrame([(1, "Acme Tradng Company", "r1", None, None), (2, "Renamed Ship", "r2", "9074729", "vessel"), (3, "Nothing Alike", "r3", None, None), (4, "Ocean Star", "r4", "9999999", "vessel")], "line long, name string, ref string, imo string, type string")
    got = {r.line: r for r in screen.screen(parties, entries).collect()}
    assert got[1].status == "strong" and got[1].candidates[0].ids == ["1"]
    assert got[2].status == "strong" and got[2].candidates[0].by == "imo"
    assert got[3].status == "no-match" and got[4].status == "no-match" and got[4].set_aside[0].listed_name == "Ocean Star"
    exact = {r.line: r for r in screen.screen(parties, entries, exhaustive=True).collect()}
    assert exact == got
    after = screen.screen(parties.where("line <> 3"), entries.where("id <> '1'"))
    assert {(r.change, r.key) for r in screen.changes(screen.screen(parties, entries), after).collect()} == {("candidate gone", "ref:r1"), ("party removed", "ref:r3")}


@pytest.mark.parametrize(
    "a,b",
    [
        ("Orion Maritime Ltd", "Orion Maritime Limited"), ("OOO Kamaflot", "Kamaflot OOO"), ("Lindqvar Hydraulik GmbH", "Lindqvar Hydraulik Gesellschaft mit beschränkter Haftung"), ("Établissements Garnavel et Compagnie", "Ets Garnavel & Cie"),
        ("Compañía Minera Hualla S.A.C.", "Cía. Minera Hualla SAC"), ("SHIRATSUNE MARU NO18", "Shiratsune Maru No. 18"), ("Camlibelen Dokum San. ve Tic. Ltd. Sti.", "Çamlıbelen Döküm Sanayi ve Ticaret Limited Şirketi"), ("M/V Golden Crane", "Golden Crane"),
    ],
)
def test_two_spellings_are_prepared_alike(a, b):
    assert entity.parts(a).words == entity.parts(b).words


def test_entity_preparation():
    words = lambda n: " ".join(entity.parts(n).words)
    assert words("Company Limited") == "company limited" and words("Ag. Prokopis II") == "ag prokopis 2" and words("Prokopis Trading AG") == "prokopis trading" and words("") == ""
    apart = lambda a, b: entity.parts(a).conflicts(entity.parts(b))
    assert apart("Wexmoor GmbH", "Wexmoor Inc.") and apart("MV Orlessa Dawn", "Orlessa Dawn Shipping Ltd") and not apart("Kamaflot OOO", "Kamaflot LLC") and not apart("A Pte. Ltd.", "A Private Limited")


def test_entity_score_by_hand():
    score = lambda a, b, u=None, v=None, **k: screen.entity_score(a.split(), b.split(), u or [1.0] * len(a.split()), v or [1.0] * len(b.split()), **k)
    assert score("hong da 1", "hong da 8") == 0 and score("karina 2", "karina 2") == 1 and score("ocean pearl", "ocean pearl 2") == pytest.approx(0.8)
    assert score("quarrington metals", "quarrington metals jebel zone dubai") == pytest.approx(0.8)  # contained
    assert score("petro link", "petrolink") == 1 and score("northwick logistics", "northwick engineering") < 0.6
    assert score("", "a") == 0 and score("acme", "acme", doubt=True) == pytest.approx(0.8)
    assert score("golden crane shipping", "golden crane", [1, 1, 5], [1, 1]) == pytest.approx(0.8)  # what is rare is left over
    assert score("alpha kestrel", "alpha ketsrel") > 0.85 and screen.typing_error("amber", "amebr") and screen.typing_error("amber", "ambr") and not screen.typing_error("amber", "ambar")


def test_candidates_lose_nothing(spark):
    """Perturbed names against a list: joins on keys find what comparing everything finds, from few pairs."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 8)))
    common = ["trading", "shipping", "holdings", "global", "marine"]
    listed = [" ".join([*(word() for _ in range(rng.randrange(1, 4))), *rng.sample(common, rng.randrange(3))]) for _ in range(150)] + common[:2]

    def worse(name):
        letters = list(name)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(letters))
            how = rng.randrange(5)
            letters[k : k + 2] = {0: letters[k : k + 2][::-1], 1: letters[k + 1 : k + 2], 2: [rng.choice("aeiou"), *letters[k : k + 2]], 3: [rng.choice("bst"), *letters[k + 1 : k + 2]], 4: letters[k : k + 2] + [" "]}[how]
            if not "".join(letters).strip():
                return name
        return "".join(letters)

    sent = [worse(rng.choice(listed)) for _ in range(200)] + [f"{rng.choice(listed)} {rng.choice(common)} ltd" for _ in range(20)]
    entries = spark.createDataFrame([("L", str(k), n, [], [], "entity", "P", None, []) for k, n in enumerate(listed)], screen.ENTRY)
    parties = spark.createDataFrame([(k, n, None, None, None) for k, n in enumerate(sent)], "line long, name string, ref string, imo string, type string")
    fast, all_ = ({r.line: r for r in screen.screen(parties, entries, exhaustive=x).collect()} for x in (False, True))
    assert fast == all_ and sum(r.status != "no-match" for r in fast.values()) > 120
    a, b = screen.texts(parties, "name"), screen.texts(entries, "name")
    often = b.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    assert screen.candidates(screen.weighed(a, often, 150), screen.weighed(b, often, 150)).count() < 0.1 * len(sent) * len(listed)


def test_names_that_share_only_common_words_or_trigrams_are_no_candidates(spark):
    rng = random.Random(4)
    made = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(80)})
    names = [f"trading {w}" if k % 2 else f"{w[:5]} {w[5:]}ing co" for k, w in enumerate(made)] + ["sun rise", "sunrise", "trading", "trading ltd"]
    entries = spark.createDataFrame([("L", str(k), n, [], [], "entity", "P", None, []) for k, n in enumerate(names)], screen.ENTRY)
    once = screen.texts(entries, "name")
    often = spark.createDataFrame([("none", 1)], "w string, df long")  # all words weigh alike
    own = screen.weighed(once, often, 100)
    found = {tuple(r) for r in screen.candidates(own, own).collect()}
    texts = {r.text: (list(r.words), list(r.weights)) for r in own.collect()}
    right = {(a, b) for a, (x, u) in texts.items() for b, (y, v) in texts.items() if screen.entity_score(x, y, u, v) >= screen.POSSIBLE - 1e-9}
    assert right <= found and ("sun rise", "sunrise") in found and len(found) < 3 * len(right)


def test_reports(spark, tmp_path):
    rows = [("OFAC", "1", "=Ocean Star", ["Star O"], [], "vessel", "P", "9074729", [], None, None, [("vesselOwner", "Big Co")]), ("L", "2", "Globex, Industries", [], ["Globex"], "entity", None, None, [], "2020-01-02", "start_date", [])]
    entries = spark.createDataFrame(rows, f"{screen.ENTRY}, {screen.MORE}")
    parties = spark.createDataFrame([(1, "New Name", "r|1", "9074729", None), (2, "Globex Industries", None, None, None), (3, "M/V Nobody", None, None, None), (4, "Globex", None, None, None)], "line long, name string, ref string, imo string, type string")
    got = screen.screen(parties, entries)
    reports.write_csv(got, str(tmp_path / "csv"), {"L": "free"})
    text = "".join(sorted((f.read_text() for f in (tmp_path / "csv").glob("part-*")), key=lambda t: "New Name" not in t))
    t = records.read_table(text)
    assert tuple(t.header) == reports.COLUMNS
    by = {r[1]: dict(zip(t.header, r, strict=True)) for r in t.rows if r[1] != "name"}
    one, two, three, four = by["New Name"], by["Globex Industries"], by["M/V Nobody"], by["Globex"]
    assert (one["listed_name"], one["matched_on"], one["score"], one["renamed_ship_listed_names"], one["named_parties"], one["designated_on"]) == ("'=Ocean Star", "imo", "1.000", "'=Ocean Star | Star O", "vesselOwner: Big Co", "not published by OFAC")
    assert (two["level"], two["designated_on"], two["list_licence"], two["list_ids"]) == ("strong", "2020-01-02", "free", "2")
    assert (three["level"], three["vessel_without_imo"], three["list_source"]) == ("no-match", "yes", "") and (four["level"], four["weak_alias"], four["via_alias"], four["score"]) == ("possible", "yes", "Globex", "0.800")
    record = reports.record(got, ["L", "OFAC"], date(2026, 1, 2))
    shown = reports.markdown(record)
    assert record["names"] == 4 and "## New Name (r\\|1)" in shown and "| Globex, Industries | L  | 2 | 1.000 | name |" in shown
    with pytest.raises(ValueError):
        reports.markdown(record | {"names": 5})
    assert reports.volume(spark, "id,screened_name\n1,a\n2,b\n") == 2
    with pytest.raises(ValueError):
        reports.volume(spark, "id\n1\n")


def test_vessel_marks(spark):
    rows = [("R/M Bull", None, True), ("T/KH Volga", None, True), ("Blue Whale (tug)", None, True), ("MV Agusta", None, False), ("Barge Transport Services", None, False), ("x", " Tanker ", True), (None, None, False), (None, "vessel", True), ("Mt. Everest Trading", "company", False)]
    df = spark.createDataFrame(rows, "name string, type string, want boolean")
    assert df.where(keys.is_vessel(F.col("name"), F.col("type")) != F.col("want")).count() == 0 and df.where(keys.is_vessel(F.col("name"), F.col("type")).isNull()).count() == 0


def test_list_readers(spark, tmp_path):
    (tmp_path / "o.xml").write_text('<l><sdnEntry><uid>7</uid><lastName>SHIP</lastName><sdnType>Vessel</sdnType><programList><program>A</program><program>B</program></programList><akaList><aka><category>weak</category><lastName>S</lastName></aka></akaList><idList><id><idType>Vessel Registration Identification</idType><idNumber>IMO 9074729</idNumber></id></idList></sdnEntry></l>')
    r = lists.read_ofac(spark, str(tmp_path / "o.xml")).first()
    assert (r.id, r.name, r.weak, r.type, r.programme, r.imo) == ("7", "SHIP", ["S"], "vessel", "A+B", "9074729")
    (tmp_path / "u.xml").write_text("<l><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>A</FIRST_NAME><SECOND_NAME>B</SECOND_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>C</ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL><ENTITY><DATAID>2</DATAID><FIRST_NAME>D</FIRST_NAME></ENTITY></l>")
    assert {(r.id, r.name, tuple(r.alias), r.type) for r in lists.read_un(spark, str(tmp_path / "u.xml")).collect()} == {("1", "A B", ("C",), "person"), ("2", "D", (), "entity")}


def test_weights(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "")], "id long, name string")
    got = {r.word: (r.df, r.weight) for r in measure.document_frequency(df, "id", F.split("name", " ")).collect()}
    assert got["a"] == (2, pytest.approx(1 + math.log(4 / 3))) and set(got) == {"a", "b"}


def test_every_name_is_another_ones_neighbour(spark):
    for n, most in ((2000, 1000), (2000, 100), (2, 1000), (1, 1000), (0, 1000)):
        names = {f"name {k}" for k in range(n)}
        got = queries.neighbours(spark.createDataFrame([(x,) for x in names], "name string"), most).collect()
        assert all(r.a != r.name for r in got)
        assert {r.name for r in got} == {r.a for r in got} == (names if n > 1 else set()) and len(got) == len(names) * (n > 1)


def test_levels_from_two_tables(spark):
    schema = "tier string, threshold double, recall_n long, recall_low double, false_alert_high double"
    written = spark.createDataFrame([("m", t / 100, 100, 0.95 - t / 1000, 0.9 if t <= 80 else 0.04) for t in range(50, 101)], schema)
    real = spark.createDataFrame([("m", t / 100, 100, 0.5, 0.02 if t < 90 else 0.005) for t in range(50, 101)], schema)
    r = measure.choose_thresholds(written, real).first()
    assert (r.possible, r.strong, r.holds_recall) == (0.8, 0.9, False)
    never = measure.choose_thresholds(written, real.withColumn("false_alert_high", F.lit(0.5)), recall_min=0.8).first()
    assert (never.strong, never.holds_recall) == (1.0, True)
    with pytest.raises(ValueError):
        measure.choose_thresholds(written, real.where("threshold <> 0.7"))
    assert measure.strongest_bound(written).first()[0] == pytest.approx(0.9) and measure.analyst_hours(12)[0] == 1


def test_labelled_pairs_are_checked(spark):
    schema = "a string, b string, verdict string, nature string"
    good = [(f"a{k}", f"b{k}", "match" if k < 40 else "different", "n") for k in range(80)]
    assert measure.checked_pairs(spark.createDataFrame(good, schema)).count() == 80
    for bad in (good[1:], [*good[1:], ("b1", "a1", "match", "n")], [*good, ("x", " ", "match", "n")], [*good, ("x", "y", "match", None)]):
        with pytest.raises(ValueError):
            measure.checked_pairs(spark.createDataFrame(bad, schema))


def test_ships_of_the_screening_queries(spark):
    """The number rule, entries set aside and weak aliases are met by the registered query."""
    got = queries.screened(spark, "/root/testdata/sf0.001")
    ships = got.where("ref like 's%'").collect()
    assert ships and all((r.status == "strong" and r.candidates[0].by == "imo") if r.imo != "1234567" else r.set_aside for r in ships)
    weak = got.where("name like 'Weak Ship%'").collect()
    assert weak and all(r.status == "possible" and r.candidates[0].is_weak for r in weak)
