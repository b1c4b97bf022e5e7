import io
import zipfile
from datetime import date

import pytest

from sievewright.sources import freshness, lists

OFAC = """<?xml version="1.0"?><sdnList xmlns="https://example.invalid/x"><publshInformation><Record_Count>3</Record_Count></publshInformation>
<sdnEntry><uid>1</uid><firstName>Ana</firstName><lastName>LUPESCU</lastName><sdnType>Individual</sdnType><programList><program>P1</program><program>P2</program></programList>
<akaList><aka><category>strong</category><firstName>Anna</firstName><lastName>LUPESKU</lastName></aka><aka><category>weak</category><lastName>LUPA</lastName></aka></akaList></sdnEntry>
<sdnEntry><uid>2</uid><lastName>BRIG SOLA &amp; CO</lastName><sdnType>Vessel</sdnType><remarks>(Linked To: HOUSE (OF) SOLA; other; Linked To: SOLA B)</remarks>
<idList><id><idType>MMSI</idType><idNumber>IMO 1111111</idNumber></id><id><idType>Vessel Registration Identification</idType><idNumber>IMO 9074729</idNumber></id>
<id><idType>Vessel Registration Identification</idType><idNumber>IMO 9187629</idNumber></id></idList><vesselInfo><vesselOwner>Sola  Shipping</vesselOwner></vesselInfo></sdnEntry>
<sdnEntry><uid>3</uid><lastName> </lastName><sdnType>Entity</sdnType></sdnEntry></sdnList>"""
UN = """<LIST><INDIVIDUALS><INDIVIDUAL><DATAID>7</DATAID><FIRST_NAME>Oma</FIRST_NAME><THIRD_NAME>Teel</THIRD_NAME><UN_LIST_TYPE>DRC</UN_LIST_TYPE><LISTED_ON>2012-12-31</LISTED_ON>
<INDIVIDUAL_ALIAS><QUALITY/><ALIAS_NAME/></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME>Teel Oma</ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><DATAID>8</DATAID><FIRST_NAME>Teel Works</FIRST_NAME></ENTITY><ENTITY><FIRST_NAME>No Id</FIRST_NAME></ENTITY></ENTITIES></LIST>"""
EU = """<export xmlns="http://example.invalid/fsd"><sanctionEntity logicalId="13"><regulation entryIntoForceDate="2011-03-03" numberTitle="270/2011" programme="EGY"/><regulation numberTitle="271/2011"/>
<subjectType code="person"/><nameAlias wholeName="Ola Brun"/><nameAlias wholeName=""/><nameAlias wholeName="Ola &amp; Brun"/></sanctionEntity>
<sanctionEntity logicalId="14"><subjectType code="enterprise"/><nameAlias wholeName="Brun AS"/></sanctionEntity><sanctionEntity logicalId="15"><subjectType code="person"/></sanctionEntity></export>"""
UK = """<Designations><Designation><DateDesignated>29/06/2012</DateDesignated><UniqueID>A1</UniqueID><Names>
<Name><Name1>Ivo</Name1><Name6>TRAN</Name6><NameType>Primary name variation</NameType></Name><Name><Name1>Ivo</Name1><Name2>B</Name2><Name6>TRAN</Name6><NameType>Primary Name</NameType></Name>
<Name><Name6>IT</Name6><NameType>Alias</NameType><AliasStrength>Low quality a.k.a</AliasStrength></Name></Names>
<NonLatinNames><NonLatinName><NameNonLatinScript>Иво</NameNonLatinScript></NonLatinName></NonLatinNames><RegimeName>R</RegimeName><IndividualEntityShip>Individual</IndividualEntityShip></Designation>
<Designation><UniqueID>A2</UniqueID><Names><Name><Name6>TRAN STAR</Name6><NameType>Primary Name</NameType></Name></Names><IndividualEntityShip>Ship</IndividualEntityShip><ShipDetails><Ship>
<IMONumbers><IMONumber>IMO9074729</IMONumber><IMONumber>9187629</IMONumber><IMONumber>none</IMONumber></IMONumbers><CurrentOwnerOperators><CurrentOwnerOperator>Tran Lines </CurrentOwnerOperator></CurrentOwnerOperators>
</Ship></ShipDetails></Designation></Designations>"""
CA = """<data-set><record><Country-Pays>Moon / Lune</Country-Pays><LastName-NomDeFamille>VASS</LastName-NomDeFamille><GivenName-Prenom>Eli </GivenName-Prenom><Aliases-Alias>Eli V, Russian: Илай; VASS</Aliases-Alias>
<Schedule-Annexe>1</Schedule-Annexe><Item-NumeroDarticle>9</Item-NumeroDarticle><DateOfListing-DateDinscription>2024-04-12</DateOfListing-DateDinscription><ShipIMONumber-NumeroOMIDuNavire>9074729</ShipIMONumber-NumeroOMIDuNavire></record>
<record><Country-Pays>Moon / Lune</Country-Pays><EntityOrShip-EntiteOuNavire>Vass Boat</EntityOrShip-EntiteOuNavire><Schedule-Annexe>1</Schedule-Annexe><Item-NumeroDarticle>9</Item-NumeroDarticle><ShipIMONumber-NumeroOMIDuNavire>9074729</ShipIMONumber-NumeroOMIDuNavire></record>
<record><Country-Pays>Moon / Lune</Country-Pays><EntityOrShip-EntiteOuNavire>Vass OJSC</EntityOrShip-EntiteOuNavire><ShipIMONumber-NumeroOMIDuNavire>shifted</ShipIMONumber-NumeroOMIDuNavire></record><record><Country-Pays>x</Country-Pays></record></data-set>"""
VESSELS = """<html><body><p>ANNEX XLI</p><table><tr><td>1.</td><td>NOT THIS</td><td>1234567</td></tr></table><p>ANNEX XLII</p><table><tr><td>No</td><td>Name</td><td>IMO</td></tr>
<tr><td><p>1.</p></td><td>SEA &amp; SUN</td><td>9074729</td><td>a</td><td>1.2.2025</td></tr><tr><td>2</td><td>MOON</td><td>9187629</td></tr><tr><td>3.</td><td>OLD SEA</td><td>9074729</td></tr></table><p>ANNEX XLIII</p><table><tr><td>1.</td><td>NOR THIS</td><td>7654321</td></tr></table></body></html>"""
CSL = """_id,source,type,programs,name,start_date,vessel_owner,alt_names
a1,Specially Designated Nationals (SDN) - Treasury Department,Entity,X,Left Out,,,
a2,Entity List (EL) - Bureau of Industry and Security,,,"Holdrin, V","2020-01-02",,"Holdryn; ;V Holdrin"
a3,Some List (SL) - State,Vessel,P;Q, Ship Three ,,Owner Co,
"""


def workbook(sheets, shared=()):
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values()):
            cells = lambda r, row: "".join(c.replace("@", f"{chr(65 + j)}{r}") for j, c in enumerate(row) if c)
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r + 1}">{cells(r + 1, row)}</row>' for r, row in enumerate(rows)) + "</sheetData></worksheet>")
    return out.getvalue()


def text(*values):
    return [f'<c r="@" t="inlineStr"><is><t>{v}</t></is></c>' if v else "" for v in values]


def by_id(df):
    assert df.columns == ["source", "id", "name", "alias", "weak", "type", "programme", "imo", "other_imo", "designated_on", "designation_field", "parties", "regulations"]
    return {r.id: r for r in df.collect()}


@pytest.fixture
def file(tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return put


def test_ofac(spark, file):
    path = file("o.xml", OFAC)
    got = by_id(lists.read_list(spark, path, "ofac-sdn-xml", "OFAC-CONS"))
    assert set(got) == {"1", "2"} and got["1"].source == "OFAC-CONS"
    assert (got["1"].name, got["1"].alias, got["1"].weak, got["1"].type, got["1"].programme, got["1"].imo) == ("Ana LUPESCU", ["Anna LUPESKU", "LUPA"], ["LUPA"], "person", "P1+P2", None)
    assert (got["2"].imo, got["2"].other_imo, got["2"].type) == ("9074729", [], "vessel")
    assert [tuple(p) for p in got["2"].parties] == [("vesselOwner", "Sola Shipping"), ("Linked To", "HOUSE (OF) SOLA"), ("Linked To", "SOLA B")]
    assert lists.announced(spark, path, 3) is None and "3" in lists.announced(spark, path, 2) and lists.announced(spark, file("u.xml", UN), 2)


def test_un(spark, file):
    got = by_id(lists.read_list(spark, file("u.xml", UN), "un-consolidated-xml"))
    assert set(got) == {"7", "8"} and (got["7"].name, got["7"].alias, got["7"].designated_on, got["7"].designation_field) == ("Oma Teel", ["Teel Oma"], "2012-12-31", "LISTED_ON")
    assert (got["8"].type, got["8"].designated_on, got["8"].designation_field) == ("entity", None, None)


def test_eu(spark, file):
    got = by_id(lists.read_list(spark, file("e.xml", EU), "eu-fsf-xml"))
    assert set(got) == {"13", "14"} and (got["13"].name, got["13"].alias, got["13"].type, got["13"].programme) == ("Ola Brun", ["Ola & Brun"], "person", "EGY")
    assert (got["13"].designated_on, got["13"].designation_field, got["13"].regulations) == ("2011-03-03", "regulation entryIntoForceDate (270/2011)", ["270/2011", "271/2011"])
    assert got["14"].type == "entity" and got["14"].regulations == []


def test_uk(spark, file):
    got = by_id(lists.read_list(spark, file("k.xml", UK), "uk-sanctions-xml"))
    assert (got["A1"].name, sorted(got["A1"].alias), got["A1"].weak, got["A1"].designated_on) == ("Ivo B TRAN", ["IT", "Ivo TRAN", "Иво"], ["IT"], "29/06/2012")
    assert (got["A2"].imo, got["A2"].other_imo, got["A2"].type, [tuple(p) for p in got["A2"].parties]) == ("9074729", ["9187629"], "vessel", [("CurrentOwnerOperator", "Tran Lines")])


def test_eu_vessels(spark, file):
    got = by_id(lists.read_list(spark, file("v.xhtml", VESSELS), "eu-833-annex-xlii-xhtml"))
    assert set(got) == {"IMO9074729", "IMO9187629"}
    one = got["IMO9074729"]
    assert (one.name, one.alias, one.designated_on, one.designation_field, one.imo) == ("SEA & SUN", ["OLD SEA"], "1.2.2025", "Date of application", "9074729")


def test_canada(spark, file):
    got = by_id(lists.read_list(spark, file("c.xml", CA), "gac-sema-xml"))
    assert {k: (r.name, r.type, r.imo) for k, r in got.items()} == {"Moon|1|9": ("Eli VASS", "person", None), "Moon|1|9#2": ("Vass Boat", "vessel", "9074729"), "Moon||": ("Vass OJSC", "entity", None)}
    assert got["Moon|1|9"].alias == ["Eli V", "Илай", "VASS"]


def test_csl(spark, file):
    got = by_id(lists.read_list(spark, file("l.csv", CSL), "trade-csl-csv"))
    assert set(got) == {"a2", "a3"} and (got["a2"].name, got["a2"].alias, got["a2"].type, got["a2"].programme, got["a2"].designated_on) == ("Holdrin, V", ["Holdryn", "V Holdrin"], "other", "Entity List (EL)", "2020-01-02")
    assert (got["a3"].name, got["a3"].type, got["a3"].programme, [tuple(p) for p in got["a3"].parties]) == ("Ship Three", "vessel", "Some List (SL): P;Q", [("vessel_owner", "Owner Co")])
    with pytest.raises(ValueError, match="alt_names"):
        lists.read_csl(spark, file("m.csv", CSL.replace("alt_names", "other")))


def test_workbooks(spark, file):
    head = ["Reference", "Name of Individual or Entity", "Type", "Name Type", "Alias Strength", "Listing Information", "IMO Number", "Committees"]
    au = workbook({"Sheet of a day": [text("a legend"), text(*head), ['<c r="@" t="s"><v>0</v></c>', *text("Ann Oll", "Individual", "Primary Name", "", "Listed by the UN on 6 Oct. 2001", "", "1267")],
                                      text("82a", "Annie Oll", "Individual", "Alias", "Weak"), text("82b", "Oll Ann", "Individual", "Alias", "Strong"), text("83", "Oll Ship", "Vessel", "Primary Name", "", "", "IMO 9074729"), text("", "no number")]}, shared=["82"])
    got = by_id(lists.read_list(spark, file("a.xlsx", au), "dfat-consolidated-xlsx"))
    assert (got["82"].name, got["82"].alias, got["82"].weak, got["82"].type, got["82"].designated_on, got["82"].programme) == ("Ann Oll", ["Annie Oll", "Oll Ann"], ["Annie Oll"], "person", "6 Oct. 2001", "1267")
    assert (got["83"].imo, got["83"].type, got["83"].designation_field) == ("9074729", "vessel", None) and set(got) == {"82", "83"}
    day = '<c r="@" s="1"><v>44621.5</v></c>'
    nz = workbook({"Russia Sanctions Register": [text("legend"), text("Type", "Unique Identifier", "First name", "Middle name(s)", "Last name", "Sanction Status", "Date of Sanction", "Alias/Alternate Spellings"),
                                                 [*text("Individual", "N1", "Jon", "", "Doll", "Sanctioned"), day, *text("J Doll; Jon Doll;Dol")], text("Bank", "N2", "Doll Bank", "", "", "sanctioned"), text("Entity", "N3", "Gone", "", "", "Revoked"), text("Total", "3")],
                   "Ships": [text("Type", "Unique Identifier", "IMO Number", "Name of Ship as of Date of Sanction", "Date of Sanction", "Record Deleted Flag"), text("Ship", "S1", "9074729", "Doll Star"), text("Ship", "S2", "9187629", "Dead Star", "", "Yes")]})
    path = file("n.xlsx", nz)
    got = by_id(lists.read_list(spark, path, "mfat-russia-register-xlsx"))
    assert set(got) == {"N1", "N2", "S1"} and (got["N1"].name, got["N1"].alias, got["N1"].designated_on, got["N2"].type, got["S1"].imo) == ("Jon Doll", ["J Doll", "Dol"], "2022-03-01", "entity", "9074729")
    with pytest.raises(ValueError, match="no sheet"):
        list(lists.sheet_rows(nz, "Other"))
    with pytest.raises(ValueError, match="not a workbook"):
        list(lists.sheet_rows(b"junk", 0))
    assert lists.is_date(170, {170: "yyyy\\-mm"}) and not lists.is_date(171, {171: '0.00 "d"'})


def test_a_list_without_entries_is_an_error(spark, file):
    with pytest.raises(ValueError, match="no entry"):
        lists.read_list(spark, file("u.xml", UN), "eu-fsf-xml")
    with pytest.raises(ValueError, match="no known format"):
        lists.read_list(spark, file("u.xml", UN), "pdf")


def test_supplement_entries_that_the_feed_lacks(spark, file):
    feed = lists.read_eu(spark, file("e.xml", EU))
    rows = [("EU", "s1", "BRUN, Ola"), ("EU", "s2", "Brun AS"), ("EU", "s3", "Nora Vik")]
    supplement = spark.createDataFrame(rows, "source string, id string, name string")
    left = lambda act: sorted(r.id for r in lists.not_in_feed(supplement, feed, act).collect())
    assert left("271/2011") == ["s2", "s3"] and left("271/201") == ["s1", "s2", "s3"]


def test_freshness(spark, file):
    text = '<export generationDate="2026-10-12T07:00:00">\n<a publicationDate="2026-07-23"/><a publicationDate="2026-07-01"/>\n</export>'
    made = freshness.file_dates(spark, file("f.xml", text))
    assert made == freshness.Recorded("2026-10-12", "2026-07-23")
    for bad in (text.replace("2026-10-12", "2026-02-30"), text.replace("2026-07-01", "2026-10-14"), text.replace("2026-07-01", "soon"), text.replace("generationDate", "other")):
        assert freshness.file_dates(spark, file("g.xml", bad)).fault
    feed = "<rss><channel><item><link>x/full_1_1/c</link><pubDate>Mon, 12 Oct 2026 11:00:23 GMT</pubDate></item><item><link>x/other</link><pubDate>Tue, 13 Oct 2026 11:00:23 GMT</pubDate></item></channel></rss>"
    assert freshness.announced(feed, "full_1_1") == ("2026-10-12", None) and freshness.announced(feed, "none")[1] and freshness.announced("<rss", "x")[1] and freshness.announced(feed.replace("12 Oct", "32 Oct"), "full_1_1")[1]
    today = date(2026, 10, 14)
    got = freshness.recorded(made, feed, "full_1_1", today)
    assert got.confirmed == "2026-10-14" and freshness.stale(got, date(2026, 10, 21)) is None and freshness.stale(got, date(2026, 10, 22))
    unread = freshness.recorded(made, "<rss", "full_1_1", date(2026, 10, 20), got)
    assert unread.confirmed == "2026-10-14" and unread.unreadable and freshness.stale(unread, date(2026, 10, 21)) is None
    newer = freshness.recorded(made, feed.replace("12 Oct", "14 Oct"), "full_1_1", today)
    assert newer.confirmed is None and "2026-10-14" in freshness.stale(newer, today)
    assert freshness.stale(made, date(2026, 10, 10)) and freshness.stale(freshness.Recorded(None), today) and freshness.stale(freshness.Recorded("2026-10-12", confirmed="2026-13-01"), today)
