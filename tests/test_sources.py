"""Workbooks and formats of times."""

import io
import zipfile
from datetime import datetime

import pytest

from wattloom.sources.files import load_readings, time_format, write_table
from wattloom.sources.workbooks import read_workbook, sheet_rows


def test_a_written_workbook_reads_back(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5 * k), float(k) / 3, None if k == 2 else f"a <b> & ünï {k}", k % 2 == 0) for k in range(5)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, load double, note string, flag boolean").coalesce(1)
    path = str(tmp_path / "out.xlsx")
    write_table(df, "in.csv", path)
    got = [tuple(r) for r in read_workbook(spark, path).collect()]
    assert got[0] == ("timestamp", "load", "note", "flag") and len(got) == 6
    for (t, v, note, flag), r in zip(rows, got[1:], strict=True):
        assert r[0] == t.strftime("%Y-%m-%d %H:%M:%S") and float(r[1]) == v and r[2] == note and r[3] == str(flag).lower()


def test_a_panel_loads_from_a_workbook(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 5 * k), float(k), -999.0) for k in range(6)]
    path = str(tmp_path / "panel.xlsx")
    write_table(spark.createDataFrame(rows, "t timestamp_ntz, a double, b double").coalesce(1), "in.csv", path, header=False)
    readings, headerless = load_readings(spark, path)
    got = sorted((r.channel, r.pos, r.ts, r.value) for r in readings.collect())
    assert headerless and got == sorted([("Household_01", k, t, a) for k, (t, a, _) in enumerate(rows)] + [("Household_02", k, t, b) for k, (t, _, b) in enumerate(rows)])


def test_shared_strings_gaps_and_both_calendars():
    def book(date1904):
        main, links = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="x" sheetId="7" r:id="rId9"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/other.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="[Red]0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row><c s="1"><v>45292.5</v></c><c s="2"><v>3.5</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>x</f><v>made</v></c></row></sheetData></worksheet>')
        return list(sheet_rows(out.getvalue()))

    rows = book(False)
    assert rows[0] == [] and rows[1][1] == "plain" and rows[1][26] == "two runs" and len(rows[1]) == 27
    assert rows[2] == ["2024-01-01 12:00:00", "3.5", None, "made"]
    assert book(True)[2][0] == "2028-01-02 12:00:00"


@pytest.mark.parametrize("texts, want", [
    (["2024-01-05 10:00:00.020", "2024-01-05 10:05:00"], datetime(2024, 1, 5, 10, 0)),
    (["2024-01-05T10:00:00Z", "2024-01-05T12:05:00+02:00"], datetime(2024, 1, 5, 10, 0)),
    (["2024/1/5 9:30"], datetime(2024, 1, 5, 9, 30)),
    (["5/1/2024 10:00", "13/1/2024 10:05"], datetime(2024, 1, 5, 10, 0)),
    (["1/5/2024 10:00", "1/13/2024 10:05"], datetime(2024, 1, 5, 10, 0)),
    (["5.1.2024 10:00:07", "25.1.2024 10:05:00"], datetime(2024, 1, 5, 10, 0)),
    (["1/25/2024 1:15 PM"], datetime(2024, 1, 25, 13, 15)),
    (["05 Jan 2024 10:00"], datetime(2024, 1, 5, 10, 0)),
    (["20240105"], datetime(2024, 1, 5)),
    (["5/5/2024 10:00", "6/6/2024 11:00"], datetime(2024, 5, 5, 10, 0)),
])
def test_formats_of_times(spark, tmp_path, texts, want):
    path = tmp_path / "x.csv"
    path.write_text("time,a\n" + "".join(f'"{t}",{k}\n' for k, t in enumerate(texts)))
    got = sorted(r.ts for r in load_readings(spark, str(path))[0].collect())
    assert got[0] == want and len(got) == len(texts)


def test_day_or_month_first_is_never_guessed(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("time,a\n1/2/2024 10:00,1\n3/2/2024 10:00,2\n")
    with pytest.raises(ValueError, match="day first or month first"):
        load_readings(spark, str(path))
    for day_first, want in ((True, datetime(2024, 2, 1, 10)), (False, datetime(2024, 1, 2, 10))):
        assert min(r.ts for r in load_readings(spark, str(path), day_first=day_first)[0].collect()) == want
    assert time_format(spark.createDataFrame([("1/2/2024 10:00",), ("14/2/2024 10:00",)], "_t string")) == "d/M/yyyy H:mm"
