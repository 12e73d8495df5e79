"""A folder of plain and zipped days of several layouts gives the panel of the plain files."""

import zipfile

from pyspark.sql import functions as F

from candlewick import schemas
from candlewick.sources import daily_files, readers

HEAD = ["TradDt", "ISIN", "TckrSymb", "SctySrs", "FinInstrmNm", "OpnPric", "HghPric", "LwPric", "ClsPric", "LastPric", "PrvsClsgPric", "TtlTradgVol", "TtlTrfVal", "TtlNbOfTxsExctd", "FinInstrmTp"]


def day(date, n=3, **other):
    return [{"TradDt": date, "ISIN": f"I{i}", "TckrSymb": f"S{i}", "SctySrs": "EQ" if i else "GS", "FinInstrmNm": f'"Name, {i}"', "OpnPric": 10 + i, "HghPric": 20 + i, "LwPric": 5 + i, "ClsPric": 15 + i, "LastPric": 15.5, "PrvsClsgPric": "-", "TtlTradgVol": 100 * i, "TtlTrfVal": 1.5, "TtlNbOfTxsExctd": 3, "FinInstrmTp": "STK"} | other for i in range(n)]


def csv(rows, head=HEAD, end="\n"):
    return end.join([",".join(head), *(",".join(str(r.get(c, "")) for c in head) for r in rows)]) + end


def zipped(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(f"{name}.csv", text)


def rows_of(df):
    return sorted(map(tuple, df.select(*readers.PANEL.values(), "exchange").collect()), key=str)


def test_zips_layouts_and_error_pages(spark, tmp_path):
    plain, mixed = tmp_path / "plain", tmp_path / "mixed"
    plain.mkdir(), mixed.mkdir()
    days = {f"2026-10-0{i}": day(f"2026-10-0{i}") for i in (1, 5, 6, 7)}
    for name, rows in days.items():
        (plain / f"{name}.csv").write_text(csv(rows))
    one, five, six, seven = days.values()
    (mixed / "a.csv").write_text("﻿" + csv(one, HEAD[:5] + ["ClsPric", "LwPric", "Extra", "OpnPric", "HghPric"] + HEAD[9:], "\r\n"))  # another order, one column more
    zipped(mixed / "b.zip", inner=csv(five))
    zipped(mixed / "c.ZIP", first=csv(six, [*HEAD[::-1]]), second=csv(seven))
    (mixed / "d.csv").write_text("<html><body>not yet published</body></html>\n")
    (mixed / "e.zip").write_text("<html>also not</html>")
    (mixed / "f.csv").write_text("")
    zipped(mixed / "g.zip", page="<html></html>\n")
    want = rows_of(readers.panel(spark, str(plain), "NSE"))
    assert len(want) == 8 and want[0][4] == "Name, 1" and want[0][10] is None
    assert rows_of(readers.panel(spark, str(mixed), "NSE")) == want
    assert rows_of(readers.panel(spark, str(mixed / "c.ZIP"), "NSE")) == [r for r in want if str(r[0]) >= "2026-10-06"]


def test_exchanged_columns_of_a_later_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text(csv(day("2026-10-01", 2)))
    swapped = [c if c not in ("OpnPric", "ClsPric") else {"OpnPric": "ClsPric", "ClsPric": "OpnPric"}[c] for c in HEAD]
    (tmp_path / "2.csv").write_text(csv(day("2026-10-05", 2), swapped))
    assert {(r.open, r.close) for r in readers.panel(spark, str(tmp_path), "NSE").collect()} == {(11.0, 16.0)}


def test_daily_file_by_name(spark, tmp_path):
    names = [c.split()[0] for c in schemas.DAILY_FILE.split(", ")]
    rows = day("2026-10-01", 3) + [day("2026-10-01", 2, SctySrs="BE")[1] | {"TckrSymb": "S1"}]
    zipped(tmp_path / "x.zip", x=csv(rows, names))
    got = readers.daily_file(spark, str(tmp_path))
    schemas.assert_schema(got, schemas.DAILY_FILE)
    assert sorted((r.TckrSymb, r.SctySrs, r.ClsPric) for r in got.collect()) == [("S1", "BE", 16.0), ("S1", "EQ", 16.0), ("S2", "EQ", 17.0)]
    assert [(r.TckrSymb, r.SctySrs) for r in readers.preferred_rows(got).orderBy("TckrSymb").collect()] == [("S1", "EQ"), ("S2", "EQ")]


def test_many_lines_leave_in_slices(spark, tmp_path, monkeypatch):
    from candlewick.sources import daily_files

    rows = day("2026-10-01", 500)
    zipped(tmp_path / "x.zip", x=csv(rows))
    assert readers.panel(spark, str(tmp_path), "NSE").count() == 499
    import pyarrow as pa

    monkeypatch.setattr(daily_files, "SLICE", 1000)
    out = list(daily_files.unzipped(iter([pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([(tmp_path / "x.zip").read_bytes()])], ["path", "content"])])))
    assert len(out) > 10 and sum(b.num_rows for b in out) == 501


def test_a_line_is_parsed_once_and_as_before(spark):
    lines = ["a,b", "", "a,,c,", 'x,"one, two",y', '"open,b', 'a,"he said \\"no, no\\"",z', ' a , "b" ,c', '"a""b",c', 'a"b,c', ",".join(map(str, range(70))), ",".join(map(str, range(64))), ",", '""', "\\,a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    alone = F.from_csv("value", ", ".join(f"c{i} string" for i in range(daily_files.WIDTH)))
    got = df.select("i", daily_files.fields("value").alias("f"))
    want = {r.i: list(r.p) for r in df.select("i", alone.alias("p")).collect()}
    assert {r.i: r.f for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
