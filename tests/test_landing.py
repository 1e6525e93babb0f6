"""Workbooks as a data source, uploads in two phases, and the ledger of extraction runs."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.sources import collections, landing, pdf, workbooks, xlsx
from tidemill.streaming import events


def test_workbook_round_trip(spark, tmp_path):
    workbooks.register(spark)
    rows = [(i, f"name <{i}> & ü", None if i % 3 else i * 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, name string, v double").repartition(4)
    folder = str(tmp_path / "out")
    df.write.format("workbook").mode("append").save(folder)
    assert not [f for f in os.listdir(folder) if not f.endswith(".xlsx")]
    back = spark.read.format("workbook").load(folder)
    got = sorted(tuple(r.cells) for r in back.where("row > 1").collect())
    assert got == sorted((str(i), n, "" if v is None else str(v)) for i, n, v in rows)
    assert {tuple(r.cells) for r in back.where("row = 1").collect()} == {("id", "name", "v")}
    df.limit(1).write.format("workbook").mode("overwrite").save(folder)
    assert spark.read.format("workbook").load(folder).where("row > 1").count() == 1
    (tmp_path / "out" / "bad.xlsx").write_bytes(b"no workbook")
    assert spark.read.format("workbook").load(folder).where("error is not null").count() == 1


def test_a_failed_write_leaves_no_workbook(spark, tmp_path):
    workbooks.register(spark)
    folder = str(tmp_path / "out")
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("workbook").mode("append").save(folder)
    assert not os.path.isdir(folder) or not os.listdir(folder)


def test_material_rows_of_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.template_bytes())
    workbooks.register(spark)
    cells = spark.read.format("workbook").load(str(tmp_path))
    assert sorted((r.materialNo, r.gtipNo) for r in xlsx.material_rows(cells).collect()) == [("MLZ-001", "847130000000"), ("MLZ-002", "848210900000")]


UPLOADS = "companyId string, declarationId string, type string, fileName string, content binary"


def test_uploads_land_whole(spark, tmp_path):
    folder = str(tmp_path / "up")
    rows = [("c1", "d1", "INVOICE", "a.pdf", bytearray(b"%PDF one")), ("c1", "d1", "INVOICE", "../../a.pdf", bytearray(b"two")), ("c1", "d2", None, None, bytearray(b"three")), ("c1", "d2", "X", "big.pdf", bytearray(3 << 20)), ("c1", None, "X", "b.pdf", bytearray(b"x")), ("c1", "d3", "X", "e.pdf", None)]
    got = landing.land(spark.createDataFrame(rows, UPLOADS), folder, most_mb=2).collect()
    by = {(r.fileName, r.declarationId, r.length): r for r in got}
    assert len(got) == 6 and sorted(r.extractionStatus for r in got) == ["FAILED"] * 3 + ["PENDING"] * 3
    for name, declaration, content in (("a.pdf", "d1", b"%PDF one"), ("a.pdf", "d1", b"two"), ("file", "d2", b"three")):
        path = by[name, declaration, len(content)].filePath
        assert open(path, "rb").read() == content and os.path.realpath(path).startswith(os.path.realpath(folder))
    assert by["big.pdf", "d2", 3 << 20].parseErrors == ["too large"] and by["e.pdf", "d3", 0].parseErrors == ["empty file"]
    assert landing.sweep(spark, folder) == 0 and landing.stored_uploads(spark, folder).count() == 6


def test_bytes_are_read_and_swept_by_tasks(spark, tmp_path, monkeypatch):
    """No folder of all uploads is listed on the driver: contents go by the paths of the metadata, sweeping lists level by level."""
    folder = str(tmp_path / "up")
    rows = [(f"c{i % 2}", f"d{i % 9}", "X", f"{i}.pdf", bytearray(b"%d" % i) * (i % 5)) for i in range(60)]
    meta = landing.land(spark.createDataFrame(rows, UPLOADS).repartition(3), folder)
    monkeypatch.setattr(landing, "READ_BYTES", 16)
    monkeypatch.setattr(landing, "PATHS", 4)
    read = landing.contents(meta)
    assert "binaryFile" not in read._jdf.queryExecution().toString()
    assert sorted((r.fileName, r.content) for r in read.collect()) == sorted((f"{i}.pdf", b"%d" % i * (i % 5) or None) for i in range(60))
    there = landing.stored_bytes(spark, folder)
    assert "binaryFile" not in there._jdf.queryExecution().toString()
    assert sorted(r[0] for r in there.collect()) == sorted(r.filePath for r in meta.where("filePath is not null").collect())
    gone = meta.where("fileName = '7.pdf'").first().filePath
    os.rename(gone, gone + "x")
    assert [r.content for r in landing.contents(meta).where("fileName = '7.pdf'").collect()] == [None]
    # the folder written in another way is the same folder
    assert landing.sweep(spark, f"{tmp_path}//up/") == 1 and not os.path.exists(gone + "x")
    assert landing.stored_bytes(spark, folder).count() == 47 and landing.stored_bytes(spark, str(tmp_path / "none")).count() == 0


def test_a_failing_task_leaves_no_half_row(spark, tmp_path):
    folder = str(tmp_path / "up")
    landing.land(spark.createDataFrame([("c", "d", "X", "first.pdf", bytearray(b"first"))], UPLOADS), folder)

    def fail(n):
        if n == 3:
            raise OSError("disk gone")

    more = spark.createDataFrame([("c", "d", "X", f"{i}.pdf", bytearray(b"more")) for i in range(8)], UPLOADS).coalesce(1)
    with pytest.raises(Exception, match="disk gone"):
        landing.land(more, folder, before_write=fail)
    rows = landing.stored_uploads(spark, folder)
    assert [r.fileName for r in rows.collect()] == ["first.pdf"]
    assert landing.sweep(spark, folder) == 2 and landing.sweep(spark, folder) == 0
    assert os.path.exists(rows.first().filePath)


def test_ledger_takes_what_has_no_success(spark, tmp_path):
    ledger = landing.Ledger(spark, str(tmp_path / "ledger"))
    ok = lambda limit: lambda d: (F.when(F.col("n") < limit, F.to_json(F.struct("n"))), F.when(F.col("n") == 7, F.lit("bad page")))
    docs = spark.createDataFrame([(i, i) for i in range(6)] + [(3, 3), (None, 1)], "doc_id int, n int")
    first = ledger.run(docs, ok(4)).collect()
    assert sorted((r.doc_id, r.extractionStatus, r.attempt) for r in first) == [("0", "SUCCESS", 1), ("1", "SUCCESS", 1), ("2", "SUCCESS", 1), ("3", "SUCCESS", 1), ("4", "FAILED", 1), ("5", "FAILED", 1)]
    more = docs.union(spark.createDataFrame([(7, 7), (8, 2)], "doc_id int, n int"))
    second = ledger.run(more, ok(5)).collect()
    assert sorted((r.doc_id, r.extractionStatus, r.attempt, *r.parseErrors) for r in second) == [("4", "SUCCESS", 2), ("5", "FAILED", 2, "Çıkarma hatası"), ("7", "FAILED", 1, "bad page"), ("8", "SUCCESS", 1)]
    assert ledger.run(more, ok(5), most=2).count() == 1
    assert {r.doc_id: (r.extractionStatus, r.attempt) for r in ledger.latest().collect()} == {"0": ("SUCCESS", 1), "1": ("SUCCESS", 1), "2": ("SUCCESS", 1), "3": ("SUCCESS", 1), "4": ("SUCCESS", 2), "5": ("FAILED", 2), "7": ("FAILED", 2), "8": ("SUCCESS", 1)}
    assert ledger.run(docs.limit(0), ok(9)).count() == 0


def test_json_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", [1, 2]), (2, None, None)], "id int, t string, l array<int>")
    collections.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, collections.read_json(spark, str(tmp_path / "j"), df.schema, whole_file=False).collect())) == [(1, "a\nb", [1, 2]), (2, None, None)]
    (tmp_path / "one.json").write_text('[{"id": 5,\n "t": "x"}]')
    assert [(r.id, r.t) for r in collections.read_json(spark, str(tmp_path / "one.json"), "id int, t string").collect()] == [(5, "x")]
