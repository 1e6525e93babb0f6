"""View models on a few rows."""

from pyspark.sql import functions as F

from tidemill.plans import views
from tidemill.schemas import collection


def test_customs_files_and_counts(spark):
    op = [None] * 18
    names = [f.name for f in collection("declarations")["operation"].dataType]
    stored = dict(zip(names, op, strict=True)) | {"ref": "IHR-1", "fileStatus": "tescil", "transportMode": "sea freight", "isArchived": False}
    rows = [("65f0a1b2c3d4e5f60718293a", "t", "ERROR", None, None, None, None), ("b", "t", "DRAFT", tuple(stored.values()), "x.xml", None, None), ("c", "t", "ODD", None, None, None, None)]
    files = views.customs_files(spark.createDataFrame(rows, collection("declarations")))
    got = {r.id[0]: r for r in files.collect()}
    assert (got["6"].ref, got["6"].status, got["6"].escalation, got["6"].declarationNo) == ("DCL-18293A", "evrak-bekleniyor", True, None)
    assert (got["b"].ref, got["b"].status, got["b"].transportMode, got["b"].declarationNo) == ("IHR-1", "tescil", "denizyolu", "IHR-1")
    assert got["c"].status == "yeni-talep"
    n = views.file_counts(files).first()
    assert (n.total, n.tescil, n.evrak_bekleniyor, n.eskalasyon) == (3, 1, 1, 1)


def test_readiness(spark):
    docs = spark.createDataFrame([("a", "SUCCESS"), ("a", "FAILED"), ("b", "SUCCESS"), ("a", None)], "declarationId string, extractionStatus string")
    got = {r.id: (r.meta, r.all_ready) for r in views.readiness(docs, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).collect()}
    assert got == {"a": ("2 eksik evrak", False), "b": ("Tüm evraklar geldi", True), "c": ("Evrak bekleniyor", False)}


def test_small_views(spark):
    one = spark.range(1)
    lists = one.select(views.archive_checklist(F.lit("ithalat"), F.array(F.lit("CMR"))).alias("a"), views.archive_checklist(F.lit("ihracat"), F.array(F.lit("Çeki Listesi"))).alias("b")).first()
    assert len(lists.a) == 7 and lists.a[4].available is False and len(lists.b) == 6 and lists.b[3].available is False
    t = one.select(views.timeline(F.lit("Sarı"), F.lit(False), F.lit("started")).alias("t"), views.ageing(F.lit(4), F.lit("started")).alias("a")).first()
    assert [x.state for x in t.t] == ["done", "done", "wait", "wait"] and tuple(t.a) == ("4 gündür", "warn")
    perms = spark.createDataFrame([({"x": (True, True), "y": (True, False), "z": (False, True)},)], "p map<string,struct<view:boolean,operate:boolean>>")
    r = perms.select(views.menu_access(F.col("p")).alias("k"), views.menu_actions(F.col("p"), {"x": ["view", "edit"]}).alias("a")).first()
    assert set(r.k) == {"x", "y"} and r.a == {"x": ["view", "edit"], "y": ["view"]}
    assert one.select(views.special_actions(F.array(F.lit("arsiv.view")))).first()[0] == ["downloadDocuments"]
    rows = spark.createDataFrame([("r1", "i1", 1), ("r2", "i2", 2)], "ref string, id string, n int")
    wanted = spark.createDataFrame([("r1",), ("i2",), ("zz",)], "key string")
    assert {(x.key, x.n) for x in views.first_by_key(rows, wanted, F.col("ref"), "id", "n").collect()} == {("r1", 1), ("i2", 2)}
    assert views.or_first(rows, "ref", "none", [F.col("n")]).first().n == 1 and views.or_first(rows, "ref", "r2", [F.col("n")]).first().n == 2
