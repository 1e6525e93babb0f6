"""View models: what screens and exports show of a declaration, its documents, queries and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import tr_format
from ..functions.text import tail_ref, transport_code
from ..operators.joins import labelled
from ..operators.stats import count_bundle

# Labels of codes, checklist names and capability rules.
FILE_STATUS = {"DRAFT": "beyanname-yazim", "READY": "ic-kontrol", "XML_GENERATED": "tescil", "ERROR": "evrak-bekleniyor"}
FORM_STATUS = {"DRAFT": "taslak", "READY": "kontrol", "XML_GENERATED": "tescilli", "ERROR": "bekliyor"}
LIST_STATUS = {"DRAFT": "yazim-bekliyor", "READY": "onaya-hazir", "XML_GENERATED": "onaya-hazir", "ERROR": "kontrol-uyarisi"}
STATUS_LABELS = {"DRAFT": "Yazım Bekliyor", "READY": "Onaya Hazır", "XML_GENERATED": "XML Üretildi", "ERROR": "Hata"}
DOCUMENT_LABELS = {"INVOICE": "Fatura", "E_INVOICE_XML": "e-Fatura XML", "EXPORT_INVOICE": "İhracat Faturası", "PACKING_LIST": "Çeki Listesi", "PROFORMA": "Proforma", "BILL_OF_LADING_INSTRUCTION": "Konşimento Talimatı", "OTHER": "Diğer"}
FILE_COUNTERS = {"yeni_talep": "yeni-talep", "gtip_hazirlik": "gtip-hazirlik", "evrak_bekleniyor": "evrak-bekleniyor", "beyanname": "beyanname-yazim", "ic_kontrol": "ic-kontrol", "tescil": "tescil", "kapanis_bekleyen": "kapanis-bekleyen"}
CHECKLIST = [("Beyanname", "PDF"), ("Beyanname Ekli Liste", "PDF"), ("Fatura", "PDF"), ("Çeki Listesi", "PDF"), ("Teslim Tesellüm", "PDF"), ("Mühürlü Evraklar", "JPG")]
TRANSPORT_PAPERS = ("CMR / Konşimento / AWB", "PDF")
SPECIAL_ACTIONS = {"sendToSystem": ["beyanname.send"], "viewCosts": ["kapanis.maliyet"], "downloadDocuments": ["arsiv.view", "kapanis.evraklar", "beyanname.view"], "sendMail": ["mailler.manage", "tescil.notify"]}


def customs_files(declarations: DataFrame) -> DataFrame:
    """One row a declaration: stored operation fields first, then what its status implies."""
    op = F.col("operation")
    ref = F.coalesce(op["ref"], tail_ref(F.col("id")))
    mode = F.when(F.coalesce(op["transportMode"], F.lit("")) != "", transport_code(op["transportMode"]))
    received = F.coalesce(op["receivedAt"], "createdAt")
    return declarations.select(
        "id", "companyId", ref.alias("ref"), F.coalesce(op["customerName"], F.lit("—")).alias("customer"), F.coalesce(op["fileStatus"], labelled(F.col("status"), FILE_STATUS, F.lit("yeni-talep"))).alias("status"),
        F.coalesce(op["operationType"], F.lit("ihracat")).alias("operationType"), F.coalesce(op["isArchived"], F.lit(False)).alias("isArchived"), mode.alias("transportMode"), op["line"].alias("line"),
        F.coalesce(op["declarationNo"], F.when(F.coalesce(F.col("generatedXmlPath"), F.lit("")) != "", ref)).alias("declarationNo"), received.alias("receivedAt"), op["closedAt"].alias("closedAt"),
        F.coalesce(op["escalation"], F.col("status") == "ERROR").alias("escalation"), F.coalesce(op["missingDocuments"], F.array().cast("array<string>")).alias("missingDocuments"), F.coalesce("updatedAt", received).alias("updatedAt"),
    )


def file_counts(files: DataFrame) -> DataFrame:
    """Files that are not archived: all, each status, and escalated ones, in one pass."""
    own = {"total": F.lit(True)} | {n: F.col("status") == s for n, s in FILE_COUNTERS.items()} | {"eskalasyon": F.col("escalation")}
    return count_bundle(files.where("not isArchived"), own)


def writing_fields(fields: Column) -> Column:
    """Structs (key, label, value) of a declaration's form from a map of path to text; packages and weight only where they are known."""
    at = lambda p: F.element_at(fields, p)
    dash = lambda c: F.coalesce(c, F.lit("—"))
    date = F.coalesce(F.date_format(F.try_to_timestamp(at("header.invoiceDate")), "dd.MM.yyyy"), F.lit("—"))
    amount = F.coalesce(F.concat_ws(" ", tr_format(at("header.totalAmount").try_cast("double")), at("header.currency")), F.lit("—"))
    row = lambda k, n, v: F.struct(F.lit(k).alias("key"), F.lit(n).alias("label"), v.alias("value"))
    base = F.array(
        row("gonderici", "Gönderici", dash(at("parties.seller.name"))), row("alici", "Alıcı", dash(at("parties.buyer.name"))), row("beyan", "Beyan", F.coalesce(at("evrimHeader.rejim"), F.lit("10 — İhracat"))),
        row("referans", "Referans", dash(at("header.invoiceNo"))), row("fatura", "Fatura", F.concat_ws(" / ", date, dash(at("header.invoiceNo")))), row("teslim", "Teslim Şekli", dash(at("trade.deliveryTerm"))), row("kiymet", "Kıymet", amount),
    )
    more = F.array(row("kap", "Kap Adedi", at("packageInfo.totalPackage")), row("kilo", "Brüt Kilo", F.concat(at("packageInfo.grossKg"), F.lit(" KG"))))
    return F.concat(base, F.filter(more, lambda r: r["value"].isNotNull()))


def registration_counts(rows: DataFrame) -> DataFrame:
    """waiting and started count the same rows; completed is always 0."""
    started = F.col("status") == "started"
    return count_bundle(rows, {"waiting": started, "started": started, "completed": F.lit(False), "yellow_red": F.col("line").isin("Sarı", "Kırmızı"), "blue_green": F.col("line").isin("Mavi", "Yeşil")})


def closing_counts(rows: DataFrame) -> DataFrame:
    s = F.col("status")
    return count_bundle(rows, {"waiting": s == "kontrol-bekliyor", "uploaded": s == "mutabakat-hazir", "reconciled": s == "kapandi", "warnings": s == "maliyet-bekliyor", "cost_pending": s == "maliyet-bekliyor"})


def document_status(extraction: Column) -> Column:
    return F.when(extraction == "SUCCESS", "Geldi").when(extraction == "FAILED", "Eksik").otherwise("Koşullu")


def readiness(documents: DataFrame, declarations: DataFrame) -> DataFrame:
    """id, meta and all_ready of every declaration from its documents' extraction statuses."""
    per = documents.groupBy(F.col("declarationId").alias("id")).agg(F.count("*").alias("n"), F.count_if(~F.col("extractionStatus").eqNullSafe("SUCCESS")).alias("lack"))
    out = declarations.select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lack", F.lit(0)).alias("lack"))
    meta = F.when(F.col("lack") > 0, F.concat(F.col("lack").cast("string"), F.lit(" eksik evrak"))).when(F.col("n") == 0, "Evrak bekleniyor").otherwise("Tüm evraklar geldi")
    return out.select("id", meta.alias("meta"), ((F.col("n") > 0) & (F.col("lack") == 0)).alias("all_ready"))


def query_results(items: DataFrame) -> DataFrame:
    """Parsed items as tariff-query results: material number or KALEM-n, description or the raw line, status by whether a code was found."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    code = F.coalesce(some("gtip"), F.lit("—"))
    return items.select(
        "doc_id", "line_no", F.coalesce(some("product_code"), F.concat(F.lit("KALEM-"), F.col("line_no").cast("string"))).alias("materialNo"), F.coalesce(some("description"), F.substring(some("raw_line"), 1, 120), F.lit("—")).alias("description"),
        code.alias("foundGtip"), F.when(code != "—", "Bulundu").otherwise("Operasyon Girişi Gerekli").alias("status"), F.when(code != "—", "Onay Bekliyor").otherwise("Giriş Bekliyor").alias("approvalStatus"), "needs_review",
    )


def archive_checklist(operation: Column, missing: Column) -> Column:
    """Structs (name, format, available): six papers, and those of transport in fifth place for import and transit."""
    lacks = lambda n: F.coalesce(F.array_contains(missing, n), F.lit(False))
    cell = lambda n, f, ok: F.struct(F.lit(n).alias("name"), F.lit(f).alias("format"), ok.alias("available"))
    base = [cell(n, f, ~lacks(n) if n == "Çeki Listesi" else F.lit(True)) for n, f in CHECKLIST]
    papers = cell(*TRANSPORT_PAPERS, ~lacks("CMR") & ~lacks("Konşimento"))
    return F.when(operation.isin("ithalat", "transit"), F.array(*base[:4], papers, *base[4:])).otherwise(F.array(*base))


def ageing(days: Column, status: Column) -> Column:
    """struct(text, level) of an open registration."""
    done = status == "completed"
    text = F.concat(days.cast("string"), F.when(done, " günde tamamlandı").otherwise(" gündür"))
    return F.struct(text.alias("text"), F.when(done | (days <= 2), "ok").when(days <= 5, "warn").otherwise("red").alias("level"))


def timeline(line: Column, second: Column, status: Column) -> Column:
    """Four fixed steps (title, state)."""
    step = lambda t, ok: F.struct(t.alias("title"), F.when(ok, "done").otherwise("wait").alias("state"))
    told = status == "completed"
    return F.array(
        step(F.lit("Beyanname tescil talebi oluşturuldu"), F.lit(True)), step(F.concat(F.lit("İlk bildirim alındı · "), line, F.lit(" Hat")), F.lit(True)),
        step(F.when(second, "İkinci bildirim alındı").otherwise("İkinci bildirim bekleniyor"), second), step(F.when(told, "Müşteri bilgilendirildi").otherwise("Müşteri bekleme durumunda"), told),
    )


def trace_entries(trace: Column, most: int = 8) -> Column:
    """The first entries of a lineage map as (label, value, source); the label is the last part of the path."""
    rows = F.transform(F.map_entries(trace), lambda e: F.struct(F.element_at(F.split(e["key"], r"\."), -1).alias("label"), e["value"]["value"].alias("value"), e["value"]["source"].alias("source")))
    return F.slice(rows, 1, most)


def menu_access(permissions: Column) -> Column:
    """Keys of a map of permissions (view, operate) that may be viewed."""
    return F.map_keys(F.map_filter(permissions, lambda _, v: v["view"]))


def menu_actions(permissions: Column, sets: dict[str, list[str]]) -> Column:
    """Allowed actions of each viewable key: its whole set to operate, else only view."""
    table = F.create_map(*(x for k, v in sets.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if sets else F.lit(None).cast("map<string,array<string>>")
    view = F.array(F.lit("view"))
    return F.transform_values(F.map_filter(permissions, lambda _, v: v["view"]), lambda k, v: F.when(v["operate"], F.coalesce(F.element_at(table, k), view)).otherwise(view))


def special_actions(capabilities: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(capabilities, F.array(*map(F.lit, c))), F.lit(a)) for a, c in SPECIAL_ACTIONS.items())))


def visible_menu(items: DataFrame, held: Column) -> DataFrame:
    """Menu rows (group, item, capabilities) of which one capability at least is held, or that ask for none. Rows stand alone; visible_navigation goes by groups."""
    from ..operators.filters import allowed

    return items.where(allowed(F.col("capabilities"), held))


def visible_navigation(nodes: DataFrame, held: list[str], mode: str, super_admin: bool) -> DataFrame:
    """node_id, depth (from 1) and root of the nodes of navigation trees, of any depth, that may be seen.

    nodes: node_id, parent_id (null for a group), capabilities (null or empty: a screen that asks for none), required_mode and
    super_admin_only, which count for groups. A group of another mode, or for super admins where the user is none, is gone with
    all below it. A screen (a node without children) is seen with one of its capabilities, or if it asks for none; in a super admin's
    group it is seen anyway. A node with children is seen if a screen below it is. A node whose parent is missing is not reached.
    A recursive query goes down the parent links with the path so far, in as many steps as the deepest tree has levels; the paths of the
    screens that are seen are what is seen.
    """
    spark = nodes.sparkSession
    may = F.lit(super_admin) | ~F.coalesce("super_admin_only", F.lit(False))
    fits = F.col("required_mode").isNull() | (F.col("required_mode") == mode)
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    seen = (F.coalesce(F.size("capabilities"), F.lit(0)) <= 0) | F.arrays_overlap("capabilities", F.array(*map(F.lit, held)).cast("array<string>"))
    rows = nodes.join(parents, "node_id", "left").select("node_id", "parent_id", F.coalesce("inner", F.lit(False)).alias("inner"), seen.alias("seen"), (may & fits).alias("open"), F.coalesce("super_admin_only", F.lit(False)).alias("admin"))
    down = spark.sql("""
        WITH RECURSIVE down (node_id, path, admin, leaf) AS (
          SELECT node_id, array(node_id), admin, false FROM {rows} WHERE parent_id IS NULL AND open
          UNION ALL
          SELECT r.node_id, array_append(d.path, r.node_id), d.admin, NOT r.inner AND (r.seen OR d.admin) FROM down d JOIN {rows} r ON r.parent_id = d.node_id
        )
        SELECT path FROM down WHERE leaf
    """, rows=rows)
    return down.select(F.posexplode("path").alias("depth", "node_id"), F.get("path", F.lit(0)).alias("root")).select("node_id", (F.col("depth") + 1).alias("depth"), "root").distinct()


def first_by_key(rows: DataFrame, wanted: DataFrame, ref: Column, ident: str, order: str) -> DataFrame:
    """For each wanted key the first row whose reference or id it is: two equality joins, not one on either."""
    r = rows.withColumn("_ref", ref)
    hits = wanted.join(r, wanted["key"] == r["_ref"]).unionByName(wanted.join(r, wanted["key"] == r[ident]))
    return hits.drop("_ref").groupBy("key").agg(F.min_by(F.struct(*(c for c in rows.columns)), order).alias("row")).select("key", "row.*")


def or_first(rows: DataFrame, ref: str, wanted: str, order: list[Column]) -> DataFrame:
    """The row of the wanted reference, or the first one without it."""
    return rows.orderBy(F.when(F.col(ref) == wanted, 0).otherwise(1), *order).limit(1)


def over_template(partial: Column, template: dict[str, object]) -> Column:
    """A struct of template defaults, with the partial struct's values where it has them."""
    return F.struct(*(F.coalesce(partial[k], F.lit(v)).alias(k) for k, v in template.items()))


def merged_maps(one: Column, two: Column) -> Column:
    """Both maps in one; of a key in both, the second map's value. A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    one, two = F.coalesce(one, none), F.coalesce(two, none)
    return F.map_concat(F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k)), two)


def with_line_numbers(lines: Column, fields: list[str]) -> Column:
    """Goods lines with lineNo, its place from 1 where it has none; null lines are an empty array."""
    lines = F.coalesce(lines, F.slice(F.array(F.get(lines, F.lit(0))), 1, 0))
    return F.transform(lines, lambda x, i: F.struct(F.coalesce(x["lineNo"].cast("long"), (i + 1).cast("long")).alias("lineNo"), *(x[f].alias(f) for f in fields)))


def trade_name(descriptions: Column) -> Column:
    """The first line's description, else those of all lines that have one, else a dash."""
    every = F.array_join(F.filter(descriptions, lambda d: d != ""), " / ")
    return F.coalesce(F.get(descriptions, F.lit(0)), F.nullif(every, F.lit("")), F.lit("—"))


def packed(packages: Column, gross: Column) -> Column:
    """Packages and gross weight of a declaration's goods; a dash for what is not known, and one alone if neither is."""
    kap = F.coalesce(F.concat(packages.cast("string"), F.lit(" KAP")), F.lit("—"))
    whole = F.regexp_replace(F.regexp_replace(tr_format(gross, 3), r"(,\d*?)0+$", "$1"), r",$", "")
    return F.when(packages.isNull() & gross.isNull(), "—").otherwise(F.concat_ws(" / ", kap, F.coalesce(F.concat(whole, F.lit(" KG")), F.lit("—"))))


def parsed(text: Column, schema: str) -> Column:
    """struct(value, failed) of JSON text: null and true for text that is no JSON of the schema, null and false for null."""
    value = F.from_json(text, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = text.isNotNull() & (value.isNull() | value["_bad"].isNotNull())
    return F.struct(F.when(~bad, value).alias("value"), F.coalesce(bad, F.lit(False)).alias("failed"))
