"""An inbox made from orders, and the queries on whole messages.

Every order with lines is a message. Which of the 16 changes its BL has, which
formats its files are in, how many drafts or shipments it comes with and what
it asks for all follow from o_orderkey, so SQL can state every result without
the rules.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.fields import FIELDS
from quaystone.operators import extraction, messages, routing
from quaystone.plans import shipments
from quaystone.session import stored, table
from quaystone.sources import readers

_LABELS = dict(zip(FIELDS, ("Shipper", "Consignee", "Notify Party", "Port of Loading", "POD", "No. of Containers", "Gross Weight"), strict=True))


def _lines(title: Column, doc: Column) -> Column:
    """A document as text."""
    return F.concat(title, F.lit("\n"), *[F.concat(F.lit(f"\n{label}: "), doc[f], F.lit("\n")) for f, label in _LABELS.items()])


def _interchange(doc: Column, cnt: Column, kg: Column) -> Column:
    """An SI as X12 304, without padding in its header."""
    port = lambda kind, x: F.concat(F.lit(f"R4*{kind}*UN*"), F.regexp_extract(x, r"\((\w+)\)", 1), F.lit("*"), F.trim(F.substring_index(x, "(", 1)), F.lit("~\n"))
    party = lambda code, x: F.concat(F.lit(f"N1*{code}*"), F.substring_index(x, "\n", 1), F.lit("~\n"))
    weight = F.when(doc["gross_weight_kg"] == "TBA", "").otherwise(F.concat(F.lit("L0*1***"), kg.cast("string"), F.lit("*G******K~\n")))
    return F.concat(
        F.lit("# made from an order\nISA*00*x~\nST*304*1~\n"), party("SF", doc["shipper"]), party("CN", doc["consignee"]), party("NP", doc["notify_party"]),
        port("L", doc["port_of_loading"]), port("D", doc["port_of_discharge"]), F.repeat(F.lit("N7**BOX~\n"), cnt.cast("int")), weight, F.lit("SE*1*1~\n"),
    )


@F.pandas_udf(T.BinaryType())
def _office(formats: pd.Series, texts: pd.Series) -> pd.Series:
    """A text document as docx or xlsx: the title, then a row a pair."""

    def made(kind: str | None, text: str | None) -> bytes | None:
        if kind not in ("docx", "xlsx") or text is None:
            return None
        title, *blocks = text.rstrip("\n").split("\n\n")
        rows = [b.strip("\n").partition(": ") for b in blocks]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if kind == "docx":
                paragraph = lambda x: f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
                cells = [f"<w:tr><w:tc>{paragraph(a)}</w:tc><w:tc>{''.join(map(paragraph, b.split(chr(10))))}</w:tc></w:tr>" for a, _, b in rows]
                z.writestr("word/document.xml", f"<w:document>{paragraph(title)}<w:tbl>{''.join(cells)}</w:tbl></w:document>")
            else:
                cell = lambda x: f'<c t="inlineStr"><is><t>{escape(x)}</t></is></c>'
                lines = [[title], *([a, *b.split("\n")] for a, _, b in rows)]
                z.writestr("xl/worksheets/sheet1.xml", "<worksheet>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in lines) + "</worksheet>")
        return out.getvalue()

    return pd.Series([made(k, t) for k, t in zip(formats, texts, strict=True)], dtype=object)


_CALLS = ("please cancel invoice 123456", "the invoice is open", "a holiday is near")


def inbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, files). o_orderkey % 5 = 0: no files, an ask by o_orderkey % 3.
    Else an SI (X12 if % 4 = 1) and a BL (text, docx, xlsx by % 3) with change
    % 16; % 32 = 15: no BL; % 7 = 3: an older draft before it, with change
    (c + 5) % 13; else % 11 = 4: a second shipment with one box more."""
    booked = shipments.bookings(spark, sf_dir)
    k = F.col("o_orderkey")
    change = (k % 16).cast("int")
    drafts = (k % 7 == 3) & (k % 5 != 0) & (k % 32 != 15)
    second = (k % 11 == 4) & (k % 7 != 3) & (k % 5 != 0) & (k % 32 != 15)
    si = F.struct(*[(F.when(change == 13, "TBA").otherwise(F.col("si")[f]) if f == "gross_weight_kg" else F.col("si")[f]).alias(f) for f in FIELDS])
    made = booked.withColumns({"_si": si, "_bl": shipments.drafted(booked, change), "_old": shipments.drafted(booked, (change + 5) % 13), "_more": shipments.drafted(booked, F.lit(10))})
    si_kind, bl_kind = F.when(k % 4 == 1, "edi").otherwise("txt"), F.get(F.array(F.lit("txt"), F.lit("docx"), F.lit("xlsx")), (k % 3).cast("int"))
    title = F.when(change == 14, "PACKING LIST").otherwise("BILL OF LADING (DRAFT)")
    si_title = F.lit("SHIPPING INSTRUCTION")
    si_text = F.when(si_kind == "edi", _interchange(F.col("_si"), F.col("cnt"), F.col("kg"))).otherwise(_lines(si_title, F.col("_si")))
    asks = k % 5 == 0
    number = F.when(second, "_1.").otherwise(".")
    slots = (
        (~asks, "_SI", F.concat(number, si_kind), si_text, F.lit(False)),
        (drafts, "_BL.", F.lit("txt"), _lines(F.lit("BILL OF LADING"), F.col("_old")), F.lit(False)),
        (~asks & (k % 32 != 15), "_BL", F.concat(F.when(drafts, "_V2.").otherwise(number), bl_kind), _lines(title, F.col("_bl")), change == 15),
        (second, "_SI_2.", F.lit("txt"), _lines(si_title, F.col("si")), F.lit(False)),
        (second, "_BL_2.", F.lit("txt"), _lines(F.lit("B/L"), F.col("_more")), F.lit(False)),
    )
    path = lambda name, kind: F.concat(F.lit("in/e"), k.cast("string"), F.lit(name), kind)
    there = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    # messages name their files without the texts
    paths = there(*[F.when(holds, path(name, kind)) for holds, name, kind, _, _ in slots])
    files = made.select(F.inline(there(*[F.when(holds, F.struct(path(name, kind).alias("path"), kind.alias("format"), text.alias("text"), broken.alias("broken"))) for holds, name, kind, text, broken in slots])))
    body = F.when(asks, F.get(F.array(*map(F.lit, _CALLS)), (k % 3).cast("int"))).otherwise("two documents to look at")
    mail = made.select(k.cast("string").alias("email_id"), F.lit("desk@line.example").alias("from"), F.lit("a message").alias("subject"), body.alias("body"), paths.alias("attachments"))
    files = files.withColumn("format", F.substring_index("format", ".", -1))
    plain = F.when(F.col("broken"), F.lit("nothing to read").cast("binary")).when(F.col("format").isin("txt", "edi"), F.col("text").cast("binary"))
    office = _office("format", F.when(F.col("format").isin("docx", "xlsx") & ~F.col("broken"), F.col("text")))
    return mail, files.select("path", F.coalesce(plain, office).alias("content"))


def process_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail, files = (stored(x, "inbox") for x in inbox(spark, sf_dir))
    found = messages.process_emails(mail, files)
    fixed = lambda label: F.array_join(F.transform(F.filter("revision", lambda x: x["label"] == label), lambda x: x["field"]), ",")
    return found.select(
        F.col("email_id").cast("long").alias("o_orderkey"), "category", "decided_by", "confidence", "status", "review_reason", F.array_join("defect_fields", ",").alias("defects"), "n_shipments",
        *[F.coalesce(fixed(x), F.lit("none")).alias(x) for x in ("fixed", "still_wrong", "new_mistake")],
    )


def recompare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned values as an editor left them, judged again: the SI's own with
    one field changed or emptied."""
    booked = shipments.bookings(spark, sf_dir)
    k = F.col("o_orderkey") % 8
    norm = F.struct(*[F.lit("10 x 40'HC" if f == "container_count" else "1000.000" if f == "gross_weight_kg" else "ALPHA BETA").alias(f) for f in FIELDS])
    edited = F.struct(*[F.when(k == i, F.lit(None).cast("string") if f == "notify_party" else F.lit("2 x 20GP" if f == "container_count" else "999.8" if f == "gross_weight_kg" else "GAMMA")).otherwise(norm[f]).alias(f) for i, f in enumerate(FIELDS)])
    found = messages.compare_fields(booked.select("o_orderkey", norm.alias("si"), edited.alias("bl")), "o_orderkey")
    return found.withColumn("defect_fields", F.array_join("defect_fields", ","))


def extract_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's fields come from: saved and current, by rule, or
    a model's answer under its guard (invented values are dropped)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    number = k.cast("string")
    label = lambda f: F.lit(_LABELS[f])
    pair = lambda f, v: F.struct(label(f).alias("label"), v.alias("value"))
    values = {f: F.concat(F.lit(f"{f.upper()} "), number) for f in FIELDS}
    # every third document has no POD label the rules know
    known = [pair(f, values[f]) for f in FIELDS if f != "port_of_discharge"]
    pod = F.struct(F.when(k % 3 == 0, "Final place").otherwise(_LABELS["port_of_discharge"]).alias("label"), values["port_of_discharge"].alias("value"))
    docs = o.select(number.alias("doc"), F.lit("ok").alias("status"), F.lit("BILL OF LADING").alias("title"), F.array(*known, pod).alias("pairs"))
    rows = lambda v: F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(True).alias("present"), (F.lit("Final place") if f == "port_of_discharge" else label(f)).alias("label_seen"), v(f).alias("raw")) for f in FIELDS]))
    # what is saved of every fifth document is of another type in every tenth
    saved = o.where(k % 5 == 0).select(number.alias("doc"), F.lit("ok").alias("status"), F.when(k % 10 == 0, "SI").otherwise("BL").alias("type"), rows(lambda f: values[f]))
    answers = o.select(number.alias("doc"), rows(lambda f: F.when((k % 2 == 0) & F.lit(f == "shipper"), "INVENTED").otherwise(values[f])))
    found = extraction.chosen_extracts(docs, saved, answers)
    return found.groupBy(F.col("doc").cast("long").alias("o_orderkey"), "source").agg(F.count_if("present").alias("present"))


def second_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a first and a second answer: which is kept, how sure."""
    k = F.col("o_orderkey")
    pick = lambda of, *xs: F.get(F.array(*map(F.lit, xs)), (of % len(xs)).cast("int"))
    said = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("a message").alias("subject"),
        pick(k, "sign in at http://x.example", "I am out of the office", "as agreed").alias("body"),
        F.when(k % 4 == 0, F.array(F.lit("a_SI.txt"), F.lit("a_BL.txt"))).otherwise(F.array(F.lit("a_BL.txt"))).alias("attachments"),
        pick(k, "GENERAL", "BL_COMPARISON", "GENERAL", "SPAM", "BL_COMPARISON").alias("category"),
        routing.confidence_tier(pick(k, "high", "0.62", "0.9", "medium", "low", "unheard", "1")).alias("confidence"),
        pick(k, "GENERAL", "SPAM", "BL_COMPARISON").alias("second_category"),
        routing.confidence_tier(pick(k, "0.75", "very high")).alias("second_confidence"),
    )
    return routing.review(said).select("o_orderkey", "outcome", "kept", "kept_confidence")


def form_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forms, label above value, with a table of containers."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat_ws(
        "\n", F.lit("BILL OF LADING"), F.lit("Shipper"), F.concat(F.lit("S"), k), F.lit("1 QUAY ROAD"), F.lit("Consignee:"), F.concat(F.lit("C"), k), F.lit("Notify Party"), F.lit("N"),
        F.lit("Container No. Seal"), F.lit("Gross Weight"), F.lit("12 34"), F.lit("POL: PORT A"), F.lit("stray"), F.lit("POD"), F.lit("PORT B"), F.lit("Vessel: V"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("Gross Weight (KG)")), F.when(F.col("o_orderkey") % 2 == 0, k),
    )
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    read = readers.read_forms(lines).withColumn("f", readers.fields_of(F.col("pairs")))
    return read.select(F.col("doc").alias("o_orderkey"), "status", F.size("pairs").cast("long").alias("n_pairs"), *[F.col("f")[f].alias(f) for f in ("shipper", "consignee", "port_of_loading", "port_of_discharge", "gross_weight_kg")])


QUERIES = {f.__name__: f for f in (process_emails, recompare, extract_tiers, second_opinions, form_reader)}

_ROUTED = """e AS (SELECT *, c % 16 AS ch,
  CASE WHEN c <= 7 THEN 'OK' WHEN c <= 12 THEN 'MISMATCH' ELSE 'NEEDS_REVIEW' END AS st,
  CASE WHEN c = 13 THEN 'missing_value' WHEN c = 14 THEN 'wrong_doc_type' WHEN o_orderkey % 32 = 15 THEN 'missing_attachment' WHEN c = 15 THEN 'unreadable' END AS rr,
  o_orderkey % 7 = 3 AND o_orderkey % 32 <> 15 AS drafts, o_orderkey % 11 = 4 AND o_orderkey % 7 <> 3 AND o_orderkey % 32 <> 15 AS two
  FROM booked WHERE o_orderkey % 5 <> 0)"""
_CHANGED = lambda c: f"CASE {c} WHEN 8 THEN 'consignee' WHEN 9 THEN 'shipper' WHEN 10 THEN 'container_count' WHEN 11 THEN 'gross_weight_kg' WHEN 12 THEN 'port_of_discharge' ELSE '' END"
_WEIGHT_BLANK = "CASE WHEN c = 13 THEN 'gross_weight_kg' WHEN c = 15 THEN 'all' ELSE '' END"
ORACLES = {
    # a blank SI weight is wrong against both drafts; an unreadable draft has all fields wrong
    "process_emails": f"""WITH {shipments._BOOKED}, {_ROUTED},
f AS (SELECT *, {_CHANGED("c")} AS wrong, {_CHANGED("(c + 5) % 13")} AS was FROM e),
g AS (SELECT *, list_filter(['shipper', 'consignee', 'notify_party', 'port_of_loading', 'port_of_discharge', 'container_count', 'gross_weight_kg'], lambda x: x = was OR (c = 13 AND x = 'gross_weight_kg')) AS b,
  list_filter(['shipper', 'consignee', 'notify_party', 'port_of_loading', 'port_of_discharge', 'container_count', 'gross_weight_kg'], lambda x: c = 15 OR x = wrong OR (c = 13 AND x = 'gross_weight_kg')) AS a FROM f)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'GENERAL' ELSE 'INVOICE_QUERY' END AS category, 'rule' AS decided_by, 0.5::DOUBLE AS confidence, 'OK' AS status, NULL AS review_reason, '' AS defects, 0::BIGINT AS n_shipments, 'none' AS fixed, 'none' AS still_wrong, 'none' AS new_mistake
FROM booked WHERE o_orderkey % 5 = 0 UNION ALL
SELECT o_orderkey, 'BL_COMPARISON', 'rule', CASE WHEN o_orderkey % 32 = 15 THEN 0.5 ELSE 1 END,
  CASE WHEN two AND st = 'OK' THEN 'MISMATCH' ELSE st END, rr, CASE WHEN two AND st = 'OK' THEN 'container_count' ELSE wrong END, CASE WHEN two THEN 2 ELSE 1 END,
  CASE WHEN NOT drafts THEN 'none' ELSE array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') END,
  CASE WHEN NOT drafts THEN 'none' ELSE array_to_string(list_filter(b, lambda x: list_contains(a, x)), ',') END,
  CASE WHEN NOT drafts THEN 'none' ELSE array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') END FROM g""",
    "recompare": f"""WITH {shipments._BOOKED} SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN 'OK' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'MISMATCH' END AS status, CASE WHEN o_orderkey % 8 = 2 THEN 'missing_value' END AS review_reason,
CASE o_orderkey % 8 WHEN 0 THEN 'shipper' WHEN 1 THEN 'consignee' WHEN 3 THEN 'port_of_loading' WHEN 4 THEN 'port_of_discharge' WHEN 5 THEN 'container_count' WHEN 6 THEN 'gross_weight_kg' ELSE '' END AS defect_fields FROM booked""",
    "extract_tiers": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 5 THEN 'saved' WHEN o_orderkey % 3 <> 0 THEN 'rule' ELSE 'model' END AS source,
CASE WHEN o_orderkey % 10 <> 5 AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 6 ELSE 7 END::BIGINT AS present FROM orders""",
    "second_opinions": """WITH a AS (SELECT o_orderkey AS k, list_extract(['GENERAL', 'BL_COMPARISON', 'GENERAL', 'SPAM', 'BL_COMPARISON'], k % 5 + 1) AS c1, list_extract([1.0, 0.65, 1.0, 0.85, 0.5, 0.85, 1.0], k % 7 + 1)::DOUBLE AS s1,
  list_extract(['GENERAL', 'SPAM', 'BL_COMPARISON'], k % 3 + 1) AS c2, CASE k % 2 WHEN 0 THEN 0.85 ELSE 1 END::DOUBLE AS s2 FROM orders),
d AS (SELECT *, s1 < 0.8 AS unsure, c1 <> 'BL_COMPARISON' AND k % 4 = 0 AS pair, c1 <> 'SPAM' AND k % 3 = 0 AS bait, c1 = 'BL_COMPARISON' AND k % 3 = 1 AS auto FROM a),
o AS (SELECT *, CASE WHEN NOT (unsure OR pair OR bait OR auto) THEN 'unasked' WHEN c1 = c2 THEN 'agreed'
  WHEN (pair AND c2 = 'BL_COMPARISON') OR (bait AND c2 = 'SPAM') OR (auto AND c2 <> 'BL_COMPARISON') OR (unsure AND s2 > s1) THEN 'changed' ELSE 'contested' END AS outcome FROM d)
SELECT k AS o_orderkey, outcome, CASE outcome WHEN 'changed' THEN c2 ELSE c1 END AS kept, CASE outcome WHEN 'agreed' THEN greatest(s1, s2) WHEN 'changed' THEN s2 WHEN 'contested' THEN 0.5 ELSE s1 END AS kept_confidence FROM o""",
    "form_reader": """SELECT o_orderkey, 'ok' AS status, CASE o_orderkey % 2 WHEN 0 THEN 6 ELSE 5 END::BIGINT AS n_pairs, 'S' || o_orderkey || ' | 1 QUAY ROAD' AS shipper, 'C' || o_orderkey AS consignee, 'PORT A' AS port_of_loading,
CASE o_orderkey % 2 WHEN 0 THEN 'PORT B | Vessel: V' ELSE 'PORT B | Vessel: V' END AS port_of_discharge, CASE o_orderkey % 2 WHEN 0 THEN o_orderkey::VARCHAR END AS gross_weight_kg FROM orders""",
}
