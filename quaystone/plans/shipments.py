"""Shipment pairs derived from orders, and the queries on them.

An order with lines is a shipment. Its SI is written from customer, supplier
and line counts; its BL is the SI with one change, picked by o_orderkey % 16,
so SQL can state the expected verdict without the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions import fields
from quaystone.functions.fields import FIELDS
from quaystone.operators import compare, pairing
from quaystone.session import short_methods, table


def _port(nation: Column) -> Column:
    letter = F.char(F.lit(65) + nation)
    return F.concat(F.lit("CITY"), letter, F.lit("VILLE, CHINA (CNAA"), letter, F.lit(")"))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey and si: the raw fields of the order's SI."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("cnt"), (F.sum("l_quantity").cast("bigint") * 10).alias("kg"), F.min("l_suppkey").alias("supp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("supp") == F.col("s_suppkey"))
    si = F.struct(
        F.concat("s_name", F.lit("\n  1 EXAMPLE ROAD")).alias("shipper"),
        F.col("c_name").alias("consignee"),
        F.col("c_name").alias("notify_party"),
        _port(F.col("s_nationkey")).alias("port_of_loading"),
        _port(F.col("c_nationkey")).alias("port_of_discharge"),
        F.concat(F.col("cnt").cast("string"), F.lit(" x 40'HC")).alias("container_count"),
        F.concat(F.format_number("kg", 0), F.lit(" KG")).alias("gross_weight_kg"),
    )
    return joined.select("o_orderkey", "o_custkey", "cnt", "kg", "s_name", "c_name", "c_nationkey", si.alias("si"))


def drafted(booked: DataFrame, change: Column) -> Column:
    """The BL's raw fields: the SI with the given change."""
    si = F.col("si")
    other = {
        "shipper": F.when(change == 4, F.lower(si["shipper"])).when(change == 9, F.concat(F.expr("substring(s_name, 2)"), F.lit("\n  1 EXAMPLE ROAD"))),
        "consignee": F.when(change == 4, F.lower(si["consignee"])).when(change == 8, F.concat(F.lit("OTHER "), F.col("c_name"))),
        "notify_party": F.when(change == 7, F.lit("SAME AS CONSIGNEE")),
        "port_of_loading": F.when(change == 5, F.regexp_replace(si["port_of_loading"], r" \(.*$", "")),
        "port_of_discharge": F.when(change == 12, _port((F.col("c_nationkey") + 1) % 25)),
        "container_count": F.when(change == 10, F.concat((F.col("cnt") + 1).cast("string"), F.lit(" x 40'HC"))),
        "gross_weight_kg": F.when(change == 6, F.concat(F.format_number("kg", 0), F.lit(".00 KGS"))).when(change == 11, F.concat(F.format_number(F.col("kg") + 50, 0), F.lit(" KG"))),
    }
    return F.struct(*[F.coalesce(other[f], si[f]).alias(f) for f in FIELDS])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input of compare_pairs, one row an order with lines."""
    booked = bookings(spark, sf_dir)
    change = (F.col("o_orderkey") % 16).cast("int")
    bl = F.when(F.col("o_orderkey") % 32 != 15, drafted(booked, change))
    blank_weight = F.struct(*[(F.lit("TBA") if f == "gross_weight_kg" else F.col("si")[f]).alias(f) for f in FIELDS])
    return booked.select(
        "o_orderkey",
        "o_custkey",
        F.when(change == 13, blank_weight).otherwise(F.col("si")).alias("si"),
        bl.alias("bl"),
        F.lit("ok").alias("si_status"),
        F.when(F.col("o_orderkey") % 32 == 15, "missing").when(change == 15, "unreadable").otherwise("ok").alias("bl_status"),
        F.lit("SHIPPING INSTRUCTION").alias("si_title"),
        F.when(change == 14, "PACKING LIST").when(change == 15, None).otherwise("BILL OF LADING (DRAFT)").alias("bl_title"),
    )


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_pairs(pairs(spark, sf_dir))


def verify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("o_orderkey", "status", "review_reason", F.array_join("defect_fields", ",").alias("defects"))


def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.long_rows(compared(spark, sf_dir), "o_orderkey").select("o_orderkey", F.col("field_ord").cast("long"), "field", "verdict")


def defect_fields_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.defects(compared(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("n"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).groupBy("status", F.coalesce("review_reason", F.lit("none")).alias("review_reason")).agg(F.count("*").alias("n"))


def auto_cleared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compared(spark, sf_dir).agg(F.count_if(F.col("status") == "OK").alias("cleared"), F.count("*").alias("n"))
    return found.select("cleared", "n", F.round(F.coalesce(F.try_divide("cleared", "n"), F.lit(0.0)), 6).alias("share"))


#: (name, field, change of drafted, breaks the pair)
EDITS = (
    ("lower_names", "shipper", 4, False), ("code_dropped", "port_of_loading", 5, False), ("unit_respelled", "gross_weight_kg", 6, False),
    ("same_as_consignee", "notify_party", 7, False), ("other_name", "consignee", 8, True), ("typo", "shipper", 9, True),
    ("count_bumped", "container_count", 10, True), ("weight_bumped", "gross_weight_kg", 11, True), ("port_swapped", "port_of_discharge", 12, True),
)


def mutation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every SI against a copy of itself with each edit: breaking edits must be
    found on exactly their field, harmless ones nowhere. An edit leaves the
    other fields as they are, so the SI is cleaned once and each edit cleans
    what it changes: its field, and the notify party that a new consignee may
    be meant by."""
    short_methods(spark)
    booked = bookings(spark, sf_dir)
    si = {f: F.col("si")[f] for f in FIELDS}
    tried = booked.withColumns({f"_bl{c}": drafted(booked, F.lit(c)) for _, _, c, _ in EDITS})
    meant = lambda doc: fields.notify_as_meant(doc["notify_party"], doc["consignee"])
    raw = {**si, "notify_party": meant(F.col("si"))}
    for name, f, c, _ in EDITS:
        bl = F.col(f"_bl{c}")
        raw[f"{f}-{name}"] = meant(bl) if f == "notify_party" else bl[f]
        if f == "consignee":
            raw[f"notify_party-{name}"] = meant(bl)
    for columns in fields.clean_in_stages(raw, prefix="_c_"):
        tried = tried.withColumns(columns)
    cleaned = lambda f, name="": F.col(f"`_c_{f}-{name}`" if f"{f}-{name}" in raw else f"_c_{f}")
    agrees = lambda f, name="": fields.verdict(f, cleaned(f), cleaned(f, name)) == "match"
    tried = tried.withColumns({f"_same_{f}": agrees(f) for f in FIELDS} | {f"_edit_{k}": agrees(k.partition("-")[0], k.partition("-")[2]) for k in raw if "-" in k})
    found = {}
    for name, f, _, breaks in EDITS:
        others = [F.col(f"`_edit_{g}-{name}`") if f"{g}-{name}" in raw else F.col(f"_same_{g}") for g in FIELDS if g != f]
        hit = F.col(f"`_edit_{f}-{name}`") != F.lit(breaks)
        found[name] = F.count_if(reduce(lambda x, y: x & y, others, hit))
    counted = tried.agg(F.count("*").alias("trials"), *[x.alias(name) for name, x in found.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("edit"), F.lit(b).alias("breaks"), F.col("trials"), F.col(n).alias("as_expected")) for n, f, _, b in EDITS])
    return counted.select(F.inline(rows))


def revision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of two drafts of one BL: the order's change, then another."""
    booked = bookings(spark, sf_dir)
    first, second = (F.col("o_orderkey") % 13).cast("int"), ((F.col("o_orderkey") * 5 + 3) % 13).cast("int")
    both = booked.withColumns({"one": drafted(booked, first), "two": drafted(booked, second)})
    before = compare.with_rows(both, bl="one", out="before", keep_si=True)
    after = compare.with_rows(before, bl="two")
    labelled = F.transform(F.arrays_zip("before", F.col("rows")), lambda x: F.struct(x["before"]["field"].alias("field"), compare.revision_label(x["before"]["verdict"], x["rows"]["verdict"]).alias("label")))
    return after.select(F.explode(labelled).alias("x")).groupBy("x.field", "x.label").agg(F.count("*").alias("n"))


def worst_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.worst_of(compared(spark, sf_dir), "o_custkey", "o_orderkey")
    return found.select("o_custkey", "status", F.col("shown").alias("o_orderkey"), "n_pairs", "statuses")


_NAMES = ("", "_V2", "_V3", "_REVISED", "_copy", " (2)")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % len(_NAMES)).cast("int"))
    path = F.concat(F.lit("in/e"), F.col("o_custkey").cast("string"), F.lit("_BL"), suffix, F.lit(".txt"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("email_id"), F.lit("BL").alias("role"), path.alias("path"), F.lit("").alias("title"), F.col("o_orderkey").alias("pos"))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pairing.latest_revisions(_versions(spark, sf_dir)).where(F.col("order") <= 2)
    pick = lambda n: F.max(F.when(F.col("order") == n, F.col("pos")))
    return ranked.groupBy(F.col("email_id").alias("o_custkey")).agg(pick(1).alias("chosen"), pick(2).alias("previous"))


def shipment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    roles = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("SI"), F.lit("BL"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("SI"))).otherwise(F.array(F.lit("BL")))
    files = orders.select(F.col("o_custkey").alias("email_id"), F.col("o_orderkey").alias("pos"), F.explode(roles).alias("r"))
    files = files.select("email_id", "pos", F.concat(F.lit("in/m"), F.col("email_id").cast("string"), F.lit("_"), F.col("r"), F.lit("_"), F.col("pos").cast("string"), F.lit(".txt")).alias("path"))
    return pairing.shipments(files).select(F.col("email_id").alias("o_custkey"), "key", "si_path", "bl_path", (F.col("si_path").isNotNull() & F.col("bl_path").isNotNull()).alias("complete"))


def corrections_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' words on three kinds of orders, put over the verdicts."""
    rows = compare.long_rows(compared(spark, sf_dir), "o_orderkey")
    return compare.with_corrections(rows, _corrections(spark, sf_dir), "o_orderkey").groupBy("o_orderkey").agg(
        F.count_if(F.col("verdict") != "match").alias("issues"), F.count("tag").alias("tags")
    )


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dismissal of changes 8, a fix of the BL's weight for changes 11 (to
    the SI's), a confirmation of 10, an undone dismissal of 12."""
    one = lambda field, kind, at=1, side=None, corrected=None: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(side).cast("string").alias("side"), (F.lit(None).cast("string") if corrected is None else corrected).alias("corrected"), F.lit(at).alias("at"))
    change = F.col("o_orderkey") % 16
    said = (
        F.when(change == 8, F.array(one("consignee", "dismiss")))
        .when(change == 10, F.array(one("container_count", "confirm")))
        .when(change == 11, F.array(one("gross_weight_kg", "fix", 1, "BL", F.col("si.gross_weight_kg"))))
        .when(change == 12, F.array(one("port_of_discharge", "dismiss"), one("port_of_discharge", "undo", 2)))
    )
    return bookings(spark, sf_dir).where(change.isin(8, 10, 11, 12)).select("o_orderkey", F.inline(said))


def corrections_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrections(spark, sf_dir).groupBy("field", "kind", F.coalesce("side", F.lit("none")).alias("side")).agg(F.count("*").alias("n"))


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = compare.contract_errors(compared(spark, sf_dir))
    return checked.groupBy(F.size("errors").cast("long").alias("n_errors")).agg(F.count("*").alias("n"))


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("o_orderkey") % 5 == 0, "GENERAL").otherwise("BL_COMPARISON")
    found = compare.submission(compared(spark, sf_dir), "o_orderkey", category)
    return found.withColumn("defect_fields", F.array_join("defect_fields", ","))


QUERIES = {
    f.__name__: f
    for f in (
        verify_status, verify_rows, defect_fields_hist, review_reasons, auto_cleared_share, mutation_matrix, revision_labels,
        worst_shipment, latest_revision, shipment_pairs, corrections_overlay, corrections_by_field, contract_errors, submission,
    )
}

_BOOKED = """booked AS (
  SELECT o_orderkey, o_custkey, o_orderkey % 16 AS c FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
_WRONG = "CASE c WHEN 8 THEN 'consignee' WHEN 9 THEN 'shipper' WHEN 10 THEN 'container_count' WHEN 11 THEN 'gross_weight_kg' WHEN 12 THEN 'port_of_discharge' ELSE '' END"
_EXPECTED = f"""WITH {_BOOKED},
e AS (SELECT o_orderkey, o_custkey, c,
  CASE WHEN c <= 7 THEN 'OK' WHEN c <= 12 THEN 'MISMATCH' ELSE 'NEEDS_REVIEW' END AS status,
  CASE WHEN c = 13 THEN 'missing_value' WHEN c = 14 THEN 'wrong_doc_type' WHEN o_orderkey % 32 = 15 THEN 'missing_attachment' WHEN c = 15 THEN 'unreadable' END AS review_reason,
  {_WRONG} AS defects FROM booked)"""
_FIELD_LIST = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FIELDS))
_RANK = "CASE status WHEN 'OK' THEN 0 WHEN 'MISMATCH' THEN 1 ELSE 2 END"

ORACLES = {
    "verify_status": f"{_EXPECTED} SELECT o_orderkey, status, review_reason, defects FROM e",
    "verify_rows": f"""{_EXPECTED}, f(field_ord, field) AS (VALUES {_FIELD_LIST})
SELECT o_orderkey, field_ord::BIGINT AS field_ord, field,
  CASE WHEN c = 13 AND field = 'gross_weight_kg' THEN 'missing' WHEN defects = field THEN 'mismatch' ELSE 'match' END AS verdict
FROM e, f WHERE c <= 13""",
    "defect_fields_hist": f"{_EXPECTED} SELECT defects AS field, count(*) AS n FROM e WHERE defects <> '' GROUP BY 1",
    "review_reasons": f"{_EXPECTED} SELECT status, coalesce(review_reason, 'none') AS review_reason, count(*) AS n FROM e GROUP BY 1, 2",
    "auto_cleared_share": f"{_EXPECTED} SELECT count(*) FILTER (WHERE status = 'OK') AS cleared, count(*) AS n, round(coalesce(count(*) FILTER (WHERE status = 'OK')::DOUBLE / nullif(count(*), 0), 0), 6) AS share FROM e",
    "mutation_matrix": f"WITH {_BOOKED}, e(edit, field, breaks) AS (VALUES {', '.join(f"('{n}', '{f}', {str(b).lower()})" for n, f, _, b in EDITS)}) SELECT field, edit, breaks, count(*) AS trials, count(*) AS as_expected FROM booked, e GROUP BY 1, 2, 3",
    "revision_labels": f"""WITH {_BOOKED}, f(i, field) AS (VALUES {_FIELD_LIST}),
d AS (SELECT {_WRONG.replace("CASE c", "CASE o_orderkey % 13")} AS a, {_WRONG.replace("CASE c", "CASE (o_orderkey * 5 + 3) % 13")} AS b FROM booked)
SELECT field, CASE WHEN a = field AND b = field THEN 'still_wrong' WHEN a = field THEN 'fixed' WHEN b = field THEN 'new_mistake' ELSE 'unchanged' END AS label, count(*) AS n FROM d, f GROUP BY 1, 2""",
    "worst_shipment": f"""{_EXPECTED}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK} DESC, o_orderkey) AS k FROM e)
SELECT o_custkey, max(status) FILTER (WHERE k = 1) AS status, max(o_orderkey) FILTER (WHERE k = 1) AS o_orderkey, count(*) AS n_pairs, string_agg(status, ',' ORDER BY o_orderkey) AS statuses FROM r GROUP BY 1""",
    "latest_revision": """WITH v AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS marked, CASE o_orderkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 5 THEN 2 ELSE 0 END AS num FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY marked DESC, num DESC, o_orderkey DESC) AS k FROM v)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE k = 1) AS chosen, max(o_orderkey) FILTER (WHERE k = 2) AS previous FROM r WHERE k <= 2 GROUP BY 1""",
    "shipment_pairs": """SELECT o_custkey, 'm' || o_custkey || '_' || o_orderkey AS key,
  CASE WHEN o_orderkey % 3 <> 2 THEN 'in/m' || o_custkey || '_SI_' || o_orderkey || '.txt' END AS si_path,
  CASE WHEN o_orderkey % 3 <> 1 THEN 'in/m' || o_custkey || '_BL_' || o_orderkey || '.txt' END AS bl_path, o_orderkey % 3 = 0 AS complete FROM orders""",
    "corrections_overlay": f"{_EXPECTED} SELECT o_orderkey, (CASE WHEN c IN (9, 10, 12, 13) THEN 1 ELSE 0 END)::BIGINT AS issues, (CASE WHEN c IN (8, 10, 11) THEN 1 ELSE 0 END)::BIGINT AS tags FROM e WHERE c <= 13",
    "corrections_by_field": f"""WITH {_BOOKED}, k(c, field, kind, side) AS (VALUES (8, 'consignee', 'dismiss', 'none'), (11, 'gross_weight_kg', 'fix', 'BL'), (10, 'container_count', 'confirm', 'none'), (12, 'port_of_discharge', 'dismiss', 'none'), (12, 'port_of_discharge', 'undo', 'none'))
SELECT field, kind, side, count(*) AS n FROM booked JOIN k USING (c) GROUP BY 1, 2, 3""",
    "contract_errors": f"WITH {_BOOKED} SELECT 0::BIGINT AS n_errors, count(*) AS n FROM booked",
    "submission": f"""{_EXPECTED} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'GENERAL' ELSE 'BL_COMPARISON' END AS category,
  CASE WHEN o_orderkey % 5 = 0 THEN 'OK' ELSE status END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN review_reason END AS review_reason,
  o_orderkey % 5 <> 0 AND defects <> '' AS has_defect, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE defects END AS defect_fields FROM e""",
}
