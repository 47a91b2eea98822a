"""Queries on contracts, reviews, reports and reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions import documents, strict, text
from quaystone.operators import compare, contracts, extraction, ledger, routing
from quaystone.plans import reporting, shipments
from quaystone.session import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat results by construction: change % 16 as in the shipments, one rule
    broken by o_orderkey % 9."""
    k = F.col("o_orderkey")
    c, bad = k % 16, k % 9
    none = F.array().cast("array<string>")
    status = F.when(c <= 7, "OK").when(c <= 12, "MISMATCH").otherwise("NEEDS_REVIEW")
    return table(spark, sf_dir, "orders").select(
        F.when(bad == 1, "OTHER").otherwise("BL_COMPARISON").alias("category"),
        status.alias("status"),
        F.when((status == "NEEDS_REVIEW") & (bad != 2), "unreadable").alias("review_reason"),
        F.when(bad == 3, F.lit(None).cast("boolean")).otherwise(status == "MISMATCH").alias("has_defect"),
        F.when(status == "MISMATCH", F.when(bad == 4, F.array(F.lit("colour"))).when(bad == 5, none).otherwise(F.array(F.lit("shipper")))).otherwise(none).alias("defect_fields"),
    )


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.broken_rules(_entries(spark, sf_dir), contracts.ENTRY)


def visible_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports, and purchases as replies to users' reviews: how many
    rows user 7, and an administrator, sees."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("user_id"), "event_type")
    reviews = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("user_id"))
    replies = e.where("event_type = 'purchase'").select(F.col("user_id").cast("long").alias("review_id"))
    admins = spark.createDataFrame([("Lead@Line.Example",)], "email string")
    out = None
    for who, mail in (("7", "user@line.example"), ("7", "lead@line.EXAMPLE")):
        admin = ledger.is_admin(admins, mail)
        seen = ledger.visible(e, who, admin).agg(F.count("*").alias("reports")).crossJoin(ledger.visible_through(replies, reviews, who, admin).agg(F.count("*").alias("replies"))).withColumn("admin", F.lit(admin))
        out = seen if out is None else out.unionByName(seen)
    return out


def merged_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a device over those of the account."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("email_ref"))
    k = F.col("email_ref")
    local = o.where(k % 2 == 0).withColumn("mark", F.lit("ok"))
    remote = o.where(k % 3 == 0).withColumn("mark", F.when(k % 9 != 0, "back"))
    return ledger.merged_marks(local, remote)


def upserted_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's reviews of event types after all events: the last mark."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("email_ref"), F.col("event_id").cast("string").alias("mark"), F.struct("ts", "event_id").alias("updated_at"))
    early = F.col("updated_at.event_id") % 2 == 0
    stored = ledger.upserted(e.limit(0), e.where(early), ["user_id", "email_ref"], "updated_at")
    return ledger.upserted(stored, e.where(~early), ["user_id", "email_ref"], "updated_at").select("user_id", "email_ref", "mark")


def technical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps with one to three attempts; those that struggled."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    steps = o.select(k.alias("step_id"), F.lit("Sorting").alias("name"), k.cast("string").alias("email_id"), F.lit("filed by keywords").alias("if_no_answer"), F.when(k % 10 == 0, "asked twice").alias("note_title"), F.when(k % 10 == 0, "kept").alias("note_outcome"))
    tries = o.select(k.alias("step_id"), F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("ordinal"))
    last = F.col("ordinal") == F.col("step_id") % 3 + 1
    attempts = tries.withColumns({"model": F.concat(F.lit("m"), F.col("ordinal").cast("string")), "result": F.when(last & (F.col("step_id") % 4 != 0), "answered").otherwise("timed out"), "seconds": F.lit(2.25)})
    return ledger.steps_reported(attempts, steps).select("step_id", "title", F.md5("detail").alias("detail_md5"), "tries", "own_email_only")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run of results, by construction."""
    k = F.col("o_orderkey")
    c = k % 16
    status = F.when(k % 5 == 0, None).when(c <= 7, "OK").when(c <= 12, "MISMATCH").otherwise("NEEDS_REVIEW")
    defects = F.when((c > 7) & (c <= 12) & (k % 5 != 0), F.array(F.lit("shipper"), F.lit("consignee"))).otherwise(F.array().cast("array<string>"))
    r = table(spark, sf_dir, "orders").select(status.alias("status"), ((c == 15) & (k % 5 != 0)).alias("awaiting"), F.when(k % 5 == 0, 0).otherwise(2).alias("n_attachments"), defects.alias("defect_fields"), F.when(k % 3 == 0, k.cast("string")).alias("ref"), F.col("o_custkey").alias("from"))
    one, two = ledger.pipeline_summary(r), ledger.waiting_summary(r)
    hours = ledger.impact(one.select("cleared")).groupBy().pivot("minutes", [2, 3, 5]).agg(F.first("hours"))
    return one.crossJoin(two).crossJoin(hours.select(*[F.col(f"`{m}`").alias(f"hours_{m}") for m in (2, 3, 5)])).withColumn("cleared_percent", text.percent(F.col("cleared_share"))).withColumn("cleared_share", F.round("cleared_share", 6))


def timed_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled-in sheets scored against the key."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    key = o.select(k.alias("pair"), F.when(k % 2 == 0, "OK").otherwise("MISMATCH").alias("status"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("consignee"), F.lit("shipper"))).alias("defect_fields"))
    seconds = F.when(k % 7 == 0, "").when(k % 7 == 1, "soon").otherwise((k % 50).cast("string"))
    answers = o.select(k.alias("pair"), seconds.alias("seconds"), F.when(k % 5 == 0, "?").when(k % 2 == 0, " ok ").otherwise("mismatch").alias("verdict"), F.when(k % 2 == 0, "").when(k % 3 == 0, "Shipper").otherwise("Shipper; consignee;").alias("fields_that_differ"))
    return ledger.timed_scores(answers, key).withColumn("mean", F.round("mean", 4))


def body_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with known phrases and senders, filed by them."""
    k = F.col("o_orderkey")
    body = F.get(F.array(*map(F.lit, ("please CHECK the draft BL against the SI", "query on INVOICE 7", "the daily berthing report", "good morning"))), (k % 4).cast("int"))
    found = routing.body_category(F.when(k % 7 == 0, "x@prize-claims.info").otherwise("x@line.example"), body)
    return table(spark, sf_dir, "orders").select(found.alias("f")).groupBy(F.coalesce("f.category", F.lit("none")).alias("category"), "f.evidence").agg(F.count("*").alias("n"))


def keyword_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as filed messages, against the keywords."""
    c = table(spark, sf_dir, "conversations")
    saved = c.select(F.col("conv_id").cast("string").alias("email_id"), F.col("role").alias("subject"), F.col("text").alias("body"), F.array().cast("array<string>").alias("attachments"), F.lit("GENERAL").alias("category"), F.when(F.col("turn") % 2 == 0, 0.65).otherwise(0.85).alias("confidence"))
    return routing.disagreements(saved)


def verdict_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose result differs between the full comparison and a stricter
    one that takes weights as texts: those whose weight is spelt anew."""
    pairs = shipments.pairs(spark, sf_dir)
    full = compare.compare_pairs(pairs)
    plain = pairs.withColumn("bl", F.when(F.col("bl").isNotNull(), F.col("bl").withField("gross_weight_kg", F.when(F.col("bl.gross_weight_kg").contains("KGS"), F.lit("1 KG")).otherwise(F.col("bl.gross_weight_kg")))))
    return extraction.verdicts_differ(full, compare.compare_pairs(plain), "o_orderkey").select("o_orderkey", F.col("a.status").alias("first"), F.col("b.status").alias("second"))


def rule_sets_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of both rule sets on pairs that are compared field by field,
    tallied by field."""
    pairs = shipments.pairs(spark, sf_dir).where("bl is not null and bl_status = 'ok' and bl_title <> 'PACKING LIST'")
    both = strict.with_verdicts(compare.with_rows(pairs.select("o_orderkey", "si", "bl")))
    each = both.select(F.inline(F.arrays_zip(F.transform("rows", lambda r: r["field"]).alias("field"), F.transform("rows", lambda r: r["verdict"]).alias("judged"), F.col("strict"))))
    return each.groupBy("field", "judged", "strict").agg(F.count("*").alias("n"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about each pair."""
    return shipments.compared(spark, sf_dir).select("o_orderkey", "evidence")


_ASKS = (
    ("BL_COMPARISON", "it is still missing", False), ("BL_COMPARISON", "please send it", True), ("BL_COMPARISON", "see attached", False), ("SI_REQUEST", "here it is", False), ("INVOICE_QUERY", "detention again", False),
    ("GENERAL", "this is an automated notification", False), ("GENERAL", "ETA is Monday", False), ("GENERAL", "two items pending", False), ("GENERAL", "Happy New Year", False), ("GENERAL", "hello", False), ("SPAM", "prize", False),
)


def all_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every category with their intents."""
    asks = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(b).alias("body"), F.lit(w).alias("awaiting")) for c, b, w in _ASKS])
    o = table(spark, sf_dir, "orders").select(F.get(asks, (F.col("o_orderkey") % len(_ASKS)).cast("int")).alias("a")).select("a.*")
    return o.withColumn("intent", F.coalesce(documents.email_intent(F.col("category"), F.col("body"), F.col("awaiting")), F.lit("none"))).groupBy("category", "intent").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (schema_errors, visible_reports, merged_marks, upserted_reviews, technical_reports, summaries, timed_test, body_rules, keyword_agreement, verdict_agreement, rule_sets_agree, evidence_lines, all_intents)}

ORACLES = {
    "schema_errors": """WITH e AS (SELECT o_orderkey % 9 AS bad, CASE WHEN o_orderkey % 16 <= 7 THEN 'OK' WHEN o_orderkey % 16 <= 12 THEN 'MISMATCH' ELSE 'NEEDS_REVIEW' END AS st FROM orders),
x AS (SELECT '$.category: is none of BL_COMPARISON, SI_REQUEST, INVOICE_QUERY, GENERAL, SPAM' AS error FROM e WHERE bad = 1
UNION ALL SELECT '$: a review has a reason' FROM e WHERE bad = 2 AND st = 'NEEDS_REVIEW'
UNION ALL SELECT '$: lacks has_defect' FROM e WHERE bad = 3
UNION ALL SELECT '$: defects are told' FROM e WHERE bad = 3 AND st <> 'MISMATCH'
UNION ALL SELECT '$.defect_fields[0]: is none of shipper, consignee, notify_party, port_of_loading, port_of_discharge, container_count, gross_weight_kg' FROM e WHERE bad = 4 AND st = 'MISMATCH'
UNION ALL SELECT '$: a mismatch has defects' FROM e WHERE bad = 5 AND st = 'MISMATCH'
UNION ALL SELECT '$: defects are told' FROM e WHERE bad = 5 AND st = 'MISMATCH')
SELECT error, count(*) AS n FROM x GROUP BY 1""",
    "visible_reports": """SELECT (SELECT count(*) FROM events WHERE user_id = 7 AND event_type <> 'error') AS reports, (SELECT count(*) FROM events WHERE user_id = 7 AND event_type = 'purchase') AS replies, false AS admin
UNION ALL SELECT (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer)), true""",
    "merged_marks": "SELECT o_orderkey AS email_ref, CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'back' END AS mark FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0)",
    "upserted_reviews": """WITH r AS (SELECT user_id::VARCHAR AS user_id, event_type AS email_ref, event_id::VARCHAR AS mark, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, email_ref, mark FROM r WHERE n = 1""",
    "technical_reports": """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS n, o_orderkey % 10 = 0 AS noted, o_orderkey % 4 <> 0 AS answered FROM orders),
l AS (SELECT k, string_agg(i || '. m' || i || ': ' || CASE WHEN i = n AND answered THEN 'answered' ELSE 'timed out' END || ' (2.3 s)', chr(10) ORDER BY i) AS lines FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM s) GROUP BY k)
SELECT k AS step_id, 'Sorting: ' || CASE WHEN noted THEN 'asked twice' WHEN answered THEN 'answered on try ' || n || ' by m' || n ELSE 'no answer after ' || n || CASE n WHEN 1 THEN ' try' ELSE ' tries' END END AS title,
  md5(CASE WHEN noted THEN 'kept' WHEN answered THEN 'answered by m' || n ELSE 'filed by keywords' END || chr(10) || chr(10) || lines) AS detail_md5, n AS tries, noted AS own_email_only
FROM s JOIN l USING (k) WHERE noted OR n > 1 OR NOT answered""",
    "summaries": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 16 AS c, o_orderkey % 5 <> 0 AS routed, o_custkey FROM orders),
s AS (SELECT count(*) AS emails, count(*) FILTER (routed) AS with_attachments, count(*) FILTER (routed) AS routed, count(*) FILTER (routed AND c = 15) AS awaiting, count(*) FILTER (routed AND c <> 15) AS comparisons,
  count(*) FILTER (routed AND c <= 7) AS cleared, count(*) FILTER (routed AND c BETWEEN 8 AND 12) AS mismatched, count(*) FILTER (routed AND c IN (13, 14)) AS reviewed, 2 * count(*) FILTER (routed AND c BETWEEN 8 AND 12) AS field_differences,
  count(*) FILTER (routed AND c = 15) AS waiting, count(*) FILTER (routed AND c = 15 AND k % 3 = 0) AS with_reference, count(DISTINCT CASE WHEN routed AND c = 15 THEN o_custkey END) AS senders, count(DISTINCT CASE WHEN k % 3 = 0 THEN k END) AS distinct_references FROM r)
SELECT *, round(cleared / comparisons, 6) AS cleared_share, format('{:.1f}%', 100.0 * cleared / comparisons) AS cleared_percent, round_even(cleared * 2 / 60, 1) AS hours_2, round_even(cleared * 3 / 60, 1) AS hours_3, round_even(cleared * 5 / 60, 1) AS hours_5 FROM s""",
    "timed_test": """WITH a AS (SELECT o_orderkey AS k, (o_orderkey % 50)::DOUBLE AS s, o_orderkey % 5 <> 0 AS "right", o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 AS named FROM orders WHERE o_orderkey % 7 > 1)
SELECT count(*) AS checks, round(avg(s), 4) AS mean, median(s) AS median, min(s) AS least, max(s) AS most, count(*) FILTER ("right") AS verdicts, count(*) FILTER ("right" AND named) AS exact FROM a""",
    "body_rules": """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'SPAM' ELSE list_extract(['BL_COMPARISON', 'INVOICE_QUERY', 'GENERAL', 'none'], o_orderkey % 4 + 1) END AS category,
CASE WHEN o_orderkey % 7 = 0 THEN 'known spam domain prize-claims.info' ELSE list_extract(['says: check the draft BL against the SI', 'says: Query on invoice', 'says: daily berthing report', 'no rule'], o_orderkey % 4 + 1) END AS evidence, count(*) AS n FROM orders GROUP BY 1, 2""",
    "keyword_agreement": f"SELECT count(*) AS total, count(*) FILTER (WHERE {reporting._SQL_CATEGORY} = 'GENERAL') AS agree, count(*) FILTER (WHERE turn % 2 = 0) AS unsure FROM conversations",
    "verdict_agreement": f"WITH {shipments._BOOKED} SELECT o_orderkey, 'OK' AS first, 'MISMATCH' AS second FROM booked WHERE c = 6",
    "rule_sets_agree": f"""WITH {shipments._BOOKED}, f(i, field) AS (VALUES {shipments._FIELD_LIST}),
v AS (SELECT field, CASE WHEN c = 13 AND field = 'gross_weight_kg' THEN 'missing' WHEN {shipments._WRONG} = field THEN 'mismatch' ELSE 'match' END AS v FROM booked, f WHERE c <= 13)
SELECT field, v AS judged, v AS strict, count(*) AS n FROM v GROUP BY 1, 2""",
    "evidence_lines": f"""WITH {shipments._BOOKED} SELECT o_orderkey, CASE WHEN c <= 7 THEN 'all seven fields agree' WHEN c <= 12 THEN '1 fields differ: ' || {shipments._WRONG}
WHEN c = 13 THEN 'gross_weight_kg: SI says "TBA"' WHEN c = 14 THEN 'BL file is titled PACKING LIST' WHEN o_orderkey % 32 = 15 THEN 'BL is not attached' ELSE 'BL is unreadable' END AS evidence FROM booked""",
    "all_intents": """WITH a AS (SELECT o_orderkey % 11 AS k FROM orders)
SELECT list_extract(['BL_COMPARISON', 'BL_COMPARISON', 'BL_COMPARISON', 'SI_REQUEST', 'INVOICE_QUERY', 'GENERAL', 'GENERAL', 'GENERAL', 'GENERAL', 'GENERAL', 'SPAM'], k + 1) AS category,
list_extract(['resend_documents', 'chase_draft_bl', 'check_draft_bl', 'submit_si', 'dd_charges', 'system_notice', 'schedule_update', 'outstanding_reminder', 'office_notice', 'none', 'none'], k + 1) AS intent, count(*) AS n FROM a GROUP BY 1, 2""",
}
