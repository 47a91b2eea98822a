"""Queries on batches, tables on disk, contracts of maps, chunks and tallies
with their offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions import chunking, fields
from quaystone.operators import batch, buckets, contracts, extraction, ledger
from quaystone.plans import records
from quaystone.session import shared_folder, small_batches, table


def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for its length, in three runs over one batch: the
    first model fails on lengths that 2 divides and says nothing on those that
    3 divides, the second fails on the former only, the third never. By which
    run each was answered, and how."""
    at = shared_folder(spark, "batch")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def model(fails_by: int | None, silent_by: int | None):
        def answer(text: str) -> str | None:
            if fails_by and len(text) % fails_by == 0:
                raise ValueError("even")
            return None if silent_by and len(text) % silent_by == 0 else str(len(text))

        return answer

    for of in (model(2, 3), model(2, None), model(None, None)):
        batch.run(docs, "doc_id", "text", of, at)
    return batch.answers(spark, at, "doc_id", "bigint").select("doc_id", F.col("answer").cast("long").alias("answer"), "run")


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of two runs whose model fails on every third length, and of
    the documents that are left."""
    at = shared_folder(spark, "batch")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def model(text: str) -> str:
        if len(text) % 3 == 0:
            raise ValueError("by three")
        return "ok"

    batch.run(docs, "doc_id", "text", model, at)
    batch.run(docs, "doc_id", "text", model, at)
    left = batch.failures(spark, at, "doc_id", "bigint").groupBy("error", "tries").agg(F.count("*").alias("failed"))
    told = batch.runs(spark, at).select(F.concat(F.lit("run "), F.col("run").cast("string")).alias("what"), "done", "skipped", "failed")
    return told.unionByName(left.select(F.concat("error", F.lit(", tries "), F.col("tries").cast("string")).alias("what"), "failed"), allowMissingColumns=True)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in chunks of 1000 characters with 200 of overlap."""
    small_batches(spark)
    cut = table(spark, sf_dir, "documents").select("doc_id", chunking.chunks(F.col("text")).alias("c"))
    return cut.select("doc_id", F.posexplode("c").alias("chunk_index", "content")).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


MEASURES = {
    "required": ["price", "size_0"],
    "properties": {"price": {"type": "number", "maximum": 1500}},
    "patternProperties": {"size_": {"type": "number", "maximum": 30}},
    "additionalProperties": False,
}


def map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as maps of measures, against a contract by names and patterns."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("size_"), (F.col("p_size") % 3).cast("string"))
    measures = F.map_from_arrays(F.array(name, F.lit("price"), F.col("p_brand")), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), F.lit(1.0)))
    return contracts.broken_rules(p.select(measures.alias("measures")), {"properties": {"measures": MEASURES}})


def missed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container counts as the rules read them, against what was written; every
    53rd order is written wrong. Trials, hits and the first misses by status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 9 + 1).alias("boxes"))
    written = F.concat((F.col("boxes") + F.when(F.col("o_orderkey") % 53 == 0, 1).otherwise(0)).cast("string"), F.lit(" x 40'HC"))
    read = o.select("o_orderkey", "o_orderstatus", "boxes", fields.container_total(written).alias("read"))
    found = batch.offenders(read, ["o_orderstatus"], F.col("read") == F.col("boxes").cast("string"), "o_orderkey")
    return found.withColumn("missed", F.array_join(F.transform("missed", lambda k: k.cast("string")), ","))


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as readings of scans of their orders, odd ones of the SI."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    name = F.concat(F.lit("email_"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 1, "_SI").otherwise("_BL"))
    untrusted = F.array_repeat(F.col("l_returnflag"), (F.col("l_orderkey") % 4).cast("int"))
    return extraction.scans(line.select(name.alias("name"), untrusted.alias("untrusted")))


def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, upserted into a table on disk in three rounds: each
    round reads and rewrites the buckets of its own customers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("email_ref"), F.col("o_orderstatus").alias("mark"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    kept = buckets.Buckets(spark, shared_folder(spark, "reviews"), "user_id bigint, email_ref string, mark string, updated_at date, o_orderkey bigint", ["user_id", "email_ref"], 32)
    for n in range(3):
        kept.upsert(o.where(F.col("o_orderkey") % 3 == n).withColumn("updated_at", F.col("updated_at").cast("date")), "updated_at")
    return kept.read().select("user_id", "email_ref", "mark", "o_orderkey")


def stored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all sources stored by source, then the sources with an even
    number anew without every third text: stale rows go with their bucket."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.sha2("text", 256).alias("content_hash"))
    kept = buckets.Buckets(spark, shared_folder(spark, "sources"), "source string, doc_id bigint, content_hash string", ["source"], 16)
    kept.replace(d)
    kept.replace(d.where("source rlike '[02468]$' and doc_id % 3 <> 0"))
    return kept.read().groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("n_texts"), F.max("doc_id").alias("last_id"))


def most_tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 technical reports with the most tries: a top-k report."""
    return ledger.most_tried(records.technical_reports(spark, sf_dir), 20).select("step_id", "tries")


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label and repeat a text of another one."""
    d = table(spark, sf_dir, "documents")
    repeated = d.join(d.groupBy("text").agg(F.count("*").alias("n")).where("n > 1").select("text"), "text", "left_semi")
    return batch.shared_keys(table(spark, sf_dir, "labels"), repeated, "doc_id")


def evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report on orders as checks: how many there are, how many
    are closed, and how many documents have a label."""
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    checks = ledger.figures_of(o.withColumn("closed_share", F.try_divide("closed", "orders")), "Checks", {"orders": "orders checked", "closed": "closed", "closed_share": "share closed"})
    labels = table(spark, sf_dir, "labels").agg(F.count("*").alias("labels"), F.max(F.lit(None).cast("long")).alias("missing"))
    return ledger.report_lines(checks.unionByName(ledger.figures_of(labels, "Labels", {"labels": "labels", "missing": "left | right"})))


QUERIES = {
    f.__name__: f
    for f in (batch_runs, batch_outcomes, document_chunks, map_errors, missed_counts, scan_totals, stored_reviews, stored_sources, most_tried, shared_ids, evidence_report)
}

ORACLES = {
    "batch_runs": "SELECT doc_id, length(text)::BIGINT AS answer, CASE WHEN length(text) % 2 = 0 THEN 3 WHEN length(text) % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS run FROM documents WHERE text IS NOT NULL",
    "batch_outcomes": """WITH d AS (SELECT count(*) FILTER (text IS NOT NULL AND length(text) % 3 <> 0) AS good, count(*) FILTER (length(text) % 3 = 0) AS bad, count(*) FILTER (text IS NULL) AS none FROM documents)
SELECT 'run 1' AS what, good AS done, 0::BIGINT AS skipped, bad + none AS failed FROM d UNION ALL SELECT 'run 2', 0, good, bad + none FROM d
UNION ALL SELECT 'ValueError: by three, tries 2', NULL, NULL, bad FROM d WHERE bad > 0 UNION ALL SELECT 'no prompt, tries 2', NULL, NULL, none FROM d WHERE none > 0""",
    "map_errors": """WITH x AS (SELECT '$.measures: lacks size_0' AS error FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT '$.measures.price: is above 1500' FROM part WHERE p_retailprice > 1500
UNION ALL SELECT '$.measures.size_' || p_size % 3 || ': is above 30' FROM part WHERE p_size > 30 UNION ALL SELECT '$.measures: has unknown ' || p_brand FROM part) SELECT error, count(*) AS n FROM x GROUP BY 1""",
    "missed_counts": """WITH m AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 53 = 0),
l AS (SELECT o_orderstatus, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS missed FROM m WHERE n <= 20 GROUP BY 1)
SELECT o_orderstatus, count(*) AS trials, count(*) FILTER (o_orderkey % 53 <> 0) AS held, coalesce(any_value(missed), '') AS missed FROM orders LEFT JOIN l USING (o_orderstatus) GROUP BY 1""",
    "scan_totals": """WITH l AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS si, bool_or(l_linenumber = 2) AS bl FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT 'email_' || l_orderkey AS email_id, CASE WHEN si AND bl THEN 'BL+SI' WHEN si THEN 'SI' ELSE 'BL' END AS roles, (l_orderkey % 4 * (si::INT + bl::INT))::BIGINT AS flagged FROM l""",
    "stored_reviews": """SELECT user_id, email_ref, mark, o_orderkey FROM (SELECT o_custkey AS user_id, o_orderpriority AS email_ref, o_orderstatus AS mark, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey % 3 DESC, o_orderdate DESC, o_orderstatus DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
    "stored_sources": """SELECT coalesce(source, '') AS source, count(*) AS n, count(DISTINCT text) AS n_texts, max(doc_id) AS last_id FROM documents
WHERE text IS NOT NULL AND NOT (coalesce(regexp_matches(source, '[02468]$'), false) AND doc_id % 3 = 0) GROUP BY 1""",
    "most_tried": """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS n, o_orderkey % 10 = 0 AS noted, o_orderkey % 4 <> 0 AS answered FROM orders)
SELECT k AS step_id, n AS tries FROM s WHERE noted OR n > 1 OR NOT answered ORDER BY n DESC, k LIMIT 20""",
    "shared_ids": "SELECT DISTINCT doc_id FROM documents JOIN labels USING (doc_id) WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "evidence_report": """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders), l AS (SELECT count(*) AS n FROM labels),
h AS (SELECT unnest(['Checks', 'Labels']) AS section)
SELECT section, -3 AS place, '## ' || section AS line FROM h UNION ALL SELECT section, -2, '| figure | value |' FROM h UNION ALL SELECT section, -1, '|---|---|' FROM h
UNION ALL SELECT 'Checks', 0, '| orders checked | ' || n || ' |' FROM o UNION ALL SELECT 'Checks', 1, '| closed | ' || f || ' |' FROM o
UNION ALL SELECT 'Checks', 2, '| share closed | ' || format('{:.1f}%', 100.0 * f / n) || ' |' FROM o
UNION ALL SELECT 'Labels', 0, '| labels | ' || n || ' |' FROM l UNION ALL SELECT 'Labels', 1, '| left / right | n/a |' FROM l""",
}
