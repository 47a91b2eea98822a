"""Quality rules with host-level verdicts, in DataFrame functions alone.

Each document is measured once, over its whole text. Failures are counted by
host and rule, the hosts' rates are shrunk towards a beta prior fitted to all
hosts by the method of moments, and a host's verdict is joined back to its
documents. The measurements, a narrow table, are written once and read for
both steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import small, written
from quaystone.session import table

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
#: A host fails once the shrunk share of its documents that fail one rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1e6
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
}


def _covered(found: Column) -> Column:
    """Words in the windows that start at the sorted positions found."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        found,
        start,
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words of every whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("host"), text.alias("text")).withColumn("words", F.filter(F.split("text", GAP), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    a = words.select(
        "doc_id",
        "host",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(WINDOW)]))
    b = a.withColumn("win", F.when(F.col("n") >= WINDOW, window))
    c = b.withColumn(
        "twice",
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, i: (x["h"] == F.get(F.col("twice"), i - 1)["h"]) | (x["h"] == F.get(F.col("twice"), i + 1)["h"])
    at = F.sort_array(F.transform(F.filter("twice", lambda x, i: F.coalesce(same(x, i), F.coalesce(x["h"] == F.get(F.col("twice"), i + 1)["h"], x["h"] == F.get(F.col("twice"), i - 1)["h"]), F.lit(False))), lambda x: x["i"]))
    return c.select(
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice").isNull(), F.lit(0)).otherwise(_covered(at)).cast("long").alias("n_repeat_words"),
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, and each rule's shrunk failure rate rate_<rule>."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(k) for k, rule in RULES.items()])
    hosts = written(hosts, "hosts")
    moments = [F.sum("n").alias("docs"), F.count("*").alias("hosts")]
    for k in RULES:
        moments += [F.sum(k).alias(f"f_{k}"), F.sum(F.col(k) * F.col(k) / F.col("n")).alias(f"q_{k}")]
    m = hosts.agg(*moments).first()
    rate = {}
    for k in RULES:
        mean = m[f"f_{k}"] / m["docs"] if m["docs"] else 0.0
        spread = m[f"q_{k}"] / m["docs"] - mean * mean if m["docs"] else 0.0
        chance = mean * (1 - mean) * m["hosts"] / m["docs"] if m["docs"] else 0.0
        weight = (mean * (1 - mean) - spread) / (spread - chance) if spread > chance else MOST_PRIOR
        weight = min(MOST_PRIOR, max(LEAST_PRIOR, weight))
        rate[f"rate_{k}"] = (F.col(k) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", *[v.alias(k) for k, v in rate.items()])


def judge(docs: DataFrame) -> DataFrame:
    """One row a row of docs: its measurements, base_failed and kept.

    A null text counts as empty and fails; a text of any length is measured
    whole; a null source is a host of its own; a null doc_id is carried along;
    repeated rows are judged each; an empty table gives an empty result; other
    columns of docs are ignored. A host whose shrunken rate equals the limit
    keeps its documents.
    """
    measured = written(measure(docs), "measured")
    verdict = small(host_rates(measured).select("host", F.greatest(*[f"rate_{k}" for k in RULES]).alias("worst")))
    failed = F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")
    return (
        measured.join(verdict, "host", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("worst") <= HOST_LIMIT))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents; a document's host is its source."""
    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rates, priors, moments = [], [], []
    for k, rule in RULES.items():
        moments.append(f"sum({k}) AS f_{k}, sum({k}::DOUBLE * {k} / n) / sum(n) - (sum({k})::DOUBLE / sum(n)) * (sum({k})::DOUBLE / sum(n)) AS s_{k}")
        mean = f"(f_{k}::DOUBLE / docs)"
        chance = f"{mean} * (1 - {mean}) * hosts / docs"
        priors.append(
            f"{mean} AS m_{k}, CASE WHEN s_{k} > {chance} THEN least({MOST_PRIOR}, greatest({LEAST_PRIOR}, ({mean} * (1 - {mean}) - s_{k}) / (s_{k} - {chance}))) ELSE {MOST_PRIOR} END AS w_{k}"
        )
        rates.append(f"({k} + m_{k} * w_{k}) / (n + w_{k})")
    counts = ", ".join(f"count(*) FILTER (WHERE {rule}) AS {k}" for k, rule in RULES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS t FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win) WHERE c > 1),
cover AS (SELECT rid, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT w.rid, doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN cover USING (rid)),
h AS (SELECT host, count(*) AS n, {counts} FROM m GROUP BY host),
mo AS (SELECT sum(n) AS docs, count(*) AS hosts, {", ".join(moments)} FROM h),
pr AS (SELECT {", ".join(priors)} FROM mo),
v AS (SELECT host, greatest({", ".join(rates)}) AS worst FROM h, pr),
f AS (SELECT m.*, ({RULES["few_words"]}) OR ({RULES["repeats"]}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND worst <= {HOST_LIMIT} AS kept
FROM f JOIN v USING (host)"""


ORACLE = _oracle()
