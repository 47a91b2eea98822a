"""Mixing sources to target weights by Poisson replication.

A source's target weight and its size give the mean number of copies of each
of its documents. The number for one document inverts the Poisson distribution
at a uniform value hashed from seed and doc_id: the same on every run, whatever
the partitions. Documents are exploded by their counts and put in one global
order by the hash of seed, doc_id and copy: one exchange, since the hash is
uniform and its ranges are known beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.shared import small, width, written
from quaystone.session import table

SEED = "mix-1"
#: Without given weights a source weighs its bytes to this power.
TEMPER = 0.7
KEY_BITS = 60
#: Bytes of a partition of the mixture; bytes of a row without its text.
PART_BYTES = 128 << 20
ROW_BYTES = 64


def _counts(rate: float, u: np.ndarray) -> np.ndarray:
    """The Poisson distribution of this mean inverted at u: how many of its
    cumulative probabilities are at most u. Values so far from the mean that
    they hold no probability are left out, so the work follows the root of the
    mean."""
    if not rate > 0:
        return np.zeros(len(u), np.int64)
    reach = 12 * math.sqrt(rate) + 24
    first = max(0, math.floor(rate - reach))
    k = np.arange(first, math.ceil(rate + reach) + 1)
    factorial = math.lgamma(first + 1) + np.append(0.0, np.cumsum(np.log(k[1:])))
    return first + np.searchsorted(np.cumsum(np.exp(k * np.log(rate) - rate - factorial)), u, "right")


@F.pandas_udf(T.LongType())
def _drawn(rate: pd.Series, u: pd.Series) -> pd.Series:
    values, which = np.unique(rate.to_numpy(), return_inverse=True)
    out = np.zeros(len(u), np.int64)
    for i, x in enumerate(values):
        rows = which.ravel() == i
        out[rows] = _counts(float(x), u.to_numpy()[rows])
    return pd.Series(out)


def _hex_long(digits: int, *parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """_src, rate, bytes, rows: mean copies of a source's documents, so that
    sources take shares of epochs times all bytes in proportion to their
    weights, and what the source has. A source that weights leaves out has
    weight 0."""
    by = docs.groupBy(F.coalesce("source", F.lit("")).alias("_src")).agg(F.sum((F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("double")).alias("bytes"), F.count("*").alias("rows"))
    by = written(by, "sources")
    if weights is None:
        weighed = by.withColumn("w", F.pow("bytes", F.lit(TEMPER)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_src string, w double")
        weighed = by.join(given, "_src", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = weighed.agg(F.sum("bytes"), F.sum("w")).first()
    all_bytes, all_w = total[0] or 0.0, total[1] or 0.0
    rate = F.col("w") / all_w * (all_bytes * epochs) / F.col("bytes") if all_w else F.lit(0.0)
    return weighed.select("_src", rate.alias("rate"), "bytes", "rows")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """docs, each row as often as drawn, with _rate, _copies, _copy (from 1)
    and _key, the place in the global order; not yet ordered.

    A null source is a source of its own; a null text counts one byte; a text
    of any length is one record; a null doc_id draws by the hash of its text.
    Repeated rows draw the same count; an empty table gives an empty result.
    Columns of docs with these names are dropped.
    """
    return _replicated(docs, rates(docs, weights, epochs))


def _replicated(docs: DataFrame, found: DataFrame) -> DataFrame:
    docs = docs.drop("_src", "_rate", "_copies", "_copy", "_key", "_who")
    found = small(found.select("_src", F.col("rate").alias("_rate")))
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    drawn = docs.withColumns({"_src": F.coalesce("source", F.lit("")), "_who": who}).join(found, "_src").drop("_src")
    uniform = _hex_long(13, F.col("_who")).cast("double") / float(1 << 52)
    drawn = drawn.withColumn("_copies", _drawn("_rate", uniform)).where("_copies > 0")
    drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return drawn.withColumn("_key", _hex_long(KEY_BITS // 4, F.col("_who"), F.col("_copy").cast("string"))).drop("_who")


def in_order(drawn: DataFrame, size: float = 0) -> DataFrame:
    """drawn in the order of _key, which is uniform: partition i holds the i-th
    equal range of keys, so no sample has to be drawn first. size: the bytes
    that are expected, which decide how many partitions there are."""
    n = width(drawn.sparkSession, math.ceil(size), PART_BYTES)
    at = F.shiftright(F.shiftright("_key", KEY_BITS - 30) * F.lit(n), 30).cast("int")
    return drawn.repartitionById(n, at).sortWithinPartitions("_key", "doc_id", "_copy")


def _expected(found: DataFrame, each: str) -> float:
    """How many of each, bytes or rows, the rates lead to expect."""
    return found.agg(F.sum(F.col("rate") * F.col(each))).first()[0] or 0.0


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """The mixture in its global order, with the columns of docs, whatever
    their names. Rows of equal key, which are copies of one id, or of one text
    without id, are ordered by id and copy; what is equal in those too is in
    any order. replicate states the other cases."""
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("_doc"))
    found = written(rates(whole, weights, epochs), "rates")
    drawn = _replicated(whole, found).select("_doc", "_key", "doc_id", "_copy")
    return in_order(drawn, _expected(found, "bytes")).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the documents' mixture, without the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = written(rates(docs), "rates")
    drawn = _replicated(docs, found).drop("text")
    return in_order(drawn, _expected(found, "rows") * ROW_BYTES).select(
        "doc_id", "source", F.col("_copies").alias("n_copies"), F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"), F.round("_rate", 6).alias("rate")
    )


ORACLE = f"""
WITH s AS (SELECT coalesce(source, '') AS src, sum((strlen(coalesce(text, '')) + 1)::DOUBLE) AS bytes FROM documents GROUP BY 1),
t AS (SELECT sum(bytes) AS b, sum(pow(bytes, {TEMPER})) AS w FROM s),
r AS (SELECT src, pow(bytes, {TEMPER}) / w * b / bytes AS rate FROM s, t),
f AS (SELECT k, coalesce(sum(ln(k)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS lf FROM (SELECT unnest(range(1, 2000)) AS k) UNION ALL SELECT 0, 0),
c AS (SELECT src, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY src ORDER BY k) AS cdf FROM r, f WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)),
l AS (SELECT src, list(cdf) AS cdfs FROM c GROUP BY src),
d AS (SELECT doc_id, source, coalesce(source, '') AS src, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents),
n AS (SELECT doc_id, source, rate, len(list_filter(cdfs, lambda x: x <= u))::BIGINT AS n_copies FROM d JOIN r USING (src) JOIN l USING (src)),
x AS (SELECT *, unnest(range(1, n_copies + 1))::BIGINT AS copy FROM n)
SELECT doc_id, source, n_copies, copy, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key, round(rate, 6) AS rate FROM x"""
