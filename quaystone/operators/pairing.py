"""Attachments to documents: roles, shipments, revisions, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import documents

_ROLE = r"_(SI|BL)(?=[._\s(-])"


def with_role(files: DataFrame) -> DataFrame:
    """files (email_id, path, pos) with role and key, the name without role."""
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    role = F.nullif(F.regexp_extract(name, _ROLE, 1), F.lit(""))
    key = F.regexp_replace(F.concat(stem, F.lit(".")), r"^(.*?)_(?:SI|BL)(?=[._\s(-])", "$1")
    return files.withColumns({"role": role, "key": F.regexp_replace(key, r"\.$", "")})


def roles_of(path: Column) -> Column:
    """Every role that a file's name tells, or that the path ends with."""
    told = F.regexp_extract_all(F.substring_index(path, "/", -1), F.lit(_ROLE), 1)
    return F.array_distinct(F.concat(told, F.filter(F.array(F.lit("SI"), F.lit("BL")), lambda r: F.upper(path).endswith(r))))


def shipments(files: DataFrame) -> DataFrame:
    """One row a shipment: the first SI and BL whose names agree but for the
    role; either may be absent."""
    at = lambda role: F.min_by(F.when(F.col("role") == role, F.col("path")), F.when(F.col("role") == role, F.col("pos")))
    return with_role(files).where("role is not null").groupBy("email_id", "key").agg(at("SI").alias("si_path"), at("BL").alias("bl_path"))


def latest_revisions(files: DataFrame) -> DataFrame:
    """files (email_id, role, path, title, pos), best first: order 1 is the
    file to compare, order 2 the draft before it."""
    rank = documents.revision_rank(F.col("path"), F.col("title"))
    ranked = files.withColumn("_rank", rank)
    w = Window.partitionBy("email_id", "role").orderBy(F.desc("_rank.marked"), F.desc("_rank.number"), F.desc("pos"))
    return ranked.withColumn("order", F.row_number().over(w)).drop("_rank")


def close_requests(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests (domain, ref, at) each with the earliest later answer of the
    same domain and reference, or null. An as-of join by one sort: both sides
    are dealt by key once, and the next answer is read off a window."""
    tag = lambda df, is_answer: df.select("domain", "ref", "at", F.lit(is_answer).alias("is_answer"))
    w = Window.partitionBy("domain", "ref").orderBy("at", F.desc("is_answer")).rowsBetween(1, Window.unboundedFollowing)
    # of equal times the answer sorts first, so an answer closes earlier requests only
    nearest = F.first(F.when(F.col("is_answer"), F.col("at")), ignorenulls=True).over(w)
    return tag(requests, False).unionByName(tag(answers, True)).withColumn("closed_at", nearest).where("not is_answer").drop("is_answer")


def chase_list(requests: DataFrame, answers: DataFrame, now) -> DataFrame:
    """Open requests by domain and reference, oldest first, with age in days."""
    held = close_requests(requests, answers).where("closed_at is null")
    return held.groupBy("domain", F.coalesce("ref", F.lit("no reference")).alias("ref")).agg(F.count("*").alias("n_requests"), F.min("at").alias("first_at")).withColumn("age_days", F.datediff(F.to_date(F.lit(now)), F.to_date("first_at")).cast("long")).orderBy("first_at", "domain", "ref")
