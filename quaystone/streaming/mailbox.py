"""A mailbox as a stream of messages, each checked once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators import messages
from quaystone.session import stored
from quaystone.sources import folder, readers
from quaystone.streaming import run, state

LISTED = readers.EMAIL_SCHEMA + ", at timestamp"
#: Listing files of a micro-batch.
FILES_A_BATCH = 200


def watch(
    spark: SparkSession, listing: str, files: str, out: str, once: bool = True, answers: DataFrame | None = None, formats: dict[str, readers.Reader] | None = None,
) -> None:
    """Every message that the folder listing shows (JSON, with at, when it
    came) through process_emails once, however often it is listed; results are
    appended to out. files: the folder that messages' attachments are named
    from; a batch opens those that its own messages name. What was handled is
    kept in out, so a later call takes up what has come since."""
    stream = spark.readStream.schema(LISTED).option("multiLine", True).option("maxFilesPerTrigger", FILES_A_BATCH).json(listing)
    fresh = state.once(stream, "email_id", "at")

    def handle(batch: DataFrame, n: int) -> None:
        batch = stored(batch, "listed")
        found = messages.process_emails(batch, folder.named(files), answers, formats)
        listed = batch.groupBy("email_id").agg(F.max("at").alias("at"))
        found.join(listed, "email_id").write.mode("overwrite").parquet(f"{out}/batch={n}")

    run.each_batch(fresh, handle, once, f"{out}/_checkpoint")


def listed(spark: SparkSession, listing: str) -> DataFrame:
    """What the listing shows now, one row a message: email_id, at."""
    found = spark.read.schema(LISTED).option("multiLine", True).json(listing)
    return found.where("email_id is not null").groupBy("email_id").agg(F.max("at").alias("at"))


def finished(shown: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """The results (done) of the messages that are shown (email_id, at), in
    list order: the newest first, ties by id; at most so many, if given."""
    at = shown.select("email_id", F.col("at").alias("_at"))
    out = done.join(at, "email_id").orderBy(F.desc_nulls_last("_at"), "email_id").drop("_at")
    return out.limit(most) if most else out


def pending(shown: DataFrame, done: DataFrame) -> DataFrame:
    """One row: how many messages that are shown are not done yet."""
    return shown.select("email_id").distinct().join(done.select("email_id"), "email_id", "left_anti").agg(F.count("*").alias("pending"))
