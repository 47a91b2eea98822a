"""Reviews, corrections, replies and reports as tables: who sees which rows,
upserts, merges, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.operators.buckets import Buckets

NEWEST = 200


def is_admin(admins: DataFrame, email: str | None) -> bool:
    """Whether an address, in any case, is an administrator's."""
    return admins.where(F.lower("email") == (email or "").lower()).limit(1).count() > 0


def visible(rows: DataFrame, user_id: str, admin: bool, owner: str = "user_id") -> DataFrame:
    """The rows that a person sees: their own, an administrator all. Rows
    without an owner are an administrator's alone."""
    return rows if admin else rows.where(F.col(owner) == user_id)


def visible_through(rows: DataFrame, reviews: DataFrame, user_id: str, admin: bool) -> DataFrame:
    """Corrections or replies (review_id) whose review a person sees."""
    return rows.join(visible(reviews, user_id, admin).select(F.col("id").alias("review_id")), "review_id", "left_semi")


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], at: str) -> DataFrame:
    """stored with fresh rows in place of those of the same keys; of several
    fresh rows of a key the latest by at, of equally late ones the greatest.
    buckets.Buckets does the same to a table on disk."""
    others = [c for c in fresh.columns if c not in keys]
    order = F.struct(at, *[c for c in others if c != at])
    last = fresh.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*stored.columns))


def filed_reports(fresh: DataFrame) -> DataFrame:
    """Rows for the table of reports from what people sent (user_id, kind,
    about: a message or null, msg, rating, at): a title that names the message,
    as the queue lists titles. Without a person there is no report."""
    kind = F.coalesce("kind", F.lit("note"))
    title = F.when(F.coalesce(F.trim("about"), F.lit("")) == "", kind).otherwise(F.concat(kind, F.lit(" on "), F.col("about")))
    return fresh.where("user_id is not null").select("user_id", F.lit("human").alias("kind"), F.col("about").alias("email_ref"), title.alias("title"), F.coalesce("msg", F.lit("")).alias("detail"), "rating", F.col("at").alias("created_at"))


def _rows_of(fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, reviews and corrections of fresh corrections. A correction does
    not finish a message, so its review has no mark of its own; one without a
    title is not reported."""
    told = fresh.where("title is not null").select("user_id", F.lit("human").alias("kind"), "email_ref", "title", F.col("at").alias("created_at"))
    marks = fresh.select("user_id", "email_ref", "source", "mark", F.col("at").alias("updated_at"))
    said = fresh.select("user_id", "email_ref", "field", "was", "corrected", "kind", "side", F.col("at").alias("created_at"))
    return told, marks, said


def with_corrected(reviews: DataFrame, reports: DataFrame, corrections: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after fresh corrections (user_id, email_ref, source,
    mark, field, was, corrected, kind, side, title, at): a report and a
    correction each, and their reviews upserted."""
    told, marks, said = _rows_of(fresh)
    return upserted(reviews, marks, ["user_id", "email_ref"], "updated_at"), reports.unionByName(told), corrections.unionByName(said)


def record_corrections(reviews: Buckets, reports: str, corrections: str, fresh: DataFrame) -> None:
    """with_corrected on disk: the reports first, so that they are there
    whatever fails after them, then the reviews, then the corrections; reports
    and corrections are folders that are appended to."""
    told, marks, said = _rows_of(fresh)
    told.write.mode("append").parquet(reports)
    reviews.upsert(marks, "updated_at")
    said.write.mode("append").parquet(corrections)


def with_replies(reviews: DataFrame, replies: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables after fresh replies (user_id, email_ref, source, mark,
    to_address, subject, body, at): one that answers a sample is not sent."""
    marks = fresh.select("user_id", "email_ref", "source", "mark", F.col("at").alias("updated_at"))
    sent = F.when(F.col("source") != "demo", F.col("at"))
    said = fresh.select("user_id", "email_ref", "to_address", "subject", "body", sent.alias("sent_at"))
    return upserted(reviews, marks, ["user_id", "email_ref"], "updated_at"), replies.unionByName(said)


def merged_marks(local: DataFrame, remote: DataFrame) -> DataFrame:
    """email_ref, mark of both sides; the local one wins, a remote row without
    a mark adds nothing."""
    held = remote.where("mark is not null").select("email_ref", F.col("mark").alias("_remote"))
    return local.join(held, "email_ref", "full").select("email_ref", F.coalesce("mark", "_remote").alias("mark"))


def emails_synced(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """users (id, email) with the address of the account (id, email) they sign
    in with, where it differs in more than case."""
    new = accounts.select("id", F.lower("email").alias("_new"))
    held = users.join(new, "id", "left")
    differs = F.col("_new").isNotNull() & ~F.lower("email").eqNullSafe(F.col("_new"))
    return held.withColumn("email", F.when(differs, F.col("_new")).otherwise(F.col("email"))).drop("_new")


def newest_reports(reports: DataFrame, users: DataFrame, n: int = NEWEST) -> DataFrame:
    """The newest n reports with their authors' names: a top-k report."""
    newest = reports.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.join(users.select(F.col("id").alias("user_id"), "display_name"), "user_id", "left")


def most_tried(reports: DataFrame, n: int = NEWEST) -> DataFrame:
    """The n automatic reports (step_id, tries) with the most tries, ties by
    step: a top-k report."""
    return reports.orderBy(F.desc("tries"), "step_id").limit(n)


def in_folder(results: DataFrame, status: str | None = None, mark: str | None = None, category: str | None = None, search: str | None = None) -> DataFrame:
    """The results (status, mark, category, subject, title, from) of a folder
    that match a search in subject, title or sender, in any case."""
    for column, value in (("status", status), ("mark", mark), ("category", category)):
        results = results if value is None else results.where(F.col(column) == value)
    if search and search.strip():
        results = results.where(F.lower(F.concat_ws(" ", "subject", "title", "from")).contains(search.strip().lower()))
    return results


def n_issues(rows: Column) -> Column:
    """How many of a result's field rows do not match; none without rows."""
    return F.coalesce(F.size(F.filter(rows, lambda r: r["verdict"] != "match")), F.lit(0))


#: Orders of a folder by name, each with the saved place last.
ORDERS = {"worst": ("issues", True), "least": ("issues", False), "new": ("email_id", True), "old": ("email_id", False)}


def ordered(results: DataFrame, by: str) -> DataFrame:
    """results (email_id, issues, place) in one of ORDERS, stable in place."""
    column, down = ORDERS[by]
    return results.orderBy(F.desc(column) if down else F.asc(column), "place")


def steps_reported(attempts: DataFrame, steps: DataFrame) -> DataFrame:
    """One report a step that struggled: it has a note, more than one attempt,
    or its last attempt was not answered. attempts: step_id, ordinal, model,
    result, seconds; steps: step_id, name, email_id, if_no_answer, note_title,
    note_outcome. Most tries first is the caller's order by tries."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "model", F.substring("result", 1, 300).alias("result"), F.round("seconds", 1).alias("seconds"))))
    held = steps.join(attempts.groupBy("step_id").agg(listed.alias("a")), "step_id", "left").withColumn("a", F.coalesce("a", F.array().cast("array<struct<ordinal:int,model:string,result:string,seconds:double>>")))
    last = F.try_element_at("a", F.lit(-1))
    noted, answered = F.col("note_title").isNotNull(), last["result"] == "answered"
    struggled = noted | (F.size("a") > 1) | F.coalesce(~answered, F.lit(False))
    tries = F.size("a")
    title = (
        F.when(noted, F.col("note_title"))
        .when(answered, F.concat(F.lit("answered on try "), tries.cast("string"), F.lit(" by "), last["model"]))
        .otherwise(F.concat(F.lit("no answer after "), tries.cast("string"), F.when(tries == 1, " try").otherwise(" tries")))
    )
    outcome = F.when(noted, F.col("note_outcome")).when(answered, F.concat(F.lit("answered by "), last["model"])).otherwise(F.col("if_no_answer"))
    lines = F.array_join(F.transform("a", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["model"], F.lit(": "), x["result"], F.lit(" ("), F.format_string("%.1f", x["seconds"]), F.lit(" s)"))), "\n")
    return held.where(struggled).select("step_id", F.col("email_id").alias("email_ref"), F.concat(F.col("name"), F.lit(": "), title).alias("title"), F.concat_ws("\n\n", outcome, lines).alias("detail"), tries.cast("long").alias("tries"), noted.alias("own_email_only"))


def pipeline_summary(results: DataFrame) -> DataFrame:
    """One row of counts over results (status null where not routed, awaiting,
    n_attachments, defect_fields): requests that await a draft are no checks."""
    routed = F.col("status").isNotNull()
    awaits = F.coalesce("awaiting", F.lit(False))
    checked = routed & ~awaits
    of = lambda s: checked & (F.col("status") == s)
    counts = {
        "emails": F.lit(True), "with_attachments": F.col("n_attachments") > 0, "routed": routed, "awaiting": routed & awaits, "comparisons": checked,
        "cleared": of("OK"), "mismatched": of("MISMATCH"), "reviewed": of("NEEDS_REVIEW"),
    }
    out = results.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.coalesce(F.sum(F.when(of("MISMATCH"), F.size("defect_fields"))), F.lit(0)).cast("long").alias("field_differences"))
    return out.withColumn("cleared_share", F.coalesce(F.try_divide("cleared", "comparisons"), F.lit(0.0)))


def figures_of(summary: DataFrame, section: str, names: dict[str, str]) -> DataFrame:
    """section, place, name, value: a row a figure of a summary of one row, in
    the order of names (column to what it is called). Shares between 0 and 1 of
    columns that end in _share are percentages; what is null is n/a."""
    shown = lambda c: F.format_string("%.1f%%", 100 * F.col(c)) if c.endswith("_share") else F.col(c).cast("string")
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(i).alias("place"), F.lit(n).alias("name"), F.coalesce(shown(c), F.lit("n/a")).alias("value")) for i, (c, n) in enumerate(names.items())])
    return summary.select(F.inline(rows))


def report_lines(figures: DataFrame) -> DataFrame:
    """Figures as lines of a Markdown report (section, place, line): a heading
    and a table a section, sections by name."""
    head = figures.select("section").distinct().select("section", F.inline(F.array(*[F.struct(F.lit(i - 3).alias("place"), line.alias("line")) for i, line in enumerate((F.concat(F.lit("## "), "section"), F.lit("| figure | value |"), F.lit("|---|---|")))])))
    mark = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("/"))
    return head.unionByName(figures.select("section", "place", F.concat(F.lit("| "), mark("name"), F.lit(" | "), mark("value"), F.lit(" |")).alias("line")))


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report, in order, as one text file in the folder path: a
    report is as long as its figures, so one task writes it."""
    lines.coalesce(1).sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def waiting_summary(results: DataFrame) -> DataFrame:
    """One row: requests that await a draft, those with a reference, their
    senders, and the distinct references of all results (awaiting, ref, from)."""
    awaits = F.coalesce("awaiting", F.lit(False))
    return results.agg(F.count_if(awaits).alias("waiting"), F.count_if(awaits & F.col("ref").isNotNull()).alias("with_reference"), F.count_distinct(F.when(awaits, F.col("from"))).alias("senders"), F.count_distinct("ref").alias("distinct_references"))


def impact(cleared: DataFrame, minutes: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """minutes, hours: what a person is spared when so many checks (column
    cleared, one row) need nobody."""
    each = F.explode(F.array(*map(F.lit, minutes)))
    return cleared.select("cleared", each.alias("minutes")).select("minutes", F.bround(F.col("cleared") * F.col("minutes") / 60, 1).alias("hours"))


def timed_scores(answers: DataFrame, key: DataFrame) -> DataFrame:
    """One row: checks, mean, median, least and most seconds, right verdicts,
    and right verdicts with exactly the fields. answers: pair, seconds
    (text), verdict, fields_that_differ (parted by semicolons); key: pair,
    status, defect_fields."""
    seconds = F.trim("seconds").try_cast("double")
    both = answers.join(key, "pair").withColumn("s", seconds).where("s is not null")
    right = F.upper(F.trim("verdict")) == F.col("status")
    theirs = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("fields_that_differ", F.lit("")), ";"), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    exact = F.array_sort(theirs) == F.array_sort("defect_fields")
    return both.agg(F.count("*").alias("checks"), F.avg("s").alias("mean"), F.median("s").alias("median"), F.min("s").alias("least"), F.max("s").alias("most"), F.count_if(right).alias("verdicts"), F.count_if(right & exact).alias("exact"))


