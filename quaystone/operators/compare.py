"""Comparison of two documents field by field, within a row: no shuffle.

A document is a struct of seven raw strings, with labels where known, a parse
status and a title. compare_pairs adds rows (one struct a field, in order),
status, review_reason, defect_fields and evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import documents, fields
from quaystone.functions.fields import FIELDS
from quaystone.session import short_methods

SEVERITY = ("OK", "MISMATCH", "NEEDS_REVIEW")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status).cast("int") - 1


def _sides(si: Column, bl: Column, labels: tuple[Column, Column] | None, done: bool) -> list[dict]:
    """The stages of columns _a_{field} and _b_{field}, a document's cleaned
    values each. What is written alike is cleaned once: a BL's value that is
    the SI's (_e_{field}), a notify party that is the consignee (_n_{side})."""
    meant = {n: fields.notify_as_meant(doc["notify_party"], doc["consignee"]) for n, doc in (("a", si), ("b", bl))}  # the raw text is kept
    alike = {f: si[f].eqNullSafe(bl[f]) for f in FIELDS}
    alike["notify_party"] &= alike["consignee"]
    if labels:
        alike["gross_weight_kg"] &= labels[0]["gross_weight_kg"].eqNullSafe(labels[1]["gross_weight_kg"])
    first = {f"_e_{f}": c for f, c in alike.items()} | {f"_n_{n}": doc["consignee"].eqNullSafe(meant[n]) for n, doc in (("a", si), ("b", bl))}
    raw = {f"{f}-b": F.when(~F.col(f"_e_{f}"), bl[f]) for f in FIELDS}
    raw["notify_party-b"] = F.when(~(F.col("_e_notify_party") | F.col("_n_b")), meant["b"])
    if not done:
        raw |= {f"{f}-a": si[f] for f in FIELDS} | {"notify_party-a": F.when(~F.col("_n_a"), meant["a"])}
    stages = fields.clean_in_stages(raw, labels and {f"gross_weight_kg-{n}": label["gross_weight_kg"] for n, label in zip("ab", labels, strict=True)}, "_c_")
    own = lambda f, n: F.col(f"`_c_{f}-{n}`")
    a = {f: F.col(f"_a_{f}") if done else own(f, "a") for f in FIELDS}
    if not done:
        a["notify_party"] = F.when(F.col("_n_a"), a["consignee"]).otherwise(a["notify_party"])
    b = {f: F.when(F.col(f"_e_{f}"), a[f]).otherwise(own(f, "b")) for f in FIELDS}
    b["notify_party"] = F.when(F.col("_e_notify_party"), a["notify_party"]).when(F.col("_n_b"), b["consignee"]).otherwise(own("notify_party", "b"))
    return [first, *stages, {f"_a_{f}": c for f, c in a.items()} | {f"_b_{f}": c for f, c in b.items()}]


def with_rows(pairs: DataFrame, si: str = "si", bl: str = "bl", labels: bool = False, out: str = "rows", keep_si: bool = False, keep_verdicts: bool = False) -> DataFrame:
    """pairs with rows: field, raw and cleaned values of both sides, verdict.

    Values are cleaned in a few projections and judged in the next, in flat
    columns: Catalyst keeps the projections apart, so each is computed once.
    keep_si leaves the cleaned SI there for another call that compares the same
    SI with another BL, which then does not clean it again; keep_verdicts
    leaves the verdicts there as columns _v_{field}.
    """
    short_methods(pairs.sparkSession)
    done = all(f"_a_{f}" in pairs.columns for f in FIELDS)
    stages = _sides(F.col(si), F.col(bl), (F.col("si_label"), F.col("bl_label")) if labels else None, done)
    stages.append({f"_v_{f}": fields.verdict(f, F.col(f"_a_{f}"), F.col(f"_b_{f}")) for f in FIELDS})
    row = lambda f: F.struct(
        F.lit(f).alias("field"), F.col(si)[f].alias("si_raw"), F.col(bl)[f].alias("bl_raw"), F.col(f"_a_{f}").alias("si_norm"), F.col(f"_b_{f}").alias("bl_norm"), F.col(f"_v_{f}").alias("verdict")
    )
    for columns in stages:
        pairs = pairs.withColumns(columns)
    kept = {f"_a_{f}" for f in FIELDS if keep_si} | {f"_v_{f}" for f in FIELDS if keep_verdicts}
    made = {c for columns in stages for c in columns}
    return pairs.withColumn(out, F.array(*map(row, FIELDS))).drop(*(made - kept))


def _blanks(rows: Column) -> Column:
    """Up to three blank fields by name and side, then how many more."""
    gone = F.filter(rows, lambda r: r["verdict"] == "missing")
    side = lambda r: F.when(r["si_norm"].isNull(), F.concat(F.lit("SI "), documents.describe_value(r["si_raw"]))).otherwise(F.concat(F.lit("BL "), documents.describe_value(r["bl_raw"])))
    named = F.array_join(F.transform(F.slice(gone, 1, 3), lambda r: F.concat(r["field"], F.lit(": "), side(r))), "; ")
    more = F.size(gone) - 3
    return F.concat(named, F.when(more > 0, F.concat(F.lit("; "), more.cast("string"), F.lit(" further fields"))).otherwise(F.lit("")))


def compare_pairs(pairs: DataFrame, labels: bool = False) -> DataFrame:
    """pairs (si, bl: structs of raw fields, null if absent; si_status,
    bl_status; si_title, bl_title) with the comparison's result.

    The first that holds decides: a document is absent, could not be read, is
    of another type; a field is missing; a field differs; all agree.
    """
    types = {f"_{side}_type": documents.document_type(F.col(f"{side}_title")) for side in ("si", "bl")}
    judged = with_rows(pairs, labels=labels, keep_verdicts=True).withColumns(types)
    absent = F.col("si").isNull() | F.col("bl").isNull()
    unread = (F.coalesce("si_status", F.lit("missing")) != "ok") | (F.coalesce("bl_status", F.lit("missing")) != "ok")
    wrong = ~(F.coalesce("_si_type", F.lit("")) == "SI") | ~(F.coalesce("_bl_type", F.lit("")) == "BL")
    # from the flat verdicts, so that rows are made only where they are asked for
    blank = reduce(lambda x, y: x | y, [F.col(f"_v_{f}") == "missing" for f in FIELDS])
    differ = F.filter(F.array(*[F.when(F.col(f"_v_{f}") == "mismatch", f) for f in FIELDS]), lambda f: f.isNotNull())
    reason = F.when(absent, "missing_attachment").when(unread, "unreadable").when(wrong, "wrong_doc_type").when(blank, "missing_value")
    judged = judged.withColumn("review_reason", reason)
    defects = F.when(F.col("review_reason").isNull(), differ).otherwise(F.array().cast("array<string>"))
    judged = judged.withColumn("defect_fields", defects)
    status = F.when(F.col("review_reason").isNotNull(), "NEEDS_REVIEW").when(F.size("defect_fields") > 0, "MISMATCH").otherwise("OK")
    title = lambda c, want: F.when(F.coalesce(f"_{c}_type", F.lit("")) != want, F.concat(F.lit(f"{want} file is titled "), F.coalesce(F.substring_index(f"{c}_title", "\n", 1), F.lit("nothing"))))
    evidence = (
        F.when(F.col("review_reason") == "missing_attachment", F.concat(F.when(F.col("si").isNull(), "SI").otherwise("BL"), F.lit(" is not attached")))
        .when(F.col("review_reason") == "unreadable", F.when(F.coalesce("si_status", F.lit("missing")) != "ok", F.concat(F.lit("SI is "), F.col("si_status"))).otherwise(F.concat(F.lit("BL is "), F.col("bl_status"))))
        .when(F.col("review_reason") == "wrong_doc_type", F.concat_ws("; ", title("si", "SI"), title("bl", "BL")))
        .when(F.col("review_reason") == "missing_value", _blanks(F.col("rows")))
        .when(F.size("defect_fields") > 0, F.concat(F.size("defect_fields").cast("string"), F.lit(" fields differ: "), F.array_join("defect_fields", ", ")))
        .otherwise("all seven fields agree")
    )
    return judged.withColumns({"status": status, "evidence": evidence}).drop(*types, *[f"_v_{f}" for f in FIELDS])


def long_rows(compared: DataFrame, *keys: str) -> DataFrame:
    """One row a field of the pairs that were compared field by field."""
    # a condition inside the generator, not a filter: pushed below the projections it would clean every value again
    held = F.when(F.col("review_reason").isNull() | (F.col("review_reason") == "missing_value"), F.col("rows"))
    return compared.select(*keys, F.posexplode(held).alias("field_ord", "r")).select(*keys, "field_ord", "r.*")


def defects(compared: DataFrame, *keys: str) -> DataFrame:
    """One row a differing field."""
    return compared.select(*keys, F.explode(F.filter("defect_fields", lambda f: f.isNotNull())).alias("field"))


def revision_label(before: Column, after: Column) -> Column:
    """What became of a field between two drafts, from their verdicts."""
    was, now = before != "match", after != "match"
    return F.when(was & ~now, "fixed").when(was & now, "still_wrong").when(now, "new_mistake").otherwise("unchanged")


def worst_of(compared: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest most severe result of each key, and all its statuses."""
    rank = F.struct(severity(F.col("status")).alias("s"), (-F.col(order)).alias("o"))
    return compared.groupBy(key).agg(
        F.max_by("status", rank).alias("status"),
        F.max_by(order, rank).alias("shown"),
        F.count("*").alias("n_pairs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "status"))), lambda x: x["status"]), ",").alias("statuses"),
    )


def with_corrections(rows: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """rows (key, field, field_ord, verdict, ...) under a reviewer's last word:
    dismiss makes a match, fix judges the corrected value against the other
    side, confirm only tags. corrections: key, field, kind, side, corrected, at;
    undo takes back what came before it."""
    last = corrections.groupBy(key, "field").agg(F.max_by(F.struct("kind", "side", "corrected"), "at").alias("c"))
    joined = rows.join(last, [key, "field"], "left")
    fixes = F.col("c.kind") == "fix"
    chain = lambda of, otherwise: reduce(lambda out, f: F.when(F.col("field") == f, of(f)).otherwise(out), FIELDS, otherwise)
    joined = joined.withColumn("_fixed", F.when(fixes, chain(lambda f: fields.clean(f, F.col("c.corrected")), F.lit(None).cast("string"))))
    value = lambda side, column: F.when(fixes & (F.col("c.side") == side), F.col("_fixed")).otherwise(F.col(column))
    joined = joined.withColumns({"_si": value("SI", "si_norm"), "_bl": value("BL", "bl_norm")})
    again = chain(lambda f: fields.verdict(f, F.col("_si"), F.col("_bl")), F.lit("missing"))
    verdict = F.when(F.col("c.kind") == "dismiss", "match").when(fixes, again).otherwise(F.col("verdict"))
    return joined.withColumns({"verdict": verdict, "tag": F.when(F.col("c.kind") != "undo", F.col("c.kind"))}).drop("c", "_fixed", "_si", "_bl")


def contract_errors(compared: DataFrame) -> DataFrame:
    """compared with errors: which of the result's rules it breaks."""
    rules = {
        "status_known": F.col("status").isin(*SEVERITY),
        "reason_iff_review": (F.col("status") == "NEEDS_REVIEW") == F.col("review_reason").isNotNull(),
        "defects_iff_mismatch": (F.col("status") == "MISMATCH") == (F.size("defect_fields") > 0),
        "seven_rows": F.size("rows") == len(FIELDS),
        "field_order": F.transform("rows", lambda r: r["field"]) == F.array(*map(F.lit, FIELDS)),
        "verdicts_known": F.forall("rows", lambda r: r["verdict"].isin("match", "mismatch", "missing")),
        "evidence_given": F.length("evidence") > 0,
    }
    return compared.withColumn("errors", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda e: e.isNotNull()))


def submission(compared: DataFrame, key: str, category: Column) -> DataFrame:
    """The flat entry of one message: category, status, reason, defects."""
    routed = category == "BL_COMPARISON"
    none = F.lit(None).cast("string")
    return compared.select(
        key,
        category.alias("category"),
        F.when(routed, F.col("status")).otherwise("OK").alias("status"),
        F.when(routed, F.col("review_reason")).otherwise(none).alias("review_reason"),
        (routed & (F.size("defect_fields") > 0)).alias("has_defect"),
        F.when(routed, F.col("defect_fields")).otherwise(F.array().cast("array<string>")).alias("defect_fields"),
    )
