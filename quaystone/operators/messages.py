"""From messages and their files to results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import documents, fields
from quaystone.functions.fields import FIELDS
from quaystone.operators import compare, pairing, routing
from quaystone.session import stored
from quaystone.sources import readers


#: Files by path: rows (path, content), or what gives them for rows (path), such as folder.named.
Files = DataFrame | Callable[[DataFrame], DataFrame]


def _opened(files: Files, paths: DataFrame) -> DataFrame:
    """path, content of the files that paths name."""
    named = paths.select("path").where("path is not null")
    return files(named.distinct()) if callable(files) else files.join(named, "path", "left_semi")


def read_fields(files: DataFrame, formats: dict[str, readers.Reader] | None = None) -> DataFrame:
    """path, status, title, v (the seven raw fields), l (their labels) of files
    (path, content), each read once."""
    read = readers.read_documents(files.select("path", documents.attachment_format(F.col("path")).alias("format"), "content"), formats)
    read = read.select("path", "status", "title", readers.aligned(F.col("pairs")).alias("a")).select("path", "status", "title", "a.v", "a.l")
    return stored(read, "read")


def _paired(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """pairs (si_path, bl_path) with what compare_pairs takes. No path, and a
    path without a file, are a document that is absent."""
    nothing = F.struct(*[F.lit(None).cast("string").alias(f) for f in FIELDS])
    for side in ("si", "bl"):
        doc = read.where("status <> 'missing'").select(F.col("path").alias(f"{side}_path"), F.col("v").alias(side), F.col("l").alias(f"{side}_label"), F.col("status").alias(f"{side}_status"), F.col("title").alias(f"{side}_title"))
        pairs = pairs.join(doc, f"{side}_path", "left").withColumns({
            f"{side}_label": F.coalesce(f"{side}_label", nothing),
            f"{side}_status": F.coalesce(f"{side}_status", F.lit("missing")),
        })
    return pairs


def compare_files(pairs: DataFrame, files: Files, formats: dict[str, readers.Reader] | None = None) -> DataFrame:
    """pairs (any columns, si_path, bl_path, either null) read and compared:
    status, review_reason, defect_fields, evidence, rows beside them. Only
    files that a pair names are read, by formats (READERS, if none is given)."""
    named = pairs.select(F.explode(F.array("si_path", "bl_path")).alias("path"))
    read = read_fields(_opened(files, named), formats)
    return compare.compare_pairs(_paired(pairs, read), labels=True)


def compare_fields(norms: DataFrame, key: str) -> DataFrame:
    """norms (key, si, bl: structs of seven cleaned values, as an editor left
    them) judged again: key, status, review_reason, defect_fields."""
    judged = norms.withColumns({f"_v_{f}": fields.verdict(f, F.col("si")[f], F.col("bl")[f]) for f in FIELDS})
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_v_{f}").alias("verdict")) for f in FIELDS])
    of = lambda v: F.transform(F.filter("rows", lambda r: r["verdict"] == v), lambda r: r["field"])
    judged = judged.withColumn("rows", rows).withColumns({"_blank": F.size(of("missing")) > 0, "_differ": of("mismatch")})
    status = F.when(F.col("_blank"), "NEEDS_REVIEW").when(F.size("_differ") > 0, "MISMATCH").otherwise("OK")
    return judged.select(key, status.alias("status"), F.when(F.col("_blank"), "missing_value").alias("review_reason"), F.when(F.col("_blank"), F.array().cast("array<string>")).otherwise(F.col("_differ")).alias("defect_fields"))


def attachments_of(messages: DataFrame) -> DataFrame:
    """email_id, pos, path: one row an attachment, and one without path of a
    message that has none."""
    return messages.select("email_id", F.posexplode_outer("attachments").alias("pos", "path"))


def _documents(slots: DataFrame, read: DataFrame) -> DataFrame:
    """email_id and files: a message's files in their order, each with what
    its name and title tell and, where it was read, the document doc."""
    there = F.col("status") != "missing"
    doc = F.when(there, F.struct("status", "title", "v", "l"))
    rank = documents.revision_rank(F.col("path"), F.col("title"))
    held = pairing.with_role(slots.join(read, "path", "left")).withColumns({"_doc": doc, "_rank": rank, "_roles": pairing.roles_of(F.col("path"))})
    file = F.struct("pos", "path", "role", "key", F.col("_roles").alias("roles"), F.col("_rank.marked").alias("marked"), F.col("_rank.number").alias("number"), F.col("_doc").alias("doc"))
    return held.groupBy("email_id").agg(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), file))).alias("files"))


def pairs_of(found: DataFrame) -> DataFrame:
    """What to compare of each message (email_id, files of _documents): with
    two or more complete shipments each of them (place 1, 2, ...; n in all),
    else the latest revision of SI and BL and, where there is one, the pair of
    the BL before it. draft tells now from before; one row a pair. All of a
    message is in its row, so nothing is joined or shuffled."""
    pair = lambda place, n, note, draft, si, bl: F.struct(
        place.alias("place"), n.alias("n"), note.alias("note"), F.lit(draft).alias("draft"),
        si["path"].alias("si_path"), bl["path"].alias("bl_path"), si["doc"].alias("si_doc"), bl["doc"].alias("bl_doc"),
    )
    first = lambda role, key: F.get(F.filter("files", lambda g: (g["role"] == role) & (g["key"] == key)), F.lit(0))
    begins = F.filter("files", lambda f: (f["role"] == "SI") & (first("SI", f["key"])["path"] == f["path"]) & first("BL", f["key"]).isNotNull())
    best_first = F.transform(F.sort_array(F.transform("files", lambda f: F.struct(f["marked"], f["number"], f["pos"], f.alias("f"))), False), lambda x: x["f"])
    found = found.withColumns({"_begins": begins, "_best": best_first})
    of = lambda role: F.filter("_best", lambda f: F.array_contains(f["roles"], role))
    found = found.withColumns({"_SI": of("SI"), "_BL": of("BL")})
    n = F.size("_begins").cast("long")
    many = F.transform("_begins", lambda si, i: pair(i + 1, n, F.lit(None).cast("string"), "now", si, first("BL", si["key"])))
    at = lambda role, i: F.get(F.col(f"_{role}"), F.lit(i))
    rest = lambda role: F.transform(F.slice(F.col(f"_{role}"), 2, 1 << 30), lambda f: f["path"])
    aside = F.array_join(F.array_sort(F.concat(rest("SI"), rest("BL"))), ", ")
    one = lambda draft, bl: pair(F.lit(1), F.lit(1).cast("long"), F.when(aside != "", F.concat(F.lit("set aside: "), aside)), draft, at("SI", 0), bl)
    single = F.filter(F.array(one("now", at("BL", 0)), F.when(F.size("_BL") > 1, one("before", at("BL", 1)))), lambda x: x.isNotNull())
    return found.select("email_id", F.inline(F.when(n >= 2, many).otherwise(single)))


def _sides(pairs: DataFrame) -> DataFrame:
    """pairs (si_doc, bl_doc) with what compare_pairs takes."""
    nothing = F.struct(*[F.lit(None).cast("string").alias(f) for f in FIELDS])
    of = lambda side: {
        side: F.col(f"{side}_doc.v"), f"{side}_label": F.coalesce(f"{side}_doc.l", nothing),
        f"{side}_status": F.coalesce(f"{side}_doc.status", F.lit("missing")), f"{side}_title": F.col(f"{side}_doc.title"),
    }
    return pairs.withColumns(of("si") | of("bl")).drop("si_doc", "bl_doc")


RESULT = ("email_id", "category", "decided_by", "confidence", "status", "review_reason", "defect_fields", "evidence", "si_path", "bl_path", "n_shipments", "revision")


def process_emails(messages: DataFrame, files: Files, answers: DataFrame | None = None, formats: dict[str, readers.Reader] | None = None) -> DataFrame:
    """Messages (email_id, from, subject, body, attachments) and files to one
    result a message, RESULT.

    A message is filed by its complete pair, a given answer (answers) or
    keywords; only comparisons are paired, read and compared. Of several
    shipments the earliest most severe result counts and the evidence lists
    all; of several drafts the latest counts and revision tells what became of
    each field since the one before. Other messages are OK as they are.
    Null attachments are none; a message without an id is no message. formats:
    how files are read, by suffix (READERS, if none is given).
    """
    filed = routing.classify(messages.where("email_id is not null").withColumn("attachments", F.coalesce("attachments", F.array().cast("array<string>"))), answers)
    slots = stored(attachments_of(filed.where("category = 'BL_COMPARISON'")), "slots")
    read = read_fields(_opened(files, slots), formats)
    result = compare.compare_pairs(_sides(pairs_of(_documents(slots, read))), labels=True)
    result = result.withColumn("rows", F.transform("rows", lambda r: F.struct(r["field"], r["verdict"])))
    rank = F.struct(F.when(F.col("draft") == "now", compare.severity(F.col("status"))).otherwise(-1).alias("s"), (-F.col("place")).alias("o"))
    kept = F.struct("status", "review_reason", "defect_fields", "evidence", "si_path", "bl_path", "rows", "note", "n", "place")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("draft") == "now", F.struct("place", "status")))), lambda x: F.concat(F.lit("shipment "), x["place"].cast("string"), F.lit(" "), x["status"])), ", ")
    folded = result.groupBy("email_id").agg(F.max_by(kept, rank).alias("r"), F.max(F.when(F.col("draft") == "before", F.col("rows"))).alias("before"), listed.alias("listed"))
    label = F.transform(F.arrays_zip(F.col("before"), F.col("r.rows").alias("rows")), lambda x: F.struct(x["before"]["field"].alias("field"), compare.revision_label(x["before"]["verdict"], x["rows"]["verdict"]).alias("label")))
    evidence = F.when(F.col("r.n") > 1, F.concat_ws("; ", F.col("listed"), F.concat(F.lit("shown: shipment "), F.col("r.place").cast("string")), F.col("r.evidence"))).otherwise(F.concat_ws("; ", F.col("r.note"), F.col("r.evidence")))
    done = folded.select("email_id", *[F.col(f"r.{c}").alias(c) for c in ("status", "review_reason", "defect_fields", "si_path", "bl_path")], evidence.alias("evidence"), F.col("r.n").cast("long").alias("n_shipments"), F.when(F.col("before").isNotNull(), label).alias("revision"))
    out = filed.join(done, "email_id", "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("OK")), "defect_fields": F.coalesce("defect_fields", F.array().cast("array<string>")), "n_shipments": F.coalesce("n_shipments", F.lit(0).cast("long"))}).select(*RESULT)
