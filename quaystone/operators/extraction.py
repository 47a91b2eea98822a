"""Where a document's seven fields come from: what was saved, the rules, a
model's answer, and the guards that hold an answer against the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import documents, fields
from quaystone.functions.fields import FIELDS
from quaystone.session import stored
from quaystone.sources import readers

#: A long table of extracted values: one row a document and field.
EXTRACT = "doc string, field string, present boolean, label_seen string, raw string"


def plain_label(label: Column) -> Column:
    """A label as words: parentheses and marks (but slashes) dropped, lower case."""
    return F.trim(F.lower(fields.squash(F.regexp_replace(F.regexp_replace(label, r"\([^)]*\)", " "), r"[^\w\s/]", " "))))


def is_same_label(a: Column, b: Column) -> Column:
    """One plain label is the beginning of the other."""
    return a.startswith(b) | b.startswith(a)


#: Put around a found value; private to Unicode, and taken out of texts before.
_FROM, _TO = "\ue000", "\ue001"
#: A marked value whose neighbours, marked ones too, are no letter, digit or number mark.
_ALONE = rf"(?<![\w.,])(?<![\w.,]{_TO}){_FROM}[^{_TO}]*{_TO}(?!{_FROM}?\w|{_FROM}?[.,]{_TO}?{_FROM}?\d)"


def stands_whole(value: Column, text: Column) -> Column:
    """value occurs in text as whole words and numbers, spaces folded: no
    letter, digit or number mark touches it. The value is marked where it
    occurs and its neighbours are looked at by one constant pattern, so no
    pattern is compiled for a row; nothing stands nowhere."""
    v, t = F.trim(fields.squash(value)), F.translate(F.trim(fields.squash(text)), _FROM + _TO, "")
    return (v != "") & F.replace(t, v, F.concat(F.lit(_FROM), v, F.lit(_TO))).rlike(_ALONE)


def plain_labels(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: plain_label(p["label"]))


def is_under_its_label(raw: Column, label_seen: Column, pairs: Column, plain: Column | None = None) -> Column:
    """The value stands whole under the label it is said to have, or, if no
    pair has that label, under any. plain: plain_labels of pairs, where known."""
    plain = plain_labels(pairs) if plain is None else plain
    # both evaluated before the filter, not for each pair
    labels = F.struct(plain_label(F.coalesce(label_seen, F.lit(""))).alias("wanted"), plain.alias("plain"))
    of_label = fields.let(labels, lambda x: F.filter(pairs, lambda p, i: is_same_label(F.get(x["plain"], i), x["wanted"])))
    searched = fields.let(of_label, lambda found: F.when(F.size(found) > 0, found).otherwise(pairs))
    return F.coalesce(F.exists(searched, lambda p: stands_whole(raw, p["value"])), F.lit(False))


def is_misplaced(field: Column, raw: Column, label_seen: Column, pairs: Column, plain: Column | None = None) -> Column:
    """The label belongs to another field, or the value is not under it."""
    claimed = documents.canonical_field(F.coalesce(label_seen, F.lit("")))
    return (claimed.isNotNull() & (claimed != field)) | ~is_under_its_label(F.coalesce(raw, F.lit("")), label_seen, pairs, plain)


def _kept(extract: DataFrame, keep: Column) -> DataFrame:
    """extract with the values that are not kept made absent."""
    keep = F.coalesce(keep, F.lit(False))
    value = lambda c: F.when(F.col("_keep"), F.col(c))
    return extract.withColumn("_keep", keep).withColumns({"present": F.col("_keep"), "label_seen": value("label_seen"), "raw": value("raw")}).drop("_keep")


def under_their_labels(extract: DataFrame, pairs: DataFrame) -> DataFrame:
    """extract (EXTRACT) with values that its documents (doc, pairs) do not
    bear out made absent."""
    # a document's labels are made plain once, not for each of its fields
    held = extract.join(pairs.select("doc", "pairs", plain_labels(F.col("pairs")).alias("_plain")), "doc", "left")
    none = F.array().cast(readers.PAIRS)
    return _kept(held, F.col("present") & ~is_misplaced(F.col("field"), F.col("raw"), F.col("label_seen"), F.coalesce("pairs", none), F.coalesce("_plain", F.array().cast("array<string>")))).drop("pairs", "_plain")


def verbatim_only(extract: DataFrame) -> DataFrame:
    """extract with values made absent that come without a label or a text, as
    for scans, where nothing else can be checked."""
    return _kept(extract, F.col("present") & (F.col("label_seen") != "") & (F.col("raw") != ""))


def _gives_all(v: Column) -> Column:
    """All seven fields have a value."""
    whole = F.lit(True)
    for f in FIELDS:
        whole = whole & F.coalesce(v[f] != "", F.lit(False))
    return whole


def _rows(v: Column, label: Column) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(True).alias("present"), label[f].alias("label_seen"), v[f].alias("raw")) for f in FIELDS])


def by_rule(docs: DataFrame) -> DataFrame:
    """EXTRACT of docs (doc, status, pairs) that give all seven fields by their
    labels; documents that give fewer are left to others, whole."""
    found = docs.where("status = 'ok'").select("doc", readers.aligned(F.col("pairs")).alias("a")).select("doc", "a.v", "a.l")
    # a condition inside the generator, not a filter: pushed below the projection it would align every label again
    return found.select("doc", F.inline(F.when(_gives_all(F.col("v")), _rows(F.col("v"), F.col("l")))))


def is_current(saved_status: Column, saved_type: Column, status: Column, title: Column) -> Column:
    """A saved extract is of the document at hand: its status is the same, and
    its type, if a title is given."""
    return saved_status.eqNullSafe(status) & (title.isNull() | documents.document_type(title).eqNullSafe(saved_type))


def tiers(docs: DataFrame, saved: DataFrame) -> DataFrame:
    """docs (doc, status, title, pairs) as doc, source (saved, rule, model), a
    (aligned pairs) and pairs: which tier answers each document, said once."""
    kept = saved.groupBy("doc").agg(F.min(F.struct("status", "type")).alias("_s"))
    is_saved = F.col("_s").isNotNull() & is_current(F.col("_s.status"), F.col("_s.type"), F.col("status"), F.col("title"))
    held = docs.join(kept, "doc", "left").withColumn("_saved", F.coalesce(is_saved, F.lit(False)))
    held = held.withColumn("a", F.when(~F.col("_saved") & (F.col("status") == "ok"), readers.aligned(F.col("pairs"))))
    source = F.when(F.col("_saved"), "saved").when(_gives_all(F.col("a.v")), "rule").otherwise("model")
    return held.select("doc", source.alias("source"), "a", "pairs")


def chosen_extracts(docs: DataFrame, saved: DataFrame, answers: DataFrame) -> DataFrame:
    """EXTRACT and source (saved, rule, model) of docs (doc, status, title,
    pairs): what is saved and current, else the rules if they give all fields,
    else the model's answer under its guard. The tier of a document is found
    once and stored; each tier then takes its own. saved: EXTRACT with status
    and type by document."""
    told = stored(tiers(docs, saved), "tiers")
    of = lambda source: told.where(F.col("source") == source)
    columns = ["doc", "field", "present", "label_seen", "raw"]
    tier_1 = saved.join(of("saved").select("doc"), "doc", "left_semi").select(*columns, F.lit("saved").alias("source"))
    tier_2 = of("rule").select("doc", F.inline(_rows(F.col("a.v"), F.col("a.l")))).select(*columns, F.lit("rule").alias("source"))
    rest = of("model").select("doc", "pairs")
    tier_3 = under_their_labels(answers.join(rest.select("doc"), "doc", "left_semi"), rest).select(*columns, F.lit("model").alias("source"))
    return tier_1.unionByName(tier_2).unionByName(tier_3)


def empty_extractions(docs: DataFrame, extract: DataFrame) -> DataFrame:
    """doc, title: documents that could not be read, or were and gave no field;
    a missing file is no failure."""
    given = extract.where("present").select("doc").distinct().withColumn("_any", F.lit(True))
    held = docs.join(given, "doc", "left")
    title = F.when(F.col("status") == "unreadable", "file could not be read").when((F.col("status") == "ok") & F.col("_any").isNull(), "nothing extracted")
    return held.select("doc", title.alias("title")).where("title is not null")


def cleaned(extract: DataFrame) -> DataFrame:
    """extract with norm, the comparable form of its values."""
    norm = F.lit(None).cast("string")
    for f in FIELDS:
        norm = F.when(F.col("field") == f, fields.clean(f, F.col("raw"), F.col("label_seen"))).otherwise(norm)
    return extract.withColumn("norm", F.when(F.col("present"), norm))


def untrusted(extract: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Present values of fields with a closed set (vocabulary: field, norm)
    that are not in it, from an extract with norm. Fields without a set, and
    values that clean to nothing, are not checked."""
    checked = vocabulary.select("field").distinct()
    return extract.where("present and norm is not null").join(checked, "field", "left_semi").join(vocabulary.select("field", "norm").distinct(), ["field", "norm"], "left_anti")


def scans(readings: DataFrame) -> DataFrame:
    """email_id, roles, flagged of readings of scans (name: a message's id and
    its role; untrusted: values that no document had): one row a message, of
    several readings of a role the last by name."""
    parts = F.regexp_extract("name", r"^(.+)_(SI|BL)$", 1), F.regexp_extract("name", r"^(.+)_(SI|BL)$", 2)
    named = readings.select(parts[0].alias("email_id"), parts[1].alias("role"), F.coalesce(F.size("untrusted"), F.lit(0)).alias("n"), "name").where("role <> ''")
    one = named.groupBy("email_id", "role").agg(F.max_by("n", "name").alias("n"))
    return one.groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"), F.sum("n").alias("flagged"))


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two extracts with norm, tallied by field: agree, first_only,
    second_only, differ, total and share that agrees, over documents in both."""
    left, right = (x.select("doc", "field", F.col("norm").alias(n)) for x, n in ((first, "a"), (second, "b")))
    kind = F.when(F.col("a").eqNullSafe(F.col("b")), "agree").when(F.col("b").isNull(), "first_only").when(F.col("a").isNull(), "second_only").otherwise("differ")
    both = left.join(right, ["doc", "field"]).select("field", kind.alias("kind"))
    tally = both.groupBy("field").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("agree", "first_only", "second_only", "differ")], F.count("*").alias("total"))
    return tally.withColumn("share", F.try_divide(F.col("agree"), F.col("total")))


def verdicts_differ(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Ids whose results (key, status, review_reason, defect_fields) differ
    between two ways of extracting, defects in any order."""
    shape = lambda df, n: df.select(key, F.struct("status", "review_reason", F.array_sort("defect_fields").alias("defects")).alias(n))
    return shape(first, "a").join(shape(second, "b"), key).where(~F.col("a").eqNullSafe(F.col("b"))).select(key, "a", "b")
