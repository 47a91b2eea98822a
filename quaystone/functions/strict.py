"""The stricter of two rule sets: cleaned values must be equal as texts. It is
a check on the other (fields), which judges numbers and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import fields
from quaystone.functions.fields import FIELDS, NAME_FIELDS, PORT_FIELDS


def count(raw: Column) -> Column:
    """The number that a value begins with, or null."""
    return F.nullif(F.regexp_extract(raw, "^[0-9]+", 0), F.lit(""))


def weight(raw: Column) -> Column:
    """The first number of a value, whatever its unit, as a decimal text."""
    first = F.nullif(F.regexp_extract(raw, f"({fields.NUMBER})", 1), F.lit(""))
    return F.when(first.isNotNull(), fields.parse_number(first).cast("decimal(18,3)").cast("string"))


def clean(field: str, raw: Column) -> Column:
    """The comparable text of a value, null if it is absent."""
    x = fields.stripped(F.regexp_replace(raw, r"[ \t\x0B\f]{2,}|[\t\x0B\f]", " "))
    if field in NAME_FIELDS:
        out = fields.clean_name(x)
    elif field in PORT_FIELDS:
        out = fields.clean_port(x)
    else:
        out = count(x) if field == "container_count" else weight(x)
    return F.when(raw.isNotNull() & ~fields.is_placeholder(raw), out)


def verdict(a: Column, b: Column) -> Column:
    """match, mismatch or missing, for two cleaned values."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "match").otherwise("mismatch")


#: Blanks that the stricter rules fold before they clean a value.
_ODD_BLANKS = ("\t", "\x0b", "\f", "  ")


def with_verdicts(pairs: DataFrame, out: str = "strict", rows: str | None = "rows") -> DataFrame:
    """pairs (si, bl: structs of raw fields) with an array of the seven
    verdicts, in the fields' order. Where pairs have the other rules' rows,
    their cleaned names and ports are these rules' too, unless a value has
    blanks to fold first, and are not cleaned again."""
    shared = rows is not None and rows in pairs.columns

    def cleaned(side: str, i: int, f: str) -> Column:
        doc = F.col(side)
        raw = fields.notify_as_meant(doc[f], doc["consignee"]) if f == "notify_party" else doc[f]
        if not shared or f not in (*NAME_FIELDS, *PORT_FIELDS):
            return clean(f, raw)
        return F.when(fields.has_any(doc[f], *_ODD_BLANKS) | fields.has_any(doc["consignee"], *_ODD_BLANKS), clean(f, raw)).otherwise(F.get(F.col(rows), F.lit(i))[f"{side}_norm"])

    values = {f"_{side}_{f}": cleaned(side, i, f) for side in ("si", "bl") for i, f in enumerate(FIELDS)}
    return pairs.withColumns(values).withColumn(out, F.array(*[verdict(F.col(f"_si_{f}"), F.col(f"_bl_{f}")) for f in FIELDS])).drop(*values)
