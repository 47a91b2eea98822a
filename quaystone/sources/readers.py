"""Readers of messages and documents. All are total: a document that cannot be
read gives a status, never an error."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions import documents
from quaystone.functions.documents import FIELD_OF_LABEL
from quaystone.functions.fields import FIELDS, let
from quaystone.sources.edi import edi_document
from quaystone.sources.lines import PAIRS, txt_pairs

EMAIL_SCHEMA = "email_id string, `from` string, subject string, body string, attachments array<string>"
#: A member of an office file may hold so many bytes, by its header and in fact.
MEMBER_LIMIT = 8 << 20
LEAST_PAIRS = 3


def emails(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of a folder of JSON files, with its sender's domain."""
    found = spark.read.schema(EMAIL_SCHEMA).option("multiLine", True).json(folder)
    return found.withColumn("sender_domain", documents.sender_domain(F.col("from")))


def as_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def json_by_stem(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Result files of a folder, keyed by file name without suffix."""
    found = spark.read.schema(schema).option("multiLine", True).json(folder)
    return found.withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def json_in_script(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the JSON array that a script assigns."""
    text = spark.read.option("wholetext", True).text(path)
    rows = F.from_json(F.regexp_extract("value", r"(?s)=\s*(\[.*\])\s*;?\s*$", 1), f"array<struct<{schema}>>")
    return text.select(F.inline(rows))


def txt_title(text: Column) -> Column:
    return F.nullif(F.trim(F.substring_index(text, "\n", 1)), F.lit(""))


def _member(archive: zipfile.ZipFile, name: str) -> str:
    if archive.getinfo(name).file_size > MEMBER_LIMIT:
        raise ValueError(f"{name} is too large")
    with archive.open(name) as f:
        data = f.read(MEMBER_LIMIT + 1)
    if len(data) > MEMBER_LIMIT:
        raise ValueError(f"{name} is too large")
    return data.decode("utf-8", "replace")


_PARAGRAPH, _ROW, _CELL = (re.compile(rf"<w:{x}\b") for x in ("p", "tr", "tc"))
_SHEET_ROW, _SHARED = (re.compile(rf"<{x}\b") for x in ("row", "si"))
_BREAK, _TAG, _IN_TEXT = re.compile(r"<w:br\b[^>]*/?>|</w:p>"), re.compile(r"<[^>\n]+>"), re.compile(r"<w:t\b[^>]*>([^<]*)</w:t>")
_INLINE, _SHEET_CELL, _OF_SHARED = re.compile(r"(?s)<t\b[^>]*>(.*?)</t>"), re.compile("(?s)<c\\b.*?(?:</c>|/>)"), re.compile(r'^<c\b[^>]*\bt="s"')
_FOREIGN, _ASIDE = re.compile("[一-鿿■]"), re.compile(r"\([^)]*\)")


def _spans(xml: str, opens: re.Pattern, end: str) -> Iterator[str]:
    """Texts from each match of a pattern to the next end. Linear in the text,
    also if some do not end."""
    at = 0
    while (found := opens.search(xml, at)) and (to := xml.find(end, found.end())) >= 0:
        at = to + len(end)
        yield xml[found.start() : at]


def _inline(xml: str) -> str | None:
    """What stands in the t elements of a cell, or None if it has none."""
    found = _INLINE.findall(xml)
    return html.unescape("".join(found)) if found else None


def _plain(cells: list[str]) -> list[str]:
    """The text of each cell. Tags do not go over line ends, so cells parted by
    a line of their own are freed of tags together, if breaks are plain."""
    whole = "\n\0\n".join(cells)
    if "<w:br" in whole or whole.count("\0") >= len(cells):
        texts = [_TAG.sub("", _BREAK.sub("\n", c)) for c in cells]
    else:
        texts = _TAG.sub("", whole.replace("</w:p>", "\n")).split("\n\0\n")
    return [" | ".join(filter(None, [html.unescape(x).strip() for x in t.split("\n")])) for t in texts]


#: Stands between the cells of one value; the marks that cut names are this and line ends.
CELL_MARK = " | "


def _from_cells(cells: list[str]) -> list[tuple[str, str]]:
    """One row of a table: its label and the rest; several pairs when the first
    cell is a known label and later ones are too."""
    cells = [c for c in cells if c]
    if len(cells) < 2:
        return []
    marks = [i for i, c in enumerate(cells) if _known(c)]
    if not marks or marks[0]:
        return [(cells[0], CELL_MARK.join(cells[1:]))]
    return [(cells[a].rstrip(":"), CELL_MARK.join(cells[a + 1 : b])) for a, b in zip(marks, [*marks[1:], len(cells)], strict=True)]


def _known(label: str) -> bool:
    x = label if label.isascii() else _FOREIGN.sub("", label)
    x = _ASIDE.sub(" ", x) if "(" in x else x
    return " ".join(x.split()).rstrip(":").lower().removeprefix("total ") in FIELD_OF_LABEL


def _docx(content: bytes) -> tuple[str | None, list]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = _member(z, "word/document.xml")
    pairs = [pair for r in _spans(xml, _ROW, "</w:tr>") for pair in _from_cells(_plain(list(_spans(r, _CELL, "</w:tc>"))))]
    paragraphs = (html.unescape("".join(_IN_TEXT.findall(p))).strip() for p in _spans(xml, _PARAGRAPH, "</w:p>"))
    if pairs:
        return next(filter(None, paragraphs), None), pairs
    written = list(paragraphs)
    return next(filter(None, written), None), [(a.strip(), b.strip()) for a, colon, b in (p.partition(":") for p in written) if colon]


def _xlsx(content: bytes) -> tuple[str | None, list]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        sheet = _member(z, min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)))
        shared = _member(z, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else ""
    texts = [_inline(x) or "" for x in _spans(shared, _SHARED, "</si>")]

    def value(cell: str) -> str:
        written = _inline(cell)
        if written is not None:
            return written.strip()
        _, begun, rest = cell.partition("<v>")
        v, ended, _ = rest.partition("</v>")
        if not begun or not ended:
            return ""
        return texts[int(v)].strip() if _OF_SHARED.search(cell) else html.unescape(v).strip()

    rows = [[value(c) for c in _SHEET_CELL.findall(r)] for r in _spans(sheet, _SHEET_ROW, "</row>")]
    title = next((c for r in rows for c in r if c), None)
    return title, [pair for r in rows for pair in _from_cells(r)]


#: A form read line by line holds at least so many of the seven fields.
LEAST_FIELDS = 5
#: What starts a table of containers, whose headings are no labels.
TABLE_START = "CONTAINER NO."


def form_pairs(lines: DataFrame) -> DataFrame:
    """lines (doc, pos, line; stripped, none blank) of forms to (doc, pos,
    label, value): "label: value", or a known label alone with its value on the
    lines below, until the next label. In a table of containers nothing counts
    but whole pairs, which also end it. pos is the label's line."""
    known = lambda x: documents.canonical_field(x).isNotNull()
    before, after = F.substring_index("line", ":", 1), F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    bare = F.trim(F.regexp_replace("line", ":+$", ""))
    is_pair = F.col("line").contains(":") & (after != "") & known(before)
    kind = F.when(is_pair, "pair").when(F.upper("line").startswith(TABLE_START), "table").when(known(bare), "label").otherwise("text")
    tagged = lines.withColumns({"kind": kind, "label": F.when(is_pair, F.trim(before)).otherwise(bare), "value": F.when(is_pair, after).otherwise(F.col("line"))})
    so_far = Window.partitionBy("doc").orderBy("pos")
    in_table = F.coalesce(F.last(F.when(F.col("kind") == "pair", False).when(F.col("kind") == "table", True), ignorenulls=True).over(so_far), F.lit(False))
    tagged = tagged.withColumn("in_table", in_table)
    starts = (F.col("kind") == "pair") | ((F.col("kind") == "label") & ~F.col("in_table"))
    tagged = tagged.withColumn("starts", starts).withColumn("owner", F.last(F.when(F.col("starts"), F.col("pos")), ignorenulls=True).over(so_far))
    held = tagged.where("starts or (kind = 'text' and not in_table and owner is not null)")
    at_start = lambda c: F.max(F.when(F.col("starts"), F.col(c)))
    under = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("pos", "line"))))
    grouped = held.groupBy("doc", F.col("owner").alias("pos")).agg(at_start("kind").alias("kind"), at_start("label").alias("label"), at_start("value").alias("whole"), F.array_join(F.transform(under, lambda x: x["line"]), CELL_MARK).alias("below"))
    return grouped.select("doc", "pos", "label", F.when(F.col("kind") == "pair", F.col("whole")).otherwise(F.col("below")).alias("value"))


def read_forms(lines: DataFrame) -> DataFrame:
    """doc, status, pairs of forms given by their lines: unreadable if fewer
    than LEAST_FIELDS of the seven fields are named."""
    found = form_pairs(lines).withColumn("field", documents.canonical_field(F.col("label")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "value"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value")))
    held = found.groupBy("doc").agg(F.count_distinct("field").alias("n"), ordered.alias("pairs"))
    out = lines.select("doc").distinct().join(held, "doc", "left")
    status = F.when(F.coalesce("n", F.lit(0)) >= LEAST_FIELDS, "ok").otherwise("unreadable")
    return out.select("doc", status.alias("status"), F.coalesce("pairs", F.array().cast(PAIRS)).alias("pairs"))


Parse = Callable[[bytes], tuple[str | None, list[tuple[str, str]]]]
#: How a format is read: from the content (null for files of other formats) to a struct (title, pairs, error).
Reader = Callable[[Column], Column]
_READ = T.StructType([T.StructField("title", T.StringType()), T.StructField("pairs", PAIRS), T.StructField("error", T.StringType())])


def by_bytes(parse: Parse) -> Reader:
    """A reader from a function of a file's bytes to its title and pairs. What
    the function raises is the file's error, not the job's."""

    @F.arrow_udf(_READ)
    def read(contents: pa.Array) -> pa.Array:
        titles, errors, labels, values, ends = [], [], [], [], [0]
        for content in contents.to_pylist():
            title, pairs, error = None, [], None
            if content is not None:
                try:
                    title, found = parse(content)
                    pairs = [(label, value) for label, value in found]
                except Exception as e:  # noqa: BLE001  a broken file is a status, whatever broke
                    error = f"{type(e).__name__}: {e}"
            titles.append(title)
            errors.append(error)
            labels += [label for label, _ in pairs]
            values += [value for _, value in pairs]
            ends.append(len(labels))
        text = lambda x: pa.array(x, pa.string())
        both = pa.StructArray.from_arrays([text(labels), text(values)], ["label", "value"])
        return pa.StructArray.from_arrays([text(titles), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both), text(errors)], _READ.names)

    return read


def _by_lines(content: Column) -> Column:
    text = as_text(content)
    return F.struct(txt_title(text).alias("title"), txt_pairs(text).alias("pairs"), F.lit(None).cast("string").alias("error"))


def _by_segments(content: Column) -> Column:
    found = edi_document(as_text(content))
    return F.struct(found["title"].alias("title"), found["pairs"].alias("pairs"), F.lit(None).cast("string").alias("error"))


#: The formats that are read, by suffix. PDF needs a library that is not here; a caller may add it, or any other.
READERS: dict[str, Reader] = {"txt": _by_lines, "edi": _by_segments, "docx": by_bytes(_docx), "xlsx": by_bytes(_xlsx)}


def read_documents(files: DataFrame, formats: dict[str, Reader] | None = None) -> DataFrame:
    """files (path, format, content) with status, title, pairs, error, read in
    one pass. formats: READERS, or those with others beside them. A file of
    another format is not attempted, one of a known format without content is
    missing, and one that breaks its reader or gives fewer than three pairs is
    unreadable, its pairs kept."""
    formats = READERS if formats is None else formats
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in _READ])
    found = F.lit(None).cast(_READ)
    for name, read in formats.items():
        here = F.col("format") == name
        found = F.when(here, read(F.when(here, F.col("content")))).otherwise(found)
    held = files.withColumn("_read", F.when(F.col("content").isNotNull(), found).otherwise(none))
    title, pairs, error = (F.col(f"_read.{c}") for c in _READ.names)
    readable = F.coalesce(F.col("format").isin(*formats), F.lit(False))
    pairs = F.coalesce(pairs, F.array().cast(PAIRS))
    status = (
        F.when(~readable, "not_attempted").when(F.col("content").isNull(), "missing")
        .when(error.isNotNull() | (F.size(pairs) < LEAST_PAIRS), "unreadable").otherwise("ok")
    )
    return held.select("path", "format", status.alias("status"), title.alias("title"), pairs.alias("pairs"), error.alias("error"))


def aligned(pairs: Column) -> Column:
    """Struct of v, the seven raw fields, and l, the labels that named them as
    they were written: of several labels of a field the first counts. Each
    label is cleaned once."""
    tagged = F.transform(pairs, lambda p: F.struct(documents.canonical_field(p["label"]).alias("f"), p["value"].alias("v"), p["label"].alias("l")))
    first = lambda t, f: F.get(F.filter(t, lambda x: x["f"] == f), F.lit(0))
    one_each = lambda t: F.struct(*[first(t, f).alias(f) for f in FIELDS])
    side = lambda firsts, c: F.struct(*[firsts[f][c].alias(f) for f in FIELDS]).alias(c)
    return let(let(tagged, one_each), lambda firsts: F.struct(side(firsts, "v"), side(firsts, "l")))


def fields_of(pairs: Column) -> Column:
    """The seven raw fields from labelled pairs."""
    return aligned(pairs)["v"]
