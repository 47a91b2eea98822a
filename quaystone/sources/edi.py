"""X12 304 messages as title and labelled pairs, one pass over the segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.fields import EDI_POUNDS_A_KG
from quaystone.sources.lines import PAIRS

# N1 qualifiers of each party, the preferred first; R4 qualifiers of each port; the code of a shipping instruction.
EDI_PARTIES = {"shipper": ("SF", "SH", "EX"), "consignee": ("CN", "UC", "ST"), "notify party": ("N1", "NP", "N2")}
EDI_PORTS = {"port of loading": "L", "port of discharge": "D"}
INSTRUCTION = "304"
DOCUMENT = T.StructType([T.StructField("title", T.StringType()), T.StructField("pairs", PAIRS)])


def segments(text: str) -> Iterator[list[str]]:
    """The segments of an interchange, each its elements without blanks at
    their ends.

    The header tells its marks: the character after ISA parts elements, and
    the 106th of a padded header ends segments. Of an unpadded one the first
    tilde or line end does, and without a header an asterisk and a tilde. Line
    ends inside segments are no part of them, and lines that begin with a hash
    mark are comments.
    """
    if "#" in text:
        text = "\n".join(line for line in text.split("\n") if line.lstrip()[:1] != "#")
    head = text.find("ISA")
    apart, end = "*", "~"
    if 0 <= head < len(text) - 3:
        apart, end = text[head + 3], text[head + 105 : head + 106]
        if not end or end.isalnum() or end == apart:
            places = [p for p in (text.find(mark, head) for mark in "~\n\r") if p >= 0]
            end = text[min(places)] if places else "~"
    if end != "\n":
        text = text.replace("\n", "")
    for segment in text.split(end):
        if segment and not segment.isspace():
            yield [e.strip() for e in segment.strip().split(apart)]


def read(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """Title and pairs of a message; of a field that is not there, no pair. A
    port is its code, with a name beside it if there is one; weights count if
    they are gross, in pounds if they say so."""
    kind, named, ports, boxes, kg = None, {}, {}, 0, 0.0
    for tag, *rest in segments(text):
        at = dict(enumerate(rest, 1)).get
        if tag == "ST" and kind is None:
            kind = at(1, "")
        elif tag == "N1":
            named[at(1, "")] = at(2, "")
        elif tag == "R4" and at(3):
            ports.setdefault(at(1), f"{at(4)} ({at(3)})" if at(4) else at(3))
        elif tag == "N7":
            boxes += 1
        elif tag == "L0" and at(5) == "G" and at(4, "").replace(".", "").isdecimal() and at(4).count(".") < 2:
            kg += float(at(4)) / (EDI_POUNDS_A_KG if at(11) == "L" else 1)
    values = {label: next(filter(None, map(named.get, codes)), None) for label, codes in EDI_PARTIES.items()}
    values |= {label: ports.get(code) for label, code in EDI_PORTS.items()}
    values |= {"containers": str(boxes) if boxes else None, "gross weight": f"{kg:,.0f} KG" if kg else None}
    return "SHIPPING INSTRUCTION" if kind == INSTRUCTION else None, [(k, v) for k, v in values.items() if v]


@F.arrow_udf(DOCUMENT)
def edi_document(texts: pa.Array) -> pa.Array:
    """Struct (title, pairs) of each message; of null, no title and no pairs."""
    found = [read(t) if t is not None else (None, []) for t in texts.to_pylist()]
    flat = [pair for _, pairs in found for pair in pairs]
    ends = [0]
    for _, pairs in found:
        ends.append(ends[-1] + len(pairs))
    both = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], ["label", "value"])
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)], ["title", "pairs"])
