"""Texts cut into chunks that end, where they can, between paragraphs, lines or
words.

A cut is a place in the text, so a chunk is a span, and nothing is copied
before the spans are known. At each level the text is cut before every
separator; pieces short enough are gathered in spans as long as the size
allows, each beginning with as much of the one before as the overlap allows;
longer ones are cut at the next level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 1000
OVERLAP = 200
#: Paragraph, line, word; below them single characters.
SEPARATORS = ("\n\n", "\n", " ")


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """start, each place in between where a separator begins, end."""
    out = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > start:
            out.append(at)
        at = text.find(separator, at + len(separator), end)
    return [*out, end]


def _gathered(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of adjoining pieces between cuts, no longer than size; the next
    one goes back over whole pieces within the overlap."""
    first = 0
    for i, (begin, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if end - cuts[first] > size:
            if i > first:
                yield cuts[first], begin
            while begin - cuts[first] > overlap or (end - cuts[first] > size and begin > cuts[first]):
                first += 1
    yield cuts[first], cuts[-1]


def _within(text: str, start: int, end: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    if level == len(SEPARATORS):  # single characters: a plain stride
        while end - start > size:
            yield start, start + size
            start += size - overlap
        yield start, end
        return
    cuts = _cuts(text, start, end, SEPARATORS[level])
    short: list[int] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < size:
            short += [b] if short else [a, b]
            continue
        if short:
            yield from _gathered(short, size, overlap)
            short = []
        yield from _within(text, a, b, level + 1, size, overlap)
    if short:
        yield from _gathered(short, size, overlap)


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """The spans of a text's chunks, in order, blanks at their ends included."""
    return _within(text, 0, len(text), 0, size, overlap) if text else iter(())


def chunks_of(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text without blanks at their ends, none empty, each
    once, in order."""
    found = (text[a:b].strip() for a, b in spans(text, size, overlap))
    return list(dict.fromkeys(x for x in found if x))


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """chunks_of of a column; null of null."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else chunks_of(t, size, overlap) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)
