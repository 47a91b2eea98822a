"""Labelled lines of text documents, a whole Arrow batch at a time.

What a line is depends on its own look and on what the line before it turned
out to be, nothing else, so an automaton with four states reads any text in one
pass. Looks, labels and values are found for all lines of a batch at once.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))
BLANKS = " \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"

#: What a line is: no part of a pair, a label without or with a value, more of the value above.
NOTHING, BARE, FULL, MORE = range(4)
#: After each of those, what the next line is by its look: blank; indented with colon and value, with colon alone,
#: without colon; at the margin with colon and value, with colon alone, without colon.
AFTER = {
    NOTHING: (NOTHING, FULL, BARE, NOTHING, FULL, BARE, NOTHING),
    BARE: (NOTHING, MORE, MORE, MORE, FULL, BARE, MORE),
    FULL: (NOTHING, MORE, MORE, MORE, FULL, BARE, NOTHING),
}
AFTER[MORE] = AFTER[FULL]


def _trimmed(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, BLANKS)


def _looks(lines: pa.Array, core: pa.Array, colon: np.ndarray, value: pa.Array) -> np.ndarray:
    length = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False)
    indented = length(pc.utf8_ltrim(lines, BLANKS)) < length(lines)
    look = np.where(colon < 0, 3, np.where(length(value) > 0, 1, 2)) + np.where(indented, 0, 3)
    return np.where(length(core) == 0, 0, look)


def _joined(pieces: pa.Array, starts: np.ndarray) -> pa.Array:
    """Runs of pieces, each from one start to the next, by line ends."""
    ends = pa.array(np.append(starts, len(pieces)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, pieces), "\n")


def pairs_in(texts: pa.Array) -> pa.Array:
    """The pairs (label, value) of each text, as a list; of null, null."""
    # a blank line before each text closes what the text before it left open
    lists = pc.split_pattern(pc.binary_join_element_wise("", pc.fill_null(texts, ""), "\n"), "\n")
    lines, text_of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    core = _trimmed(lines)
    colon = pc.find_substring(core, ":").to_numpy(zero_copy_only=False)  # in bytes
    parts = pc.split_pattern(core, ":", max_splits=1)
    value = _trimmed(pc.fill_null(pc.list_element(pc.if_else(pa.array(colon >= 0), parts, pa.scalar(["", ""], parts.type)), 1), ""))
    state = np.fromiter(accumulate(_looks(lines, core, colon, value).tolist(), lambda s, look: AFTER[s][look], initial=NOTHING), np.int8, len(lines) + 1)[1:]
    label_at = np.flatnonzero((state == BARE) | (state == FULL))
    # pieces of values: a bare label brings none of its own unless nothing follows
    follows = np.append(state[1:], NOTHING) == MORE
    piece = (state == FULL) | (state == MORE) | ((state == BARE) & ~follows)
    at = pa.array(np.flatnonzero(piece))
    pieces = pc.if_else(pa.array(state[piece] == MORE), core.take(at), value.take(at))
    # the first piece of a label: its own line's, or the line's after a bare one
    first = np.cumsum(piece)[label_at] - piece[label_at]
    labels = _trimmed(pc.list_element(parts.take(pa.array(label_at)), 0))
    pairs = pa.StructArray.from_arrays([labels, _joined(pieces, first)], ["label", "value"])
    per_text = np.append(0, np.cumsum(np.bincount(text_of[label_at], minlength=len(texts)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per_text), pairs, mask=pc.is_null(texts))


@F.arrow_udf(PAIRS)
def txt_pairs(texts: pa.Array) -> pa.Array:
    """Pairs of "label: value" lines, in order. An indented line, or a line
    without colon right under an empty value, continues the last value; a blank
    line ends it, as does any other. Linear in the text, whatever is in it."""
    return pairs_in(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
