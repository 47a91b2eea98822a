"""Secret scans by one deterministic automaton for all rules.

The rules' expressions are compiled: syntax tree, Thompson NFA, subset
construction over byte classes, minimisation, transition array. The combined
automaton is that of all rules read backwards: it goes over every byte of a
text once, from its end, and is in an accepting state for a rule exactly where
a match of the rule begins. Taken from the left, each such place is the start
of a span unless an earlier span of the rule covers it, and the rule's own
automata, forwards over the span alone, give its end. So the work is linear in
the text, whatever is in it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches
from quaystone.session import table


@dataclass(frozen=True)
class Rule:
    """head, then the longest run of value bytes (a class, or empty); a match
    with fewer than least of them is consumed but dropped. Expressions know
    literals, classes, groups, |, ?, *, + and {m,n}; they are over ASCII."""

    kind: str
    head: str
    value: str
    least: int
    either_case: bool = False


# The rules of the base kinds, in their order, then the added ones.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
ADDED = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", 20),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0),
)
RULES = BASE + ADDED


class _Syntax:
    """A regular expression as a tree of ('set', bytes), ('cat', parts),
    ('or', parts), ('times', part, least, most or None)."""

    def __init__(self, text: str, either_case: bool):
        self.text, self.at, self.either_case = text, 0, either_case

    def parse(self) -> tuple:
        tree = self._either()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self) -> tuple:
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self) -> tuple:
        part = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                inside, _, _ = self.text[self.at :].partition("}")
                self.at += len(inside) + 1
                low, comma, high = inside.partition(",")
                part = ("times", part, int(low), int(high) if high else None if comma else int(low))
            else:
                part = ("times", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def _atom(self) -> tuple:
        c = self._peek()
        if c == "(":
            self.at += 1
            tree = self._either()
            self.at += 1
            return tree
        if c != "[":
            return ("set", self._cased({self._char()}))
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            found |= set(range(low, high + 1))
        self.at += 1
        return ("set", self._cased(set(range(128)) - found if negated else found))

    def _cased(self, found: set[int]) -> frozenset:
        if self.either_case:
            found = found | {ord(x) for c in found for x in (chr(c).lower(), chr(c).upper())}
        return frozenset(found)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Appends the tree after start; gives its last state."""
        if tree[0] == "set":
            end = self.state()
            middle = self.state()
            self.empty[start].append(middle)
            self.moves[middle] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(part, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """next[state, class of byte]. accepts: a bit a rule. Accepting states have
    the highest numbers, from first_accept; the start is 0 unless it accepts.
    The last class is no byte's: it leads to the start and stands between
    texts."""

    classes: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    first_accept: int
    dead: int
    start: int


def build(trees: list[tuple], search: bool) -> Automaton:
    """search: from any position, and each rule's thread ends with its first
    accept; else anchored at the start, with all longer matches."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        ends[nfa.add(tree, begin)] = i
    marks = np.zeros((256, 0), np.int8)
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    marks = np.array([[b in s for s in sets] for b in range(256)], np.int8).reshape(256, -1)
    _, sample, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes, n_classes = classes.ravel(), len(sample)
    steps: list[list[int]] = [[] for _ in nfa.moves]
    for s, m in enumerate(nfa.moves):
        if m:
            steps[s] = [c for c in range(n_classes) if int(sample[c]) in m[0]]

    @lru_cache(None)
    def closure(s: int) -> frozenset:
        found, todo = {s}, [s]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(x for x in found if nfa.moves[x] or x in ends)

    first = closure(start)
    number, order, table_rows, accepts = {first: 0}, [first], [], []
    at = 0
    while at < len(order):
        here = order[at]
        at += 1
        accepts.append(sum(1 << ends[s] for s in here if s in ends))
        targets: list[set] = [set(first) if search else set() for _ in range(n_classes)]
        for s in here:
            if nfa.moves[s] and not (search and s in ends):
                for c in steps[s]:
                    targets[c] |= closure(nfa.moves[s][1])
        row = []
        for t in targets:
            key = frozenset(t)
            if key not in number:
                number[key] = len(order)
                order.append(key)
            row.append(number[key])
        table_rows.append(row)
    return _minimised(classes, np.array(table_rows, np.int32), np.array(accepts, np.int64))


def _minimised(classes: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merges states no input tells apart, by refining the partition."""
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    n = group.max() + 1
    one = np.zeros(n, np.int64)
    one[group] = np.arange(len(group))
    order = np.lexsort((np.arange(n) != group[0], accepts[one] > 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    merged, acc = place[group[step[one[order]]]], accepts[one[order]]
    start = int(place[group[0]])
    merged = np.column_stack([merged, np.full(n, start)]).astype(np.int32)
    dead = [s for s in range(n) if not acc[s] and (merged[s, :-1] == s).all()]
    first_accept = int(np.searchsorted(acc > 0, True))
    return Automaton(classes.astype(np.uint8), merged, acc, first_accept, dead[0] if dead else -1, start)


def _backwards(tree: tuple) -> tuple:
    """The tree of the reversed texts."""
    if tree[0] == "set":
        return tree
    if tree[0] == "times":
        return ("times", _backwards(tree[1]), *tree[2:])
    parts = [_backwards(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


@lru_cache(4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, Automaton | None]]]:
    """The combined automaton, backwards, and each rule's own for head and
    value. A match begins where a head and one value byte do, or, of a rule
    without a head, where its least number of value bytes does."""
    heads = [_Syntax(r.head, r.either_case).parse() for r in rules]
    values = [_Syntax(r.value, r.either_case).parse() for r in rules]
    asked = [1 if r.head else max(1, r.least) for r in rules]
    whole = [("cat", [h, ("times", v, n, n)]) if r.value else h for r, h, v, n in zip(rules, heads, values, asked, strict=True)]
    own = [(build([h], False), build([("times", v, 1, None)], False) if r.value else None) for r, h, v in zip(rules, heads, values, strict=True)]
    return build([_backwards(x) for x in whole], True), own


LANES = 2048


def _run(auto: Automaton, classes: np.ndarray) -> np.ndarray:
    """The state after each symbol, from the start state. The input is cut in
    lanes that run side by side; a lane that should not have begun in the start
    state is run again until it meets the states it had."""
    n = len(classes)
    lanes = max(1, min(LANES, n // 64))
    depth = -(-n // lanes)
    padded = np.full(lanes * depth, auto.next.shape[1] - 1, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, depth).T)
    flat, width = auto.next.ravel(), auto.next.shape[1]
    out = np.empty((depth, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for k in range(depth):
        state = flat.take(state * width + columns[k])
        out[k] = state
    step = auto.next
    for lane in range(1, lanes):
        s = int(out[depth - 1, lane - 1])
        if s:
            for k in range(depth):
                s = int(step[s, columns[k, lane]])
                if s == out[k, lane]:
                    break
                out[k, lane] = s
    return out.T.ravel()[:n]


def _longest(auto: Automaton, steps: list, accept: int, data: bytes, at: int) -> int:
    """End of the longest match from at, or -1."""
    end = at if auto.start >= accept else -1
    state, classes, dead = auto.start, auto.classes, auto.dead
    for i in range(at, len(data)):
        state = steps[state][classes[data[i]]]
        if state == dead:
            break
        if state >= accept:
            end = i + 1
    return end


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all, own = compiled(rules)
        self.own = [[(a, [list(map(int, row)) for row in a.next], a.first_accept) if a else None for a in parts] for parts in own]

    def find(self, texts: pa.Array):
        """(row, text bytes, its spans by rule) of the texts that have any."""
        for c in textscan.chunks(texts):
            n = np.diff(c.offsets)
            classes = np.full(len(c.data) + c.n, self.all.next.shape[1] - 1, np.uint8)
            row = np.repeat(np.arange(c.n), n)
            classes[np.arange(len(c.data)) + row] = self.all.classes[c.data]
            state = _run(self.all, classes[::-1])[::-1]
            hit = np.flatnonzero(state >= self.all.first_accept)
            if not len(hit):
                continue
            begin = c.offsets[:-1] + np.arange(c.n)
            rows = np.searchsorted(begin, hit, "right") - 1
            which = self.all.accepts[state[hit]]
            edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            for a, b in zip(edge, np.append(edge[1:], len(hit)), strict=True):
                i = int(rows[a])
                data = c.data[c.offsets[i] : c.offsets[i + 1]]
                yield c.first + i, data, [list(self._spans(data.tobytes(), k, hit[a:b][which[a:b] >> k & 1 > 0] - begin[i])) for k in range(len(self.rules))]

    def _spans(self, raw: bytes, k: int, starts: np.ndarray):
        """(start, end) in bytes of rule k's matches, leftmost and apart, from
        the places where one begins; those with too few value bytes drop."""
        head, value = self.own[k]
        at, i = 0, 0
        while i < len(starts):
            s = int(starts[i])
            mid = _longest(*head, raw, s)
            end = _longest(*value, raw, mid) if value and mid >= 0 else mid
            at = max(end, s + 1)
            if end >= 0 and (not value or end > mid) and end - mid >= self.rules[k].least:
                yield s, end
            i = int(np.searchsorted(starts, at))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _finder(rules: tuple[Rule, ...]):
    @F.arrow_udf(_SPANS)
    def find(texts: pa.Array) -> pa.Array:
        scanner = _scanner(rules)
        found: list[list] = [[] for _ in range(len(texts))]
        for row, data, spans in scanner.find(texts):
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            held = [(int(points[a]), k, int(points[b])) for k, each in enumerate(spans) for a, b in each]
            found[row] = [{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(held)]
        return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return find


_scanners: dict = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One scanner a Python worker."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with found: its secrets as an array of (kind, start, end), in code
    points, end exclusive, by start, then the rules' order.

    A null or empty text has none; a text of any length is scanned whole.
    Repeated rows are scanned each; an empty table gives an empty result; a
    column of docs named found is replaced.
    """
    bounded_batches(docs.sparkSession)
    return docs.withColumn("found", _finder(rules)(F.coalesce("text", F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(*base)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
