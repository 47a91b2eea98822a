"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct 5-word shingles. Equal sets are one node from
the start. Tokens (48-bit shingle hashes) are ordered by the number of sets
that hold them, rarest first, and a set of n tokens is indexed under its first
n - ceil(0.8 n) + l tokens; two sets linked at 0.8 share at least min(l, l')
tokens of those prefixes. Each set picks the l with the least estimated cost:
postings to scan, plus candidates to verify, which fall with l.

How it is laid out:

* Token counts come from one shuffle of packed token arrays. A token that many
  sets of one map task share is sent as a marker, not as postings, so no key
  gathers a third of all rows. Only tokens held twice or more go back to their
  sets, and a set with over 20 % tokens of its own leaves at once.
* Tokens below HOT sets give candidate pairs directly, at most HOT / 2 a
  posting, kept if they share enough prefix tokens. Hot tokens tie their sets
  to one hub. Connected candidates form clusters.
* A cluster is verified in sub-blocks, two at a time, so a large
  one is many tasks. Inside, sets are compared through inverted indexes, first
  on prefixes, then, where enough prefix tokens match, on whole sets. Out come
  link counts and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches, connected_components, small, width, written
from quaystone.llm.textscan import distinct, mix
from quaystone.session import table

SHINGLE = 5
PERCENT = 80
HOT = 32
#: Sets of a sub-block: the root of SPREAD times the cluster's, within bounds.
#: Larger ones move less (a set goes to as many tasks as there are sub-blocks),
#: smaller ones spread a cluster over more tasks.
BLOCK = (128, 1024)
SPREAD = 16
FLUSH = 1_000_000
#: Postings that a token partition takes before it tells those of hot tokens.
SETTLE = 8_000_000
#: Tokens of a partition of the token and the set exchange, at most.
TOKENS_A_PART = 4_000_000
MATCHES = (1, 2, 3, 4, 6, 8)
#: Cost of verifying a candidate, in scanned postings, for each token of the set.
VERIFY = 0.05

_U = np.uint64
_PACKED = "part int, kind int, a binary, b binary, c binary, d binary"


def signature(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    a, b = tokens.sum(keepdims=True), mix(tokens ^ _U(0xD6E8FEB86659FD93)).sum(keepdims=True)
    return int(mix(a * _U(0x9E3779B97F4A7C15) + b + _U(len(tokens))).view(np.int64)[0])


def _least(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n): tokens that a set of n shares with any set it links with."""
    return -((-PERCENT * n) // 100)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set: its size and signature; hash, of the text, stays."""
    for batch in batches:
        sig, n = [], []
        for _, tokens in textscan.shingle_sets(batch["text"], SHINGLE):
            n.append(len(tokens))
            sig.append(signature(tokens) if len(tokens) else None)
        yield pa.record_batch([batch["doc_id"], batch["hash"], pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "hash", "n", "sig"])


def _pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _join(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(x)))


def _rows(part: list, kind: list, *blobs: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], ["part", "kind", "a", "b", "c", "d"])


def _send(out: tuple, kind: int, parts: np.ndarray, a, b, c, d) -> None:
    """Appends a row for each run of parts; a..d give a blob for a slice."""
    start, n = _runs(parts)
    for s, m in zip(start, n, strict=True):
        cut = slice(s, s + m)
        for column, value in zip(out, (int(parts[s]), kind, a(cut), b(cut), c(cut), d(cut)), strict=True):
            column.append(value)


def _none(_: slice) -> bytes:
    return b""


def _postings(n_parts: int):
    """Packs the sets' tokens by token: kind 0, (tokens, sets, tokens a set);
    tokens that HOT sets of a flush share: kind 1, the token alone; and each
    set's size and such tokens, by set: kind 2."""

    def flush(toks: list, sigs: list) -> pa.RecordBatch:
        n = np.array([len(x) for x in toks])
        tok, doc = np.concatenate(toks), np.repeat(np.arange(len(toks)), n)
        sig = np.array(sigs, np.int64)
        order = np.argsort(tok, kind="stable")
        start, count = _runs(tok[order])
        hot = np.empty(len(tok), bool)
        hot[order] = np.repeat(count >= HOT, count)
        out: tuple = ([], [], [], [], [], [])
        mark = tok[order][start[count >= HOT]]
        mark = mark[np.argsort(mark % _U(n_parts), kind="stable")]
        _send(out, 1, mark % _U(n_parts), lambda c: _pack48(mark[c]), _none, _none, _none)
        t, d = tok[~hot], doc[~hot]
        by = np.lexsort((d, t % _U(n_parts)))
        t, d = t[by], d[by]

        def held(c: slice) -> tuple[np.ndarray, np.ndarray]:
            s, m = _runs(d[c])
            while len(m) and m.max() > 65535:  # a set may come twice
                big = np.flatnonzero(m > 65535)
                s, m = np.insert(s, big + 1, s[big]), np.insert(m, big + 1, m[big] - 65535)
                m[big + np.arange(len(big))] = 65535
            return sig[d[c][s]], m

        _send(out, 0, t % _U(n_parts), lambda c: _pack48(t[c]), lambda c: held(c)[0].tobytes(), lambda c: held(c)[1].astype("<u2").tobytes(), _none)
        ht, hd = tok[hot], doc[hot]
        ends = np.searchsorted(hd, np.arange(len(toks) + 1))
        home = (sig.view(np.uint64) % _U(n_parts)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        _send(
            out,
            2,
            home[by],
            lambda c: sig[by[c]].tobytes(),
            lambda c: n[by[c]].astype("<i4").tobytes(),
            lambda c: np.diff(ends)[by[c]].astype("<i4").tobytes(),
            lambda c: b"".join(_pack48(ht[ends[i] : ends[i + 1]]) for i in by[c]),
        )
        return _rows(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        toks, sigs, held = [], [], 0
        for batch in batches:
            for _, tokens in textscan.shingle_sets(batch["text"], SHINGLE):
                if not len(tokens) or (s := signature(tokens)) in seen:
                    continue
                seen.add(s)
                toks.append(distinct(tokens >> _U(16)))
                sigs.append(s)
                held += len(tokens)
                if held >= FLUSH:
                    yield flush(toks, sigs)
                    toks, sigs, held = [], [], 0
        if toks:
            yield flush(toks, sigs)

    return run


def _counted(n_parts: int):
    """Token partition: how many sets hold each token, told to those sets when
    two or more do. Rows of kind 2 pass through. Postings are settled whenever
    SETTLE of them have come: those of a token that is known to be hot are told
    at once and only the token is kept, so a token that very many flushes send
    takes no room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple = ([], [], [], [])
        tok, sig, mark = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        came = 0

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal tok, sig, mark, came
            tok = np.concatenate([tok, _unpack48(parts[0])])
            sig = np.concatenate([sig, np.repeat(_join(parts[1], "<i8"), _join(parts[2], "<u2"))])
            mark = np.union1d(mark, _unpack48(parts[3]))
            for x in parts:
                x.clear()
            order = np.lexsort((sig, tok))
            tok, sig = tok[order], sig[order]
            new = np.append(True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1]))[: len(tok)]
            tok, sig = tok[new], sig[new]
            start, count = _runs(tok)
            hot = np.isin(tok[start], mark) | (count >= HOT)
            mark = np.union1d(mark, tok[start[hot]])
            df, hot = np.repeat(np.where(hot, HOT, count), count), np.repeat(hot, count)
            tells = hot | ((df > 1) & last)
            home = (sig[tells].view(np.uint64) % _U(n_parts)).astype(np.int64)
            by = np.flatnonzero(tells)[np.argsort(home, kind="stable")]
            out: tuple = ([], [], [], [], [], [])
            _send(out, 0, np.sort(home), lambda c: sig[by[c]].tobytes(), lambda c: _pack48(tok[by[c]]), lambda c: df[by[c]].astype(np.uint8).tobytes(), _none)
            if out[0]:
                yield _rows(*out)
            tok, sig, came = tok[~hot], sig[~hot], 0

        for batch in batches:
            kind = batch["kind"].to_numpy(zero_copy_only=False)
            if (kind == 2).any():
                yield batch.filter(pa.array(kind == 2))
            for i in np.flatnonzero(kind < 2):
                row = [batch[c][i].as_py() for c in "abc"]
                if kind[i]:
                    parts[3].append(row[0])
                else:
                    for held, x in zip(parts, row, strict=False):
                        held.append(x)
                    came += len(row[0]) // 6
            if came >= SETTLE:
                yield from settled(False)
        yield from settled(True)

    return run


_PREFIX = "tok long, sig long, df int, n int, l int, n_hot int, n_light int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set partition: picks each set's l and gives its prefix."""
    heads: tuple = ([], [], [], [])
    told: tuple = ([], [], [])
    for batch in batches:
        for kind, *row in zip(*[batch[c].to_pylist() for c in ("kind", "a", "b", "c", "d")], strict=True):
            for held, x in zip(heads if kind == 2 else told, row, strict=False):
                held.append(x)
    hs, hn, hc = _join(heads[0], "<i8"), _join(heads[1], "<i4"), _join(heads[2], "<i4")
    if not len(hs):
        return
    ht = _unpack48(heads[3])
    sig = np.concatenate([_join(told[0], "<i8"), np.repeat(hs, hc)])
    tok = np.concatenate([_unpack48(told[1]), ht])
    df = np.concatenate([_join(told[2], "u1").astype(np.int64), np.full(len(ht), HOT)])
    order = np.lexsort((tok, df, sig))
    sig, tok, df = sig[order], tok[order], df[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (tok[1:] != tok[:-1]))[: len(sig)]
    sig, tok, df = sig[new], tok[new], df[new]
    start, m = _runs(sig)
    us, first = np.unique(hs, return_index=True)
    n = hn[first][np.searchsorted(us, sig[start])].astype(np.int64)
    least = _least(n)
    cost = np.append(0, np.cumsum(df - 1))
    own = n - m  # tokens no other set holds: the rarest, so first in the order
    best, pick, reach = np.full(len(n), np.inf), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    for ell in MATCHES:
        r = np.clip(n - least + ell - own, 0, m)
        scanned = cost[start + r] - cost[start]
        total = scanned * (1 + VERIFY * n / ell)
        better = (total < best) & (ell <= least)
        best[better], pick[better], reach[better] = total[better], ell, r[better]
    reach[n - least + 1 - own <= 0] = 0
    inside = np.arange(len(sig)) - np.repeat(start, m) < np.repeat(reach, m)
    hot = np.add.reduceat(inside & (df >= HOT), start) if len(start) else m
    x = [tok.astype(np.int64), sig, df, np.repeat(n, m), np.repeat(pick, m), np.repeat(hot, m), np.repeat(reach - hot, m)]
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
    yield pa.record_batch([pa.array(v[inside], k) for v, k in zip(x, kinds, strict=True)], ["tok", "sig", "df", "n", "l", "n_hot", "n_light"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the light tokens of one partition, with the number of
    tokens they share there and the number they need."""
    batches = list(batches)
    if not sum(b.num_rows for b in batches):
        return
    t = pa.Table.from_batches(batches)
    tok, sig, n, ell, hot = (t[c].to_numpy() for c in ("tok", "sig", "n", "l", "n_hot"))
    order = np.lexsort((sig, tok))
    tok, sig, n, ell, hot = tok[order], sig[order], n[order].astype(np.int64), ell[order], hot[order]
    a, b, need = [], [], []
    for k in range(1, HOT):
        i = np.flatnonzero(tok[k:] == tok[:-k])
        if not len(i):
            break
        j = i + k
        fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        a.append(sig[i])
        b.append(sig[j])
        need.append(np.minimum(ell[i], ell[j]) - np.minimum(hot[i], hot[j]))
    if not a:
        return
    a, b, need = np.concatenate(a), np.concatenate(b), np.concatenate(need)
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    yield pa.record_batch([pa.array(x) for x in (a[start], b[start], np.diff(np.append(start, len(a))).astype(np.int64), need[start].astype(np.int64))], ["src", "dst", "shared", "need"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, once a task; drops texts with another set."""
    seen: set[int] = set()
    for batch in batches:
        sig = batch["sig"].to_pylist()
        new = [i for i, x in enumerate(sig) if x not in seen and not seen.add(x)]
        batch, sig = batch.take(pa.array(new, pa.int64())), [sig[i] for i in new]
        keep, tokens = [], []
        for i, x in textscan.shingle_sets(batch["text"], SHINGLE):
            keep.append(len(x) > 0 and signature(x) == sig[i])
            tokens.append(x.tobytes() if keep[-1] else None)
            if not keep[-1]:
                seen.discard(sig[i])  # another text with the same hash
        out = batch.drop_columns(["text"]).append_column("tokens", pa.array(tokens, pa.binary()))
        yield out.filter(pa.array(keep, pa.bool_()))


class _Index:
    """Sets by token: how many tokens of a set each other set holds."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(x) for x in sets])
        tok, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tok, kind="stable")
        start, count = _runs(tok[order])
        which = np.empty(len(tok), np.int64)
        which[order] = np.repeat(np.arange(len(start)), count)
        self.docs, self.start, self.count = doc[order], start, count
        self.which, self.at, self.m = which, np.append(0, np.cumsum(n)), len(sets)

    def shared(self, i: int) -> np.ndarray:
        w = self.which[self.at[i] : self.at[i + 1]]
        w = w[self.count[w] > 1]
        c = self.count[w]
        end = np.cumsum(c)
        if not len(end):
            return np.zeros(self.m, np.int64)
        return np.bincount(self.docs[np.arange(end[-1]) + np.repeat(self.start[w] - end + c, c)], minlength=self.m)


_FOUND = "a long, b long, links long"


def _verified(key: tuple, group: pa.Table) -> pa.Table:
    """All clusters of one task: a spanning forest of the links (a, b) and the
    copies that each set links with (a, null, links)."""
    out_a, out_b, out_n = [], [], []
    comp = group["comp"].to_numpy()
    order = np.argsort(comp, kind="stable")
    start, m = _runs(comp[order])
    for s, k in zip(start, m, strict=True):
        if k < 2:
            continue
        rows = group.take(pa.array(order[s : s + k]))
        sig = rows["sig"].to_numpy()
        _, once = np.unique(sig, return_index=True)
        rows, sig = rows.take(pa.array(once)), sig[once]
        block, pair = rows["block"].to_numpy(), rows["bi"].to_numpy()[0] != rows["bj"].to_numpy()[0]
        copies, ell = rows["copies"].to_numpy(), rows["l"].to_numpy()
        whole = [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
        n = np.array([len(x) for x in whole])
        early, full = _Index([np.frombuffer(x, np.int64) for x in rows["prefix"].to_pylist()]), _Index(whole)
        links, root = np.zeros(len(sig), np.int64), np.arange(len(sig))

        def top(x: int, root=root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(sig) - 1):
            might = early.shared(i) >= np.minimum(ell, ell[i])
            might[: i + 1] = False
            if pair:
                might &= block != block[i]
            might &= 100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])
            if not might.any():
                continue
            both = full.shared(i)
            js = np.flatnonzero(might & (100 * both >= PERCENT * (n + n[i] - both)))
            links[i] += copies[js].sum()
            links[js] += copies[i]
            for j in js:
                p, q = top(i), top(j)
                if p != q:
                    root[q] = p
                    out_a.append(int(sig[i]))
                    out_b.append(int(sig[j]))
                    out_n.append(0)
        for i in np.flatnonzero(links):
            out_a.append(int(sig[i]))
            out_b.append(None)
            out_n.append(int(links[i]))
    return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["a", "b", "links"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents it links with,
    copies included) of each row of docs (doc_id, text).

    A null or wordless text has no shingles, links with nothing and is its own
    component. Rows with equal sets link. A null doc_id is carried along and
    never names a component unless no other id is there. Repeated rows come
    back as often as they were given; a text of any length is taken whole; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    signed = written(docs.mapInArrow(_signed, "doc_id long, hash long, n long, sig long"), "signed")
    grouped = signed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("hash").alias("hash"), F.count("*").alias("copies"), F.first("n").alias("n"))
    sets = written(grouped, "sets")
    parts = width(spark, sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], TOKENS_A_PART)

    packed = docs.select("text").mapInArrow(_postings(parts), _PACKED).repartitionById(parts, "part")
    told = packed.mapInArrow(_counted(parts), _PACKED).repartitionById(parts, "part")
    prefix = written(told.mapInArrow(_prefixes, _PREFIX), "prefix")

    light = prefix.where(F.col("df") < HOT).select("tok", "sig", "n", "l", "n_hot").repartition(parts, "tok")
    pairs = light.mapInArrow(_pairs, "src long, dst long, shared long, need long").groupBy("src", "dst").agg(F.sum("shared").alias("shared"), F.first("need").alias("need"))
    hot = prefix.where(F.col("df") >= HOT).select("tok", "sig")
    hubs = written(hot.groupBy("tok").agg(F.min("sig").alias("hub")), "hubs")
    tied = hot.join(hubs, "tok").select(F.col("sig").alias("src"), F.col("hub").alias("dst")).distinct()
    cluster = connected_components(pairs.where("shared >= need").select("src", "dst").union(tied)).select(F.col("node").alias("sig"), F.col("component").alias("comp"))

    sizes = cluster.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1")
    blocked = cluster.join(sizes, "comp").withColumn("blocks", F.ceil(F.col("size") / F.least(F.lit(BLOCK[1]), F.greatest(F.lit(BLOCK[0]), F.sqrt(F.col("size") * SPREAD)))).cast("int"))
    own = prefix.groupBy("sig").agg(F.collect_list("tok").alias("prefix"), F.first("l").alias("l"))
    members = written(blocked.join(sets, "sig").join(own, "sig"), "members")
    n_members = members.count()
    # by the hash of one of the set's texts; a text of many rows is one set a task, then one in all
    text = docs.select("hash", "text").join(small(members.select("hash", "sig")), "hash").select("sig", "text")
    whole = text.mapInArrow(_tokens, "sig long, tokens binary").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    tasks = max(parts, n_members // 512)
    spread = (
        members.join(whole, "sig")
        .withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.xxhash64("comp", "bi", "bj")))
        .mapInArrow(_prefix_bytes, "comp long, sig long, copies long, l int, block int, bi int, bj int, task long, prefix binary, tokens binary")
    )
    found = written(spread.groupBy("task", "bi", "bj").applyInArrow(_verified, _FOUND), "found")

    linked = connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = sets.join(linked, sets["sig"] == linked["node"], "left").select("sig", "rep", "copies", F.coalesce("component", "sig").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    degree = found.where("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links"))
    final = written(labelled.join(least, "label").join(degree, "sig", "left").select("sig", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "final")
    return signed.where("n > 0").join(final, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(
        signed.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id"), F.lit(0).cast("long"))
    )


def _prefix_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["comp", "sig", "copies", "l", "block", "bi", "bj", "task"]
    for batch in batches:
        lists = batch["prefix"]
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        packed = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([*[batch[c] for c in names], pa.array(packed, pa.binary()), batch["tokens"]], [*names, "prefix", "tokens"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
