"""Centroids, vector codes and fingerprints against brute force, with nulls,
bad and odd vectors, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from quaystone.llm import centroid_blocks, registry, simhash, vector_codes
from quaystone.llm.vectors import LARGEST
from quaystone.session import table

SCHEMA = "vec_id long, embedding array<float>, label int, id int, code string, n int, kept int, cluster string"


def rows_of(seed: int, n: int, dims: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dims)], r.choice([0, 1, None]), 1, "c", 2, 3, "x") for i in range(n)]
    rows += [rows[5], rows[5], (None, rows[7][1], None, 1, "c", 2, 3, "x"), (n + 1, rows[2][1], 1, 1, "c", 2, 3, "x")]
    bad = [None, [], [0.5] * (dims - 1), [None, *[0.1] * (dims - 1)], [math.nan, *[0.1] * (dims - 1)], [*[0.1] * (dims - 1), math.inf]]
    return rows + [(1000 + i, x, 0, 1, "c", 2, 3, "x") for i, x in enumerate(bad)]


def integers(x, scale):
    return [math.floor(float(np.float32(c)) * scale) for c in x]


def whole(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def near(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in book]
    return d.index(min(d)), min(d)


def moved(book, members):
    return [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := members[i]) else list(b) for i, b in enumerate(book)]


def test_clusters_are_brute_force(spark):
    rows = rows_of(1, 300, 64)
    kept = [(r[0], integers(r[1], 64)) for r in rows if whole(r[1]) and len(r[1]) == 64]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(x, "<i4").tobytes(), x) for i, x in kept if i is not None)
    book = [x for _, _, x in first[:16]]
    for _ in range(3):
        at = [near(x, book)[0] for _, x in kept]
        book = moved(book, [[x for (_, x), a in zip(kept, at, strict=True) if a == c] for c in range(16)])
    got, centroids = centroid_blocks.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert centroids.tolist() == book
    assert sorted(map(str, ((r["id"], r["cluster"], r["distance"]) for r in got.collect()))) == sorted(str((i, *near(x, book))) for i, x in kept)


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame(rows_of(2, 10, 64), SCHEMA)
    got, centroids = centroid_blocks.cluster(df.where("vec_id < 3"))
    assert got.count() == 3 and len(centroids) == 3
    assert centroid_blocks.cluster(df.where("vec_id >= 1000"))[0].count() == 0
    assert centroid_blocks.cluster(df.limit(0))[0].columns == got.columns
    with pytest.raises(ValueError, match="no vector has an id"):
        centroid_blocks.cluster(df.where("vec_id is null"))


def test_boxes_keep_the_nearest():
    r = np.random.default_rng(3)
    dropped = 0
    for spread in (2, 10, 60):
        for _ in range(60):
            c = r.integers(-40, 40, (16, 8))
            x = r.integers(-40, 40, 8) + r.integers(-spread, spread, (50, 8))
            among = centroid_blocks.candidates(x.min(axis=0), x.max(axis=0), c)
            a, b = centroid_blocks.nearest(x, c, among), centroid_blocks.nearest(x, c, np.arange(16))
            assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
            dropped += 16 - len(among)
    assert dropped > 500
    far = np.array([[1 << 26] * 8, [-(1 << 26)] * 8])
    assert centroid_blocks.nearest(far, far[:1] + 1, np.array([0]))[1].tolist() == [8, 8 * ((1 << 27) + 1) ** 2]


def test_blocks_of_groups_have_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(centroid_blocks, "BLOCK", 32)
    r = np.random.default_rng(8)
    middle = r.uniform(-1, 1, (12, 64))
    x = middle[r.integers(0, 12, 3000)] + r.normal(0, 0.02, (3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows, centroids = centroid_blocks.cluster(df)
    got = rows.collect()
    codes = np.floor(x * 64).astype(np.int64)
    d = ((codes[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert all(d[r["id"]].min() == r["distance"] and d[r["id"]].argmin() == r["cluster"] for r in got) and len(got) == 3000
    assert np.mean([r["candidates"] for r in got]) < 5


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours_in_turn(dims, bits):
    cells = np.array([[i >> (bits * j) & ((1 << bits) - 1) for j in range(dims)] for i in range(1 << (bits * dims))])
    keys = [bytes(k) for k in centroid_blocks.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(keys)
    walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_codes_are_brute_force(spark):
    rows = rows_of(4, 150, 64)
    kept = [(r[0], r[2], integers(r[1], 256)) for r in rows if whole(r[1]) and len(r[1]) == 64]
    first = sorted((i, np.array(x, "<i4").tobytes(), x) for i, _, x in kept if i is not None)[:64]
    books = [[x[4 * p : 4 * p + 4] for _, _, x in first] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            cut = [x[4 * p : 4 * p + 4] for _, _, x in kept]
            at = [near(x, books[p])[0] for x in cut]
            books[p] = moved(books[p], [[x for x, a in zip(cut, at, strict=True) if a == e] for e in range(64)])
    want = []
    for i, label, x in kept:
        found = [near(x[4 * p : 4 * p + 4], books[p]) for p in range(16)]
        want.append((i, label, bytes(e for e, _ in found).hex(), sum(d for _, d in found)))
    want += [(r[0], r[2], None, None) for r in rows if whole(r[1]) and len(r[1]) != 64]
    got, found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.tolist() == books
    assert sorted(map(str, want)) == sorted(str((r["id"], r["label"], r["code"] and r["code"].hex(), r["error"])) for r in got.collect())


def test_codes_of_few_and_none(spark):
    df = spark.createDataFrame(rows_of(5, 10, 64), SCHEMA)
    assert [r["error"] for r in vector_codes.compress(df.where("vec_id < 3"))[0].collect()] == [0, 0, 0]
    assert vector_codes.compress(df.where("embedding is null"))[0].count() == 0
    assert vector_codes.compress(df.limit(0), keep=("label", "code", "n"))[0].count() == 0
    assert vector_codes.compress(df.where("vec_id < 3"), keep=("n", "kept", "cluster"))[0].select("n", "kept", "cluster").distinct().count() == 1
    with pytest.raises(ValueError, match="no vector has an id"):
        vector_codes.compress(df.where("vec_id is null"))
    with pytest.raises(Exception, match="do not fit a long"):
        vector_codes.compress(spark.createDataFrame([(1, [float(LARGEST)] * 16)], "vec_id long, embedding array<double>"), keep=())


def test_pivots_prune_and_lose_nothing():
    r = np.random.default_rng(6)
    for size in (3, 40, 100_000):
        x, book = r.integers(-size, size, (500, 4)), r.integers(-size, size, (64, 4))
        book[9] = book[3]  # a tie
        pivots = vector_codes.pivots_of(book)
        entry, d, evaluated = vector_codes.nearest(x, vector_codes.distances(x, pivots).astype("<f4").astype(float), book, pivots)
        full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    assert evaluated < 0.4 * full.size


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes"])
def test_vector_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.execute(registry.ORACLES[name]).df().sort_values("vec_id", ignore_index=True)
    got = registry.QUERIES[name](spark, data).toPandas()[want.columns].sort_values("vec_id", ignore_index=True)
    assert got.astype(str).equals(want.astype(str))


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    of = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in of]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(fps)))
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    least = {}
    for (i, _), c in zip(fps, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(str((i, f"{fp:016x}", least.get(c))) for (i, fp), c in zip(fps, label, strict=True))


def test_fingerprints_are_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    r = random.Random(7)
    base = " ".join(r.choice("lorem ipsum dolor sit amet elit sed do".split()) + str(r.randrange(50)) for _ in range(900))
    rows += [(1000 + i, base + f" edit{i}") for i in range(40)]
    rows += [(None, None), (2000, None), (2001, ""), (2002, "\x0b \t"), (None, "lonely words without id here"), (2003, "One"), (2004, "one two"), (2005, "ONE\ttwo"), (2005, "ONE\ttwo"), (2006, "É é " * 5), (2007, "x" * 200_000), (2008, "w " * 150_000)]
    df = spark.createDataFrame([(*x, 1, "f", 2) for x in rows], "doc_id long, text string, fp int, cell string, component_id int").repartition(3)
    want = plain_components(rows)
    as_rows = lambda found: sorted(str((x["doc_id"], f"{x['fp'] % 2**64:016x}", x["component_id"])) for x in found.collect())
    assert as_rows(simhash.near_duplicates(df)) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_long_texts_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    r = random.Random(piece)
    for _ in range(300):
        text = "".join(r.choice(["a", "Bc", " ", "\n", "\t ", "é", "long" * 9]) for _ in range(r.randrange(40)))
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize(("grid", "crowd"), [(4, 7), (6, 4096), (8, 3), (16, 2)])
def test_grids_and_shares_lose_no_link(spark, grid, crowd):
    r = random.Random(grid)
    centres = [0, (1 << 64) - 1, *[r.getrandbits(64) for _ in range(40)]]
    near = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for c in centres for _ in range(12)}
    fps = sorted(near)
    label = {f: f for f in fps}
    for _ in fps:
        before = dict(label)
        for a in fps:
            label[a] = min(label[b] for b in fps if (a ^ b).bit_count() <= 2)
        if before == label:
            break
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    points = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    group = {}
    top = {f: f for f in fps}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    for x in simhash.links(points, grid, crowd).collect():
        a, b = root(x["src"] % 2**64), root(x["dst"] % 2**64)
        top[max(a, b)] = min(a, b)
    for f in fps:
        group.setdefault(root(f), set()).add(label[f])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(label.values()))


def test_xxh64_is_sparks_own(spark):
    got = spark.sql("SELECT xxhash64('one two three')").first()[0]
    assert got % 2**64 == int(next(simhash.shingle_hashes("One  two three"))[0])


def test_steps_cover_the_ball():
    for n in simhash.GRIDS:
        base = max(w for _, w in simhash.segments(n)) + simhash.BITS + 1
        assert len(simhash.steps(n)) == 1 + n + n + n * (n - 1) and base**n < 1 << 63
        assert sum(w for _, w in simhash.segments(n)) == 64
