"""The methods themselves against plain statements of them."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaystone.llm import context_tree, decontaminate, language, ngram_join, quality_classifier, secrets, sharding, textscan, warc
from quaystone.llm.shared import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_long_words_differ_when_their_halves_change_places(spark):
    a, b = "a" * 65536, "b" * 65536
    (chunk,) = textscan.chunks(pa.array([f"{a}{b} {b}{a} {a}{b} {a}{b}c{a}"]), 1 << 30)
    s, e, _ = chunk.words()
    h = chunk.word_hashes(s, e).tolist()
    assert h[0] == h[2] and len(set(h)) == 3
    rows = [(1, f"{a}{b} x y z w"), (2, f"{b}{a} x y z w"), (3, f"{a}{b} x y z w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
    known = {r["doc_id"]: r["n_known"] for r in context_tree.score_texts(docs, F.col("doc_id") == 2).collect()}
    assert known == {1: 6, 2: 5, 3: 6}


def test_added_secrets_are_the_regexes(spark):
    kinds = {
        "forge": re.compile("gh[pousr]_([A-Za-z0-9]+)"),
        "chat": re.compile("xox[abprs]-([A-Za-z0-9-]+)"),
        "signed": re.compile(r"eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)"),
        "pem": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    }
    least = {"forge": 20, "chat": 10, "signed": 8, "pem": 0}
    rng = random.Random(5)
    parts = ["ghp_", "gho_", "A1b2C3d4E5", "xoxb-", "xoxp-xoxb-", "eyJ", ".", "_-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", " ", "é", "\n", "token=", "AKIA"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    n = 0
    for r in secrets.secret_spans(df).collect():
        want = []
        for i, (k, p) in enumerate(kinds.items()):
            want += [(m.start(), i, m.end()) for m in p.finditer(r["text"]) if not p.groups or len(m[1]) >= least[k]]
        got = [(x["start"], list(kinds).index(x["kind"]), x["end"]) for x in r["found"] if x["kind"] in kinds]
        assert got == sorted(want)
        n += len(got)
    assert n > 50


def test_secret_scan_is_linear():
    scanner = secrets._scanner(secrets.RULES)
    for text in ("eyJ" * 80_000, "eyJ" * 80_000 + ".short12345", "token=" * 40_000, "password" + " " * 240_000 + "=x", "a1" * 120_000, "AKIA" * 60_000):
        began = time.perf_counter()
        list(scanner.find(pa.array([text])))
        assert time.perf_counter() - began < 3  # a quadratic scan of 240 kB takes many minutes


def test_secret_query_columns(spark, data):
    rules = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": ("AKIA([A-Z0-9]+)", 0), "hex": ("([0-9a-f]+)", 0)}
    least = {"assign": 6, "access": 16, "hex": 24}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = secrets.query(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = [(m.start(), i, m.end(), k) for i, (k, (p, flags)) in enumerate(rules.items()) for m in re.finditer(p, texts[r["doc_id"]], flags) if len(m[m.lastindex]) >= least[k]]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[3] == k for x in found) for k in rules)
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_foreign_and_malformed_records_give_a_status(spark):
    def record(head, block):
        return gzip.compress(("WARC/1.0\r\nWARC-Type: response\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items())).encode() + b"\r\n" + block + b"\r\n\r\n")

    body = b"some payload"
    b32 = base64.b32encode(hashlib.sha256(body).digest()).decode()
    cases = {
        "sha256 hex": ({"WARC-Payload-Digest": "sha256:" + hashlib.sha256(body).hexdigest(), "Content-Length": len(body)}, "ok"),
        "sha256 base32": ({"WARC-Payload-Digest": f"SHA-256:{b32}", "Content-Length": len(body)}, "ok"),
        "md5": ({"WARC-Payload-Digest": "md5:" + hashlib.md5(body).hexdigest().upper(), "Content-Length": len(body)}, "ok"),
        "foreign": ({"WARC-Payload-Digest": "crc99:zzzz", "Content-Length": len(body)}, "unknown digest"),
        "wrong": ({"WARC-Payload-Digest": "sha1:" + "0" * 40, "Content-Length": len(body)}, "digest differs"),
        "none": ({"Content-Length": len(body)}, "ok"),
        "no length": ({}, "malformed length"),
        "bad length": ({"Content-Length": "1e3"}, "malformed length"),
        "negative": ({"Content-Length": "-5"}, "malformed length"),
        "too long": ({"Content-Length": 10**9}, "malformed length"),
    }
    folder = new_folder(spark, "warc-status").removeprefix("file://")
    import os

    os.makedirs(folder)
    data = b"".join(record({"WARC-Record-ID": name, **head}, body) for name, (head, _) in cases.items())
    with open(f"{folder}/x.warc.gz", "wb") as f:
        f.write(data)
    files = spark.createDataFrame([(f"file://{folder}/x.warc.gz", len(data))], "path string, bytes long")
    got = {r["record_id"]: r for r in warc.read_warc(files, 100).collect()}
    assert {k: r["status"] for k, r in got.items()} == {k: status for k, (_, status) in cases.items()}
    assert {r["payload_digest"] for k, r in got.items() if r["status"] != "malformed length"} == {hashlib.sha1(body).hexdigest()}


def test_repeated_rows_are_split_over_shards(spark):
    rows = spark.range(20_000).selectExpr("if(id < 10000, 7, id) as doc_id", "if(id < 10000, 'the same row over and over', concat('text ', repeat(cast(id as string), 5))) as text")
    placed = sharding.shard_documents(rows, 16).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots"), F.sum(F.octet_length("text") + 1).alias("bytes")).collect()
    assert len(placed) == 16 and sum(r["n"] for r in placed) == 20_000
    assert all(r["n"] == r["slots"] == r["top"] + 1 for r in placed)
    mean = sum(r["bytes"] for r in placed) / 16
    assert all(abs(r["bytes"] - mean) < 0.05 * mean for r in placed)


def test_one_heavy_text_among_light_ones(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 2 = 0, 'one text of many rows', concat('t', id)) as text")
    placed = sharding.shard_documents(rows, 8).groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    mean = sum(r["bytes"] for r in placed) / 8
    assert len(placed) == 8 and all(abs(r["bytes"] - mean) < 0.05 * mean and r["n"] == r["top"] + 1 for r in placed)


def test_items_with_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d1", "a b c d e f g"), (None, "x y"), ("d3", None)], "doc_id string, text string")
    items = spark.createDataFrame([("q1", "a b c d e f"), (None, "X Y"), ("q3", None)], "item_id string, text string")
    got = sorted(map(str, map(tuple, decontaminate.contaminated(docs, items).collect())))
    assert got == sorted(map(str, [("d1", "q1", 2, 2), (None, None, 1, 1)]))


def test_many_blocks_are_one_scan(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)
    monkeypatch.setattr(decontaminate, "KEPT", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 12))) for i in range(30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    sets = lambda lo, n: {tuple(range(i, i + 5)) for i in range(lo, lo + n - 4)}
    assert got == {(d, i) for d in range(30) for i in range(30) if len(sets(d, 40) & sets(2 * i, 12)) >= 0.8 * 8}


def test_factorisation_machine_is_the_sum_over_pairs():
    texts = pa.array(["one two two three! 7", "", "A b c\nA b c", None], pa.string())
    declared = np.array([20.0, -1, 11, 5])
    machine = quality_classifier.Machine(0.25)
    machine.w[:] = np.random.default_rng(3).normal(0, 1, len(machine.w))
    for _, n, index, value in quality_classifier.features(texts, declared):
        at, got = 0, machine.score(n, index, value)
        for row, m in enumerate(n):
            i, x = index[at : at + m], value[at : at + m].astype(float)
            at += m
            raw = machine.bias + sum(float(machine.w[a]) * b for a, b in zip(i, x, strict=True))
            raw += sum(float(machine.v[i[a]].astype(float) @ machine.v[i[b]].astype(float)) * x[a] * x[b] for a, b in itertools.combinations(range(m), 2))
            assert got[row] == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-4)


def test_classifier_learns_from_repeated_ids_once(spark):
    docs = spark.createDataFrame([(i % 4, f"good words here {i}" if i % 2 else "$$$ ### bad", None) for i in range(400)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    scored = {r["text"][:3]: r["score"] for r in quality_classifier.classify(docs, labels, F.lit(True)).collect()}
    assert scored["goo"] > scored["$$$"]


def test_base_score_is_add_one_unigrams(spark):
    texts = ["The the cat", "a cat", None, "dog the", "", "unseen words the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {3, 5}
    tokens = [[*WORD.findall(fold(t or "")), None] for t in texts]
    count = {}
    for i, words in enumerate(tokens):
        for w in words if i not in held else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for r in context_tree.score_texts(docs, F.col("doc_id").isin(*held), 3).collect():
        words = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in count for w in words), n)


def test_languages_held_out(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").join(language.query(spark, data), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(r["n_spans"] == len(r["spans"].split(",")) for r in rows)


def test_large_and_small_groups_of_equal_pages(spark, monkeypatch):
    """With room to broadcast few groups, the small ones are joined otherwise."""
    payloads = ["a" * 1000] * 5 + ["b" * 1000] * 2 + ["c" * 1000] * 2 + ["d" * 1000, "e", "e", None]
    pages = spark.createDataFrame([(i, "u", x) for i, x in enumerate(payloads)], "page_id long, url string, html string")
    want = [4, 4, 4, 4, None, 6, None, 8, None, None, None, None, None]
    for rows in (3, 1, 1_000_000):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
        assert [r["refers_to"] for r in warc.deduplicated(pages).orderBy("page_id").collect()] == want
