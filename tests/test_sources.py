"""Text lines against plain Python, readers that callers add, folders as a
source, and a mailbox whose files come meanwhile."""

import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaystone.operators import messages
from quaystone.sources import edi, folder, readers
from quaystone.sources.lines import BLANKS, pairs_in
from quaystone.streaming import mailbox, run


def plain_pairs(text):
    """Line by line, as one would read it."""
    out, taking = [], False
    for line in text.split("\n"):
        core = line.strip(BLANKS)
        if core and taking and (line[0] in BLANKS or (":" not in line and out[-1][1] == [])):
            out[-1][1].append(core)
        elif core and ":" in core:
            label, value = core.split(":", 1)
            out.append((label.strip(BLANKS), [value.strip(BLANKS)] if value.strip(BLANKS) else []))
            taking = True
        else:
            taking = False
    return [(label, "\n".join(v)) for label, v in out]


def test_lines_are_brute_force():
    r = random.Random(5)
    parts = ["a", "b: c", "x:", "  ", " y", "\t", "", ":", " : ", "\r", "é", "\xa0", "z", "  q: r", " k:", "::", "\x0b"]
    texts = ["\n".join("".join(r.choice(parts) for _ in range(r.randrange(3))) for _ in range(r.randrange(12))) for _ in range(20_000)]
    got = pairs_in(pa.array(texts)).to_pylist()
    assert [[(p["label"], p["value"]) for p in x] for x in got] == [plain_pairs(t) for t in texts]
    assert pairs_in(pa.array([None, "", "a: b", None])).to_pylist() == [None, [], [{"label": "a", "value": "b"}], None]
    assert len(pairs_in(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("text", ["Shipper:\n" + "  more\n" * 100_000, "a:\nb\n" * 100_000, "a" + " " * 1_000_000 + "b: c", "\n" * 1_000_000, ":" * 1_000_000, "  x: y\n" * 100_000])
def test_lines_are_linear(text):
    began = time.perf_counter()
    got = pairs_in(pa.array([text]))
    assert time.perf_counter() - began < 1
    got = got.to_pylist()[0]
    if len(text) < 700_000:
        assert [(p["label"], p["value"]) for p in got] == plain_pairs(text)


def test_a_long_block_ends_no_session(spark):
    text = "BILL OF LADING\nShipper:\n" + "  more\n" * 100_000 + "POL: X\nPOD: Y\n"
    files = spark.createDataFrame([("a_BL.txt", "txt", text.encode())], "path string, format string, content binary")
    row = readers.read_documents(files).first()
    assert row["status"] == "ok" and len(row["pairs"]) == 3 and row["pairs"][0]["value"].count("\n") == 99_999


def test_edi_marks_and_choices():
    assert edi.read("")[1] == [] and edi.read("no header~N1*SH*S~")[1] == [("shipper", "S")]
    assert dict(edi.read("ISA|x\nN1|SH|SECOND\nN1|SF|FIRST\nN1|CN|C\nN1|CN|\nN1|ST|SHIP TO\nN1|N2|LAST")[1]) == {"shipper": "FIRST", "consignee": "SHIP TO", "notify party": "LAST"}
    head = "ISA*" + "0" * 101
    assert dict(edi.read(head + "!R4*L*UN**NO CODE!R4*L*UN*BE\nANR*ANTWERP!R4*L*UN*OTHER!N7**A!N7!L0*1***-5*G!L0*1***1.5*G*****K!L0*2***x*G!ST*301!ST*304!")[1]) == {"port of loading": "ANTWERP (BEANR)", "containers": "2", "gross weight": "2 KG"}
    assert edi.read("ISA*x~ST*304*1~")[0] == "SHIPPING INSTRUCTION" and edi.read("ISA*x~ST*301~ST*304~")[0] is None
    assert edi.read("# ISA|\nISA*x~N1*SH*S~")[1] == [("shipper", "S")]
    for text in ("~" * 500_000, "ISA" * 300_000, "#\n" * 300_000, "N1*" * 300_000):
        began = time.perf_counter()
        edi.read(text)
        assert time.perf_counter() - began < 1


def with_csv():
    """READERS and one more; a function inside, so that workers need not import this module."""

    def parse(content: bytes):
        lines = content.decode().splitlines()
        return lines[0], [tuple(x.split(";")) for x in lines[1:]]

    return readers.READERS | {"csv": readers.by_bytes(parse)}


CSV = b"BILL OF LADING\nShipper;ALPHA LTD\nConsignee;BETA LTD\nNotify Party;GAMMA LTD\nPort of Loading;SHENZHEN (CNSZX)\nPOD;ANTWERP (BEANR)\nNo. of Containers;2 x 40'HC\nGross Weight;1,000 KG"
SI = CSV.replace(b"BILL OF LADING", b"SHIPPING INSTRUCTION").replace(b";", b": ")


def test_a_format_that_the_caller_adds(spark):
    formats = with_csv()
    files = spark.createDataFrame([("a.csv", "csv", CSV), ("b.csv", "csv", b"t\na;b;c"), ("c.csv", "csv", None), ("d.pdf", "pdf", b"%PDF"), (None, None, None)], "path string, format string, content binary")
    found = {r["path"]: (r["status"], len(r["pairs"]), r["error"]) for r in readers.read_documents(files, formats).collect()}
    assert found["a.csv"] == ("ok", 7, None) and found["c.csv"][:2] == ("missing", 0) and found["d.pdf"][:2] == ("not_attempted", 0) and found[None][0] == "not_attempted"
    assert found["b.csv"][0] == "unreadable" and found["b.csv"][2].startswith("ValueError")
    pairs = spark.createDataFrame([(1, "s_SI.txt", "b_BL.csv"), (2, "s_SI.txt", "none_BL.csv"), (3, "s_SI.txt", None)], "n int, si_path string, bl_path string")
    held = spark.createDataFrame([("s_SI.txt", SI), ("b_BL.csv", CSV), ("unused", b"x")], "path string, content binary")
    got = {r["n"]: (r["status"], r["review_reason"]) for r in messages.compare_files(pairs, held, formats).collect()}
    assert got == {1: ("OK", None), 2: ("NEEDS_REVIEW", "missing_attachment"), 3: ("NEEDS_REVIEW", "missing_attachment")}


def test_a_folder_as_a_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for i in range(20):
        (tmp_path / "sub" / f"f{i:02}.TXT").write_bytes(b"x" * i * 1000)
    (tmp_path / "_temporary").write_text("being written")
    found = folder.scanned(spark, f"file://{tmp_path}", partition="30000")
    rows = {r["path"]: r for r in found.collect()}
    assert len(rows) == 20 and all(r["format"] == "txt" and len(r["content"]) == r["length"] == int(p[5:7]) * 1000 for p, r in rows.items())
    assert found.rdd.getNumPartitions() > 5
    assert folder.scanned(spark, str(tmp_path), largest="5000").where("content is null").count() == 14
    assert folder.scanned(spark, str(tmp_path / "none")).count() == 0


def test_only_named_files_are_opened(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A")
    (tmp_path / "in" / "shut.txt").write_text("secret")
    (tmp_path / "out.txt").write_text("outside")
    at = {p: os.stat(tmp_path / "in" / p).st_atime_ns for p in ("a.txt", "shut.txt")}
    os.utime(tmp_path / "in" / "shut.txt", (1, 1))
    paths = spark.createDataFrame([("a.txt",), ("a.txt",), ("none.txt",), ("../out.txt",), (None,), ("",), (str(tmp_path / "out.txt"),)], "path string")
    got = {r["path"]: r["content"] for r in folder.named(f"file://{tmp_path}/in")(paths).collect()}
    assert got == {"a.txt": b"A", "none.txt": None, "../out.txt": None, "": None, str(tmp_path / "out.txt"): None}
    assert [bytes(r["content"]) for r in folder.scanned(spark, f"{tmp_path}/in").where("path = 'a.txt'").collect()] == [b"A"]
    assert folder.scanned(spark, f"{tmp_path}/in").where("path in ('a.txt', 'x') and format = 'txt' and path like 'a%'").count() == 1
    assert os.stat(tmp_path / "in" / "shut.txt").st_atime_ns == 1_000_000_000 and at


def test_a_folder_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = f"file://{tmp_path}/out"

    def take():
        run.append_batches(folder.followed(spark, f"{tmp_path}/in", settle="0").select("path", F.length("content").alias("n")), out)
        return sorted((r["path"], r["n"]) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "a.txt").write_text("one")
    assert take() == [("a.txt", 3)]
    (tmp_path / "in" / "b.txt").write_text("three")
    assert take() == [("a.txt", 3), ("b.txt", 5)] == take()


def test_mailbox_reads_its_attachments(spark, tmp_path):
    listing, files, out = tmp_path / "in", tmp_path / "files" / "attachments", f"file://{tmp_path}/out"
    listing.mkdir()
    files.mkdir(parents=True)

    def message(i, *names):
        (listing / f"m{i}.json").write_text(json.dumps({"email_id": f"m{i}", "from": "a@b.example", "subject": "s", "body": "see files", "attachments": [f"attachments/{n}" for n in names], "at": f"2024-01-0{i + 1}T00:00:00"}))

    edi_si = b"ISA*00*x~ST*304*1~N1*SF*ALPHA LTD~N1*CN*BETA LTD~N1*NP*GAMMA LTD~R4*L*UN*CNSZX*SHENZHEN~R4*D*UN*BEANR*ANTWERP~N7**A~N7**B~L0*1***1000*G******K~"
    for name, content in {"m0_SI.txt": SI, "m0_BL.csv": CSV, "m1_SI.txt": SI, "m1_BL.csv": CSV.replace(b"BETA", b"DELTA"), "m2_SI.txt": SI, "m2_BL.docx": b"no archive", "m3_SI.txt": SI, "m4_SI.edi": edi_si, "m4_BL.csv": CSV.replace(b"2 x 40'HC", b"2")}.items():
        (files / name).write_bytes(content)
    formats = with_csv()
    message(0, "m0_SI.txt", "m0_BL.csv")
    message(1, "m1_SI.txt", "m1_BL.csv")
    message(2, "m2_SI.txt", "m2_BL.docx")
    message(3, "m3_SI.txt", "m3_BL.txt")
    watch = lambda: mailbox.watch(spark, f"file://{listing}", f"file://{tmp_path}/files", out, formats=formats)
    watch()
    done = lambda: spark.read.parquet(out)
    assert {r["email_id"]: (r["status"], r["review_reason"]) for r in done().collect()} == {
        "m0": ("OK", None), "m1": ("MISMATCH", None), "m2": ("NEEDS_REVIEW", "unreadable"), "m3": ("NEEDS_REVIEW", "missing_attachment"),
    }
    message(4, "m4_SI.edi", "m4_BL.csv")
    (files / "m3_BL.txt").write_bytes(CSV.replace(b";", b": "))  # came too late for m3
    shown = mailbox.listed(spark, f"file://{listing}")
    assert mailbox.pending(shown, done()).first()["pending"] == 1
    watch()
    assert [(r["email_id"], r["status"]) for r in mailbox.finished(shown, done()).collect()] == [("m4", "OK"), ("m3", "NEEDS_REVIEW"), ("m2", "NEEDS_REVIEW"), ("m1", "MISMATCH"), ("m0", "OK")]
    assert [r["email_id"] for r in mailbox.finished(shown, done(), 2).collect()] == ["m4", "m3"]
    assert mailbox.pending(shown, done()).first()["pending"] == 0
