"""Whole messages: a message's files meet in its row, and office files are read
in time linear to their length."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quaystone.operators import messages
from quaystone.plans import inbox
from quaystone.sources import readers


def test_files_meet_their_message_in_one_join(spark, tmp_path):
    mail = spark.createDataFrame([("a", "x@y.example", "s", "b", ["a_SI.txt", "a_BL.txt"])], readers.EMAIL_SCHEMA)
    files = spark.createDataFrame([("a_SI.txt", b"")], "path string, content binary")
    plan = messages.process_emails(mail, files)._jdf.queryExecution().optimizedPlan().toString()
    # slots with what was read, and messages with their results
    assert plan.count("Join ") == 2 and "Window" not in plan


def test_files_of_the_inbox_are_made_in_one_pass(spark, data):
    mail, files = inbox.inbox(spark, data)
    assert "Union" not in files._jdf.queryExecution().optimizedPlan().toString()
    assert "Shipper" not in mail._jdf.queryExecution().optimizedPlan().toString()  # no texts for names


def test_which_files_are_compared(spark):
    mail = [
        ("once", ["k_SI.txt", None, "k_BL.txt", "note.txt"]), ("three", ["b_SI.txt", "a_BL.txt", "a_SI.txt", "c_BL.txt", "b_BL.txt", "c_SI.txt"]), ("again", ["k_SI.txt", "k_SI.txt", "k_BL.txt"]),
        ("latest", ["k_SI_V2.txt", "k_SI.txt", "k_BL_REVISED.txt", "k_BL (3).txt", "k_BL.txt"]), ("both", ["k_SI_BL.txt"]), ("ends", ["xSI", "xBL"]), ("none", ["_x.txt"]),
    ]
    slots = messages.attachments_of(spark.createDataFrame(mail, "email_id string, attachments array<string>"))
    read = spark.createDataFrame([], "path string, status string, title string, v struct<x: string>, l struct<x: string>")
    got = messages.pairs_of(messages._documents(slots, read)).where("draft = 'now' or bl_path is not null")
    rows = {}
    for r in got.orderBy("email_id", "place", F.desc("draft")).collect():
        rows.setdefault(r["email_id"], []).append((r["place"], r["n"], r["draft"], r["si_path"], r["bl_path"], r["note"]))
    assert rows == {
        "once": [(1, 1, "now", "k_SI.txt", "k_BL.txt", None)],
        "three": [(1, 3, "now", "b_SI.txt", "b_BL.txt", None), (2, 3, "now", "a_SI.txt", "a_BL.txt", None), (3, 3, "now", "c_SI.txt", "c_BL.txt", None)],
        "again": [(1, 2, "now", "k_SI.txt", "k_BL.txt", None), (2, 2, "now", "k_SI.txt", "k_BL.txt", None)],
        "latest": [(1, 1, "now", "k_SI_V2.txt", "k_BL (3).txt", "set aside: k_BL.txt, k_BL_REVISED.txt, k_SI.txt"), (1, 1, "before", "k_SI_V2.txt", "k_BL_REVISED.txt", "set aside: k_BL.txt, k_BL_REVISED.txt, k_SI.txt")],
        "both": [(1, 1, "now", "k_SI_BL.txt", "k_SI_BL.txt", None)], "ends": [(1, 1, "now", "xSI", "xBL", None)], "none": [(1, 1, "now", None, None, None)],
    }


@pytest.mark.parametrize("parse,name,text", [(readers._docx, "word/document.xml", "<w:tr>" * 40_000), (readers._xlsx, "xl/worksheets/sheet1.xml", "<row>" * 40_000)])
def test_rows_that_never_end_are_passed_over_once(parse, name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    began = time.perf_counter()
    assert parse(out.getvalue()) == (None, [])
    assert time.perf_counter() - began < 2


def test_cells_are_freed_of_tags_as_each_alone():
    cells = ["<w:tc><w:p>a</w:p><w:p>b &amp; c</w:p></w:tc>", "<w:tc><w:p>a <b</w:p></w:tc>", "x\n\0\ny", "<w:p>u<w:br/>v</w:p>", ""]
    alone = [readers._plain([c])[0] for c in cells]
    assert alone[:2] == ["a | b & c", "a <b"] and alone[3:] == ["u | v", ""]
    assert readers._plain(cells) == alone and readers._plain(cells[:2]) == alone[:2]
