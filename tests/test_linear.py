"""Masking and page text against the patterns they stand for, and in time
linear to texts made to be slow."""

import random
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from quaystone.functions import documents, privacy, scan

MB = 1_000_000


def seconds(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_addresses_are_what_the_pattern_finds():
    r = random.Random(1)
    parts = ["a", "b@", "@", "c.com", ".", "..", "-", "_x", "@d.e", " ", ".co", "é", "9", "a@b.comX@c.org", "%+", "@a..b.com", ".c1", "x@y.zz"]
    for _ in range(40_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        assert [text[a:b] for a, b in scan.email_spans(text)] == re.findall(privacy.EMAIL, text), text


def plain_page(page):
    x = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", "", page)
    return re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr)\s*>", "\n", x))


def test_pages_are_what_the_patterns_leave():
    r = random.Random(2)
    parts = ["<script>", "</script>", "<STYLE a='b'>", "</style >", "<", ">", "<p>", "</p>", "</DIV\n>", "<br/>", "<br", "a", "<scripts>", "</script", "x\ny", "<di", "v>", "<style", "</style>", "<script"]
    for _ in range(40_000):
        page = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert scan.page_text(page) == plain_page(page), page


@pytest.mark.parametrize("text", ["a" * MB, "a@" + "b." * (MB // 2), "@" * MB, "a@b" * (MB // 3), "account" + " " * MB, "swift" + " " * MB + "x", "account " * (MB // 8), "1 " * (MB // 2), "0" * MB, "GB82" * (MB // 4), "bank" + " " * MB, "+60" * (MB // 3)])
def test_masking_is_linear(text):
    for mask in (privacy.without_contacts, privacy.without_personal_data):
        half, whole = seconds(lambda m=mask: m(text[: MB // 4])), seconds(lambda m=mask: m(text))
        assert whole < 1 or whole < 8 * half
    assert seconds(lambda: privacy._hidden([text])) < 4


@pytest.mark.parametrize("page", ["<" * MB, "<script>" * (MB // 8), "<script><style>" * (MB // 15) + "</style>", "<br " * (MB // 4), "</script" * (MB // 8), "<style>" + "</style " * (MB // 8), "<br" + " " * MB, "<p" * (MB // 2) + ">"])
def test_page_text_is_linear(page):
    assert seconds(lambda: scan.page_text(page)) < 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_long_texts_in_spark(spark):
    texts = ["a" * MB, "a@" + "b." * (MB // 2) + "com", "<script>" * (MB // 8), "{" * MB, "```" + " " * MB]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    columns = [privacy.mask_text("t"), privacy.mask_contacts("t"), documents.html_to_text("t"), documents.html_core_text(F.col("t")), documents.json_in(F.col("t")), documents.unfenced(F.col("t"))]
    assert seconds(lambda: df.select(*[F.length(c) for c in columns], F.length(privacy.anonymize("t")["text"])).collect()) < 30


def test_masking_of_arrays_and_back(spark):
    df = spark.createDataFrame([(1, [("Shipper", "a@b.com"), ("Remarks", "a@b.com"), (None, "c@d.com"), ("x", None)]), (2, None), (3, [])], "i int, p array<struct<label:string,value:string>>")
    got = {r["i"]: r["m"] and [tuple(x) for x in r["m"]] for r in df.select("i", privacy.mask_pairs("p").alias("m")).collect()}
    assert got == {1: [("Shipper", "a@b.com"), ("Remarks", "<EMAIL_ADDRESS>"), (None, "<EMAIL_ADDRESS>"), ("x", None)], 2: None, 3: []}
    texts = ["mail a@b.com and c@d.com, a@b.com; card 4111 1111 1111 1111", None, "", "<EMAIL_ADDRESS_9> stays"]
    hidden = spark.createDataFrame([(t,) for t in texts], "t string").select("t", privacy.anonymize("t").alias("a"))
    rows = hidden.select("t", F.col("a.text").alias("h"), privacy.deanonymize("a.text", "a.tokens").alias("back")).collect()
    assert [r["back"] for r in rows] == texts and rows[0]["h"] == "mail <EMAIL_ADDRESS_1> and <EMAIL_ADDRESS_2>, <EMAIL_ADDRESS_1>; card <BANK_DETAILS_1>"


def test_replies(spark):
    cases = ['so: {"a": {}} done', "none", "} {", "{", "{}", None]
    got = [r["x"] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(documents.json_in(F.col("t")).alias("x")).collect()]
    assert got == ['{"a": {}}', None, None, None, "{}", None]
    fences = ["a ```json\n{1}\n``` b", "```\nx y\n```", "no", "```x", "``` z ```"]
    got = [r["x"] for r in spark.createDataFrame([(c,) for c in fences], "t string").select(documents.unfenced(F.col("t")).alias("x")).collect()]
    assert got == ["{1}", "x y", "no", "```x", "z"]


def test_titles(spark):
    of = lambda intent, subject, body: one(spark, documents.title_parts(F.lit(intent), F.lit(subject), F.lit(body)))
    assert of("cancel_invoice", "s", "the invoice is wrong, cancel invoice 12345678 for ACME LTD (MY) soon") == ["12345678", "ACME LTD"]
    assert of("charge_query", "s", "Invoice 123 and INVOICE 654321") == ["654321"] and of("missing_gr", "s", "reinvoice 1234567") == []
    assert of("dd_charges", "s", "Charges for OOLU123, charges for X") == ["OOLU123"]
    assert of("schedule_update", "s", "update summary for EVER GIVEN V.12W today") == ["EVER GIVEN V.12W"] and of("schedule_update", "s", "vessel X V.1") == []
    assert of("system_notice", "s", "Vessel A V. and B V.9x") == ["A V. and B V.9x"] and of("system_notice", "s", "Vessel A\nV.9") == []
    assert of("chase_draft_bl", "RE_ Draft BL EVER GIVEN V.12W now", "") == ["EVER GIVEN V.12W"] and of("chase_draft_bl", "REQUEST BL DRAFT _ PO 4711 x", "") == ["PO 4711"]
    assert unescape(one(spark, documents.html_to_text(F.lit("<p>a &amp; b</p>")))) == "a & b"


def test_orders_and_boxes(spark):
    from quaystone.functions import fields

    names = {"ORDER OF X": "TO ORDER OF X", "TO THE ORDER OF X": "TO ORDER OF X", "THE ORDER": "TO ORDER", "TO ORDER": "TO ORDER", "ORDERLY X": "ORDERLY X", "BY ORDER OF X": "BY ORDER OF X", "ACME": "ACME", "TO ORDER, X": "TO ORDER, X"}
    rows = spark.createDataFrame(list(names.items()), "a string, b string").select("a", "b", fields.order_form(F.col("a")).alias("c")).collect()
    assert [r["c"] for r in rows] == [r["b"] for r in rows]
    boxes = {"2 x 40'HC + 1X20GP": [("20", 1), ("40", 2)], "3*20": [("20", 3)], "2x400": [], "2x20x40": [("20", 2)], "5 × 45 reefers": [("45", 5)], "x20": [], "2 x 40_": []}
    rows = spark.createDataFrame(list(boxes), "string").select("value", fields.container_sizes(F.col("value")).alias("c")).collect()
    assert {r["value"]: [(x["size"], x["n"]) for x in r["c"]] for r in rows} == boxes
