"""Small functions, each by its own cases."""

import base64
import random
import re

from pyspark.sql import functions as F

from quaystone.functions import documents, fields, text
from quaystone.operators import extraction, retrieval, routing
from quaystone.sources import readers


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r["y"] for r in df.select(column.alias("y")).collect()]


def test_texts_of_messages(spark):
    assert values(spark, documents.reply_subject(F.col("x")), ["Re: a", "RE: b", "re:c", "d", ""]) == ["Re: a", "RE: b", "re:c", "Re: d", "Re: "]
    assert values(spark, documents.clean_body(F.col("x"), 6), ["a\n\n\n\nb", "  x \n", "123456789", "\n\n\n"]) == ["a\n\nb", "x", "123456", ""]
    assert values(spark, documents.attachment_role(F.col("x")), ["d/a_SI.txt", "a_BL.txt", "b.txt", "x_SI_2.txt"]) == ["SI", "BL", "BL", "BL"]
    rows = [("BL_COMPARISON", 0, "please send the\ndraft BL"), ("BL_COMPARISON", 1, "send the draft BL"), ("GENERAL", 0, "send the draft BL"), ("BL_COMPARISON", 0, "the draft BL is here"), ("BL_COMPARISON", 0, "provide draft  bl")]
    assert values(spark, documents.awaits_draft(F.col("c"), F.col("n"), F.col("b")), rows, "c string, n int, b string") == [True, False, False, False, True]
    pairs = [([("A", "1"), ("B", "2")],), ([],), ([("A", None)],)]
    assert values(spark, documents.pairs_as_text(F.col("x")), pairs, "x array<struct<label:string,value:string>>") == ["A: 1\nB: 2", "", ""]


def test_digests_and_sizes(spark):
    raw = [b"", b"a", b"ab", b"abc", b"\xff\xfe?>"]
    coded = [base64.urlsafe_b64encode(x).decode() for x in raw]
    assert values(spark, documents.base64_url(F.col("x")), coded + [c.rstrip("=") for c in coded]) == raw * 2
    assert values(spark, documents.base64_url(F.col("x")), ["%%%", None]) == [None, None]
    short = values(spark, documents.short_hash(F.col("x")), ["a", "a", "b"])
    assert short[0] == short[1] != short[2] and all(re.fullmatch("[0-9a-f]{16}", x) for x in short)
    sizes = values(spark, text.is_too_large(F.col("n"), F.col("u")), [(10, False), (10**12, False), (10**12, True), (10, True), (None, False)], "n long, u boolean")
    assert sizes[:2] == [False, True] and sizes[2] and not sizes[3] and not sizes[4]


def test_containers(spark):
    cases = {"2 x 40'HC": "2", "1x20GP + 3X40HC": "4", "5": "5", "about 7 boxes": "7", " tba ": "TBA", "": ""}
    assert dict(zip(cases, values(spark, fields.container_total(F.col("x")), list(cases)), strict=True)) == cases


def test_first_of_each(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, id int, v string")
    assert sorted(tuple(r) for r in retrieval.keep_first(rows, "k", "id").collect()) == [("a", 1, "y"), ("b", 5, "z")]


def test_results_by_file_name(spark, tmp_path):
    for name, n in (("e1", 1), ("e2.x", 2)):
        (tmp_path / f"{name}.json").write_text('{"n":\n %d}' % n)
    got = {r["stem"]: r["n"] for r in readers.json_by_stem(spark, str(tmp_path), "n int").collect()}
    assert got == {"e1": 1, "e2.x": 2}


def test_hand_labels_and_disagreements(spark):
    filed = spark.createDataFrame([("a", "SPAM"), ("b", "GENERAL"), ("c", "SPAM"), ("d", "SPAM")], "email_id string, category string")
    labels = spark.createDataFrame([("a", "SPAM"), ("b", "SPAM"), ("c", "AMBIGUOUS"), ("e", "SPAM")], "email_id string, label string")
    assert tuple(routing.hand_label_accuracy(filed, labels).first()) == (2, 1, 1)


def test_values_stand_whole_as_the_pattern_says(spark):
    r = random.Random(9)
    parts = ["12", "1", ".", ",", "A", "b", " ", "(", "x1", "-", "é", "2.5"]
    rows = [("".join(r.choice(parts) for _ in range(r.randrange(1, 3))), "".join(r.choice(parts) for _ in range(r.randrange(9)))) for _ in range(4000)]
    got = values(spark, extraction.stands_whole(F.col("v"), F.col("t")), rows, "v string, t string")
    fold = lambda x: re.sub(r"[ \t\x0b\f\r\n]+", " ", x).strip(" ")
    for (v, t), found in zip(rows, got, strict=True):
        value, where = fold(v), fold(t)
        want = re.search(rf"(?<![\w.,]){re.escape(value)}(?!\w|[.,]\d)", where, re.A) if value else None
        assert found == (want is not None), (v, t)
