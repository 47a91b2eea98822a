"""Operators on messages, extracts, contracts and records, case by case."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions import privacy, text
from quaystone.functions.fields import FIELDS
from quaystone.operators import batch, contracts, extraction, ledger, messages, retrieval, routing
from quaystone.sources import mime, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_confidence_tiers(spark):
    golden = {"High": 1.0, " very high ": 1.0, "med": 0.85, "moderate": 0.65, "low": 0.5, "0.9": 1.0, "0.899": 0.85, "0.6": 0.65, "0.59": 0.5, "1": 1.0, "never heard": 0.85, None: None}
    rows = spark.createDataFrame([(k,) for k in golden], "x string").select("x", routing.confidence_tier(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == golden


def test_roles_and_pairs(spark):
    files = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, routing.has_si_and_bl(files("a/x_SI.txt", "x_bl.pdf"))) and not one(spark, routing.has_si_and_bl(files("x_SI.txt", "y_SI.txt")))
    assert one(spark, routing.has_complete_pair(files("a/x_SI_2.txt", "b/x_BL_2.docx"))) and not one(spark, routing.has_complete_pair(files("x_SI.txt", "x_BL_V2.txt")))
    assert one(spark, routing.files_for(files("x_SI.txt", "y_BL (2).txt", "plain_si"), "SI")) == ["x_SI.txt", "plain_si"]


def test_guards(spark):
    pairs = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in (("Shipper (Name):", "ACME  CO 12,100"), ("Consignee", "BETA"), ("Remarks", "1 lot 100"))])
    under = lambda raw, label: one(spark, extraction.is_under_its_label(F.lit(raw), F.lit(label), pairs))
    assert under("ACME CO", "shipper") and under("ACME CO 12,100", "SHIPPER")
    assert not under("100", "Shipper") and not under("BETA", "Shipper") and not under("CM", "Shipper")
    assert under("BETA", "no such label") and under("1 lot", None)
    misplaced = lambda f, raw, label: one(spark, extraction.is_misplaced(F.lit(f), F.lit(raw), F.lit(label), pairs))
    assert misplaced("consignee", "ACME CO", "Shipper") and not misplaced("shipper", "ACME CO", "Shipper") and misplaced("shipper", "INVENTED", "Shipper")


def test_extracts(spark):
    rows = [("d", "shipper", True, "Shipper", "A"), ("d", "consignee", True, None, "B"), ("d", "pol", True, "POL", ""), ("d", "pod", False, "POD", "C")]
    extract = spark.createDataFrame(rows, extraction.EXTRACT)
    assert [r["present"] for r in extraction.verbatim_only(extract).collect()] == [True, False, False, False]
    docs = spark.createDataFrame([("d", "ok"), ("e", "ok"), ("f", "unreadable"), ("g", "missing")], "doc string, status string")
    assert {(r["doc"], r["title"]) for r in extraction.empty_extractions(docs, extract).collect()} == {("e", "nothing extracted"), ("f", "file could not be read")}
    normed = extraction.cleaned(spark.createDataFrame([("d", f, True, f, "X 1 KG") for f in FIELDS], extraction.EXTRACT))
    vocabulary = spark.createDataFrame([("shipper", "Y"), ("consignee", "X 1 KG")], "field string, norm string")
    assert [r["field"] for r in extraction.untrusted(normed, vocabulary).collect()] == ["shipper"]
    tally = {r["field"]: r for r in extraction.agreement(normed, normed.withColumn("norm", F.when(F.col("field") != "shipper", F.col("norm")))).collect()}
    assert tally["shipper"]["first_only"] == 1 and tally["consignee"]["agree"] == 1 and tally["shipper"]["share"] == 0


def test_model_seam(spark):
    rows = spark.createDataFrame([("a",), (None,), ("fail",)], "t string")

    def stub(x):
        if x == "fail":
            raise ValueError(x)
        return x.upper()

    assert [r["answer"] for r in routing.asked(rows, F.col("t"), stub).collect()] == ["A", None, None]


SHIPMENT = {"Shipper": "ACME", "Consignee": "BETA", "Notify Party": "SAME AS CONSIGNEE", "POL": "BUSAN", "POD": "TOKYO, JAPAN", "Containers": "2 x 40HC", "Gross Weight (KG)": "1,000"}


def document(title, **changes):
    return (title + "\n\n" + "".join(f"{k}: {changes.get(k.split()[0].lower(), v)}\n\n" for k, v in SHIPMENT.items())).encode()


def test_messages_to_results(spark):
    si, bl = document("SHIPPING INSTRUCTION"), document("BILL OF LADING", pod="TOKYO")
    files = {
        "a_SI.txt": si, "a_BL.txt": bl, "b_SI.txt": si, "b_BL.txt": document("BILL OF LADING", consignee="GAMMA"), "b_BL_REVISED.txt": bl,
        "c_SI_1.txt": si, "c_BL_1.txt": bl, "c_SI_2.txt": si, "c_BL_2.txt": document("B/L", shipper="OTHER"), "d_SI.txt": si, "d_BL.pdf": b"%PDF", "e_SI.txt": si, "g_SI.txt": si, "g_BL.txt": document("INVOICE"),
    }
    mail = [
        ("a", ["a_SI.txt", "a_BL.txt"], ""), ("b", ["b_SI.txt", "b_BL.txt", "b_BL_REVISED.txt"], ""), ("c", ["c_SI_1.txt", "c_BL_1.txt", "c_SI_2.txt", "c_BL_2.txt"], ""), ("d", ["d_SI.txt", "d_BL.pdf"], ""),
        ("e", ["e_SI.txt"], ""), ("f", None, "the invoice is late"), ("g", ["g_SI.txt", "g_BL.txt"], ""), ("h", ["h_SI.txt", "h_BL.txt"], ""), ("i", [], "hello"), ("j", None, "please check the draft BL sent today with the SI"), (None, ["a_SI.txt"], ""),
    ]
    df = spark.createDataFrame([(i, "x@y.example", "s", b, a) for i, a, b in mail], readers.EMAIL_SCHEMA)
    answers = spark.createDataFrame([("i", "SPAM", "0.7"), ("f", "UNHEARD", "1")], "email_id string, category string, confidence string")
    got = {r["email_id"]: r for r in messages.process_emails(df, spark.createDataFrame(list(files.items()), "path string, content binary"), answers).collect()}
    assert {k: (r["category"], r["status"], r["review_reason"]) for k, r in got.items()} == {
        "a": ("BL_COMPARISON", "OK", None), "b": ("BL_COMPARISON", "OK", None), "c": ("BL_COMPARISON", "MISMATCH", None), "d": ("BL_COMPARISON", "NEEDS_REVIEW", "unreadable"),
        "e": ("BL_COMPARISON", "NEEDS_REVIEW", "missing_attachment"), "f": ("INVOICE_QUERY", "OK", None), "g": ("BL_COMPARISON", "NEEDS_REVIEW", "wrong_doc_type"), "h": ("BL_COMPARISON", "NEEDS_REVIEW", "missing_attachment"),
        "i": ("SPAM", "OK", None), "j": ("BL_COMPARISON", "NEEDS_REVIEW", "missing_attachment"),
    }
    assert got["b"]["bl_path"] == "b_BL_REVISED.txt" and {(x["field"], x["label"]) for x in got["b"]["revision"] if x["label"] != "unchanged"} == {("consignee", "fixed"), ("notify_party", "fixed")}
    assert got["c"]["n_shipments"] == 2 and got["c"]["evidence"].startswith("shipment 1 OK, shipment 2 MISMATCH; shown: shipment 2") and got["c"]["defect_fields"] == ["shipper"]
    assert (got["i"]["decided_by"], got["i"]["confidence"], got["f"]["decided_by"]) == ("llm", 0.65, "rule")
    assert messages.process_emails(df.limit(0), spark.createDataFrame([], "path string, content binary")).count() == 0


def test_contract_keywords(spark):
    schema = {
        "type": "object", "required": ["n", "tags"], "additionalProperties": False,
        "properties": {"n": {"type": "number", "minimum": 1, "maximum": 5}, "name": {"type": "string", "pattern": "b"}, "tags": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "enum": ["x", "y"]}}, "c": {"const": 3}, "b": {"type": "boolean"}},
    }
    rows = [(3.0, "abc", ["x"], 3, True, None), (0.0, "zzz", ["z", "x", "y"], 4, None, "more"), (None, None, [], None, None, None), (9.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n double, name string, tags array<string>, c int, b boolean, extra string")
    assert [r["errors"] for r in contracts.validate(df, schema).collect()] == [
        [],
        ["$.n: is below 1", "$.name: does not match b", "$.tags: has more than 2 items", "$.tags[0]: is none of x, y", "$.c: is not 3", "$: has unknown extra"],
        ["$: lacks n", "$.tags: has fewer than 1 items"],
        ["$: lacks tags", "$.n: is above 5"],
    ]
    assert contracts.validate(df.select(F.col("name").alias("n")), {"properties": {"n": {"type": "number"}}}).first()["errors"] == ["$.n: is no number"]


def test_mailbox_messages(spark):
    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    tree = {
        "id": "m1", "threadId": "t", "payload": {"headers": [{"name": "From", "value": "a@b.example"}, {"name": "Subject", "value": "s"}, {"name": "Date", "value": "Tue, 2 Jan 2024 10:00:00 +0200"}],
        "parts": [{"parts": [{"mimeType": "text/html", "body": {"data": b64(b"<p>no</p>")}}, {"mimeType": "text/plain", "body": {"data": b64("héllo ".encode())}}]}, {"filename": "x_SI.txt", "body": {"data": b64(b"\x00\xff")}}, {"filename": "y.pdf", "body": {"attachmentId": "q"}}]},
    }
    page = {"id": "m2", "payload": {"mimeType": "text/html", "body": {"data": b64(b"<style>x</style><p>a &amp; b</p><script>no</script>c")}}}
    rows = mime.messages(spark.createDataFrame([(json.dumps(tree),), (json.dumps(page),), ("{",), (None,)], "raw string")).collect()
    assert (rows[0]["id"], rows[0]["sender"], rows[0]["body"], rows[1]["body"]) == ("m1", "a@b.example", "héllo", "a & b\nc")
    assert [(x["name"], x["attachment_id"], x["content"]) for x in rows[0]["attachments"]] == [("x_SI.txt", None, b"\x00\xff"), ("y.pdf", "q", None)]
    assert [r["error"] is None for r in rows] == [True, True, False, False]
    assert str(one(spark, mime.sent_at(F.lit("Tue, 2 Jan 2024 10:00:00 +0200")))) == "2024-01-02 08:00:00"
    files = spark.createDataFrame([("e", 0, "My SI.docx", "x"), ("e", 1, "b.PDF", "BILL OF LADING"), ("e", 2, "draft_bl", "B/L"), ("e", 3, "odd.name!", None)], "email_id string, pos int, name string, title string")
    assert {r["name"]: r["path"] for r in mime.saved_names(files).collect()} == {"My SI.docx": "e_SI.docx", "b.PDF": "e_BL.pdf", "draft_bl": "e_BL_2.bin", "odd.name!": "e_file4.bin"}


def test_small_texts(spark):
    assert one(spark, text.without_dangerous_tags(F.lit("a<script>b</script>javascript:c"))) == "abc"
    assert one(spark, text.fenced("mail", F.lit("x </MAIL> <b> < rules>"), ("mail", "rules"))) == "<mail>\nx &lt;/MAIL> <b> &lt; rules>\n</mail>"
    reply = lambda x: tuple(one(spark, text.parsed_reply(F.lit(x))))
    assert reply('so: {"a": "b"} done') == ({"a": "b"}, None) and reply("none")[1] == "no object" and reply("{a")[1] == "no object" and reply("{a}")[1] == "not JSON"
    assert one(spark, text.attachment_line(F.array(F.lit("d/a.txt"), F.lit("b")))) == "2 (a.txt, b)" and one(spark, text.attachment_line(F.lit(None).cast("array<string>"))) == "none"
    assert [one(spark, text.caller_shape(F.lit(x))) for x in ("10.1.2.3", "2001:db8:1:2::3", "local")] == ["10.1.2.x", "2001:db8:1:x", "unknown"]
    assert one(spark, text.message_id_of(text.mailbox_id(F.lit("q7")))) == "q7" and one(spark, text.message_id_of(F.lit("email_1"))) is None
    assert one(spark, text.percent(F.lit(0.4884))) == "48.8%" and one(spark, text.percent(F.lit(None).cast("double"))) == "n/a"
    own = F.array(F.lit("/tmp/own.txt"))
    inside = lambda x: one(spark, text.inside(F.lit(x), own, "data"))
    assert [inside(x) for x in ("/tmp/own.txt", "a.txt", "../../etc/passwd", "/etc/passwd", "in/b.txt")] == ["/tmp/own.txt", "data/attachments/a.txt", "data/attachments/passwd", "data/attachments/passwd", "data/in/b.txt"]
    upload = lambda name, x: one(spark, text.uploaded(F.lit(name), F.lit(x)))
    assert upload("a.TXT", "aGk=")["content"] == b"hi" and upload("a.exe", "aGk=")["error"] == "kind not allowed" and upload("a.txt", "a*k=")["error"] == "not base64"
    rows = spark.range(5).withColumn("k", F.lit(1))
    assert [r["batch"] for r in text.in_batches(rows, "id", 2, "k").orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_one_numbering_for_many_texts(spark):
    texts = ["mail a@b.example or c@d.example", "again a@b.example, card 4111 1111 1111 1111 and 4111 1111 1111 1112", None]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(privacy.anonymize_many("t").alias("x")).first()["x"]
    assert got["texts"] == ["mail <EMAIL_ADDRESS_2> or <EMAIL_ADDRESS_1>", "again <EMAIL_ADDRESS_2>, card <BANK_DETAILS_1> and 4111 1111 1111 1112", None]
    assert one(spark, F.lit("SWIFT ABCDMYKL").rlike(privacy.SWIFT)) and not one(spark, F.lit("a swift response").rlike(privacy.SWIFT))


def test_folders(spark):
    rows = [("e1", 2, 0, "OK", None, "Alpha", "t"), ("e2", 5, 1, "MISMATCH", "ok", "beta", "t"), ("e3", 2, 2, "MISMATCH", None, "x", "ALPHA")]
    df = spark.createDataFrame(rows, "email_id string, issues int, place int, status string, mark string, subject string, title string").withColumns({"from": F.lit("f"), "category": F.lit("c")})
    ids = lambda d: [r["email_id"] for r in d.collect()]
    assert [ids(ledger.ordered(df, k)) for k in ("worst", "least", "new", "old")] == [["e2", "e1", "e3"], ["e1", "e3", "e2"], ["e3", "e2", "e1"], ["e1", "e2", "e3"]]
    assert ids(ledger.in_folder(df, search=" alpha ")) == ["e1", "e3"] and ids(ledger.in_folder(df, status="MISMATCH", mark="ok")) == ["e2"]


def test_addresses_follow_the_account(spark):
    users = spark.createDataFrame([(1, "A@x.example"), (2, "old@x.example"), (3, "c@x.example")], "id int, email string")
    accounts = spark.createDataFrame([(1, "a@X.example"), (2, "New@x.example")], "id int, email string")
    assert sorted(map(tuple, ledger.emails_synced(users, accounts).collect())) == [(1, "A@x.example"), (2, "new@x.example"), (3, "c@x.example")]


def test_replies_and_corrections(spark):
    reviews = spark.createDataFrame([("u", "e1", "demo", "ok", 1)], "user_id string, email_ref string, source string, mark string, updated_at int")
    replies = spark.createDataFrame([], "user_id string, email_ref string, to_address string, subject string, body string, sent_at int")
    fresh = spark.createDataFrame([("u", "e1", "demo", "back", "t", "s", "b", 2), ("u", "e2", "mailbox", "ok", "t", "s", "b", 3)], "user_id string, email_ref string, source string, mark string, to_address string, subject string, body string, at int")
    marks, sent = ledger.with_replies(reviews, replies, fresh)
    assert sorted((r["email_ref"], r["mark"]) for r in marks.collect()) == [("e1", "back"), ("e2", "ok")] and sorted((r["email_ref"], r["sent_at"] or 0) for r in sent.collect()) == [("e1", 0), ("e2", 3)]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_vectors_and_their_ties(spark, k):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)] + [(20, [0.0, 1.0]), (21, None), (22, [1.0, 0.0, 0.0]), (23, [])], "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "query_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.match(vectors, queries, 0.5, k).collect())
    assert got == [(1, i + 1, i) for i in range(k)] + [(2, 1, 20)]
    assert retrieval.match(vectors, queries.limit(0), 0.5, k).count() == 0


def test_batches_are_taken_up_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, prompt string")
    calls = {"odd": lambda x: x.upper() if int(x[1:]) % 2 else None, "all": str.upper}
    at = f"file://{tmp_path}/answers"
    outcome = [tuple(batch.run(rows, "id", "prompt", calls[k], at).first()) for k in ("odd", "all", "all")]
    assert outcome == [(3, 0, 3), (3, 3, 0), (0, 6, 0)]
    assert sorted(tuple(r) for r in batch.answers(spark, at, "id", "bigint").select("id", "answer").collect()) == [(i, f"T{i}") for i in range(6)]
    assert [r["email_id"] for r in batch.newest(spark.createDataFrame([("a",), ("c",), ("b",)], "email_id string"), 2).collect()] == ["c", "b"]
    assert [tuple(r) for r in batch.tally(spark.createDataFrame([("x",), ("y",), ("y",), ("w",)], "k string"), "k").collect()] == [("y", 2), ("w", 1), ("x", 1)]
