"""Readers per format, and that none raises."""

import io
import zipfile

from pyspark.sql import functions as F

from quaystone.sources import readers


def _zip(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_every_format_and_broken_files(spark):
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    rows = "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in [("Shipper", "A &amp; B"), ("POL", "X"), ("POD", "Y")])
    docx = _zip({"word/document.xml": f"<w:document><w:p><w:r><w:t>BL DRAFT</w:t></w:r></w:p><w:tbl>{rows}</w:tbl></w:document>"})
    xml = "<row><c t='s'><v>0</v></c></row>".replace("'", '"') + "".join(f'<row><c t="inlineStr"><is><t>{a}</t></is></c><c><v>{b}</v></c></row>' for a, b in [("Containers", 2), ("Gross Weight (KG)", 100), ("POD", 7)])
    xlsx = _zip({"xl/worksheets/sheet1.xml": f"<worksheet>{xml}</worksheet>", "xl/sharedStrings.xml": "<sst><si><t>BL INSTRUCTION</t></si></sst>"})
    text = b"BILL OF LADING\n\nShipper: S\n  2 ROAD\nConsignee:\nC\nPOL: L\n\xff bad byte\n"
    edi = b"ISA*00*x~ST*304*1~N1*SH*S~N1*CN*C~R4*D*UN*BEANR~L0*1***2204.62*G******L~"
    files = [("a.docx", docx), ("a.xlsx", xlsx), ("a.txt", text), ("a.edi", edi), ("b.docx", b"no zip"), ("b.xlsx", b""), ("b.txt", b""), ("b.edi", b""), ("a.pdf", b"%PDF"), ("noext", None)]
    df = spark.createDataFrame(files, "path string, content binary").withColumn("format", F.lower(F.substring_index("path", ".", -1)))
    found = {r["path"]: r for r in readers.read_documents(df).collect()}
    assert len(found) == len(files)
    assert [(p["label"], p["value"]) for p in found["a.docx"]["pairs"]] == [("Shipper", "A & B"), ("POL", "X"), ("POD", "Y")]
    assert found["a.docx"]["title"] == "BL DRAFT" and found["a.xlsx"]["title"] == "BL INSTRUCTION"
    assert [(p["label"], p["value"]) for p in found["a.xlsx"]["pairs"]][:2] == [("Containers", "2"), ("Gross Weight (KG)", "100")]
    assert [(p["label"], p["value"]) for p in found["a.txt"]["pairs"]] == [("Shipper", "S\n2 ROAD"), ("Consignee", "C"), ("POL", "L")]
    assert ("gross weight", "1,000 KG") in [(p["label"], p["value"]) for p in found["a.edi"]["pairs"]]
    assert {k: r["status"] for k, r in found.items()} == {
        "a.docx": "ok", "a.xlsx": "ok", "a.txt": "ok", "a.edi": "ok", "b.docx": "unreadable", "b.xlsx": "unreadable", "b.txt": "unreadable", "b.edi": "unreadable", "a.pdf": "not_attempted", "noext": "not_attempted",
    }


def test_folder_of_messages(spark, tmp_path):
    (tmp_path / "email_001.json").write_text('{"email_id": "email_001", "from": "a@b.example",\n "subject": "s", "body": "b", "attachments": ["x_SI.txt"]}')
    row = readers.emails(spark, str(tmp_path)).first()
    assert row["sender_domain"] == "b.example" and row["attachments"] == ["x_SI.txt"]
    (tmp_path / "r.js").write_text('window.R = [{"id": 1}, {"id": 2}];\n')
    assert [r["id"] for r in readers.json_in_script(spark, str(tmp_path / "r.js"), "id int").collect()] == [1, 2]
