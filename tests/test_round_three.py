"""Masked texts come back whatever they hold; labels are looked up as they are
written; workers take bounded batches."""

import pytest
from pyspark.sql import functions as F

from quaystone.functions import documents, privacy
from quaystone.operators import batch
from quaystone.plans import reporting, upkeep

ODD = (
    "see <EMAIL_ADDRESS_1> and <EMAIL_ADDRESS_2>, ann.5@mail3.example.com",
    "account: 12345678 ann.5@mail3.example.com",  # the bank detail ends inside the address
    "cut off at ann.5@mail3",
    "ann.5@mail3.example.com and ann.5@mail3.example.com.The end",
    "ann.5@mail3.example.com, ANN@OTHER.EXAMPLE, +60 12-3456789",
    "",
    None,
)


def test_odd_texts_come_back_as_sql_says(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, reporting.pii_roundtrip(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(reporting.ORACLES["pii_roundtrip"]).fetchall())


def test_overlapping_finds_are_hidden_as_one():
    (hidden,), tokens = privacy._hidden(["account: 12345678 ann.5@mail3.example.com."])
    assert hidden == "<BANK_DETAILS_1>." and tokens == {"<BANK_DETAILS_1>": "account: 12345678 ann.5@mail3.example.com"}


@pytest.mark.parametrize("call", [upkeep.document_chunks, reporting.pii_mask, reporting.pii_mask_text, reporting.pii_roundtrip, lambda spark, at: batch.run(spark.range(2).selectExpr("id", "'x' AS t"), "id", "t", str.upper, f"{at}-batch")])
def test_workers_take_bounded_batches(spark, data, tmp_path, call):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "10000")
        call(spark, str(tmp_path) if call.__name__ == "<lambda>" else data)
        assert int(spark.conf.get(names[0])) == 1000 and int(spark.conf.get(names[1])) == 4 << 20
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)


def test_labels_are_found_as_before_the_look_up(spark):
    labels = [*documents.FIELD_OF_LABEL, "POL", " Gross  Weight (KG) ", "TOTAL\tContainers", "total  containers", "Total nothing", "Port\nof loading", "装运 POL", "x", "", None]
    known = F.create_map(*[F.lit(x) for pair in documents.FIELD_OF_LABEL.items() for x in pair])
    rows = spark.createDataFrame([(x,) for x in labels], "l string")
    got = rows.select(documents.canonical_field(F.col("l")), F.try_element_at(known, documents.clean_label(F.col("l")))).collect()
    assert all(a == b for a, b in got)
