"""Records whose header is longer than any buffer."""

import random

from quaystone.llm import warc
from quaystone.llm.shared import new_folder


def test_long_headers_are_read(spark):
    long = "".join(random.Random(7).choices([chr(i) for i in range(1, 33)], k=500_000))  # does not compress much
    pages = [(1, f"http://a.example/{long}", "one"), (2, "http://a.example/", "two"), (3, f"http://b.example/{long}", "x" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    files = warc.write_warc(df, new_folder(spark, "warc-heads"))
    for size in (1 << 16, 1 << 20):
        got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(files, size).collect()}
        assert got == {f"<urn:quaystone:page:{i}>": html for i, _, html in pages}
