"""Queries whose whole job SQL does not state, against brute force."""

import hashlib
import re
from html import unescape

from quaystone.functions import privacy
from quaystone.plans import catalogue


def luhn(found):
    d = [int(c) for c in found if c.isdigit()][::-1]
    return len(d) >= 13 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def mod_97(found):
    x = found.replace(" ", "").upper()
    return len(x) >= 15 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def masked(text):
    lines = []
    for line in text.split("\n"):
        for pattern in (privacy.SWIFT, privacy.WIRE, privacy.ACCOUNT):
            line = re.sub(pattern, "<BANK_DETAILS>", line, flags=re.ASCII)
        for pattern, valid in ((privacy.IBAN, mod_97), (privacy.CARD, luhn)):
            line = re.sub(pattern, lambda m, ok=valid: "<BANK_DETAILS>" if ok(m[0]) else m[0], line, flags=re.ASCII)
        if not any(line.lower().startswith((f"{x}:", f"{x} :")) for x in privacy.PROTECTED):
            line = re.sub(privacy.PHONE, "<PHONE_NUMBER>", re.sub(privacy.EMAIL, "<EMAIL_ADDRESS>", line, flags=re.ASCII), flags=re.ASCII)
        lines.append(line)
    return "\n".join(lines)


BANK = [
    None, "", "no data",
    "Shipper: a@b.com +1 (555) 123-4567 card 4111-1111-1111-1111\nc@d.com 5500 0000 0000 0004",
    "4111111111111111\n4111 1111 1111 1112 and 0124111111111111111 and 4111111111111111",
    "iban GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433\nSWIFT: DEUTDEFF500, bic: x",
    "Account No: 1234567890; a/c 99-88-77-66\nbeneficiary bank: First of Somewhere, city\nremittance: wire 12",
]


def check_masked(spark, folder):
    got = {r["doc_id"]: (r["text_md5"], r["n_emails"], r["n_phones"], r["n_bank"]) for r in catalogue.QUERIES["pii_mask_text"](spark, folder).collect()}
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        t = masked(r["text"] or "")
        want[r["doc_id"]] = (hashlib.md5(t.encode()).hexdigest(), *(t.count(f"<{k}>") for k in ("EMAIL_ADDRESS", "PHONE_NUMBER", "BANK_DETAILS")))
    assert got == want
    return sum(x[3] for x in got.values())


def test_masking_is_brute_force(spark, data, tmp_path):
    spark.createDataFrame(list(enumerate(BANK)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert check_masked(spark, str(tmp_path)) == 10
    assert check_masked(spark, data)


PAGES = [
    None, "", "<p> a &copy; b&nbsp;</p>\n", "&nbsp;&middot;&#xe9;&#233; &eacute &notit; &amp;lt; &lt;b&gt; &#39;&quot;&apos;", "&#128; &#x110000; &#xD800; &bogus; &NotEqualTilde; & &",
    "<script>&copy;</script>x<br/>y<td>z</tr>&hellip;\u00a0 ",
]


def test_entities_are_brute_force(spark, data, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for folder in (str(tmp_path), data):
        want = {}
        for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect():
            x = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", "", r["html"] or "")
            x = re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>|</(?:p|div|tr)\s*>", "\n", x))
            want[r["page_id"]] = hashlib.md5(unescape(x).strip().encode()).hexdigest()
        assert {r["page_id"]: r["text_md5"] for r in catalogue.QUERIES["html_full_text"](spark, folder).collect()} == want
