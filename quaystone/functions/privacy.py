"""Masking of personal data.

Addresses, phones, card numbers and bank details are found by scans that take
time linear to the text, a batch of texts at a time; checksums (Luhn, IBAN mod
97) decide about numbers. Names are not recognised: that needs a language
model, and none is here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions import scan

# Domains of personal mail providers.
PERSONAL_DOMAINS = """
126.com 163.com aol.com gmail.com gmx.com googlemail.com hotmail.com icloud.com live.com mail.com me.com msn.com
outlook.com proton.me protonmail.com qq.com yahoo.co.uk yahoo.com yahoo.com.my yahoo.com.sg yandex.com zoho.com
""".split()
# Labels whose lines and values keep everything but bank details.
PROTECTED = """
consignee;container;gross weight;gross_weight_kg;notify party;notify_party;port of discharge;port of loading;
port_of_discharge;port_of_loading;shipper;vessel;voyage
""".replace("\n", "").split(";")

# Words that announce bank details, an abbreviation's dot or a space after each left open.
ACCOUNT_WORDS = ("acc", "account", "a/c", "bank a/c", "routing", "sort code")
NUMBER_WORDS = ("number", "num", "no")
SWIFT_WORDS = ("swift", "bic")
CODE_WORDS = ("code", "number", "no")
WIRE_WORDS = ("remittance", "beneficiary acc", "beneficiary account", "beneficiary bank")
#: What stands between an announcement and its value: a mark, perhaps a mark, blanks alone. No two runs of blanks adjoin.
_MARK, _PERHAPS_MARK, _BLANKS = r"\s*[:#-]\s*", r"\s*(?:[:#-]\s*)?", r"\s+"


def _words(words: tuple[str, ...]) -> str:
    """Any of the words, in either case, longer ones first; a space in one may be several or none."""
    return "(?i:" + "|".join(w.replace(" ", r"\s*") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


def announced(words: tuple[str, ...], then: tuple[str, ...], mark: str, value: str) -> str:
    """A pattern: one of words, perhaps one of then, the mark, the value."""
    noun = rf"(?:\s*{_words(then)})?\.?" if then else ""
    return rf"\b{_words(words)}\.?{noun}{mark}{value}"


#: What scan.email_spans finds, for engines that take time linear to the text for any pattern.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
# What regional numbers begin with; by kind, the first digit of the area and how many follow it, and how
# many digits a subscriber has.
REGION_PREFIXES = ("0", "60", "+60")
REGION_KINDS = {"mobile": ("1", 1, (7, 8)), "land line": ("3456789", 0, (6, 8))}


def phone_pattern() -> str:
    """North American numbers with their country code, and regional ones: a
    prefix, an area, a subscriber, with a space or hyphen between them or not."""
    gap, digit = "[ -]?", "[0-9]"
    kinds = [f"[{first}]{digit * more}{gap}{digit}{{{least},{most}}}" for first, more, (least, most) in REGION_KINDS.values()]
    return rf"\+1 \([0-9]{{3}}\) [0-9]{{3}}-[0-9]{{4}}|\b(?:{'|'.join(map(re.escape, REGION_PREFIXES))}){gap}(?:{'|'.join(kinds)})\b"


PHONE = phone_pattern()
ACCOUNT = announced(ACCOUNT_WORDS, NUMBER_WORDS, _PERHAPS_MARK, r"(?i:[0-9][0-9A-Z -]{5,25})\b")
_BANK_CODE = "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"
#: After a mark a bank code may be in either case; without one it is in capitals, as words may follow "swift".
SWIFT = announced(SWIFT_WORDS, CODE_WORDS, _MARK, rf"(?i:{_BANK_CODE})\b") + "|" + announced(SWIFT_WORDS, CODE_WORDS, _BLANKS, rf"{_BANK_CODE}\b")
WIRE = announced(WIRE_WORDS, (), _MARK, r"[^\n\r,;]{4,40}")
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"


def luhn(number: Column) -> Column:
    """Whether the digits of number pass the check-digit test."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("^[0-9]$")))
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return (F.size(digits) >= 13) & (F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0)


def iban_valid(code: Column) -> Column:
    """The mod 97 test, digit by digit."""
    x = F.upper(F.replace(code, F.lit(" "), F.lit("")))
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    symbols = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(symbols, F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)
    return (F.length(x) >= 15) & (rest == 1)


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.A)


_BANK = [_compiled(p) for p in (SWIFT, WIRE, ACCOUNT)]
_IBAN, _CARD, _PHONE = _compiled(IBAN), _compiled(CARD), _compiled(PHONE)


def _luhn_holds(number: str) -> bool:
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return len(digits) >= 13 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _iban_holds(code: str) -> bool:
    x = code.replace(" ", "").upper()
    return len(x) >= 15 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def without_contacts(text: str) -> str:
    return _PHONE.sub("<PHONE_NUMBER>", scan.replaced(text, scan.email_spans(text), "<EMAIL_ADDRESS>"))


def without_bank_details(text: str) -> str:
    """Announced details first, then numbers that pass their checksum; a longer
    number that holds the same characters stays."""
    for pattern in _BANK:
        text = pattern.sub("<BANK_DETAILS>", text)
    text = scan.replaced_if(text, _IBAN, _iban_holds, "<BANK_DETAILS>")
    return scan.replaced_if(text, _CARD, _luhn_holds, "<BANK_DETAILS>")


def is_protected_line(line: str) -> bool:
    label, colon, _ = line[:40].partition(":")
    return bool(colon) and label.removesuffix(" ").lower() in PROTECTED


def without_personal_data(text: str) -> str:
    """Line by line: one that begins with a protected label loses bank details
    only."""
    lines = map(without_bank_details, text.split("\n"))
    return "\n".join(line if is_protected_line(line) else without_contacts(line) for line in lines)


def _each(mask, texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else mask(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def mask_contacts(texts: pa.Array) -> pa.Array:
    """Texts with addresses and phones masked."""
    return _each(without_contacts, texts)


@F.arrow_udf(T.StringType())
def mask_bank(texts: pa.Array) -> pa.Array:
    """Texts with bank details masked."""
    return _each(without_bank_details, texts)


@F.arrow_udf(T.StringType())
def mask_text(texts: pa.Array) -> pa.Array:
    """Texts with personal data masked; a line that begins with a protected
    label loses bank details only."""
    return _each(without_personal_data, texts)


@F.arrow_udf(T.BooleanType())
def has_address(texts: pa.Array) -> pa.Array:
    """Whether a mail address is in a text; of null, null."""
    return pa.array([None if x is None else any(scan.email_spans(x)) for x in texts.to_pylist()], pa.bool_())


def is_personal(address: Column) -> Column:
    parts = F.split(F.lower(F.trim(address)), "@")
    return (F.size(parts) == 2) & F.coalesce(F.get(parts, F.lit(1)).isin(PERSONAL_DOMAINS), F.lit(False))


def mask_sender(address: Column) -> Column:
    return F.when(is_personal(address), "<PERSONAL_EMAIL>").when(address.contains("@"), F.concat(F.lit("user@"), F.substring_index(address, "@", -1))).otherwise(address)


_PAIRS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


@F.arrow_udf(_PAIRS)
def mask_pairs(lists: pa.Array) -> pa.Array:
    """Pairs (label, value) with the values of unprotected labels masked."""

    def masked(pair: dict) -> dict:
        label, value = pair["label"], pair["value"]
        if value is None or (label or "").strip().lower().startswith(tuple(PROTECTED)):
            return pair
        return {"label": label, "value": without_personal_data(value)}

    found = [None if x is None else [p and masked(p) for p in x] for x in lists.to_pylist()]
    return pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())])))


def _finds(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what is personal, whatever overlaps."""
    for start, end in scan.email_spans(text):
        yield start, end, "EMAIL_ADDRESS"
    for pattern in _BANK:
        for m in pattern.finditer(text):
            yield *m.span(), "BANK_DETAILS"
    for pattern, holds in ((_IBAN, _iban_holds), (_CARD, _luhn_holds)):
        for m in pattern.finditer(text):
            if holds(m[0]):
                yield *m.span(), "BANK_DETAILS"
    for m in _PHONE.finditer(text):
        yield *m.span(), "PHONE_NUMBER"


_SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.MapType(T.StringType(), T.StringType()))])


_TOKEN = re.compile("<[A-Z_]+_[0-9]+>")


def _hidden(texts: list[str | None]) -> tuple[list[str | None], dict[str, str]]:
    """The texts with numbered tokens, one numbering for all, and what each
    token stands for. A token that a text has already is given to nothing."""
    written = {token for text in texts for token in _TOKEN.findall(text or "")}
    number: dict[str, int] = {}
    by_value: dict[tuple[str, str], str] = {}
    out = []
    for text in texts:
        spans, end = [], -1
        for start, minus, kind in sorted((start, -end, kind) for start, end, kind in _finds(text or "")):
            if start >= end:
                spans.append((start, -minus, kind))
                end = -minus
            elif -minus > end:  # hidden as one, or the rest of it would stay
                spans[-1] = (spans[-1][0], -minus, spans[-1][2])
                end = -minus
        parts, done = [], len(text or "")
        for start, stop, kind in reversed(spans):
            value = text[start:stop]
            while (kind, value) not in by_value:
                number[kind] = number.get(kind, 0) + 1
                token = f"<{kind}_{number[kind]}>"
                if token not in written:
                    by_value[kind, value] = token
            parts += (text[stop:done], by_value[kind, value])
            done = start
        out.append(text if text is None else "".join(reversed([*parts, text[:done]])))
    return out, {token: value for (_, value), token in by_value.items()}


@F.pandas_udf(_SPAN)
def anonymize(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Numbered tokens in place of personal data, and what each stands for.
    Numbers count by kind from the end of the text; a value has one token;
    overlapping finds are one, of the kind of the earlier, longer."""
    for series in texts:
        out = []
        for text in series:
            (hidden,), tokens = _hidden([text])
            out.append({"text": hidden, "tokens": None if text is None else tokens})
        yield pd.DataFrame(out, columns=["text", "tokens"])


@F.pandas_udf(T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("tokens", T.MapType(T.StringType(), T.StringType()))]))
def anonymize_many(lists: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """anonymize over an array of texts with one numbering: a value has the
    same token in all of them."""
    for series in lists:
        out = []
        for texts in series:
            hidden, tokens = _hidden([]) if texts is None else _hidden(list(texts))
            out.append({"texts": None if texts is None else hidden, "tokens": tokens})
        yield pd.DataFrame(out, columns=["texts", "tokens"])


@F.arrow_udf(T.StringType())
def deanonymize(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    """The texts with their tokens put back, in one pass."""
    out = []
    for text, held in zip(texts.to_pylist(), tokens.to_pylist(), strict=True):
        known = dict(held or ())
        out.append(None if text is None else _TOKEN.sub(lambda m, known=known: known.get(m[0], m[0]), text))
    return pa.array(out, pa.string())
