"""Small functions of replies, prompts, addresses and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import documents

#: Prefix of ids of messages from a live mailbox.
MAILBOX = "gmail_"
# What is taken out of a drafted reply.
DANGEROUS = ("<script>", "</script>", "javascript:")


def without_dangerous_tags(text: Column) -> Column:
    for tag in DANGEROUS:
        text = F.replace(text, F.lit(tag), F.lit(""))
    return text


def fenced(tag: str, text: Column, tags: tuple[str, ...]) -> Column:
    """text between <tag> and </tag>, with the opening brackets of any of tags
    inside it made harmless."""
    inside = F.regexp_replace(text, rf"(?i)<(\s*/?\s*(?:{'|'.join(tags)})\b)", "&lt;$1")
    return F.concat(F.lit(f"<{tag}>\n"), inside, F.lit(f"\n</{tag}>"))


def parsed_reply(text: Column) -> Column:
    """Struct (value, error): the JSON object of a reply as a map of texts, or
    why there is none."""
    held = documents.json_in(text)
    value = F.from_json(held, "map<string,string>")
    error = F.when(held.isNull(), "no object").when(F.try_parse_json(held).isNull(), "not JSON").when(value.isNull(), "not an object")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def attachment_line(paths: Column) -> Column:
    """How many files and their names, or `none`."""
    names = F.array_join(F.transform(paths, lambda p: F.substring_index(p, "/", -1)), ", ")
    return F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0, "none").otherwise(F.concat(F.size(paths).cast("string"), F.lit(" ("), names, F.lit(")")))


def caller_shape(address: Column) -> Column:
    """A network, never the whole address."""
    dots = F.length(address) - F.length(F.translate(address, ".", ""))
    six = F.concat(F.array_join(F.slice(F.split(address, ":"), 1, 3), ":"), F.lit(":x"))
    return F.when(address.contains(":"), six).when(dots == 3, F.concat(F.substring_index(address, ".", 3), F.lit(".x"))).otherwise("unknown")


def mailbox_id(message_id: Column) -> Column:
    return F.concat(F.lit(MAILBOX), message_id)


def message_id_of(email_id: Column) -> Column:
    """The mailbox's own id, null for messages that are not from it."""
    return F.when(email_id.startswith(MAILBOX), F.regexp_replace(email_id, f"^{MAILBOX}", ""))


def percent(share: Column) -> Column:
    """A share with one decimal, or `n/a`."""
    return F.when(share.isNull(), "n/a").otherwise(F.format_string("%.1f%%", share * 100))


def is_too_large(length: Column, is_upload: Column) -> Column:
    """A declared length over 17 MB for uploads, 2 MB for others."""
    return F.coalesce(length > F.when(is_upload, 17_000_000).otherwise(2_000_000), F.lit(False))


def inside(path: Column, own: Column, folder: str) -> Column:
    """Where an attachment path may be read: itself if it is one of the
    request's own files, else by its name in the folder's attachments, else
    below the folder by a relative path that does not climb; or null."""
    name = F.substring_index(path, "/", -1)
    climbs = F.exists(F.split(path, "/"), lambda x: x == "..")
    relative = F.when(~path.startswith("/") & ~climbs & path.contains("/"), F.concat(F.lit(f"{folder}/"), path))
    return F.when(F.array_contains(own, path), path).when(~name.isin("", ".", "..") & (path.startswith("/") | climbs | ~path.contains("/")), F.concat(F.lit(f"{folder}/attachments/"), name)).otherwise(relative)


def in_batches(rows: DataFrame, order: str, size: int, key: str) -> DataFrame:
    """rows with batch, so many a batch within each key, in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(at / size).cast("long"))


def uploaded(name: Column, data: Column, suffixes: tuple[str, ...] = ("txt", "docx", "xlsx", "pdf", "edi"), limit: int = 5_000_000) -> Column:
    """Struct (content, error) of an upload: its suffix is allowed, its data is
    base64 without anything else, and it is not too large."""
    content = F.when(data.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(data) % 4 == 0), F.try_to_binary(data, F.lit("base64")))
    error = F.when(~documents.attachment_format(name).isin(*suffixes) | ~name.contains("."), "kind not allowed").when(content.isNull(), "not base64").when(F.length(content) > limit, "too large")
    return F.struct(F.when(error.isNull(), content).alias("content"), error.alias("error"))
