"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader deals byte ranges of the
files to tasks. A task looks for gzip magic in its range, accepts a candidate
only if it inflates to a WARC header, and owns the records of the members that
start inside the range, reading past its end to finish the last one. Files are
opened through pyarrow's file systems, so the folder may be any that all
executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import BROADCAST_ROWS, bounded_batches, new_folder, written
from quaystone.session import table

#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000
RANGE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
_ID = "<urn:quaystone:page:{}>"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{coded}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        held = f"{root}/.attempt-{context.taskAttemptId()}"
        size = records = 0
        with fs.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for page_id, url, html, digest, refers_to in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                    member = _gzip(_record(page_id, url, (html or "").encode(), digest, refers_to))
                    out.write(member)
                    size += len(member)
                    records += 1
        if records:
            fs.move(held, name)  # a second attempt of the task replaces the file by the same bytes
            yield pa.record_batch([pa.array([folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])
        else:
            fs.delete_file(held)

    return run


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages with digest (hex SHA-1 of the payload) and refers_to: of equal
    payloads of LEAST_REVISIT bytes or more, the largest page_id where it is
    another. Rows that share the largest page_id are all written in full."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"))
    long = F.octet_length(payload) >= LEAST_REVISIT
    groups = pages.where(long).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    groups = written(groups, "equal-payloads")
    # at most BROADCAST_ROWS groups have more than a BROADCAST_ROWS-th of the repeated rows: those are sent to
    # the pages, so that no large group of pages is shuffled to one task; what is left are small groups
    size = -(-(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BROADCAST_ROWS)
    large = groups.where(F.col("n") > size).select("digest", F.col("kept").alias("kept_large"))
    joined = pages.join(F.broadcast(large), "digest", "left")
    rest = groups.where(F.col("n") <= size).select("digest", F.col("kept").alias("kept_small"))
    if size > 1:  # else no group is left
        alone = joined.where("kept_large is not null").withColumn("kept_small", F.lit(None).cast(groups.schema["kept"].dataType))
        joined = joined.where("kept_large is null").join(rest, "digest", "left").unionByName(alone)
        kept = F.coalesce("kept_large", "kept_small")
    else:
        kept = F.col("kept_large")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(kept), kept).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record a row of pages (page_id, url, html) into folder, one
    file a partition; gives path, bytes, records of each file.

    A null html is an empty payload, a null url has no target header, a null
    page_id an empty id and is never referred to. Repeated rows are repeated
    records; a page of any length is one record; other columns, whatever their
    names, are ignored. No file comes from an empty table.
    """
    bounded_batches(pages.sparkSession)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return written(deduplicated(pages).mapInArrow(_writer(folder), "path string, bytes long, records long"), "warc-files")


def _member(read, data: bytes, at: int, after: int) -> tuple[bytes | None, int]:
    """The member that starts at data[at], if it inflates to WARC records, and
    its length; read(offset) gives the bytes that follow data, from after."""
    z = zlib.decompressobj(31)
    out, fed = [], 0
    piece = memoryview(data)[at : at + 4096]
    start, last, checked = b"", b"", False
    try:
        while True:
            out.append(z.decompress(piece))
            fed += len(piece)
            if not checked:  # a header may be of any length, as the writer's may
                start += out[-1][: 5 - len(start)]
                if not b"WARC/".startswith(start):
                    return None, 0
                last = last[-3:] + out[-1]
                checked = b"\r\n\r\n" in last
                if not checked and z.eof:
                    return None, 0
            if z.eof:
                return b"".join(out), fed - len(z.unused_data)
            if at + fed < len(data):
                piece = memoryview(data)[at + fed : at + fed + 65536]
            else:
                piece = read(after + at + fed - len(data))
                if not piece:
                    return None, 0
    except zlib.error:
        return None, 0


def _records(member: bytes) -> Iterator[tuple[dict, bytes, bool]]:
    """Header, block and whether the header tells its length of each record. A
    record that does not, or tells more than there is, has all that is left."""
    at = 0
    while member.startswith(b"WARC/", at):
        end = member.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = member[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        told = head.get("content-length", "")
        sound = told.isascii() and told.isdigit() and end + 4 + int(told) <= len(member)
        n = int(told) if sound else len(member) - end - 4
        yield head, member[end + 4 : end + 4 + n], sound
        at = end + 4 + n
        while member.startswith(b"\r\n", at):
            at += 2


_READ = "path string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string, payload_bytes long, payload_digest string, declared_digest string, status string, payload binary"
# Names of digests in a header.
_DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")


def _hex_digest(value: str, size: int) -> str | None:
    """A digest of so many bytes written in base 16 or base 32, as lower-case hex."""
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * size}}}", value):
        return value.lower()
    bare = value.rstrip("=").upper()
    if len(bare) == -(-8 * size // 5) and re.fullmatch("[A-Z2-7]*", bare):
        return base64.b32decode(bare + "=" * (-len(bare) % 8)).hex()
    return None


def _parsed(head: dict, block: bytes, sound: bool) -> tuple:
    kind = head.get("warc-type")
    declared = head.get("warc-payload-digest")
    name, _, value = (declared or "").rpartition(":")
    name = name.strip().lower().replace("-", "") or "sha1"
    told = _hex_digest(value.strip(), hashlib.new(name).digest_size) if declared and name in _DIGESTS else None
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not head.get("content-type", "").startswith("application/http") or not gap:
        http, payload = b"", block
    n = len(payload)
    status = "ok" if declared is None or told else "unknown digest"
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", http)
        n, payload, digest = int(m[1]) if m else None, None, told if name == "sha1" else None
    else:
        digest = hashlib.sha1(payload).hexdigest()
        if told and told != hashlib.new(name, payload).hexdigest():
            status = "digest differs"
    if not sound:
        status = "malformed length"
    return kind, head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), n, digest, declared, status, payload


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, start, end in zip(*[batch[c].to_pylist() for c in ("path", "start", "end")], strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                held, weight = [], 0
                with fs.open_input_file(name) as f:
                    data = f.read_at(end - start + len(MAGIC) - 1, start)
                    at = data.find(MAGIC)
                    while 0 <= at < end - start:
                        member, n = _member(lambda offset, f=f: f.read_at(65536, offset), data, at, start + len(data))
                        if member is not None:
                            for head, block, sound in _records(member):
                                kind, *rest, payload = _parsed(head, block, sound)
                                held.append((path, start + at, n, kind, *rest, payload if payloads else None))
                                weight += len(block) if payloads else 200
                            if weight > 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                                held, weight = [], 0
                        at = data.find(MAGIC, at + max(1, n))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of files (path, bytes). Bytes between members, and members
    that are cut off or hold no WARC header, are passed over.

    payload_digest is the SHA-1 of the payload, of a revisit that of its header
    if it is one; declared_digest is the header's as it stands. status is ok,
    unknown digest (one in a form that cannot be held against the payload),
    digest differs, or malformed length (the record then has the rest of its
    member); no record stops the job. A record of any length is read whole;
    an empty table of files gives an empty result. A file that is listed twice
    is read twice; a row without a path or without bytes names no file and
    gives no record."""
    files = files.where("path is not null and bytes is not null")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "bytes", at.alias("start")).select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end"))
    n = max(1, ranges.count())
    return ranges.repartition(n, "path", "start").mapInArrow(_reader(payloads), _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all pages, written and read back."""
    files = write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:(-?[0-9]+)>', 1) as long)")
    return read_warc(files, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept, strlen(html) >= {LEAST_REVISIT} AS long FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN long AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN long AND page_id <> kept THEN kept END AS refers_to FROM q"""
