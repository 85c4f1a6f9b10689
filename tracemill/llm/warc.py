"""WARC archives of web pages: a writer that dedupes payloads, and a salvage reader.

Writing: one gzip member a record. Of the records with equal payloads of at least `MIN_REVISIT`
bytes, that with the largest page id is a response and the others are revisits that refer to it;
smaller payloads are all responses. Each task writes one file under a name of its own and renames
it when whole, so a task that runs again replaces what it wrote.

Reading: a member or record is checked (inflation and its CRC, version line, header block,
content length, end mark, payload digest). After a failed check the reader searches for the next
valid member (gzip magic that inflates to a version line) or, in plain archives, the next version
line, goes on from there, and reports the bytes in between as a gap: file, start, length, reason.
Archives of others are read too: any WARC/x.y, digests in hex or base32 (of the body behind an HTTP
head), members of several records, where only the part that fails is a gap, in inflated bytes.

Edge cases: a long payload is one record, and a task holds one archive and one inflated member at
a time; a null html is an empty payload; a null url is written as empty; a null page id is
smaller than any other; ids of any type that text can hold come back as they were; repeated rows with the winning page id are each a response; an empty
table makes no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, LongType, StringType, StructField, StructType

from .common import scratch_dir

MIN_REVISIT = 1000
LEVEL = 1
VERSION = b"WARC/1.1\r\n"
#: The version line of any archive, and how far it can reach.
ANY_VERSION = re.compile(rb"WARC/[0-9]{1,3}\.[0-9]{1,3}\r\n")
VERSION_BYTES = 14
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

RECORD = StructType(
    [
        StructField("file", StringType()),
        StructField("offset", LongType()),
        StructField("record_type", StringType()),
        StructField("record_id", StringType()),
        StructField("url", StringType()),
        StructField("payload_digest", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("refers_to", StringType()),
        StructField("payload", BinaryType()),
        StructField("gap_bytes", LongType()),
        StructField("gap_reason", StringType()),
    ]
)


# -- one record -------------------------------------------------------------------------------


def urn(page_id: int | str | None) -> str:
    """A page's name: the digits of a whole number, null, or any other id's text, escaped."""
    plain = page_id is None or re.fullmatch(r"-?[0-9]+", str(page_id)) and not isinstance(page_id, str)
    return "<urn:page:%s>" % ("null" if page_id is None else page_id if plain else f"text:{quote(page_id, safe='')}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of a record; refers_to makes it a revisit, which has no payload."""
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = b"" if refers_to else payload
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + END


def member(data: bytes) -> bytes:
    """One gzip member; the header holds no time, so equal records make equal bytes."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def entity(block: bytes) -> bytes:
    """The body behind an HTTP head, as it was sent; a block without one is all body."""
    if not block.startswith(b"HTTP/"):
        return block
    stop = re.search(rb"\r?\n\r?\n", block)
    return block[stop.end() :] if stop else b""


def _bytes_of(digest: str) -> tuple[str, bytes | None]:
    """Algorithm and value of a digest in hex or base32; None where it is neither."""
    name, colon, text = digest.strip().rpartition(":")
    name = name.lower().replace("-", "") if colon else "sha1"
    size = hashlib.new(name).digest_size if name in ("md5", "sha1", "sha256", "sha512") else 0
    try:
        if size and len(text) == 2 * size:
            return name, bytes.fromhex(text)
        value = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
        return name, value if len(value) == size else None
    except ValueError:
        return name, None


def _agrees(digest: str, data: bytes) -> bool:
    """Whether data has the digest; one that is absent or of an unknown kind cannot differ."""
    name, colon, _ = digest.strip().rpartition(":")
    if not digest or (colon and name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512")):
        return True
    name, value = _bytes_of(digest)
    return value is not None and hashlib.new(name, data).digest() == value


def _hex(digest: str) -> str:
    """A digest without its algorithm, in lower-case hex where it can be read."""
    value = _bytes_of(digest)[1]
    return value.hex() if value is not None else digest.removeprefix("sha1:").lower()


def parse(data: bytes, start: int) -> tuple[dict, int]:
    """The record at start and the place after it; ValueError says which check failed."""
    version = ANY_VERSION.match(data, start)
    if not version:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", start)
    if stop < 0:
        raise ValueError("header block without an end")
    head = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and head:  # a folded header goes on
            head[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        name = name.strip().lower()
        head[name] = value.strip().decode("utf-8", "replace")
    length = head.get(b"content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    body = stop + 4
    end = body + int(length)
    if data[end : end + 4] != END:
        raise ValueError("no end mark after the content")
    payload = bytes(data[body:end])
    kind = head.get(b"warc-type")
    block = payload
    if kind == "response" and head.get(b"content-type", "").lower().startswith("application/http"):
        payload = entity(block)
    digest = head.get(b"warc-payload-digest", "")
    if kind == "response" and not _agrees(digest, payload):
        raise ValueError("payload digest differs")
    if not _agrees(head.get(b"warc-block-digest", ""), block):
        raise ValueError("block digest differs")
    digest = _hex(digest)
    stated = head.get(b"x-payload-length", "")
    return {
        "record_type": kind,
        "record_id": head.get(b"warc-record-id"),
        "url": head.get(b"warc-target-uri"),
        "payload_digest": digest or hashlib.sha1(payload).hexdigest(),
        "payload_bytes": int(stated) if kind == "revisit" and stated.isdigit() else len(payload),
        "refers_to": head.get(b"warc-refers-to"),
        "payload": payload,
    }, end + 4


# -- salvage ----------------------------------------------------------------------------------


def inflate(data: bytes, start: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The content of the gzip member at start and the place after it."""
    d, out, at = zlib.decompressobj(31), [], start
    view = memoryview(data)
    while not d.eof:
        if at >= len(data):
            raise ValueError("member without an end")
        try:
            out.append(d.decompress(view[at : at + step]))
        except zlib.error as e:
            raise ValueError(f"member does not inflate: {e}") from None
        at = min(at + step, len(data))
    return b"".join(out), at - len(d.unused_data)


def _opens(data: bytes, at: int) -> bool:
    """Whether a gzip member at `at` begins with a version line."""
    try:
        return ANY_VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 512], VERSION_BYTES)) is not None
    except zlib.error:
        return False


class _Finder:
    """Finds the next place where a member or record begins. The next version line is kept until it is passed, so a damaged archive is scanned once."""

    def __init__(self, data: bytes):
        self.data, self.plain = data, -1

    def after(self, start: int) -> int:
        """The first such place from start on, or the end."""
        if self.plain < start:
            version = ANY_VERSION.search(self.data, start)
            self.plain = version.start() if version else len(self.data)
        at = self.data.find(MAGIC, start, self.plain)
        while at >= 0:
            if _opens(self.data, at):
                return at
            at = self.data.find(MAGIC, at + 1, self.plain)
        return self.plain


def _records(content: bytes, offset: int) -> Iterator[dict]:
    """Records of an inflated member, all with its offset, and gaps counted in inflated bytes."""
    at, bad, reason = 0, None, ""
    while at < len(content):
        try:
            found, end = parse(content, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            version = ANY_VERSION.search(content, at + 1)
            at = version.start() if version else len(content)
            continue
        if bad is not None:
            yield {"offset": offset, "gap_bytes": at - bad, "gap_reason": f"in a member: {reason}"}
            bad = None
        yield {"offset": offset, **found}
        at = end
    if bad is not None:
        yield {"offset": offset, "gap_bytes": len(content) - bad, "gap_reason": f"in a member: {reason}"}


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, and a row with gap_bytes and gap_reason for each stretch that had none."""
    at, bad, reason, finder = 0, None, "", _Finder(data)
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                content, end = inflate(data, at)
                found = list(_records(content, at))
                if content and all("gap_bytes" in r for r in found):
                    raise ValueError(found[0]["gap_reason"].removeprefix("in a member: "))
            else:
                one, end = parse(data, at)
                found = [{"offset": at, **one}]
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = finder.after(at + 1)
            continue
        if bad is not None:
            yield {"offset": bad, "gap_bytes": at - bad, "gap_reason": reason}
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield {"offset": bad, "gap_bytes": len(data) - bad, "gap_reason": reason}


# -- on Spark ---------------------------------------------------------------------------------


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, keeper: the page id of the response with the same payload, null where the payload is single or small.

    Only digests move in the count; small payloads, and so empty pages, take no part in the join.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    small, large = rows.filter(F.octet_length("html") < min_revisit), rows.filter(F.octet_length("html") >= min_revisit)
    twice = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keeper")
    keeper = twice.schema["keeper"].dataType
    return small.withColumn("keeper", F.lit(None).cast(keeper)).unionByName(large.join(twice, "digest", "left").select(*rows.columns, "keeper"))


def _file_system(folder: str):
    """The file system of a URI. A bare path is only this machine's where the caller says so by `file:`."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"file://{folder.removeprefix('file:')}" if folder.startswith("file:/") and "://" not in folder else folder)


def _qualified(spark: SparkSession, folder: str) -> str:
    """folder with a scheme: a bare path lies on the cluster's default file system, as Spark's own readers take it."""
    if ":" in folder.split("/")[0]:
        return folder
    base = (spark.conf.get("spark.hadoop.fs.defaultFS", None) or "file:///").rstrip("/")
    return ("file://" if base == "file:" else base) + folder


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the archives below folder, which all executors reach; returns file, records, bytes by file, once they are there."""
    folder = _qualified(pages.sparkSession, folder)
    number = int if _whole_number(pages) else str
    _file_system(folder)[0].create_dir(_file_system(folder)[1], recursive=True)

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, path = _file_system(folder)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():05d}.warc.gz"
        own = f"{name}.{task.taskAttemptId()}.tmp"
        out, n, size = None, 0, 0
        for rows in batches:
            for page_id, url, html, digest, keeper in rows.itertuples(index=False):
                page_id, keeper = (None if pd.isna(x) else number(x) for x in (page_id, keeper))
                refers = urn(keeper) if keeper is not None and keeper != page_id else None
                data = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                out = out or system.open_output_stream(own)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            system.move(own, name)
            yield pd.DataFrame({"file": [name], "records": [n], "bytes": [size]})

    rows = planned(pages, min_revisit).select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("keeper").cast("string").alias("keeper"))
    made = rows.mapInPandas(tasks, "file string, records long, bytes long").collect()  # a row a file
    schema = "file string, records long, bytes long"
    return pages.sparkSession.createDataFrame([tuple(r) for r in made], schema)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (see RECORD) of the archives below folder; a task holds one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    names = RECORD.fieldNames()

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in rows.itertuples(index=False):
                found, size = [], 0
                for r in salvage(content):
                    if not payloads:
                        r.pop("payload", None)
                    found.append({"file": path, **r})
                    size += len(r.get("payload") or b"") + 200
                    if size > 4_000_000:
                        yield _frame(found, names)
                        found, size = [], 0
                if found:
                    yield _frame(found, names)

    return files.mapInPandas(tasks, RECORD)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names).astype(object)
    for c in ("offset", "payload_bytes", "gap_bytes"):
        out[c] = pd.array([None if pd.isna(x) else int(x) for x in out[c]], dtype="Int64")
    return out.where(out.notna(), None)


def _whole_number(pages: DataFrame) -> bool:
    return isinstance(pages.schema["page_id"].dataType, IntegralType)


def _page(column: str, pages: DataFrame):
    """The page id of a name, of the type that pages have; whole numbers as long."""
    if _whole_number(pages):
        return F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    text = r"^<urn:page:text:([^>]*)>$"
    return F.when(F.col(column).rlike(text), F.url_decode(F.regexp_extract(column, text, 1))).cast(pages.schema["page_id"].dataType)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the scratch area, read them back, and give page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = f"{scratch_dir(spark)}/warc"
    files = write(pages, folder)
    if files.isEmpty():
        return pages.limit(0).select(
            "page_id", F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"),
            F.lit(None).cast("long" if _whole_number(pages) else pages.schema["page_id"].dataType).alias("refers_to"),
        )
    rows = read(spark, folder, payloads=False).filter("gap_bytes IS NULL")
    return rows.select(
        _page("record_id", pages).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to", pages).alias("refers_to")
    )
