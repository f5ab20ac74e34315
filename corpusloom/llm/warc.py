"""ARC archives converted to WARC, written and read back (operator 5).

``write_arc`` stores pages as ARC files of version 1 or 2, ``convert`` parses
the files by their version's header line and the declared lengths and makes the
equivalent WARC fields, ``write_warc`` writes WARC/1.1 files with revisit
records for repeated payloads, ``read_warc`` reads them back by Content-Length.

Each archive is one part file of Spark's text writer in the shared folder, a
gzip stream. Within a task the records are joined to blocks of ``BLOCK_BYTES``
or one larger record, without a shuffle; a block is a row for the writer, the
blank lines that must follow a record are its line separator, and
``ARCHIVE_BLOCKS`` rows are a file. So a reader task holds 64 MB at a time,
whatever the size of the pages, or as many of the largest ones as a file has
blocks. Each WARC file begins with a ``warcinfo`` record. Writers commit
through Spark, so a lost executor's files are written again.

Cases: a null html is an empty payload; a null url, or characters that the
space-separated ARC line can't hold, are percent-encoded, the record type and
digest do not depend on it; an empty table gives no records. Foreign archives
are bytes from end to end: payloads and HTTP headers of any encoding are kept as
they are, and so are addresses, whose bytes beyond ASCII are percent-encoded. A
record without an address has no WARC-Target-URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.tables import shared_dir, staged

#: Bytes at which a block of records is full, and blocks in an archive.
BLOCK_BYTES, ARCHIVE_BLOCKS = 8 << 20, 8
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 0
#: The fields of a record's header line, by version of the ARC format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
_DATE = "20240101000000"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/archives/{label}-{uuid.uuid4().hex}"


def _write_archives(records: DataFrame, begin: Column, folder: str, separator: str) -> None:
    """Store ``records`` (value: one record, as bytes) in gzip files of ``folder``; each file begins with the text of the column ``begin``."""
    import pyarrow as pa

    full, ends = BLOCK_BYTES, separator.encode()

    def run(batches):
        group, held = [], 0
        for batch in batches:
            for record in batch.column(0):
                group.append(record.as_py())
                held += len(group[-1])
                if held >= full:
                    yield pa.RecordBatch.from_arrays([pa.array([ends.join(group)], pa.binary())], names=["value"])
                    group, held = [], 0
        if group:
            yield pa.RecordBatch.from_arrays([pa.array([ends.join(group)], pa.binary())], names=["value"])

    # A partition's rows are numbered from a multiple of 2 ** 33, and each ARCHIVE_BLOCKS of them are a file.
    blocks = records.mapInArrow(run, "value binary").withColumn("_at", F.monotonically_increasing_id())
    first = F.pmod(F.pmod(F.col("_at"), F.lit(1 << 33)), F.lit(ARCHIVE_BLOCKS)) == 0
    # Bytes stay what they are in Spark's strings, and its text writer puts them out unchanged.
    value = F.col("value").cast("string")
    stored = blocks.select(F.when(first, F.concat(begin, F.lit(separator), value)).otherwise(value).alias("value"))
    stored.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_BLOCKS).text(folder)


def write_arc(pages: DataFrame, folder: str, version: int = 1, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Store ``pages`` as ARC files in ``folder``: a version block, then a record for each page.

    The stored content is an HTTP response whose header X-Page-Id keeps the key.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\r\n\r\n"), body)
    # The line is ASCII cut at spaces, so an address with anything else is percent-encoded.
    address = F.when(F.col(url).rlike("^[!-~]+$"), F.col(url)).when(F.col(url) != "", F.regexp_replace(F.url_encode(F.col(url)), r"\+", "%20")).otherwise(F.lit("-"))
    names = ARC_FIELDS[version]
    fields = {"url": address, "ip": F.lit("0.0.0.0"), "date": F.lit(_DATE), "type": F.lit("text/html"), "length": F.octet_length(http).cast("string"), "code": F.lit("200"), "checksum": F.lit("-"), "location": F.lit("-"), "offset": F.lit("0"), "filename": F.lit("pages.arc")}
    record = F.concat(F.concat_ws(" ", *[fields[n] for n in names]), F.lit("\n"), http)
    fixed = f"{version} 0 own\n" + " ".join(ARC_FIELDS[version]) + "\n"
    line = {"url": "filedesc://pages.arc", "ip": "0.0.0.0", "date": _DATE, "type": "text/plain", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc", "length": str(len(fixed))}
    block = " ".join(line[n] for n in names) + "\n" + fixed
    _write_archives(pages.select(record.cast("binary").alias("value")), F.lit(block), folder, "\n")


def arc_records(data: bytes):
    """The records of an ARC file: a dict of header fields and the content, the version block left out.

    The version block says by which line the records are parsed; the declared
    length says where the content ends, whatever stands in it.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        # Old archives have addresses in any encoding; Latin-1 keeps each byte, as one character.
        values = data[at:end].decode("latin-1").split(" ")
        if values[0].startswith("filedesc:"):
            version = int(data[end + 1 : end + 2])
        names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ValueError(f"an ARC header line of version {version} has {len(values)} fields")
        head = dict(zip(names, values))
        stop = end + 1 + int(head["length"])
        if stop > len(data):
            raise ValueError("an ARC record is shorter than declared")
        if not head["url"].startswith("filedesc:"):
            yield head, data[end + 1 : stop]
        at = stop + 1  # a line feed ends each record


def _identifier(*parts: str) -> str:
    """A urn:uuid made from what the record holds, so that reruns give the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


CONVERTED = T.StructType([T.StructField(n, k) for n, k in (("page_id", T.LongType()), ("url", T.StringType()), ("record_id", T.StringType()), ("date", T.StringType()), ("ip", T.StringType()), ("http", T.BinaryType()), ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("block_digest", T.StringType()))])


def _warc_fields(head: dict, content: bytes) -> tuple:
    http, _, payload = content.partition(b"\r\n\r\n")
    page = re.search(rb"X-Page-Id: (-?\d+)", http)
    d = head["date"].ljust(14, "0")
    url = "" if head["url"] == "-" else re.sub("[^!-~]", lambda c: f"%{ord(c[0]):02X}", head["url"])
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    own = page[1].decode() if page else ""
    digest = payload_digest(payload)
    return (int(own) if own else None, url, _identifier(own, url, date, digest), date, head["ip"], http, payload, len(payload), digest, payload_digest(content))


def _batches(rows, schema, most: int = 4 << 20):
    """Arrow batches of about ``most`` bytes of ``rows``, tuples in the order of ``schema``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held, group = to_arrow_schema(schema), 0, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), arrow)], schema=arrow)
    for row in rows:
        group.append(row)
        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if held > most:
            yield made()
            held, group = 0, []
    if group:
        yield made()


def _files(spark, folder: str) -> DataFrame:
    """Each archive as a row (content)."""
    return spark.read.format("binaryFile").load(folder).select("content")


def convert(spark, folder: str) -> DataFrame:
    """The records of all ARC files of ``folder`` with the fields of their WARC equivalents."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = gzip.decompress(batch.column(0)[i].as_py())
                yield from _batches((_warc_fields(*x) for x in arc_records(data)), CONVERTED)

    return _files(spark, folder).mapInArrow(run, CONVERTED)


def first_pages(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(_digest, _bytes, _first, _first_record) of the payloads that more than one record has: their smallest page_id and that page's record_id, url and date.

    Equal payloads are found on (digest, length) with partial minima, so a
    payload of very many pages is no hot task.
    """
    groups = records.groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))).alias("_record")
    found = groups.agg(first, F.count("*").alias("_n")).where(f"_n > 1 AND _bytes >= {least}")
    return found.select("_digest", "_bytes", F.col("_record.page_id").alias("_first"), F.col("_record").alias("_first_record"))


def with_revisits(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """``records`` with record_type and refers_to: of equal payloads ``first_pages`` names the response.

    An equi-join by the size of ``firsts``: where that is too large to be
    broadcast, Spark splits what is skewed.
    """
    joined = records.join(firsts, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("_first"), F.lit(False))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).withColumn("refers", F.when(revisit, F.col("_first_record"))).drop("_digest", "_bytes", "_first", "_first_record")


def write_warc(records: DataFrame, folder: str) -> None:
    """A WARC/1.1 record for each row of ``records`` (see ``with_revisits``), in gzip files of ``folder``.

    A revisit record keeps the payload too, so that every archive stands alone;
    its profile names the identical payload digest, its headers the record, address, date and page referred to.
    """
    def head(name: str, value) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))

    given = lambda name, value: F.when(value != "", head(name, value)).otherwise(F.lit(""))
    http = F.concat(F.col("http"), F.lit(b"\r\n\r\n"), F.col("payload")).cast("string")
    revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.col("record_type")), head("WARC-Record-ID", F.col("record_id")), head("WARC-Date", F.col("date")),
        given("WARC-Target-URI", F.col("url")), given("WARC-IP-Address", F.when(F.col("ip").isin("0.0.0.0", "-"), "").otherwise(F.col("ip"))), head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), head("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest"))),
        F.when(revisit, F.concat(head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), head("WARC-Refers-To", F.col("refers.record_id")), given("WARC-Refers-To-Target-URI", F.col("refers.url")), head("WARC-Refers-To-Date", F.col("refers.date")), head("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        head("Content-Type", F.lit("application/http;msgtype=response")), head("Content-Length", F.octet_length(http).cast("string")), F.lit("\r\n"), http,
    )
    about = "software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
    own = F.regexp_replace(F.md5(F.concat(F.lit(folder), F.col("_at").cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    info = F.concat(F.lit("WARC/1.1\r\n"), head("WARC-Type", F.lit("warcinfo")), head("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))), head("WARC-Date", made), head("Content-Type", F.lit("application/warc-fields")), head("Content-Length", F.lit(str(len(about)))), F.lit("\r\n" + about))
    _write_archives(records.select(record.cast("binary").alias("value")), info, folder, "\r\n\r\n")


def warc_records(data: bytes):
    """The records of a WARC file: a dict of header fields and the block, cut by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("latin-1").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is not as long as declared")
        yield head, data[end + 4 : stop]
        at = stop + 4


READ = T.StructType([T.StructField(n, k) for n, k in (("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("record_id", T.StringType()), ("digest_ok", T.BooleanType()))])


def _read_fields(head: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    page = re.search(rb"X-Page-Id: (-?\d+)", http)
    digest, to = payload_digest(payload), head.get("X-Refers-To-Page")
    return (int(page[1]) if page else None, len(payload), digest, head["WARC-Type"], int(to) if to else None, head["WARC-Record-ID"], head["WARC-Payload-Digest"] == f"sha1:{digest}" and head["WARC-Block-Digest"] == f"sha1:{payload_digest(block)}")


def read_warc(spark, folder: str) -> DataFrame:
    """The responses and revisits in all WARC files of ``folder``; payload sizes and digests are computed from what was read."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = gzip.decompress(batch.column(0)[i].as_py())
                yield from _batches((_read_fields(*x) for x in warc_records(data) if x[0]["WARC-Type"] in ("response", "revisit")), READ)

    return _files(spark, folder).mapInArrow(run, READ)


def pages_to_warc(pages: DataFrame, version: int = 1) -> str:
    """Write ``pages`` as ARC, convert them, write WARC; returns the folder of the WARC files."""
    spark = pages.sparkSession
    arc, warc = _folder(spark, "arc"), _folder(spark, "warc")
    write_arc(pages.select("page_id", "url", "html"), arc, version)
    # Records are parsed twice: first for their digests alone, so that payloads aren't stored once more.
    digests = convert(spark, arc).select("page_id", "record_id", "url", "date", "payload_digest", "payload_bytes")
    write_warc(with_revisits(convert(spark, arc), staged(first_pages(digests), "arc-repeats")), warc)
    return warc
