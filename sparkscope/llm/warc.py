"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records by joins.

1. Each row's payload gets a SHA-256 key and a SHA-1 digest. Of rows with equal
   payloads the one with the smallest id is a ``response``, the others are
   ``revisit`` records that refer to it; ids and digests decide this, no
   payload is moved for it.
2. The archive is two tables: ``headers`` has the exact header block of every
   record and its payload's key, ``payloads`` has each payload once. Writing
   verifies that rows with one key also agree in length and SHA-1.
3. Reading joins both by the key. Length and SHA-1 are measured on the stored
   bytes and held against what the record's own header says, so a payload that
   was changed, or stored under a wrong key, raises.

``write_warc`` and ``read_warc`` exchange the same records with other programs
as WARC/1.1 files. Everything but that file parser is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.session import materialise

#: Payloads of at least so many bytes are stored once and revisited; smaller ones are responses throughout.
MIN_BYTES = 0
#: Fixed values of WARC/1.1: version line, line end, profile of revisits by digest; the digits of base 32 in RFC 4648 and in ``conv``.
VERSION, END, PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


@dataclass(frozen=True)
class Archive:
    """``headers``: page_id, key, header; ``payloads``: key, payload."""

    headers: DataFrame
    payloads: DataFrame


def base32(hex_: Column) -> Column:
    """Base 32 of 40 hexadecimal digits: 5 of these are 4 digits there."""
    parts = (F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8))
    return F.translate(F.concat(*parts), CONV32, BASE32)


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def record_id(id_: Column) -> Column:
    """A name for the record of an id: the same in every run."""
    h = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def header_block(id_: Column, url: Column, type_: Column, refers_to: Column, n_bytes: Column, digest: Column, date: str) -> Column:
    """The header of a record, up to and with its empty line; fields without a value are left out, white space in the address is encoded."""
    target = F.replace(F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("\t"), F.lit("%09")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = type_ == "revisit"
    fields = {
        "WARC-Type": type_,
        "WARC-Record-ID": record_id(id_),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), digest),
        "WARC-Refers-To": F.when(revisit, record_id(refers_to)),
        "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
        "X-Page-Id": id_.cast("string"),
        "X-Refers-To-Page-Id": F.when(revisit, refers_to.cast("string")),
        "X-Payload-Length": n_bytes.cast("string"),
        "Content-Type": F.lit("text/html; charset=utf-8"),
        "Content-Length": F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string")),
    }
    return F.concat(F.concat_ws(END, F.lit(VERSION), *(F.concat(F.lit(f"{name}: "), value) for name, value in fields.items())), F.lit(END + END))


def field(header: Column, name: str) -> Column:
    """A field of a header block; null if it has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{END}{name}: ")), found)


def write_archive(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """The archive of ``rows``, written to the shared folder.

    A null payload is empty. Each row is a record of its own, repeated ones
    too: all rows with the smallest id of a payload are responses. A row
    without an id counts after all others; such rows are responses if no row
    with their payload has an id. A null url gives no address field. Columns of
    any other name are not read; an empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    given = rows.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256)).alias("key")
    size = F.octet_length("payload").cast("long").alias("n_bytes")
    told = materialise(given.select("page_id", "url", key, size, payload_digest(F.col("payload")).alias("digest")))
    shared = told.where(F.col("n_bytes") >= min_bytes).groupBy(F.col("key").alias("shared_key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    joined = told.join(shared, (F.col("key") == F.col("shared_key")) & (F.col("n_bytes") >= min_bytes), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = joined.withColumns({"type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first_id"))})
    header = header_block(F.col("page_id"), F.col("url"), F.col("type"), F.col("refers_to"), F.col("n_bytes"), F.col("digest"), date)
    # of each payload one copy a task is shuffled, and rows with its key have to agree in a second digest
    sums = F.struct(F.octet_length("payload"), F.sha1("payload"))
    once = given.select(key, "payload", sums.alias("sums")).groupBy("key").agg(F.any_value("payload").alias("payload"), F.min("sums").alias("least"), F.max("sums").alias("most"))
    bad = F.raise_error(F.concat(F.lit("different payloads have the SHA-256 "), F.hex("key")))
    once = once.select("key", F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(bad.cast("binary")).alias("payload"))
    return Archive(materialise(typed.select("page_id", "key", header.alias("header"))), materialise(once))


def read_index(archive: Archive) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): what the records say, held against the stored bytes.

    A stored payload is measured once, however many records share it, and only
    its measures are joined. Raises if a payload is missing or is not what the
    header says.
    """
    measured = archive.payloads.select(F.col("key").alias("stored"), F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest"), (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("sound"))
    rows = archive.headers.join(measured, F.col("key") == F.col("stored"), "left")
    header = F.col("header")
    sound = F.col("sound") & (field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field(header, "X-Payload-Length").cast("long") == F.col("payload_bytes"))
    bad = F.raise_error(F.concat(F.lit("the payload stored for this record is not what it says: "), header))
    return rows.select(
        field(header, "X-Page-Id").cast("long").alias("page_id"), field(header, "WARC-Target-URI").alias("url"),
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload_bytes")).otherwise(bad.cast("long")).alias("payload_bytes"), "payload_digest",
        field(header, "WARC-Type").alias("record_type"), field(header, "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


def read_records(archive: Archive) -> DataFrame:
    """(page_id, record_type, header, payload, record binary): every record with its payload, revisits too; ``record`` is as in a WARC file.

    Here payloads are joined as bytes: one that many records share travels to
    each of them, in parts if adaptive execution finds its partition skewed.
    """
    rows = archive.headers.join(archive.payloads.withColumnRenamed("key", "stored"), F.col("key") == F.col("stored"))
    type_ = field(F.col("header"), "WARC-Type")
    block = F.when(type_ == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", type_.alias("record_type"), "header", "payload", F.concat(F.col("header").cast("binary"), block).alias("record"))


def write_warc(archive: Archive, folder: str, compression: str = "gzip", records_per_file: int = 10_000) -> None:
    """Write the records as WARC files. A record ends with two line ends, which is what the text writer puts after each row."""
    text = read_records(archive).select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END + END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(folder)


_FILE_ROW = "path string, start long, header string, block binary, complete boolean"


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = [f.split()[0] for f in _FILE_ROW.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            data = content.as_buffer().to_pybytes()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            at, rows, held = 0, [], 0
            while at < len(data):
                stop = data.find(b"\r\n\r\n", at)
                header = data[at : stop + 4 if stop >= 0 else len(data)].decode("utf-8", "replace")
                said = [line.partition(":")[2].strip() for line in header.split("\r\n") if line.lower().startswith("content-length:")]
                known = stop >= 0 and header.startswith("WARC/") and bool(said) and said[0].isdigit()
                end = stop + 4 + int(said[0]) if known else len(data)
                block = data[stop + 4 : end] if known else b""
                rows.append((path, at, header, block, known and data[end : end + 4] == b"\r\n\r\n"))
                at, held = end + 4, held + len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, start, header, block, complete): the records of WARC files, plain or gzip; a file is read by one task.

    Records are told apart by their lengths, so a payload may hold anything.
    Where a file breaks off or is none, what is left is one row that is not
    ``complete``, and an empty file has none.
    """
    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(_parsed, _FILE_ROW)
