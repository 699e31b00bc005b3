"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

A record is a row: page_id, warc_type, record_id, refers_to, target_uri, date, content_type, headers (ordered name-value pairs),
block, block_digest, payload_digest, content_length (bytes of the block). Identifiers are version-5 style urn:uuid values made
from page id, URI, date, type and the digest of the response's payload, so reruns agree, captures of one page that differ have their own, and a
derivative can be linked without a join. The conversion record refers to the response and carries the
source's payload digest and content type; the metadata record refers to the response, names the conversion, and lists the
source's HTTP headers and digests. Digests are labelled sha256 in hexadecimal.

Null html is an empty payload and gives an empty conversion; a null URL gives the URI urn:none. Rows repeated in the input give
repeated records. No row meets another, so any key may be as frequent as it likes.

Files are written as one gzip member for each record, as readers of WARC files expect, and read back member by member, so no archive
has to fit in memory.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .html_extract import all_text

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
COLUMNS = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "headers", "block", "block_digest", "payload_digest", "content_length"]


def _urn(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _record_id(kind: str) -> Column:
    """Of the record of a kind made from the page at hand; source_digest is the digest of its response's payload."""
    return _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.col("target_uri"), F.col("date"), F.lit(kind), F.col("source_digest"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Ordered header fields; those with a null value are left out."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in pairs]), lambda f: f["value"].isNotNull())


def _record(df: DataFrame, kind: str, content_type: str, block: Column, refers: Column | None, payload: Column, extra: tuple[tuple[str, Column], ...] = ()) -> DataFrame:
    df = df.withColumn("warc_type", F.lit(kind)).withColumn("content_type", F.lit(content_type)).withColumn("block", block)
    df = df.withColumn("record_id", _record_id(kind))
    df = df.withColumn("refers_to", refers if refers is not None else F.lit(None).cast("string"))
    df = df.withColumn("block_digest", _digest(F.col("block"))).withColumn("payload_digest", payload).withColumn("content_length", F.octet_length("block").cast("long"))
    named = [("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
             ("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))), *extra, ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")),
             ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length"))]
    return df.withColumn("headers", _fields(*named))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | Column = DATE) -> DataFrame:
    """Response records of fetched pages (date: of all, or a column of WARC dates), with the columns http (header text) and payload beside those of a record."""
    uri = F.coalesce(F.regexp_replace(F.col(url_col), "[\\x00-\\x20]", "%20"), F.lit("urn:none"))
    p = pages.select(F.col(id_col).alias("page_id"), uri.alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"), (F.lit(date) if isinstance(date, str) else date).alias("date"))
    p = p.withColumn("source_digest", _digest(F.col("payload")))
    p = p.withColumn("http", F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF)))
    return _record(p, "response", "application/http; msgtype=response", F.concat("http", F.lit(CRLF), "payload"), None, F.col("source_digest"))


def _texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(all_text)


def derive(source: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records, in the columns COLUMNS."""
    text = F.pandas_udf(_texts, "string")
    kept = small_batches(source).select("page_id", "target_uri", "date", "http", F.col("record_id").alias("of"), "source_digest",
                         F.col("block_digest").alias("source_block"), text("payload").alias("text"))
    kept = kept.withColumn("own", F.explode(F.array(F.lit("conversion"), F.lit("metadata"))))
    sent = (("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Source-Content-Type", F.regexp_extract("http", "Content-Type: ([^\\r\\n]*)", 1)))
    conversion = _record(kept.filter("own = 'conversion'"), "conversion", "text/plain; charset=utf-8", F.col("text"), F.col("of"), _digest(F.col("text")), sent)
    lines = F.concat_ws(CRLF, F.concat(F.lit("conversion: <"), _record_id("conversion"), F.lit(">")), F.concat(F.lit("source-payload-digest: "), "source_digest"),
                        F.concat(F.lit("source-block-digest: "), "source_block"), F.concat(F.lit("text-digest: "), _digest(F.col("text"))), F.concat(F.lit("text-chars: "), F.char_length("text").cast("string")),
                        F.regexp_replace(F.rtrim(F.col("http"), F.lit(CRLF)), "(?m)^", "source-http: "))
    fields = F.concat(lines, F.lit(CRLF))
    metadata = _record(kept.filter("own = 'metadata'"), "metadata", "application/warc-fields", fields, F.col("of"), _digest(fields), sent)
    return conversion.select(*COLUMNS).unionByName(metadata.select(*COLUMNS))


def serialized(records: DataFrame) -> DataFrame:
    """The column record: each record's text up to the end of its block; two line ends come after it in a file."""
    head = F.array_join(F.transform("headers", lambda f: F.concat(f["name"], F.lit(": "), f["value"])), CRLF)
    return records.select(F.concat(F.lit("WARC/1.1" + CRLF), head, F.lit(CRLF + CRLF), "block").alias("record"))


#: The first bytes of every gzip member, and the member that ends a record: the two line ends that the format asks for.
MAGIC = b"\x1f\x8b\x08"
ENDING = gzip.compress((CRLF + CRLF).encode(), mtime=0)


def _members(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield b.map(lambda r: gzip.compress(r.encode("utf-8", "surrogatepass"), mtime=0))


def write_warc(records: DataFrame, path: str) -> None:
    """Write WARC files: a gzip member for each record, written by Spark's text writer, whose line separator is the member with the record's two line ends."""
    member = F.pandas_udf(_members, "binary")
    rows = small_batches(serialized(records)).select(member("record").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", ENDING.decode("latin-1")).text(path)


def _records(data: bytes) -> tuple[list[tuple], bytes]:
    """The whole records at the beginning of data, and what is left."""
    out = []
    while True:
        data = data.lstrip(b"\r\n")
        end = data.find(b"\r\n\r\n")
        if end < 0:
            return out, data
        headers = [tuple(x.split(": ", 1)) for x in data[:end].decode("utf-8").split(CRLF)[1:]]
        n = int(next(v for k, v in headers if k.lower() == "content-length"))
        if len(data) < end + 4 + n:
            return out, data
        out.append(([{"name": k, "value": v} for k, v in headers], data[end + 4 : end + 4 + n].decode("utf-8", "replace")))
        data = data[end + 4 + n :]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, block) for each record of gzipped WARC files.

    Files are cut where a gzip member begins, so a large one is read by many tasks and no file has to fit in memory; a member does. Bytes inside a
    member that look like a beginning are joined to what is before them. Raises ValueError on a damaged file and where such bytes stand at the
    border of a split (larger spark.sql.files.maxPartitionBytes help). Records without a gzip member of their own are read too, but not apart.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, raw, left = None, b"", b""

        def whole() -> None:
            if raw or left.strip(b"\r\n"):
                raise ValueError(f"{at}: a record is cut off: damaged, or cut by a split of the file")

        for b in batches:
            rows = []
            for name, value in zip(b["file"], b["value"], strict=True):
                if name != at:
                    whole()
                    at = name
                if not value and not raw:
                    continue  # before the first member of a file
                raw += MAGIC + bytes(value)
                member = zlib.decompressobj(31)
                try:
                    data = member.decompress(raw)
                except zlib.error as e:
                    raise ValueError(f"{name}: no gzip member where one should be: damaged, or cut by a split of the file") from e
                if member.eof:
                    raw = b""
                    found, left = _records(left + data)
                    rows += [(name, *r) for r in found]
            yield pd.DataFrame(rows, columns=["file", "headers", "block"])
        whole()

    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    cut = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return small_batches(cut).mapInPandas(of, "file string, headers array<struct<name:string,value:string>>, block string")
