"""Content-addressed web archive: each payload once by its digests, exact record headers apart, records rebuilt by a join.

``payloads`` has one row for each distinct payload under a key of SHA-256, SHA-1 and length. Rows with equal payloads meet after partial
aggregation, so a payload that a third of all pages share is one row for each task before any shuffle. ``records`` has the header block
of each record as it stands in a WARC file, up to where its payload begins, and the key of its payload. Reading checks each stored
payload against its digests before any record gets it back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ("sha256", "sha1", "payload_bytes")


@dataclass(frozen=True)
class Archive:
    """Folder of an archive and what its records say alike. Payloads of fewer than ``least_bytes`` are always stored as responses."""

    path: str
    date: str = "1970-01-01T00:00:00Z"
    least_bytes: int = 0


def base32(hexadecimal: Column) -> Column:
    """Base-32 text of 40 hex digits: eight groups of 20 bits with four characters each."""
    out = []
    for g in range(8):
        bits = F.conv(F.substring(hexadecimal, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    return rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


#: What ``uri_written`` makes: the code of a control character, or of a percent sign before what looks like such a code.
CODE = "(?:[01][0-9A-F]|7F|25)"


def uri_written(url: Column) -> Column:
    """A url on one line: control characters by their codes. A percent sign turns into its code only where a code could be read after it."""
    safe = F.regexp_replace(url, f"%(?=(?i:{CODE}))", "%25")
    coded = F.transform(F.split(safe, ""), lambda c: F.when(c.rlike(r"^[\x00-\x1F\x7F]$"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(safe.rlike(r"[\x00-\x1F\x7F]"), F.array_join(coded, "")).otherwise(safe)


def uri_read(written: Column) -> Column:
    """The url that ``uri_written`` was given."""
    others = F.replace(F.regexp_replace(written, f"%(?!{CODE})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(written.rlike(f"%{CODE}"), F.url_decode(others)).otherwise(written)


def _head(revisit: Column) -> Column:
    uri = uri_written(F.coalesce("url", F.lit("")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def write(pages: DataFrame, archive: Archive, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes the archive. Of records with equal payloads those with the smallest page id are responses, the others revisits of it.

    A null payload is an empty one. A null page id comes after all others; where a payload has no other, its records are responses.
    Repeated rows are records of their own and share a payload. Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = _keyed(pages, id_col, url_col, payload_col)
    rows.groupBy(*KEY).agg(F.min("page_id").alias("first"), F.min("payload").alias("payload")).write.parquet(f"{archive.path}/payloads")
    first = spark.read.parquet(f"{archive.path}/payloads").select(*KEY, "first")
    revisit = (F.col("payload_bytes") >= archive.least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = rows.drop("payload").join(first, list(KEY)).withColumn("date", F.lit(archive.date)).withColumn("revisit", revisit)
    head.select(*KEY, _head(F.col("revisit")).alias("head")).write.parquet(f"{archive.path}/records")


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """head, payload and digests of every record. Fails if a stored payload is not what its key says."""
    stored = spark.read.parquet(f"{archive.path}/payloads")
    true = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = stored.select(F.when(true, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("sha256"), "sha1", "payload_bytes", "payload")
    return spark.read.parquet(f"{archive.path}/records").join(checked, list(KEY))


def warc(rows: DataFrame) -> DataFrame:
    """Adds ``record``: the bytes of each WARC record, a revisit without its payload."""
    body = F.when(F.col("head").contains(f"{CRLF}WARC-Type: revisit{CRLF}"), F.lit(b"")).otherwise(F.col("payload"))
    return rows.withColumn("record", F.concat(F.col("head").cast("binary"), body, F.lit(b"\r\n\r\n")))


def reread(rows: DataFrame) -> DataFrame:
    """The rows of ``warc`` with ``head`` taken from the bytes of the record: its first two blocks. Fails if their lengths don't match."""
    head = F.concat(F.substring_index(F.col("record").cast("string"), CRLF * 2, 2), F.lit(CRLF * 2))
    block = F.octet_length(F.substring_index(head, CRLF * 2, 1)) + 4
    said = F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n\r\n", 1).try_cast("long")
    checked = F.when(F.octet_length("record") == block + said + 4, head).otherwise(F.raise_error(F.concat(F.lit("damaged record "), head)))
    return rows.withColumn("head", checked)


def field(name: str) -> Column:
    """A header field of the record, null if it has none."""
    return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def described(rows: DataFrame) -> DataFrame:
    """What the headers and restored payloads say: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    page = lambda name: F.regexp_extract("head", rf"\r\n{name}: <urn:page:(-?\d+)>\r\n", 1).try_cast("long")
    return rows.select(
        page("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), uri_read(field("WARC-Target-URI")).alias("url"),
    )
