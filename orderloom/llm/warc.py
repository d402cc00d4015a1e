"""WARC archives with resolved revisits.

Headers alone (id, payload length, SHA-1 digest) are shuffled by digest: of equal payloads the record
with the smallest id is the response, the others become revisit records that refer to it and carry no
payload. Payloads stay in the task that read them; only where the table of repeated digests is too large to
broadcast do they meet it in a shuffled join. Archives are written with fresh headers by Spark's text
writer, so a lost task is simply written again, and each file holds a bounded number of records.
Reading parses whole files by content length, checks every digest, and joins revisits to their
responses.

Defined results: a null payload counts as empty; payloads below ``least_bytes`` are always responses;
records without an id are responses, and so are repeated rows with the response's id and payload (they
share one record id); null urls are left out; line breaks in a url become blanks; an empty table
gives an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze, new_path
from orderloom.llm.common import checked, text_of

_BREAK = "\r\n"
_END = _BREAK * 2
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value: the profile of revisits that share a payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 5_000


def digest(payload: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _record_id(page_id: Column, digest_: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest_).cast("binary"))
    groups = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def resolve(headers: DataFrame) -> DataFrame:
    """Digests that repeat, with the id of their response. ``headers`` has (id, digest)."""
    known = headers.where(F.col("id").isNotNull())
    return (
        known.groupBy("digest")
        .agg(F.min("id").alias("response"), F.max("id").alias("last"))
        .where(F.col("last") > F.col("response"))
        .select("digest", "response")
    )


def _line(name: str, value: Column) -> Column:
    """One header line, or null without a value."""
    return F.concat(F.lit(f"{name}: "), value)


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write one record per row under ``path`` as gzipped WARC 1.1 files. Runs jobs."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]+", " ").alias("url"),
        text_of(payload_col).alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload"), "digest": digest(F.col("payload"))})
    headers = freeze(rows.select("id", "bytes", "digest"), "headers")
    repeats = checked(resolve(headers.where(F.col("bytes") >= least_bytes)), "responses")
    placed = rows.join(repeats, "digest", "left")
    revisit = (F.col("bytes") >= least_bytes) & (F.col("id") > F.col("response"))
    revisit = F.coalesce(revisit, F.lit(False))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(_END),
    )
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("bytes"))
    lines = F.concat_ws(
        _BREAK,
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Page-ID", F.col("id").cast("string")),
        F.when(revisit, _line("WARC-Profile", F.lit(_PROFILE))),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("response"), F.col("digest")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
    )
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload")))
    placed.select(F.concat(lines, F.lit(_END), block).alias("record")).write.option(
        "lineSep", _END
    ).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by content length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split(_BREAK)
        if version != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield fields, data[start:stop]
        at = stop + 4


_COLUMNS = "record_id string, page_id string, url string, record_type string, digest string, refers_to string, payload binary, bytes long"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("record_id", "page_id", "url", "record_type", "digest", "refers_to")]
    + [("payload", pa.binary()), ("bytes", pa.int64())]
)


def _records(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(gzip.decompress(content.as_py())):
                    payload = None
                    if fields["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if fields["WARC-Payload-Digest"] != f"sha1:{found}":
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    rows.append(
                        (
                            fields["WARC-Record-ID"],
                            fields.get("WARC-Page-ID"),
                            fields.get("WARC-Target-URI"),
                            fields["WARC-Type"],
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            fields.get("WARC-Refers-To"),
                            payload if with_payload else None,
                            None if payload is None else len(payload),
                        )
                    )
                columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
                )

    return read


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, one row each; revisits have no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_records(with_payload), _COLUMNS)


def resolved_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (an id)."""
    records = freeze(read_records(spark, path, with_payload=False).drop("payload"), "records")
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("original"))
        .agg(F.max("bytes").alias("original_bytes"), F.max("page_id").alias("original_page"))
    )
    responses = records.where("record_type = 'response'").select(
        F.col("page_id").cast(id_type).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.lit(None).cast(id_type).alias("refers_to"),
    )
    revisits = records.where("record_type = 'revisit'").join(
        originals, F.col("refers_to") == F.col("original"), "left"
    )
    found = revisits.select(
        F.col("page_id").cast(id_type).alias("page_id"),
        F.col("original_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("original_page").cast(id_type).alias("refers_to"),
    )
    return responses.unionAll(found)


def archive(spark: SparkSession, pages: DataFrame, **options) -> str:
    """Write ``pages`` to a new folder in the shared space and return its path. Runs jobs."""
    path = new_path(spark, "warc")
    write_archives(pages, path, **options)
    return path
