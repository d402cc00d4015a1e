"""Exact duplicates through counting quotient filters.

Every text gets a 64-bit fingerprint. Each task packs the fingerprints it sees into counting
quotient filters, one per range of fingerprints; filters of a range merge without loss, because
their remainders are sorted and keep every bit. Only fingerprints with a count above one go on:
their texts are grouped by the bytes themselves, so a chance collision never joins two texts.

A text travels only if its fingerprint repeats, and equal texts of one task travel once
(partial aggregation), so a text that fills a third of the table reaches the shuffle as one row
per task. All per-row results join narrow tables.

Defined results: a null text counts as empty; empty texts equal each other; equality ignores the
six white-space characters of ``SPACE``. Of equal texts the row with the most code points in the
original text stays, then the smallest id (null ids last), then, among rows that agree in both,
one row. An empty table gives an empty result. Extra columns are ignored by the report and kept
as they are by ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze
from orderloom.llm.common import buckets_for, checked, fresh, text_of, without_space

_FILTER = (
    "segment int, quotient_bits int, entries long, occupied binary, run_ends binary, "
    "remainders binary, counted binary, counts binary"
)
#: Fingerprints a task gathers before it packs them, which bounds its memory.
_FLUSH = 4_000_000
_PER_RANGE = 4_000_000  # fingerprints of a range, on average


def pack(values: np.ndarray, counts: np.ndarray) -> dict:
    """A counting quotient filter of sorted distinct fingerprints: one quotient per slot on average.

    The quotient's bit in ``occupied`` is set if the quotient has remainders; ``run_ends`` marks
    the last remainder of each quotient; a remainder with a bit in ``counted`` has a counter.
    """
    n = len(values)
    bits = max(1, int(n - 1).bit_length())
    quotients = (values >> np.uint64(64 - bits)).astype(np.int64)
    occupied = np.zeros(1 << bits, dtype=bool)
    occupied[quotients] = True
    ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, dtype=bool)
    counted = counts > 1
    return {
        "quotient_bits": bits,
        "entries": n,
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(ends).tobytes(),
        "remainders": (values << np.uint64(bits)).tobytes(),
        "counted": np.packbits(counted).tobytes(),
        "counts": counts[counted].astype(np.int64).tobytes(),
    }


def unpack(f: dict) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that ``pack`` stored."""
    bits, n = f["quotient_bits"], f["entries"]
    occupied = np.unpackbits(np.frombuffer(f["occupied"], np.uint8), count=1 << bits)
    ends = np.unpackbits(np.frombuffer(f["run_ends"], np.uint8), count=n)
    run = np.cumsum(ends) - ends
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run]
    low = np.frombuffer(f["remainders"], np.uint64) >> np.uint64(bits)
    counts = np.ones(n, dtype=np.int64)
    counts[np.unpackbits(np.frombuffer(f["counted"], np.uint8), count=n).astype(bool)] = (
        np.frombuffer(f["counts"], np.int64)
    )
    return (quotients << np.uint64(64 - bits)) | low, counts


def merged(filters: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Sums filters by sorted remainders."""
    parts = [unpack(f) for f in filters]
    values, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


def _build(segment_bits: int):
    def packed(chunk: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(chunk), return_counts=True)
        segments = (values >> np.uint64(64 - segment_bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
        rows = [
            {"segment": int(segments[a])} | pack(values[a:b], counts[a:b])
            for a, b in zip(starts, np.append(starts[1:], len(values)), strict=True)
        ]
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            chunk.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= _FLUSH:
                yield packed(chunk)
                chunk, held = [], 0
        if held:
            yield packed(chunk)

    return build


_ARROW = pa.schema(
    [("segment", pa.int32()), ("quotient_bits", pa.int32()), ("entries", pa.int64())]
    + [(c, pa.binary()) for c in ("occupied", "run_ends", "remainders", "counted", "counts")]
)


def _repeated(group: pa.Table) -> pa.Table:
    values, counts = merged(group.drop_columns(["segment"]).to_pylist())
    return pa.table({"fingerprint": values[counts > 1].view(np.int64)})


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints (one bigint column) that occur more than once. ``rows`` is a stored table.

    The number of ranges follows the number of rows, so a merging task holds about ``_PER_RANGE`` fingerprints.
    """
    ranges = buckets_for(rows.sparkSession, rows.count(), _PER_RANGE)
    segment_bits = max(1, (ranges - 1).bit_length())
    filters = rows.mapInArrow(_build(segment_bits), _FILTER)
    return filters.groupBy("segment").applyInArrow(_repeated, "fingerprint long")


def _normal(text_col: str) -> Column:
    return without_space(text_of(text_col))


def _groups(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """One row per verified group of two or more: key, size, and the row that stays."""
    repeats = checked(repeated_fingerprints(rows.select("fingerprint")), "repeats")
    texts = docs.select(_normal(text_col).alias("bytes")).select(
        F.xxhash64("bytes").alias("fingerprint"), "bytes"
    )
    verified = (
        texts.join(repeats, "fingerprint", "left_semi")
        .groupBy("fingerprint", "bytes")
        .agg(F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fingerprint", F.sha2("bytes", 256).alias("text_sha256"), "group_size")
    )
    best = (
        rows.join(repeats, "fingerprint", "left_semi")
        .groupBy("fingerprint", "text_sha256")
        .agg(F.min(F.struct(-F.col("chars"), F.isnull("id"), "id", "row")).alias("best"))
    )
    return checked(
        verified.join(best, ["fingerprint", "text_sha256"]).select(
            "fingerprint",
            "text_sha256",
            "group_size",
            (-F.col("best.col1")).alias("keep_chars"),
            F.col("best.id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
        ),
        "copies",
        most=100_000,  # rows of about 150 bytes
    )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document, written once, so that ``row`` names it for good."""
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.length(text_of(text_col)).cast("long").alias("chars"),
        _normal(text_col).alias("bytes"),
    ).select(
        "id",
        "chars",
        F.xxhash64("bytes").alias("fingerprint"),
        F.sha2("bytes", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    return freeze(narrow, "fingerprints")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Runs jobs."""
    rows = _rows(docs, id_col, text_col)
    groups = _groups(docs, rows, text_col)
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["fingerprint", "text_sha256"], "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Runs jobs.

    Rows outside the groups pass in place; of a group only rows that match the one to stay are
    gathered, and the window's limit leaves one of them per task before the shuffle.
    """
    groups = _groups(docs, _rows(docs, id_col, text_col), text_col)
    print_, sha, size, chars, keep_id, row, rank = fresh(
        docs, "fingerprint", "text_sha256", "group_size", "keep_chars", "keep_id", "keep_row", "rank"
    )
    groups = groups.toDF(print_, sha, size, chars, keep_id, row)
    marked = docs.withColumns(
        {print_: F.xxhash64(_normal(text_col)), sha: F.sha2(_normal(text_col), 256)}
    ).join(groups, [print_, sha], "left")
    stays = F.col(keep_id).eqNullSafe(F.col(id_col)) & (F.col(chars) == F.length(text_of(text_col)))
    order = Window.partitionBy(print_, sha).orderBy(F.xxhash64(*docs.columns))
    one_each = (
        marked.where(F.col(size).isNotNull() & stays)
        .withColumn(rank, F.row_number().over(order))
        .where(F.col(rank) == 1)
    )
    return marked.where(F.col(size).isNull()).select(*docs.columns).unionByName(
        one_each.select(*docs.columns)
    )
