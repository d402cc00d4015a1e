"""Rows at given ranks by selection: no sort of the table.

A bounded sample of keys brackets each wanted rank, and one pass over the table counts the rows up to the
brackets. The counts are exact, so the row is known to lie between them; what lies between is sampled
and counted again until it fits one task, which sorts it. A round leaves about a fifteenth of the rows, so two
or three passes over narrow columns replace a shuffle of the whole table. Whatever the sample was, the result is
the exact one: a bracket that misses moves to the side where the rank lies.

Keys are structs in ascending order (NULL comes first in a struct) and must be unique, so that a value that many rows
share does not keep a bracket wide.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze

#: Rows that one task may sort in the end, and keys that are sampled from a bracket.
DIRECT_ROWS, SAMPLED_KEYS = 100_000, 4_000


@dataclass(frozen=True)
class _Bracket:
    """The wanted row's key is above ``low`` and at most ``high`` (None: no bound); ``before`` rows come before."""

    name: str
    rank: int
    low: Row | None
    high: Row | None
    before: int
    rows: int

    @property
    def span(self) -> tuple:
        return self.name, self.low, self.high


def _literal(row: Row, kind) -> Column:
    fields = zip(kind.fields, row, strict=True)
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in fields))


def rows_at_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[Row]]:
    """Keys at the 1-based ``ranks`` of each key column of ``df``. Ranks must lie within the table.

    ``df`` is read several times, so it should be a stored table. Runs jobs.
    """
    kinds = {name: df.schema[name].dataType for name in ranks}
    whole = df.count()
    open_brackets = {(n, r): _Bracket(n, r, None, None, 0, whole) for n, wanted in ranks.items() for r in wanted}
    while wide := {at: b for at, b in open_brackets.items() if b.rows > DIRECT_ROWS}:
        open_brackets.update(_narrowed(df, wide, kinds))
    found: dict[tuple[str, int], Row] = {}
    spans = list(dict.fromkeys(b.span for b in open_brackets.values()))
    if not spans:
        return {name: [] for name in ranks}
    hits = {(spans.index(b.span), b.rank - b.before): at for at, b in open_brackets.items()}
    order = Window.partitionBy("span").orderBy(*(f"key_{i}" for i in range(len(kinds))))
    placed = _inside(df, spans, kinds).withColumn("place", F.row_number().over(order))
    wanted = reduce(Column.__or__, ((F.col("span") == s) & (F.col("place") == p) for s, p in hits))
    for row in placed.where(wanted).collect():
        at = hits[row["span"], row["place"]]
        found[at] = row[f"key_{list(kinds).index(at[0])}"]
    return {name: [found[name, r] for r in wanted_ranks] for name, wanted_ranks in ranks.items()}


def _within(span: tuple, kinds) -> Column:
    name, low, high = span
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col(name) > _literal(low, kinds[name]))
    if high is not None:
        inside = inside & (F.col(name) <= _literal(high, kinds[name]))
    return inside


def _inside(df: DataFrame, spans: list[tuple], kinds) -> DataFrame:
    """span, and the key of each row in it: column ``key_i`` for the i-th key, others NULL."""
    names = list(kinds)

    def entry(i: int, span: tuple) -> Column:
        keys = [
            (F.col(n) if n == span[0] else F.lit(None).cast(kinds[n])).alias(f"key_{k}") for k, n in enumerate(names)
        ]
        return F.when(_within(span, kinds), F.struct(F.lit(i).alias("span"), *keys))

    entries = F.array_compact(F.array(*(entry(i, s) for i, s in enumerate(spans))))
    return df.select(F.inline(entries))


def _narrowed(df: DataFrame, brackets: dict, kinds) -> dict:
    spans = list(dict.fromkeys(b.span for b in brackets.values()))
    names = list(kinds)
    keys = [f"key_{i}" for i in range(len(names))]
    by_hash = Window.partitionBy("span").orderBy(F.xxhash64(*keys), *keys)
    sample = (
        _inside(df, spans, kinds)
        .withColumn("place", F.row_number().over(by_hash))
        .where(F.col("place") <= SAMPLED_KEYS)
        .orderBy("span", *keys)
        .collect()  # at most SAMPLED_KEYS of each span
    )
    sampled: list[list[Row]] = [[] for _ in spans]
    for row in sample:
        sampled[row["span"]].append(row[f"key_{names.index(spans[row['span']][0])}"])
    edges = {}
    for at, b in brackets.items():
        known = [k for k in sampled[spans.index(b.span)] if k != b.high]
        share = (b.rank - b.before) / b.rows
        middle, slack = share * len(known), 4 * math.sqrt(len(known) * share * (1 - share)) + 2
        low, high = math.floor(middle - slack), math.ceil(middle + slack)
        if low < 0 and high >= len(known):  # too few keys to bracket: the middle one cuts the rows in two
            low = high = min(max(math.floor(middle), 0), len(known) - 1)
        edges[at] = (known[low] if 0 <= low < len(known) else b.low, known[high] if 0 <= high < len(known) else b.high)
    counts = []
    for i, (at, (low, high)) in enumerate(edges.items()):
        for side, edge in (("low", low), ("high", high)):
            if edge is not None:
                counts.append(F.count_if(F.col(at[0]) <= _literal(edge, kinds[at[0]])).alias(f"{side}_{i}"))
    seen = df.agg(*counts).first().asDict() if counts else {}
    out = {}
    for i, (at, b) in enumerate(brackets.items()):
        low, high = edges[at]
        upto_low = seen.get(f"low_{i}", b.before)
        upto_high = seen.get(f"high_{i}", b.before + b.rows)
        if b.rank <= upto_low:
            out[at] = _Bracket(b.name, b.rank, b.low, low, b.before, upto_low - b.before)
        elif b.rank > upto_high:
            out[at] = _Bracket(b.name, b.rank, high, b.high, upto_high, b.before + b.rows - upto_high)
        else:
            out[at] = _Bracket(b.name, b.rank, low, high, upto_low, upto_high - upto_low)
    return out


def with_tiles(df: DataFrame, keys: Mapping[str, Column], tiles: int) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY key)`` for each named key. ``df`` is written once; runs jobs."""
    names = {name: f"_key_of_{name}" for name in keys}
    stored = freeze(df.withColumns({names[n]: k for n, k in keys.items()}), "tiled")
    rows = stored.count()
    size, longer = divmod(rows, tiles)
    # the last rank of every tile but the last; tiles beyond the number of rows are empty
    ends = [t * size + min(t, longer) for t in range(1, tiles)]
    ends = [e for e in dict.fromkeys(ends) if 0 < e < rows]
    borders = rows_at_ranks(stored, {names[n]: ends for n in keys})
    out = {}
    for name, column in names.items():
        kind = stored.schema[column].dataType
        above = (F.when(F.col(column) > _literal(b, kind), 1).otherwise(0) for b in borders[column])
        out[name] = reduce(Column.__add__, above, F.lit(1)).cast("bigint")
    return stored.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def with_top(df: DataFrame, key: Column, tops: Mapping[str, int]) -> DataFrame:
    """Add a flag for each named top: whether the row is among the first ``ceil(pct * n / 100)`` by ``key``."""
    stored = freeze(df.withColumn("_key", key), "top")
    rows = stored.count()
    last = {name: min(rows, -(-rows * pct // 100)) for name, pct in tops.items()}
    ranks = [r for r in dict.fromkeys(last.values()) if r > 0]
    borders = dict(zip(ranks, rows_at_ranks(stored, {"_key": ranks})["_key"], strict=True)) if rows else {}
    kind = stored.schema["_key"].dataType
    flags = {
        name: F.col("_key") <= _literal(borders[r], kind) if r in borders else F.lit(False) for name, r in last.items()
    }
    return stored.select(*df.columns, *(c.alias(n) for n, c in flags.items()))
