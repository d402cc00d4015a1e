"""Mixing sources to target weights by weighted fair queueing.

Every source has a target amount of words. Its documents, shuffled by a hash of their id, form a
queue that is served up to ``repeats`` times over. A document's virtual finish time is the number of
words its source has been served by then, divided by the source's target. All queues are merged by
range-sorting finish times over the whole table, and the merged queue is cut at the total budget. A
document in service when its source reaches its target is served in two parts, so that every
source comes within a few words of its target.

Queues and the merged order are running totals over range-partitioned slices, so a source with a
third of all documents is spread over tasks. Only narrow rows (id, source, size) are sorted.

Defined results: null texts have size 0 and are taken 0 words; the null source is a source of its
own, last in order; rows that agree in id, source and size are served together and share what they
get evenly; an empty table gives an empty result; extra columns do not matter. The same table gives
the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.ranking import with_rank, with_running_total
from orderloom.functions.storage import freeze
from orderloom.llm.common import checked, fresh, text_of

#: Fixed value: a word is a run of anything but the six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def _source(source_col: str) -> Column:
    """A text that sorts like the source by code point, with null after everything."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], repeats: int
) -> tuple[DataFrame, int]:
    """Per source: size, target, words of all sources before it; and the total budget.

    ``sizes`` has (source, source_size). Targets share ``share`` (a fraction) of all sizes by
    weight and stop at ``repeats`` times the size. A source stops if serving all sources in
    proportion to weight fills it before the budget ends; sorted by size over weight, those are
    the first ones, so running totals find them without a loop.
    """
    ranked = with_rank(sizes, [F.col("source").asc()], "place")
    cycle = F.array(*map(F.lit, weights))
    weighed = ranked.select(
        "source",
        "source_size",
        F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * repeats).alias("most"),
    ).withColumn("ratio", F.col("most") / F.col("weight"))
    order = [F.col("ratio").asc(), F.col("source").asc()]
    by_size = with_running_total(weighed, order, "most", "most_before", "most_total")
    placed = with_running_total(by_size, order, "weight", "weight_before", "weight_total")
    placed = with_running_total(placed, [F.col("source").asc()], "source_size", "words_before", "words")
    placed = placed.withColumn("budget", F.col("words") * share[0] / share[1])
    stops = F.col("most") * (F.col("weight_total") - F.col("weight_before")) <= F.col("weight") * (
        F.col("budget") - F.col("most_before")
    )
    placed = freeze(placed.withColumn("stops", stops), "sources")
    full = placed.agg(  # one row
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))), F.lit(0)).alias("most"),
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("weight"))), F.lit(0)).alias("weight"),
        F.max("budget").alias("budget"),
    ).first()
    rest = F.col("weight") * (F.col("budget") - full["most"]) / (F.col("weight_total") - full["weight"])
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(rest)
    return placed.select("source", "source_size", target.alias("target"), "words_before"), int(full["budget"] or 0)


def _queues(rows: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """Parts of documents in every round, with their virtual finish times."""
    order = [F.col(c).asc() for c in ("source", "place", "id", "size")]
    served = with_running_total(rows, order, "amount", "before", "everything")
    queue = served.join(sources, "source")
    base = F.col("before") - F.col("words_before") + F.col("round") * F.col("source_size")
    quota = F.floor("target")
    first = F.greatest(F.least(F.col("amount"), quota - F.col("base")), F.lit(0))

    def part(words: Column, number: int, end: Column) -> Column:
        finish = end / F.nullif(F.col("target"), F.lit(0.0))
        return F.struct(words.cast("long").alias("words"), F.lit(number).alias("part"), finish.alias("finish"))

    end = F.col("base") + F.col("amount")
    rounds = F.array(*(F.lit(r) for r in range(repeats)))
    parts = F.array(part(first, 0, F.col("base") + first), part(F.col("amount") - first, 1, end))
    return (
        queue.withColumn("round", F.explode(rounds))
        .withColumn("base", base)
        .withColumn("piece", F.explode(F.filter(parts, lambda p: p["words"] > 0)))
        .select("source", "place", "id", "size", "round", "piece.words", "piece.part", "piece.finish")
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: id, size, source_size, target, taken. Runs jobs."""
    rows, taken = _mix(docs, weights, share, repeats, id_col, text_col, source_col)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in _ALIKE]
    joined = rows.alias("r").join(taken.alias("t"), same).select("r.*", "source_size", "target", "taken", "extra")
    whole = joined.where("extra = 0").unionByName(_one_more(joined.where("extra > 0")))
    return whole.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


_ALIKE = ("source", "id", "size")


def _one_more(rows: DataFrame) -> DataFrame:
    """Of rows that are alike the first ``extra`` ones take one word more.

    They are numbered by slice of the stored rows and within it, so no task holds a group that fills many slices.
    """
    sliced = rows.withColumn("slice", F.shiftright("row", 33))
    counts = sliced.groupBy(*_ALIKE, "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*_ALIKE).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*_ALIKE, "slice").orderBy("row"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*_ALIKE, "slice")]
    placed = sliced.withColumn("inside", inside).alias("s").join(counts.alias("c"), same).select("s.*", "c.before")
    more = F.when(F.col("before") + F.col("inside") <= F.col("extra"), 1).otherwise(0)
    return placed.withColumn("taken", F.col("taken") + more).select(*rows.columns)


def _mix(docs, weights, share, repeats, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame]:
    rows = freeze(
        docs.select(
            F.col(id_col).alias("id"), _source(source_col).alias("source"), word_count(text_col).alias("size")
        ).withColumn("row", F.monotonically_increasing_id()),
        "sizes",
    )
    alike = rows.groupBy("source", "id", "size").agg(F.count("*").alias("rows"))
    alike = alike.withColumn("amount", F.col("size") * F.col("rows")).withColumn(
        "place", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    )
    sources, budget = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats
    )
    order = [F.col(c).asc() for c in ("finish", "source", "place", "id", "size", "round", "part")]
    merged = with_running_total(_queues(alike, sources, repeats), order, "words", "before", "everything")
    left = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    got = merged.groupBy("source", "id", "size").agg(F.sum(F.least(F.col("words"), left)).alias("got"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("source", "id", "size")]
    taken = (
        alike.alias("a")
        .join(got.alias("g"), same, "left")
        .select("a.source", "a.id", "a.size", "a.rows", "g.got")
        .join(sources, "source")
        .select(
            "source",
            "id",
            "size",
            "source_size",
            "target",
            F.expr("coalesce(got, 0) div rows").alias("taken"),
            F.expr("coalesce(got, 0) % rows").alias("extra"),
        )
    )
    return rows, checked(taken, "mix", most=100_000)


def mixed_documents(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix as documents with all their columns: whole copies only, as many as were taken, to
    the nearest copy. Rows without words are left out. Runs jobs."""
    _, taken = _mix(docs, weights, share, repeats, id_col, text_col, source_col)
    source, size, copies, copy = fresh(docs, "mix_source", "mix_size", "mix_copies", "mix_copy")
    key, place, words = fresh(docs, "mix_id", "mix_place", "mix_words")
    wanted = taken.where("taken > 0").select(
        F.col("source").alias(source),
        F.col("id").alias(key),
        F.col("size").alias(size),
        F.round(F.col("taken") / F.col("size")).cast("int").alias(copies),
    )
    return (
        docs.withColumns({place: _source(source_col), words: word_count(text_col)})
        .join(
            checked(wanted.where(F.col(copies) > 0), "copies", most=100_000),
            [
                F.col(place) == F.col(source),
                F.col(words) == F.col(size),
                F.col(key).eqNullSafe(F.col(id_col)),
            ],
        )
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
        .select(*docs.columns)
    )
