"""Personal data by patterns, and information-theoretic sanitisation of what reveals it.

The patterns find protected entities: mail addresses, IP addresses, card and phone numbers. The
corpus then tells which terms (runs of letters or digits outside these spans) reveal an entity. All counts are over
different texts, so copies of a text say nothing: of N texts, n(c) hold an entity c, f(t) a term t, and n(c, t) both. The
information that t gives about c is PMI = log(n(c, t) * N / (n(c) * f(t))), and that of the entity itself is
IC = log(N / n(c)). A term whose PMI reaches ``disclosure`` times IC, over at least ``least`` texts, is a span
of its own wherever it stands in a text that holds the entity; sanitising generalises spans to
their kind.

All of it is column expressions. Spans and different terms of every text are written once, and all counts are taken from
that table. Entities that stand in the same texts share their counts, so a text with thousands of entities is not
multiplied with its terms; pairs are counted in the reading task before they are shuffled.

Defined results: null texts count as empty and have no spans; repeated rows have equal spans; texts of
any length are scanned whole (every pattern runs in linear time); an empty table gives an empty
result; extra columns stay as they are in ``sanitize``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze
from orderloom.llm.common import checked, fresh, row_key, text_of

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
# A dot between two label characters, and a separator between two digits, become characters that
# stand nowhere else. So the patterns need no repeated groups, which Java's matcher runs
# recursively, and a start that continues a longer run is ruled out by looking back.
_DOT, _JOINT = "\x03", "\x01"
_LOCAL = rf"A-Za-z0-9._%+\-{_DOT}"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"(?<![0-9{_JOINT}])[0-9][0-9{_JOINT}]{{13,}}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"[\p{L}\p{N}]++"


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda hit: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches with code point positions, as an array of structs; of them those to keep."""
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), pair["hit"].alias("value"))
        return F.when(pair["hit"].isNull(), state).otherwise(
            F.struct(end.cast("bigint").alias("at"), F.when(keep(pair["hit"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))
        )

    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    # from the right, every second digit counts double, less 9 above 9
    each = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)),
    )
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, d: a + F.coalesce(d, F.lit(0)).cast("bigint")) % 10 == 0


def _small_parts(value: Column) -> Column:
    plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))


def _count_between(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


def base_spans(text: Column) -> Column:
    """All matches of the four kinds that pass their checks, as an array of structs with ``kind``."""
    none = F.array().cast(_SPAN)
    plain = F.translate(text, _JOINT + _DOT, "\x02\x02")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), matches(dotted, _EMAIL)).otherwise(none),
        "ip": F.filter(matches(plain, _IP), lambda s: _small_parts(s["value"])),
        "card": F.filter(
            matches(joined, _CARD), lambda s: _count_between(s["value"], 14, 19) & _luhn(s["value"])
        ),
        "phone": F.when(
            F.contains(text, F.lit("+")),
            F.filter(matches(plain, _PHONE), lambda s: _count_between(s["value"], 10, 15)),
        ).otherwise(none),
    }
    return F.concat(*(_of_kind(spans, i) for i, spans in enumerate(found.values())))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), s["value"])
    )


def _how_many(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _entity(kind: Column, value: Column) -> Column:
    """One spelling per entity: digits of numbers, lower case of addresses."""
    return F.when(kind >= 2, _digits(value)).otherwise(F.lower(F.translate(value, _DOT, ".")))


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, key, row, a hash of the text, spans, and different terms outside them. Written once. Runs a job."""
    text = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    spans = text.withColumn("spans", base_spans(F.col("text")))
    named = F.transform(
        "spans", lambda s: F.struct(s["start"], s["end"], s["kind"], _entity(s["kind"], s["value"]).alias("entity"))
    )
    plain = F.when(F.size("spans") > 0, _outside(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    # lower case may be longer, so words are taken first
    terms = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(_TERM), F.lit(0)), F.lower))
    rows = spans.select("id", "key", F.xxhash64("text").alias("same"), named.alias("spans"), terms.alias("terms"))
    return freeze(rows.withColumn("row", F.monotonically_increasing_id()), "spans")


def _outside(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its spans, so that positions stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin, end = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        gap = F.substring(text, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
        return F.struct(
            end.alias("at"), F.concat(state["out"], gap, F.repeat(F.lit(" "), (end - begin).cast("int"))).alias("out")
        )

    rest = F.lit(2**31 - 1)
    return F.aggregate(
        ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), rest))
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))


def _holders(found: DataFrame, *keep: str) -> DataFrame:
    """Which rows hold which entities."""
    return found.select(*keep, F.explode("spans").alias("s")).select(*keep, "s.kind", "s.entity")


def _different(found: DataFrame) -> DataFrame:
    """One row for each text."""
    copies = found.groupBy("same").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    more = found.select("same", "row").join(copies, "same").where("row <> first").select("row")
    return found.join(checked(more, "copies"), "row", "left_anti")


def revealing_terms(found: DataFrame, *, disclosure: float = 0.9, least: int = 3) -> DataFrame:
    """(kind, entity, term) where the term reveals the entity. Runs jobs."""
    texts = _different(found)
    held = freeze(_holders(texts, "row").distinct(), "held")
    # entities of the same texts get the same number: two hashes of the set of texts
    sets = held.groupBy("kind", "entity").agg(
        F.count("*").alias("contexts"),
        F.expr("bit_xor(xxhash64(row, 1))").alias("one"),
        F.expr("bit_xor(xxhash64(row, 2))").alias("two"),
    )
    # entities of fewer texts have no pair with so many
    sets = checked(sets.where(F.col("contexts") >= least), "entities")
    which = F.struct("contexts", "one", "two").alias("which")
    reading = held.join(sets, ["kind", "entity"]).select("row", which).distinct()
    pairs = (
        texts.select("row", "terms")
        .join(checked(reading, "reading"), "row")
        .select("which", F.explode("terms").alias("term"))
        .groupBy("which", "term")
        .agg(F.count("*").alias("together"))
        .where(F.col("together") >= least)
    )
    pairs = freeze(pairs, "pairs")
    wanted = checked(pairs.select("term").distinct(), "terms")
    often = (
        texts.select(F.explode("terms").alias("term")).join(wanted, "term").groupBy("term").agg(F.count("*").alias("often"))
    )
    total = texts.agg(F.count("*").alias("n")).first()["n"] or 1  # one row
    contexts = F.col("which.contexts")
    information = F.log(F.col("together") * float(total) / (contexts * F.col("often")))
    whole = F.log(F.lit(float(total)) / contexts)
    told = pairs.join(often, "term").where(information >= disclosure * whole).select("which", "term")
    return sets.select("kind", "entity", which).join(told, "which").select("kind", "entity", "term")


def all_spans(
    docs: DataFrame,
    *,
    disclosure: float = 0.9,
    least: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, spans) with base spans, and rows (key, terms) with the added ones. Runs jobs."""
    found = found_spans(docs, id_col, text_col)
    revealing = checked(revealing_terms(found, disclosure=disclosure, least=least), "revealing")
    names = _holders(found, "key").join(revealing, ["kind", "entity"]).groupBy("key").agg(F.collect_set("term").alias("names"))
    spans = found.where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    marking = checked(names.join(spans, "key"), "marking")
    hits = matches(
        _outside(F.col("text"), F.col("spans")), _TERM, lambda hit: F.array_contains("names", F.lower(hit))
    )
    added = _texts(docs, id_col, text_col).join(marking, "key").select(
        "key", F.transform(hits, lambda s: F.struct(s["start"], s["end"], F.lit(4).alias("kind"))).alias("terms")
    )
    return found.drop("terms", "row"), checked(added.dropDuplicates(["key"]), "terms")


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(
        _ordered(spans),
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(each, ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, counts per kind, ``base`` and ``spans`` (lists as texts). Runs jobs."""
    found, added = all_spans(docs, id_col=id_col, text_col=text_col, **options)
    base = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    terms = F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    counts = [_how_many("spans", i).alias(f"n_{name}") for i, name in enumerate(KINDS[:4])]
    return found.join(added, "key", "left").select(
        F.col("id").alias(id_col),
        *counts,
        _listed(base).alias("base"),
        _listed(F.concat(base, terms)).alias("spans"),
    )


def sanitize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span generalised to its kind, as in ``[email]``; terms are removed. Of
    spans that overlap, the one that starts first, then the longer one, decides. Runs jobs."""
    found, added = all_spans(docs, id_col=id_col, text_col=text_col, **options)
    key, mine, spans = fresh(docs, "pii_key", "pii_row", "pii_spans")
    base = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    terms = F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))
    marks = (
        found.join(added, "key", "left")
        .select(F.col("key").alias(key), F.concat(base, terms).alias(spans))
        .where(F.size(spans) > 0)
        .dropDuplicates([key])
    )
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], -s["end"], s["kind"])))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]], F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        put = F.concat(state["out"], gap, F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct((-s["col2"]).cast("bigint").alias("at"), put.alias("out"))
        )

    rest = F.lit(2**31 - 1)
    clean = F.aggregate(
        ordered, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), rest))
    )
    return (
        docs.withColumn(mine, row_key(id_col, text_col))
        .join(checked(marks, "marks"), F.col(mine) == F.col(key), "left")
        .withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(clean))
        .select(*docs.columns)
    )
