"""Phrase collocations by SON partitioning: shards mined whole, then one exact count of what they name.

Texts are cut into pieces at punctuation and line ends, pieces into words; a phrase is a run of words
within a piece. The texts of a language are dealt into ``S`` shards. A phrase found ``support`` times or
more is found ``s = ceil(support / S)`` times in some shard, so every shard is mined completely, level by level,
with that lowered support. The union of what is locally frequent is then pruned by what the shards have
told: where a phrase was not named, it was found ``s - 1`` times at most, so its count is at most the sum of the
counts of the shards that named it and ``s - 1`` for each of the others. Candidates for which that sum reaches
the support set a bit in one table of ``2**_BITS`` bits (its size is fixed). The second pass reads all texts
where they lie and counts, exactly and as strings, every phrase whose bit is set: all candidates, and the few
others that share a bit; counts travel as packed blocks, one for each task and bucket of phrases. The support is then asked of these exact counts, so neither hash nor shard decides
about a result.

A language of ``support`` shards or more has a local support of one: its shards name every phrase, and the
sums are then the counts themselves. That is the method's limit at a fixed support: the first shuffle holds a row
of two numbers for each phrase of each shard, while the second stays as small as the result.

A candidate's score is ``floor(2000000 * a / (l + r))``, ``a`` its count, ``l`` and ``r`` those of the two
parts of its lowest-scoring cut (first such cut). Candidates that lie inside a longer one with most of
their count are dropped. Products are decimals of 38 digits.

Defined results: null and empty texts hold no words; a null language is called ``und``; repeated rows count
as often as they stand there; ties end in the phrase's bytes; texts of any length are read whole; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze
from orderloom.llm.common import buckets_for, checked, give_back, text_of, tidied

#: Bits of the table of candidates (8 MB).
_BITS = 26
#: Bytes of text in a shard, which bounds the memory of a mining task; and how many shards a language has at least.
_SHARD_BYTES, _LEAST_SHARDS = 40_000_000, 6
#: Words that the counting pass holds before it hands on what it has.
_CHUNK_WORDS = 3_000_000
#: What ends a piece. Tabs count as blanks; A-Z become small letters.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"." * len(_ENDS)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Word to number, in order of first appearance. Number 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """The words of many texts of one language as one array of numbers, pieces divided by 0."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self._parts, self.held = lang, _Numbers({b".": 0}), [], 0

    def add(self, text: str) -> None:
        words = text.encode().translate(_TABLE).replace(b".", b" . ").split()
        if words:
            words.append(b".")
            part = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self._parts.append(part)
            self.held += len(part)

    def array(self) -> np.ndarray:
        """All words; the parts are given up for it."""
        whole = np.concatenate(self._parts) if self._parts else np.zeros(0, np.int32)
        self._parts = [whole]
        return whole

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))

    def seed(self) -> np.uint64:
        """What every phrase's hash of this language begins with."""
        return np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), 1) * int(_STEP) % (1 << 64))

    def phrases(self, ids: np.ndarray, starts: np.ndarray, length: int) -> list[bytes]:
        words = list(self.numbers)
        runs = np.column_stack([ids[starts + k] for k in range(length)]).tolist()
        return [b" ".join([words[i] for i in run]) for run in runs]


def _mixed(hashed: np.ndarray) -> np.ndarray:
    """Phrase hashes whose first bits are a bit number in the table of candidates."""
    return (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def mined(words: Words, support: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of all phrases found ``support`` times or more; parts of a frequent phrase are frequent."""
    ids = words.array()
    if not len(ids):
        return
    hashes, size = words.hashes(), np.int64(len(words.numbers))
    counts = np.bincount(ids, minlength=size)
    counts[0] = 0  # the end of a piece is no word
    often = np.flatnonzero(counts >= support)
    yield _mixed(words.seed() + hashes[often]), counts[often]
    label = np.full(size, -1, np.int32)
    label[often] = often
    label = label[ids]  # number of the frequent phrase that starts here, or -1
    hashed = hashes[ids]
    hashed += words.seed()
    for length in range(2, longest + 1):
        starts = np.flatnonzero((label[:-1] >= 0) & (label[1:] >= 0)).astype(np.int32)
        starts = starts[starts + length <= len(ids)]
        if not len(starts):
            return
        keys = label[starts] * size + ids[starts + (length - 1)]
        order = np.argsort(keys)
        keys = keys[order]
        starts = starts[order]  # places by phrase
        del order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        del keys
        found = np.diff(np.append(first, len(starts)))
        kept = found >= support
        hashed[: 1 - length] *= _STEP
        hashed[: 1 - length] += hashes[ids[length - 1 :]]
        yield _mixed(hashed[starts[first[kept]]]), found[kept]
        renamed = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)
        label = np.full(len(ids), -1, np.int32)
        label[starts] = np.repeat(renamed, found)


def counted(words: Words, table: np.ndarray, longest: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Every phrase whose bit is set, its hash, and how often it is found; first the number of words under ``b""``."""
    ids = words.array()
    if not len(ids):
        return
    hashes, size = words.hashes(), np.int64(len(words.numbers))
    real, bits = ids != 0, (len(table) * 64).bit_length() - 1
    yield [b""], np.array([words.seed()]), np.array([np.count_nonzero(real)])
    hashed = words.seed() + hashes[ids]
    inside = real.copy()  # whether the phrase that starts here lies within a piece
    for length in range(1, longest + 1):
        if length > 1:
            end = len(ids) - length + 1
            if end <= 0:
                return
            hashed[:end] = hashed[:end] * _STEP + hashes[ids[length - 1 :]]
            inside[end:] = False
            inside[:end] &= real[length - 1 :]
        starts = np.flatnonzero(inside)
        place = (_mixed(hashed[starts]) >> np.uint64(64 - bits)).astype(np.int64)
        starts = starts[(table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]
        if length == 1:
            found = np.bincount(ids[starts], minlength=size)
            some = np.flatnonzero(found)
            names = list(words.numbers)
            yield [names[i] for i in some.tolist()], _mixed(words.seed() + hashes[some]), found[some]
            continue
        keys = ids[starts].astype(np.int64)
        for k in range(1, length):  # exact: the number of the first k words, and the next word
            keys = keys * size + ids[starts + k]
            _, first, keys, found = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        yield words.phrases(ids, starts[first], length), _mixed(hashed[starts[first]]), found


def _lang(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("und"))


def frequent_phrases(
    docs: DataFrame, *, support: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, phrase, f: phrases of up to ``longest`` words found ``support`` times or more in a language, with
    their exact counts; under the empty phrase the language's number of words. Runs jobs; a written table."""
    spark, bits = docs.sparkSession, _BITS
    texts = docs.select(_lang(lang_col).alias("lang"), text_of(text_col).alias("text")).where(F.col("text") != "")
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("whole"))
    shards = F.greatest(F.ceil(F.col("whole") / _SHARD_BYTES), F.lit(_LEAST_SHARDS))
    placed = texts.withColumn("row", F.monotonically_increasing_id()).join(
        checked(sizes, "lang-sizes"), "lang"
    )

    def mine(group: pa.Table) -> pa.Table:
        words, local = Words(group["lang"][0].as_py()), -(-support // group["shards"][0].as_py())
        for batch in group.to_batches(max_chunksize=2_000):
            for text in batch.column("text").to_pylist():
                words.add(text)
        hashes, counts = zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *mined(words, local, longest), strict=True)
        hashes, counts = np.concatenate(hashes).view(np.int64), np.concatenate(counts)
        base = np.full(len(counts), group["shards"][0].as_py() * (local - 1))
        give_back()
        return pa.table({"hash": hashes, "more": counts - (local - 1), "base": base})

    named = freeze(
        placed.select("lang", "text", shards.alias("shards"), F.pmod("row", shards).alias("shard"))
        .groupBy("lang", "shard")
        .applyInArrow(mine, "hash long, more long, base long")
        .groupBy("hash")
        .agg((F.sum("more") + F.max("base")).alias("most"))
        .where(F.col("most") >= support),
        "candidates",
    )
    # a bucket of the final count holds about so many phrases, whatever their number
    buckets = buckets_for(spark, named.count(), 100_000)
    rows = (
        named.select(F.shiftrightunsigned("hash", 64 - bits).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("set"))
        .toArrow()  # at most 2**(bits - 6) rows of two numbers
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Words] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                parts = list(counted(words, shared.value, longest))
                if parts:
                    phrases = [p for part, _, _ in parts for p in part]
                    hashes, found = (np.concatenate([part[i] for part in parts]) for i in (1, 2))
                    yield _packed(lang, phrases, (hashes % np.uint64(buckets)).astype(np.int64), found)
            held.clear()

        for batch in batches:
            for small in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                for lang, text in zip(small.column(0).to_pylist(), small.column(1).to_pylist(), strict=True):
                    if lang not in held:
                        held[lang] = Words(lang)
                    held[lang].add(text)
                if sum(w.held for w in held.values()) >= _CHUNK_WORDS:
                    yield from flush()
        yield from flush()

    def total(group: pa.Table) -> pa.Table:
        out = []
        for lang, sums in _unpacked(group).items():
            out += [(lang, phrase.decode(), n) for phrase, n in sums.items() if n >= support or not phrase]
        langs, phrases, sums = zip(*out, strict=True) if out else ((), (), ())
        return pa.table(
            {"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string()), "f": pa.array(sums, pa.int64())}
        )

    counts = texts.mapInArrow(tidied(count), "bucket int, lang string, phrases binary, found binary")
    counts = counts.groupBy("bucket").applyInArrow(total, "lang string, phrase string, f long")
    return freeze(counts, "frequent-phrases")


def _packed(lang: str, phrases: list[bytes], buckets: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that occurs; no phrase holds a line end."""
    order = np.argsort(buckets, kind="stable")
    there, first = np.unique(buckets[order], return_index=True)
    blobs, numbers, press = [], [], zstandard.ZstdCompressor(level=1)
    for at in np.split(order, first[1:]):
        blobs.append(press.compress(b"\n".join([phrases[i] for i in at.tolist()])))
        numbers.append(press.compress(found[at].astype("<i8").tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(there, pa.int32()),
            pa.array([lang] * len(there), pa.string()),
            pa.array(blobs, pa.binary()),
            pa.array(numbers, pa.binary()),
        ],
        names=["bucket", "lang", "phrases", "found"],
    )


def _unpacked(group: pa.Table) -> dict[str, dict[bytes, int]]:
    """Sums of the counts of each phrase, by language."""
    sums: dict[str, dict[bytes, int]] = {}
    press = zstandard.ZstdDecompressor()
    for lang, blob, numbers in zip(*(group[c].to_pylist() for c in ("lang", "phrases", "found")), strict=True):
        own = sums.setdefault(lang, {})
        counts = np.frombuffer(press.decompress(numbers), "<i8").tolist()
        for phrase, n in zip(press.decompress(blob).split(b"\n"), counts, strict=True):
            own[phrase] = own.get(phrase, 0) + n
    return sums


def collocations(
    docs: DataFrame,
    *,
    support: int = 30,
    longest: int = 4,
    inside: tuple[int, int] = (80, 100),
    first: int = 2_000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` collocations of each language.

    ``inside``: a candidate goes if a longer one that holds it has at least this share of its count.
    """
    found = frequent_phrases(docs, support=support, longest=longest, text_col=text_col, lang_col=lang_col)
    words = F.split("phrase", " ")
    named = found.where("phrase != ''").select("lang", "phrase", "f")
    several = named.withColumn("words", words).withColumn("size", F.size("words")).where("size > 1")

    def run(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", start, size), " ")

    cut = F.col("cut")
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut",
        run(F.lit(1), cut).alias("left"), run(cut + 1, F.col("size") - cut).alias("right"),
    )
    left = named.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = named.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr("(2000000 * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + r)")
    scored = (
        cuts.join(left, ["lang", "left"])
        .join(right, ["lang", "right"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    )
    # runs inside a longer candidate, as (start, size)
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1),"
        " i -> array_join(slice(words, i, k), ' '))))"
    )
    longer = (
        several.where("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    share, of = inside
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"longer IS NULL OR cast(longer AS decimal(19,0)) * {of} < cast(a AS decimal(19,0)) * {share}")
    )
    order = Window.partitionBy("lang").orderBy(F.col("low.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    total = found.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        F.col("low.l").alias("l"),
        F.col("low.r").alias("r"),
        "n",
        F.col("low.score").alias("score"),
    )
