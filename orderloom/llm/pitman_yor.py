"""Language-model scores by a hierarchical Pitman-Yor model of words and their predecessors.

Every word that precedes others is a restaurant; its customers are the words that follow it, and
each table it opens sends one customer to the shared parent restaurant of all words, whose own base
is uniform over the known words and one unknown. Seating is sampled by Gibbs: in turn, every dish of
every restaurant has its tables sampled given all others, from its full conditional
``x^t S(c, t)`` (``c`` customers, ``x`` the weight of a new table, ``S`` the generalised Stirling
numbers) for counts up to ``_EXACT``, above that from the limit of that distribution for large
counts, one more than a Poisson number. The parent is then seated given the tables of its children.
Tables are averaged over the samples kept; ``perplexity`` sums the scores up.

Limits of the sampler: it is one pass down the hierarchy (children given the parent's first state, parent given the
children's tables), and a slice of a cut context takes its own tables as its share of the whole. Seeds, buckets
and cuts follow from the text alone, so the scores are the same for any number of partitions.

The corpus flows as packed blocks of integers. Texts become chunks of at most ``_CHUNK`` tokens;
words are counted by hash bucket, and every chunk learns the ids and counts of its own words;
pairs of a restaurant are gathered by context, and a context with more customers than a fraction of
a bucket is cut into slices of that size, which are summed up afterwards; results return to the chunks in the
order in which they were sent. Nothing of the vocabulary passes through the driver, except sums: one row per bucket
and one per slice, of which there are at most twice ``_SHARE`` per bucket.

Defined results: null texts count as empty and have one token, the end; repeated rows train as often
as they occur and score equally; without training tokens the model is its base; an empty table
gives an empty result; ids must be whole numbers or null; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze
from orderloom.llm.common import text_of

_CHUNK = 2_000_000  # tokens
_WORD_BYTES, _PAIR_BYTES = 64_000_000, 10_000_000  # bytes of text for each bucket of words, of pairs
_LEAST_WORD_BUCKETS, _LEAST_BUCKETS = 8, 24  # small inputs too are the work of many tasks
_SHARE = 4  # a context is cut if it has more than 1 / _SHARE of a bucket's mean tokens
_EXACT = 64
_END = xxhash.xxh64_intdigest(b" ")  # no word holds a blank
_TOKENS, _WORDS, _IDS, _PAIRS, _SEATS, _TABLES, _PARENT, _SUMS = range(8)
_SCHEMA = "kind int, part long, bucket int, data array<binary>"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int64()), ("bucket", pa.int32()), ("data", pa.list_(pa.binary()))]
)


class Settings:
    """Discounts and strengths of contexts and of the parent; sweeps thrown away and kept."""

    def __init__(self, discounts=(0.8, 0.7), strengths=(2.0, 1.0), burn_in=2, samples=4, seed=17):
        self.discounts, self.strengths = discounts, strengths
        self.burn_in, self.samples, self.seed = burn_in, samples, seed


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes as their largest needs."""
    top = int(values.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"u{size}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, f"u{data[0]}").astype(np.int64)


def _sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def _unsorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _rows(group: pa.Table, kind: int, by: str) -> list[tuple[int, list[bytes]]]:
    """Blocks of a kind, sorted by part or bucket."""
    keys, kinds = group[by].to_pylist(), group["kind"].to_pylist()
    at = [i for i, k in enumerate(kinds) if k == kind]
    return sorted(((keys[i], group["data"][i].as_py()) for i in at), key=lambda r: r[0])


def _runs(buckets: np.ndarray) -> tuple[list[int], list[int]]:
    """The buckets that occur in sorted ``buckets``, and where each begins and the last one ends."""
    there, first = np.unique(buckets, return_index=True)
    return there.tolist(), [*first.tolist(), len(buckets)]


def _tokenize(buckets: int):
    """Chunks of tokens as places in the chunk's own vocabulary, and that vocabulary by bucket."""

    def chunk(part: int, ids: list, held: list, tokens: list[list[int]], words: dict[bytes, int]) -> pa.RecordBatch:
        hashes = np.fromiter(
            (_END if w == b" " else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)
        )
        order = np.lexsort((hashes, hashes % np.uint64(buckets)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array([len(t) for t in tokens])
        flat = place[np.concatenate([np.array(t, np.int64) for t in tokens])]
        held_out = np.array(held, bool)
        train = np.bincount(flat[~np.repeat(held_out, lengths)], minlength=len(order))
        hashes = hashes[order]
        missing = np.array([i is None for i in ids])
        number = np.array([0 if i is None else i for i in ids], np.int64)
        rows = [
            (_TOKENS, part, 0, [pack(flat), pack(lengths), pack(held_out), pack(missing), number.tobytes()])
        ]
        there, cuts = _runs((hashes % np.uint64(buckets)).astype(np.int64))
        for b, low, high in zip(there, cuts[:-1], cuts[1:], strict=True):
            rows.append((_WORDS, part, b, [hashes[low:high].tobytes(), pack(train[low:high])]))
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        ids, held, tokens, words, count = [], [], [], {b" ": 0}, 0
        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = [words.setdefault(w, len(words)) for w in text.as_py().encode().lower().split()]
                found.append(0)
                ids.append(i)
                held.append(h)
                tokens.append(found)
                count += len(found)
                if count >= _CHUNK:
                    yield chunk(part, ids, held, tokens, words)
                    part, ids, held, tokens, words, count = part + 1, [], [], [], {b" ": 0}, 0
        if ids:
            yield chunk(part, ids, held, tokens, words)

    return run


def _count_words(buckets: int):
    """Totals of a bucket's words; to every chunk the ids and counts of the words it sent."""

    def run(group: pa.Table) -> pa.Table:
        sent = _rows(group, _WORDS, "part")
        bucket = group["bucket"][0].as_py()
        parts = [(p, np.frombuffer(d[0], np.uint64), unpack(d[1])) for p, d in sent]
        values, at = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, _, c in parts])).astype(np.int64)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(values))
        ids = rank * buckets + bucket + 1  # 0 stands for the beginning of a text
        rows, low = [(_SUMS, -1, bucket, [pack(np.array([total.sum(), (total > 0).sum()]))])], 0
        for part, hashes, _ in parts:
            mine = at[low : low + len(hashes)]
            low += len(hashes)
            rows.append((_IDS, part, bucket, [pack(ids[mine]), pack(total[mine])]))
        return _table(rows)

    return run


def _mixed(values: np.ndarray) -> np.ndarray:
    return ((values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


class _Chunk:
    """A chunk's tokens as distinct (context, word) pairs, in the order in which they are sent."""

    def __init__(self, group: pa.Table, buckets: int, hot: int):
        ((self.part, data),) = _rows(group, _TOKENS, "part")
        flat, self.lengths = unpack(data[0]), unpack(data[1])
        self.held, missing = unpack(data[2]).astype(bool), unpack(data[3]).astype(bool)
        self.ids = pa.array(np.frombuffer(data[4], np.int64), mask=missing)
        known = [d for _, d in _rows(group, _IDS, "bucket")]
        self.word_ids = np.concatenate([unpack(d[0]) for d in known])
        self.word_counts = np.concatenate([unpack(d[1]) for d in known])
        before = np.empty_like(flat)
        before[1:] = flat[:-1] + 1
        before[np.cumsum(self.lengths) - self.lengths] = 0
        pairs, self.pair = np.unique((before << 32) | flat, return_inverse=True)
        context, self.word = pairs >> 32, pairs & 0xFFFFFFFF
        self.u = np.append(0, self.word_ids)[context]
        self.w = self.word_ids[self.word]
        # every text ends with the end token, so its count is that of texts, and of their beginnings
        self.size = np.append(self.word_counts[flat[-1]], self.word_counts)[context]
        self.dealt = self.size > hot
        slices = np.where(self.dealt, -(-self.size // hot), 1)
        slot = _mixed(_mixed(self.u) + (_mixed(self.w) % slices))
        self.bucket = slot % buckets
        self.order = np.lexsort((self.w, self.u, self.bucket))
        self.token_doc = np.repeat(np.arange(len(self.lengths)), self.lengths)


def _send_pairs(buckets: int, hot: int):
    def run(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group, buckets, hot)
        train = np.bincount(chunk.pair[~chunk.held[chunk.token_doc]], minlength=len(chunk.u))
        order = chunk.order
        there, cuts = _runs(chunk.bucket[order])
        rows = []
        for b, low, high in zip(there, cuts[:-1], cuts[1:], strict=True):
            at = order[low:high]
            counts = chunk.word_counts[chunk.word[at]]
            data = [_sorted(chunk.u[at]), pack(chunk.w[at]), pack(train[at]), pack(counts)]
            data += [pack(chunk.dealt[at]), pack(chunk.size[at])]
            rows.append((_PAIRS, chunk.part, b, data))
        return _table(rows)

    return run


def _stirling(d: float) -> np.ndarray:
    """log S(c, t) for c, t up to ``_EXACT``: S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    out = np.full((_EXACT + 1, _EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(_EXACT):
            t = np.arange(1, c + 2)
            stay = np.log(np.maximum(c - t * d, 0)) + out[c, 1 : c + 2]
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def sample_tables(counts: np.ndarray, x: np.ndarray, d: float, table: np.ndarray, rng) -> np.ndarray:
    """Tables of dishes with ``counts`` customers, where a new table weighs ``x``."""
    out = np.minimum(counts, 1)
    large = counts > _EXACT
    if large.any():
        c = counts[large]
        out[large] = np.minimum(1 + rng.poisson(np.minimum(x[large] / d * (1 - c**-d), c)), c)
    many = np.flatnonzero((counts > 1) & ~large)
    many = many[np.argsort(counts[many], kind="stable")]
    sizes, starts = np.unique(counts[many], return_index=True)
    for c, at in zip(sizes.tolist(), np.split(many, starts[1:]), strict=False):
        weight = np.log(x[at])[:, None] * np.arange(c) + table[c, 1 : c + 1]
        weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
        out[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(1)
    return out


def _seat(settings: Settings, word_buckets: int, tokens: int, types: int):
    """Gibbs seating of a bucket's contexts; tables go to the parent, seats back to the chunks."""
    d, strength = settings.discounts[0], settings.strengths[0]

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        blocks = _rows(group, _PAIRS, "part")
        u, w, n, cw, dealt, cu = (
            np.concatenate([(_unsorted if i == 0 else unpack)(data[i]) for _, data in blocks]) for i in range(6)
        )
        order = np.lexsort((w, u))
        first = np.append(True, (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0))
        at = np.empty(len(u), np.int64)
        at[order] = np.cumsum(first) - 1
        top = order[first]
        u, w, cw, dealt, cu = u[top], w[top], cw[top], dealt[top].astype(bool), cu[top]
        counts = np.bincount(at, n).astype(np.int64)
        context = np.cumsum(np.append(True, np.diff(u) != 0)) - 1
        sizes = np.bincount(context, counts)
        # of a dealt-out context this bucket sees a share, which stands for the whole
        whole = np.where(dealt, np.maximum(cu, 1) / np.maximum(sizes[context], 1), 1.0)
        base = (cw + 1.0) / (tokens + types + 1.0)  # the parent's state before any seating
        rng, table = np.random.default_rng([settings.seed, bucket]), _stirling(d)
        tables, seats = np.minimum(counts, 1), np.zeros(len(counts), np.int64)
        for sweep in range(settings.burn_in + settings.samples):
            opened = np.bincount(context, tables)[context] * whole - tables
            tables = sample_tables(counts, (strength + d * opened) * base, d, table, rng)
            if sweep >= settings.burn_in:
                seats += tables
        context_seats = np.bincount(context, seats).astype(np.int64)
        rows, low = [], 0
        for part, data in blocks:
            high = low + len(at[low:]) if part == blocks[-1][0] else low + len(unpack(data[1]))
            mine = at[low:high]
            low = high
            where = context[mine]
            rows.append(
                (_SEATS, part, bucket, [pack(counts[mine]), pack(seats[mine]), pack(sizes[where]), pack(context_seats[where])])
            )
        hot = np.unique(context[dealt])
        if len(hot):
            one = np.flatnonzero(np.append(True, np.diff(context) != 0))[hot]
            rows.append((_SUMS, -1, bucket, [pack(u[one]), pack(sizes[hot]), pack(context_seats[hot])]))
        # customers of the parent, by the bucket of the word
        dishes, which = np.unique(w, return_inverse=True)
        customers = np.bincount(which, tables).astype(np.int64)
        dishes, customers = dishes[customers > 0], customers[customers > 0]
        home = (dishes - 1) % word_buckets
        for b in np.unique(home):
            rows.append((_TABLES, -1, int(b), [_sorted(dishes[home == b]), pack(customers[home == b])]))
        return _table(rows)

    return run


def _seat_parent(settings: Settings, types: int):
    """Gibbs seating of the parent's dishes in a bucket of words; results go to the chunks."""
    d, strength = settings.discounts[1], settings.strengths[1]

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        came = _rows(group, _TABLES, "part")
        ids = np.concatenate([_unsorted(data[0]) for _, data in came] or [np.zeros(0, np.int64)])
        dishes, which = np.unique(ids, return_inverse=True)
        counts = np.bincount(which, np.concatenate([unpack(data[1]) for _, data in came] or [ids])).astype(np.int64)
        rng, table = np.random.default_rng([settings.seed, 1 << 40, bucket]), _stirling(d)
        tables, seats = np.minimum(counts, 1), np.zeros(len(counts), np.int64)
        share = max(types, 1) / max(len(dishes), 1)  # what this bucket sees of the one restaurant
        for sweep in range(settings.burn_in + settings.samples):
            x = (strength + d * (tables.sum() * share - tables)) / (types + 1.0)
            tables = sample_tables(counts, x, d, table, rng)
            if sweep >= settings.burn_in:
                seats += tables
        rows = [(_SUMS, -2, bucket, [pack(np.array([counts.sum(), seats.sum()]))])]
        for part, data in _rows(group, _IDS, "part"):
            mine = unpack(data[0])
            at = np.minimum(np.searchsorted(dishes, mine), max(len(dishes) - 1, 0))
            there = dishes[at] == mine if len(dishes) else np.zeros(len(mine), bool)
            m = np.where(there, counts[at], 0) if len(dishes) else np.zeros(len(mine), np.int64)
            s = np.where(there, seats[at], 0) if len(dishes) else np.zeros(len(mine), np.int64)
            rows.append((_PARENT, part, bucket, [pack(m), pack(s)]))
        return _table(rows)

    return run


_RESULT = (
    "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(settings: Settings, buckets: int, hot: int, tokens: int, types: int, dealt: dict, parent: tuple[int, int]):
    (d, d0), (strength, strength0), kept = settings.discounts, settings.strengths, settings.samples

    def run(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group, buckets, hot)
        known = [d_ for _, d_ in _rows(group, _PARENT, "bucket")]
        m, s = (np.concatenate([unpack(k[i]) for k in known]) for i in (0, 1))
        every, tables = parent[0], parent[1] / kept
        root = np.maximum(m - d0 * s / kept, 0) + (strength0 + d0 * tables) / (types + 1.0)
        root = root / (strength0 + every)
        seats = [d_ for _, d_ in _rows(group, _SEATS, "bucket")]
        c, t, cu, tu = (np.concatenate([unpack(k[i]) for k in seats]).astype(float) for i in range(4))
        order = chunk.order
        spread = np.flatnonzero(chunk.dealt[order])
        if len(spread):
            at, which = np.unique(chunk.u[order][spread], return_inverse=True)
            sums = np.array([dealt.get(int(x), (0, 0)) for x in at], float)
            cu[spread], tu[spread] = sums[which, 0], sums[which, 1]
        t, tu = t / kept, tu / kept
        p = (np.maximum(c - d * t, 0) + (strength + d * tu) * root[chunk.word[order]]) / (strength + cu)
        logs = np.empty(len(p))
        logs[order] = np.log10(p)
        count = chunk.word_counts
        base = np.log10((count + 1.0) / (tokens + (types + 1.0)))
        word, doc, n = chunk.word[chunk.pair], chunk.token_doc, len(chunk.lengths)
        return pa.table(
            {
                "id": chunk.ids,
                "held_out": chunk.held,
                "n_tokens": chunk.lengths,
                "n_known": np.bincount(doc, count[word] > 0, minlength=n).astype(np.int64),
                "train_tokens": np.full(n, tokens),
                "base_score": np.bincount(doc, base[word], minlength=n),
                "score": np.bincount(doc, logs[chunk.pair], minlength=n),
            }
        )

    return run


def score(
    docs: DataFrame,
    held_out: Column,
    *,
    settings: Settings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Runs jobs.

    The model is trained on the rows that are not ``held_out``; all rows are scored.
    """
    settings = settings or Settings()
    given = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_of(text_col).alias("text")
    )
    amount = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # by the amount of text alone: seeds and cuts go by bucket, so scores do not hang on the session's width
    word_buckets = max(_LEAST_WORD_BUCKETS, math.ceil(amount / _WORD_BYTES))
    buckets = max(_LEAST_BUCKETS, math.ceil(amount / _PAIR_BYTES))

    chunks = freeze(given.mapInArrow(_tokenize(word_buckets), _SCHEMA), "tokens")
    tokens_of = chunks.where(F.col("kind") == _TOKENS)
    words = freeze(
        chunks.where(F.col("kind") == _WORDS).groupBy("bucket").applyInArrow(_count_words(word_buckets), _SCHEMA), "words"
    )
    ids = words.where(F.col("kind") == _IDS)
    sums = [unpack(bytes(r["data"][0])) for r in words.where(F.col("kind") == _SUMS).collect()]  # one per bucket
    tokens, types = (int(sum(s[i] for s in sums)) for i in (0, 1))

    hot = max(tokens // (_SHARE * buckets), 1)
    pairs = tokens_of.unionAll(ids).groupBy("part").applyInArrow(_send_pairs(buckets, hot), _SCHEMA)
    seated = freeze(
        pairs.groupBy("bucket").applyInArrow(_seat(settings, word_buckets, tokens, types), _SCHEMA), "seats"
    )
    dealt: dict[int, tuple[int, int]] = {}
    for row in seated.where(F.col("kind") == _SUMS).collect():  # at most 2 * _SHARE * buckets slices
        for u, c, t in zip(*(unpack(bytes(b)).tolist() for b in row["data"]), strict=True):
            old = dealt.get(u, (0, 0))
            dealt[u] = (old[0] + c, old[1] + t)

    parents = freeze(
        seated.where(F.col("kind") == _TABLES).unionAll(ids).groupBy("bucket").applyInArrow(
            _seat_parent(settings, types), _SCHEMA
        ),
        "parent",
    )
    sums = [unpack(bytes(r["data"][0])) for r in parents.where(F.col("kind") == _SUMS).collect()]  # one per bucket
    parent = tuple(int(sum(s[i] for s in sums)) for i in (0, 1))

    everything = (
        tokens_of.unionAll(ids)
        .unionAll(seated.where(F.col("kind") == _SEATS))
        .unionAll(parents.where(F.col("kind") == _PARENT))
    )
    scored = everything.groupBy("part").applyInArrow(
        _score(settings, buckets, hot, tokens, types, dealt, parent), _RESULT
    )
    return scored.withColumnRenamed("id", id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """Of trained and of held-out rows: held_out, n_tokens, perplexity and that of the base, per token. Rows are those
    of ``score``; no rows give no result."""
    sums = scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"), F.sum("base_score").alias("base")
    )
    per = lambda column: F.pow(F.lit(10.0), -F.col(column) / F.col("n_tokens"))
    return sums.select("held_out", "n_tokens", per("score").alias("perplexity"), per("base").alias("base_perplexity"))
