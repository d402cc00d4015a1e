"""Alignment of two tokenizers' ids: which ids end together, how often, and which are each other's best.

Each text is encoded by vocabulary A (byte-level) and vocabulary B (sentence pieces). Byte offsets where
tokens of both end cut the text into groups; the tokens that end a group are linked. Most groups hold
one token of each with the same bytes. For these an array from every A id to the B id of the same bytes is made
beforehand, and their links are counted in vectors as long as the vocabulary. Only links of other groups
are counted as pairs in a shuffle.

Encoding goes by units: a unit begins with a blank that follows a character which is no white space
for either vocabulary. No token of A or B crosses the border of a unit, so units are encoded and
aligned once and remembered (a bounded number of them), and a text is the sequence of its units. If B has a piece
that could cross a border, whole texts are the units.

Defined results: texts that are null, empty, or not given back by one of the vocabularies have no tokens, zeros, and
an empty ``groups``. Strings of special tokens are plain text. Repeated rows count as often as they stand
there. Empty tables give no rows. Very long texts are encoded whole; memory grows with a text's longest
unit. Extra columns are kept as they are, but one called like a result is replaced by it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from orderloom.functions.storage import freeze
from orderloom.llm.bpe import PATTERN, _byte_characters
from orderloom.llm.common import checked, fresh

#: Characters after which a blank begins no unit: white space by any definition, and B's own mark of a blank.
_ODD = "\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u2581\\u3000\\ufeff"
_UNITS = re.compile(rf" +[^ ]*(?:(?<=[{_ODD}]) +[^ ]*)*")
_MARK = "\u2581"
#: Whether a text holds ASCII and Latin letters only, up to U+024F.
_LATIN = re.compile("[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]*").fullmatch
#: Bounds of what a worker remembers: units, characters in them; and characters that are worked on at a time.
_KEPT_UNITS, _KEPT_CHARS, _CHUNK_CHARS, _CHUNK_ROWS = 300_000, 6_000_000, 1_000_000, 500
_PAIRS_HELD = 2_000_000
_RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self):
        self.size, self._room = 0, np.zeros(1024, np.int64)

    def add(self, new: np.ndarray) -> None:
        while self.size + len(new) > len(self._room):
            self._room = np.concatenate([self._room, np.zeros_like(self._room)])
        self._room[self.size : self.size + len(new)] = new
        self.size += len(new)

    def array(self) -> np.ndarray:
        return self._room[: self.size]


class Links:
    """Aligned texts: tokens and groups of each, the groups as text, and the links as counted lists."""

    def __init__(self, n_a, n_b, n_groups, shown, same, pairs):
        self.n_a, self.n_b, self.n_groups, self.shown = n_a, n_b, n_groups, shown
        self.same, self.pairs = same, pairs  # (offsets, ids or pairs, how often)


def _counted(owner: np.ndarray, links: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of each row with their counts. Links take less than 50 bits, rows are few."""
    found, times = np.unique(owner << 50 | links, return_counts=True)
    return np.searchsorted(found >> 50, np.arange(rows + 1)), found & ((1 << 50) - 1), times


class Aligner:
    """Both vocabularies, and the units met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True  # their strings are plain text
        self._a.no_truncation()
        self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_characters()
        self.size_a, self.size_b = self._a.get_vocab_size(), self._b.get_piece_size()
        self.bytes_a = [self._a_bytes(self._a.id_to_token(i), byte_of) for i in range(self.size_a)]
        self.bytes_b = [
            bytes([int(self._b.id_to_piece(i)[3:5], 16)])
            if self._b.is_byte(i)
            else self._b.id_to_piece(i).replace(_MARK, " ").encode()
            for i in range(self.size_b)
        ]
        #: A's id -> B's id of the same bytes, or -1; pieces come before B's single-byte ids
        order = sorted(range(self.size_b), key=lambda i: (self._b.is_byte(i), i))
        of_bytes = {self.bytes_b[i]: i for i in reversed(order)}
        self.same = np.array([of_bytes.get(t, -1) if t else -1 for t in self.bytes_a])
        self._same_shown = [f"{i}|{j}" for i, j in enumerate(self.same.tolist())]
        self._len_a = np.array([len(t) for t in self.bytes_a])
        self._len_b = np.array([len(t) for t in self.bytes_b])
        inner = (self._b.id_to_piece(i).lstrip(_MARK) for i in range(self.size_b) if not self._b.is_byte(i))
        self._cuts = not any(_MARK in piece for piece in inner)
        self._blank = self._b.piece_to_id(_MARK)
        self._plain = self._plain_encoder(a_path)
        self._forget()

    @staticmethod
    def _a_bytes(token: str | None, byte_of: dict[str, int]) -> bytes:
        token = token or ""
        return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def _plain_encoder(self, a_path: str):
        """A faster encoder with the same merges for units of Latin letters, digits and ASCII, whose classes all
        libraries agree on; None if A's ids are not in the order of its merges."""
        import json

        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        vocab = model["vocab"]
        if [vocab[m] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._shown: list[str | None] = []  # groups as text; None: bytes are not given back
        self._sizes = [Grown(), Grown(), Grown()]
        self._links = Grown()
        self._chars = 0

    def _learn(self, units: list[str]) -> None:
        """Encode and align units that are not known yet."""
        plain = self._plain
        odd = [u for u in units if plain is None or not _LATIN(u)]
        of_odd = dict(zip(odd, self._a.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        ids_a = [of_odd[u].ids if u in of_odd else plain(u) for u in units]
        ids_b = self._b.encode([u[1:] for u in units], num_threads=1)  # B adds a blank
        ids_b = [[self._blank] if u == " " else b for u, b in zip(units, ids_b, strict=True)]
        whole = [True] * len(units)
        if not self._same_bytes(units, ids_a, ids_b):
            whole = [self._same_bytes([u], [a], [b]) for u, a, b in zip(units, ids_a, ids_b, strict=True)]
            ids_a = [a if ok else [] for a, ok in zip(ids_a, whole, strict=True)]
            ids_b = [b if ok else [] for b, ok in zip(ids_b, whole, strict=True)]
        n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array([i for part in ids for i in part], np.int64) for ids in (ids_a, ids_b))
        # units lie one behind the other, and every unit's end is an end of both
        ends_a, ends_b = np.cumsum(self._len_a[flat_a]), np.cumsum(self._len_b[flat_b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        one_a, one_b = flat_a[last_a], flat_b[last_b]
        alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        same = alone & (self.same[one_a] == one_b)
        n_groups = np.diff(np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)])))
        names = self._same_shown
        shown = [names[i] for i in one_a.tolist()]
        a, b = flat_a.tolist(), flat_b.tolist()
        for k in np.flatnonzero(~same).tolist():
            from_a, from_b = (last_a[k - 1] + 1, last_b[k - 1] + 1) if k else (0, 0)
            group_a, group_b = a[from_a : last_a[k] + 1], b[from_b : last_b[k] + 1]
            shown[k] = ",".join(map(str, group_a)) + "|" + ",".join(map(str, group_b))
        at = 0
        for unit, many, ok in zip(units, n_groups.tolist(), whole, strict=True):
            self._number[unit] = len(self._shown)
            self._shown.append(";".join(shown[at : at + many]) if ok else None)
            at += many
        self._chars += sum(map(len, units))
        for kept, new in zip(self._sizes, (n_a, n_b, n_groups), strict=True):
            kept.add(new)
        self._links.add(np.where(same, one_a, one_a + 1 << 32 | one_b))

    def _same_bytes(self, units: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> bool:
        raw = [u.encode() for u in units]
        of_a, of_b = self.bytes_a, self.bytes_b
        return all(
            b"".join([of_a[i] for i in a]) == r == b"".join([of_b[i] for i in b])
            for r, a, b in zip(raw, ids_a, ids_b, strict=True)
        )

    def _ensure(self, units: set[str]) -> None:
        missing = [u for u in units if u not in self._number]
        start = held = 0
        for end, unit in enumerate(missing):
            if end > start and held + len(unit) > _CHUNK_CHARS:
                self._learn(missing[start:end])
                start, held = end, 0
            held += len(unit)
        if start < len(missing):
            self._learn(missing[start:])

    def units(self, whole: str) -> list[str]:
        return _UNITS.findall(whole) if self._cuts else [whole]

    def align(self, texts: list[str | None]) -> Links:
        if len(self._number) > _KEPT_UNITS or self._chars > _KEPT_CHARS:
            self._forget()
        split = [self.units(" " + t) if t else [] for t in texts]
        self._ensure({u for units in split for u in units})
        number, all_shown = self._number, self._shown
        at, shown = [], []
        for text, units in zip(texts, split, strict=True):
            of_text = [number[u] for u in units]
            parts = [all_shown[i] for i in of_text]
            if None in parts:  # the whole text decides
                self._ensure({" " + text})
                of_text = [number[" " + text]]
                parts = [all_shown[of_text[0]] or ""]
            at.append(np.array(of_text, np.int64))
            shown.append(";".join(parts))
        rows = len(texts)
        owner = np.repeat(np.arange(rows), [len(x) for x in at])
        flat = np.concatenate([np.zeros(0, np.int64), *at])
        of_unit = [kept.array()[flat] for kept in self._sizes]
        n_a, n_b, n_groups = (np.bincount(owner, n, rows).astype(np.int64) for n in of_unit)
        # places of all links of all units: each unit's first one, and the steps within the unit
        many = of_unit[2]
        first = np.concatenate([[0], np.cumsum(self._sizes[2].array())])[flat]
        before = np.cumsum(many) - many
        links = self._links.array()[np.repeat(first - before, many) + np.arange(many.sum())]
        owner = np.repeat(owner, many)
        even = links < 1 << 32
        same = _counted(owner[even], links[even], rows)
        offsets, pairs, times = _counted(owner[~even], links[~even], rows)
        return Links(n_a, n_b, n_groups, shown, same, (offsets, pairs - (1 << 32), times))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(offsets: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


#: What ``groups`` adds, beside the results: A ids of one-to-one groups and linked pairs (A id << 32 | B id), counted.
_LISTS = ("same_ids", "same_n", "pairs", "pair_n")


def groups(
    docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", lists: tuple[str, ...] = _LISTS
) -> DataFrame:
    """Add ``n_a, n_b, n_groups, n_links, groups`` and the links as counted lists, called ``lists``."""
    names = (*_RESULTS[:5], *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start = 0
            while start < len(texts):
                end, held, chunk = start, 0, []
                while end < len(texts) and (end == start or held < _CHUNK_CHARS) and end - start < _CHUNK_ROWS:
                    chunk.append(texts[end].as_py())
                    held += len(chunk[-1] or "")
                    end += 1
                found = tool.align(chunk)
                groups = pa.array(found.n_groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i)[start:end] for i in range(batch.num_columns - 1)),
                        pa.array(found.n_a), pa.array(found.n_b), groups, groups, pa.array(found.shown, pa.string()),
                        _lists(found.same[0], found.same[1], pa.int32()), _lists(found.same[0], found.same[2], pa.int32()),
                        _lists(found.pairs[0], found.pairs[1], pa.int64()), _lists(found.pairs[0], found.pairs[2], pa.int32()),
                    ],
                    names=[*batch.schema.names[:-1], *names],
                )
                start = end

    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    kinds = [*[LongType()] * 4, StringType(), ints, ints, longs, ints]
    (work,) = fresh(docs, "work")
    given = docs.withColumn(work, F.col(text_col).cast("string")).drop(*names)
    added = [StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], *added]))


def link_counts(grouped: DataFrame, a_path: str, b_path: str, lists: tuple[str, ...] = _LISTS) -> DataFrame:
    """pair (A id << 32 | B id), n (links of all rows that hold the pair), best (no A id has more with this B
    id), same (of one-to-one groups of the same bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        vector = np.zeros(tool.size_a, np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def rows(pairs: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
            flags = pa.array(np.full(len(n), same))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n), flags], names=["pair", "n", "same"])

        for batch in batches:
            same, same_n, pairs, pair_n = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in range(4))
            np.add.at(vector, same, same_n)
            known, inverse = np.unique(np.concatenate([held[0], pairs]), return_inverse=True)
            total = np.zeros(len(known), np.int64)
            np.add.at(total, inverse, np.concatenate([held[1], pair_n]))
            held = [known, total]
            if len(known) > _PAIRS_HELD:
                yield rows(*held, False)
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        ids = np.flatnonzero(vector)
        yield rows(ids << 32 | tool.same[ids], vector[ids], True)
        yield rows(*held, False)

    counts = (
        grouped.select(*lists)
        .mapInArrow(run, "pair long, n long, same boolean")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"), F.bool_or("same").alias("same"))
        .withColumn("b_id", F.expr("pair & 4294967295L"))
    )
    counts = freeze(counts, "link-counts")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # at most one row for each id of B
    rated = counts.join(F.broadcast(most), "b_id")
    return rated.select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "same")


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    *,
    text_col: str = "text",
    shown: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """Add ``n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` to every row. Runs jobs.

    ``shown``: what is kept of ``groups`` (a digest, say), so that long texts need not be written.
    """
    rest = docs.drop(*_RESULTS)
    *lists, key = fresh(rest, *_LISTS, "key")
    grouped = groups(docs, a_path, b_path, text_col, tuple(lists)).withColumn("groups", shown(F.col("groups")))
    written = freeze(grouped.withColumn(key, F.monotonically_increasing_id()), "token-groups")
    counts = freeze(link_counts(written, a_path, b_path, tuple(lists)), "link-ratings")
    of_same = (
        counts.where("same").select(F.shiftright("pair", 32).alias("a_id"), "n", "best").toArrow()
    )  # at most one row for each id of A
    at = of_same["a_id"].to_numpy()
    n_of, best_of = (np.zeros(1 + at.max(initial=0), np.int64) for _ in range(2))
    n_of[at] = of_same["n"].to_numpy()
    best_of[at] = of_same["best"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((n_of, best_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of, best_of = shared.value
        for batch in batches:
            ids, many = batch.column(1), batch.column(2)
            lengths = np.diff(ids.offsets.to_numpy())
            owner = np.repeat(np.arange(len(lengths)), lengths)
            flat, times = ids.flatten().to_numpy(), many.flatten().to_numpy().astype(np.int64)
            best, total = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            np.add.at(best, owner, best_of[flat] * times)
            np.add.at(total, owner, n_of[flat] * times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"]
            )

    same_ids, same_n, pairs, pair_n = lists
    of_row = F.col(key).alias("row")
    even = written.select(of_row, same_ids, same_n).mapInArrow(run, "row long, n_best long, count_sum long")
    times = F.element_at(pair_n, F.col("at") + 1).cast("long")
    rated = checked(counts.where("NOT same").select("pair", "n", "best"), "rated-pairs")
    odd = (
        written.select(of_row, pair_n, F.posexplode(pairs).alias("at", "pair"))
        .select("row", "pair", times.alias("times"))
        .join(rated, "pair")
        .select(
            "row",
            F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
            (F.col("n") * F.col("times")).alias("count_sum"),
        )
    )
    sums = even.unionAll(odd).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = written.join(sums, F.col(key) == F.col("row"))
    return joined.select(*rest.columns, *_RESULTS)
