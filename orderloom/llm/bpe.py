"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

Encoding finds, with one Aho-Corasick pass per piece of text, the longest token that starts at
each byte. It takes the longest token that is compatible with the token before it; if none is, it
steps back and tries the next shorter prefix token. Two neighbours are compatible if merging their
bytes by rank gives just these two tokens, which is read off the merge rules by undoing the later
of the two merges again and again. The result equals merging by rank.

Pieces come from the vocabulary's own splitting pattern, and special tokens that stand in a text
become their ids, as in the ``tokenizers`` library. Each worker keeps the ids of the pieces it has
met, up to a fixed number, so frequent pieces are encoded once.

``round_trip`` encodes, decodes and compares in one Python worker: the text travels once, and one vocabulary
is held.

Decoding holds all token bytes in one buffer with an offset per id, gathers the slices of a
sequence, and reads them as UTF-8 (invalid bytes become U+FFFD).

Defined results: a null text counts as empty and gives no ids; every row is encoded on its own, so
repeated rows repeat; texts of any length are encoded whole; an empty table gives no rows. Ids outside the
vocabulary raise. Extra columns are kept, but one called like a result is replaced by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import fresh, text_of, tidied

#: Fixed value: the splitting pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What an encoder remembers: pieces (up to a length), and pairs of neighbours.
_KEPT_PIECES, _KEPT_LENGTH, _KEPT_PAIRS = 250_000, 48, 250_000


def _byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id: one buffer and an offset table. All that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self._take(json.load(file))

    def _take(self, spec: dict) -> list[bytes]:
        """Keep what decoding needs of a vocabulary file; the bytes of every id but the special ones."""
        byte_of = _byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        bytes_of = [b""] * size
        for token, i in vocab.items():
            bytes_of[i] = bytes(byte_of[c] for c in token)
        plain = list(bytes_of)
        for content, i in self.special.items():
            bytes_of[i] = content.encode()
        self._buffer = np.frombuffer(b"".join(bytes_of), np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(b) for b in bytes_of])])
        return plain

    def decode_all(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of many sequences: ``flat`` holds their ids, ``lengths`` how many each has."""
        starts = self._offsets[flat]
        sizes = self._offsets[flat + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # position of every output byte in the buffer: its token's offset plus its place in it
        source = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        data = self._buffer[source].tobytes()
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [
            data[a:b].decode("utf-8", "replace")
            for a, b in zip(borders[:-1], borders[1:], strict=True)
        ]


class ByteBPE(Vocabulary):
    def _take(self, spec: dict) -> list[bytes]:
        plain = super()._take(spec)
        self.sizes = np.diff(self._offsets).tolist()
        id_of = {b: i for i, b in enumerate(plain) if b}
        model = spec["model"]
        vocab, size = model["vocab"], len(self.sizes)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # rank of the merge that makes a token (-1: a single byte), its two halves, and the pairs
        self._rank = [-1] * size
        self._left, self._right = [-1] * size, [-1] * size
        self._made: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._made[left, right] = rank
            if self._rank[whole] < 0:
                self._rank[whole], self._left[whole], self._right[whole] = rank, left, right
        self._shorter = [-1] * size
        self._automaton = ahocorasick.Automaton()
        for token, i in id_of.items():
            shorter = (id_of.get(token[:end], -1) for end in range(len(token) - 1, 0, -1))
            self._shorter[i] = next((t for t in shorter if t >= 0), -1)
            self._automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
        self._automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._find = regex.compile(PATTERN).findall
        self._split = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
            if self.special
            else None
        )
        return plain

    def forget(self) -> None:
        """Give up what is remembered of pieces and pairs; it is found again when needed."""
        self._pieces.clear()
        self._compatible.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves exactly these two tokens."""
        known = self._compatible.get((left, right))
        if known is None:
            if len(self._compatible) >= _KEPT_PAIRS:
                self._compatible.clear()
            known = self._compatible[left, right] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # A merge across the border happens if its rank comes before the merge that would take
        # one of its two parts into a larger token. At equal rank the left occurrence goes first.
        a, b = left, right
        taken_a = taken_b = 1 << 60  # rank at which a joins its left neighbour, b its right one
        while True:
            across = self._made.get((a, b))
            if across is not None and across < taken_a and across <= taken_b:
                if across < taken_b or b != right:
                    return False
            # undo the later of the merges that made a and b
            if self._rank[a] < 0 and self._rank[b] < 0:
                return True
            if self._rank[a] >= self._rank[b] and self._rank[a] >= 0:
                taken_a, a = self._rank[a], self._right[a]
            else:
                taken_b, b = self._rank[b], self._left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, (back, token) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - back] = token  # ends rise, so the longest match of a start is its last
        sizes, shorter, known = self.sizes, self._shorter, self._compatible
        dead = set()  # positions that no encoding passes through
        out: list[int] = []
        at, last = 0, -1
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def _ids(self, text: str, out: list[int]) -> None:
        known = self._pieces
        for piece in self._find(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= _KEPT_LENGTH:
                    if len(known) >= _KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self._split is None:
            self._ids(text, out)
            return out
        for part in self._split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._ids(part, out)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Bytes of text that are encoded or decoded at a time, which bounds memory for very long texts.
_CHUNK_BYTES = 2_000_000


def _chunks(column: pa.Array, size_of) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, size in enumerate(size_of):
        if held and held + size > _CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(column):
        yield start, len(column)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of every text. ``path``: the vocabulary file, present on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in _chunks(texts, pc.binary_length(texts).to_pylist()):
                ids = pa.array([bpe.encode(t) for t in texts[a:b].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[a:b] for i in range(batch.num_columns - 1)), ids],
                    names=[*batch.schema.names[:-1], ids_col],
                )

    rest = docs.drop(ids_col)
    (work,) = fresh(rest, "work")
    given = rest.withColumn(work, text_of(text_col))
    return given.mapInArrow(run, _schema(rest, f"{ids_col} array<int>"))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of every id sequence; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            lengths = np.diff(ids.offsets.to_numpy())
            for a, b in _chunks(ids, (lengths * 4).tolist()):
                part = ids[a:b]
                texts = known.decode_all(part.flatten().to_numpy().astype(np.int64), lengths[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[a:b] for i in range(batch.num_columns - 1)), pa.array(texts, pa.string())],
                    names=[*batch.schema.names[:-1], text_col],
                )

    rest = encoded.drop(text_col)
    (work,) = fresh(rest, "work")
    given = rest.withColumn(work, F.coalesce(F.col(ids_col), F.array().cast("array<int>")))
    return given.mapInArrow(run, _schema(rest, f"{text_col} string"))


def round_trip(
    docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "restored"
) -> DataFrame:
    """Add the token ids of every text, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in _chunks(texts, pc.binary_length(texts).to_pylist()):
                part = texts[a:b].to_pylist()
                ids = [bpe.encode(t) for t in part]
                lengths = np.array([len(i) for i in ids], np.int64)
                ids = pa.array(ids, pa.list_(pa.int32()))
                back = bpe.decode_all(ids.flatten().to_numpy().astype(np.int64), lengths)
                same = pa.array([x == y for x, y in zip(part, back, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[a:b] for i in range(batch.num_columns - 1)), ids, same],
                    names=[*batch.schema.names[:-1], ids_col, same_col],
                )
        bpe.forget()  # the worker goes on to other stages

    (work,) = fresh(docs, "work")
    given = docs.withColumn(work, text_of(text_col)).drop(ids_col, same_col)
    rest = given.drop(work)
    schema = _schema(rest, f"{ids_col} array<int>")
    return given.mapInArrow(tidied(run), schema.add(same_col, "boolean"))


def _schema(rest: DataFrame, added: str):
    from pyspark.sql.types import StructType

    fields = [*rest.schema.fields, *StructType.fromDDL(added.replace(" ", ": ", 1)).fields]
    return StructType(fields)
