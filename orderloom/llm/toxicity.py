"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

Fitting takes a bounded sample of labelled texts (``Bounds``). The ordinary dictionary is trained
on windows of ordinary text, the toxic one on the words of toxic texts whose beginnings recur there
and are rare in the ordinary texts of the sample; it lies in front of the ordinary content, so both compressors
treat ordinary text alike and a window becomes shorter only where it holds toxic content. A text is
cut into windows of whole words. The gain of a window is its compressed length under the ordinary
dictionary less that under the toxic one; how much evidence each gain carries, and how evidence
becomes a probability, is calibrated on texts whose dictionaries were trained without them. Where the
bounds change the shares of the classes, the constant is moved to the odds of all labelled documents.

Scoring reads every window of every text, in tasks that need only the fitted model (some kilobytes).

Defined results: null and empty texts have no evidence and get the score of an evidence of zero;
repeated texts get the same score; very long texts are cut like any other. Labels that are null or
neither 0 nor 1 are ignored; of several labels of one id the highest counts; of several texts of
one id the smallest is learned. Without labels of both classes every score is the share of toxic
labels, 0 if there are none. Extra columns are kept, but one called like the score is replaced by it. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orderloom.llm.common import fresh, text_of, tidied

_WINDOW, _LONGEST = 32, 256
#: Opens every window and ends both dictionaries, so that each window has one match already and
#: the first toxic match does not have to pay for the match section of its block.
_OPENING = bytes([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17])
_GAINS = 9  # gains 0 (and less) to 8 (and more)
_NORMAL = bytes.maketrans(
    bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     "
)


@dataclass(frozen=True)
class Bounds:
    """How much labelled text is learned from: rows and bytes of each class, whole texts only.

    Bounded besides, by constants: of the sample's ordinary windows about 60,000 evenly spaced ones train; a word
    beginning must recur in 4 % of the toxic texts, three at least; the dictionaries hold 1,800 bytes of
    toxic and 2,400 and 4,000 bytes of ordinary content.
    """

    rows: int = 2_000
    text_bytes: int = 8_000_000


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()
    prior: float = 0.0


def normal(text: str) -> bytes:
    return b" " + text.encode().translate(_NORMAL) + b" "


def windows(data: bytes) -> list[bytes]:
    """Runs of whole words of about ``_WINDOW`` bytes; longer words are cut."""
    raw = np.frombuffer(data, np.uint8)
    blanks = np.flatnonzero(raw == 32)
    marks = np.arange(_WINDOW, len(raw) - 1, _WINDOW)
    ends = blanks[np.minimum(np.searchsorted(blanks, marks), len(blanks) - 1)]
    ends = np.where(ends - marks > _LONGEST - _WINDOW, marks, ends)
    ends = np.unique(np.append(ends, len(raw) - 1))
    starts = np.append(0, ends[:-1])
    return [_OPENING + data[a : b + 1] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Compressors:
    def __init__(self, model: Model):
        def made(content: bytes) -> zstandard.ZstdCompressor:
            settings = zstandard.ZstdCompressionParameters.from_level(
                5,
                source_size=64,
                dict_size=len(content),
                min_match=6,
                write_checksum=0,
                write_content_size=0,
                write_dict_id=0,
            )
            shared = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            shared.precompute_compress(compression_params=settings)
            return zstandard.ZstdCompressor(compression_params=settings, dict_data=shared)

        self._ordinary = made(model.ordinary + _OPENING).compress
        self._toxic = made(model.toxic + model.ordinary + _OPENING).compress

    def gain(self, window: bytes) -> int:
        return len(self._ordinary(window)) - len(self._toxic(window))

    def gains(self, text: str) -> np.ndarray:
        """How many windows have each gain."""
        found = [self.gain(w) for w in windows(normal(text))]
        return np.bincount(np.clip(found, 0, _GAINS - 1), minlength=_GAINS)


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; the samples themselves if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _openings(word: bytes) -> list[bytes]:
    """A word's beginnings of 4 to 8 bytes, and the word itself."""
    return [b" " + word[:n] for n in range(4, min(9, len(word)))] + [b" " + word + b" "]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    bad, plain = [normal(t) for t in dict.fromkeys(toxic)], [normal(t) for t in ordinary]
    in_bad, in_plain = Counter(), Counter()
    for texts, seen in ((bad, in_bad), (plain, in_plain)):
        for text in texts:
            seen.update({o for w in set(text.split()) for o in _openings(w)})
    # word beginnings that recur in toxic texts and are at least five times as common there
    least, rate = max(3, len(toxic) // 25), 5 * len(toxic) / len(ordinary)
    marks = {o for o, n in in_bad.items() if n >= least and n >= rate * (in_plain[o] + 0.5)}

    def marked(text: bytes) -> list[bytes]:
        """The longest mark of each word that has one."""
        found = (next((o for o in reversed(_openings(w)) if o in marks), b"") for w in text.split())
        return [o for o in found if o]

    kept = [b"".join(found) for text in bad if (found := marked(text))]
    pieces = [w for b in plain for w in windows(b)]
    pieces = [w[len(_OPENING) :] for w in pieces[:: max(1, len(pieces) // 60_000)]]
    first = Model(_trained(pieces, 6_000)[-4_000:], _trained(kept, 2_000)[-1_800:] if kept else b"")
    # ordinary windows that chance matches shorten: what they hold is ordinary content as well
    tools = Compressors(first)
    hard = [w for w in pieces if tools.gain(_OPENING + w) >= 2 and not marked(w)]
    return Model(_trained(hard, 3_000)[-2_400:] + first.ordinary, first.toxic)


def _evidence(counts: np.ndarray) -> np.ndarray:
    """Per text: how many windows gain at least 1, 2, ... bytes, and how many there are (logs)."""
    tail = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    return np.log1p(np.column_stack([tail[:, 1:], tail[:, 0]]))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights (the last one constant) of a lightly held logistic fit, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    hold = np.full(len(w), 0.5)
    hold[-1] = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - hold * w
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(w.tolist())


def fit_texts(toxic: list[str], ordinary: list[str], labelled: tuple[int, int] | None = None) -> Model:
    """The model of two lists of texts, taken from ``labelled`` toxic and ordinary ones; fitting the
    same lists gives the same model."""
    bad, good = labelled or (len(toxic), len(ordinary))
    prior = bad / (bad + good) if bad + good else 0.0
    if not toxic or not ordinary:
        return Model(prior=prior)
    counts, y = [], []
    for half in (0, 1):  # gains of each half under dictionaries of the other
        tools = Compressors(_dictionaries(toxic[1 - half :: 2] or toxic, ordinary[1 - half :: 2] or ordinary))
        for label, texts in ((1, toxic[half::2]), (0, ordinary[half::2])):
            counts += [tools.gains(t) for t in texts]
            y += [label] * len(texts)
    counts, y = np.array(counts, dtype=float), np.array(y, dtype=float)
    both = _dictionaries(toxic, ordinary)
    *weights, constant = _logistic(_evidence(counts), y)
    constant += math.log(bad / good) - math.log(len(toxic) / len(ordinary))
    return Model(both.ordinary, both.toxic, (*weights, constant), prior)


def probability(model: Model, counts: np.ndarray) -> np.ndarray:
    weights = np.array(model.weights)
    return 1 / (1 + np.exp(-(_evidence(counts) @ weights[:-1] + weights[-1])))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    bounds: Bounds = Bounds(),
) -> Model:
    """Learn from a bounded sample: of each class the ids that come first in hash order. Runs jobs."""
    ids = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    order = [F.xxhash64("id"), F.col("id")]
    chosen = ids.where("label = 1").orderBy(*order).limit(bounds.rows).unionAll(
        ids.where("label = 0").orderBy(*order).limit(bounds.rows)
    )
    texts = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # at most two times bounds.rows ids
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
    )
    sizes = texts.select("id", "label", F.octet_length("text").alias("size"), order[0].alias("at")).collect()
    within: dict[int, list] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for row in sorted(sizes, key=lambda r: (r["at"], r["id"])):
        if held[row["label"]] + row["size"] <= bounds.text_bytes:
            held[row["label"]] += row["size"]
            within[row["label"]].append(row["id"])
    # one row: all labelled ids that have a document, whether they are in the sample or not
    known = ids.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    whole = known.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary")).first()
    wanted = within[0] + within[1]
    found = {r["id"]: r["text"] for r in texts.where(F.col("id").isin(wanted)).collect()} if wanted else {}
    return fit_texts(
        [found[i] for i in within[1]], [found[i] for i in within[0]], (whole["toxic"], whole["ordinary"])
    )


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability, from 0 to 1, that a text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(model) if model.weights else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if tools is None:
                scores = np.full(len(texts), model.prior)
            else:
                counts = np.array(
                    [tools.gains(t) if t else np.zeros(_GAINS) for t in texts.to_pylist()]
                ).reshape(-1, _GAINS)
                scores = probability(model, counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], score_col],
            )

    rest = docs.drop(score_col)
    (work,) = fresh(rest, "work")
    schema = StructType([*rest.schema.fields, StructField(score_col, DoubleType())])
    return rest.withColumn(work, text_of(text_col)).mapInArrow(tidied(run), schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of an id's text modulo ``folds``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % folds).cast("int")
