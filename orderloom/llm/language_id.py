"""Language identification by hierarchical discrimination: the family first, then the language in it.

A text's features are its runs of one to four letters (lower case, marks kept, words set apart by blanks),
hashed to ``2**_BITS`` numbers and divided by the root of how many there are. Linear support vector
machines, one for each family against the rest, choose the family. Inside a family every pair of languages has a
machine of its own, and the language that wins by the sum of its pairs' log odds is predicted.
A machine is fitted by dual coordinate descent on a bounded sample (``Bounds``), on whole texts
and on short runs of their words, so that texts of one word are covered as well.

The family of a language is looked up by its code (``FAMILIES``, a parameter); a value that is not listed is a
family of its own, so any values of the language column can be learned.

Fitting takes a bounded sample to the driver; scoring is one scan of whole texts with that model.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated texts get the same
result; very long texts are read whole; ties go to the smaller language value. Rows with a null
language, id or text are not learned from; of several texts of one id and language the smallest is. With one language
learned, every text with a letter is that language, score 1; with none, all are ``und``. Other columns are kept,
but one called like a result is replaced by it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from orderloom.llm.common import fresh

_BITS, _LONGEST, _SLICE = 16, 4, 1_000_000
_SHORT_RUNS = (1, 2, 4, 8)
UNKNOWN = "und"

#: Language codes by family.
_MEMBERS = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
    "austronesian": "id jv mg ms su tl",
    "bantu": "rw sn sw xh zu",
}
FAMILIES: dict[str, str] = {code: name for name, codes in _MEMBERS.items() for code in codes.split()}


@dataclass(frozen=True)
class Bounds:
    """What is learned from: the most frequent ``languages`` values of the column, of each at most ``rows`` texts and
    ``text_bytes``, and ``all_bytes`` together. Whole texts, the first in the order of a hash of the id."""

    languages: int = 200
    rows: int = 600
    text_bytes: int = 2_500_000
    all_bytes: int = 40_000_000


@dataclass(frozen=True)
class Machines:
    """Weights (a column each) and constants of some linear machines."""

    weights: np.ndarray
    constants: np.ndarray

    def margins(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[places] + self.constants


@dataclass(frozen=True)
class Model:
    #: languages of each family, both in ascending order
    families: tuple[tuple[str, ...], ...] = ()
    choose: Machines | None = None
    pairs: tuple[Machines | None, ...] = ()
    sizes: Mapping[str, int] = field(default_factory=dict)


@cache
def _kinds() -> np.ndarray:
    """Per code point: 1 for letters, 2 for marks, 0 for all else."""
    first = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    return np.where(first == ord("L"), 1, np.where(first == ord("M"), 2, 0)).astype(np.uint8)


def letters(text: str) -> np.ndarray:
    """Code points of the words: letters and marks in lower case, one blank between words and at both ends.
    Empty if the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    if not (kinds == 1).any():
        return np.zeros(0, np.uint32)
    word = kinds > 0
    points = np.where(word, points, np.uint32(32))
    before = np.concatenate([[False], word[:-1]])
    points = points[word | before]
    return np.concatenate([[32], points, [32] if points[-1] != 32 else []]).astype(np.uint32)


def features(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features and their values."""
    counts = np.zeros(1 << _BITS, np.int64)
    for start in range(0, len(points), _SLICE):  # bounds memory; runs that begin in the slice
        part = points[start : start + _SLICE + _LONGEST - 1]
        own = min(_SLICE, len(part))
        mixed = np.zeros(len(part), np.uint32)
        for size in range(1, _LONGEST + 1):
            many = min(own, len(part) - size + 1)
            if many <= 0:
                break
            mixed[:many] = (mixed[:many] + part[size - 1 : size - 1 + many]) * np.uint32(0x9E3779B1)
            run = mixed[:many]
            counts += np.bincount((run ^ (run >> np.uint32(15))) >> np.uint32(32 - _BITS), minlength=1 << _BITS)
    places = np.flatnonzero(counts)
    found = counts[places]
    return places, (found / np.sqrt(found.sum())).astype(np.float32)


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear support vector machine with hinge loss, by dual coordinate descent; classes weigh alike."""
    weights, constant = np.zeros(1 << _BITS, np.float32), 0.0
    held = np.zeros(len(y))
    lengths = np.array([float(v @ v) + 1.0 for _, v in rows])
    most = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    draw = np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)).tolist():
            places, values = rows[i]
            slack = 1.0 - y[i] * (float(values @ weights[places]) + constant)
            new = min(max(held[i] + slack / lengths[i], 0.0), most[i])
            step = new - held[i]
            if step:
                held[i] = new
                weights[places] += np.float32(step * y[i]) * values
                constant += step * y[i]
                moved += abs(step)
        if moved < 1e-3 * len(y):
            break
    return weights, constant


def _machines(rows: list, targets: list[np.ndarray]) -> Machines:
    made = []
    for y in targets:
        used = np.flatnonzero(y).tolist()
        made.append(_machine([rows[i] for i in used], y[used]))
    return Machines(np.column_stack([w for w, _ in made]), np.array([c for _, c in made]))


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The whole text and short runs of its words, from evenly spaced places."""
    points = letters(text)
    if not len(points):
        return
    yield points
    blanks = np.flatnonzero(points == 32)
    words = len(blanks) - 1
    for k, size in enumerate(_SHORT_RUNS):
        if words > size:
            at = (words - size) * (k + 1) // (len(_SHORT_RUNS) + 1)
            yield points[blanks[at] : blanks[at + size] + 1]


def family_of(lang: str, families: Mapping[str, str]) -> str:
    """The family of a code, of its part before ``-`` or ``_``, or the value itself."""
    base = lang.lower().replace("_", "-").split("-")[0]
    return families.get(lang) or families.get(base) or lang


def fit_texts(texts: list[tuple[str, str]], families: Mapping[str, str] = FAMILIES) -> Model:
    """The model of (language, text) rows; the same rows give the same model."""
    rows, langs = [], []
    for lang, text in texts:
        for points in _pieces(text):
            rows.append(features(points))
            langs.append(lang)
    sizes = {lang: langs.count(lang) for lang in sorted(set(langs))}
    groups: dict[str, list[str]] = defaultdict(list)
    for lang in sizes:
        groups[family_of(lang, families)].append(lang)
    members = tuple(sorted(tuple(g) for g in groups.values()))
    tags = np.array(langs, dtype=object)
    choose = None
    if len(members) > 1:
        choose = _machines(rows, [np.where(np.isin(tags, list(group)), 1.0, -1.0) for group in members])
    pairs = []
    for group in members:
        targets = [
            np.where(tags == a, 1.0, np.where(tags == b, -1.0, 0.0))
            for i, a in enumerate(group)
            for b in group[i + 1 :]
        ]
        pairs.append(_machines(rows, targets) if targets else None)
    return Model(members, choose, tuple(pairs), sizes)


def _log_odds(margins: np.ndarray) -> np.ndarray:
    """log of 1 / (1 + exp(-2 m)), without overflow."""
    return -np.logaddexp(0.0, -2.0 * margins)


def predict(model: Model, text: str | None) -> tuple[str, float]:
    points = letters(text) if text else np.zeros(0, np.uint32)
    if not len(points) or not model.families:
        return UNKNOWN, 0.0
    places, values = features(points)

    def best(odds: np.ndarray) -> tuple[int, float]:
        share = np.exp(odds - odds.max())
        return int(odds.argmax()), float(share.max() / share.sum())

    at, score = 0, 1.0
    if model.choose is not None:
        at, score = best(_log_odds(model.choose.margins(places, values)))
    group, machines = model.families[at], model.pairs[at]
    if machines is None:
        return group[0], score
    margins = machines.margins(places, values)
    odds = np.zeros(len(group))
    pair = 0
    for i in range(len(group)):
        for j in range(i + 1, len(group)):
            odds[i] += _log_odds(margins[pair])
            odds[j] += _log_odds(-margins[pair])
            pair += 1
    winner, share = best(odds)
    return group[winner], score * share


def fit(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    families: Mapping[str, str] = FAMILIES,
    bounds: Bounds = Bounds(),
) -> Model:
    """Learn from a bounded sample of the rows of ``docs``. Runs jobs."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(bounds.languages).collect()
    known = [r["lang"] for r in common]
    if not known:
        return Model()
    per_language = min(bounds.text_bytes, bounds.all_bytes // len(known))
    order = Window.partitionBy("lang").orderBy("at", "id", "size")
    narrow = rows.where(F.col("lang").isin(known)).select(
        "id", "lang", F.octet_length("text").cast("long").alias("size"), F.xxhash64("id", "lang").alias("at")
    )
    chosen = (
        narrow.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= bounds.rows)
        .withColumn("held", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("held") <= per_language)
        .select("id", "lang")
        .distinct()
    )
    # at most bounds.rows ids of bounds.languages languages
    texts = (
        rows.join(F.broadcast(chosen), ["id", "lang"])
        .groupBy("id", "lang")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    texts.sort(key=lambda r: (r["lang"], r["id"]))
    return fit_texts([(r["lang"], r["text"]) for r in texts], families)


def identify(
    docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """Add the predicted language and its score to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                found = [predict(known, t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([lang for lang, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    names=[*part.schema.names[:-1], lang_col, score_col],
                )

    (work,) = fresh(docs, "work")
    given = docs.withColumn(work, F.col(text_col).cast("string")).drop(lang_col, score_col)
    added = [StructField(lang_col, StringType()), StructField(score_col, DoubleType())]
    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], *added]))
