"""Token alignment, language identification and collocations against brute force, and on awkward tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import collocations, language_id, token_alignment
from orderloom.llm.queries import QUERIES, vocabulary
from tests.llm.helpers import LONG, awkward, empty

SF = "/root/testdata/sf0.001"
A, B = vocabulary(), vocabulary("piece_bpe_32k.model")


# -- token alignment ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tool():
    return token_alignment.aligner(A, B)


def by_hand(tool, text):
    """Tokens of both, groups and links of one text, encoded whole."""
    nothing = (0, 0, 0, "", [])
    if not text:
        return nothing
    whole = (" " + text).encode()
    a = tool._a.encode(" " + text, add_special_tokens=False).ids
    b = tool._b.encode(text)
    if b"".join(tool.bytes_a[i] for i in a) != whole or b"".join(tool.bytes_b[i] for i in b) != whole:
        return nothing
    ends_a = np.cumsum([len(tool.bytes_a[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(tool.bytes_b[i]) for i in b]).tolist()
    shown, links, at_a, at_b = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        shown.append(",".join(map(str, a[at_a:x])) + "|" + ",".join(map(str, b[at_b:y])))
        links.append((a[x - 1], b[y - 1]))
        at_a, at_b = x, y
    return len(a), len(b), len(links), ";".join(shown), links


ODD = [
    "a", "the", "é", "漢", " ", "  ", " ", "\n", "\t", "\r", " ", "　", "▁", "<|endoftext|>", "<s>",
    "<0x41>", "'s", "'ll", "23", ".", "!!", "😀", "​", "\x00", "\x1c", "\x85", "ing", "é", "한", " The", "﻿",
]


def odd_texts(n, most=14):
    draw = random.Random(5)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_units_align_like_whole_texts(tool):
    texts = [*odd_texts(6000), " ", "  ", "a ", " a", "▁"]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        found = tool.align(part)
        for row, text in enumerate(part):
            n_a, n_b, n_groups, shown, links = by_hand(tool, text)
            assert (found.n_a[row], found.n_b[row], found.n_groups[row], found.shown[row]) == (n_a, n_b, n_groups, shown)
            got = Counter()
            for k, (offsets, ids, times) in enumerate((found.same, found.pairs)):
                span = slice(offsets[row], offsets[row + 1])
                for one, n in zip(ids[span].tolist(), times[span].tolist(), strict=True):
                    got[(one >> 32, one & 0xFFFFFFFF) if k else (one, int(tool.same[one]))] += n
            assert got == Counter(links)


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_counts_over_all_rows(spark, tool, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("orderloom.llm.common.BROADCAST_ROWS", 0)
        monkeypatch.setattr(token_alignment, "checked", lambda df, label: df)
    texts = [*odd_texts(300, 40), None, "", LONG, "twice the same", "twice the same"]
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, pairs int").repartition(7)
    got = {r.doc_id: r for r in token_alignment.align(docs, A, B).collect()}
    brute = [by_hand(tool, t) for t in texts]
    counts = Counter(link for *_, links in brute for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert len(got) == len(rows)
    for i, (n_a, n_b, n_groups, shown, links) in enumerate(brute):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (n_a, n_b, n_groups, len(links), shown)
        assert r.count_sum == sum(counts[k] for k in links)
        assert r.n_best == sum(counts[k] == most[k[1]] for k in links)
        assert (r.key, r.pairs) == ("kept", 7)


def test_alignment_of_awkward_tables(spark):
    got = token_alignment.align(awkward(spark), A, B)
    assert got.count() == awkward(spark).count()
    zero = got.where("text IS NULL OR text = ''").select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert set(map(tuple, zero.collect())) == {(0, 0, 0, 0, 0, 0, "")}
    assert token_alignment.align(empty(spark), A, B).count() == 0
    clash = awkward(spark).withColumn("n_a", F.lit("x")).withColumn("groups", F.lit("y"))
    assert dict(token_alignment.align(clash, A, B).dtypes)["n_a"] == "bigint"


def test_alignment_query_keeps_the_contract(spark):
    got = QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert got.where("n_links <> n_groups OR n_best > n_links OR length(groups_sha256) NOT IN (0, 64)").count() == 0


# -- language identification ----------------------------------------------------------------


def plain_features(text):
    """Counts of all runs of one to four characters, spelled out."""
    points = "".join(map(chr, language_id.letters(text).tolist()))
    return Counter(points[i : i + n] for n in range(1, 5) for i in range(len(points) - n + 1))


@pytest.mark.parametrize("step", [7, 1_000_000])
def test_features_are_hashed_counts(monkeypatch, step):
    monkeypatch.setattr(language_id, "_SLICE", step)
    text = "Ärger,  im 3. Hauś — naïve 漢字!"
    assert "".join(map(chr, language_id.letters(text).tolist())) == " ärger im hauś naïve 漢字 "
    places, values = language_id.features(language_id.letters(text))
    total = sum(plain_features(text).values())
    want = np.zeros(1 << language_id._BITS)
    for run, n in plain_features(text).items():
        mixed = 0
        for c in run:
            mixed = (mixed + ord(c)) * 0x9E3779B1 % (1 << 32)
        want[(mixed ^ mixed >> 15) >> (32 - language_id._BITS)] += n
    assert np.array_equal(np.flatnonzero(want), places)
    assert np.allclose(values, want[places] / np.sqrt(total))


def test_a_machine_separates_with_the_largest_margin():
    rows = [(np.array([0, 1]), np.array(v, np.float32)) for v in ((3, 1), (4, 2), (1, 3), (2, 4))]
    weights, constant = language_id._machine(rows, np.array([1.0, 1.0, -1.0, -1.0]), rounds=500)
    # by hand: the border is x = y, the nearest points lie at a margin of 1
    assert np.allclose(weights[:2], [0.5, -0.5], atol=0.02) and abs(constant) < 0.02


def test_family_comes_first():
    words = {"de": "und der straße", "nl": "het een straat", "fr": "les rues était", "xx-1": "zzq qqz zqz"}
    texts = [(lang, " ".join(word * (1 + i % 3) for word in base.split())) for lang, base in words.items() for i in range(20)]
    model = language_id.fit_texts(texts)
    assert sorted(model.families) == [("de", "nl"), ("fr",), ("xx-1",)]
    assert all(language_id.predict(model, base)[0] == lang for lang, base in words.items())
    assert language_id.predict(model, "und der straße") == language_id.predict(model, "UND der STRASSE".replace("SS", "ß"))
    assert language_id.predict(model, "1234 !?") == ("und", 0.0)


def test_language_held_out(spark):
    rows = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_of_awkward_tables(spark):
    docs = awkward(spark)
    model = language_id.fit(docs)
    got = language_id.identify(docs, model)
    assert got.count() == docs.count() and got.columns == [*docs.columns, "lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in got.where("text IS NULL OR text rlike '^\\\\s*$'").collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in got.where("text rlike '[a-z]'").collect()} <= {"en", "de"}
    nothing = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0
    one = language_id.fit(docs.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs.where("doc_id = 1"), one).collect()} == {("de", 1.0)}
    clash = docs.withColumn("SCORE", F.lit("x"))
    assert dict(language_id.identify(clash, model).dtypes)["score"] == "double"


def test_language_bounds_cut_the_sample_only(spark):
    rows = [(i, ["de", "en"][i % 2], ["der die das und", "the and of with"][i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    small = language_id.Bounds(languages=1, rows=5, text_bytes=40)
    assert language_id.fit(docs, bounds=small).families == (("de",),)
    model = language_id.fit(docs, bounds=language_id.Bounds(rows=5))
    assert model == model and model.families == (("de", "en"),)
    assert language_id.identify(docs, model).where("lang_pred = lang").count() == 200


# -- collocations ---------------------------------------------------------------------------


def all_collocations(rows, support, first, inside=(80, 100)):
    """Rows of (lang, text), counted phrase by phrase."""
    found, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().lower()
        for c in b".,;:!?\n\x0b\x0c\r":
            data = data.replace(bytes([c]), b".")
        for piece in data.replace(b"\t", b" ").split(b"."):
            words = [w for w in piece.split(b" ") if w]
            total[lang] += len(words)
            for size in range(1, 5):
                found[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in found.items():
        often = {p: n for p, n in counts.items() if n >= support}
        kept = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(inside[1] * often[q] >= inside[0] * a for q in longer):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, b" ".join(p), left, right))
        out += [
            (lang, rank, name.decode(), -a, left, right, total[lang], -score)
            for rank, (score, a, name, left, right) in enumerate(sorted(kept)[:first], 1)
        ]
    return sorted(out)


def phrase_rows(n):
    draw = random.Random(3)
    pool = ["New", "york", "the", "of", "é", "漢字", "x y", "A", "a"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " "]
    rows = [
        (draw.choice(["en", "de", None, "und"]), "".join(draw.choice(pool) + draw.choice(ends) for _ in range(draw.randint(0, 60))))
        for _ in range(n)
    ]
    return [*rows, ("en", None), ("en", ""), *[("en", "hot copy of text")] * n]


@pytest.mark.parametrize(("support", "shard", "chunk", "bits"), [(30, 40_000_000, 3_000_000, 26), (5, 300, 50, 26), (4, 2_000, 200, 8)])
def test_collocations_equal_brute_force(spark, monkeypatch, support, shard, chunk, bits):
    """Also with so many shards that one local find is enough, and with bits that many phrases share."""
    for name, value in (("_SHARD_BYTES", shard), ("_CHUNK_WORDS", chunk), ("_BITS", bits)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows(150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations.collocations(docs, support=support, first=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, got.collect())) == all_collocations(rows, support, 40)


def test_shards_bound_every_count():
    """Sums over the shards that name a phrase, and one less than the local support for the others, are never too low."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(1, 9))) for _ in range(60)]

    def found(texts, support):
        words = collocations.Words("en")
        for t in texts:
            words.add(t)
        return {h: n for hs, ns in collocations.mined(words, support, 4) for h, n in zip(hs.tolist(), ns.tolist(), strict=True)}

    exact = found(texts, 1)
    assert len(exact) == len({p for t in texts for w in [t.split()] for k in range(1, 5) for p in zip(*(w[i:] for i in range(k)))})
    for shards in (2, 7, 12, 30):
        local = -(-12 // shards)
        parts = [found(texts[k::shards], local) for k in range(shards)]
        for phrase, n in exact.items():
            bound = sum(part.get(phrase, local - 1) for part in parts)
            assert n <= bound and (n < 12 or any(phrase in part for part in parts))
            assert local > 1 or bound == n


def test_collocations_of_awkward_tables(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    nothing = spark.createDataFrame([("en", None), ("en", " ..")], "lang string, text string")
    assert collocations.collocations(nothing).count() == 0
    rows = [(r.lang, r.text) for r in awkward(spark).select("lang", "text").collect()]
    got = collocations.collocations(awkward(spark), support=2)
    assert sorted(map(tuple, got.collect())) == all_collocations(rows, 2, 2000)
