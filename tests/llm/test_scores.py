"""Resampling, vector codes and quality rules against brute force and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import codes, quality, resample

LONG = "wörter andé 123 " * 3000
TEXTS = [(1, None), (2, ""), (3, "  \n"), (4, "a b c " * 10), (4, "a b c " * 10), (None, "x Y z " * 9), (None, "x Y z " * 9), (5, LONG), (6, "abc" * 200_000), (7, "-- !! ")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    more = [(100 + i, " ".join(rng.choice("the of to alpha Beta gamma ÄÖ 42 don't".split(), rng.integers(1, 60)))) for i in range(300)]
    names = "segment rank k_id x lists hashes known word n stands_for bucket at".split()
    return spark.createDataFrame([(i, t, *[3] * len(names)) for i, t in TEXTS + more], ", ".join(["doc_id long, text string", *(f"{n} int" for n in names)]))


def features(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_resampling_equals_brute_force(spark, docs):
    target = ["the alpha of", "gamma gamma 42", None]
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    rows = [(r.doc_id, features(r.text)) for r in docs.collect()]
    s, t = Counter(bucket(w) for _, x in rows for w in x), Counter(bucket(w) for x in target for w in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    expected = []
    for doc_id, words in rows:
        weight = sum(gain(bucket(w)) for w in words) // len(words) if words else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        expected.append([doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((x for x in expected if x[1] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = 10 * len(enough) // 100
    ranks = Counter((*x, n + 1) for n, x in enumerate(enough[:drawn])) + Counter((*x, None) for x in enough[drawn:]) + Counter((*x, None) for x in expected if x[1] < 20)
    got = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert Counter(map(tuple, got.collect())) == ranks and drawn > 5


def test_one_key_of_most_rows_is_dealt_to_many_segments(spark):
    rows = spark.range(4000, numPartitions=7).selectExpr("cast(null as long) as doc_id", "30L as n_features", "5L as weight", "if(id % 3 = 0, id, 77L) as score")
    scored = resample.saved(rows)
    keyed = resample._keyed(scored)
    cuts = resample.splitters(keyed, 10)
    sizes = [r["count"] for r in resample.with_segments(keyed, cuts).groupBy("segment").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 4000 / 10
    got = sorted((r["rank"], -r.score) for r in resample.ranked(scored, 3999, 10).collect() if r["rank"])
    assert [r for r, _ in got] == list(range(1, 4000)) and [s for _, s in got] == sorted(s for _, s in got)


def test_resampling_without_rows_or_target(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    some = spark.createDataFrame([(i, "word " * 30) for i in range(30)], "doc_id long, text string")
    assert sorted(r["rank"] for r in resample.resample(some, none).collect() if r["rank"]) == [1, 2, 3]


def crc_texts(texts):
    return [b for t in resample.buckets_of(texts) for b in zip(*map(list, t))]


def test_buckets_across_slabs(monkeypatch):
    texts = ["one two " * 50, None, "", "ÄÖÜ-x" * 20, "q" * 300 + " tail", "end"]
    whole = crc_texts(texts)
    assert whole == [(i, zlib.crc32(w.encode()) % 10000) for i, t in enumerate(texts) for w in features(t)]
    for size in (1, 7, 64):
        monkeypatch.setattr(resample, "SLAB", size)
        assert crc_texts(texts) == whole


def brute_codes(rows, rounds=2):
    """(code, error) by id of the rows (id, whole vector), and the books."""
    rows = sorted(rows)
    size = len(rows[0][1]) // 16
    parts = [[tuple(v[p * size : (p + 1) * size]) for _, v in rows] for p in range(16)]
    books = [list(x[:64]) for x in parts]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            held = defaultdict(list)
            for x in parts[p]:
                held[nearest(x, books[p])[1]].append(x)
            books[p] = [tuple(sum(c) // len(held[k]) for c in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])]
    found = [[nearest(parts[p][i], books[p]) for p in range(16)] for i in range(len(rows))]
    return [("".join(f"{k:02x}" for _, k in x), sum(d for d, _ in x)) for x in found], books


@pytest.mark.parametrize("n", [5, 200])
def test_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vectors = [[float(v) for v in rng.integers(-3, 4, 32) / 7] for _ in range(n)]
    rows = [(i, v, None if i % 3 else i % 2, 1) for i, v in enumerate(vectors)] + [(n, vectors[0], 1, 1), (n, vectors[0], 1, 1)]
    odd = [(900, None, 1, 1), (901, [], 1, 1), (902, [1.0] * 31 + [None], 1, 1), (903, [1.0] * 31 + [math.inf], 1, 1), (904, [math.nan] * 32, 1, 1), (905, [1.0] * 16, 1, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, to_pivots int")
    expected, books = brute_codes([(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows])
    got = codes.compress(frame).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(i, *x) for (i, *_), x in zip(rows, expected)]
    totals = Counter()
    for (_, _, label, _), (_, error) in zip(rows, expected):
        totals[label] += error
    label_of = {i: label for i, _, label, _ in rows}
    assert all(r.label_error == totals[label_of[r.vec_id]] for r in got)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_pruned_search_is_exact_on_ties():
    rng = np.random.default_rng(1)
    points, book = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (64, 3))
    pivots = codes.pivots_of(book[None])[0]
    entry, d = codes.assign(points, codes.distances(points, pivots), book, codes.distances(book, pivots))
    every = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (d == every.min(1)).all() and (entry == every.argmin(1)).all()


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    huge = codes.compress(spark.createDataFrame([(None, [3e38] * 16, None), (None, [-3e38] * 16, None), (1, [0.0] * 16, 2)], schema)).collect()
    assert [r.error for r in huge] == [0, 0, 0] and sorted(str(r.vec_id) for r in huge) == ["1", "None", "None"]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_equals_brute_force(spark, docs):
    text = "a b c\na b c\n\n a # b\x0bc | <x>\n \na b c"
    frame = docs.select("*").unionByName(spark.createDataFrame([(8, text), (9, "p q r s p q r s t p q")], "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "cast(null as string) as lang")
    got = quality.judge(frame).collect()
    rows = frame.collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r.doc_id, *base(r.text)) for r in rows), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)  # no document names a language, so there is no reference


def test_quality_keeps_what_looks_like_its_language(spark):
    rng = np.random.default_rng(3)
    noun = lambda: "".join(rng.choice(list("bdfgklmnprstaeiou"), rng.integers(3, 9)))
    prose = lambda n, common: " ".join(rng.choice(common) if rng.random() < 0.4 else noun() for _ in range(n))
    en, de = "the of and to in is that it for was".split(), "der die und in den von zu das mit sich".split()
    rows = [(i, prose(300, en if i % 2 else de), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200, rows[1][1].upper(), "en"), (201, " | ".join(noun() for _ in range(300)), "de"), (202, rows[3][1], None), (203, rows[3][1], "xx"), (204, " ".join(noun() + "$%" for _ in range(300)), None)]
    rows += [(300 + i, rows[5][1], "en") for i in range(200)]  # copies of one text move one group of its language only
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(120)) and all(got[i].kept for i in range(300, 500))
    assert [got[i].kept for i in range(200, 205)] == [False, False, True, True, False]
    assert len(got[202].judged) == 2 and len(got[1].judged) == 1


def test_divergence(spark):
    got = spark.createDataFrame([([1, 1, 0], [0, 1, 1]), ([2, 0, 0], [0, 0, 9]), ([1, 2, 3], [2, 4, 6]), ([0, 0, 0], [1, 1, 1])], "p array<long>, q array<long>")
    found = [r[0] for r in got.select(quality.divergence(got.p, got.q)).collect()]
    assert found[:3] == pytest.approx([0.5, 1.0, 0.0]) and found[3] is None


def test_quality_of_nothing(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
