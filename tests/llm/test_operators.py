"""Operators against brute force, exact round trips, held-out rows and odd rows."""

import gzip
import hashlib
import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, language, license, linededup, media, mixing, neighbours, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "word"), (4, "word"), (None, "x y z"), (5, "long " * 60000)]


@pytest.fixture(scope="module")
def odd(spark):
    names = "key_d key_t parts lines exact near links hash range leaf p_toxic found spans score lang_pred media detected".split()
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], SCHEMA).select("*", *(F.lit(7).alias(n) for n in names))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_join_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    lines = set()
    for _ in range(40):
        line = "".join(rng.choice(list("abc d"), 25))
        lines.add(line)
        for _ in range(3):
            chars = list(line)
            for _ in range(rng.integers(1, k + 2)):
                at, what = rng.integers(len(chars)), rng.integers(3)
                chars[at : at + (what != 0)] = [] if what == 1 else [rng.choice(list("abcé"))]
            lines.add("".join(chars))
    ids = sorted(lines)
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(ids)], "id long, line string")
    got = {(r.a, r.b) for r in linededup.edit_candidates(frame, k).collect() if levenshtein(ids[r.a], ids[r.b]) <= k}
    assert got == {(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if levenshtein(ids[i], ids[j]) <= k}


def test_lines_drop_once(spark, odd):
    a, b = "This line is long enough to count.", "Another line that is also long enough."
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"short\n{a[:-1]}!\n{b}"), (3, b), (3, b), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.exact, r.near, r.links) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0, 0, 1), 2: ("", 2, 1, 1), 3: ("", 1, 0, 0), 4: (None, 0, 0, 0)}
    found = linededup.dedup_lines(odd)
    assert found.count() == len(ODD) and linededup.dedup_lines(odd.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in found.collect()} == dict(ODD)


def test_mixing_moves_shortages_to_siblings_first(spark):
    rows = [("a", "x", "p", 10), ("a", "x", "q", 100), ("a", "y", "r", 100), ("b", "x", "s", 200)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, {}, 160 / 410, 1).collect()}
    assert got == {"p": 10, "q": 30, "r": 40, "s": 80}
    got = {r.source: r.budget for r in mixing.budgets(leaves, {"domain": {"a": 3}}, 400 / 410, 1).collect()}
    assert sum(got.values()) == 400 and got["p"] == 10 and got["q"] == 100 and got["r"] == 100 and got["s"] == 190


def test_mixing_takes_prefixes_of_epochs(spark, odd):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "s", 1) for i in range(20)], SCHEMA).withColumn("domain", F.lit("d"))
    taken, _ = mixing.mix_sources(docs, {}, 1.525, 2)
    rows = taken.collect()
    assert sum(r.taken for r in rows) == 305 and sorted(r.taken for r in rows) == [10] * 9 + [15] + [20] * 10
    wide = odd.withColumn("domain", F.lit("d"))
    taken, leaves = mixing.mix_sources(wide, {}, 1.0, 1)
    assert sum(r.taken for r in taken.collect()) == 5 + 60000 and mixing.whole_documents(wide, leaves).count() == 4
    assert mixing.mix_sources(wide.limit(0), {}, 0.5, 1)[0].count() == 0


def test_language_of_held_out_rows_and_spans(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = language.fit(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 800 and text not like '%|%' and text not like '%!!%'").select("lang", F.substring("text", 1, 400).alias("text")).collect()}
    mixed = spark.createDataFrame([(1, texts["en"] + " " + texts["de"])], "doc_id long, text string")
    spans = [s.language for s in language.predict(mixed, model).first().spans if s.letters > 60]
    assert spans[0] == "en" and spans[-1] == "de"
    found = {r.doc_id: r.lang_pred for r in language.predict(odd.select("doc_id", "text"), model).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[5] in model.languages
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("кот и собака", "ru"), ("猫と犬", "ja")] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "зебра zebra"), (2, "слон"), (3, "犬"), (4, "אבג")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got[2] == "ru" and got[3] == "ja" and got[4] in model.languages


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(4)
    scores = rng.normal(0, 2, (13, 3)).astype(np.float32)
    first, count = np.array([0, 6, 13, 6]), np.array([6, 7, 0, 0])
    labels = language.best_paths(scores, first[:2], count[:2], 1.5)
    for f, n in ((0, 6), (6, 7)):
        value = lambda p: sum(scores[f + i, x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert value(labels[f : f + n]) == pytest.approx(max(map(value, product(range(3), repeat=n))), abs=1e-4)


def test_toxicity_on_held_out_rows(spark, sf, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels.where("doc_id % 3 > 0")).join(labels, "doc_id").where("doc_id % 3 = 0 and lang = 'en'").collect()
    wrong = [r.doc_id for r in got if r.rejected and not r.toxic]
    assert len(wrong) <= 2 and sum(r.rejected for r in got if r.toxic) >= 0.6 * sum(r.toxic for r in got)
    empty = labels.limit(0)
    found = toxicity.score(odd, empty).collect()
    assert len(found) == len(ODD) and not any(r.rejected for r in found) and toxicity.score(odd.limit(0), labels).count() == 0


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (1500, 8)).round(3)
    points[200:400] = points[200]
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(9000, None), (9100, []), (9200, [0.0] * 8), (9300, [float("nan")] * 8), (9400, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as leaf", "2 as score")
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, fit_rows=800).toPandas()
    hits = 0
    for q in range(0, 1500, 100):
        gaps = np.sqrt(((points - points[q]) ** 2).sum(1))
        gaps[q] = np.inf
        exact = np.lexsort((np.arange(1500), gaps))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, np.sqrt(((points[own.vec_id] - points[q]) ** 2).sum(1)))
        hits += len(set(exact) & set(own.vec_id))
    assert hits >= 0.9 * 150 and set(got.query_id) == set(range(0, 1500, 100))
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(frame.limit(3), F.lit(True)).count() == 6  # fewer candidates than k


def test_page_text():
    page = """<html><head><title>t</title></head><body><header><p>The top of the site and all of the menus</p></header><nav><a href=x>Home</a></nav>
    <article><h1>Short title</h1><p>The first block of the article is &amp; was\n  long enough to be one of the good ones.<p>Tiny.<script>x()</script>
    <aside>By the way, this is not a part of the article at all.</aside><div class="ad">Buy the best of the best now</div><p>Last one, <b>in the</b> middle of the page.</p></article>
    <div id="comments"><p>I think that this is the best of all and the worst of the most.</p></div><footer>&copy; someone</footer></body>"""
    assert html.main_text(page)[0] == "Short title\nThe first block of the article is & was long enough to be one of the good ones.\nTiny.\nLast one, in the middle of the page."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ("", 0)
    assert html.main_text("plain words of the page")[0] == "plain words of the page"


def test_every_page_equals_its_article(spark, sf):
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", inner))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_licenses():
    full = license.TEMPLATES["mit"].replace("hereby", "now")
    text = f"some words {full} more words. Released under the MIT License. And license plates."
    got = license.scan(text)
    assert [(name, text[a:b][:8]) for name, _, a, b in got] == [("mit", "Permissi"), ("mit-notice", "Released")] and got[0][1] > 0.98
    assert license.scan("a license to drive") == license.scan("") == []
    assert license.align("a x b y c".split(), "a b c".split()) == [(0, 0), (2, 1), (4, 2)]


def test_license_rows(spark, odd):
    rows = [(1, "Licensed under CC BY-NC 4.0.\n" * 3), (2, None), (2, "Released under the MIT License."), (None, "Released under the MIT License.")]
    got = license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "cc-by-nc-4.0-notice")] * 3 + [("2", "mit-notice"), ("None", "mit-notice")]
    assert license.licenses(odd).count() == 0


def test_media_round_trip(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in media.features(media.sniff_column(media.store_texts(docs))).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert json.loads(x.feature)["intact"] and x.media_bytes > x.payload_bytes
    rows = media.features(media.sniff_column(media.store_texts(odd))).collect()
    assert len(rows) == len(ODD) and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {576}


def test_embedded_media_are_carved():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b" * 100)
    packed = gzip.compress(b"hello" * 100)
    data = b"RIFF BM junk" + packed + b"\x89PNG\r\n\x1a\nbroken" + box.getvalue() + packed[:9]
    assert [(m.kind, m.start, m.length) for m in media.sniff(data)] == [("application/gzip", 12, len(packed)), ("application/zip", 12 + len(packed) + 14, len(box.getvalue()))]
    assert media.sniff(b"") == []
