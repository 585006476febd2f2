"""Page text without articles, broken markup, odd rows, and the second pass against its definition."""

import itertools

import pytest

from tidemark.llm import html

GOOD = "The text of the page is here and it is the one that we want to keep for all of us."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>t</title><body><p>{GOOD}", GOOD),
        (f"<head><title>never closed<body><p>{GOOD}</p>", GOOD),
        (f"<body><script>var s='<!--'</script><p>{GOOD}</p><p>{GOOD}</p>", f"{GOOD}\n{GOOD}"),
        (f"<script>x<p>{GOOD}</p>", GOOD),
        (f'<div class="page side"><p>{GOOD}</p></div>', GOOD),
        (f'<p>{GOOD}</p><div class="legal"><p>{GOOD}</p></div>', GOOD),
        (f"<article><p>{GOOD}</p><p>Tiny.</p><div><a href=x>Share</a> <a href=y>Print</a></div><p>Share this now</p><div><a href=x>Next</a></div><p>{GOOD}</p></article>", f"{GOOD}\nTiny.\n{GOOD}"),
        (f"<h2>A heading</h2><p>{GOOD}</p><ul><li><a href=x>Home</a></li></ul><p>Short end</p>", f"A heading\n{GOOD}"),
        ("<article><p>Tags: a b</p></article>", "Tags: a b"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page)[0] == text


def test_second_pass_takes_the_nearest_decided_label():
    block = html.Block("x", 0, False, False, False, False)
    for labels in itertools.product(["good", "bad", "open"], repeat=6):
        found = html.second_pass([block] * 6, list(labels))
        decided = [i for i, x in enumerate(labels) if x != "open"]
        for i, label in enumerate(labels):
            nearest = [labels[j] for j in decided if abs(i - j) == min(abs(i - k) for k in decided)]
            expected = "good" in nearest if "good" in labels else not decided
            assert found[i] == (label == "good" if label != "open" else expected), labels


def test_odd_page_rows(spark):
    long = f"<body>{'<script>x' * 20000}" + f"<p>{GOOD}</p>" * 20000
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "v", f"<p>{GOOD}", 1), (3, "w", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text if len(r.text) < 1000 else len(r.text)) for r in html.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (1, ""), (2, ""), (None, GOOD), (3, 20000 * (len(GOOD) + 1) - 1)], key=str)
    assert html.extract(pages.limit(0)).count() == 0
