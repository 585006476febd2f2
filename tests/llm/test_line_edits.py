"""The edits that line dedup allows grow with the length of a line."""

import numpy as np

from test_operators import levenshtein
from tidemark.llm import linededup


def allowed(a, b):
    n = min(len(a), len(b))
    return max(1, min(n // 30, int(np.cbrt(n + 0.5))))


def lines_of_many_lengths():
    rng = np.random.default_rng(11)
    lines = set()
    for n in (20, 29, 59, 60, 61, 89, 91, 120, 151, 180, 216):
        line = "".join(rng.choice(list("abcde fgh"), n))
        lines.add(line)
        most = allowed(line, line)
        for wanted in (1, most - 1, most, most, most + 1, most + 2):
            chars = list(line)
            for _ in range(wanted):
                at, what = rng.integers(len(chars)), rng.integers(3)
                chars[at : at + (what != 0)] = [] if what == 1 else [rng.choice(list("xyzé"))]
            lines.add("".join(chars))
    return sorted(x for x in lines if len(x) >= linededup.MIN_CHARS)


def test_edit_join_by_length_equals_brute_force(spark):
    lines = lines_of_many_lengths()
    near = lambda i, j: abs(len(lines[i]) - len(lines[j])) <= 9 and levenshtein(lines[i], lines[j]) <= allowed(lines[i], lines[j])
    expected = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if near(i, j)}
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {(r.a, r.b) for r in linededup.edit_candidates(frame).collect()}
    assert {(i, j) for i, j in got if near(i, j)} == expected and len(expected) > 40
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    links = {r.doc_id: r.links for r in linededup.dedup_lines(docs).collect()}
    assert links == {i: sum(i in pair for pair in expected) for i in range(len(lines))}


def test_a_changed_word_is_near(spark):
    line = "It was nterti who came " + "to the house and stayed there for a long time, " * 3
    docs = spark.createDataFrame([(1, line), (2, line.replace("nterti", "the")), (3, line[:60] + "another end of it")], "doc_id long, text string")
    assert {r.doc_id: r.near for r in linededup.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_lines_without_their_equal_ends_have_as_many_edits(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ab é漢"), 300))
    lines = [base, base + "x", "x" + base, base[:150] + base[151:], base[:40] + "xy" + base[41:260] + "z" + base[260:], "a" * 30, "a" * 31, "a" * 33, "b" + "a" * 31, base[::-1], "ab", ""]
    pairs = [(a, b, k) for i, a in enumerate(lines) for b in lines[i + 1 :] for k in (0, 1, 2, 5)]
    frame = spark.createDataFrame(pairs, "line_a string, line_b string, allowed int")
    got = {tuple(r) for r in linededup.within(frame).collect()}
    assert got == {(a, b, k) for a, b, k in pairs if levenshtein(a, b) <= k} and got


def test_near_copies_that_differ_in_many_letters_are_no_candidates(spark):
    start, end = "the one line that all of them begin with, and its second part; ", " so it ends for all of them in the same way as well"
    lines = [(n, start + letter * 5 + end) for n, letter in enumerate("trosl")]
    assert linededup.edit_candidates(spark.createDataFrame(lines, "id long, line string")).count() == 0
