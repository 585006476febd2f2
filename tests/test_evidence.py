"""Interval joins, page chains and histories of renders against plain Python."""

import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evidence, intervals

START = dt.datetime(2020, 1, 1)


def at(hours):
    return None if hours is None else START + dt.timedelta(hours=int(hours))


def test_interval_join_equals_every_pair(spark):
    rng = np.random.default_rng(4)
    rows = [(i, a := int(rng.integers(9000)), a + int(rng.choice([0, 1, 5, 30, 5000]))) for i in range(150)]
    rows += [(200, None, 5), (201, 5, None), (202, 10, 5), (203, -2_000_000, 20_000), (204, 100, 100), (204, 100, 100)]
    windows = [(i, a := int(rng.integers(9000)), a + int(rng.choice([0, 2, 24, 700]))) for i in range(40)] + [(100, 50, 40), (101, None, 60), (102, 60, None), (103, 100, 101), (104, 99, 100)]
    frame = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in rows], "event long, low timestamp_ntz, high timestamp_ntz")
    held = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in windows], "window long, since timestamp_ntz, until timestamp_ntz")
    found = intervals.overlap_join(frame, held)
    expected = [(i, w) for i, a, b in rows for w, s, u in windows if None not in (a, b, s, u) and a <= b and s < u and a < u and b >= s]
    expected += [(200, None), (201, None)]
    key = lambda p: (p[0], p[1] is None, p[1] or 0)
    assert sorted(((r.event, r.window) for r in found.collect()), key=key) == sorted(expected, key=key)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_join(frame.limit(0), held).count() == 0


def test_chains_of_pages(spark):
    chains = {
        "whole": [("a", "b"), ("b", "c"), ("c", None)],
        "circle": [("a", "b"), ("b", "c"), ("c", "b")],
        "itself": [("a", "a")],
        "gap": [("a", "b"), ("b", "z"), ("y", None)],
        "long": [(str(i), str(i + 1) if i < 8 else None) for i in range(9)],
        "aside": [("a", None), ("x", "y"), ("y", "x")],
    }
    rows = [(s, p, n, p == pairs[0][0]) for s, pairs in chains.items() for p, n in pairs] + [("none", "a", None, False)]
    got = {r.scope: (r.pages, r.reached, r.warnings) for r in evidence.page_chains(spark.createDataFrame(rows, "scope string, page string, next_page string, first boolean"), 5).collect()}
    assert got == {
        "whole": (3, 3, []), "circle": (3, None, ["PAGE_CURSOR_CYCLE"]), "itself": (1, None, ["PAGE_CURSOR_CYCLE"]), "gap": (3, 2, ["PAGE_MISSING", "PAGES_NOT_REACHED"]),
        "long": (9, 9, ["PAGE_CAP"]), "aside": (3, 1, ["PAGES_NOT_REACHED"]), "none": (1, 0, ["NO_FIRST_PAGE", "PAGES_NOT_REACHED"]),
    }


def test_descriptions_of_renders(spark):
    said = [(1, "a", "x", 5), (2, "a", "x", 9), (3, "a", "y", 6), (4, "a", "x", 1), (5, "b", "x", 3), (6, "c", "q", 3), (7, "a", "x", 9)]
    shown = [(10, "a", "x", 2), (11, "a", "x", 9), (12, "a", "y", 6), (13, "a", "x", 9), (14, "b", "x", 4), (15, "b", None, 8)]
    of = lambda rows, k, t: spark.createDataFrame(rows, f"{k} long, artifact string, content_hash string, {t} long")
    got = {r.description_key: (r.render_key, r.is_current) for r in evidence.visual_history(of(said, "description_key", "described_at"), of(shown, "render_key", "rendered_at")).collect()}
    assert got == {1: (10, False), 2: (13, False), 7: (13, True), 3: (12, False), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_points_are_looked_for_on_the_levels_of_spans_only(spark):
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval({n})")
    rows = spark.range(50).select("id", day("cast(id as int)").alias("low"), day("cast(id as int)").alias("high"))
    found = intervals._inside(rows, spark.range(1).select(day("8").alias("since"), day("9").alias("until")), "low", "since", "until")
    assert sorted(r.id for r in found.collect()) == [8, 9]
    looked = [int(n) for n in re.findall(r"transform\(cast\(array\(([0-9, ]+)\)", found._jdf.queryExecution().analyzed().toString()) for n in n.split(",")]
    assert looked == [0, 1] or looked == [1] or looked == [0]
    assert intervals.overlap_join(rows, spark.range(0).select(day("8").alias("since"), day("9").alias("until"))).count() == 0


def test_intervals_lie_in_two_blocks_at_most_however_long(spark, monkeypatch):
    """Before, rows of 40 days took eight places on the average."""
    placed = []
    monkeypatch.setattr(intervals, "_placed", lambda *args, real=intervals._placed: placed.append(real(*args)) or placed[-1])
    day = lambda n: F.expr(f"timestamp_ntz'1995-01-01' + make_dt_interval({n})")
    rows = spark.range(2000).select("id", day("cast(id as int)").alias("low"), day("cast(id + id % 700 + 4 as int)").alias("high"))
    windows = spark.range(300).select(F.col("id").alias("window"), day("cast(id * 7 as int)").alias("since"), day("cast(id * 7 + 1 + id % 3 as int)").alias("until"))
    found = intervals.overlap_join(rows, windows)
    assert found.count() == sum(i < 7 * w + 1 + w % 3 and i + i % 700 + 4 >= 7 * w for i in range(2000) for w in range(300))
    assert 2000 <= placed[0].count() <= 4000
    assert found.select("id", "window").distinct().count() == found.count()


def test_pairs_of_every_length_meet_once(spark):
    rng = np.random.default_rng(9)
    spans = lambda n: [(i, a := int(rng.integers(200_000)), a + int(rng.choice([1, 3, 20, 24, 49, 200, 3000, 60_000, 900_000]))) for i in range(n)]
    rows, windows = spans(300), spans(200)
    frame = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in rows], "event long, low timestamp_ntz, high timestamp_ntz")
    held = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in windows], "window long, since timestamp_ntz, until timestamp_ntz")
    got = sorted((r.event, r.window) for r in intervals.overlap_join(frame, held).collect())
    assert got == sorted((i, w) for i, a, b in rows for w, s, u in windows if a < u and b >= s)
