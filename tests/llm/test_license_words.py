"""Licenses without the usual words, misspelt ones, and coverage against a longest common subsequence."""

import numpy as np

from tidemark.llm import license


def names(text):
    return [name for name, *_ in license.scan(text)]


def test_other_spellings_are_found():
    assert names("Released under the MIT Licence.") == ["mit-notice"]
    assert names("the code is Released under the GNU General Public Licence, version 3") == ["gpl-3.0-notice"]
    assert names(license.TEMPLATES["isc"].replace("Permission", "Permision").replace("permission", "permision")) == ["isc"]
    assert names("released under the mat license") == []


def common(a, b):
    row = np.zeros(len(b) + 1, int)
    for x in a:
        before = row.copy()
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_coverage_is_that_of_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for name in ("isc", "apache-2.0-header", "mpl-2.0-header"):
        words = license.TEMPLATES[name].split()
        for _ in range(20):
            noisy = [w if rng.random() > 0.08 else "other" for w in words]
            for at in sorted(rng.integers(0, len(noisy), 3), reverse=True):
                noisy.insert(at, "more")
            text = "before it " + " ".join(noisy) + " after it"
            exact = common(license._words(text), license._words(license.TEMPLATES[name])) / len(license._words(license.TEMPLATES[name]))
            got = [share for found, share, _, _ in license.scan(text) if found == name]
            assert all(share <= exact + 1e-9 for share in got) and (not got or got[0] >= exact - 0.05)
            if exact > 0.85 and not got:  # then a word that tells it is gone
                runs = [license._words(r) for r in license.RUNS[name]]
                plain = license._words(text)
                assert not all(any(plain[i : i + len(r)] == r for i in range(len(plain))) for r in runs)


def test_ties_long_texts_and_repeats(spark):
    long = "license text " * 40000 + "Released under the MIT License. " * 3
    rows = [(1, long), (1, long), (2, ""), (3, None)]
    got = [(r.doc_id, r.license) for r in license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, "mit-notice")] * 6
