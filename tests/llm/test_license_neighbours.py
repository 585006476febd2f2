"""Licenses that differ from a template in a name, a version or a condition."""

import pytest

from tidemark.llm import license

GNU = license._GNU_HEADER


@pytest.mark.parametrize(
    "said, names",
    [
        ("Released under the MIT License.", ["mit-notice"]),
        ("Released under the BSD License.", ["bsd-notice"]),
        ("Released under the BSD 3-Clause License.", ["bsd-3-clause-notice"]),
        ("Released under the Foo License.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0-notice"]),
        ("This work is licensed under the GNU General Public License, version 3.0.", ["gpl-3.0-notice"]),
        ("Licensed under the GNU General Public License.", ["gpl-notice"]),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl-2.1-notice"]),
        ("Licensed under the GNU Affero General Public License v3.", ["agpl-3.0-notice"]),
        ("Licensed under the GPLv2 or later.", ["gpl-2.0-notice"]),
        ("Licensed under CC BY 4.0.", ["cc-by-4.0-notice"]),
        ("Licensed under CC BY 3.0.", ["cc-by-3.0-notice"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0-notice"]),
        ("Licensed under CC BY-ND 4.0.", ["cc-by-nd-4.0-notice"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["cc-by-nc-4.0-notice"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["cc-by-nc-nd-4.0-notice"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["cc-by-sa-3.0-notice"]),
        ("Licensed under the Apache License, Version 1.1.", ["apache-1.1-notice"]),
        (GNU.format(name="General Public License", version="3"), ["gpl-3.0-header"]),
        (GNU.format(name="General Public License", version="2"), ["gpl-2.0-header"]),
        (GNU.format(name="Affero General Public License", version="3"), ["agpl-3.0-header"]),
        (GNU.format(name="Lesser General Public License", version="2.1"), ["lgpl-2.1-header"]),
        ("Released under the Unlicense.", ["unlicense-notice"]),
        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["unlicense"]),
        (license.TEMPLATES["bsd"], ["bsd"]),
        (license.TEMPLATES["bsd"] + " Neither the name of Foo nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["bsd-3-clause"]),
        (license.TEMPLATES["isc"], ["isc"]),
        (license.TEMPLATES["mit"].replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ""), ["mit-0"]),
    ],
)
def test_neighbours_are_told_apart(said, names):
    assert [x[0] for x in license.scan(f"Some words. {said} And more of them.")] == names


def test_every_template_is_found_as_itself():
    for name, text in license.TEMPLATES.items():
        assert [(x[0], x[1]) for x in license.scan(text)] == [(name, 1.0)]
    assert all(set(license._seeds(template, places, license.COVERAGE)) <= set(template) and license._seeds(template, places, license.COVERAGE) for _, template, places, _ in license._PREPARED)
