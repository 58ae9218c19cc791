"""Licences that differ in a word or two."""

from __future__ import annotations

import textwrap

from libgauge.llm import licenses

GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} (at your option) any later version."
HEADERS = {
    "GPL-1.0-header": "This program is free software; " + GNU.format("General Public License", ";", "1, or"),
    "GPL-2.0-header": "This program is free software; " + GNU.format("General Public License", ";", "2 of the License, or"),
    "GPL-3.0-header": "This program is free software: " + GNU.format("General Public License", ",", "3 of the License, or"),
    "AGPL-3.0-header": "This program is free software: " + GNU.format("Affero General Public License", ",", "3 of the License, or"),
    "LGPL-2.0-header": "This library is free software; " + GNU.format("Library General Public License", ";", "2 of the License, or"),
    "LGPL-2.1-header": "This library is free software; " + GNU.format("Lesser General Public License", ";", "2.1 of the License, or"),
    "LGPL-3.0-header": "This library is free software: " + GNU.format("Lesser General Public License", ",", "3 of the License, or"),
    **{f"CC-{short}-4.0": f"This work is licensed under a Creative Commons Attribution{long} 4.0 International License." for short, long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives"))},
}


def test_each_header_is_its_own(spark):
    """On one line, and wrapped as a comment inside code."""
    code = "\n".join(f"int f{k}(int x{k}) {{ return x{k} * {k}; }}" for k in range(40))
    rows = [(f"{n}|line", f"first words\n{t}\nlast words") for n, t in HEADERS.items()] + [(f"{n}|wrapped", code + "\n/*\n" + textwrap.indent(textwrap.fill(t, 60), " * ") + "\n */\n" + code) for n, t in HEADERS.items()]
    df = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[k].license for k in range(len(rows))] == [n.partition("|")[0] for n, _ in rows] and all(r.dice == 1.0 for r in got.values())


def test_no_two_templates_are_alike():
    bags = [(n, sorted(licenses.template_bigrams(t))) for n, t in licenses.TEMPLATES]
    assert len({n for n, _ in bags}) == len({tuple(b) for _, b in bags}) == len(bags)
