"""Notices that are neither a line nor the whole text."""

from __future__ import annotations

import random
import textwrap

from libgauge.llm import licenses


def test_wrapped_and_inline_notices(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    known = dict(licenses.TEMPLATES)
    wrapped = {k: "\n".join([prose(90), prose(90), textwrap.fill(known[name], 60), prose(90), prose(200)]) for k, name in enumerate(("MIT-text", "ISC-text", "GPL-3.0-header", "MPL-2.0", "Apache-2.0-header", "BSD-notice"))}
    twice = "\n".join([prose(40), *[textwrap.fill(known["MIT-text"], 70)] * 2, prose(500)])
    inline = f"{prose(30)} {known['Proprietary']} {prose(30)}\n{prose(9)}"
    spread = textwrap.fill(f"{prose(14)} {known['BSD-notice']} {prose(20)}", 60)
    beside = "\n".join([prose(60), f"licensed {known['MIT']} now", prose(60)])
    rows = [*wrapped.items(), (10, twice), (11, inline), (12, spread), (13, beside), (14, prose(3000)), (15, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license for k in range(6)] == ["MIT-text", "ISC-text", "GPL-3.0-header", "MPL-2.0", "Apache-2.0-header", "BSD-notice"]
    assert all(got[k].dice == 1.0 and got[k].unit == 2 for k in range(6))
    assert (got[10].license, got[10].dice, got[10].unit, got[10].n_matches) == ("MIT-text", 1.0, 1, 2)
    assert (got[11].license, got[11].dice, got[11].unit) == ("Proprietary", 1.0, 0)
    assert (got[12].license, got[12].dice, got[12].n_matches) == ("BSD-notice", 1.0, 1)
    assert (got[13].license, got[13].unit, got[13].n_matches) == ("MIT", 1, 1)
    assert got[14].license is None and got[14].n_matches == 0 and got[15].license is None


def test_bsd_and_zlib_texts(spark):
    """Whole licence texts, wrapped as comments over code, told apart though they share most words."""
    known = dict(licenses.TEMPLATES)
    names = ("BSD-2-Clause-text", "BSD-3-Clause-text", "Zlib-text")
    code = "\n".join(f"int f{k}(int x{k}) {{ return x{k} * {k}; }}" for k in range(60))
    rows = [(k, "/*\n" + textwrap.indent(textwrap.fill(known[name], 70), " * ") + "\n */\n" + code) for k, name in enumerate(names)]
    rows.append((3, code))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license for k in range(4)] == [*names, None] and all(got[k].dice == 1.0 for k in range(3))
