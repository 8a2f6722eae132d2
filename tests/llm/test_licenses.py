import re

from sylvan.llm.license_templates import TEMPLATES
from sylvan.llm.licenses import scan


def pairs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], strict=False))


def plain(text):
    text = text or ""
    blocks = [[]]
    for x in text.split("\n"):
        if x.strip():
            blocks[-1].append(x)
        elif blocks[-1]:
            blocks.append([])
    blocks = [b for b in blocks if b]
    parts = [("line", i, x) for i, x in enumerate(text.split("\n"))]
    parts += [("block", i, "\n".join(b)) for i, b in enumerate([b for b in blocks if len(b) > 1])]
    parts += [("text", 0, text)] if len(blocks) > 1 else []
    out = set()
    for unit, i, x in parts:
        for name, t in TEMPLATES:
            a, b = pairs(x), pairs(t)
            if a and b and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                out.add((unit, i, name))
    return out


MIT = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
TEXTS = [
    None, "", " ", "word", "Nothing here.\nNor here of any use to the scan.", "intro\nLICENSED under the apache license -- version 2.0\nmore",
    MIT, MIT.upper().replace("COPYRIGHT", "copy"), "title\n\n" + MIT.replace(". ", ".\n") + "\n\nlast line\n", MIT[:200], "All rights reserved.\n" * 3,
    "a\n\nReleased under\nthe MIT License.\n \n\nAll rights\nreserved.", "x " * 20000, "This work is licensed under the GNU General Public License, version 3.", MIT + " and then some words more of " * 40,
]


def test_against_plain_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "All rights reserved.", None)], "doc_id long, text string, name string")
    rows = scan(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        got = [(m["unit"], m["index"], m["name"]) for m in r["__sv_matches"]]
        assert len(got) == len(set(got))
        assert set(got) == plain(r.text), (r.doc_id, r.text)
    assert sum(bool(r["__sv_matches"]) for r in rows) >= 8
    assert scan(docs.limit(0)).count() == 0


def test_coefficient_and_own_templates(spark):
    docs = spark.createDataFrame([(1, "one two three four five x")], "doc_id long, text string")
    (m,) = scan(docs, templates=[("A", "one two three four five"), ("A", "one two three four five six"), ("B", "nil")]).first()["__sv_matches"]
    assert (m.name, m.common, m.size, m.template_size, round(m.dice, 4)) == ("A", 4, 5, 4, 0.8889)


def test_no_python_in_the_plan(spark):
    plan = scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))


def test_licence_lines_of_the_tables_and_full_texts(spark):
    """The lines as they stand in the documents tables, and variants of full texts; not the list itself."""
    lines = [
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("All rights reserved.", "All-Rights-Reserved"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("licensed under CC-BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ]
    full = [(t.replace(". ", ".\n\n").upper() + "\n\nCopyright of somebody and 30 words more." * 2, n) for n, t in TEMPLATES if len(t) > 5000]
    assert {n for _, n in full} >= {"Apache-2.0", "GPL-2.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    rows = lines + full
    docs = spark.createDataFrame([(i, "Some text.\n" + t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in scan(docs).collect():
        text, name = rows[r.doc_id]
        found = {m["name"] for m in r["__sv_matches"]}
        assert name in found, text[:60]
        assert len(found) == 1 or name == "GPL-3.0", (name, found)  # the short notices of the GPL family are alike
