import bisect
import random
import re

import numpy as np

from sylvan.llm import decontaminate as decontaminate_module
from sylvan.llm.decontaminate import Block, bound, decontaminate, find_matches, scan, suffix_array


def fold(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def brute(text, items, window=10):
    own, hit, found = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


def check(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string, matches string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in find_matches(d, b, **options).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t, _ in docs), key=str)
    clean = decontaminate(d, b, **options)
    assert clean.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(g[0]) for g in got if not g[2])


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("a b c d é f1".split()) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([30, 14, 10, 9, 3, 2, 1, 0])] + [(20, None), (21, "zz"), (22, text(30))]
    items.append((23, items[0][1]))
    docs = [(i, text(rng.randrange(40)), "x") for i in range(40)]
    docs += [(90, items[0][1].upper() + "! tail", "x"), (91, "head-" + items[10][1] + " " + items[0][1], "x"), (92, None, None), (93, "", "x"), (None, items[0][1], "x"), (94, "ZZ", "x"), (94, "ZZ", "x")]
    check(spark, docs, items)
    check(spark, docs, items, shard_words=7, block_bytes=60)


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, "x y " + item + " z " + " ".join(f"w{i}" for i in range(3, 14)))], "doc_id long, text string")
    row = find_matches(docs, spark.createDataFrame([("it", item)], "item_id string, text string")).first()
    assert [tuple(m) for m in row.matches] == [("it", 2, 0, 25), ("it", 28, 3, 11)]


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 1, 7, 40)])
    text = np.concatenate([text, text, np.append(np.ones(60, int), 0)])
    suffix = lambda t, p: t[p : p + int(np.argmax(t[p:] == 0))].tolist()
    array = suffix_array(text)
    own = [suffix(text, p) for p in array]
    assert own == sorted(own) and sorted(array) == np.flatnonzero(text).tolist()
    other = np.concatenate([np.append(rng.integers(1, 4, 30), 0), text[:41]])
    b = np.flatnonzero(other)
    for limit in (1, 3, 100):
        for after in (False, True):
            at = bound(text, array, other, b, np.full(len(b), limit), after)
            cut = [s[:limit] for s in own]
            find = bisect.bisect_right if after else bisect.bisect_left
            assert at.tolist() == [find(cut, suffix(other, p)[:limit]) for p in b]


def test_long_and_shared_passages(spark):
    """A passage that many items share is one match a place; a text of one word a hundred thousand times ends."""
    passage = " ".join(f"p{i}" for i in range(60))
    items = spark.createDataFrame([(i, f"{passage} own{i} end") for i in range(200)] + [(900, "same " * 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage} y {passage} own7"), (2, "same " * 100_000), (3, "p1 p2 p3")], "doc_id long, text string")
    rows = {r.doc_id: r for r in find_matches(docs, items).collect()}
    assert [(m.doc_word, m.item_word, m.n_words) for m in rows[1].matches] == [(1, 0, 60), (62, 0, 61)] and rows[1].matches[1].item_id == "7"
    assert len(rows[1]["items"]) == 200 and rows[1].n_hit == 121
    assert rows[2].n_hit == 100_000 and rows[2]["items"] == ["900"] and rows[3].n_hit == 0
    assert max(m.n_words for m in rows[2].matches) == 40


def test_matches_come_from_the_suffix_array(spark, monkeypatch):
    docs = [[w.encode() for w in "a b c d e f g h i j k".split()]]

    class Source:
        value = Block([("it", b"a b c d e f g h i j")], 10)

    assert scan(docs, [Source])[0] == [10]
    monkeypatch.setattr(decontaminate_module, "suffix_array", lambda text: np.zeros(0, np.int64))
    assert scan(docs, [Source])[0] == [0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert find_matches(none, items).count() == 0
    assert decontaminate(docs, items).count() == 1


def test_items_without_an_id(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x " + item), (2, "nothing"), (3, item + " named " * 12)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None), (7, "named " * 10)], "item_id long, text string")
    for options in ({}, {"block_bytes": 20}):
        rows = {r.doc_id: r for r in find_matches(docs, items, **options).collect()}
        assert [(rows[i].n_hit, rows[i]["items"]) for i in (1, 2, 3)] == [(12, []), (0, []), (24, ["7"])]
        assert [m.item_id for m in rows[1].matches] == [None] and {m.item_id for m in rows[3].matches} == {None, "7"}
        assert [r.doc_id for r in decontaminate(docs, items, **options).collect()] == [2]
