import math
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash

from sylvan.llm.quality import BITS, clean, judge

WS = " \t\n\x0b\x0c\r"


def plain(text):
    text = text or ""
    words = regex.findall("[^" + WS + "]+", text)
    lines = [x for x in text.split("\n") if x.strip(WS)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(runs)
    repeated = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def grams(text):
    tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in tokens]
    chain = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
    return [x % 2**BITS for x in h + [chain(a, b) for a, b in zip(h, h[1:], strict=False)]]


def scores(docs, trusted):
    raw, good = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    size, nr, nt = 2**BITS, raw.total(), good.total()
    w = lambda b: math.log((good[b] + 1) / (nt + size)) - math.log((raw[b] + 1) / (nr + size)) if nt else 0
    return [sum(map(w, g)) / len(g) if (g := grams(t)) else 0.0 for _, t in docs]


def texts():
    rng = random.Random(5)
    one = lambda n, w: " ".join(rng.choice(w) for _ in range(n))
    good, bad = ["sun", "moon,", "Rain", "été", "wind."], ["BUY!!", "$$$", "x|y", "<b>"]
    out = [(i, one(rng.randrange(5, 60), good if i % 3 else bad)) for i in range(60)]
    fixed = " a b c d e f g h i j k l m n o p q r s t"
    out += [(100, None), (101, ""), (102, " \n\t\n"), (103, "a\nb\na\n\n\nb \nb"), (104, "é" * 40000), (105, "z " * 3000), (106, fixed + fixed), (107, "q" + fixed + " a b c d e"), (108, " ".join(f"w{i}" for i in range(30000))), (None, fixed), (7, "second text of seven")]
    return out


def test_against_plain_python(spark):
    docs = texts()
    trusted = {i for i in range(60) if i % 3}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, __score string")
    labels = spark.createDataFrame([(i, int(i in trusted)) for i in range(60)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    rows = judge(df, labels).collect()
    assert len(rows) == len(docs)
    got = {(r.doc_id, r.text): r for r in rows}
    for (i, t), s in zip(docs, scores(docs, trusted), strict=True):
        r = got[i, t]["__sv_verdict"]
        assert (*r.base, r.base_failed) == plain(t), (i, (t or "")[:40])
        assert r.score == pytest.approx(s, abs=1e-9)
        assert r.kept == (not r.base_failed and s >= -0.25)
    kept = clean(df, labels)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r["__sv_verdict"].kept)


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")] * 2, "doc_id long, text string")
    assert [(r["__sv_verdict"].score, r["__sv_verdict"].kept) for r in judge(df, labels).collect()] == [(0.0, True)] * 2
    assert judge(df.limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = judge(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
