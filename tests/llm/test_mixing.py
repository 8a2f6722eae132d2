import random
from collections import defaultdict

import pytest

from sylvan.llm import mixing
from sylvan.llm.mixing import decide, measured, mix, plan_sources


def fill(totals, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, out, free = share * sum(totals.values()), {}, set(names)
    while free:
        level = (budget - sum(out.values())) / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level >= cap * totals[s]}
        if not full:
            return out | {s: w[s] * level for s in free}
        out |= {s: cap * totals[s] for s in full}
        free -= full
    return out


def rows(n=600):
    rng = random.Random(2)
    pick = ["hot"] * 6 + ["b", "B", "é", "𝄞", "￿", None, "tiny"]
    out = [(i, " ".join("w" * rng.randrange(0, 30)), rng.choice(pick), "x") for i in range(n)]
    return out + [(None, "a b c", "hot", None), (7, None, "b", None), (7, "", "b", None), (3, "same row", "B", "y"), (3, "same row", "B", "y"), (9, "long " * 900, "hot", "z")]


@pytest.mark.parametrize("few", [100_000, 0])
def test_targets_and_taken(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    own = measured(docs)
    got = decide(own, *plan_sources(own)).collect()
    assert len(got) == len(data)
    totals, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source, _ in data:
        n = len((text or "").split())
        totals[source] += n
        largest[source] = max(largest[source], n)
    targets = fill(dict(totals))
    for r in got:
        n = len((r.text or "").split())
        assert (r["__sv_size"], r["__sv_total"]) == (n, totals[r.source])
        assert r["__sv_target"] == pytest.approx(targets[r.source])
        assert 0 <= r["__sv_copies"] <= 2
        taken[r.source] += n * r["__sv_copies"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(totals.values()))
    for s in totals:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["__sv_copies"] for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix(docs.repartition(3)).collect()))


def test_no_words_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    own = measured(docs)
    assert [(r["__sv_target"], r["__sv_copies"]) for r in decide(own, *plan_sources(own)).collect()] == [(0.0, 0)] * 2
    assert mix(docs.limit(0)).count() == 0


def test_one_source_is_capped_by_its_share(spark):
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(100)], "doc_id long, text string, source string")
    assert mix(docs).count() == 150


def test_no_python_in_the_plan(spark):
    own = measured(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string"))
    plan = decide(own, *plan_sources(own))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
