import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sylvan.llm import language_model
from sylvan.llm.language_model import END, Parameters, Tree, contexts, score, tokens


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0


def texts(n=400):
    rng = random.Random(1)
    follow = {w: rng.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}
    out = []
    for i in range(n):
        own = [rng.choice("abcd")]
        for _ in range(rng.randrange(5, 40)):
            own.append(rng.choice(follow[own[-1]]))
        own.insert(rng.randrange(len(own)), f"Rare{rng.randrange(400)}")
        out.append((i, " ".join(own)))
    return out


def check(rows, data):
    counts, total = Counter(), 0
    for i, t in data:
        if not held(i):
            counts.update(tokens((t or "").encode()))
    total = counts.total()
    want = []
    for i, t in data:
        own = tokens((t or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        want.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)
    return counts


@pytest.mark.parametrize("frequent", [400_000, 30])
def test_counts_and_scores(spark, frequent):
    data = texts() + [(1000, None), (1001, ""), (1002, "A a A"), (1003, "new words Only here"), (1003, "new words Only here"), (None, "a b c"), (1004, "a " * 20000), (1005, "y" * 40000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, token string")
    rows = score(docs, outcomes=12, frequent=frequent).collect()
    counts = check(rows, data)
    out = [r for r in rows if r.held_out and r.n_tokens < 100]
    assert len(out) > 20
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.97
    same = [r.score for r in rows if r.doc_id == 1003]
    assert len(same) == 2 and same[0] == same[1]
    assert counts[END] == sum(not held(i) for i, _ in data)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = score(docs).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert score(docs.limit(0)).count() == 0


def test_probabilities_add_up_and_learning_helps():
    rng = np.random.default_rng(0)
    n = 20
    ids = np.cumsum(rng.integers(1, 3, 20000)) % n  # each token is one or two after the last
    lengths = np.full(200, 100)
    before, last = contexts(ids, lengths, n)
    assert last[0] == last[100] == before[1] == before[101] == n and last[1] == ids[0] and before[2] == ids[0]
    share = np.bincount(ids, minlength=n) / len(ids)
    model = Parameters(share, 8)
    model.learn(before, last, ids, np.ones(len(ids), np.float32), rng, steps=2000)
    s1, s2, norm = model.tables()
    p = np.exp(s1[None, :, :] + s2[:, None, :] - norm[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    learned = (s1[last, ids] + s2[before, ids] - norm[before, last]).mean()
    assert learned > np.log(share[ids]).mean() + 1.0


def test_tree_shares_add_up():
    """Shares within each class, by a plain walk over its groups and tokens, and their sum over its tokens."""
    rng = np.random.default_rng(3)
    tree = Tree(rng.integers(5, 90, 157).astype(float), 6)
    assert sorted(set(tree.of)) == list(range(6)) and all((np.diff(tree.group) >= 0) & (np.diff(tree.group) <= 1))
    n, sums = tree.counts, rng.normal(size=(157, 4)) * tree.counts[:, None]
    tree.fit(sums, sums.sum(0), (sums / n[:, None]).T @ sums, n.sum())
    for context in rng.normal(size=(3, 4)):
        got = np.exp(tree.log_shares(np.arange(157), np.repeat(context[None], 157, 0)))
        assert np.allclose(np.bincount(tree.of, got), 1, atol=1e-5)
        for t in range(157):
            groups = [g for g in range(tree.first[tree.of[t]], tree.first[tree.of[t] + 1])]
            scores = [math.exp(tree.group_vectors[g] @ context + tree.group_bias[g]) for g in groups]
            inner = {u: math.exp(tree.vectors[u] @ context + tree.bias[u]) for u in range(157) if tree.group[u] == tree.group[t]}
            assert got[t] == pytest.approx(scores[groups.index(tree.group[t])] / sum(scores) * inner[t] / sum(inner.values()), rel=1e-4)


def test_tokens_below_the_top_are_scored_by_the_model(spark, monkeypatch):
    """Pairs of tokens outside the top: a context tells which of them follows, which counts alone don't."""
    rng = random.Random(4)
    data = [(i, " ".join(f"k{j} {'ab'[j % 2]}{rng.randrange(3)}x{j % 7}" for j in rng.choices(range(2), k=30))) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    total = lambda: sum(r.score for r in score(docs, outcomes=4).collect() if r.held_out)
    learned = total()
    monkeypatch.setattr(language_model, "RATE", 0.0)
    assert learned > total() * 0.97


def test_scores_against_a_plain_walk(spark, monkeypatch):
    """The query's scores are the sums over the tokens of a text that its parameters give, taken one by one."""
    kept = {}
    fitted = language_model.context_sums

    def spy(docs, words, tree, model):
        own = words.value
        kept.update(n_out=own.n_out, n_top=own.n_top, model=model, tree=fitted(docs, words, tree, model))
        return kept["tree"]

    number = language_model.numbered

    def spy_numbers(docs, id_col, text_col, words):
        own = words.value
        kept["vocabulary"] = {w: i if i < own.n_top else i - own.n_top + own.n_out for w, i in own.numbers.items() if i < own.n_top + len(own.of)}
        return number(docs, id_col, text_col, words)

    monkeypatch.setattr(language_model, "numbered", spy_numbers)

    monkeypatch.setattr(language_model, "context_sums", spy)
    data = texts(150) + [(900, ""), (901, "unseen words a b")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = {r.doc_id: r.score for r in score(docs, outcomes=8, least_count=30).collect()}
    counts = Counter(w for i, t in data if not held(i) for w in tokens(t.encode()))
    v, n_out, n_top, model, tree = (kept[k] for k in ("vocabulary", "n_out", "n_top", "model", "tree"))
    assert len(tree.counts) > 3
    outside = [c for w, c in counts.items() if w not in v]
    near, far = model.embed @ model.first, model.embed @ model.second

    def top(w):
        at = v.get(w, n_out - 1)
        return at if at < n_out else n_top + tree.of[at - n_out]

    for i in (0, 7, 33, 900, 901):
        total, before, last = 0.0, n_out, n_out
        for w in tokens(dict(data)[i].encode()):
            context = near[last] + far[before]
            s = model.out @ context + model.bias
            total += s[top(w)] - np.log(np.exp(s).sum())
            at = v.get(w, -1)
            if at >= n_out:
                total += tree.log_shares(np.array([at - n_out]), context[None])[0]
            elif at < 0:
                total += math.log((counts[w] + 0.1) / (sum(outside) + 0.1 * (len(outside) + 1)))
            before, last = last, top(w)
        assert rows[i] == pytest.approx(total / math.log(10), rel=1e-4)


def test_dictionaries_stay_small(spark):
    docs = spark.createDataFrame([(f"w{i} a",) for i in range(300)], "text string")
    got = {bytes(r.token): r.n for r in language_model.count_tokens(docs, "text", most=10).collect()}
    assert got == {b"a": 300, END: 300} | {f"w{i}".encode(): 1 for i in range(300)}
