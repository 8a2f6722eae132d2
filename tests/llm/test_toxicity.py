import random
import zlib

import numpy as np

from sylvan.llm.toxicity import BITS, fit, score, subwords, tokens, train

RNG = random.Random(3)
CLEAN = ["".join(RNG.choice("abdefghilmnoprstu") for _ in range(RNG.randrange(3, 9))) for _ in range(600)]
RUDE = ["blockhead", "nitwit", "scoundrel"]


def text(toxic, n=60):
    own = [RNG.choice(CLEAN) for _ in range(n)]
    if toxic:
        own[RNG.randrange(n)] = RNG.choice(RUDE)
    return " ".join(own)


def tables(spark, n=900):
    rows = [(i, text(i % 4 == 0), None) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)] + [(None, 1), (10**9, 1), (5, None)], "doc_id long, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = tables(spark)
    model = fit(docs, labels)
    rows = {r.doc_id: r for r in score(docs, model).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert np.mean([rows[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    odd = spark.createDataFrame([(1, text(0) + " blockheads " + text(0)), (2, text(0, 3000) + " nitwitt " + text(0, 3000)), (3, text(0, 80))], "doc_id long, text string")
    got = {r.doc_id: r for r in score(odd, model).collect()}
    assert [got[i].predicted for i in (1, 2, 3)] == [1, 1, 0]
    assert got[2].worst_window in (374, 375)


def test_edges(spark):
    docs, labels = tables(spark, 40)
    model = fit(docs, labels, max_labelled=20)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "... !!"), (3, "x" * 50000)], "doc_id long, text string")
    rows = score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert score(odd.limit(0), model).count() == 0
    none = fit(docs, labels.limit(0))
    assert {(round(r.score, 6), r.predicted) for r in score(odd, none).collect()} == {(0.25, 0)}


def test_same_seed_same_model():
    texts, y = [text(i % 2) for i in range(50)], [i % 2 for i in range(50)]
    assert (train(texts, y).weights == train(texts, y).weights).all()


def test_subwords_match_a_plain_loop():
    words = [b"ab", b"", b"hello", "é".encode()]
    owner, bucket = subwords(words)
    for k, w in enumerate(words):
        own = b"<" + w + b">"
        hashes = [zlib.crc32(w)]
        for n in (3, 4, 5, 6):
            for i in range(len(own) - n + 1):
                h = n
                for c in own[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                hashes.append(h)
        plain = sorted(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - BITS) for h in hashes)
        assert sorted(bucket[owner == k].tolist()) == plain


def test_scores_do_not_depend_on_the_cache():
    from sylvan.llm import toxicity

    model = train([text(i % 2) for i in range(60)], [i % 2 for i in range(60)], steps=40)
    many = [" ".join(f"w{i * 1000 + j}x" for j in range(1000)) for i in range(700)] + [text(1)]
    z, _ = model.logits(many)
    fresh = toxicity.Model(model.weights, model.bias, model.span)
    assert np.allclose(z[[0, 350, 700]], fresh.logits([many[0], many[350], many[700]])[0])


def test_scores_against_a_plain_walk(spark):
    """The query's score is the greatest, over windows of 8 words, of the mean of the words' mean subword weights, taken one by one."""
    docs, labels = tables(spark, 200)
    model, own_texts = fit(docs, labels), {r.doc_id: r.text for r in docs.collect()}
    for r in score(docs, model).collect()[:60]:
        words, windows = tokens(own_texts[r.doc_id]), []
        for a in range(0, len(words), 8):
            own = [float(np.mean(model.weights[subwords([w])[1]])) for w in words[a : a + 8]]
            windows.append(sum(own) / len(own))
        want = 1 / (1 + np.exp(-(model.bias + max(windows))))
        assert abs(r.score - want) < 1e-5
        assert windows[r.worst_window] == max(windows)
