import random
from collections import Counter

import corpus_pipeline
from sylvan.llm.simhash import WIDE, WIDE_DISTANCE, fingerprints
from tests.llm.test_decontaminate import brute
from tests.llm.test_line_dedup import plain as dedup_plain
from tests.llm.test_mixing import fill
from tests.llm.test_simhash import grouped


def write(spark, folder):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    passage = " ".join(word() for _ in range(30))
    own = [(i, text(rng.randrange(1, 6)), ["a", "b", "c", None][i % 4]) for i in range(80)]
    own += [(100 + i, own[i][1], "a") for i in range(5)]  # copies
    own += [(110, text(2) + "\n" + passage, "b"), (111, "BUY!! $$$ " * 30, "b"), (112, "too short", "c"), (113, None, "c"), (114, "", None)]
    near = own[20][1].split(" ")
    near[3] = "changed"
    own.append((115, " ".join(near), "b"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in own], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 111), 0) for i, _, _ in own], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return own, passage


def test_stages_against_plain_python(spark, tmp_path):
    own, passage = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept.append([(r.doc_id, r.text, r.source) for r in docs.collect()])
    quality, lines, near, clean, mixed = kept
    assert {i for i, _, _ in own} - {i for i, _, _ in quality} == {111, 112, 113, 114}
    want = dedup_plain([(i, t) for i, t, _ in quality])
    assert {(i, t) for i, t, _ in lines} == {(i, t) for i, t in want.items() if t.strip()}
    assert not {100, 101, 102, 103, 104} & {i for i, _, _ in lines}
    rows = sorted(lines)
    wide = fingerprints([t.encode() for _, t, _ in rows], 5, wide=WIDE)
    least = grouped([sum(int(w) << (64 * k) for k, w in enumerate(row)) for row in wide], [i for i, _, _ in rows], WIDE_DISTANCE)
    assert {i for i, _, _ in near} == set(least)
    assert {i for i, t, _ in near if not brute(t, [(1, passage)])[1]} == {i for i, _, _ in clean}
    assert 110 in {i for i, _, _ in near} and 110 not in {i for i, _, _ in clean}
    size = lambda t: len((t or "").split())
    totals, largest, taken, times = Counter(), Counter(), Counter(), Counter()
    for _, t, s in clean:
        totals[s] += size(t)
        largest[s] = max(largest[s], size(t))
    for i, t, s in mixed:
        taken[s] += size(t)
        times[i] += 1
    assert max(times.values()) <= 2
    for s, target in fill(dict(totals)).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted((i, t) for i, t, _ in mixed)


EXTRA = ["token", "score", "kept", "n", "k", "rows", "hash", "line", "fingerprint", "component_id", "item_id", "size", "a.b"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names: each stage has a defined result."""
    own, _ = write(spark, tmp_path)
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    data = [(i, t, "en", s, len(t or ""), *["x"] * len(EXTRA)) for i, t, s in own]
    data += [(None, None, None, None, None, *[None] * len(EXTRA))] * 2
    data += [(None, own[30][1] + " and more", None, None, None, *[None] * len(EXTRA)), (200, long, None, None, 5, *["y"] * len(EXTRA))]
    data += [data[40]] * 2
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame(data, kind)
    plain = lambda rows: [(r.doc_id, r.text) for r in rows]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        out[name] = got.collect()
        for r in out[name]:
            if r.doc_id is not None:
                assert r["a.b"] == ("y" if r.doc_id == 200 else "x"), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    repeated = (data[40][0], data[40][1])
    assert plain(out["quality_rules"]).count(repeated) == 3 and not any(not t for _, t in plain(out["quality_rules"]))
    assert plain(out["line_dedup"]).count(repeated) == 3 and plain(out["line_dedup"]).count((None, None)) == 2
    near = plain(out["near_dedup"])
    assert near.count(repeated) == 1 and sum(not t for _, t in near) == 1 and (113, None) in near
    clean = plain(out["decontaminate"])
    assert clean.count(repeated) == 3 and clean.count((None, None)) == 2 and 110 not in {i for i, _ in clean}
    copies = Counter(plain(out["mix_sources"]))
    assert max(n for k, n in copies.items() if k != repeated and k[1]) <= 2 and copies[repeated] in (0, 3, 6)
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontaminate"):
        assert [t for i, t in plain(out[name]) if i == 200] in ([long], []), name
    assert (200, long) in plain(out["line_dedup"]) and (200, long) in near and (200, long) in clean
