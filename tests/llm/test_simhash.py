import random
import re

import numpy as np
import pytest
import xxhash

from sylvan.llm import simhash
from sylvan.llm.graph import components
from sylvan.llm.simhash import TABLES, WIDE_DISTANCE, Forest, Index, classes, dedup, fingerprints, gray_rank, links


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    own = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(codes, ids, distance=3):
    """Least id of each code's component, by brute force."""
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(codes))]


def texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    out = []
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(1, 400))]
        for _ in range(rng.randrange(4)):
            out.append(" ".join(own))
            own = own[:]
            own[rng.randrange(len(own))] = word()
    return out + [None, "", " \n", "one", "One TWO", "a b c", "x " * 3000, "x " * 3001, "É é"]


def test_fingerprints():
    data = texts()
    assert fingerprints([(t or "").encode() for t in data]).tolist() == [plain(t) for t in data]


def test_classes_and_dedup(spark):
    data = [(i, t, "n") for i, t in enumerate(texts())]
    data += [(None, data[0][1], "n"), (None, "alone without an id", "n"), (3, data[3][1], "n"), (3, data[3][1], "m"), (5, "another text of five", "n")]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    codes = [plain(t) for _, t, _ in data]
    want = grouped(codes, [i for i, _, _ in data])
    rows = classes(docs).collect()
    got = sorted((str(r["__sv_id"]), r.fingerprint % 2**64, str(r.component_id)) for r in rows)
    assert got == sorted((str(d[0]), c, str(w)) for d, c, w in zip(data, codes, want, strict=True))
    kept = dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({w for w in want if w is not None})
    assert ids.count(None) == 1
    assert dedup(docs.limit(0)).count() == 0


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 9, 17, 300, 1500])
def test_index_against_brute_force(n):
    codes = np.array(clustered(n, n), np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    forest = Forest(n)
    Index(codes[:, None], np.zeros(n, int), 3).link(forest, block=50, step=100)
    assert forest.roots(np.arange(n)).tolist() == grouped(codes.tolist(), list(range(n)))


@pytest.mark.parametrize("distance", [3, 48])
def test_groups_of_all_sizes_go_through_the_index(distance, monkeypatch):
    """Links within groups only, of 1 to 600 codes; none of them is found any other way."""
    rng = np.random.default_rng(distance)
    sizes = [1, 2, 1, 3, 8, 9, 1, 64, 65, 600, 2, 17]
    group = np.repeat(np.arange(len(sizes)), sizes)
    n, w = len(group), 1 if distance == 3 else 4
    codes = rng.integers(0, 2**63, (12, w)).astype(np.uint64)[rng.integers(0, 12, n)]
    for row in codes:
        for b in rng.choice(64 * w, rng.integers(0, distance), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    want = []
    for g in range(len(sizes)):
        own = np.flatnonzero(group == g)
        want += grouped([sum(int(x) << (64 * k) for k, x in enumerate(c)) for c in codes[own]], own.tolist(), distance)

    def found():
        forest = Forest(n)
        forest.union(*simhash.group_links(codes, group, distance, block=100, step=64))
        return forest.roots(np.arange(n)).tolist()

    assert found() == want
    monkeypatch.setattr(Index, "neighbours", lambda self, forest: None)  # only a shortcut
    assert found() == want
    monkeypatch.setattr(Index, "step", lambda *args: None)
    assert found() != want


def test_gray_order_of_several_words():
    codes = np.array([[i ^ (i >> 1)] for i in range(1 << 8)], np.uint64)
    split = np.concatenate([codes >> np.uint64(4) & np.uint64(15), codes & np.uint64(15)], 1)
    split[:, 1] <<= np.uint64(60)  # the lower half as the highest bits of the next word
    rank = gray_rank(split)
    assert np.lexsort(rank.T[::-1]).tolist() == list(range(1 << 8))


def test_dense_ball():
    """All codes within two bits of one: whole nodes are taken and dropped at once."""
    codes = np.array(sorted({0} | {1 << i | 1 << j for i in range(64) for j in range(i + 1)}), np.uint64)
    codes = codes[np.argsort(gray_rank(codes))]
    forest = Forest(len(codes))
    Index(codes[:, None], np.zeros(len(codes), int), 3).link(forest)
    assert set(forest.roots(np.arange(len(codes)))) == {0}


@pytest.mark.parametrize("most", [200_000, 3])
def test_links_over_groups(spark, most):
    codes = clustered(400, 9)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    found = links(spark.createDataFrame([(c,) for c in signed], "fingerprint long"), most=most, buffer=50)
    roots = {r.node % 2**64: r.root for r in components(found).collect()}
    want = grouped(codes, signed)
    assert {c: roots.get(c, s) for c, s in zip(codes, signed, strict=True)} == dict(zip(codes, want, strict=True))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    rows = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(1000))
    assert simhash.LANES[5] == 1 + (1 << 16)


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    data, pairs = [], []
    for i in range(150):
        own = [word() for _ in range(200)]
        other = own[:]
        for _ in range((0, 1, 2, 30, 60)[i % 5]):
            other[rng.randrange(200)] = word()
        data += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        pairs.append((jaccard(data[-2][1], data[-1][1]), 2 * i))
    docs = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    crowded = {r["__sv_id"]: r.component_id for r in classes(docs, words=5, wide=True, distance=WIDE_DISTANCE, most=1).collect()}
    got = {r["__sv_id"]: r.component_id for r in classes(docs, words=5, wide=True, distance=WIDE_DISTANCE).collect()}
    close = [got[i + 1] == i for s, i in pairs if s >= 0.9]
    apart = [got[i + 1] == i + 1 for s, i in pairs if s < 0.5]
    assert len(close) > 80 and sum(close) >= 0.97 * len(close)
    assert len(apart) > 50 and all(apart)
    assert got[900] == got[901] == 900
    assert crowded == got
    assert all(got[i] in (i, i - 1) for i in range(300))
    kept = dedup(docs, words=5, wide=True, distance=WIDE_DISTANCE)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert TABLES >= 20


@pytest.mark.parametrize("n", [10_000, 3_000_000, 12_000_000, 100_000_000])
def test_recall_does_not_fall_with_size(n):
    """12 million are about 30 GB of documents."""
    tables = simhash.sampled_bits(n, WIDE_DISTANCE)
    rng = np.random.default_rng(3)
    for distance, least in ((26, 0.99), (39, 0.96), (WIDE_DISTANCE, 0.85)):  # 26, 39: the means at Jaccard 0.9 and 0.8
        met = 0
        for _ in range(1000):
            differs = np.zeros(256, bool)
            differs[rng.choice(256, distance, replace=False)] = True
            met += any(not differs[own].any() for own in tables)
        assert met >= least * 1000, (distance, met)
    assert n / 2 ** len(tables[0]) <= 256


def wide_clusters(seed=5):
    """Fingerprints of 256 bits around a few templates: many share sampled bits, and not all of those link."""
    rng = np.random.default_rng(seed)
    words = np.repeat(rng.integers(0, 2**63, (4, 4)).astype(np.uint64), 60, 0)
    for i in range(len(words)):
        for b in rng.choice(256, rng.integers(0, 50), replace=False):
            words[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.unique(words, axis=0)


def test_crowded_keys_keep_all_links(spark):
    words = wide_clusters()
    rows = [(i, *map(int, w.view(np.int64))) for i, w in enumerate(words)]
    prints = spark.createDataFrame(rows, "fingerprint long, w0 long, w1 long, w2 long, w3 long")
    plain, *crowded = ({r.node: r.root for r in components(simhash.wide_links(prints, most=m)).collect()} for m in (200_000, 40, 1))
    assert len(plain) > 100
    for own in crowded:
        assert own == plain


def test_links_in_one_word_are_found_in_groups_of_any_size(spark, monkeypatch):
    """Two that differ in 30 bits of the first word link, whether their key holds 2 or 42."""
    monkeypatch.setattr(simhash, "sampled_bits", lambda n, distance: [np.arange(192, 208)])
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    far = base.copy()
    far[0] ^= np.uint64((1 << 30) - 1)
    crowd = np.stack([base] * 40)  # 60 bits from the first, so no link
    for row in crowd:
        for b in rng.choice(np.arange(64, 192), 60, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows = [(i, *map(int, w.view(np.int64))) for i, w in enumerate([base, far, *crowd])]
    for own in (rows[:2], rows):
        prints = spark.createDataFrame(own, "fingerprint long, w0 long, w1 long, w2 long, w3 long")
        roots = {r.node: r.root for r in components(simhash.wide_links(prints)).collect()}
        assert roots.get(1) == 0


def test_recall_on_documents(spark):
    """Of the pairs of texts of similarity 0.8 or more in the given documents, nine in ten or more link; few below 0.6 do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    common = {}
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] = common.get((a, b), 0) + 1
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in common.items()}
    got = {r["__sv_id"]: r.component_id for r in classes(docs, words=5, wide=True, distance=WIDE_DISTANCE).collect()}
    close = [got[a] == got[b] for (a, b), s in alike.items() if s >= 0.8]
    changed = [got[a] == got[b] for (a, b), s in alike.items() if 0.8 <= s < 1]
    assert len(close) > 20 and sum(close) >= 0.9 * len(close)
    assert sum(changed) >= 0.9 * len(changed)
    # a component joins nothing but texts that are linked by similarities of 0.6 or more
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    empty = [i for i, own in sets.items() if not own]
    for (a, b), s in [*alike.items(), *(((empty[0], i), 1.0) for i in empty)]:
        if s >= 0.6:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    apart = [i for i in sets if got[i] is not None and root(got[i]) != root(i)]
    assert len(apart) <= 0.002 * len(sets), len(apart)
