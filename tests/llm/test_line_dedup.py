import random

import pytest

from sylvan.llm import line_dedup
from sylvan.llm.line_dedup import dedup, dedup_lines, deletions, one_edit


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(line):
    return [w for w in lower(line).replace("\t", " ").replace("\r", " ").split(" ") if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    """One edit of two lines: of their words from eight words on, else of their characters from eight characters on."""
    if (len(a) >= 8) != (len(b) >= 8):
        return False
    if len(a) < 8:
        a, b = " ".join(a), " ".join(b)
    return min(len(a), len(b)) >= 8 and abs(len(a) - len(b)) < 2 and distance(a, b) == 1


def plain(docs):
    """New text of each document, in order of id; ids are unique here."""
    seen, out = [], {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            if w:
                close = any(w == s or near(w, s) for s in seen)
                seen.append(w)
                if close:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def random_docs(n=60, seed=3):
    rng = random.Random(seed)
    pick = ["red", "Green", "blue", "é", "x"]
    pool = [[rng.choice(pick) for _ in range(rng.randrange(0, 14))] for _ in range(30)]

    def line():
        own = rng.choice(pool)[:]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(own) + 1)
            own[k : k + rng.randrange(2)] = [rng.choice(pick)] * rng.randrange(2)
        return (" " * rng.randrange(1, 3)).join(own) + rng.choice(["", " ", "\t"])

    return [(i, "\n".join(line() for _ in range(rng.randrange(1, 8)))) for i in range(n)]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_against_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", few)
    docs = random_docs() + [(900, None), (901, ""), (902, "\n\n"), (907, "x" * 400), (908, "x" * 401), (909, "les."), (910, "LES.\nlis."), (911, "Überall hier"), (912, "Überal hier\nüberall hier"), (913, "abcdefg\nabcdefgh\nabcdefghi"), (903, "tail " * 300), (904, "tail " * 301), (905, "The same old line of words here, friend."), (906, "the SAME old line of words here, friend."), (914, "the same old line of words here"), (None, "the same old line of some words here, friend.\nnew line of three")]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string")
    rows = {r.doc_id: r for r in dedup_lines(df).collect()}
    want = plain(docs)
    assert len(rows) == len(docs)
    for i, text in docs:
        assert (rows[i]["__sv_text"] or "") == want[i], i
    kept = dedup(df)
    assert kept.columns == df.columns
    nothing = {i for i, t in docs if not (want[i] == (t or "") or want[i].strip())}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - nothing
    assert len(nothing) > 3


def test_repeated_rows_and_lengths(spark):
    df = spark.createDataFrame([(1, "a b c d", 7), (1, "a b c d", 7), (2, "A b c d\nq r s", 13)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in dedup(df).collect()) == [(1, "a b c d", 7), (1, "a b c d", 7), (2, "q r s", 5)]
    assert dedup(df.limit(0)).count() == 0


def test_deletions():
    a, full = deletions(b"p q r s".split(), b" ")
    b, other = deletions(b"p q x s".split(), b" ")
    assert a[2] == b[2] and len({*a, *b}) == 7
    assert deletions(b"p r s".split(), b" ")[1] == a[1] and full != other
    assert deletions(b"p q r s".split(), b"")[1] != full


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one line here", "a", 1), (2, "one line here\nand more", "b", 2)], "`doc.id` long, `the text` string, key string, line int")
    out = dedup(df, id_col="doc.id", text_col="the text", length_col=None)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "one line here", "a", 1), (2, "and more", "b", 2)]


def test_one_edit():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = rng.choices("ab", k=rng.randrange(1, 6)), rng.choices("ab", k=rng.randrange(1, 6))
        assert one_edit(a, b) == (distance(a, b) == 1), (a, b)
