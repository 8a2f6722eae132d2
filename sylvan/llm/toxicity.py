"""Toxicity: bags of subwords, embedded, averaged, and put through a linear softmax.

Words (lower case, ASCII punctuation stripped from their ends) become the hashed byte n-grams of
`<word>` besides the word itself, so a misspelling shares most of its vectors with the word that it
hides. A text is read in windows of `span` words, all of them; a window is the mean of its words'
vectors and a text is as toxic as its worst window. Embeddings and softmax are trained jointly, with
Adagrad, in numpy on the driver: labels are of whole texts, so each text's gradient is shared among
its windows by their present scores.

The model is fit on at most `max_labelled` labelled documents, chosen by a hash of their id (a
documented bound; whole texts). Everything else covers all rows. Since scores are linear in the
subwords' vectors, the fitted model is one number a bucket: a fixed-size broadcast.

Null or empty texts score as the model's bias. Repeated rows score alike. Labels of ids that aren't
there, null labels and null ids teach nothing; conflicting labels of one id count as toxic. No usable
label, or labels of one kind only: every score is 0.25, or 0.75 if all are toxic. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import ship, slices

BITS, SIZES, STRIP = 17, (3, 4, 5, 6), b".,;:!?\"'()[]{}<>|*#%&$-_/\\"


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tokens(text: str | None) -> list[bytes]:
    return [w for x in (text or "").lower().encode().split() if (w := x.strip(STRIP))]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words at once: the owner and the bucket of each subword."""
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, hashes = [np.arange(len(words))], [np.array([zlib.crc32(w) for w in words], np.uint64)]
    for n in SIZES:
        if len(text) < n:
            continue
        h = np.full(len(text) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + text[j : len(text) - n + 1 + j]
        same = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][same])
        hashes.append(h[same])
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return owner, (h >> np.uint64(64 - BITS)).astype(np.int64)


def sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by owner, for each column."""
    return np.stack([np.bincount(owner, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


class Model:
    """bias, and for each bucket what its presence adds to the log-odds of a one-subword window."""

    def __init__(self, weights: np.ndarray, bias: float, span: int):
        self.weights, self.bias, self.span = weights, bias, span
        self.known: dict[bytes, float] = {}

    def learn(self, words: list[bytes]) -> None:
        for start in range(0, len(words), 1 << 15):
            part = words[start : start + (1 << 15)]
            owner, bucket = subwords(part)
            mean = np.bincount(owner, self.weights[bucket], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, mean.tolist(), strict=True))

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The worst window's log-odds of each text, and that window's index."""
        rows = [tokens(t) for t in texts]
        at = 0
        while at < len(rows):  # the words of a few texts at a time, so the cache can stay small
            stop, fresh = at, set()
            while stop < len(rows) and (stop == at or len(fresh) < 1 << 17):
                fresh.update(rows[stop])
                stop += 1
            self.learn_and_score(rows, at, stop, fresh)
            at = stop
        best = np.array([x[0] for x in rows], float)
        return best, np.array([x[1] for x in rows], np.int64)

    def learn_and_score(self, rows: list, at: int, stop: int, fresh: set) -> None:
        known = self.known
        new = [w for w in fresh if w not in known]
        if new:
            if len(known) + len(new) > 1 << 19:  # a cache only
                known.clear()
                new = list(fresh)
            self.learn(new)
        for i in range(at, stop):
            if not rows[i]:
                rows[i] = (self.bias, 0)
                continue
            own = np.array([known[w] for w in rows[i]])
            start = np.arange(0, len(own), self.span)
            means = np.add.reduceat(own, start) / np.diff(np.append(start, len(own)))
            worst = int(means.argmax())
            rows[i] = (self.bias + means[worst], worst)


def train(texts: list[str | None], labels: list[int], *, span: int = 8, dim: int = 8, steps: int = 640, batch: int = 128, rate: float = 0.2, seed: int = 7) -> Model:
    """Joint training of the subword vectors and the softmax, in numpy: about `steps` batches, whatever the sample's size."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -1.0986122886681098 if not len(y) or not y.max() else 1.0986122886681098, span)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)], np.int64) for t in texts]
    owner, bucket = subwords(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    bucket, count = bucket[order], np.bincount(owner, minlength=len(vocabulary))
    first = np.concatenate([[0], np.cumsum(count)])
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out = rng.uniform(-1, 1, dim).astype(np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    square, square_out, square_bias = np.full(1 << BITS, 1e-6, np.float32), np.full(dim, 1e-6, np.float32), 1e-6
    for _ in range(-(-steps * batch // len(docs))):
        shuffled = rng.permutation(len(docs))
        for start in range(0, len(docs), batch):
            ids = [i for i in shuffled[start : start + batch] if len(docs[i])]
            if not ids:
                continue
            used, word = np.unique(np.concatenate([docs[i] for i in ids]), return_inverse=True)
            n = count[used]
            subs = bucket[np.repeat(first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            whose = np.repeat(np.arange(len(used)), n)
            vectors = np.add.reduceat(table[subs], np.cumsum(n) - n) / n[:, None]
            lens = np.array([len(docs[i]) for i in ids])
            windows = -(-lens // span)
            begin = np.concatenate([np.arange(k) * span + s for k, s in zip(windows, np.cumsum(lens) - lens, strict=True)])
            size = np.diff(np.append(begin, lens.sum()))
            means = np.add.reduceat(vectors[word], begin) / size[:, None]
            z = means @ out + bias
            heads = np.cumsum(windows) - windows
            top = np.maximum.reduceat(z, heads)
            share = np.exp(z - np.repeat(top, windows))
            share /= np.repeat(np.add.reduceat(share, heads), windows)
            error = 1 / (1 + np.exp(-top)) - y[ids]
            dz = (np.repeat(error, windows) * share / len(ids)).astype(np.float32)
            grad_out, grad_bias = means.T @ dz, float(dz.sum())
            d_word = sums(np.repeat(dz / size, size)[:, None], word, len(used)) / n[:, None]
            g = sums(d_word[whose], subs, 1 << BITS)  # the same for every dimension but for out's factor
            grad = g * out[None, :]
            square += (grad * grad).mean(1)
            touched = np.flatnonzero(g[:, 0])
            table[touched] -= rate * grad[touched] / np.sqrt(square[touched])[:, None]
            square_out += grad_out * grad_out
            square_bias += grad_bias * grad_bias
            out -= rate * grad_out / np.sqrt(square_out)
            bias -= 0.1 * rate * grad_bias / np.sqrt(square_bias)
    return Model((table @ out).astype(np.float64), float(bias), span)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 8000, fold: int = 5, **options) -> Model:
    """A model from labelled rows outside the held-out fold, max_labelled at most."""
    rows = labels.select(F.col(f"`{id_col}`").alias("__sv_id"), F.col(f"`{label_col}`").alias("__sv_y")).filter("__sv_id is not null and __sv_y is not null")
    rows = rows.filter(remainder("__sv_id", fold) != 0).groupBy("__sv_id").agg(F.max((F.col("__sv_y") > 0).cast("int")).alias("__sv_y"))
    rows = rows.orderBy(F.xxhash64(F.col("__sv_id").cast("string")), "__sv_id").limit(max_labelled)
    texts = docs.select(F.col(f"`{id_col}`").alias("__sv_id"), F.col(f"`{text_col}`").alias("__sv_text")).join(F.broadcast(rows), "__sv_id")  # max_labelled rows of two numbers
    texts = texts.groupBy("__sv_id", "__sv_y").agg(F.max_by("__sv_text", F.xxhash64("__sv_text")).alias("__sv_text"))
    found = sorted(((r["__sv_id"], r["__sv_text"] or "", r["__sv_y"]) for r in texts.toLocalIterator()), key=lambda r: (str(r[0]), r[1]))
    return train([r[1] for r in found], [r[2] for r in found], **options)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """id, score, predicted, worst_window of every row. No shuffle."""
    parts = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.span))  # 2 ** BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts.value)
        for batch in batches:
            for part in slices(batch, "__sv_text", batch_bytes):
                z, worst = own.logits(part.column("__sv_text").to_pylist())
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(worst)], names=[id_col, "score", "predicted", "worst_window"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("__sv_id"), F.col(f"`{text_col}`").alias("__sv_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, worst_window long")
