"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are a text's words, lower-cased for A-Z, then one end. Counts cover every training document.
The vocabulary is every token that stands `least` times or more, up to the `frequent` most frequent, so
it grows with the corpus to a fixed bound of memory. The model predicts a token from the two before by
its place in a tree. At the top stand the end, the most frequent tokens, up to CLASSES classes of the
rest of the vocabulary (neighbours by spelling), and the class of all tokens outside it: `outcomes` in
all and two. Classes hold groups, and groups tokens. A context's vector is the sum of
the embeddings of its tokens' outcomes through a matrix for each place, and the score of an outcome,
group or token that vector times its own, plus a bias (Mnih and Hinton, 2007 and 2009); each choice is
normalised over its alternatives, by batched matrix products. A token outside the vocabulary takes its
share of that class by smoothed counts, so an unseen one has a share too and probabilities add up to one.

Training is data-parallel over all training documents. For the top, each task starts a round from the
same parameters and learns from its own documents, each of which has one of the rounds, by minibatches of contexts with noise shared within a
batch (Mnih and Teh, 2012), in numpy; the round's parameters are the tasks', averaged by tokens. So what
is learnt depends a little on how rows lie in partitions, and not on the order of tasks. Groups and
tokens below take one full step of noise-contrastive estimation from the smoothed counts: with noise
drawn by counts its gradient is a token's sum of context vectors less what its counts alone would have,
scaled by the inverse of the vectors' covariance (Newton's step) and drawn towards 0 where counts are few. Those sums are exact for any
partitioning. Scores of all contexts and top outcomes are fixed tables with exact normalisers, of
(outcomes + 2) ** 2 numbers.

Counts of frequent tokens (`frequent` at most) are broadcast with the tables and vectors, a fixed size;
counts of the others are joined by token, each document sending one row for each distinct one. Tokens
that stand everywhere are among the frequent ones, so no key of that join is hot.

Null or empty texts are one end. Rows equal in id and text get equal scores, and count as often as they
are there. Without training documents base and model give every token its unseen share. Empty tables
give empty results. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import materialize, row_key, ship, slices, utf8
from sylvan.llm.toxicity import remainder

END = b"\n"  # no word holds a line break
SMOOTHING = 0.1
CLASSES = 256
#: Of the step below the top: its length, and the count at which it is half as long.
RATE, HALF = 0.5, 20.0


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_tokens(train: DataFrame, text_col: str, most: int = 1 << 19) -> DataFrame:
    """token, n over all rows: counted by task in dictionaries of bounded size, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(own)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([own[k] for k in part], pa.int64())], names=["token", "n"])
            own.clear()

        for batch in batches:
            for part in slices(batch, "__sv_text", 4 << 20):
                for text in utf8(part.column(0)):
                    own.update(tokens(text))
                if len(own) > most:
                    yield from out()
        yield from out()

    ship(train.sparkSession)
    rows = train.select(F.col(f"`{text_col}`").alias("__sv_text")).mapInArrow(run, "token binary, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


class Parameters:
    """Embeddings of context tokens, a matrix for each place, output vectors and biases."""

    SHAPES = ("embed", "first", "second", "out", "bias")

    def __init__(self, share: np.ndarray, dim: int, seed: int = 5):
        rng, n = np.random.default_rng(seed), len(share)
        self.embed = rng.normal(0, 0.1, (n + 1, dim)).astype(np.float32)  # the last stands for the text's begin
        self.first = np.eye(dim, dtype=np.float32)
        self.second = np.eye(dim, dtype=np.float32) * np.float32(0.5)
        self.out = rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        self.bias = np.log(share).astype(np.float32)
        self.share, self.seed, self.square = share, seed, {k: np.full_like(getattr(self, k), 1e-3) for k in self.SHAPES}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.SHAPES])

    def load(self, flat: np.ndarray) -> None:
        for k in self.SHAPES:
            old = getattr(self, k)
            setattr(self, k, flat[: old.size].reshape(old.shape).astype(np.float32))
            flat = flat[old.size :]

    def move(self, k: str, rows, grad: np.ndarray, rate: float) -> None:
        square, own = self.square[k], getattr(self, k)
        square[rows] += grad * grad
        own[rows] += rate * grad / np.sqrt(square[rows])

    def learn(self, before: np.ndarray, last: np.ndarray, token: np.ndarray, weight: np.ndarray, rng: np.random.Generator, noise: int = 64, batch: int = 1024, rate: float = 0.3, passes: int = 1, steps: int = 200) -> None:
        """Noise-contrastive estimation over weighted (token two before, token before, token): some passes, and `steps` batches at least."""
        log_noise = np.log(noise * self.share).astype(np.float32)

        def sigmoid(x: np.ndarray) -> np.ndarray:  # in place
            with np.errstate(over="ignore"):  # beyond the range it is 0
                np.exp(np.negative(x, out=x), out=x)
            return np.reciprocal(np.add(x, 1, out=x), out=x)

        cumulative, n = np.cumsum(self.share), len(token)
        for _ in range(max(passes, -(-steps // -(-n // batch)))):
            order = rng.permutation(n)
            for a in range(0, len(order), batch):
                i = order[a : a + batch]
                b2, b1, w, c = before[i], last[i], token[i], weight[i] / weight[i].sum()
                e1, e2, q = self.embed[b1], self.embed[b2], self.out[w]
                context = e1 @ self.first + e2 @ self.second
                z = np.minimum(np.searchsorted(cumulative, rng.random(noise)), len(cumulative) - 1)
                qz = self.out[z]
                real = c * (1 - sigmoid((context * q).sum(1) + self.bias[w] - log_noise[w]))
                false = -c[:, None] * sigmoid(context @ qz.T + self.bias[z] - log_noise[z])
                back = real[:, None] * q + false @ qz
                grads = [("first", slice(None), e1.T @ back), ("second", slice(None), e2.T @ back)]
                grads.append(("embed", *summed(np.concatenate([b1, b2]), np.concatenate([back @ self.first.T, back @ self.second.T]))))
                both = np.concatenate([w, z])
                grads.append(("out", *summed(both, np.concatenate([real[:, None] * context, false.T @ context]))))
                rows, grad = summed(both, np.concatenate([real, false.sum(0)])[:, None])
                grads.append(("bias", rows, grad[:, 0]))
                for k, rows, grad in grads:
                    self.move(k, rows, grad.astype(np.float32), rate)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the token before (with bias) and two before, and log normalisers of all pairs of those."""
        near, far = self.embed @ self.first, self.embed @ self.second
        s1, s2 = near @ self.out.T + self.bias, far @ self.out.T
        norm = np.empty((len(far), len(near)), np.float32)
        for k in range(len(far)):  # a batch: one token two before, all tokens before
            s = s1 + s2[k]
            top = s.max(1)
            norm[k] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return s1, s2, norm


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[starts], np.add.reduceat(values[order], starts)


def contexts(ids: np.ndarray, lengths: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The two outcomes before each of the texts' joined outcomes."""
    last, before = np.append(begin, ids[:-1]), np.append([begin, begin], ids[:-2])[: len(ids)]
    starts = np.cumsum(lengths) - lengths
    last[starts] = begin
    before[starts] = begin
    second = starts[lengths > 1] + 1
    before[second] = begin
    return before, last


class Tree:
    """The vocabulary below the top: classes of tokens that are neighbours, and in each, groups."""

    def __init__(self, counts: np.ndarray, n_classes: int):
        n = len(counts)
        self.counts = counts
        self.of = np.arange(n) * n_classes // max(n, 1)  # the class of each token
        self.start = np.searchsorted(self.of, np.arange(n_classes + 1))
        size = np.diff(self.start)
        self.width = np.maximum(1, np.ceil(3 * np.sqrt(size))).astype(np.int64)  # tokens of a group: matrix products are few and not small
        groups = -(-size // self.width)
        self.first = np.concatenate([[0], np.cumsum(groups)])  # the groups of each class
        self.group = self.first[self.of] + (np.arange(n) - self.start[self.of]) // self.width[self.of]
        self.edge = np.append(np.searchsorted(self.group, np.arange(self.first[-1])), n)  # the tokens of each group

    def fit(self, sums: np.ndarray, total: np.ndarray, products: np.ndarray, n: float) -> Tree:
        """Vectors and biases from the sums of the context vectors of each token; total, products: sums over all n contexts."""
        mean = total / max(n, 1)
        variance = products / max(n, 1) - np.outer(mean, mean)
        metric = np.linalg.inv(variance + np.eye(len(mean)) * (1e-3 * np.trace(variance) / len(mean) + 1e-6))
        starts = self.edge[:-1]
        tops = self.start[:-1]
        group_sums, group_counts = (np.add.reduceat(x, starts, axis=0) if len(starts) else x for x in (sums, self.counts))
        of_group = self.of[starts] if len(starts) else self.of
        class_sums, class_counts = (np.add.reduceat(x, tops, axis=0) if len(tops) else x for x in (sums, self.counts))
        self.group_vectors, self.group_bias = step(group_sums, group_counts, class_sums, class_counts, of_group, metric)
        self.vectors, self.bias = step(sums, self.counts, group_sums, group_counts, self.group, metric)
        return self

    def log_shares(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Log probabilities of tokens within their classes, given context vectors: of the group, and of the token in it."""
        of_group = chosen(self.of[token], self.group[token] - self.first[self.of[token]], context, self.first, self.group_vectors, self.group_bias)
        return of_group + chosen(self.group[token], token - self.edge[self.group[token]], context, self.edge, self.vectors, self.bias)


def step(sums: np.ndarray, counts: np.ndarray, all_sums: np.ndarray, all_counts: np.ndarray, parent: np.ndarray, metric: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and biases after one step of noise-contrastive estimation from zero vectors and smoothed counts.

    Its gradient at a vector is the sum of its contexts less its share of all contexts of the alternatives.
    """
    vectors, bias = np.empty(sums.shape, np.float32), np.empty(len(sums), np.float32)
    for a in range(0, len(sums), 1 << 14):  # a part at a time, to spare memory
        c, k = counts[a : a + (1 << 14)], parent[a : a + (1 << 14)]
        own, middle = sums[a : a + (1 << 14)] / np.maximum(c, 1)[:, None], all_sums[k] / np.maximum(all_counts[k], 1)[:, None]
        part = RATE * (c / (c + HALF))[:, None] * (own - middle) @ metric
        vectors[a : a + (1 << 14)] = part
        bias[a : a + (1 << 14)] = np.log(c + SMOOTHING) - (part * (own + middle) / 2).sum(1)
    return vectors, bias


def chosen(parent: np.ndarray, place: np.ndarray, context: np.ndarray, edge: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log probabilities of the child at a place among a parent's children, which stand together: a matrix product for each parent."""
    order = np.argsort(parent, kind="stable")
    parent, place, context = parent[order], place[order], context[order]
    heads = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(order) else np.arange(0)
    out, total = np.empty(len(parent), np.float64), np.empty(len(parent), np.float32)
    picked = np.empty(len(parent), np.float32)
    for a, b, k in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], parent[heads].tolist(), strict=True):
        s = context[a:b] @ vectors[edge[k] : edge[k + 1]].T
        s += bias[edge[k] : edge[k + 1]]
        s -= s.max(1, keepdims=True)
        picked[a:b] = s[np.arange(b - a), place[a:b]]
        np.exp(s, out=s)
        s.sum(1, out=total[a:b])
    out[order] = picked - np.log(total)
    return out


def context_sums(docs: DataFrame, words, tree: Tree, model: Parameters) -> Tree:
    """The tree fitted to all rows of docs (numbered)."""
    spark, dim = docs.sparkSession, model.embed.shape[1]
    if not len(tree.counts):
        return tree.fit(np.zeros((0, dim)), np.zeros(dim), np.zeros((dim, dim)), 0)
    known = spark.sparkContext.broadcast((tree.start, model.embed @ model.first, model.embed @ model.second))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (start, near, far), own_words = known.value, words.value
        sums, ends = np.zeros((int(start[-1]), dim), np.float32), np.zeros((dim + 2, dim))
        for batch in batches:
            for number, lengths in read_numbers(batch):
                _, before, last, below, at = own_words.placed(number, lengths)[:5]
                for a in range(0, len(at), 1 << 17):
                    own = at[a : a + (1 << 17)]
                    context = near[last[own]] + far[before[own]]
                    rows, added = summed(below[a : a + (1 << 17)], context)
                    sums[rows] += added
                    ends += np.concatenate([[context.sum(0), np.full(dim, len(own))], context.T @ context])
        if ends[1, 0]:
            flat = [ends.tobytes(), *(sums[a:b].tobytes() for a, b in zip(start, start[1:], strict=False))]
            for k, blob in enumerate(flat):  # a row for each class
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["k", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(blob, np.float32 if k else np.float64).astype(np.float64)
                held[k] = held[k] + own if k in held else own
        for k, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(own.astype(np.float32) if k else own).tobytes()], pa.binary())], names=["k", "sums"])

    rows = docs.select("numbers")
    parts = rows.rdd.getNumPartitions()
    if parts > 4 * spark.sparkContext.defaultParallelism:  # fewer sets of sums to add up
        rows = rows.coalesce(parts // 4)
    rows = rows.mapInArrow(add, "k int, sums binary").repartition("k").mapInArrow(total, "k int, sums binary")
    found = {r.k: r.sums for r in rows.collect()}  # dim numbers for each token of the vocabulary, whose size is bounded
    known.destroy()
    if not found:
        return tree.fit(np.zeros((len(tree.counts), dim)), np.zeros(dim), np.zeros((dim, dim)), 0)
    sums = np.concatenate([np.frombuffer(found[k], np.float32).reshape(-1, dim) for k in range(1, len(tree.start))])
    ends = np.frombuffer(found[0]).reshape(dim + 2, dim)
    return tree.fit(sums, ends[0], ends[2:], ends[1, 0])


class Words:
    """The frequent tokens by number: those of the top, those of the tree's classes (of), and others."""

    def __init__(self, numbers: dict[bytes, int], n_top: int, n_out: int, of: np.ndarray):
        self.numbers, self.n_top, self.n_out, self.of = numbers, n_top, n_out, of

    def placed(self, number: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts' joined tokens: top outcomes, those of the two before, places in the tree and where those stand, numbers (-1: none), lengths."""
        ids = np.where((number >= 0) & (number < self.n_top), number, self.n_out - 1)
        at = np.flatnonzero((number >= self.n_top) & (number < self.n_top + len(self.of)))
        below = number[at] - self.n_top
        ids[at] = self.n_top + self.of[below]
        return (ids, *contexts(ids, lengths, self.n_out), below, at, number, lengths)


def numbered(docs: DataFrame, id_col: str, text_col: str, words) -> DataFrame:
    """Rows' keys, their tokens by number, as bytes of 32-bit integers (-1: none), and the tokens without one, by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.value.numbers.get
        for batch in batches:
            for part in slices(batch, "__sv_text", 4 << 20):
                own, rare = [], []
                for text in utf8(part.column(2)):
                    flat = tokens(text)
                    number = np.array([get(w, -1) for w in flat], np.int32)
                    own.append(number.tobytes())
                    rare.append(b"\n".join([flat[i] for i in np.flatnonzero(number < 0).tolist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary()), pa.array(rare, pa.binary())], names=["__sv_id", "__sv_hash", "numbers", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__sv_text"))
    return rows.mapInArrow(run, f"__sv_id {kind}, __sv_hash long, numbers binary, rare binary")


def read_numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the texts of a batch, joined, and their lengths, in parts of bounded size."""
    for part in slices(batch, "numbers", 4 << 20):
        own = [np.frombuffer(x, np.int32) for x in part.column("numbers").to_pylist()]
        yield np.concatenate(own).astype(np.int64), np.array([len(x) for x in own])


def train(docs: DataFrame, words, share: np.ndarray, dim: int, rounds: int = 2) -> Parameters:
    """Parameters learned from all rows of docs (numbered), each in one of the rounds; words: a broadcast of Words without its numbers."""
    model = Parameters(share, dim)
    for k in range(rounds):
        part = docs.filter(F.pmod("__sv_hash", F.lit(rounds)) == k)
        model = train_round(part, words, share, dim, model.flat())
    return model


def train_round(docs: DataFrame, words, share: np.ndarray, dim: int, start: np.ndarray, chunk: int = 1 << 22) -> Parameters:
    """The tasks' parameters, each learned from the same start, averaged by tokens."""
    spark = docs.sparkSession
    known, n = spark.sparkContext.broadcast((share, start)), len(share)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, start = known.value
        own, rng, total = Parameters(share, dim), np.random.default_rng(11), 0
        own.load(start)
        held: list[np.ndarray] = []

        def flush() -> int:
            codes, weight = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            token, rest = codes % n, codes // n
            own.learn(rest // (n + 1), rest % (n + 1), token, weight.astype(np.float32), rng)
            return int(weight.sum())

        for batch in batches:
            for number, lengths in read_numbers(batch):
                ids, before, last, *_ = words.value.placed(number, lengths)
                held.append((before * (n + 1) + last) * n + ids)
                if sum(map(len, held)) >= chunk:
                    total += flush()
        if held:
            total += flush()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([float(total)]), pa.array([(own.flat() * np.float64(total)).astype(np.float64).tobytes()], pa.binary())], names=["n", "flat"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, flat = 0.0, None
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += k
                flat = np.frombuffer(v) if flat is None else flat + np.frombuffer(v)
        if flat is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])

    kind = "n double, flat binary"
    rows = docs.select("numbers")
    parts, rows = rows.rdd.getNumPartitions(), rows.mapInArrow(learn, kind)
    while parts > 32:  # sums of sums, so that each task adds up 16 sets or so
        parts = -(-parts // 16)
        rows = rows.repartition(parts).mapInArrow(add, kind)
    model, total, flat = Parameters(share, dim), 0.0, 0.0
    for r in rows.collect():  # 32 sets at most
        total, flat = total + r.n, flat + np.frombuffer(r.flat)
    model.load(flat / total if total else start)
    return model


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, outcomes: int = 1023, dim: int = 24, frequent: int = 400_000, least_count: int = 5) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; log10 probabilities of whole texts."""
    spark = ship(docs.sparkSession)
    training = docs.filter(remainder(id_col, fold) != 0)
    counts = materialize(count_tokens(training, text_col), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the frequent tokens: those whose count's bin lies above the bins that hold too many
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    bins, held, least = counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("c")).orderBy(F.desc("b")).collect(), 0, 1 << 30  # about 64 * 16 at most
    for r in bins:
        held += r.c
        if held > frequent:
            break
        least = r.b
    top = counts.filter(bin_ >= least).select("token", "n").toArrow()
    rows = sorted(zip(top["token"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    del top
    end = next((c for w, c in rows if w == END), 0) or (counts.filter(F.col("token") == F.lit(END)).agg(F.sum("n")).first()[0] or 0)
    rows = [r for r in rows if r[0] != END]
    most = min(CLASSES, outcomes // 4)
    heads, others = rows[: outcomes - most], rows[outcomes - most :]
    below = sorted(r for r in others if r[1] >= least_count)
    n_classes = min(most, -(-len(below) // 8))
    rows = [(END, end), *heads, *below, *(r for r in others if r[1] < least_count)]
    n_top, n_below = 1 + len(heads), len(below)
    n_out = n_top + n_classes + 1  # the end, the frequent tokens, the classes, the class of all others
    numbers, amounts = {w: i for i, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], np.float64)
    del rows, heads, others, below
    tree = Tree(amounts[n_top : n_top + n_below], n_classes)
    share = np.zeros(n_out)
    share[:n_top] = amounts[:n_top]
    share[n_top:-1] = np.bincount(tree.of, tree.counts, n_classes)
    rest = total - share.sum()
    share[-1] = rest
    share = (share + 0.5) / (share + 0.5).sum()
    words = spark.sparkContext.broadcast(Words(numbers, n_top, n_out, tree.of))
    n_inside = int((amounts[: n_top + n_below] > 0).sum())
    del numbers
    every = materialize(numbered(docs, id_col, text_col, words), "numbers")
    words.destroy()
    training = every.filter(remainder("__sv_id", fold) != 0)
    places = spark.sparkContext.broadcast(Words({}, n_top, n_out, tree.of))
    model = train(training, places, share, dim)
    tree = context_sums(training, places, tree, model)
    base_norm = math.log10(total + SMOOTHING * (distinct + 1))
    rest_norm = math.log10(rest + SMOOTHING * (max(0, distinct - n_inside) + 1))
    vectors = (model.embed @ model.first, model.embed @ model.second)
    known = spark.sparkContext.broadcast((amounts, tree, vectors, model.tables()))
    names = ["__sv_id", "__sv_hash", "token", "times", "n_tokens", "n_known", "log_counts", "log_model", "n_rest", "n_rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, tree, (near, far), (s1, s2, norm) = known.value
        logs, ln10 = np.log10(count + SMOOTHING), math.log(10)
        for batch in batches:
            for part in slices(batch, "numbers", 3 << 20):
                own_numbers = [np.frombuffer(x, np.int32) for x in part.column(2).to_pylist()]
                ids, before, last, below, member, at, lengths = places.value.placed(np.concatenate(own_numbers).astype(np.int64), np.array([len(x) for x in own_numbers]))
                starts = np.cumsum(lengths) - lengths
                logp = (s1[last, ids] + s2[before, ids] - norm[before, last]).astype(np.float64)
                for a in range(0, len(member), 1 << 20):
                    own = member[a : a + (1 << 20)]
                    logp[own] += tree.log_shares(below[a : a + (1 << 20)], near[last[own]] + far[before[own]])
                logp /= ln10
                seen = at >= 0
                sums = lambda x: np.add.reduceat(x, starts)
                found = np.where(seen, logs[np.maximum(at, 0)], 0.0)
                known_ = seen & (count[np.maximum(at, 0)] > 0)
                doc = [pa.array(lengths), pa.array(sums(known_.astype(np.int64))), pa.array(sums(found)), pa.array(sums(logp)), pa.array(sums((ids == n_out - 1).astype(np.int64)))]
                # of the class's tokens only the share within the class counts, added below; others have none
                inner = pa.array(sums(np.where((ids == n_out - 1) & seen, found, 0.0)))
                owner, rare, times = [], [], []
                for d, lines in enumerate(part.column(3).to_pylist()):
                    if lines:
                        once = Counter(lines.split(b"\n"))
                        owner += [d] * len(once)
                        rare += once
                        times += once.values()
                n, m = part.num_rows, len(owner)
                take = pa.array([*range(n), *owner], pa.int64())
                empty = pa.nulls(m, pa.int64())
                real = pa.nulls(m, pa.float64())
                unique = [b"\n" + str(i).encode() + b":" + str(h).encode() for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                join = lambda a, b: pa.concat_arrays([a, b])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array([*unique, *rare], pa.binary()), pa.array([0] * n + times, pa.int64()), join(doc[0], empty), join(doc[1], empty), join(doc[2], real), join(doc[3], real), join(doc[4], empty), join(inner, real), pa.array([1] * n + [0] * m, pa.int64())],
                    names=[*names[:-1], "log_rest", "n_rows"],
                )

    columns = f"__sv_id {every.schema['__sv_id'].dataType.simpleString()}, __sv_hash long, token binary, times long, n_tokens long, n_known long, log_counts double, log_model double, n_rest long, log_rest double, n_rows long"
    parts = every.mapInArrow(run, columns)
    scored = parts.join(counts.filter(bin_ < least), "token", "left")
    of_rare = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)
    scored = scored.groupBy("__sv_id", "__sv_hash").agg(
        F.sum("n_rows").alias("rows"), F.sum("n_tokens").alias("t"), F.sum("n_rest").alias("r"), F.sum("log_model").alias("m"),
        (F.coalesce(F.sum("n_known"), F.lit(0)) + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("k"),
        (F.sum("log_counts") + F.sum(of_rare)).alias("c"), (F.sum("log_rest") + F.sum(of_rare)).alias("q"),
    )
    one = lambda c: F.col(c) / F.col("rows")  # noqa: E731  of rows that are there several times
    scored = scored.withColumn("__sv_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return scored.select(
        F.col("__sv_id").alias(id_col), (remainder("__sv_id", fold) == 0).alias("held_out"), one("t").cast("long").alias("n_tokens"), one("k").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (one("c") - one("t") * base_norm).alias("base_score"),
        (one("m") + one("q") - one("r") * rest_norm).alias("score"),
    )
