"""Benchmark decontamination with suffix arrays over the training text.

Every task folds its documents into shards of word ids and builds the suffix array of each shard by
prefix doubling, over the stretches that can match (a word goes only if no run of neighbouring word
pairs of the benchmark that is as long as the shortest window holds it, so no match is lost). Every
benchmark suffix is then binary-searched in it: the interval of training suffixes that begin with its
window holds all its occurrences, and its own place gives each training suffix its nearest benchmark
suffixes on both sides, one of which shares the longest verbatim match that starts there.

Work and memory go by the places found, never by pairs of places and items: intervals are marked by
sums of their ends, windows with the same items are one class, and documents meet classes, then the
items of each. Of each longest match one benchmark place is named, though several items may hold it;
`items` names all items with a window in the document.

The benchmark is read in blocks of bounded size, each searched in turn inside the task, so neither
driver nor executor holds more than one block; documents are never shuffled.

Null texts have no words. Items of null id are searched like others: their matches count as hit words
and have a null item_id, and only `items` doesn't name them. Repeated rows give repeated results;
items with equal texts all count. A document or item of no words matches nothing; empty tables give
empty or clean results. Very long texts are cut nowhere: a document is always within one shard. Only
the id and text columns are read for the search, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import materialize, ship, utf8

#: Lower-cases A-Z and turns all ASCII but letters and digits into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of runs of ids, each run closed by a 0, in their order: prefix doubling."""
    places = np.flatnonzero(text)
    end = np.flatnonzero(text == 0)
    end = end[np.searchsorted(end, places)] if len(places) else places
    rank, k = np.zeros(len(text), np.int64), 1
    rank[places] = text[places]
    longest = int((end - places).max(initial=0))
    while True:
        _, own = np.unique(rank[places], return_inverse=True)
        rank[places] = own + 1
        if k >= longest or len(own) == 0 or own.max() + 1 == len(own):
            return places[np.argsort(rank[places], kind="stable")]
        second = np.zeros(len(places), np.int64)
        more = places + k < end
        second[more] = rank[places[more] + k]
        rank[places] = rank[places] * (len(places) + 1) + second
        k *= 2


def compare(text: np.ndarray, p: np.ndarray, other: np.ndarray, b: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes of two texts, up to so many words: the sign of their order, and the words they share."""
    sign, shared = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    open_, k = np.flatnonzero(limit > 0), 0
    while len(open_):
        x, y = text[p[open_] + k], other[b[open_] + k]
        sign[open_] = np.sign(x - y)
        k += 1
        same = (x == y) & (x > 0)
        shared[open_[same]] = k
        open_ = open_[same & (limit[open_] > k)]
    return sign, shared


def bound(text: np.ndarray, array: np.ndarray, other: np.ndarray, b: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in a suffix array: the first place whose suffix isn't before, or is after, each other suffix up to its limit."""
    low, high = np.zeros(len(b), np.int64), np.full(len(b), len(array), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        sign, _ = compare(text, array[middle], other, b[open_], limit[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


class Block:
    """A block of benchmark items: their text as word ids, its suffix array, word pairs, and distinct windows with their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        parts, start, at = [], [], 0
        windows: dict[bytes, tuple[int, int, set[int]]] = {}
        pairs = set()
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            pairs.update(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1 if length else 0):
                windows.setdefault(ids[i : i + length].tobytes(), (at + i, length, set()))[2].add(k)
            start.append(at)
            at += len(ids) + 1
            parts += [ids, [0]]
        self.text = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        self.start = np.array(start, np.int64)
        self.array = suffix_array(self.text)
        self.base = len(self.vocabulary) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.places = np.array([p for p, _, _ in windows.values()], np.int64)
        self.lengths = np.array([n for _, n, _ in windows.values()], np.int64)
        classes: dict[tuple, int] = {}
        self.of_window = np.array([classes.setdefault(tuple(sorted(own)), len(classes)) for _, _, own in windows.values()], np.int64)
        self.classes = list(classes)  # the items of each

    def alive(self, ids: np.ndarray) -> np.ndarray:
        """Which words of a shard stand in runs of benchmark pairs as long as the shortest window."""
        least = int(self.lengths.min(initial=1 << 40))
        if least == 1 or not len(self.lengths):
            return ids > 0 if len(self.lengths) else np.zeros(len(ids), bool)
        code = ids[:-1] * self.base + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        joined = np.concatenate([[False], (ids[:-1] > 0) & (ids[1:] > 0) & (self.pairs[at] == code), [False]])  # to the word before
        head = np.flatnonzero(~joined[:-1])
        run = np.diff(np.append(head, len(ids)))
        return np.repeat(run >= least, run) & (ids > 0)

    def search(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a shard (documents of word ids with a 0 after each) whose words belong to owner.

        Gives marks to add up over the words (above 0: hit), rows of (document, class of items), and rows of
        (place, benchmark place, words): the longest match from each place where one starts, without those
        that another holds.
        """
        cover, none = np.zeros(len(ids) + 1, np.int64), np.zeros((0, 3), np.int64)
        own = np.flatnonzero(self.alive(ids))
        if not len(own):
            return cover, none[:, :2], none
        gap = np.concatenate([[0], np.cumsum(np.diff(own) > 1)])  # a 0 closes each stretch
        text = np.zeros(len(own) + gap[-1] + 1, np.int64)
        text[np.arange(len(own)) + gap] = ids[own]
        origin = np.zeros(len(text), np.int64)
        origin[np.arange(len(own)) + gap] = own
        array = suffix_array(text)
        low = bound(text, array, self.text, self.places, self.lengths, False)
        high = bound(text, array, self.text, self.places, self.lengths, True)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return cover, none[:, :2], none
        starts = np.zeros(len(array), bool)  # suffixes that begin with a window
        rows = []
        for length in np.unique(self.lengths[hit]):
            chosen = hit[self.lengths[hit] == length]
            n = high[chosen] - low[chosen]  # windows of one length differ, so their intervals are apart
            suffix = np.repeat(low[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = origin[array[suffix]]
            starts[suffix] = True
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            rows.append(np.unique(owner[place] * len(self.classes) + np.repeat(self.of_window[chosen], n)))
        rows = np.unique(np.concatenate(rows))
        # the benchmark suffixes' own places, in order: the ones before and after a training suffix share most with it
        order = bound(text, array, self.text, self.array, np.full(len(self.array), len(text) + 1), True)
        suffix = np.flatnonzero(starts)
        after = np.searchsorted(order, suffix, "right")
        best, where = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
        for beside in (after - 1, after):
            real = np.flatnonzero((beside >= 0) & (beside < len(self.array)))
            b = self.array[beside[real]]
            _, shared = compare(text, array[suffix[real]], self.text, b, np.full(len(real), len(text) + 1))
            better = shared > best[real]
            best[real[better]], where[real[better]] = shared[better], b[better]
        place = origin[array[suffix]]
        by = np.argsort(place)
        place, where, best = place[by], where[by], best[by]
        fresh = place + best > np.concatenate([[-1], np.maximum.accumulate(place + best)[:-1]])
        return cover, np.stack([rows // len(self.classes), rows % len(self.classes)], 1), np.stack([place[fresh], where[fresh], best[fresh]], 1)


def scan(texts: list[list[bytes]], blocks: list) -> tuple[list[int], list[list[str]], list[list[tuple]]]:
    """Of the documents of a shard: hit words, names of items, and the matches as (item, document word, item word, words)."""
    n = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(n + 1)])
    owner = np.repeat(np.arange(len(texts)), n + 1)
    cover = np.zeros(start[-1] + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    matches: list[list[tuple]] = [[] for _ in texts]
    for source in blocks:
        block: Block = source.value
        get = block.vocabulary.get
        ids = np.zeros(start[-1], np.int64)
        for s, t in zip(start, texts, strict=False):
            ids[s : s + len(t)] = [get(w, 0) for w in t]
        marks, classes, found = block.search(ids, owner)
        cover += marks
        for d, c in classes.tolist():
            items[d].update(block.names[k] for k in block.classes[c])
        of = np.searchsorted(block.start, found[:, 1], "right") - 1
        for d, k, (p, b, m) in zip(owner[found[:, 0]].tolist(), of.tolist(), found.tolist(), strict=True):
            matches[d].append((block.names[k], p - int(start[d]), b - int(block.start[k]), m))
        if len(blocks) > 1:  # keep one block in memory at a time
            source.__dict__.pop("_value", None)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    return [int(inside[s + m] - inside[s]) for s, m in zip(start, n, strict=False)], [sorted(own - {None}) for own in items], matches


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of about block_bytes of text; the driver holds one at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    out = []
    if n > 1:  # written in the order of blocks once, so that reading one skips the others
        rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        rows = materialize(rows.repartitionByRange(n, "block").sortWithinPartitions("block"), "benchmark")
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.col("block") == k)
        out.append(spark.sparkContext.broadcast(Block([(r.item, bytes(r.text)) for r in own.collect()], window)))
    return out


def find_matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = 10, shard_words: int = 1 << 20, block_bytes: int = 8 << 20, keep: bool = False,
) -> DataFrame:
    """id, n_words, n_hit, items (sorted strings), matches of every document.

    matches: array of (item_id, doc_word, item_word, n_words), the longest verbatim matches of at least
    `window` words (or of a whole shorter item), one for each stretch that no longer match from the left
    holds, places counted from 0. keep: all columns of docs come
    along, named as they are, before those of the search, whose names then start with __sv_.
    """
    ship(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, item_col, item_text, window, block_bytes)
    found = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

    def result(rows: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        hits, items, matches = scan(texts, blocks)
        n = [len(t) for t in texts]
        cells = [[dict(zip(("item_id", "doc_word", "item_word", "n_words"), m, strict=True)) for m in sorted(own, key=lambda m: (m[1], m[0] is None, m[0] or "", *m[2:]))] for own in matches]
        more = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(cells, found)]
        at = 0
        for batch in rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(m.slice(at, batch.num_rows) for m in more)], names=names)
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, total = [], [], 0
        for batch in batches:
            at = 0
            for i, text in enumerate(utf8(batch.column(batch.num_columns - 1))):
                own = words(text)
                texts.append(own)
                total += len(own)
                if total >= shard_words:
                    rows.append(batch.slice(at, i + 1 - at))
                    yield from result(rows, texts)
                    rows, texts, total, at = [], [], 0, i + 1
            if at < batch.num_rows:
                rows.append(batch.slice(at))
        if texts:
            yield from result(rows, texts)

    prefix = "__sv_" if keep else ""
    kept = docs.columns if keep else [id_col]
    source = docs.select(*(F.col(f"`{c}`").alias(f"__sv_{i}") for i, c in enumerate(kept)), F.col(f"`{text_col}`").alias("__sv_text"))  # any name may come, a dot in it too
    new = ("n_words", "n_hit", "items", "matches")
    names = [*source.columns[:-1], *new]
    kinds = [*(source.schema[i].dataType.simpleString() for i in range(len(kept))), "long", "long", "array<string>", "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"]
    out = source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.select(*(F.col(f"__sv_{i}").alias(c) for i, c in enumerate(kept)), *(F.col(c).alias(f"{prefix}{c}") for c in new))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, that hold no window of any benchmark item."""
    found = find_matches(docs, benchmark, keep=True, **options)
    return found.filter("__sv_n_hit = 0").select(*(f"`{c}`" for c in docs.columns))


#: The digest of the query as DuckDB SQL, for ids that are there once.
ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), h AS (
  SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
