"""SimHash near-dedup with a Gray-order hierarchical index over fingerprints.

A fingerprint is the majority of the bits of the XXH64 hashes of a text's word shingles. Fingerprints
link at `distance` or fewer differing bits. Of distance + 1 equal blocks of bits two linked
fingerprints share one at least, so each distinct fingerprint goes, once a block, to the group of
those that agree in it; a group beyond `most` is dealt again by blocks of its other bits, and one that
is still beyond it in pieces of which each two are searched together. Groups of any size are searched
alike: fingerprints are sorted by Gray rank and every `fan` neighbours of a group become a node that
holds the bits on which they agree, and so on upwards; a search adds up differences from the top, drops
a whole node once they exceed the distance or once it is of the searching fingerprint's component, and
takes a whole node once they can't. A group returns a spanning forest of its links, never pairs; links
of all groups join into components by rounds of minima. Nothing is sampled or capped, and no list of
fingerprints, links or components is collected.

Wide fingerprints (`wide=True`) have 256 bits and link at WIDE_DISTANCE, which catches pairs of Jaccard
similarity 0.8; they meet by sampled bits, and the same index searches their groups.

Copies share a fingerprint and enter the search once. Texts of fewer words than a shingle are one
shingle; null and empty texts have fingerprint 0, which links like any other. Repeated rows give
repeated results. A component's id is the least id in it; null ids don't count, and a component of
null ids only has a null id. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import materialize, row_key, ship, slices, utf8
from sylvan.llm.graph import components

#: The bits of a byte, each in a byte of its own.
LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [joined[a : b - 1] for a, b in zip([0, *ends], ends[k - 1 :], strict=False)]


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th hash of each shingle, made from its first: SplitMix64's steps."""
    if n:
        h = h + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprints(texts: list[bytes], k: int = 3, seed: int = 42, wide: int = 1) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers; wide: that many numbers each, as columns."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        own = shingles(text, k)
        sizes.append(len(own))
        hashes += [digest(s, seed) for s in own]
    out, n = np.zeros((len(texts), wide), np.uint64), np.array(sizes, np.int64)
    full = np.flatnonzero(n)
    if len(full):
        n = n[full]
        parts = -(-n // 255)  # as many as a lane can count
        starts = np.concatenate([s + 255 * np.arange(p) for s, p in zip(np.cumsum(n) - n, parts, strict=True)])
        heads = np.cumsum(parts) - parts
        first = np.array(hashes, np.uint64)
        for w in range(wide):
            h = mixed(first, w).view(np.uint8).reshape(-1, 8)
            counts = np.concatenate([np.add.reduceat(np.add.reduceat(LANES[h[:, j]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64), heads) for j in range(8)], 1)
            out[full, w] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out if wide > 1 else out[:, 0]


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, batch_bytes: int = 4 << 20) -> DataFrame:
    """__sv_id, __sv_hash (of the text) and fingerprint (a long) of every row. No shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__sv_text", batch_bytes):
                own = fingerprints(utf8(part.column("__sv_text")), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own)], names=["__sv_id", "__sv_hash", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__sv_text"))
    return rows.mapInArrow(run, f"__sv_id {kind}, __sv_hash long, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order; of codes of several words (columns), the place as as many words, highest first."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    if out.ndim > 1:  # a word whose higher words have odd parity counts down
        odd = np.bitwise_xor.accumulate(out & np.uint64(1), 1)
        out[:, 1:] ^= np.where(odd[:, :-1] > 0, ~np.uint64(0), np.uint64(0))
    return out


class Forest:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each a and b: roots hook to lesser roots until nothing changes."""
        parent = self.parent
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up


def bits(x: np.ndarray) -> np.ndarray:
    """Bits set in each row."""
    return np.bitwise_count(x).sum(1, dtype=np.int64)


class Index:
    """Codes (rows of words) in Gray order within groups, under nodes of `fan` neighbours with the bits they share.

    Rows of a group stand together; each group is a tree of its own, of as many levels as it needs.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, distance: int, fan: int = 8):
        self.codes, self.distance = codes, distance
        n = len(codes)
        self.levels: list[dict[str, np.ndarray]] = []  # from the leaves
        self.root = np.full(n, -1)  # of each code's group: level and node, as level + LEVELS * node
        low = high = codes
        own, first, last = group, np.arange(n), np.arange(n)
        head = np.arange(n)  # the items' places in the level below
        while True:
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            size = np.diff(np.append(start, len(own)))
            many = np.repeat(size > 1, size)
            alone = np.flatnonzero(~many)
            if self.levels:  # what stands alone here is its group's root
                span = last[alone] - first[alone] + 1
                self.root[np.repeat(first[alone], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)] = np.repeat(len(self.levels) - 1 + LEVELS * head[alone], span)
            if not many.any():
                break
            place = (np.arange(len(own)) - np.repeat(start, size))[many]
            own, first, last, low, high, below = own[many], first[many], last[many], low[many], high[many], head[many]
            cut = np.flatnonzero(place % fan == 0)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            mask = ~(low ^ high)
            count = np.diff(np.append(cut, len(place)))
            above = np.repeat(np.arange(len(cut)), count)
            fresh = mask.copy()  # bits that the node above doesn't share
            if self.levels:
                self.levels[-1]["fresh"][below] &= ~mask[above]
            own, first, last = own[cut], first[cut], last[cut + count - 1]
            self.levels.append({"mask": mask, "value": low & mask, "fresh": fresh, "below": below[cut], "count": count, "first": first, "last": last})
            head = np.arange(len(cut))

    def link(self, forest: Forest, block: int = 1 << 16, step: int = 1 << 14) -> None:
        """Join each code with those after it in its group within the distance."""
        for level in self.levels:  # neighbours that differ in so few bits all link
            for k in np.flatnonzero(bits(~level["mask"]) <= self.distance):
                inside = np.arange(level["first"][k] + 1, level["last"][k] + 1)
                forest.union(inside, inside - 1)
        self.neighbours(forest)
        inner = np.flatnonzero(self.root >= 0)
        for a in range(0, len(inner), step):
            query = inner[a : a + step]
            own = forest.roots(np.arange(len(self.codes)))
            for level in self.levels:  # nodes of one component
                edges = np.stack([level["first"], level["last"] + 1], 1).ravel()
                low, high = (f.reduceat(np.append(own, own[-1]), edges)[::2] for f in (np.minimum, np.maximum))
                level["one"] = np.where(low == high, low, -1)
            at, node = self.root[query] % LEVELS, self.root[query] // LEVELS
            stack = [(k, query[at == k], node[at == k], np.zeros((at == k).sum(), np.int64)) for k in range(len(self.levels))]
            while stack:
                k, q, node, seen = stack.pop()
                if len(q) > block:
                    stack.append((k, q[block:], node[block:], seen[block:]))
                if len(q):
                    self.step(k, q[:block], node[:block], seen[:block], own, forest, stack)

    def neighbours(self, forest: Forest) -> None:
        """Links of codes that are next to each other: not needed, but nodes of one component needn't be searched then."""
        for shift in (1, 2, 3):
            a = np.flatnonzero(self.root[:-shift] >= 0) if len(self.codes) > shift else np.arange(0)
            a = a[self.root[a] == self.root[a + shift]]
            forest.union(*near(self.codes, a, a + shift, self.distance))

    def step(self, k: int, q: np.ndarray, node: np.ndarray, seen: np.ndarray, own: np.ndarray, forest: Forest, stack: list) -> None:
        level = self.levels[k]
        keep = (level["last"][node] > q) & (level["one"][node] != own[q])
        q, node, seen = q[keep], node[keep], seen[keep]
        seen = seen + bits((self.codes[q] ^ level["value"][node]) & level["fresh"][node])
        keep = seen <= self.distance
        q, node, seen = q[keep], node[keep], seen[keep]
        whole = seen + bits(~level["mask"][node]) <= self.distance
        forest.union(q[whole], level["first"][node[whole]])
        q, node, seen = q[~whole], node[~whole], seen[~whole]
        count = level["count"][node]
        child = np.repeat(level["below"][node] - np.cumsum(count) + count, count) + np.arange(count.sum())
        q = np.repeat(q, count)
        if k:
            stack.append((k - 1, q, child, np.repeat(seen, count)))
            return
        later = (child > q) & (own[child] != own[q])
        forest.union(*near(self.codes, q[later], child[later], self.distance))


LEVELS = 32


def near(codes: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of codes, those that differ in so many bits at most; words are counted until it's clear."""
    count = np.zeros(len(a), np.int64)
    for k in range(codes.shape[1]):
        word = np.ascontiguousarray(codes[:, k])
        count += np.bitwise_count(word[a] ^ word[b])
        keep = count <= distance
        a, b, count = a[keep], b[keep], count[keep]
    return a, b


def group_links(codes: np.ndarray, group: np.ndarray, distance: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the links within groups; rows of a group stand together."""
    rank = gray_rank(codes)
    order = np.lexsort((*rank.T[::-1], group))
    forest = Forest(len(codes))
    Index(codes[order], group[order], distance).link(forest, **options)
    root = forest.roots(np.arange(len(codes)))
    linked = root != np.arange(len(codes))
    return order[linked], order[root[linked]]


def searched(rows: DataFrame, codes: list[str], distance: int, most: int, buffer: int) -> DataFrame:
    """a, b: links within each key of rows (key, fingerprint, and the columns of its code).

    A key of more than `most` fingerprints is cut into pieces of half as many, and each two pieces are
    searched together, so none of its links is lost; the rows of a key of n fingerprints are then read
    2 n / most times.
    """
    ship(rows.sparkSession)

    def flush(group: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = group_links(words, group, distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append((columns[0], columns[1], np.stack(columns[2:], 1).view(np.uint64)))
            total += batch.num_rows
            if total >= buffer:  # all but the last group is complete
                group, ids, words = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(group, group[-1])
                if cut:
                    yield from flush(group[:cut], ids[:cut], words[:cut])
                held, total = [(group[cut:], ids[cut:], words[cut:])], len(ids) - cut
        if total:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    own = ["fingerprint", *(c for c in codes if c != "fingerprint")]
    crowded = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "crowded")
    if crowded.take(1):
        crowded = crowded.select("key", F.ceil(F.col("n") * 2 / most).cast("int").alias("pieces"))
        rows = rows.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, "key", "left")
        rows = rows.withColumn("piece", F.pmod(F.xxhash64("fingerprint"), "pieces").cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: p != F.col("piece"))
        cells = F.transform(others, lambda p: F.xxhash64("key", F.least(p, "piece"), F.greatest(p, "piece")))
        rows = rows.withColumn("key", F.explode(F.when(F.col("pieces").isNull(), F.array("key")).otherwise(cells)))
    rows = rows.select("key", *own).repartition("key").sortWithinPartitions("key")
    return rows.select("key", "fingerprint", *(F.col(c).alias(f"c{i}") for i, c in enumerate(codes))).mapInArrow(run, "a long, b long")


def keyed(rows: DataFrame, distance: int, most: int) -> DataFrame:
    """rows (fingerprint) once for each block of bits: fingerprint, group (a struct that tells groups apart)."""
    n = distance + 1
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda a, b: F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    first = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), part(a, b).alias("key")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))))
    rows = rows.select("fingerprint", first.alias("g")).select("fingerprint", "g.t", "g.key")
    crowded = materialize(rows.groupBy("t", "key").count().filter(F.col("count") > most).select("t", "key", F.lit(1).alias("again")), "crowded")
    if not crowded.take(1):
        return rows.select("fingerprint", F.struct("t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2")).alias("group"))
    if crowded.count() <= 100_000:
        crowded = F.broadcast(crowded)
    rows = rows.join(crowded, ["t", "key"], "left")
    whole = F.array(F.struct(F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2")))
    again = F.lit(None)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):  # the bits outside block i, cut anew
        rest = [x for x in range(64) if not a <= x < b]
        own = []
        for j in range(n):
            chosen = rest[len(rest) * j // n : len(rest) * (j + 1) // n]
            own.append(F.struct(F.lit(j).alias("t2"), F.col("fingerprint").bitwiseAND(F.lit(np.uint64(sum(1 << x for x in chosen)).view(np.int64).item())).alias("key2")))
        again = F.when(F.col("t") == i, F.array(*own)).otherwise(again)
    rows = rows.select("fingerprint", "t", "key", F.explode(F.when(F.col("again").isNull(), whole).otherwise(again)).alias("g"))
    return rows.select("fingerprint", F.struct("t", "key", "g.t2", "g.key2").alias("group"))


def links(prints: DataFrame, *, distance: int = 3, most: int = 200_000, buffer: int = 1 << 18) -> DataFrame:
    """a, b: links that join the distinct fingerprints of each component; prints: distinct fingerprint."""
    # groups are told apart by a 64-bit hash; two that share it are only compared for nothing
    rows = keyed(prints, distance, most).select("fingerprint", F.xxhash64("group").alias("key"))
    return searched(rows, ["fingerprint"], distance, most, buffer)


#: Of wide fingerprints: their 64-bit words, the tables of sampled bits, and the differing bits of 256 at which they
#: link. Texts of similarity 0.8 (Jaccard, of five-word shingles) differ in 256 / pi * acos(2 * 0.8 / 1.8) = 39 bits on
#: average, with a deviation of 6, so 48 bits catch more than nine in ten of them. LEAST_BITS are sampled for a table, of
#: which there are TABLES then.
WIDE, TABLES, WIDE_DISTANCE, LEAST_BITS = 4, 40, 48, 14


def meeting(bits: int, distance: int) -> float:
    """The chance that fingerprints which differ in `distance` wide bits agree in so many sampled ones, short of 0 and 1."""
    chance = math.prod(max(0, 64 * WIDE - distance - i) / (64 * WIDE - i) for i in range(bits))
    return min(max(chance, 1e-300), 1 - 1e-9)


def sampled_bits(n: int, distance: int) -> list[np.ndarray]:
    """The bits sampled for each table of n fingerprints.

    The bits grow so that a key holds 2 ** 8 fingerprints by chance at most, and the tables with them so
    that two at the distance meet in one of them as often as in TABLES tables of LEAST_BITS.
    """
    many = max(LEAST_BITS, n.bit_length() - 8)
    tables = math.ceil(TABLES * math.log1p(-meeting(LEAST_BITS, distance)) / math.log1p(-meeting(many, distance)))
    rng = np.random.default_rng(17)
    return [rng.choice(64 * WIDE, many, replace=False) for _ in range(tables)]


def wide_fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, batch_bytes: int = 4 << 20) -> DataFrame:
    """__sv_id, __sv_hash, fingerprint (a hash of the words) and words w0, w1, ... of every row. No shuffle."""
    ship(docs.sparkSession)
    names = [f"w{i}" for i in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__sv_text", batch_bytes):
                own = fingerprints(utf8(part.column("__sv_text")), words, wide=WIDE).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(own[:, i])) for i in range(WIDE))], names=["__sv_id", "__sv_hash", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__sv_text"))
    rows = rows.mapInArrow(run, f"__sv_id {kind}, __sv_hash long, " + ", ".join(f"{n} long" for n in names))
    return rows.withColumn("fingerprint", F.xxhash64(*names))


def wide_links(prints: DataFrame, *, distance: int = WIDE_DISTANCE, buffer: int = 1 << 17, most: int = 200_000) -> DataFrame:
    """a, b: links between fingerprints at `distance` or fewer of the wide bits; prints: distinct fingerprint, w0, ...

    Fingerprints meet in tables by sampled bits, whose number of tables grows with that of the bits, so
    that the chance of a meeting doesn't depend on the number of fingerprints.
    """
    chosen = sampled_bits(prints.count(), distance)
    names = [f"w{i}" for i in range(WIDE)]

    def sampled(t: int, own: np.ndarray):
        masks = [int(np.bitwise_or.reduce([np.uint64(1) << np.uint64(b % 64) for b in own if b // 64 == w] or [np.uint64(0)]).view(np.int64)) for w in range(WIDE)]
        return F.xxhash64(F.lit(t), *(F.col(n).bitwiseAND(F.lit(m)) for n, m in zip(names, masks, strict=True)))

    keys = [sampled(t, own) for t, own in enumerate(chosen)]
    return searched(prints.select(F.explode(F.array(*keys)).alias("key"), "fingerprint", *names), names, distance, most, buffer)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, wide: bool = False, **options) -> DataFrame:
    """__sv_id, __sv_hash, fingerprint, component_id of every row.

    wide: fingerprints of 256 bits, and `distance` of those (see WIDE_DISTANCE); fingerprint is then their hash.
    """
    more = [f"w{i}" for i in range(WIDE)] if wide else []
    rows = materialize((wide_fingerprint if wide else fingerprint)(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("__sv_id").alias("least"), *(F.any_value(c).alias(c) for c in more)), "prints")
    found = (wide_links if wide else links)(prints.select("fingerprint", *more), distance=distance, **options)
    roots = components(materialize(found, "links"))
    roots = materialize(roots.join(prints, roots.node == prints.fingerprint).select("node", "root", "least"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select(F.col("node").alias("fingerprint"), "component")
    labels = prints.join(linked.withColumn("linked", F.lit(True)), "fingerprint", "left").select("fingerprint", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(labels, "fingerprint").select("__sv_id", "__sv_hash", "fingerprint", "component_id")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, in their own columns, one of each component: the one with the least id, then text hash.

    A component of null ids keeps the least text hash. Of rows equal in id and text one stays.
    """
    rows = materialize(classes(docs, id_col=id_col, text_col=text_col, **options), "classes")
    order = F.struct(F.col("__sv_id").isNull().alias("none"), "__sv_id", "__sv_hash")
    named = rows.filter("component_id is not null").groupBy("component_id").agg(F.min(order).alias("k"))
    nameless = rows.filter("component_id is null").groupBy("fingerprint").agg(F.min(order).alias("k"))
    stay = named.select("k").unionByName(nameless.select("k")).select(F.col("k.__sv_id").alias("__sv_stay_id"), F.col("k.__sv_hash").alias("__sv_stay_hash")).distinct()
    own = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), ("__sv_own_id", "__sv_own_hash"), strict=True)))
    kept = own.join(stay, F.col("__sv_own_id").eqNullSafe(F.col("__sv_stay_id")) & (F.col("__sv_own_hash") == F.col("__sv_stay_hash")), "left_semi")
    n = rows.agg(F.count("*").alias("n"), F.count_distinct(F.struct("__sv_id", "__sv_hash")).alias("d")).first()
    if n.n != n.d:  # repeated rows
        kept = kept.dropDuplicates(["__sv_own_id", "__sv_own_hash"])
    return kept.select(*(f"`{c}`" for c in docs.columns))
