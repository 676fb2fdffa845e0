"""SimHash fingerprints and their links, found with a hierarchical index in Gray order.

Fingerprints that differ in at most LINK_BITS of 64 bits agree in one of LINK_BITS + 1 bands, so every
distinct fingerprint is dealt to one shard for each band by the band's bits. A shard sorts what it has
by Gray rank, in which neighbours share most bits, and builds a tree over it: a node keeps the bits
that all below it share, an inner node those of its whole group. Two nodes are compared by the bits
that both have settled; only bits settled since their parents are added, and a pair of groups goes as
soon as the differences so far exceed the limit. What is left at the leaves is compared exactly.

A shard answers with a forest, one row at most for each of its fingerprints, not with its pairs, and
groups in which all is linked already are skipped. Forests of all shards meet in a distributed
connected-components loop, or on the driver while they have FEW_LINKS links at most. A shard of more than HOT_SHARD distinct fingerprints is dealt out again by
bands of the bits that its fingerprints have not yet agreed in, and so on: after LEVELS times all but
20 bits are settled, so no shard can hold more than 2 ** 20.

Near copies by similarity use the same index over fingerprints of 256 bits, which every text gets of its
set of five-word shingles. A limit of COPY_BITS in 256 leaves no band of bits that two fingerprints must share, so
MinHash bands deal them to shards instead. Every pair is found by the index of a shard, and the exact Jaccard
similarity of the sets then decides.

Rows: a null or empty text has no words and fingerprint zero, which links like any other. Repeated
rows have equal fingerprints. A row with a null doc_id gets a fingerprint but neither links nor has a
component.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, discard, fresh, map_texts, stored, texts_only

LINK_BITS, SHINGLE, SEED = 3, 3, 42
HOT_SHARD, TASK_ENTRIES, LEVELS = 200_000, 500_000, 4
#: Up to so many rows of one number are broadcast: 1 MB.
SMALL = 100_000
#: Up to so many links (1.6 MB) are joined to components on the driver: a round of the loop costs many tasks and files.
FEW_LINKS = 100_000
#: Bytes of rows, by estimate, for each task and file that write a working table.
FILE_BYTES = 8 << 20
#: Entries of a leaf, children of a node, and node pairs compared at a time.
LEAF, FANOUT, FRONTIER = 8, 4, 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: the majority of each bit of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins, (ends - 1)[shingle - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        def work(keys, texts):
            made = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return {"doc_id": keys, "fp": made.view(np.int64)}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, fp long")


# --- the index of one shard -------------------------------------------------------------------------


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray code."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    """Gray ranks of fingerprints of several words, most significant first: a word's rank turns over when
    the bits before it are odd in number."""
    ranks = gray_rank(fps)
    odd = np.cumsum(np.bitwise_count(fps), axis=1, dtype=np.int64)[:, :-1] & 1
    ranks[:, 1:] ^= np.where(odd.astype(bool), ~np.uint64(0), np.uint64(0))
    return ranks


def _root(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after the links a-b, labelled by their smallest member."""
    while True:
        x, y = parent[a], parent[b]
        if not (differ := x != y).any():
            return parent
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _root(parent)


class GrayIndex:
    """Hierarchical index over distinct fingerprints of one task, of one or more 64-bit words.

    ``shard`` numbers the shard of each entry: only equal ones are compared, as other pairs meet in another
    shard. It forms the head of the sort key, so a group of the tree mostly has one.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        fps = fps.reshape(len(shard), -1)
        self.order = np.lexsort((*gray_ranks(fps).T[::-1], shard))
        self.fps, self.shard = fps[self.order], shard[self.order]
        self.levels = []
        a = o = self.fps
        low = high = self.shard
        width = LEAF
        while True:
            at = np.arange(0, len(a), width)
            a, o = np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((~(a ^ o), a, low, high))  # shared bits, their values, range of shards
            width = FANOUT
            if len(a) <= FANOUT:
                break

    def components(self, limit: int = LINK_BITS, label: np.ndarray | None = None, confirm: Callable | None = None) -> np.ndarray:
        """For every entry as given, the entry that stands for its component.

        Entries of equal ``label`` are linked already. Of pairs within the limit only those link for which
        ``confirm(x, y)`` holds, if it is given; it is asked for entries of different components alone.
        """
        n, words = self.fps.shape
        parent = np.arange(n)
        if label is not None:
            _, at, inverse = np.unique(label[self.order], return_index=True, return_inverse=True)
            parent = at[inverse]
        top = len(self.levels) - 1
        leaves = np.arange(0, n, LEAF)
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j, np.zeros(len(i), np.int64), np.zeros((len(i), words), np.uint64))]
        while stack:
            level, i, j, spent, settled = stack.pop()
            if len(i) > FRONTIER:
                stack += [(level, i[k : k + FRONTIER], j[k : k + FRONTIER], spent[k : k + FRONTIER], settled[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
                continue
            shared, values, low, high = self.levels[level]
            near = (low[i] <= high[j]) & (low[j] <= high[i])
            i, j, spent, settled = i[near], j[near], spent[near], settled[near]
            both = shared[i] & shared[j]
            spent = spent + np.bitwise_count((values[i] ^ values[j]) & both & ~settled).sum(1, dtype=np.int64)
            keep = spent <= limit
            if not level:  # groups that are wholly one component have nothing to add
                least, most = np.minimum.reduceat(parent, leaves), np.maximum.reduceat(parent, leaves)
                keep &= ~((least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j]))
            i, j, spent, both = i[keep], j[keep], spent[keep], both[keep]
            if not len(i):
                continue
            width, below = (LEAF, n) if not level else (FANOUT, len(self.levels[level - 1][0]))
            step = max(1, FRONTIER // (8 * words))
            for k in range(0, len(i), step):
                x = (i[k : k + step, None] * width + np.arange(width))[:, :, None]
                y = (j[k : k + step, None] * width + np.arange(width))[:, None, :]
                ok = (x < below) & (y < below) & ((x < y) if not level else (x <= y))
                x, y = np.broadcast_arrays(x, y)
                pair = np.nonzero(ok)[0]
                x, y = x[ok], y[ok]
                if level:
                    stack.append((level - 1, x, y, spent[k : k + step][pair], both[k : k + step][pair]))
                    continue
                apart = (self.shard[x] == self.shard[y]) & (parent[x] != parent[y])
                x, y = x[apart], y[apart]
                near = np.bitwise_count(self.fps[x] ^ self.fps[y]).sum(1, dtype=np.int64) <= limit
                x, y = x[near], y[near]
                if confirm and len(x):
                    sure = confirm(self.order[x], self.order[y])
                    x, y = x[sure], y[sure]
                parent = _union(parent, x, y)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[parent]
        return out


# --- shards -----------------------------------------------------------------------------------------


def _quarters(free: int, level: int) -> list[int]:
    """LINK_BITS + 1 masks that share out the bits of ``free``: in runs at odd levels, and in turn at even
    ones, so that what varies in one run of bits alone is split as well."""
    own, parts = [1 << i for i in range(64) if free >> i & 1], LINK_BITS + 1
    if level % 2:
        return [sum(own[len(own) * k // parts : len(own) * (k + 1) // parts]) for k in range(parts)]
    return [sum(own[k::parts]) for k in range(parts)]


def _sharded(distinct: DataFrame) -> DataFrame:
    """(shard, rep, fp): one row a fingerprint and band, hot shards dealt out again by their unsettled bits."""
    rows = distinct.select("fp", "rep", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("path"))
    free, done = [(1 << 64) - 1], []
    for level in range(1, LEVELS + 1):
        cuts = [_quarters(f, level) for f in free]
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for q in cuts for m in q])
        path = [F.col("path") * (LINK_BITS + 1) + k for k in range(LINK_BITS + 1)]
        child = F.array(*[F.struct(p.alias("path"), F.xxhash64("shard", p, F.col("fp").bitwiseAND(F.get(masks, p))).alias("shard")) for p in path])
        rows = rows.select("fp", "rep", F.explode(child).alias("c")).select("fp", "rep", "c.shard", "c.path")
        free = [f & ~m for f, q in zip(free, cuts, strict=True) for m in q]
        if level == LEVELS:
            break
        hot = stored(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SHARD).select("shard"), "hot")
        n_hot = hot.count()
        if not n_hot:
            break
        hot = F.broadcast(hot) if n_hot <= SMALL else hot
        done.append(rows.join(hot, "shard", "left_anti"))
        rows = rows.join(hot, "shard", "left_semi")
    for more in done:
        rows = rows.unionByName(more)
    return rows.select("shard", "rep", "fp")


def _forest(limit: int):
    """From a task's (shard, rep, words of the fingerprint), sorted by shard, to links (a, b), one at most
    for each entry. Whole shards are indexed together, about TASK_ENTRIES entries at a time."""

    def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rep, *words = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        up = GrayIndex(np.stack(words, 1).view(np.uint64), shard).components(limit)
        own = np.flatnonzero(up != np.arange(len(up)))
        for k in range(0, len(own), 1 << 16):
            part = own[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[part]), pa.array(rep[up[part]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            if total >= TASK_ENTRIES and batch.num_rows:
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.searchsorted(batch.column(0).to_numpy(), last, side="right"))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield from linked(held)
                    held, total, batch = [], 0, batch.slice(cut)
                else:
                    continue
            if batch.num_rows:
                held.append(batch)
                total += batch.num_rows
        if total > 1:
            yield from linked(held)

    return run


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between representatives that span exactly the components of the link relation."""
    tasks = max((LINK_BITS + 1) * distinct.count() // TASK_ENTRIES, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _sharded(distinct).repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_forest(LINK_BITS), "a long, b long")


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables of distinct links are equal."""
    return x.count() == y.count() and x.join(y, ["a", "b"], "left_anti").isEmpty()


def _gathered(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of about ``width`` bytes, in no more tasks and files than that takes."""
    return df.coalesce(max(1, -(-rows * width // FILE_BYTES)))


def _few_connected(edges: DataFrame) -> DataFrame:
    """What :func:`connected` gives, by the driver: for FEW_LINKS links at most."""
    found = edges.toArrow()
    a, b = (found.column(name).to_numpy() for name in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = _union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    table = pa.table({"node": nodes, "label": nodes[parent]})
    return stored(edges.sparkSession.createDataFrame(table).coalesce(1), "components")


def connected(edges: DataFrame, at_hand: bool = False) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes. Minima are aggregated before they
    are joined, and the join is salted by the other end of a link, so the links of one node are dealt to
    several tasks. Every round is written to the shared folder, and the round before is removed. FEW_LINKS
    links or fewer are joined on the driver. ``at_hand``: the links are read from a stored table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = edges if at_hand else stored(edges, "links")
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if n <= FEW_LINKS:
        return _few_connected(edges)
    edges = stored(edges.distinct(), "links")
    most = edges.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    salts = 8 + most // 50_000
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int"))).alias("salt")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"), every)
        large = both.where("b > a").select("a", "b", salt).join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select("a", "m", every)
        small = large.select("a", "b", salt).join(least, ["a", "salt"])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct(), "links")
        done = _same(after, edges)
        discard(edges)
        edges = after
        if done:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def classes(made: DataFrame) -> DataFrame:
    """(fp, rep, component_id) for every distinct fingerprint of a table (doc_id, fp)."""
    distinct = stored(made.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    label = connected(links(distinct))
    return distinct.join(label, distinct.rep == label.node, "left").select("fp", "rep", F.coalesce("label", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable by links, the document's own included."""
    made = stored(fingerprints(docs, shingle), "fingerprints")
    found = classes(made).select("fp", "component_id")
    return made.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- near copies by shingles in common --------------------------------------------------------------

#: Five-word shingles, fingerprints of four words, and the bits in which those of candidates may differ. Sets of
#: a similarity of 0.8 differ in 0.14 to 0.19 of the bits: of those fewer than 1 in 10 ** 6 in more than 80 of 256.
COPY_SHINGLE, COPY_WORDS, COPY_BITS, SIMILARITY = 5, 4, 80, 0.8


def shingle_set(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH3 hashes of 64 bits: a repeated one counts once."""
    from xxhash import xxh3_64_intdigest

    own = text.encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    n = max(1, len(own) - shingle + 1)
    begins = [0, *ends[: n - 1].tolist()]
    lasts = (ends - 1)[shingle - 1 :].tolist() or [len(joined)]
    return np.unique(np.fromiter((xxh3_64_intdigest(joined[a:b]) for a, b in zip(begins, lasts, strict=True)), np.uint64, n))


#: A pair of similarity J shares a band with the chance 1 - (1 - J ** COPY_ROWS) ** COPY_BANDS: all but
#: 5 in 10 ** 8 of the pairs at 0.8. Neither number depends on the corpus.
COPY_BANDS, COPY_ROWS = 32, 4
#: Texts of a star that are indexed at a time, and sets and their shingles in a task that indexes them, apart from a
#: single larger pair. Clusters of more than CLUSTER_BLOCKS halves of a task are indexed by band.
STAR, TASK_SETS, TASK_SHINGLES, CLUSTER_BLOCKS = 2000, 1000, 1 << 20, 16
#: Words of the bit sets that a task holds: 64 MB.
DENSE_WORDS = 1 << 23


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(42).integers(0, 1 << 63, (2, COPY_BANDS * COPY_ROWS, 1), np.uint64)
    return drawn[0] << np.uint64(1) | np.uint64(1), drawn[1] << np.uint64(1) | np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[int, int, list[int]]:
    """128 bits that name the set as two signed longs, and the keys of its bands by MinHash."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    name = np.frombuffer(xxh3_128_digest(shingles.tobytes()), ">i8").tolist()
    if not len(shingles):
        return *name, []
    a, b = _permutations()
    least = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(shingles), 1 << 12):
        mixed = shingles[i : i + (1 << 12)] * a
        mixed ^= mixed >> np.uint64(32)
        mixed *= b
        np.minimum(least, mixed.min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * COPY_ROWS
    keys = [xxh3_64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(COPY_BANDS)]
    return *name, np.array(keys, np.uint64).view(np.int64).tolist()


def wide_fingerprint(shingles: np.ndarray, words: int = COPY_WORDS) -> np.ndarray:
    """SimHash of several 64-bit words over a set of shingle hashes, each of which is mixed anew for each word."""
    bits = np.zeros(64 * words, np.int64)
    for i in range(0, len(shingles), 1 << 13):
        mixed = shingles[i : i + (1 << 13), None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        bits += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * bits > len(shingles)).view(">u8").astype(np.uint64)


class Overlaps:
    """Exact similarity of pairs of sets. The shingles that most sets share are bits, the others sorted ids."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.sizes = similarity, np.array([len(s) for s in sets], np.int64)
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        row, column = np.repeat(np.arange(len(sets)), self.sizes), rank[ids]
        shared = counts[ids] > 1  # what only one set has is in no pair
        row, column = row[shared], column[shared]
        words = max(1, min(-(-int(column.max(initial=0) + 1) // 64), DENSE_WORDS // len(sets)))
        dense = column < 64 * words
        place, bit = row[dense] * words + (column[dense] >> 6), np.left_shift(np.uint64(1), (column[dense] & 63).astype(np.uint64))
        order = np.argsort(place, kind="stable")
        place, bit = place[order], bit[order]
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        self.bits = np.zeros(len(sets) * words, np.uint64)
        if len(begins):
            self.bits[place[begins]] = np.bitwise_or.reduceat(bit, begins)
        self.bits = self.bits.reshape(len(sets), words)
        self.more = np.bincount(row[~dense], minlength=len(sets))
        self.rest = np.split(column[~dense], np.cumsum(self.more)[:-1])

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(x), bool), max(1, (1 << 19) // self.bits.shape[1])
        for k in range(0, len(x), step):
            a, b = x[k : k + step], y[k : k + step]
            common = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype=np.int64)
            # Whole numbers, and room for the rounding of the product only.
            least = self.similarity * (self.sizes[a] + self.sizes[b]) / (1 + self.similarity) - 1e-9
            spare = np.minimum(self.more[a], self.more[b])
            for i in np.flatnonzero((spare > 0) & (common < least) & (common + spare >= least)).tolist():
                common[i] += len(np.intersect1d(self.rest[a[i]], self.rest[b[i]], assume_unique=True))
            out[k : k + step] = (common >= least) & (common > 0)
        return out


def exact_links(
    sets: list[np.ndarray], label: np.ndarray, similarity: float = SIMILARITY, fps: np.ndarray | None = None, shard: np.ndarray | None = None, limit: int = COPY_BITS
) -> list[tuple[int, int]]:
    """Links that join the components of sets by exact Jaccard similarity; sets of equal ``label`` are linked already.

    The Gray-order index over the sets' fingerprints finds the pairs to compare, those of one shard within ``limit`` bits.
    """
    if len(sets) < 2 or not sum(map(len, sets)):
        return []
    fps = np.array([wide_fingerprint(s) for s in sets]) if fps is None else fps
    index = GrayIndex(fps, np.zeros(len(sets), np.int64) if shard is None else shard)
    up = index.components(limit, label, Overlaps(sets, similarity))
    _, first = np.unique(label, return_index=True)
    return [(i, int(up[i])) for i in first.tolist() if up[i] != i]


def _indexed(similarity: float, limit: int):
    """From a task's (key, rep, label, fp, text), sorted by key, to links (a, b) of exact similarity within each key.

    Small keys are indexed together, each as a shard of its own.
    """

    def linked(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, reps, labels, fps, sets = zip(*held, strict=True)
        found = exact_links(list(sets), np.array(labels), similarity, np.array(fps, np.int64).view(np.uint64), np.array(keys), limit)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([reps[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, total = [], 0
        for key, rep, label, fp, text in rows:
            if held and key != held[-1][0] and 4 * max(len(held) / TASK_SETS, total / TASK_SHINGLES) >= 1:
                yield from linked(held)
                held, total = [], 0
            held.append((key, rep, label, fp, shingle_set(text or "")))
            total += len(held[-1][-1])
        if held:
            yield from linked(held)

    return run


def copy_links(distinct: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of exact similarity that span the components of sets (rep, name0, name1, size, bands, fp, bytes).

    Sets that share a band meet in a shard, and the Gray-order index over the fingerprints ``fp`` of each shard
    finds the pairs. First shards are stars: sets go with the least of all that they share a band with, STAR at
    a time. Bands that hold different components then are joined to clusters, and clusters are indexed. One that is
    too large for a task is dealt to blocks at random, and every two blocks meet in a task; one of more than
    CLUSTER_BLOCKS blocks is indexed by band, in the same way. ``texts`` has (rep, name0, name1, text).
    """
    index = _indexed(similarity, COPY_BITS)
    n, text_bytes = distinct.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    entries = distinct.select("rep", F.explode("bands").alias("key"))
    least = entries.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("z")).where("c < z").select("key", "c")
    shared = stored(_gathered(entries.join(least, "key"), COPY_BANDS * n, 24), "shared")
    nearest = stored(_gathered(shared.where("rep <> c").groupBy("rep").agg(F.min("c").alias("c")), n, 16), "nearest")
    members = nearest.select("rep").union(nearest.select("c")).distinct()
    told = distinct.select("rep", "name0", "name1", "size", "fp").join(members, "rep").join(texts, ["rep", "name0", "name1"]).select("rep", "size", "fp", "text")
    told = stored(_gathered(told, text_bytes + 64 * n, 1), "candidates")

    share = F.ceil(F.greatest(F.count("*") / STAR, F.sum("size") / TASK_SHINGLES)).alias("parts")
    parts = nearest.join(told.select("rep", "size").distinct(), "rep").groupBy("c").agg(share)
    spokes = nearest.join(parts, "c").select("c", F.expr("pmod(xxhash64(rep), parts)").alias("part"), "rep")
    stars = spokes.unionByName(spokes.select("c", "part", F.col("c").alias("rep")).distinct())
    stars = stars.select(F.xxhash64("c", "part").alias("key"), "rep").join(told, "rep").select("key", "rep", F.col("rep").alias("label"), "fp", "text")
    star_links = stored(stars.repartition("key").sortWithinPartitions("key").mapInArrow(index, "a long, b long"), "links")

    label = connected(star_links, at_hand=True)
    held = shared.join(label, shared.rep == label.node, "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = held.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.min("rep").alias("c"), F.max("rep").alias("rep"),
        F.sum(F.xxhash64("rep") % (1 << 40)).alias("sum0"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 40)).alias("sum1"),
    ).where("low < high")
    tried = nearest.select("c", "rep", F.lit(2).cast("long").alias("n"))
    open_ = open_.groupBy("n", "c", "rep", "sum0", "sum1").agg(F.min("key").alias("key")).join(tried, ["c", "rep", "n"], "left_anti")
    rest = stored(_gathered(held.join(open_.select("key", "c"), "key"), shared.count(), 32), "rest")  # key, rep, label, c
    if rest.isEmpty():
        return star_links
    cluster = connected(rest.select(F.col("rep").alias("a"), F.col("c").alias("b")), at_hand=True).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    cluster = stored(_gathered(cluster.join(told.select("rep", "size").distinct(), "rep"), n, 24), "clusters")
    blocks = F.ceil(F.greatest(F.sum("size") / TASK_SHINGLES, F.count("*") / TASK_SETS) * 2).cast("int")
    large = cluster.groupBy("cluster").agg(blocks.alias("blocks")).where(F.col("blocks") > CLUSTER_BLOCKS).select("cluster")
    large = stored(_gathered(large, n, 8), "large")
    rest = rest.join(cluster, "rep")
    whole = rest.join(large, "cluster", "left_anti").select(F.col("cluster").alias("key"), "rep", "label", "size").distinct()
    by_band = rest.join(large, "cluster", "left_semi").select("key", "rep", "label", "size")
    groups = whole.select(F.xxhash64(F.lit("cluster"), "key").alias("key"), "rep", "label", "size").unionByName(by_band)
    groups = stored(_gathered(groups, rest.count(), 32), "groups")
    dealt = groups.join(groups.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(rep, 7), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "label")
    rows = dealt.join(told, "rep").select("key", "rep", "label", "fp", "text")
    return star_links.union(rows.repartition("key").sortWithinPartitions("key").mapInArrow(index, "a long, b long"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies in ``docs``, that of the smallest doc_id, and all rows without a doc_id.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or
    more: the index over their SimHash fingerprints finds them, and an exact comparison follows. Groups are
    their components.
    """
    columns, kinds = ("name0", "name1", "size", "bands", "fp", "bytes"), ("long", "long", "long", "array<long>", "array<long>", "long")
    names = [fresh(docs, name) for name in columns]

    def make():
        def work(keys, texts):
            sets = [shingle_set(t) for t in texts]
            made = [(*signature(s), len(s), wide_fingerprint(s).view(np.int64).tolist(), len(t.encode())) for s, t in zip(sets, texts, strict=True)]
            made = [(high, low, size, bands, fp, n) for high, low, bands, size, fp, n in made]
            return {name: [m[i] for m in made] for i, name in enumerate(names)}

        return work

    made = stored(append(docs, make, dict(zip(names, kinds, strict=True))), "signatures")
    own = [F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]
    known = made.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text", *own)
    rest = [*(F.first(c).alias(c) for c in columns[2:-1]), F.max("bytes").alias("bytes")]
    distinct = known.groupBy("name0", "name1").agg(F.min("rep").alias("rep"), *rest)
    distinct = stored(_gathered(distinct, made.count(), 8 * (COPY_BANDS + COPY_WORDS + 5)), "distinct")
    label = connected(copy_links(distinct, known.select("rep", "name0", "name1", "text"), similarity))
    others = label.where("node <> label").select(F.col("node").alias("rep"))
    first = distinct.join(others, "rep", "left_anti").select(F.col("rep").alias("doc_id"), F.col("name0").alias(names[0]), F.col("name1").alias(names[1]))
    kept = made.where("doc_id is not null").join(first, ["doc_id", *names[:2]], "left_semi").dropDuplicates(["doc_id", *names[:2]])
    return kept.unionByName(made.where("doc_id is null")).select(*docs.columns)
