"""The near-duplicate stage against exact similarity of five-word shingles."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import simhash

DOCS = "doc_id long, text string"


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(texts):
    sets, up = [slow_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    return {r.doc_id for r in simhash.keep_first(docs).select("doc_id").collect()}


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, words, low, high):
    """A copy in which words are replaced until its similarity lies between the two."""
    out = list(words)
    while True:
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
        x, y = slow_set(" ".join(words)), slow_set(" ".join(out))
        share = len(x & y) / len(x | y)
        if share < low:
            out = list(words)
        elif share <= high:
            return out


def test_less_similar_texts_are_kept(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = prose(rng, 150)
        texts += [" ".join(words), " ".join(edited(rng, words, 0.7, 0.79))]
    passage = prose(rng, 30)  # two texts that share a passage said twenty times, and nothing else
    for _ in range(2):
        texts.append(" ".join([w for _ in range(20) for w in [*prose(rng, 75), *passage]]))
    assert kept(spark, texts) == slow_kept(texts) == set(range(len(texts)))


def families(seed):
    rng = random.Random(seed)
    texts = ["", " ", "one two", "One  TWO", "one two three"]
    for _ in range(12):  # chains and families in which some are linked and some aren't
        words = prose(rng, 100)
        for _ in range(7):
            texts.append(" ".join(words))
            texts.append(" ".join(edited(rng, words, 0.65, 0.85)))
            words = edited(rng, words, 0.7, 0.95)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("star", "sets", "blocks"), [(2, 1000, 16), (2000, 4, 16), (2, 4, 2), (2000, 1, 1)])
def test_components_of_exact_links(spark, monkeypatch, star, sets, blocks):
    """Whatever a star or a task holds: hot groups are split, and no link is lost."""
    monkeypatch.setattr(simhash, "STAR", star)
    monkeypatch.setattr(simhash, "TASK_SETS", sets)
    monkeypatch.setattr(simhash, "CLUSTER_BLOCKS", blocks)
    texts = families(2)
    assert kept(spark, texts) == slow_kept(texts)


@pytest.mark.parametrize("dense", [1, 40, 1 << 20])
def test_exact_links_find_the_components_of_all_pairs(monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE_WORDS", dense)
    rng = np.random.default_rng(3)
    for k in range(60):
        base = rng.integers(0, 1 << 40, 20 * (1 + k % 9), np.uint64)
        sets = [np.unique(np.where(rng.random(len(base)) < rng.random() / 4, rng.integers(0, 1 << 40, len(base), np.uint64), base)) for _ in range(rng.integers(2, 40))]
        label = rng.integers(0, 2 * len(sets), len(sets)) if k % 2 else np.arange(len(sets))
        want = np.unique(label, return_index=True, return_inverse=True)
        want = got = want[1][want[2]]
        for i, x in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(x, sets[j]))
                if 10 * both >= 8 * (len(x) + len(sets[j]) - both):
                    want = simhash._union(want, np.array([i]), np.array([j]))
        for i, j in simhash.exact_links(sets, label):
            got = simhash._union(got, np.array([i]), np.array([j]))
        assert got.tolist() == want.tolist()


def test_fingerprints_of_copies_lie_within_the_limit():
    """Pairs at 0.8; the smallest sets vary most."""
    rng = np.random.default_rng(6)
    for left, common, right in ((0, 4, 1), (1, 8, 1), (0, 8, 2), (10, 80, 10), (0, 80, 20), (100, 800, 100)):
        for _ in range(3000 if common < 80 else 200):
            drawn = rng.integers(0, 1 << 63, left + common + right, np.uint64)
            x, y = simhash.wide_fingerprint(drawn[: left + common]), simhash.wide_fingerprint(drawn[left:])
            assert np.bitwise_count(x ^ y).sum() <= simhash.COPY_BITS


def test_connected_finds_the_least_node(spark):
    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(150)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(70):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = simhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.label for r in got} == {x: least[x] for x in linked} and len(got) == len(linked)


def test_copies_at_the_limit_share_a_band():
    rng = np.random.default_rng(4)
    for _ in range(2000):  # 160 of 200 in common
        drawn = rng.integers(0, 1 << 63, 200, np.uint64)
        a, b = (simhash.signature(np.sort(drawn[k : k + 180]))[2] for k in (0, 20))
        assert set(a) & set(b)


def test_groups_of_two_are_found(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(80):
        words = prose(rng, 150)
        texts += [" ".join(words), " ".join(edited(rng, words, 0.8, 0.84))]
    assert kept(spark, texts) == slow_kept(texts) == set(range(0, len(texts), 2))


def test_links_are_found_by_the_index(spark, monkeypatch):
    """Groups of two as well as families: where the index finds no pair, there's no link."""
    texts = families(8)
    different = len({frozenset(slow_set(t)) for t in texts})
    assert len(kept(spark, texts)) < different
    monkeypatch.setattr(simhash, "COPY_BITS", -1)
    assert len(kept(spark, texts)) == different


def test_small_shards_are_indexed_together():
    """Sets of different shards never link, however alike, and those of one do by fingerprint and similarity."""
    rng = np.random.default_rng(9)
    alike, other = rng.integers(0, 1 << 63, 100, np.uint64), rng.integers(0, 1 << 63, 100, np.uint64)
    sets = [np.unique(x) for x in (alike, alike[:95], alike[:90], other, other[:60])]
    fps = np.array([simhash.wide_fingerprint(s) for s in sets])
    links = lambda shard, fps=fps, limit=simhash.COPY_BITS: simhash.exact_links(sets, np.arange(5), fps=fps, shard=np.array(shard), limit=limit)
    assert links([1, 1, 2, 3, 3]) in ([(0, 1)], [(1, 0)])
    assert len(links([1, 1, 1, 3, 3])) == 2
    assert links([1, 2, 3, 4, 4]) == []
    far = fps.copy()
    far[1] = ~far[0]
    assert links([1, 1, 2, 3, 3], far) == []


def graph(seed):
    rng = random.Random(seed)
    chains = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000 - i, 1999 - i) for i in range(40)]
    return [*chains, *((5000 + rng.randrange(200), 5000 + rng.randrange(200)) for _ in range(150)), (0, 1), (1, 0), (7000, 7000), (-9, 4_000_000_000_000)]


@pytest.mark.parametrize("at_hand", [True, False])
@pytest.mark.parametrize("few", [0, 100_000])
def test_few_links_and_many_give_the_same_components(spark, monkeypatch, few, at_hand):
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    edges, up = graph(10), {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = simhash.connected(spark.createDataFrame(edges, "a long, b long").repartition(3), at_hand=at_hand)
    assert got.dtypes == [("node", "bigint"), ("label", "bigint")]
    got = got.collect()
    assert {r.node: r.label for r in got} == up and len(got) == len(up)
    none = simhash.connected(spark.createDataFrame([(3, 3)], "a long, b long"), at_hand=at_hand)
    assert none.collect() == [] and none.dtypes == [("node", "bigint"), ("label", "bigint")]


def test_small_working_tables_take_few_files(spark, monkeypatch):
    """However many shuffle partitions there are: a file costs a task and, on a local disk, processes beside the JVM."""
    files, write, texts = {}, simhash.stored, families(11)

    def stored(df, name):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert kept(spark, texts) == slow_kept(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"signatures", "distinct", "shared", "nearest", "candidates", "links"} <= set(files)
    assert all(set(n) == {1} for name, n in files.items() if name not in ("signatures", "links")), files
    assert len(files["links"]) <= 2, files  # no rounds of the loop


def test_long_words_take_the_files_of_their_bytes(spark, monkeypatch):
    rng, n, write = random.Random(12), [], simhash.stored
    texts = []
    for _ in range(20):
        words = prose(rng, 100)
        texts += [" ".join(w + 400 * "x" for w in some) for some in (words, edited(rng, words, 0.8, 0.9))]

    def stored(df, name):
        out = write(df, name)
        n.extend([len(out.inputFiles())] * (name == "candidates"))
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(simhash, "FILE_BYTES", 100_000)  # as words of a few letters they would fit in one
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert len(kept(spark, texts)) == 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n[0] > 1
