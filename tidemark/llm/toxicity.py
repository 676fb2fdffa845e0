"""Toxicity by compression distance: windows against a toxic and an ordinary zstandard dictionary.

A window is one word between two fixed pieces of text: the piece before makes the compressor open its
block, the piece after takes its last eight bytes, in which it looks for no match. The ordinary
dictionary holds the words that most ordinary labelled documents use. The toxic one is trained by
zstandard on windows of toxic documents: words that toxic documents use in more contexts than chance
allows, each as often as it has contexts. Its coder holds both, so that the difference of a window's two
compressed lengths is what the toxic text alone explains of it. A document's windows are summed up over
its distinct words, and a logistic threshold is calibrated on labelled rows that the dictionaries have
not seen.

Fitting uses at most MAX_ROWS labelled rows of each label, chosen by a hash of the id, and their whole
texts; words are counted and rows measured on executors, and the driver gets the words of the two
dictionaries and a few numbers a row. Scoring covers every document and its whole text. Labels are
learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, and score inputs are texts alone.

Rows: null and empty texts score as a text without toxic words. Repeated rows score alike. With several
labels for a document the highest counts; null labels don't. Without labels of both kinds all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, fresh, map_texts, steps, stored, texts_only

#: The bound of the labelled sample, and the sizes of the two dictionaries.
MAX_ROWS, BASE_BYTES, TOXIC_BYTES = 3_000, 8192, 16384
#: Contexts that a word of the toxic dictionary has at least, and by how many deviations more than by chance;
#: and how many windows the trainer gets in all, shared out by contexts.
LEAST_CONTEXTS, LEAST_Z, SAMPLES = 3, 4.0, 20_000
LEVEL = 12
#: Text that occurs nowhere: it opens and ends every window.
OPEN, CLOSE = bytes(range(128, 176)), bytes(range(12))
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"
CACHE_WORDS = 250_000


def words(text: str) -> list[bytes]:
    return [w.strip(_STRIP) for w in text.lower().encode().split()]


class Distance:
    """Bytes that the toxic dictionary saves on a word over the ordinary one, kept for words seen."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.coders = [self._coder(OPEN + ordinary), self._coder(OPEN + ordinary + toxic)]
        self.seen: dict[bytes, int] = {}

    @staticmethod
    def _coder(content: bytes):
        import zstandard as zs

        how = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=0, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=held, compression_params=how)

    def __call__(self, word: bytes) -> int:
        saved = self.seen.get(word)
        if saved is None:
            window = OPEN + b" " + word + b" " + CLOSE
            ordinary, toxic = (len(c.compress(window)) for c in self.coders)
            saved = ordinary - toxic
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            if len(word) <= 48:
                self.seen[word] = saved
        return saved

    def features(self, text: str) -> tuple[float, ...]:
        """Over the distinct words: savings beyond two bytes as a share, the largest, how many save five bytes
        or more as a share and as a count, and how many words there are; each of the order of one."""
        own = set(words(text))
        saved = [*map(self, own)]
        strong = sum(s >= 5 for s in saved)
        return (
            sum(s - 2 for s in saved if s > 2) / (20 + len(own)) * 10, max(saved, default=0) / 5,
            strong / (20 + len(own)) * 50, strong**0.5, np.log1p(len(own)) / 5,
        )


def _content(ranked: list[bytes], size: int) -> bytes:
    """Words up to ``size`` bytes, the first ones last, where matches cost least."""
    out, total = [], 0
    for word in ranked:
        if total + len(word) + 1 > size:
            break
        out.append(word + b" ")
        total += len(word) + 1
    return b"".join(reversed(out))


def trained(contexts: list[tuple[bytes, int]], size: int = TOXIC_BYTES, samples: int = SAMPLES) -> bytes:
    """What zstandard's trainer makes of windows of the words, each as often as it has contexts, in a fixed
    random order: the trainer takes its segments from parts of equal size, in which all words must stand."""
    import random

    import zstandard as zs

    total = sum(n for _, n in contexts)
    share = min(1.0, samples / max(1, total))
    windows = [(b" " + word + b" ").ljust(8) for word, n in contexts for _ in range(max(1, round(n * share)))]
    random.Random(42).shuffle(windows)
    try:
        return zs.train_dictionary(size, windows, k=50, d=8).as_bytes()
    except zs.ZstdError:  # too little text to train on: the words themselves
        return _content([word for word, _ in contexts], size)


def _word_contexts(found: DataFrame) -> DataFrame:
    """word, t and o: by how many different words it is preceded in toxic and in other texts. Copies add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = [*set(pairwise([b"", *words(text)]))]
                for k in range(0, len(pairs), 1 << 16):
                    before, word = zip(*pairs[k : k + (1 << 16)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(word)), pa.array(word, pa.binary()), pa.array(before, pa.binary())], names=["toxic", "word", "before"])

    pairs = found.select((F.col("toxic") == 1).alias("toxic"), "text").mapInArrow(run, "toxic boolean, word binary, before binary").distinct()
    return pairs.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))


def dictionaries(found: DataFrame) -> tuple[bytes, bytes]:
    """The ordinary dictionary and the toxic one, from labelled texts (toxic, text)."""
    counts = stored(_word_contexts(found), "contexts")
    nt, no = counts.agg(F.sum("t"), F.sum("o")).first()
    expected = (F.col("t") + F.col("o")) * ((nt or 0) / max(1, (nt or 0) + (no or 0)))
    z = (F.col("t") - expected) / F.sqrt(expected)
    # A word takes two bytes at least with its space, so more of them can't be in a dictionary.
    common = counts.where("o > 0 and length(word) > 0").orderBy(F.desc("o"), "word").limit(BASE_BYTES // 2).collect()
    marked = counts.where((F.col("t") >= LEAST_CONTEXTS) & (F.length("word") > 1) & (z > LEAST_Z))
    marked = marked.orderBy(z.desc(), "word").limit(TOXIC_BYTES // 3).collect()
    return _content([bytes(r.word) for r in common], BASE_BYTES), trained([(bytes(r.word), r.t) for r in marked])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> dict:
    """A model from labelled rows outside fold 0: dictionaries from folds 1 to 3, weights from fold 4."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(fold != 0)
    picked = [marked.where(test).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for test in ("toxic = 1", "toxic <> 1")]
    ids = picked[0].union(picked[1])  # at most 2 * max_rows rows of two numbers
    found = texts_only(docs).join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min_by("toxic", "doc_id").alias("toxic"))
    found = stored(found.select("doc_id", "text", "toxic", fold.alias("fold")), "labelled")
    kinds = {(r.early, r.toxic) for r in found.select((F.col("fold") < 4).alias("early"), (F.col("toxic") == 1).alias("toxic")).distinct().collect()}
    if not {(True, True), (True, False)} <= kinds:
        return {"ordinary": b"", "toxic": b"", "weights": None}
    early = F.col("fold") < 4
    ordinary, toxic = dictionaries(found.where(early))
    tested = found.where(~early if {(False, True), (False, False)} <= kinds else early)

    def make():
        distance = Distance(ordinary, toxic)
        return lambda keys, texts: {"key": keys, "x": [distance.features(t) for t in texts]}

    rows = map_texts(tested.selectExpr("struct(doc_id, toxic) as key", "text"), make, "key struct<doc_id: long, toxic: int>, x array<double>").collect()  # at most 2 * max_rows
    rows.sort(key=lambda r: (r.key.doc_id, r.x))
    weights = logistic(np.array([r.x for r in rows]), np.array([r.key.toxic == 1 for r in rows], np.float64))
    return {"ordinary": ordinary, "toxic": toxic, "weights": weights}


def scorer(model: dict):
    """The function from texts to scores in 0 to 1, to be made once a task."""
    distance, weights = Distance(model["ordinary"], model["toxic"]), model["weights"]

    def score(texts: list[str]) -> np.ndarray:
        if weights is None:
            return np.zeros(len(texts))
        x = np.array([(*distance.features(t), 1.0) for t in texts]).reshape(-1, len(weights))
        return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels, **bounds)

    def make():
        score = scorer(model)
        return lambda keys, texts: {"doc_id": keys, "score": score(texts)}

    scored = map_texts(texts_only(docs), make, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all their columns as they are."""
    model, name = train(docs, labels, **bounds), fresh(docs, "score")

    def make():
        score = scorer(model)
        return lambda keys, texts: {name: score(texts)}

    return append(docs, make, {name: "double"}).where(F.col(name) < 0.5).select(*docs.columns)
