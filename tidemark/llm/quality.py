"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs the votes.

Every rule looks at a few counts of the whole text and votes bad (-1), good (1) or abstains (0). How
far a rule can be trusted isn't stated but estimated: the votes of all documents are counted by their
combination, of which there are at most 3**len(RULES) however large the corpus is, and EM fits, for
each rule, the chance of each vote among good and among bad documents, with the share of bad ones. The
posterior of a document's combination is its quality. Nothing has to be collected but the combinations.
The fit leaves out documents that fail the base rules, which are rejected whatever their votes.

Rows: a null or empty text has no words, so its counts are 0, it fails the base rules and isn't kept.
Repeated rows have equal results; an empty table has none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, fresh, map_texts, stored, texts_only

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PLAIN = re.compile(r"(?<!\S)[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:?]?(?!\S)")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_ends", "n_distinct", "n_plain")

#: A junk rule that doesn't fire says nothing of other kinds of junk, so it abstains.
NEVER = (0.0, 0.0)
#: name: (measure of the counts, [bad from, bad to), [good from, good to)); elsewhere the rule abstains.
RULES = {
    "symbols": (lambda c: c["n_symbols"] / c["n_words"], (0.1, np.inf), (-1, 0.02)),
    "plain words": (lambda c: c["n_plain"] / c["n_words"], (-1, 0.6), (0.85, np.inf)),
    "capitals": (lambda c: c["n_upper"] / np.maximum(c["word_chars"], 1), (0.4, np.inf), NEVER),
    "shouting": (lambda c: c["n_marks"] / c["n_words"], (0.1, np.inf), NEVER),
    "same lines": (lambda c: c["n_dup_lines"] / np.maximum(c["n_lines"], 1), (0.3, np.inf), NEVER),
    "said again": (lambda c: c["n_repeat_words"] / c["n_words"], (0.3, np.inf), NEVER),
    "word length": (lambda c: c["word_chars"] / c["n_words"], (14, np.inf), NEVER),
    "sentences": (lambda c: c["n_words"] / np.maximum(c["n_ends"], 0.5), (60, np.inf), (3, 25)),
    "variety": (lambda c: c["n_distinct"] / np.sqrt(c["n_words"]), (-1, 2), (5, np.inf)),
}


def counts(text: str) -> tuple[int, ...]:
    """The counts named in COUNTS. Words are runs of anything but U+0020 and U+0009 to U+000D."""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    again = 0
    if len(set(triples)) < len(triples):
        seen = Counter(triples)
        covered = np.zeros(n, bool)
        at = np.fromiter((i for i, x in enumerate(triples) if seen[x] > 1), np.int64)
        for k in range(3):
            covered[at + k] = True
        again = int(covered.sum())
    ends = sum(map(text.count, (". ", ".\n", "! ", "? ", "!\n", "?\n"))) + text.endswith((".", "!", "?"))
    return (
        n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again,
        len(lines), len(_UPPER.findall(text)), text.count("!"), ends, len(set(words)), len(_PLAIN.findall(text)),
    )


def votes(table: dict[str, np.ndarray]) -> np.ndarray:
    """One row of -1, 0 and 1 for each document."""
    table = {k: np.asarray(v, np.float64) for k, v in table.items()} | {"n_words": np.maximum(np.asarray(table["n_words"], np.float64), 1)}
    out = np.zeros((len(table["n_words"]), len(RULES)), np.int8)
    for i, (measure, bad, good) in enumerate(RULES.values()):
        x = measure(table)
        out[:, i] = np.where((x >= bad[0]) & (x < bad[1]), -1, np.where((x >= good[0]) & (x < good[1]), 1, 0))
    return out


def combination(votes_: np.ndarray) -> np.ndarray:
    """The votes as one number in base 3."""
    return (votes_.astype(np.int64) + 1) @ 3 ** np.arange(votes_.shape[1])


def fit(combinations: np.ndarray, weights: np.ndarray, rules: int = len(RULES), rounds: int = 200) -> dict:
    """EM over vote combinations. Starts from: bad is what a rule calls bad, at 0.9.

    Returns the share of bad documents and, for each rule, the chance of every vote in either class.
    """
    cast = np.asarray(combinations)[:, None] // 3 ** np.arange(rules) % 3
    one_hot = (cast[:, :, None] == np.arange(3)).astype(np.float64)
    weights = np.asarray(weights, np.float64)
    bad = np.where((cast == 0).any(1), 0.9, 0.05)
    prior, chance, mass = 0.1, np.full((2, rules, 3), 1 / 3), np.zeros((2, rules, 3))
    for _ in range(rounds if len(weights) else 0):
        for y, p in enumerate((1 - bad, bad)):
            mass[y] = np.einsum("n,nrv->rv", weights * p, one_hot) + 0.5
            chance[y] = mass[y] / mass[y].sum(1, keepdims=True)
        # A rule is taken to be right more often than not: where it seems the other way, it says nothing.
        worse = (chance[1, :, 0] < chance[0, :, 0]) | (chance[1, :, 2] > chance[0, :, 2])
        chance[:, worse] = (mass[:, worse].sum(0) / mass[:, worse].sum((0, 2))[:, None])
        prior = (float(weights @ bad) + 1) / (weights.sum() + 10)
        new = posterior_bad(cast, prior, chance)
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return {"prior_bad": prior, "chance": chance}


def posterior_bad(cast: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    at = np.arange(cast.shape[1])
    log = np.log(chance[:, at, cast]).sum(2)
    log += np.log([1 - prior, prior])[:, None]
    log -= log.max(0)
    return np.exp(log[1]) / np.exp(log).sum(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the vote combination of every document."""

    def make():
        def work(keys, texts):
            table = dict(zip(COUNTS, np.array([counts(t) for t in texts], np.int64).T, strict=True))
            return {"doc_id": keys, **table, "votes": combination(votes(table))}

        return work

    return map_texts(texts_only(docs), make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", votes long")


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def posteriors(combinations: DataFrame) -> DataFrame:
    """(votes, p_good) of every combination of a table (votes, failed), fitted on rows that haven't failed.

    The result has at most 3**len(RULES) rows, whatever the table's size.
    """
    passed = F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("n")
    seen = combinations.groupBy("votes").agg(passed).orderBy("votes").collect()
    model = fit(np.array([r.votes for r in seen], np.int64), np.array([r.n for r in seen]))
    cast = np.array([r.votes for r in seen], np.int64)[:, None] // 3 ** np.arange(len(RULES)) % 3
    good = 1 - posterior_bad(cast, model["prior_bad"], model["chance"]) if len(seen) else []
    rows = [(r.votes, float(g)) for r, g in zip(seen, good, strict=True)]
    return combinations.sparkSession.createDataFrame(rows, "votes long, p_good double")


def quality(docs: DataFrame, *, good_from: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept. Rows are as many as the input's."""
    made = stored(measured(docs).withColumn("base_failed", F.expr(FAILED)), "quality")
    table = posteriors(made.select("votes", F.col("base_failed").alias("failed")))
    kept = ~F.col("base_failed") & (F.col("p_good") >= good_from)
    return made.join(F.broadcast(table), "votes").withColumn("kept", kept).select("doc_id", *COUNTS, "base_failed", "p_good", "kept")


def keep_good(docs: DataFrame, *, good_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all their columns as they are."""
    votes_, failed = fresh(docs, "votes"), fresh(docs, "failed")

    def make():
        def work(keys, texts):
            table = dict(zip(COUNTS, np.array([counts(t) for t in texts], np.int64).T, strict=True))
            bad = (table["n_words"] < 50) | (100 * table["n_repeat_words"] > 50 * table["n_words"])
            return {votes_: combination(votes(table)), failed: bad}

        return work

    made = stored(append(docs, make, {votes_: "long", failed: "boolean"}), "quality")
    table = posteriors(made.select(F.col(votes_).alias("votes"), F.col(failed).alias("failed")))
    good = table.where(F.col("p_good") >= good_from).select(F.col("votes").alias(votes_))
    return made.where(~F.col(failed)).join(F.broadcast(good), votes_, "left_semi").select(*docs.columns)
