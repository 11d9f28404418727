"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of two lexicons (a short fixed one, and words learned from labelled rows by
their log-odds), their counts, lexicon words near a second-person pronoun, words that match a lexicon only after
undoing obfuscation (digits and signs for letters, letters drawn out or spaced by signs), rates of capitals,
punctuation and signs within words, and length. Trees are grown on histograms of these features to the logistic
loss; scores of trees grown on the other folds are calibrated by isotonic regression.

The scores that calibration learns from come from trees and a lexicon that haven't seen the row: rows are dealt to
``FOLDS`` folds by their texts, and each fold's are scored by a lexicon and trees of the others.

Labels are learned from ``SAMPLE`` rows at most, picked by a hash; only their features reach the driver.

Nulls: a null text is empty and is scored like an empty one; null labels and ids aren't learned from. Rows that
share an id share its label, toxic if any label of it is. Without labels of both kinds all scores are the rate of
toxic labels, 0 without labels. Rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, sampled, staged, words

#: Most labelled rows that are learned from, and most learned words.
SAMPLE, LEARNED = 20_000, 200
FOLDS = 3
#: A seed lexicon of insults and the second-person pronouns.
LEXICON = frozenset("idiot idiots stupid moron moronic loser losers scum trash worthless pathetic disgusting clown dumb fool imbecile jerk hate filth vermin garbage ugly".split())
SECOND = frozenset("you your yours yourself yourselves u ur youre".split())
UNDO = str.maketrans("013457@$!", "oieastasi")
_TRIM = re.compile(r"^[^a-z0-9@$!]+|[^a-z0-9@$!]+$")
_SIGNS = re.compile(r"[^a-z]")
_DRAWN = re.compile(r"(.)\1+")
_TRIPLE = re.compile(r"(.)\1\1")
_CAPITALS = re.compile(r"[A-Z]")
SHORTENED = frozenset(_DRAWN.sub(r"\1", w) for w in LEXICON)
NAMES = (
    "fixed_density", "fixed_count", "learned_density", "learned_weight", "near_second", "obfuscated", "second_rate", "capital_rate",
    "shout_rate", "bang_rate", "punctuation_rate", "sign_within_rate", "log_words", "mean_word", "most_weight", "lexicon_count",
)


def _plain(core: str, learned: dict[str, float]) -> bool:
    """Whether a word with signs, digits or drawn-out letters stands for a word of a lexicon."""
    for word in (_SIGNS.sub("", core.translate(UNDO)), _SIGNS.sub("", core)):
        if len(word) > 3 and (word in LEXICON or learned.get(word, 0) > 2 or _DRAWN.sub(r"\1", word) in SHORTENED):
            return True
    return False


def features(text: str, learned: dict[str, float]) -> list[float]:
    """The features of one text."""
    raw = text.split()
    fixed = hits = learned_hits = obfuscated = near = within = second = 0
    weight = most = 0.0
    last_hit = last_second = -99
    for i, w in enumerate(text.lower().split()):
        core = w
        if not w.isalpha():
            core = _TRIM.sub("", w)
            if not core:
                continue
        hit = core in LEXICON
        fixed += hit
        if core in learned:
            learned_hits += 1
            weight += learned[core]
            most = max(most, learned[core])
            hit = hit or learned[core] > 2
        elif core in SECOND:
            second += 1
            near += i - last_hit <= 4
            last_second = i
        elif not hit and (not core.isalpha() or _TRIPLE.search(core)):
            within += not core.isalpha()
            hit = _plain(core, learned)
            obfuscated += hit
        if hit:
            hits += 1
            near += i - last_second <= 4
            last_hit = i
    n, size = len(raw), max(1, len(text))
    m = max(1, n)
    capitals = len(_CAPITALS.findall(text))
    shout = sum(map(str.isupper, raw))
    bangs = text.count("!") + text.count("?")
    signs = bangs + sum(map(text.count, ".,;:\"'()*&%$#@"))
    return [
        fixed / m, fixed, learned_hits / m, weight / m, near / m, obfuscated, second / m, capitals / size,
        shout / m, bangs / size, signs / size, within / m, float(np.log1p(n)), len(text) / m, most, hits,
    ]


def feature_rows(batches: Iterator[pa.RecordBatch], lexicons: list[dict[str, float]], extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, extra columns) with the features under each lexicon in the text's place, one after another."""
    for b in batches:
        x = [[v for learned in lexicons for v in features(t.as_py() or "", learned)] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), *[b.column(i) for i in range(2, b.num_columns)]], ["doc_id", "x", *extra])


class Trees:
    """Gradient-boosted trees of depth three over quantile bins, for the logistic loss."""

    def __init__(self, rounds: int = 80, rate: float = 0.15, depth: int = 3, bins: int = 48, least: float = 4.0):
        self.rounds, self.rate, self.depth, self.bins, self.least = rounds, rate, depth, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        for j in range(k):  # rare features have all their quantiles at one value
            if len(np.unique(x[:, j])) > 1:
                rare = x[:, j][x[:, j] > np.median(x[:, j])]
                if len(rare):
                    self.cuts[j] = np.unique(np.concatenate((self.cuts[j], [np.median(x[:, j])], np.quantile(rare, np.linspace(0, 1, 13)[1:-1]))))
        b = self._binned(x)
        width = max(len(c) for c in self.cuts) + 1
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(n, np.int64)
            splits = []
            for d in range(self.depth):
                m = 1 << d
                best = np.full(m, 1e-9)
                feature, cut = np.zeros(m, np.int64), np.full(m, width, np.int64)
                for j in range(k):
                    at = node * width + b[:, j]
                    gs = np.bincount(at, g, m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(at, h, m * width).reshape(m, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(m), top]
                    better = value > best
                    best[better], feature[better], cut[better] = value[better], j, top[better]
                splits.append((feature, cut))
                node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            self.trees.append((splits, leaf))
            score += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        at = np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[at, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function that fits ``y`` best (pools of adjacent violators), mildly smoothed."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    knots = np.array([x for p in pools for x in (p[2], p[3])])
    values = np.array([v for p in pools for v in [(p[0] + 0.5 * y.mean()) / (p[1] + 0.5)] * 2])
    return knots, np.maximum.accumulate(values)


def fit(x: np.ndarray, y: np.ndarray, by_fold: list[np.ndarray] | None = None, fold: np.ndarray | None = None) -> dict:
    """Trees on all rows, and a calibration from scores of trees that haven't seen the row.

    ``by_fold`` has for each fold the features of all rows under what was learned without that fold.
    """
    if not len(y) or y.min() == y.max():
        return {"rate": float(y.mean()) if len(y) else 0.0}
    if by_fold is None or fold is None:
        by_fold, fold = [x] * FOLDS, np.arange(len(y)) % FOLDS
    out = np.zeros(len(y))
    for f, z in enumerate(by_fold):
        seen = fold != f
        out[~seen] = Trees().fit(z[seen], y[seen]).score(z[~seen]) if 0 < y[seen].sum() < seen.sum() else 0
    return {"trees": Trees().fit(x, y), "knots": isotonic(out, y)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "rate" in model:
        return np.full(len(x), model["rate"])
    s = model["trees"].score(x)
    # A hair of the raw score keeps the order within a step of the calibration, without crossing one half.
    p = np.interp(s, *model["knots"])
    fine = p + 1e-6 * (1 / (1 + np.exp(-s)) - 0.5)
    return np.clip(np.where(p >= 0.5, np.maximum(fine, 0.5), np.minimum(fine, 0.5 - 1e-9)), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """Learn the lexicon and the model from at most ``sample`` labelled rows that aren't held out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id")))
    known = sampled(known.groupBy("doc_id").agg(F.max("y").alias("y")), sample, "doc_id")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # At most ``sample`` pairs of numbers are broadcast.
    there = staged(texts.join(F.broadcast(staged(known, "toxic-labels")), "doc_id"), "toxic-sample")
    there = there.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    n = np.zeros((2, FOLDS))
    for r in there.groupBy("y", "fold").count().collect():
        n[min(1, max(0, r.y)), r.fold] = r["count"]
    terms = there.select("y", "fold", F.explode(F.array_distinct(words(F.regexp_replace(ascii_lower(F.col("text")), r"[^\p{L}\p{N}]+", " ")))).alias("w"))
    sums = [F.count_if((F.col("fold") == f) & (F.col("y") == v)).alias(f"{'ct'[v]}{f}") for f in range(FOLDS) for v in (0, 1)]
    terms = staged(terms.groupBy("w").agg(*sums).where(" + ".join(f"t{f}" for f in range(FOLDS)) + " >= 3"), "toxic-terms")
    lexicons = [_lexicon(terms, n, [g for g in range(FOLDS) if g != f]) for f in range(FOLDS + 1)]  # the last from all folds
    rows = lambda batches: feature_rows(batches, lexicons, ["y", "fold"])
    got = there.select("doc_id", "text", "y", "fold").mapInArrow(rows, "doc_id long, x array<double>, y int, fold int").toArrow()  # bounded rows
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, FOLDS + 1, len(NAMES))
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x[:, -1].T, got.column("doc_id").to_numpy()))
    x, y, fold = x[order], y[order], got.column("fold").to_numpy()[order]
    return {"learned": lexicons[-1], **fit(x[:, -1], y, [x[:, f] for f in range(FOLDS)], fold)}


def _lexicon(terms: DataFrame, n: np.ndarray, folds: list[int]) -> dict[str, float]:
    """Words of some folds' rows by their log-odds, ``LEARNED`` at most."""
    neg, pos = n[:, folds].sum(axis=1)
    t, c = (F.expr(" + ".join(f"{v}{f}" for f in folds)) for v in "tc")
    odds = F.log((t + 0.5) / F.lit(float(pos + 1))) - F.log((c + 0.5) / F.lit(float(neg + 1)))
    # Two deviations below the estimate, so that a few copies of one text don't make words of the lexicon.
    odds = odds - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    top = terms.where(t >= 3).select("w", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "w").limit(LEARNED).collect()
    return {r.w: round(r.odds, 4) for r in top}


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    learned = model["learned"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "", learned) for t in b.column(1)], dtype=np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(model, x))], ["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
