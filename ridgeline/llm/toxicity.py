"""Toxicity by weak supervision.

1. A bounded sample (``sample_rows`` training documents, three quarters of them labelled where there are as many, least
   hash first) gives counts of words and word beginnings among toxic and other documents.
2. Voters: fixed lexicons of insults and of courtesy, surface patterns, and lexicons mined from the labelled
   rows (the fixed ones are English, texts are not); fewer mined ones than fixed.
3. A generative label model (EM) estimates each voter's accuracy and correlations: voters that still agree
   once the class is known share their weight. The labelled rows anchor it, and it decides the others by
   its votes alone. Its posterior is the label to learn; where a label is known it is one more vote, of
   accuracy ``trust``.
4. A logistic regression over word and word-beginning features learns the posterior; its margin is
   calibrated on the sample's known labels, and one pass scores every whole text.

Labels are read for training rows only: those whose crc32(doc_id as text) mod 5 is not 0. lang, source
and doc_id are no inputs of a score. Features are counts over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Common English insults, by what they disparage.
LEXICON = {
    "mind": ["idiot", "imbecile", "moron", "stupid", "dumb", "fool", "brainless"],
    "worth": ["worthless", "useless", "pathetic", "loser", "nobody", "failure"],
    "filth": ["trash", "garbage", "scum", "filth", "vermin", "disgusting"],
    "mockery": ["clown", "joke", "laughable", "ridiculous"],
}
#: Words of courtesy, which vote against.
COURTESY = ["please", "thanks", "thank", "welcome", "sorry", "bitte", "danke", "merci", "gracias"]
#: Over lower-case texts.
PATTERNS = {
    "addressed": re.compile(r"\byou(?:'re| are| were) (?:a |an |such |so |all )"),
    "called": re.compile(r"\b(?:you|du|tu|vous) (?:little|stupid|dirty|dumme[rs]?|sale|maldit[oa]) "),
    "command": re.compile(r"\b(?:shut up|get lost|go away|go to hell|drop dead|piss off)\b"),
    "hate": re.compile(r"\b(?:i|we|everyone|nobody) (?:hates?|despises?|likes?|wants?) (?:you|them|your)\b"),
    "wish": re.compile(r"\b(?:hope|wish) (?:you|they) (?:die|fail|suffer|rot)\b"),
    "sweeping": re.compile(r"\b(?:all|every one) of (?:you|them|those) (?:are|is)\b"),
    "shouting": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b[^\W\d_]+[*#@$%]{2,}[^\W\d_]*"),
}
WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8
HELD_OUT_FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for evaluation; a row without doc_id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    return [word + "$", *("^" + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


class Matcher:
    """Counts the chosen features of a text; words seen before cost one lookup."""

    def __init__(self, features: list[str], cache_entries: int = 200_000):
        self.place = {f: i for i, f in enumerate(features)}
        self.cache_entries = cache_entries
        self.cache: dict[str, tuple[int, ...]] = {}

    def count(self, text: str) -> dict[int, int]:
        counts: dict[int, int] = {}
        cache = self.cache
        for word, n in Counter(WORD.findall(text.lower())).items():
            found = cache.get(word)
            if found is None:
                if len(cache) >= self.cache_entries:
                    cache.clear()
                found = cache[word] = tuple(self.place[f] for f in word_features(word) if f in self.place)
            for i in found:
                counts[i] = counts.get(i, 0) + n
        return counts


@dataclass
class Model:
    """Features with weights, an intercept and the calibration of the margin."""

    features: list[str]
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def scorer(self):
        matcher = Matcher(self.features)

        def score(text: str) -> float:
            margin = self.intercept + sum(self.weights[i] * np.log1p(n) for i, n in matcher.count(text).items())
            return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))

        return score


def feature_counts(sample: DataFrame, flush: int = 300_000) -> DataFrame:
    """sample(text, toxic) -> (feature, pos, neg, docs): documents with the feature, by class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(f, *v) for f, v in held.items()], columns=["feature", "pos", "neg", "docs"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                place = None if pd.isna(toxic) else 0 if toxic > 0 else 1
                for f in {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}:
                    row = held.setdefault(f, [0, 0, 0])
                    row[2] += 1
                    if place is not None:
                        row[place] += 1
                if len(held) > flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    partial = sample.select("text", F.col("toxic").cast("double").alias("toxic")).mapInPandas(run, "feature string, pos long, neg long, docs long")
    return partial.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "docs")])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic, labelled): at most ``rows`` documents outside the held-out fold, by hash.

    Three quarters are labelled; of the others the label, if there is one, is known but not to be used as one. Those
    without a label come first among them.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(~held_out()).where("doc_id IS NOT NULL").select("doc_id").distinct().join(known, "doc_id", "left")
    anchors = ids.where("toxic IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows * 3 // 4).withColumn("labelled", F.lit(True))
    others = ids.join(F.broadcast(anchors.select("doc_id")), "doc_id", "left_anti").orderBy(F.col("toxic").isNotNull(), F.xxhash64("doc_id"), "doc_id")
    chosen = anchors.unionByName(others.limit(rows - rows * 3 // 4).withColumn("labelled", F.lit(False)))
    picked = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return picked.where("text <> ''").select("doc_id", "text", "toxic", "labelled")


def label_model(votes: np.ndarray, anchors: np.ndarray | None = None, rounds: int = 100, tied: float = 0.2) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of votes (+1, -1, 0 for none) by its votes alone, and what was estimated.

    EM of a model in which a voter's votes depend on the class only, started from the votes themselves (voters
    are taken to be right more often than not). anchors (1, 0, nan for most) are rows whose class is known
    while accuracies are estimated; their own posterior does not use it. Where voters still agree once the
    class is known, their residual correlation is over ``tied``, and they share their weight.
    """
    anchors = np.full(len(votes), np.nan) if anchors is None else anchors
    fixed = ~np.isnan(anchors)
    n, m = votes.shape
    outcomes = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    spoken = np.maximum((votes != 0).sum(1), 1)
    posterior = 0.05 + 0.9 * np.clip(0.5 + 0.5 * votes.sum(1) / spoken, 0, 1)
    weight, correlation = np.ones(m), np.zeros((m, m))
    for step in range(rounds):
        held = np.where(fixed, np.nan_to_num(anchors), posterior)
        prior = np.clip(held.mean(), 1e-3, 1 - 1e-3)
        tables = []
        for p in (1 - held, held):
            totals = np.einsum("n,nmv->mv", p, outcomes) + np.array([0.5, 1.0, 0.5])
            tables.append(totals / totals.sum(1, keepdims=True))
        odds = np.einsum("nmv,mv->nm", outcomes, np.log(tables[1]) - np.log(tables[0]))
        after = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + odds @ weight, -30, 30)))
        still = np.abs(after - posterior).max() < 1e-6
        posterior = after
        if step % 5 == 4:
            expected = held[:, None] * (tables[1] @ [-1, 0, 1]) + (1 - held)[:, None] * (tables[0] @ [-1, 0, 1])
            rest = votes - expected
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            correlation = (rest.T @ rest / n) / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0)
            weight = 1 / (1 + np.where(correlation > tied, correlation, 0).sum(1))
        elif still and step > 10:
            break
    accuracy = (tables[1][:, 2] * prior + tables[0][:, 0] * (1 - prior)) / np.maximum(1e-9, 1 - tables[1][:, 1] * prior - tables[0][:, 1] * (1 - prior))
    return posterior, {"accuracy": accuracy, "correlation": correlation, "weight": weight, "prior": prior}


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, l2), 1e-6])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        largest = np.abs(step).max()
        w -= step * min(1, 2 / (largest + 1e-12))  # shortened, not bent
        if largest < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, features: int = 400, mined: int = 150, lexicons: int = 12, trust: float = 0.97, l2: float = 0.3) -> Model:
    """Train on a sample of at most ``sample_rows`` documents; the driver gets their feature counts only.

    Without labelled training rows the fixed lexicon is all there is to learn from; with no rows at all,
    or one class only, the model is the lexicon with a fixed weight for each word.
    """
    fixed = [w + "$" for words in LEXICON.values() for w in words]
    fallback = Model(fixed, np.full(len(fixed), 3.0), -2.0)
    sample = materialise(training_sample(docs, labels, sample_rows), "toxic_sample")
    labelled = sample.withColumn("toxic", F.when(F.col("labelled"), F.col("toxic")))
    classes = labelled.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not classes[0] or not classes[1]:
        return fallback
    pos, neg = classes
    share = (F.col("pos") + F.col("neg")) / F.lit(float(pos + neg))
    gap = F.col("pos") / F.lit(float(pos)) - F.col("neg") / F.lit(float(neg))
    z = gap / F.sqrt(share * (1 - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-9))
    ranked = feature_counts(labelled).where(F.col("pos") >= max(3, pos // 300)).withColumn("z", z)
    chosen = [r["feature"] for r in ranked.orderBy(F.desc("z"), "feature").limit(features).collect()]
    names = list(dict.fromkeys([*chosen, *fixed, *(w + "$" for w in COURTESY)]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(names)
        for batch in batches:
            counts = [matcher.count(t) for t in batch["text"]]
            flags = [[bool(p.search(t.lower())) for p in PATTERNS.values()] for t in batch["text"]]
            yield pd.DataFrame({
                "place": [list(c) for c in counts], "n": [list(c.values()) for c in counts], "flags": flags, "toxic": batch["toxic"].to_numpy(), "labelled": batch["labelled"].to_numpy(),
            })

    counted = labelled.select("text", F.col("toxic").cast("double").alias("toxic"), "labelled")
    rows = counted.mapInPandas(count, "place array<int>, n array<long>, flags array<boolean>, toxic double, labelled boolean").collect()
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r["place"]] = np.log1p(r["n"])
    known = np.array([np.nan if r["toxic"] is None else float(r["toxic"] > 0) for r in rows])

    at = {f: i for i, f in enumerate(names)}
    says = lambda features: x[:, [at[f] for f in features]].any(1).astype(float)
    fixed_voters = [says([w + "$" for w in words]) for words in LEXICON.values()]
    patterns = np.array([r["flags"] for r in rows], dtype=float).reshape(len(rows), -1)
    mine = [chosen[:mined][i * mined // lexicons : (i + 1) * mined // lexicons] for i in range(lexicons)]  # the surest together
    votes = np.array([*fixed_voters, *patterns.T, *(says(part) for part in mine if part)]).T
    silent = -(votes.sum(1, keepdims=True) == 0).astype(float)  # no voter spoke: one against
    votes = np.hstack([votes, -says([w + "$" for w in COURTESY])[:, None], silent])
    anchors = np.where([r["labelled"] for r in rows], known, np.nan)
    posterior, _ = label_model(votes, anchors)
    known_odds = np.where(np.isnan(anchors), 0, np.log(trust / (1 - trust)) * (2 * np.nan_to_num(anchors) - 1))
    posterior = np.clip(posterior, 1e-9, 1 - 1e-9)
    posterior = 1 / (1 + np.exp(-known_odds) * (1 - posterior) / posterior)

    w = logistic(x, posterior, l2)
    model = Model(names, w[:-1], float(w[-1]))
    sure = ~np.isnan(known)
    margin = x[sure] @ w[:-1] + w[-1]
    slope, shift = logistic(margin[:, None], known[sure], 1e-3)
    if slope > 0:
        model.slope, model.shift = float(slope), float(shift)
    return model


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """documents -> their columns and a score (0 to 1) in column ``into``; null texts score like empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.select("*", scored(text_or_empty()).alias(into))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row per input row.

    Empty and null texts get the score of a text without any feature. Repeated rows are each scored;
    an empty table gives no rows.
    """
    model = fit(docs, labels, **how)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
