"""Toxicity classifier that is made indifferent to which group a text mentions.

A logistic model over the words and word beginnings that a text contains (each counts once, however long the text). Labelled
texts that name a group are copied with the term swapped for others of its set, and the fit penalises every change of the score
between a text and its copies, so that a group's name by itself carries no weight.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.language_model import remainder
from notewright.session import cut_lineage

#: Labelled rows that the fit reads at most (those of least hash of the id), and the features it weighs.
MOST_LABELLED = 12_000
FEATURES = 3_000
LEAST_TEXTS = 3
#: Word beginnings, in characters; longer words than LONGEST count by their beginnings only.
BEGINNINGS = (3, 4, 5)
LONGEST = 40
#: Weight of the penalty on squared score changes, and of squared weights.
INDIFFERENCE = 1.0
RIDGE = 2e-5
#: Copies of a text with swapped terms.
COPIES = 3

#: Terms that are swapped for one another.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "african", "european", "american", "chinese", "indian", "mexican"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("blind", "deaf", "disabled", "elderly", "young", "old"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("schwarze", "weiße"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("noirs", "blancs"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"), ("negros", "blancos"),
)

WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    found = ["^" + word[:k] for k in BEGINNINGS if len(word) >= k]
    if len(word) <= LONGEST:
        found.append("=" + word)
    return found


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def swapped(words: set[str], groups: tuple[tuple[str, ...], ...] = GROUPS, copies: int = COPIES) -> list[set[str]]:
    """The words of up to `copies` counterfactual texts: every term is replaced by the next, second next ... of its group."""
    place = {term: (g, i) for g, terms in enumerate(groups) for i, term in enumerate(terms)}
    hit = words & place.keys()
    if not hit:
        return []
    out = []
    for step in range(1, copies + 1):
        new = (words - hit) | {groups[g][(i + step) % len(groups[g])] for g, i in (place[term] for term in hit)}
        if new != words and new not in out:
            out.append(new)
    return out


@dataclass
class Classifier:
    """Weights by feature. Small and fixed in size: it goes to every worker."""

    bias: float
    weights: dict[str, float]
    #: False where there was nothing to learn from: every score is 0 then.
    fitted: bool = True
    _known: dict[str, tuple] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        known, weights = self._known, self.weights
        found: dict[str, float] = {}
        for word in words_of(text):
            hits = known.get(word)
            if hits is None:
                hits = tuple((f, weights[f]) for f in features_of(word) if f in weights)
                if len(known) >= 200_000:
                    known.clear()
                known[word] = hits
            if hits:
                found.update(hits)
        z = self.bias + math.fsum(found.values())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(labels: np.ndarray, rows: list[list[int]], pairs: list[tuple[int, list[int]]], size: int, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise log loss + RIDGE * |w|^2 + INDIFFERENCE * mean squared score change over the pairs."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64)
    # A pair's change of score is the sum over the features that only one side has.
    p_row, p_col, p_sign = [], [], []
    for k, (i, other) in enumerate(pairs):
        a, b = set(rows[i]), set(other)
        for c, sign in [*((c, 1.0) for c in a - b), *((c, -1.0) for c in b - a)]:
            p_row.append(k)
            p_col.append(c)
            p_sign.append(sign)
    p_row, p_col, p_sign = np.array(p_row, dtype=np.int64), np.array(p_col, dtype=np.int64), np.array(p_sign)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    theta = np.zeros(size + 1)
    theta[-1] = math.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w = theta[:-1]
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        gradient = np.append(np.bincount(col, weights=error[row], minlength=size) + 2 * RIDGE * w, error.sum())
        if len(p_row):
            change = np.bincount(p_row, weights=p_sign * w[p_col], minlength=len(pairs))
            gradient[:-1] += 2 * INDIFFERENCE / len(pairs) * np.bincount(p_col, weights=p_sign * change[p_row], minlength=size)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta - 0.1 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on (doc_id, text) and (doc_id, toxic); ids with several labels take the highest, null labels are left out.

    Reads at most MOST_LABELLED labelled texts. Which features count is decided in Spark; the driver sees the feature numbers of
    these texts only. With no label the classifier scores everything 0.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    # At most MOST_LABELLED rows of two numbers: small enough to broadcast, whatever the input.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = cut_lineage(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[toxic > 0].update({f for w in words_of(text) for f in features_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pd.DataFrame({"f": part, "clean": [seen[0][f] for f in part], "toxic": [seen[1][f] for f in part]})

    totals = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if not bad + good:
        return Classifier(0.0, {}, fitted=False)
    counts = sample.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    counts = counts.filter(F.col("a") + F.col("b") >= LEAST_TEXTS)
    shift = F.col("b") / max(bad, 1) - F.col("a") / max(good, 1)
    pooled = (F.col("a") + F.col("b")) / (bad + good)
    strength = shift * shift / (pooled * (1 - pooled) + F.lit(1e-9))
    names = [r["f"] for r in counts.orderBy(strength.desc(), "f").limit(FEATURES).select("f").collect()]
    number = {f: i for i, f in enumerate(names)}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def numbers(words: Iterable[str]) -> list[int]:
            return sorted({number[f] for w in words for f in features_of(w) if f in number})

        for batch in batches:
            texts = [words_of(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"toxic": batch["toxic"], "x": [numbers(w) for w in texts], "copies": [[numbers(s) for s in swapped(w)] for w in texts]}
            )

    rows = sample.mapInPandas(project, "toxic int, x array<int>, copies array<array<int>>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"], r["copies"]))  # the same sums whatever the order of arrival
    pairs = [(i, copy) for i, r in enumerate(rows) for copy in r["copies"]]
    bias, weights = fit(np.array([r["toxic"] > 0 for r in rows], dtype=float), [r["x"] for r in rows], pairs, len(names))
    return Classifier(bias, {f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-4})


def toxicity(text: Column, model: Classifier) -> Column:
    """Score of a text column, 0 to 1; null texts are empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Only the text is scored; rows with repeated or null ids stay rows."""
    model = train(docs, labels)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return rows.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those scored 0.5 or more; same columns."""
    model = train(docs, labels)
    return docs.filter(toxicity(F.col("text"), model) < 0.5)
