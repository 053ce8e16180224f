"""Quality classifier: a linear support vector machine over naive Bayes features.

Method: indicators of n-grams are scaled by their log-count ratio between the classes, then a linear
hinge-loss model is fitted on the scaled, length-normalised indicators by dual coordinate descent.
N-grams are of two kinds: four bytes in a row of the text as it stands, and four in a row of the
marks that say whether a word equals the one before it.

The model has a fixed size (a weight for each of `BUCKETS` hashed n-grams), whatever the corpus. It
is fitted in one task on a bounded sample of labelled rows; every text is then scored where it is
read, whole, and nothing but the model is sent anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fold, text_of, unpacked, whole

BUCKETS = 1 << 17  # hashed n-grams
SAMPLE = 3_000  # labelled rows of each class that the model is fitted on, at most
SMOOTHING = 1.0
COST = 1.0  # of a row on the wrong side
ROUNDS = 12  # of dual coordinate descent
THRESHOLD = 0.7

_MARKS = BUCKETS - 16  # the last buckets hold the marks of repeated words


def features() -> Callable[[str], np.ndarray]:
    """Text to the sorted numbers of the n-grams that it holds."""
    seen = np.zeros(BUCKETS, bool)

    def of(text: str) -> np.ndarray:
        raw = text.encode("utf-8", "surrogatepass")
        for shift in range(min(4, max(0, len(raw) - 3))):
            grams = np.frombuffer(raw, "<u4", (len(raw) - shift) // 4, shift)
            # Multiplicative hashing: the product's high bits, below the buckets of the marks.
            seen[((grams * np.uint32(2654435769)) >> np.uint32(15)) % np.uint32(_MARKS)] = True
        words = text.split()
        if len(words) > 4:
            same = np.fromiter(map(str.__eq__, words[1:], words), np.int64, len(words) - 1)
            seen[_MARKS + (same[:-3] + 2 * same[1:-2] + 4 * same[2:-1] + 8 * same[3:])] = True
        # Eight flags at a time, as few are set.
        groups = np.flatnonzero(seen.view(np.uint64))
        own, bit = np.nonzero(seen.reshape(-1, 8)[groups])
        found = groups[own] * 8 + bit
        seen[found] = False
        return found

    return of


def fit(texts: list[str], good: np.ndarray) -> np.ndarray:
    """The model: ratios, then weights times ratios, then bias, scale and shift of the score.

    Each fifth row is kept out of the fit to turn decisions into probabilities.
    """
    of = features()
    rows = [of(t).astype(np.int32) for t in texts]
    sign = np.where(good == 1, 1.0, -1.0)
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(sign[~aside])) < 2 or not aside.any():
        aside[:] = False
    train = np.flatnonzero(~aside)

    counts = {s: np.full(BUCKETS, SMOOTHING) for s in (1.0, -1.0)}
    for i in train:
        counts[sign[i]][rows[i]] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())

    scaled = []
    for ids in rows:
        x = ratio[ids]
        scaled.append(x / max(np.sqrt(x @ x), 1e-9))

    # Dual coordinate descent; the bias is one more feature that is always 1.
    n_good, n_bad = max(1, (sign[train] > 0).sum()), max(1, (sign[train] < 0).sum())
    most = np.where(sign > 0, COST * len(train) / (2 * n_good), COST * len(train) / (2 * n_bad))
    weights, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(ROUNDS):
        for i in order.permutation(train):
            ids, x = rows[i], scaled[i]
            slope = sign[i] * (weights[ids] @ x + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), most[i])  # |x|^2 + 1 is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[ids] += step * x
                bias += step
                alpha[i] = new

    # Probability of the good class by a logistic curve through the rows kept aside.
    against = np.flatnonzero(aside) if aside.any() else train
    decision = np.array([weights[rows[i]] @ scaled[i] + bias for i in against])
    scale, shift = logistic(decision, (sign[against] + 1) / 2)
    return np.concatenate([ratio, weights * ratio, [bias, scale, shift]]).astype("<f4")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (at least 0) and shift of a logistic curve through y, by Newton's steps on smoothed targets."""
    if not len(x):
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(d * x).sum() + 1e-3 * (a - 1), d.sum()]))
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return max(float(a), 1e-3), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text") -> np.ndarray:
    """A model from labelled rows that are not held out.

    Of each class the `sample` ids with the least digests are taken, so the sample is bounded and the
    same for any layout of the tables. Labels other than 0 and 1 and missing ids are passed over; of
    an id with several labels or texts the least counts. Without rows of both classes every text scores alike.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .where(fold(F.col("id")) != 2)
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    least = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)
    ]
    chosen = least[0].unionByName(least[1])  # at most 2 * sample rows of two numbers
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("id"), text_of(F.col(f"`{text}`")).alias("body"))
        .join(F.broadcast(chosen), "id")
        .groupBy("id")  # one text for each id, so that the sample stays bounded
        .agg(F.min("body").alias("body"), F.min("label").alias("label"))
    )

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", ignore_index=True)
        part = part.iloc[np.random.default_rng(1).permutation(len(part))]
        return pd.DataFrame({"model": [fit(list(part.body), part.label.to_numpy()).tobytes()]})

    learned = rows.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "model binary").collect()
    if not learned:
        return fit([], np.array([]))
    return np.frombuffer(learned[0]["model"], "<f4")


def scores(model: np.ndarray, text: Column) -> Column:
    """Probability that a text is of the good class. Null is the empty text, which scores by the bias alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = features()
        ratio, weights = model[:BUCKETS], model[BUCKETS : 2 * BUCKETS]
        square = ratio * ratio
        bias, scale, shift = (float(x) for x in model[2 * BUCKETS :])
        for texts in batches:
            found = map(of, texts)
            x = np.array([weights[ids].sum() / max(float(np.sqrt(square[ids].sum())), 1e-9) + bias for ids in found])
            yield pd.Series(1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30))), dtype=float)

    return score(text_of(text))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Documents with held_out, score (0 to 1) and predicted (1 from `threshold`); all columns and rows are kept.

    Rows with equal ids are scored each by its own text. Empty tables give an empty table.
    """
    rows = docs.select(whole(docs), fold(F.col("doc_id")).alias("fold"), scores(train(docs, labels, text=text), F.col(f"`{text}`")).alias("value"))
    return unpacked(
        rows,
        docs.columns,
        held_out=F.col("fold") == 2,
        score=F.col("value"),
        predicted=F.when(F.col("value") >= threshold, 1).otherwise(0).cast("int"),
    )
