"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm.common import MULTIPLIER, slabs, table, written
from cohortline.llm.registry import register

ORDERS = (3, 4, 5)
BUCKET_BITS = 17
MOST_PER_CLASS = 5_000
FEATURES = 1_500
LEAST_DOCUMENTS = 5
SMOOTHING = 1.0
RIDGE = 1e-3
SLAB = 1 << 18


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every n-gram of the texts in lower case, one order after the other.

    A text is framed by two blanks so that words at its ends look like words inside; n-grams
    never run over the border of two texts.
    """
    framed = [f" {text.lower()} " for text in texts]
    sizes = np.array([len(text) for text in framed], np.int64)
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(framed), dtype=np.int32), sizes)
    hashed, order = points.copy(), 1
    for wanted in ORDERS:
        while order < wanted:
            hashed = hashed[:-1] * MULTIPLIER + points[order:]
            order += 1
        if not len(hashed):
            return
        inside = owner[: len(hashed)] == owner[order - 1 :]
        spread = (hashed ^ (hashed >> np.uint64(29))) * MULTIPLIER
        bucket = (spread >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        yield owner[: len(hashed)][inside], bucket[inside] + np.int32(ORDERS.index(wanted) << BUCKET_BITS)


BUCKETS = len(ORDERS) << BUCKET_BITS


def distinct_features(texts: list[str], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text number, bucket) pairs of the texts, of the wanted buckets only where given."""
    for owner, bucket in ngram_buckets(texts):
        if wanted is not None:
            hit = wanted[bucket]
            owner, bucket = owner[hit], bucket[hit]
        key = np.unique(owner.astype(np.int64) << 32 | bucket)
        yield (key >> 32).astype(np.int64), (key & 0xFFFFFFFF).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weight per n-gram bucket (log-count ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of texts: the weights of their distinct n-grams, through the logistic function."""
        total = np.full(len(texts), self.intercept)
        for start, end in slabs(map(len, texts), SLAB):
            for owner, bucket in distinct_features(texts[start:end], self.weights != 0):
                total[start:end] += np.bincount(owner, self.weights[bucket], end - start)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: documents with each bucket, by label."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        texts, labels = batch["text"].tolist(), batch["toxic"].to_numpy()
        for start, end in slabs(map(len, texts), SLAB):
            for owner, bucket in distinct_features(texts[start:end]):
                toxic = labels[start:end][owner] == 1
                counts[0] += np.bincount(bucket[~toxic], minlength=BUCKETS)
                counts[1] += np.bincount(bucket[toxic], minlength=BUCKETS)
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pd.DataFrame({"bucket": seen, "clean": counts[0][seen], "toxic": counts[1][seen]})


def fit(sample: DataFrame, features: int = FEATURES) -> Model:
    """The classifier of ``text, toxic`` rows, a bounded sample.

    Buckets' log-count ratios compare the smoothed shares of toxic and of clean documents
    that hold them. The ``features`` buckets whose difference is the surest (a z-value) are
    kept, each scaled by its ratio, and a logistic regression with a ridge penalty is fitted
    to them. One class only gives that class's constant score; no rows give 0.
    """
    size = sample.groupBy("toxic").count().collect()
    rows = {row["toxic"]: row["count"] for row in size}
    clean, toxic = rows.get(0, 0), rows.get(1, 0)
    if not clean or not toxic:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if toxic else -20.0)
    counted = sample.mapInPandas(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    # the number of buckets is fixed
    found = counted.where(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).toPandas()
    share_toxic = (found["toxic"].to_numpy() + SMOOTHING) / (toxic + 2 * SMOOTHING)
    share_clean = (found["clean"].to_numpy() + SMOOTHING) / (clean + 2 * SMOOTHING)
    ratio = np.log(share_toxic / share_clean)
    spread = np.sqrt(1 / (found["toxic"] + SMOOTHING) + 1 / (found["clean"] + SMOOTHING)).to_numpy()
    order = np.lexsort((found["bucket"].to_numpy(), -np.abs(ratio) / spread))[:features]
    buckets, ratios = found["bucket"].to_numpy()[order], ratio[order]
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets] = True
    column = np.zeros(BUCKETS, np.int32)
    column[buckets] = np.arange(len(buckets))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for start, end in slabs(map(len, texts), SLAB):
                parts = list(distinct_features(texts[start:end], wanted))
                owner = np.concatenate([np.empty(0, np.int64), *[o for o, _ in parts]])
                place = column[np.concatenate([np.empty(0, np.int64), *[b for _, b in parts]])]
                order = np.argsort(owner, kind="stable")
                cuts = np.cumsum(np.bincount(owner, minlength=end - start))[:-1]
                lists = [x.astype("<i4").tobytes() for x in np.split(place[order], cuts)]
                yield pd.DataFrame({"toxic": batch["toxic"].to_numpy()[start:end], "places": lists})

    # as many rows as the sample's bound, a few hundred bytes each
    matrix = sample.mapInPandas(held, "toxic int, places binary").toPandas()
    lists = [np.frombuffer(x, "<i4") for x in matrix["places"]]
    place = np.concatenate([np.empty(0, np.int32), *lists])
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    coefficients, intercept = _logistic(row, place, ratios, matrix["toxic"].to_numpy(np.float64))
    weights = np.zeros(BUCKETS, np.float32)
    weights[buckets] = coefficients * ratios
    return Model(weights, float(intercept))


def _logistic(row: np.ndarray, place: np.ndarray, ratios: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled presence matrix by accelerated gradient steps.

    Classes weigh as they are; inputs are divided by the mean row length so that one step size fits.
    """
    count = len(labels)
    norms = np.bincount(row, (ratios**2)[place], count)
    scale = np.sqrt(max(norms.mean(), 1e-12))
    value = ratios[place] / scale
    step = 4.0 / max((norms / scale**2).max() + 1, 1.0)
    w, b = np.zeros(len(ratios)), 0.0
    vw, vb = w.copy(), b
    for turn in range(300):
        z = np.bincount(row, value * vw[place], count) + vb
        gap = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        gw = np.bincount(place, value * gap[row], len(w)) / count + RIDGE * vw
        gb = gap.mean()
        nw, nb = vw - 4 * step * gw, vb - 4 * step * gb
        momentum = turn / (turn + 3)
        vw, vb = nw + momentum * (nw - w), nb + momentum * (nb - b)
        w, b = nw, nb
    return w / scale, b


def training_sample(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """``text, toxic`` of at most ``most_per_class`` labelled documents of each class.

    Those with the smallest hash of doc_id; rows whose crc32(doc_id) mod 5 is 0 are held out.
    Null ids, labels other than 0 and 1 and texts that are null are left out. The chosen ids
    are few (twice the bound), so they may be broadcast.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id")))
    keyed = known.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int"), F.xxhash64("doc_id").alias("key"))
    parts = [
        keyed.where(F.col("toxic") == label).orderBy("key", "id").limit(most_per_class).drop("key").distinct()
        for label in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, F.expr("doc_id = id")).select(
        "text", "toxic"
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> Model:
    """The model of a corpus; the sample is written once, for two passes over it."""
    return fit(written(training_sample(docs, labels, most_per_class), "toxicity-sample"))


def toxicity(text: Column, model: Model) -> Column:
    """Score of whole texts from 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.fillna("").tolist()))

    return score(text)


@register()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels are learned from those not held out."""
    documents = table(spark, sf_dir, "documents")
    model = trained(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
