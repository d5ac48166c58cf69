"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Training is stochastic gradient descent in numpy on a bounded sample of labelled documents, whose
features are counted on Spark. The average is followed by a linear layer, so a trained model comes
down to one number per bucket; scoring adds those up over a whole text.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepress.llm.texts import map_texts

BUCKETS = 1 << 17
DIMENSIONS = 8
#: Labelled documents of each class that train a model, those with the smallest id hashes.
SAMPLE = 2000
EPOCHS, RATE, SEED = 8, 4.0, 11
SIZES = (3, 4)
#: A document of this score or more is predicted to be good.
THRESHOLD = 0.7
MEMORY, WORD_LIMIT = 400_000, 64
#: The word that stands for "the same word again", whatever the word.
AGAIN = "\x00"


def buckets_of(word: str) -> list[int]:
    """Buckets of a word and of the character n-grams of the word between marks."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    crc, last = zlib.crc32, BUCKETS - 1
    if len(marked) == len(word) + 2:
        grams = [marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)]
    else:
        text = f"<{word}>"
        grams = [text[i : i + n].encode("utf-8", "surrogatepass") for n in SIZES for i in range(len(text) - n + 1)]
    return [crc(marked) & last, *[crc(x) & last for x in grams]]


@dataclass
class Model:
    """What every bucket adds to the log odds of the better class, and their constant part."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        weights, bias, known = self.weights.tolist(), self.bias, {}
        again = [weights[x] for x in buckets_of(AGAIN)]
        again = (sum(again), len(again))

        def score(text: str) -> tuple[float]:
            total, count, last = 0.0, 0, None
            for word in text.split():
                found = known.get(word)
                if found is None:
                    buckets = buckets_of(word)
                    found = (sum([weights[x] for x in buckets]), len(buckets))
                    if len(word) <= WORD_LIMIT:
                        if len(known) >= MEMORY:
                            known.clear()
                        known[word] = found
                total += found[0]
                count += found[1]
                if word == last:
                    total += again[0]
                    count += again[1]
                last = word
            odds = bias + (total / count if count else 0.0)
            return (1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))),)

        return score


def held_out(id: Column) -> Column:
    """Documents whose labels are never learned: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(text: str) -> tuple[bytes, bytes]:
    found: list[int] = []
    last = None
    for word in text.split():
        found += buckets_of(word)
        if word == last:
            found += buckets_of(AGAIN)
        last = word
    buckets, counts = np.unique(np.array(found, np.int32), return_counts=True)
    return buckets.astype("<i4").tobytes(), counts.astype("<f4").tobytes()


def training_rows(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> tuple[DataFrame, dict[int, int]]:
    """Feature counts of the sampled documents of each class, and how many labels a class has."""
    marked = labels.select(F.col(id).alias("id"), F.col("quality").cast("int").alias("label"))
    marked = marked.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    sizes = {x.label: x["count"] for x in marked.groupBy("label").count().collect()}
    chosen = [
        marked.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)
    ]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).distinct())  # 2 * sample rows at most
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # An id with several texts is represented by the least of them.
    texts = texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return map_texts(texts, ["id", "label"], "text", lambda: _counted, "buckets binary, counts binary"), sizes


def train(rows: list[tuple], sizes: dict[int, int], seed: int = SEED) -> Model:
    """Fit the vectors and the softmax layer; ``rows`` has (id, label, buckets, counts).

    Classes are sampled evenly and weighted back to their share among all labels, so scores are
    probabilities. Without any labelled row nothing is known against a document: scores are 1.
    """
    rows = sorted(rows, key=lambda x: (x[0], x[1]))
    drawn = {c: sum(x[1] == c for x in rows) for c in (0, 1)}
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 500.0)
    known = {c: sizes.get(c, 0) if drawn[c] else 0 for c in (0, 1)}
    total = sum(known.values())
    prior = np.log((known[1] + 0.5) / (known[0] + 0.5))
    if not all(drawn.values()):
        return Model(np.zeros(BUCKETS, np.float32), float(prior))
    weight = {c: known[c] / total * len(rows) / drawn[c] for c in (0, 1)}
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.array([0.0, prior], np.float32)
    cases = []
    for _, label, buckets, counts in rows:
        counts = np.frombuffer(counts, "<f4")
        cases.append((label, np.frombuffer(buckets, "<i4"), counts / max(1.0, float(counts.sum()))))
    steps, step = EPOCHS * len(cases), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(cases)):
            label, buckets, share = cases[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[buckets]
            odds = mean @ layer + bias
            exact = np.exp(odds - odds.max())
            error = exact / exact.sum()
            error[label] -= 1
            error *= weight[label]
            back = layer @ error
            layer -= np.float32(rate) * np.outer(mean, error)
            bias -= np.float32(0.05 * rate) * error
            vectors[buckets] -= np.float32(rate) * np.outer(share, back)
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Train on the whole texts of at most ``sample`` labelled documents of each class.

    The sample is the only bound; counts of the classes cover all labels. Rows with a NULL id or
    a label other than 0 and 1 train nothing, an id labelled both ways trains both.
    """
    rows, sizes = training_rows(docs, labels, id, text, sample)
    return train([tuple(x) for x in rows.collect()], sizes)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``score``, the probability of the better class, of every whole text.

    A NULL or empty text has the share of good documents among the labels as its score.
    """
    return map_texts(docs, keep, text, model.scorer, "score double")


def accepted(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with their own columns."""
    numbered = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    scored = score(numbered, fit(docs, labels, id, text), ["row"], "text")
    return scored.filter(F.col("score") >= threshold).select("row.*")
