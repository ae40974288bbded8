"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-proximal).

Features of a text are its distinct words (n = 1) and pairs of neighbouring words (n = 2), each hashed to one of ``BITS``
bits. Two additions that are no word n-grams go with them: pairs of neighbouring word shapes (a shape folds letters to
classes, so that never-seen words count by their form), and how often a word is said twice running. Values are scaled to
unit length. A score is the logistic of the sparse dot product with the weights. Labels only say what is learnt; no other
column is an input.

Training takes at most ``TRAIN_ROWS`` labelled rows (a documented bound; those with the smallest MD5 of their id), never
a row held out; of an id that several documents have, the first text counts. Every text is scored whole. Null and empty texts have no feature but the bias. Rows of ``labels`` with a
null id or label are left out; a document with several labels counts with each. Without any training row all scores are
0.5. Repeated rows, extra columns and empty tables need no rule: scoring handles every row alone.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
TRAIN_ROWS = 6_000
EPOCHS = 6
#: A mistake on a document of low quality costs this much; they are the rarer class.
LOW_COST = 3.0
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.05, 1.0

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(token: str) -> str:
    """A coarse form of a token: letters as x or X, digits as 9, marks as they are."""
    if token.isalpha():
        return ("X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() else "x") + ("l" if len(token) > 9 else "")
    return "9" if token.isdigit() else token[:3]


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature numbers of a text, sorted; number 0 is the bias."""
    tokens = _TOKEN.findall(text or "")
    shape: dict[str, str] = {}
    for t in set(tokens):
        shape[t] = _shape(t)
    forms = [shape[t] for t in tokens]
    grams = {f"s {a} {b}" for a, b in set(zip(forms, forms[1:]))}
    low = [t.lower() for t in tokens]
    words = set(low)
    grams |= {f"{a} {b}" for a, b in set(zip(low, low[1:]))}
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    if again:  # words said twice, in eighths of the text
        grams |= {f"r {k}" for k in range(1 + 8 * again // len(tokens))}
    mask = (1 << bits) - 1
    found = {1 + crc32(g.encode()) % mask for g in grams}
    found |= {1 + crc32(w.encode()) % mask for w in words}
    return np.array(sorted({0, *found}), np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; weights are lazily derived from the sums z and n."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, cost: float = 1.0) -> None:
        w, x = self.weights(at), 1 / math.sqrt(len(at))
        g = cost * (logistic(x * w.sum()) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents that are not held out. One task learns them in a fixed order.

    The sample has a fixed bound, as have the weights, so this task does not grow with the corpus.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")
    order = [F.md5(F.col("doc_id").cast("string")), "doc_id", "quality"]
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(rows)
    # At most ``rows`` ids and labels: a size that is known, so it may be broadcast. A repeated id gives one text.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=[crc32(str(i).encode()) for i in pdf.doc_id]).sort_values(["h", "doc_id", "quality", "text"])
        found = [features(t, bits) for t in pdf.text]
        model, order = Ftrl(bits), np.arange(len(pdf))
        for epoch in range(EPOCHS):
            np.random.default_rng(epoch).shuffle(order)
            for i in order:
                label = int(pdf.quality.iloc[i])
                model.learn(found[i], label, 1.0 if label else LOW_COST)
        return pd.DataFrame({"weights": [model.weights().astype(np.float32).tobytes()]})

    got = sample.groupBy(F.lit("all")).applyInPandas(learn, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32) if got else np.zeros(1 << bits, np.float32)


def scored(df: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text (double, 0 to 1). The weights, of a fixed size, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    bits = int(math.log2(len(weights)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([logistic(w[at].sum(dtype=np.float64) / math.sqrt(len(at))) for at in (features(t, bits) for t in texts)], dtype="float64")

    return df.withColumn(out, score(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    slim = docs.select("doc_id", "text")
    done = scored(slim, train(slim, labels))
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
