"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax on top.

Every word (a run of other than white space, as written) and its character n-grams of 3 to 5 (with the word's edges)
hash to buckets, each with a learned vector; a word that repeats the one before it adds a token for that. A document is the mean of its vectors; a linear layer gives two logits.
Training is stochastic gradient descent in numpy, with step sizes by coordinate, over a bounded labelled sample. As
the layer is linear, a trained bucket adds one number to a document's difference of logits, which makes scoring fast.

The score is the probability of label 1. Empty and null texts score by the learned bias. Without labelled rows every
score is 0.5. Whole texts count; each row is scored on its own (repeated rows alike); other columns pass by.
Texts may be of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm import textops
from seasonloom.llm.common import doc_hash, fitted, labelled_sample

#: Bound of the training sample (labelled documents), buckets, vector size, passes and first step size.
TRAIN_DOCS, BUCKET_BITS, SIZE, PASSES, RATE = 5000, 17, 8, 5, 0.15
GRAMS = (3, 5)
#: Bucket of the token that stands for a word equal to the one before it, added to such words.
SAME_WORD = 0x5A5A5


def features(texts: list[str], bits: int = BUCKET_BITS):
    """Buckets of all words and n-grams of a batch of texts, and the text of each."""
    chars, begins = textops.code_points(["", *texts])  # the first text too has an edge before it
    begins = begins[1:]
    space = (chars == 32) | (chars >= 9) & (chars <= 13)
    words = textops.Words(chars, ~space, begins)
    mask = np.uint64((1 << bits) - 1)
    h = words.hashes()
    again = np.flatnonzero((h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
    ids, docs = [(h & mask).astype(np.int32), np.full(len(again), SAME_WORD & int(mask), np.int32)], [words.doc, words.doc[again]]
    for _, places, h in textops.ngrams(chars, space, *GRAMS):
        ids.append((h & mask).astype(np.int32))
        docs.append(np.searchsorted(begins, places + 1, side="right") - 1)
    return np.concatenate(ids), np.concatenate(docs)


def fit(rows: list[tuple]) -> bytes:
    """Trains on (doc_id, text, label) rows: a number by bucket, and the bias."""
    labels = [int(r[2] == 1) for r in rows]
    if not rows:
        return pickle.dumps((np.zeros(1 << BUCKET_BITS, np.float32), 0.0))
    sparse = []
    for _, text, _ in rows:
        ids, _ = features([text])
        unique, times = np.unique(ids, return_counts=True)
        sparse.append((unique, (times / max(1, len(ids))).astype(np.float32)))
    rng = np.random.default_rng(6)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BUCKET_BITS, SIZE)).astype(np.float32)
    seen = np.full((1 << BUCKET_BITS, SIZE), 1e-8, np.float32)
    top, bias = rng.uniform(-1, 1, (2, SIZE)).astype(np.float32), np.zeros(2, np.float32)
    top_seen, bias_seen = np.full_like(top, 1e-2), np.full_like(bias, 1.0)
    for turn in range(PASSES):
        rate = RATE * (1 - turn / PASSES)
        for k in rng.permutation(len(rows)):
            ids, share = sparse[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(SIZE, np.float32)
            logits = top @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            down = p @ top
            top_grad = np.outer(p, hidden)
            top_seen += top_grad**2
            top -= rate * top_grad / np.sqrt(top_seen)
            bias_seen += p**2
            bias -= rate * p / np.sqrt(bias_seen)
            if len(ids):
                grad = share[:, None] * down
                seen[ids] += grad**2
                vectors[ids] -= rate * grad / np.sqrt(seen[ids])
    vectors[seen[:, 0] <= 1e-8] = 0  # buckets without training say nothing
    return pickle.dumps(((vectors @ (top[1] - top[0])).astype(np.float32), float(bias[1] - bias[0])))


def score(docs: DataFrame, model: bytes, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key and score of each row. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames):
        weight, bias = pickle.loads(shared.value)
        for frame in frames:
            texts = [t or "" for t in frame["text"].where(frame["text"].notna(), "")]
            found = [np.zeros(0)]
            for a, b in textops.batches(texts):
                ids, docs_ = features(texts[a:b])
                total = np.bincount(docs_, weights=weight[ids], minlength=b - a)
                found.append(total / np.maximum(np.bincount(docs_, minlength=b - a), 1) + bias)
            yield pd.DataFrame({"key": frame["key"], "score": 1 / (1 + np.exp(-np.clip(np.concatenate(found), -30, 30)))})

    read = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return read.mapInPandas(work, f"key {read.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """The fold that never teaches."""
    return F.coalesce(doc_hash(F.col(key), 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of each row, by a model of labels.quality outside the held-out fold."""
    model = fitted(labelled_sample(docs, labels, "quality", train_docs, ~held_out()), fit)
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
