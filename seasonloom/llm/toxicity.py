"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Words are runs of letters in lower case; all words of the examples count. Examples are vectors of (1 + log tf) * idf *
weight, of length 1: words whose document counts in toxic and other examples differ by a log-likelihood ratio far beyond
chance have weight 1, others less, down to a hundredth. Examples with equal vectors share an entry of the index, which
keeps their count and toxic count. The entries stand in blocks, with each common word's greatest weight by block and
the postings of rarer words. A query adds these maxima by block, takes the highest blocks first and then all that can
still reach its k-th best cosine: the nearest entries are exact. Their votes, weighted by nearness, give a share that a
table learned on the examples themselves (each left out of its own entry) turns into a probability; texts without any
word of the examples get the share of such examples. Evidence is the nearest entries' first doc_id, cosine and share of
toxic examples.

Null and empty texts hold no word. Without labelled rows all scores are 0; an empty table gives an empty result. Whole
texts of any length count; repeated rows are scored alike, and teach once by doc_id; ties in nearness go to the entry with
the smaller doc_id.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm.common import doc_hash, fitted, labelled_sample, worker_cache

#: Bound of the labelled examples; nearest entries that vote; entries of a block; words with a full row in the index; texts scored together; postings read at once.
EXAMPLES, NEAREST, BLOCK, COMMON, TOGETHER, POSTINGS = 8000, 10, 64, 400, 64, 1 << 20
#: Log-likelihood ratio at which a word has its whole idf; count below which none is trusted; least share of idf.
FULL_RATIO, LEAST_COUNT, LEAST_WEIGHT = 30.0, 3, 0.01
LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower()) if text else []


def ratio(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio (2 * sum observed * log(observed / expected)) of a of n against b of m."""
    total, out = n + m, 0.0
    for seen, rows, column in ((a, n, a + b), (b, m, a + b), (n - a, n, total - a - b), (m - b, m, total - a - b)):
        if seen:
            out += seen * math.log(seen * total / (rows * column))
    return 2 * out


class BlockMaxIndex:
    """Unit vectors in blocks: of rare words their postings, of the most common ones all weights and each block's greatest.

    Entries that share their most common word stand together, so that a block's greatest weights are close to its others.
    """

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        size = [len(v) for v in vectors]
        word = np.fromiter((w for v in vectors for w in v), dtype=np.int64, count=sum(size))
        weight = np.fromiter((x for v in vectors for x in v.values()), dtype=float, count=sum(size))
        self.build(np.array(size, dtype=np.int64), word, weight, block)

    @classmethod
    def of(cls, size: np.ndarray, word: np.ndarray, weight: np.ndarray, block: int = BLOCK) -> BlockMaxIndex:
        """The index of vectors whose words and weights stand one after another, size of each."""
        index = cls.__new__(cls)
        index.build(size, word, weight, block)
        return index

    def build(self, size: np.ndarray, word: np.ndarray, weight: np.ndarray, block: int) -> None:
        self.n, self.block = len(size), block
        self.n_blocks = -(-self.n // block)
        entry = np.repeat(np.arange(self.n), size)
        often = np.bincount(word)
        top = np.full(self.n, -1)
        by_count = np.lexsort((word, often[word]))
        top[entry[by_count]] = word[by_count]  # the last one written is an entry's most common word
        self.of_spot = np.lexsort((np.arange(self.n), top))
        spot = np.argsort(self.of_spot)[entry]
        order = np.lexsort((spot, word))
        self.spot, self.weight = spot[order].astype(np.int32), weight[order]
        self.first = np.append(0, np.cumsum(often))  # a word's postings are first[w] to first[w + 1]
        frequent = np.flatnonzero(often > max(self.n // 32, block // 4))
        common = frequent[np.argsort(-often[frequent], kind="stable")][:COMMON]
        self.row = np.full(len(often), -1)  # by word: its place among the most common ones
        self.row[common] = np.arange(len(common))
        full = np.zeros((len(common), self.n_blocks * self.block))
        for k, w in enumerate(common):
            at = slice(self.first[w], self.first[w + 1])
            full[k, self.spot[at]] = self.weight[at]
        self.full = np.ascontiguousarray(full.reshape(len(common), self.n_blocks, self.block).swapaxes(0, 1))
        self.most = self.full.max(2).T if self.n else np.zeros((len(common), 0))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k entries of greatest product with query above 0, ties to the first entry, as (product, entry)."""
        return self.nearest_of([query], k)[0]

    def nearest_of(self, queries: list[dict[int, float]], k: int) -> list[list[tuple[float, int]]]:
        """nearest() of each query."""
        size = [len(q) for q in queries]
        word = np.fromiter((w for q in queries for w in q), dtype=np.int64, count=sum(size))
        weight = np.fromiter((x for q in queries for x in q.values()), dtype=float, count=sum(size))
        return self.nearest_to(np.array(size, dtype=np.int64), word, weight, k)

    def rare_products(self, n: int, query: np.ndarray, word: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By query and spot, what words with postings add; about POSTINGS of them are read at once."""
        out = np.zeros((n, self.n_blocks * self.block))
        begin = self.first[word]
        count = self.first[word + 1] - begin
        upto = np.cumsum(count)
        at = 0
        while at < len(word):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POSTINGS, side="right")))
            own = count[at:end]
            place = np.repeat(begin[at:end] - np.cumsum(own) + own, own) + np.arange(own.sum())
            low, high = int(query[at]), int(query[end - 1]) + 1
            spot = np.repeat((query[at:end] - low) * out.shape[1], own) + self.spot[place]
            out[low:high] += np.bincount(spot, weights=self.weight[place] * np.repeat(weight[at:end], own), minlength=(high - low) * out.shape[1]).reshape(high - low, -1)
            at = end
        return out.reshape(n, self.n_blocks, self.block)

    def nearest_to(self, size: np.ndarray, word: np.ndarray, weight: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """nearest() of queries whose words and weights stand one after another: a block is read for those queries only that it can still give one of the k."""
        n = len(size)
        if not self.n:
            return [[] for _ in range(n)]
        query = np.repeat(np.arange(n), size)
        known = word < len(self.row)
        query, word, weight = query[known], word[known], weight[known]
        row = self.row[word]
        often = np.zeros((n, self.full.shape[1]))
        often[query[row >= 0], row[row >= 0]] = weight[row >= 0]
        product = self.rare_products(n, query[row < 0], word[row < 0], weight[row < 0])
        bound = product.max(2) + often @ self.most
        whole = np.zeros_like(product)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        first = (rank < 4) & (bound > 0)
        self.read(first, product, often, whole)
        flat = whole.reshape(n, -1)
        least = np.partition(flat, -k, axis=1)[:, -k] if k < flat.shape[1] else np.zeros(n)
        self.read(~first & (bound > 0) & (bound >= least[:, None] - 1e-11), product, often, whole)
        out = []
        for row, low in zip(flat, least):
            near = np.flatnonzero(row >= max(low - 1e-11, 1e-300))
            value, entry = np.round(row[near], 12), self.of_spot[near]
            best = np.lexsort((entry, -value))[:k]
            out.append([(v, e) for v, e in zip(value[best].tolist(), entry[best].tolist()) if v > 0])
        return out

    def read(self, wanted: np.ndarray, product: np.ndarray, often: np.ndarray, whole: np.ndarray) -> None:
        """Writes the products of the wanted (query, block) pairs to whole."""
        for b in np.flatnonzero(wanted.any(0)):
            q = np.flatnonzero(wanted[:, b])
            whole[q, b] = product[q, b] + often[q] @ self.full[b]


class Model:
    """The examples' index with its calibration."""

    def __init__(self, rows: list[tuple]):
        toxic = sum(int(r[2] == 1) for r in rows)
        bags = [Counter(words(r[1])) for r in rows]
        counts = (Counter(), Counter())
        for bag, row in zip(bags, rows):
            counts[int(row[2] == 1)].update(bag.keys())
        clean = len(rows) - toxic
        vocab, idf = sorted(counts[0].keys() | counts[1].keys()), []
        for word in vocab:
            a, b = counts[1][word], counts[0][word]
            told = min(1.0, ratio(a, toxic, b, clean) / FULL_RATIO) ** 2 if a + b >= LEAST_COUNT else 0.0
            idf.append((math.log((1 + len(rows)) / (1 + a + b)) + 1) * max(LEAST_WEIGHT, told))
        of_word = {w: k for k, w in enumerate(vocab)}
        entries: dict[tuple, list] = {}
        bare = [0, 0]
        for bag, row in zip(bags, rows):
            key = tuple(sorted((of_word[w], tf) for w, tf in bag.items()))
            tally = entries.setdefault(key, [row[0], 0, 0]) if key else bare
            tally[-2] += 1
            tally[-1] += int(row[2] == 1)
        ordered = sorted(entries.items(), key=lambda x: (x[1][0], x[0]))
        prior = (toxic + 0.5) / (len(rows) + 1) if rows else 0.0
        size = np.array([len(k) for k, _ in ordered], dtype=np.int32)
        pairs = np.array([x for k, _ in ordered for x in k], dtype=np.int32).reshape(-1, 2)
        self.open({
            "vocab": "\n".join(vocab), "idf": np.array(idf), "size": size, "word": pairs[:, 0].copy(), "tf": pairs[:, 1].copy(),
            "entries": [e for _, e in ordered], "prior": prior, "bare": (bare[1] + prior) / (bare[0] + 1) if rows else 0.0, "levels": [],
        })
        self.levels = self.plain["levels"] = self.calibrated()

    def open(self, plain: dict) -> Model:
        """The model of its plain data, which is what is sent: the index follows from it."""
        self.plain = plain
        self.vocab = {w: k for k, w in enumerate(plain["vocab"].split("\n"))} if plain["vocab"] else {}
        self.idf, self.entries, self.prior, self.bare, self.levels = (plain[k] for k in ("idf", "entries", "prior", "bare", "levels"))
        size = plain["size"].astype(np.int64)
        self.index = BlockMaxIndex.of(size, plain["word"].astype(np.int64), self.weights(size, plain["word"], plain["tf"]))
        return self

    def weights(self, size: np.ndarray, word: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The unit vectors of texts with these words and counts, size of each."""
        raw = (1 + np.log(tf)) * self.idf[word] if len(word) else np.zeros(0)
        of = np.repeat(np.arange(len(size)), size)
        return raw / np.sqrt(np.bincount(of, weights=raw * raw, minlength=len(size)))[of]

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """size by text, words and counts, as far as the examples have the words."""
        get, size, word, tf = self.vocab.get, [], [], []
        for text in texts:
            before = len(word)
            for w, n in Counter(words(text)).items():
                k = get(w)
                if k is not None:
                    word.append(k)
                    tf.append(n)
            size.append(len(word) - before)
        return np.array(size, dtype=np.int64), np.array(word, dtype=np.int64), np.array(tf, dtype=np.int64)

    def vote(self, near: list[tuple[float, int]], left_out: tuple[int, int] | None = None) -> float:
        """Share of toxic examples among the nearest, by nearness; left_out: an entry and the label of its example that doesn't vote."""
        toxic, every = self.prior, 1.0
        for cosine, entry in near:
            weight = 1 / (1.05 - min(cosine, 1.0))
            _, n, t = self.entries[entry]
            if left_out and entry == left_out[0]:
                n, t = n - 1, t - left_out[1]
            toxic += weight * t
            every += weight * n
        return toxic / every

    def calibrated(self) -> list[tuple[float, float]]:
        """Votes of left-out examples in groups of rising share with their true share, made monotone (pool adjacent violators)."""
        votes = []
        size, word, tf = (self.plain[k] for k in ("size", "word", "tf"))
        upto = np.append(0, np.cumsum(size, dtype=np.int64))
        cuts = [(a, min(a + TOGETHER, len(size))) for a in range(0, len(size), TOGETHER)]
        found = (near for a, b in cuts for near in self.nearest(size[a:b].astype(np.int64), word[upto[a] : upto[b]].astype(np.int64), tf[upto[a] : upto[b]]))
        for entry, ((_, n, toxic), near) in enumerate(zip(self.entries, found)):
            if toxic:
                votes.append((self.vote(near, (entry, 1)), toxic, toxic))
            if n > toxic:
                votes.append((self.vote(near, (entry, 0)), n - toxic, 0))
        pools: list[list[float]] = []
        for v, n, toxic in sorted(votes):
            if not pools or pools[-1][1] >= 20:
                pools.append([0.0, 0, 0])
            pools[-1] = [x + y for x, y in zip(pools[-1], (v * n, n, toxic))]
        groups, pools = pools, []
        for group in groups:
            pools.append(group)
            while len(pools) > 1 and (pools[-1][1] < 20 or pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]):
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last)]
        return [(v / n, (toxic + self.prior) / (n + 1)) for v, n, toxic in pools]

    def nearest(self, size: np.ndarray, word: np.ndarray, tf: np.ndarray) -> list[list[tuple[float, int]]]:
        """The nearest entries of texts with these words and counts."""
        return self.index.nearest_to(size, word, self.weights(size, word, tf), NEAREST)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """Each text's probability and evidence."""
        size, word, tf = self.bags(texts)
        return [self.judged(near) if n else (self.bare, []) for n, near in zip(size, self.nearest(size, word, tf))]

    def judged(self, near: list[tuple[float, int]]) -> tuple[float, list]:
        """The probability and evidence that the nearest entries give."""
        at, levels = self.vote(near), self.levels
        share = float(np.interp(at, [x for x, _ in levels], [y for _, y in levels])) if levels else at
        return share, [{"doc_id": self.entries[e][0], "cosine": c, "toxic_share": self.entries[e][2] / self.entries[e][1]} for c, e in near]


def fit(rows: list[tuple]) -> bytes:
    """A pickled model of (doc_id, text, label) rows, as plain data: executors needn't import the package."""
    return zlib.compress(pickle.dumps(Model(rows).plain), 1)


def opened(model: bytes) -> Model:
    """The model, opened once in a worker."""
    cache = worker_cache("toxicity")
    if cache.get("toxicity", (None,))[0] != hash(model):
        cache["toxicity"] = hash(model), Model.__new__(Model).open(pickle.loads(zlib.decompress(model)))
    return cache["toxicity"][1]


def score(docs: DataFrame, model: bytes, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, score and evidence of each row. One scan, no shuffle; the model of a bounded sample is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames):
        scorer = opened(shared.value)
        for frame in frames:
            for start in range(0, len(frame), TOGETHER):
                part = frame.iloc[start : start + TOGETHER]
                found = scorer.scores([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"key": part["key"], "score": [s for s, _ in found], "evidence": [e for _, e in found]})

    read = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    return read.mapInPandas(work, f"key {kind}, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic_share: double>>").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """The fold that never teaches."""
    return F.coalesce(doc_hash(F.col(key), 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and evidence of each row, by labels.toxic outside the held-out fold."""
    model = fitted(labelled_sample(docs, labels, "toxic", examples, ~held_out()), fit)
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
