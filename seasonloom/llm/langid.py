"""Language identification by words, with back-off to character n-grams for unseen words.

A model holds log frequencies by language of the most frequent words and of character n-grams (5 down to 1 letters,
word edges included for 3 and more), learned from labelled documents. A word that the model knows adds its log
frequency for each language; an unseen word adds the mean over its letters of the longest n-gram known there, 5 first
and then shorter ones. The best sum names the language, and its share after softmax is the score.

Words are runs of letters, in lower case. Null text and text without a letter get the language und and score 0; ties
go to the first language by name. Rows without a language teach nothing; without any labelled row every text is und.
Each row is predicted on its own (repeated rows alike), whole and of any length; only the named columns are read. An empty
table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm import textops
from seasonloom.llm.common import doc_hash, give_back, stored, worker_cache

#: Bounds of the fit, parameters of train(): about so many documents of each language, chosen by hash; languages, the
#: most frequent ones; words and n-grams (each n) of the model, the most frequent ones in the sample.
DOCS_PER_LANG, LANGS, MODEL_WORDS, MODEL_GRAMS = 1500, 1000, 60_000, 30_000
LONGEST = 5
TABLE_BITS = 18


class HashTable:
    """Rows by 64-bit key: places by the key's low bits, open addressing, checked by the whole key."""

    def __init__(self, keys, bits: int = TABLE_BITS):
        while len(keys) * 2 > 1 << bits:
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            spot = ((keys[left] + np.uint64(probe)) & self.mask).astype(np.int64)
            free = self.row[spot] < 0
            _, first = np.unique(np.where(free, spot, -1 - np.arange(len(spot))), return_index=True)
            first = first[free[first]]
            self.key[spot[first]], self.row[spot[first]] = keys[left[first]], left[first]
            left = np.delete(left, first)
            probe += 1
        self.probes = probe

    def find(self, keys):
        """The row of each key, -1 if absent."""
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for probe in range(self.probes):
            spot = ((keys[open_] + np.uint64(probe)) & self.mask).astype(np.int64)
            row = self.row[spot]
            hit = (row >= 0) & (self.key[spot] == keys[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row >= 0)]
            if not len(open_):
                break
        return out


def letter_words(texts):
    """Code points in lower case, the places that are letters, and the words of texts."""
    chars, begins = textops.code_points(texts)
    letter, lower = textops.letter_tables()
    chars = lower[chars]
    is_letter = letter[chars]
    return chars, is_letter, textops.Words(chars, is_letter, begins)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", per_lang: int = DOCS_PER_LANG, most_langs: int = LANGS, most_words: int = MODEL_WORDS, most_grams: int = MODEL_GRAMS) -> bytes:
    """A model from labelled rows: at most about per_lang documents of each language, chosen by a hash of key; counts are
    summed on the executors. The most_langs most frequent languages are learned, with most_words words and most_grams
    n-grams of each length: a word beyond them is one that the model hasn't seen, and backs off."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return pickle.dumps(None)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / sizes[lang]))])
    number = F.pmod(F.xxhash64("key", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(number < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(frames):
        worker_cache("langid")  # no other operator's models beside the counts
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                texts = list(own["text"])
                for a, b in textops.batches(texts):
                    chars, is_letter, words = letter_words(["", *texts[a:b]])  # the first text too has an edge before it
                    kinds = [(0, words.hashes())] + [(n, h) for n, _, h in textops.ngrams(chars, ~is_letter, 1, LONGEST)]
                    for n, h in kinds:
                        keys, times = np.unique(h, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "n": n, "gram": keys.view(np.int64), "times": times})
        give_back()

    counts = sample.mapInPandas(count, "lang string, n int, gram long, times long").groupBy("n", "gram", "lang").agg(F.sum("times").alias("times"))
    counts = stored(counts, "language-counts")  # read once for each n
    totals = counts.groupBy("n", "lang").agg(F.sum("times").alias("all")).collect()
    by_gram = counts.groupBy("n", "gram").agg(F.sum("times").alias("times"), F.collect_list(F.struct("lang", "times")).alias("by"))  # a row per language at most
    kept = {}
    for n in range(LONGEST + 1):
        top = by_gram.where(F.col("n") == n).orderBy(F.desc("times"), "gram").limit(most_grams if n else most_words)
        kept[n] = top.select("gram", "by").toArrow()  # numbers, not a Python object for each row
    return pickle.dumps(tables(kept, langs, {(r["n"], r["lang"]): r["all"] for r in totals}))


def tables(kept: dict, langs: list[str], totals: dict) -> dict:
    """Log frequencies as arrays: of each n, keys and a row by language. kept: Arrow tables of gram and by, a list of (lang, times)."""
    model, place = {"langs": langs}, {lang: k for k, lang in enumerate(langs)}
    for n, table in kept.items():
        grams = table["gram"].to_numpy().astype(np.int64)
        logs = np.zeros((len(grams), len(langs)))
        at = 0
        for chunk in table["by"].chunks:
            flat, ends = chunk.flatten(), chunk.offsets.to_numpy()
            row = at + np.repeat(np.arange(len(chunk)), np.diff(ends))
            names = flat.field("lang").dictionary_encode()
            of = np.array([place[x] for x in names.dictionary.to_pylist()], dtype=np.int64)
            logs[row, of[names.indices.to_numpy()]] = flat.field("times").to_numpy()
            at += len(chunk)
        all_ = np.array([totals.get((n, lang), 0) for lang in langs], dtype=float)
        model[n] = (grams.view(np.uint64), np.log((logs + 0.1) / (all_ + 0.1 * max(1, len(grams)))).astype(np.float32))
    return model


class Scorer:
    """A model made ready for lookups."""
    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.tables = {n: HashTable(model[n][0]) for n in range(LONGEST + 1)}
        self.logs = {n: model[n][1] for n in range(LONGEST + 1)}

    def predict(self, texts: list[str]):
        """Languages and scores of texts."""
        chars, is_letter, words = letter_words(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        if len(words.doc):
            rows = self.tables[0].find(words.hashes())
            logs = np.zeros((len(rows), len(self.langs)))
            known = rows >= 0
            logs[known] = self.logs[0][rows[known]]
            if not known.all():
                # only the unseen words, laid out again with one edge between
                lengths = (words.ends - words.starts)[~known]
                starts = words.starts[~known]
                ends = np.cumsum(lengths + 1)
                place = np.arange(ends[-1]) - np.repeat(ends - lengths - 1, lengths + 1)
                edge = place == np.repeat(lengths, lengths + 1)
                source = np.minimum(np.repeat(starts, lengths + 1) + place, len(chars) - 1)
                own = np.concatenate([[32], np.where(edge, np.uint32(32), chars[source])]).astype(np.uint32)
                space = np.concatenate([[True], edge])
                best = np.full(len(own), 0, np.int64)
                level = np.zeros(len(own), np.int8)
                for n, places, h in textops.ngrams(own, space, 1, LONGEST):
                    found = self.tables[n].find(h)
                    hit = places[found >= 0]
                    best[hit], level[hit] = found[found >= 0], n
                grams = np.zeros((len(own), len(self.langs)))
                for n in range(1, LONGEST + 1):
                    here = level == n
                    grams[here] = self.logs[n][best[here]]
                # a gram may begin at the edge before the word, none at the edge after it
                first = np.concatenate([[0], ends[:-1]])
                count = np.maximum(np.add.reduceat((level > 0).astype(float), first), 1)
                logs[~known] = np.add.reduceat(grams, first) / count[:, None]
            for k in range(len(self.langs)):
                sums[:, k] = np.bincount(words.doc, weights=logs[:, k], minlength=len(texts))
        has = words.per_doc() > 0
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, share, 0.0)


def predict(docs: DataFrame, model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with lang_pred and score, for each row. One scan, no shuffle; the model's size is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames):
        worker_cache("langid")  # no other operator's models beside this one
        spec = pickle.loads(shared.value)
        scorer = Scorer(spec) if spec else None
        for frame in frames:
            texts = [t or "" for t in frame[column].where(frame[column].notna(), "")]
            for a, b in textops.batches(texts):
                langs, scores = scorer.predict(texts[a:b]) if scorer else (["und"] * (b - a), [0.0] * (b - a))
                out = frame.iloc[a:b][list(keep)]
                yield out.assign(lang_pred=pd.Series(langs, index=out.index, dtype=object), score=pd.Series(scores, index=out.index, dtype=float))
        give_back()

    # a text that is kept goes to the workers once
    column = text_col if text_col in keep else "_text"
    read = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in keep)
    return read.mapInPandas(work, f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """The fold that never teaches."""
    return F.coalesce(doc_hash(F.col(key), 4) == 2, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred and score of each row, by a model of the rows that aren't held out."""
    model = train(docs.where(~held_out(key)), key=key)
    found = predict(docs.select(F.col(key).alias("_key"), "text"), model, keep=("_key",))
    return found.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), "lang_pred", "score")
