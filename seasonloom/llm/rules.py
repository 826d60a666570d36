r"""Quality rules with line sequence labelling.

Base figures come from whole texts: words, characters of words, symbols, lines that repeat an earlier one, and words in
8-word windows that occur twice. Beside the fixed limits, a linear-chain conditional random field marks each line with
a word as content or boilerplate: a line's features (shares of capitals, symbols, digits and closing marks, its length,
words and repetition, each cut into a few levels) have weights by label, and neighbouring labels weights of their own.
Viterbi decoding finds the best marks; a text is kept if content lines hold at least half of its word characters. The
weights are fitted by gradient ascent on the likelihood of labelled documents, whose lines all bear their document's
label (bounded sample).

Words are [^\x20\x09-\x0D]+, lines split at \n. Null text has no words and fails, as does empty text. Without labelled
rows every line is content. Texts are read whole, of any length; each row is judged on its own, repeated rows alike, but
teaches once by doc_id; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm import textops
from seasonloom.llm.common import fitted, labelled_sample

#: Fixed by the contract: symbols, window of repeated words, least words, most repeated words of 100.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: Bound of the training sample; share of content that keeps a text; steps, rate and shrinkage of the fit.
TRAIN_DOCS, LEAST_CONTENT, STEPS, RATE, SHRINK = 3000, 0.5, 120, 0.5, 1e-3
#: Cuts of the line features, in order: words, characters a word, and shares of capitals, symbols, digits, marks that
#: are doubled, words that repeat the one before, distinct words; whether the line repeats, and ends like a sentence.
CUTS = ((2, 5, 12, 30), (3, 4.5, 6, 8, 12), (0.02, 0.1, 0.3, 0.6), (0.005, 0.03, 0.1, 0.2), (0.02, 0.1, 0.3), (0.005, 0.03, 0.1), (0.02, 0.1, 0.4), (0.3, 0.6, 0.9), (0.5,), (0.5,))
OFFSETS = np.cumsum([0, *[len(c) + 1 for c in CUTS]])

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[list(b".!?\"')")] = True


def sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of flags hold in each span."""
    upto = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[ends] - upto[starts]


def measure(texts: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Base figures by text; and of the lines with words, in order: levels of features (a column each), text, characters of words."""
    words = textops.byte_words(texts)
    chars, doc, n_docs = words.chars, words.doc, len(texts)
    hashes = words.hashes()
    points = (chars & 0xC0) != 0x80
    space = textops.BYTE_SPACE[chars]
    word_points = sums(points & ~space, words.starts, words.ends)
    base = pd.DataFrame({"n_words": words.per_doc(), "word_chars": np.bincount(doc, weights=word_points, minlength=n_docs).astype(np.int64)})
    begins = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])
    base["n_symbols"] = sums(_SYMBOL[chars], begins[:-1], begins[1:])
    # windows that occur twice: sorted by text and hash, equal neighbours
    h, at = textops.shingles(hashes, doc, WINDOW)
    first = np.flatnonzero(doc[: max(0, len(doc) - WINDOW + 1)] == doc[WINDOW - 1 :])
    order = np.lexsort((h, at))
    equal = (h[order][1:] == h[order][:-1]) & (at[order][1:] == at[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    base["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n_docs)
    # lines: the texts' own newlines and those between texts
    cuts = np.flatnonzero(chars == 10)
    line_of = np.searchsorted(cuts, words.starts)
    starts = np.concatenate([[0], cuts[:-1] + 1])
    lines, n_in = np.unique(line_of, return_counts=True)
    starts, ends = starts[lines], cuts[lines]
    line_doc = doc[np.searchsorted(line_of, lines)]
    # lines are equal if all their bytes are: white space counts, so hash the whole line
    whole = textops.Words(chars, chars != 10, begins[:-1])
    line_hash = whole.hashes()[np.searchsorted(whole.starts, starts)]
    order = np.lexsort((np.arange(len(lines)), line_hash, line_doc))
    seen = np.zeros(len(lines), dtype=bool)
    seen[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    base["n_dup_lines"] = np.bincount(line_doc[seen], minlength=n_docs)
    in_line = sums(points & ~space, starts, ends)
    size = np.maximum(in_line, 1)
    mark = _MARK[chars]
    doubled = np.zeros(len(chars), dtype=bool)
    doubled[1:] = mark[1:] & (chars[1:] == chars[:-1])
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    by_word = np.searchsorted(lines, line_of)
    order = np.lexsort((hashes, by_word))
    fresh = np.ones(len(doc), dtype=bool)
    fresh[order[1:]] = (hashes[order][1:] != hashes[order][:-1]) | (by_word[order][1:] != by_word[order][:-1])
    # capitals beyond ASCII: the second byte of the two-byte Latin capitals
    capital = _UPPER[chars]
    capital[1:] |= (chars[:-1] == 0xC3) & (chars[1:] >= 0x80) & (chars[1:] <= 0x9E)
    last = words.ends[np.searchsorted(line_of, lines, side="right") - 1] - 1
    values = (n_in, in_line / np.maximum(n_in, 1), sums(capital, starts, ends) / size, sums(_SYMBOL[chars], starts, ends) / size, sums(_DIGIT[chars], starts, ends) / size, sums(doubled, starts, ends) / size, np.bincount(by_word[again], minlength=len(lines)) / np.maximum(n_in, 1), np.bincount(by_word[fresh], minlength=len(lines)) / np.maximum(n_in, 1), seen, _CLOSE[chars[last]] if len(lines) else seen)
    levels = np.stack([np.searchsorted(c, v, side="right") + o for c, v, o in zip(CUTS, values, OFFSETS)], axis=1) if len(lines) else np.zeros((0, len(CUTS)), dtype=np.int64)
    return base, levels, line_doc, in_line


def fit(rows: list[tuple]) -> bytes:
    """Weights of the random field from (doc_id, text, label) rows: of feature levels (content against boilerplate) and
    of neighbouring labels (2 x 2), by gradient ascent on the conditional likelihood."""
    emit, step = np.zeros(OFFSETS[-1]), np.zeros((2, 2))
    if not rows:
        return pickle.dumps((emit, step, 1.0))
    _, levels, line_doc, _ = measure([r[1] for r in rows])
    label = np.array([int(r[2] == 1) for r in rows])[line_doc]
    counts = np.bincount(label, minlength=2)
    weight = np.where(label == 1, 0.5 / max(counts[1], 1), 0.5 / max(counts[0], 1))  # both labels count alike
    first = np.concatenate([[True], line_doc[1:] != line_doc[:-1]])
    place = np.arange(len(label)) - np.maximum.accumulate(np.where(first, np.arange(len(label)), 0))
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(int(place.max(initial=-1)) + 2))
    rounds = [by_place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    grown, step_grown, bias, bias_grown = np.full_like(emit, 1e-6), np.full_like(step, 1e-6), 0.0, 1e-6
    for _ in range(STEPS):
        score = np.stack([np.zeros(len(label)), emit[levels].sum(1) + bias], axis=1)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        for k, at in enumerate(rounds):
            if k:
                ahead[at] = np.logaddexp(ahead[at - 1, :1] + score[at - 1, :1] + step[:1], ahead[at - 1, 1:] + score[at - 1, 1:] + step[1:])
        for k in range(len(rounds) - 1, 0, -1):
            at = rounds[k]
            after = back[at] + score[at]
            back[at - 1] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
        both = ahead + score + back
        p = np.exp(both - both.max(1, keepdims=True))
        p = p[:, 1] / p.sum(1)
        error = weight * (label - p)
        grad = np.bincount(levels.ravel(), weights=np.repeat(error, levels.shape[1]), minlength=len(emit)) - SHRINK * emit
        grown += grad**2
        emit += RATE * grad / np.sqrt(grown)
        bias_grown += error.sum() ** 2
        bias += RATE * error.sum() / np.sqrt(bias_grown)
        joined = np.flatnonzero(~first)
        pair = (ahead[joined - 1] + score[joined - 1])[:, :, None] + step[None] + (score[joined] + back[joined])[:, None, :]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        pair /= pair.sum((1, 2), keepdims=True)
        true = np.zeros_like(pair)
        true[np.arange(len(joined)), label[joined - 1], label[joined]] = 1
        step_grad = (weight[joined, None, None] * (true - pair)).sum(0) - SHRINK * step
        step_grown += step_grad**2
        step += RATE * step_grad / np.sqrt(step_grown)
    return pickle.dumps((emit, step, bias))


def decode(scores: list[float], step) -> list[int]:
    """The best labels of a sequence of lines (Viterbi), scores being those of content against boilerplate."""
    (s00, s01), (s10, s11) = step
    boiler, content, back = 0.0, 0.0, []
    for k, score in enumerate(scores):
        if k:
            b = 1 if content + s10 > boiler + s00 else 0
            c = 1 if content + s11 >= boiler + s01 else 0
            back.append((b, c))
            boiler, content = max(boiler + s00, content + s10), max(boiler + s01, content + s11) + score
        else:
            content = score
    label = 1 if content >= boiler else 0
    out = [label] if scores else []
    for choice in reversed(back):
        label = choice[label]
        out.append(label)
    return out[::-1]


def judge(docs: DataFrame, model: bytes, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, the base figures, base_failed, content_share and kept of each row. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(frames):
        emit, step, bias = pickle.loads(shared.value)
        step = step.tolist()
        for frame in frames:
            texts = [t or "" for t in frame["text"].where(frame["text"].notna(), "")]
            for a, b in textops.batches(texts):
                out, levels, line_doc, size = measure(texts[a:b])
                scores = emit[levels].sum(1) + bias
                bounds = np.searchsorted(line_doc, np.arange(b - a + 1))
                share = np.zeros(b - a)
                for d in range(b - a):
                    lines = slice(bounds[d], bounds[d + 1])
                    if bounds[d + 1] > bounds[d]:
                        share[d] = (np.array(decode(scores[lines].tolist(), step)) * size[lines]).sum() / size[lines].sum()
                out["content_share"] = share
                out.insert(0, "key", frame["key"].iloc[a:b].to_numpy())
                yield out[["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"]]

    read = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    kind = read.schema["key"].dataType.simpleString()
    found = read.mapInPandas(work, f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double")
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumnRenamed("key", key).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= LEAST_CONTENT))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """judge() with weights fitted on labels.quality."""
    return judge(docs, fitted(labelled_sample(docs, labels, "quality", train_docs), fit))
