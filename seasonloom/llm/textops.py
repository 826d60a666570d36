"""Vectorised words, hashes and n-grams of batches of whole texts (numpy), for the Arrow functions of the operators."""

from __future__ import annotations

import numpy as np

#: Characters of text that are hashed at once; a longer text makes a batch of its own.
BATCH_CHARS = 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    #: STEP's inverse modulo 2^64.
    BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: each input bit changes about half of the output's."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: White space of the contracts, as a table over bytes; and A-Z in lower case.
BYTE_SPACE = np.zeros(256, dtype=bool)
BYTE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_LOWER = np.arange(256, dtype=np.uint8)
BYTE_LOWER[65:91] += 32


def batches(texts: list, most: int = BATCH_CHARS):
    """Slices (start, end) of texts with about most characters each."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The runs of a batch's characters where mask holds. chars: integer codes; begins: each text's first place; the
    texts are separated by places outside the mask. starts, ends, doc: by run."""

    def __init__(self, chars: np.ndarray, mask: np.ndarray, begins: np.ndarray):
        edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
        self.chars, self.starts, self.ends = chars, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(begins, self.starts, side="right") - 1
        self.n_docs = len(begins)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each run's characters: a polynomial over mixed codes, by prefix sums, then mixed."""
        codes = mixed(self.chars.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        grown = codes * powers(STEP, len(codes))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(grown, out=sums[1:])
        back = powers(BACK, len(codes) + 1)
        return mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def per_doc(self) -> np.ndarray:
        """Runs of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)


def byte_words(texts: list[str], lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts, over UTF-8 bytes; with lower, A-Z count as a-z."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    chars = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    if lower:
        chars = BYTE_LOWER[chars]
    return Words(chars, ~BYTE_SPACE[chars], np.cumsum(sizes) - sizes)


def shingles(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of all windows of width words that lie within one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = powers(np.uint64(0xA0761D6478BD642F), width + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total += words[j : j + n] * mult[j + 1]
    inside = doc[:n] == doc[width - 1 :]
    return mixed(total[inside]), doc[:n][inside]


_TABLES: dict = {}


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it's a letter, and its lower case where that is one character."""
    if not _TABLES:
        every = np.arange(0x110000, dtype=np.uint32)
        every[0xD800:0xE000] = 0
        as_text = every.view("U1")
        lower = np.char.lower(as_text)
        single = np.char.str_len(lower) == 1
        _TABLES["letter"] = np.char.isalpha(as_text)
        _TABLES["lower"] = np.where(single, lower.astype("U1").view(np.uint32), every)
    return _TABLES["letter"], _TABLES["lower"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each followed by a newline, and where each text begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return chars, np.cumsum(sizes) - sizes


def ngrams(chars: np.ndarray, space: np.ndarray, least: int, most: int):
    """For each n from least to most: n, places and hashes of the n-grams that lie in one word with its two edges.

    An edge counts as a character (all edges alike); n is 3 or more, or 1 and 2 within the word without edges.
    """
    codes = mixed(np.where(space, np.uint32(32), chars).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    spaces = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum(space, out=spaces[1:])
    grown = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, most + 1):
        if len(chars) < n:
            return
        grown = grown[: len(chars) - n + 1] * STEP + codes[n - 1 :]
        if n < least:
            continue
        m = len(chars) - n + 1
        clear = spaces[n - 1 : n - 1 + m] == spaces[1 : 1 + m] if n > 2 else spaces[n : n + m] == spaces[:m]
        places = np.flatnonzero(clear)
        yield n, places, mixed(grown[places] + np.uint64(n))
