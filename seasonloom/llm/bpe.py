"""Byte-level BPE with a tokenization automaton.

The merges of a vocabulary compile into a deterministic automaton over tokens: it begins as one state with an arc for
each byte, and each merge (a, b) -> ab, in order, is a gadget: the state that a leads to loses its arc b and all arcs of
later tokens that begin with b, and ab gets arcs wherever a has one, to a copy of the state that b leads to. What a state
allows depends only on the token that led to it, so there is one state a token; its row of the transition table holds the
intervals of tokens that it has no arc for. A word's tokens are the one path whose labels spell it, found in one pass over
its bytes; decoding emits the labels.

Null text counts as empty (no ids). Repeated rows give repeated results; only the named columns are read, so extra
columns pass by. A text of any length is encoded whole, as is a word of any length. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.llm.common import read_file, worker_cache

#: Fixed: the pattern that splits text before the merges; White_Space is spelled out, as libraries' \s differ.
WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"
PRE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Words whose tokens a worker keeps, and the longest word that it keeps.
KEPT_WORDS, KEPT_LENGTH = 250_000, 48
ROWS_OUT = 256


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in plain):
        letters[chr(256 + k)] = b
    return letters


def compiled(data: bytes) -> dict:
    """The automaton of a tokenizers JSON file (byte-level BPE) as tables: built once, on the driver, before the first text.

    Tokens stand in an order in which those that begin with a token, by their merges, follow it, latest first: whatever a
    gadget takes away from a state is one interval of places. labels: one after another, ends of each; born: whether
    merges make a token; place: by token; row, cuts: by token the sorted ends of the intervals of places that its state has
    no arc for, as one array and where each token's begin.
    """
    spec = json.loads(data)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges]
    n = 1 + max([*vocab.values(), *specials.values()])
    labels = [b""] * n
    for text, i in vocab.items():
        labels[i] = bytes(letters[c] for c in text)
    room = [1] * n  # a token and all that begin with it
    for first, _, made in reversed(merges):
        room[first] += room[made]
    born = [False] * n
    place, at, left = [0] * n, 0, room[:]
    results = {made for _, _, made in merges}
    for i in vocab.values():
        if len(labels[i]) == 1 and i not in results:
            born[i], place[i], at = True, at, at + room[i]
    cuts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for first, second, made in merges:
        spot = place[second]
        if not (born[first] and born[second]) or any(x <= spot < y for x, y in cuts[first]):
            continue  # an earlier merge keeps the two apart: this one never happens
        gone = (spot, spot + left[second])
        if not born[made]:
            cuts[made] = cuts[second][:]  # the copied state; what follows now is taken from the original alone
            place[made] = place[first] + left[first] - room[made]
            born[made] = True
        left[first] -= room[made]
        cuts[first].append(gone)
    flat: list[int] = []
    row = [0]
    for own in cuts:
        merged: list[int] = []
        for x, y in sorted(own):
            if merged and x <= merged[-1]:
                merged[-1] = max(merged[-1], y)
            else:
                merged += (x, y)
        flat += merged
        row.append(len(flat))
    for text, i in specials.items():
        labels[i] = text.encode()
    # arrays and bytes, not an object for each token: the driver keeps them, and they are sent to every worker
    ends = array("i", accumulate(map(len, labels)))
    return {"labels": b"".join(labels), "ends": ends, "born": bytes(born), "specials": specials, "place": array("i", place), "row": array("i", row), "cuts": array("i", flat)}


class MergeAutomaton:
    """The automaton that compiled() has built, made ready to run."""

    def __init__(self, tables: dict):
        text, ends = tables["labels"], tables["ends"]
        self.labels = [text[a:b] for a, b in zip([0, *ends], ends)]
        self.specials, self.place = tables["specials"], tables["place"]
        self.ids = {self.labels[i]: i for i, made in enumerate(tables["born"]) if made}
        row, cuts = tables["row"], tables["cuts"]
        self.cuts = [cuts[a:b] for a, b in zip(row, row[1:])]  # by state: the state of a token is what may follow it
        self.trie: dict = {}
        for label, i in self.ids.items():
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[-1] = i
        self.marks = {c: self.ids[c.encode()] for c in ".,;:!?" if c.encode() in self.ids}
        self.kept: dict[str, tuple[int, ...]] = {}  # what follows a blank
        self.words: dict[str, tuple[int, ...]] = {}
        import regex

        self.split = regex.compile(PRE_SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for another: its place isn't in a cut."""
        return not bisect_right(self.cuts[state], self.place[token]) & 1

    def path(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-split word: the one path of the automaton that spells it.

        Every prefix has one path too, so the places of the word are passed once, in order: each holds the last token of
        its prefix's path, whose state has an arc for the tokens that lead on. Nothing is tried again.
        """
        whole = self.ids.get(word)
        if whole is not None:
            return (whole,)
        n, place, cuts = len(word), self.place, self.cuts
        last = [-1] * (n + 1)
        for at in range(n):
            node, row = self.trie, cuts[last[at]] if at else ()
            for end in range(at, n):
                node = node.get(word[end])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[end + 1] < 0 and not bisect_right(row, place[token]) & 1:
                    last[end + 1] = token
        out = []
        while n:
            out.append(last[n])
            n -= len(self.labels[last[n]])
        return tuple(reversed(out))

    def keep(self, kept: dict, word: str, ids: tuple) -> tuple:
        """Remembers a word's ids, within bounds."""
        if len(word) <= KEPT_LENGTH:
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            kept[word] = ids
        return ids

    def pieces(self, text: str) -> tuple[int, ...]:
        """The ids of a short text, by the pre-split pattern."""
        return tuple(i for word in self.split(text) for i in self.path(word.encode()))

    def plain(self, text: str, out: list[int]) -> None:
        """Appends the ids of a text without special tokens.

        A blank between two characters that are no white space always begins a pre-split word, so such texts are cut
        there, without the pattern; what stands between two blanks is looked up as a whole.
        """
        head, *rest = text.split(" ")
        kept, begun = self.kept, len(out)
        if head == head.strip() and (head or not rest):
            out += self.pieces(head)
            for piece in rest:
                ids = kept.get(piece)
                if ids is None:
                    if not piece or piece[0].isspace() or piece[-1].isspace():
                        break
                    stem, mark = piece[:-1], self.marks.get(piece[-1])
                    if piece.isalpha():
                        ids = self.keep(kept, piece, self.path((" " + piece).encode()))
                    elif mark is not None and stem.isalpha():
                        ids = kept.get(stem)
                        ids = (*(self.keep(kept, stem, self.path((" " + stem).encode())) if ids is None else ids), mark)
                    else:
                        ids = self.keep(kept, piece, self.pieces(" " + piece))
                out += ids
            else:
                return
        del out[begun:]
        for word in self.split(text):
            ids = self.words.get(word)
            out += self.keep(self.words, word, self.path(word.encode())) if ids is None else ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; strings of special tokens in it are these tokens."""
        out: list[int] = []
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                self.plain(text[at : m.start()], out)
                out.append(self.specials[m[0]])
                at = m.end()
        self.plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        """The labels of the ids; bytes that are no UTF-8 become replacement characters."""
        labels = self.labels
        return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


#: What compiled() has made of the vocabulary files of this process.
COMPILED: dict[str, dict] = {}


def tables_of(path: str) -> dict:
    """The compiled tables of a vocabulary file."""
    key = os.fspath(path)
    if key not in COMPILED:
        COMPILED[key] = compiled(read_file(path))
    return COMPILED[key]


def automaton(tables) -> MergeAutomaton:
    """The automaton of broadcast tables, made ready once in a worker."""
    cache, key = worker_cache("bpe"), (tables.value["row"][-1], hash(tables.value["place"].tobytes()))
    if key not in cache:
        cache[key] = MergeAutomaton(tables.value)
    return cache[key]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """id_col, ids array<int>, decoded string: each whole text encoded, and (decode, else null) its ids decoded again. One scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tables_of(vocab_path))  # of one vocabulary file, some MB at any size of the data

    def work(batches):
        import numpy as np
        import pyarrow as pa

        bpe = automaton(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                found = [bpe.encode(t) if t else [] for t in part.column(1).to_pylist()]
                ends = np.zeros(len(found) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = np.concatenate([np.array(x, dtype=np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bpe.decode(x) if decode else None for x in found], pa.string())], ["key", "ids", "decoded"])

    read = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    schema = f"key {read.schema['key'].dataType.simpleString()}, ids array<int>, decoded string"
    return read.mapInArrow(work, schema).withColumnRenamed("key", id_col)


def decode_ids(df: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the decoded text of an array of ids; null ids decode to null."""
    shared = df.sparkSession.sparkContext.broadcast(tables_of(vocab_path))

    @F.pandas_udf("string")
    def decoded(ids):
        bpe = automaton(shared)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return df.withColumn(out_col, decoded(F.col(ids_col)))
