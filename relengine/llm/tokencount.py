"""Token counts by a linear longest-match automaton over a vocabulary of pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MEMO = 200_000  # words whose counts a worker keeps


class Automaton:
    """Trie of the vocabulary's byte strings with failure links, after LinMaxMatch (Song et al. 2021).

    ``pops[v]`` is the number of pieces that a greedy longest match has given by the time the node v fails, ``fail[v]`` the
    node that stands for the bytes then left over.  Every single byte is a piece, so a match never gets stuck.  Counting
    reads each byte once; pieces themselves are never built.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole, order = [False], []
        for piece in {*pieces, *(bytes([i]) for i in range(256))} - {b""}:
            v = 0
            for c in piece:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                v = self.next[v][c]
            whole[v] = True
        self.fail, self.pops = [0] * len(whole), [0] * len(whole)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:  # by depth: a link leads to a node of less depth, whose own link is known
            order = []
            for up, c, v in level:
                if whole[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    z, n = self.fail[up], self.pops[up]
                    while c not in self.next[z]:  # the root has every byte
                        n, z = n + self.pops[z], self.fail[z]
                    self.fail[v], self.pops[v] = self.next[z][c], n
                order += [(v, d, w) for d, w in self.next[v].items()]
            level = order

    def count(self, text: bytes) -> int:
        """Pieces of the greedy longest-match segmentation of ``text``."""
        nxt, fail, pops, v, n = self.next, self.fail, self.pops, 0, 0
        for c in text:
            while (w := nxt[v].get(c)) is None:
                n += pops[v]
                v = fail[v]
            v = w
        while v:
            n += pops[v]
            v = fail[v]
        return n


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(x.split()[0]) for x in f if x.strip()]


class Counts(dict):
    """Tokens of a word, remembered; forgets all when full, which changes nothing but speed."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.automaton.count(b" " + word)
        if len(word) <= 256:
            self[word] = n
        return n


_loaded: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Words and tokens of each text: (doc_id, n_words, n_tokens).

    A word is a run of anything but ASCII white space; with a space before it, it falls into pieces of the vocabulary by greedy
    longest match, so pieces that begin with a space begin words and the others continue them.  One scan, no shuffle; a worker
    builds the automaton once from the file, which must be at that path on every executor.

    Null, empty and blank texts have 0 words and 0 tokens; repeated rows count each; an empty table gives no rows; further columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _loaded:
            _loaded[vocabulary_path] = Automaton(vocabulary(vocabulary_path))
        counts = Counts(_loaded[vocabulary_path])
        for b in batches:
            words, tokens = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for i, t in enumerate(b.column("text")):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                words[i], tokens[i] = len(w), sum(map(counts.__getitem__, w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match tokens of all documents."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
