import random

import public_tokenizers

from relengine.llm.tokencount import Automaton, token_counts, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(pieces, text):
    n, at, longest = 0, 0, max(map(len, pieces))
    while at < len(text):
        at += next(k for k in range(min(longest, len(text) - at), 0, -1) if text[at : at + k] in pieces)
        n += 1
    return n


def test_counts_equal_greedy_matching():
    rng = random.Random(7)
    single = {bytes([i]) for i in range(256)}
    for _ in range(200):
        pieces = single | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(12))}
        a = Automaton(pieces)
        for _ in range(20):
            text = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(30)))
            assert a.count(text) == greedy(pieces, text)


def test_real_vocabulary(spark):
    pieces = {*vocabulary(PATH)}
    texts = [None, "", " \n\t", "Hello world", "ünïcödé 한국어 🙂", "antidisestablishmentarianism " * 3, "x" * 5000, "a\x0bb\xa0c", "Hello world"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "a b", "z")], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs, PATH).collect()}
    for i, t in [*enumerate(texts), (None, "a b")]:
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(greedy(pieces, b" " + w) for w in words))
    assert token_counts(docs.limit(0), PATH).count() == 0
