import math
import os
import random

import numpy as np
import pytest

from relengine.llm import toxicity as module
from relengine.llm.toxicity import HASH_BITS, SPAN, Model, Scores, calibrate, features, fit, phrases, svm, toxicity, units

DATA = "/root/testdata/sf0.1"


def slow_kernel(s, t, decay=0.5):
    """The gap-weighted kernel from its definition, over subsequences of three and four characters with spans of five and six."""
    from itertools import combinations

    def occurrences(w):
        w = f"^{w}$"
        return [("".join(w[i] for i in at), decay ** (at[-1] - at[0] + 1 - n)) for n, span in ((3, 5), (4, 6)) for at in combinations(range(len(w)), n) if at[-1] - at[0] < span]

    x, y = occurrences(s), occurrences(t)
    return sum(u * v for a, u in x for b, v in y if a == b) / math.sqrt(sum(u * u for _, u in x) * sum(v * v for _, v in y))


def test_features_are_the_kernels_map():
    words = ["idiot", "idxiot", "a", "abcabc", "cabcab", "réeux", "réeuxpa", "a" * 30]
    maps = {}
    for rows, ids, v in features(words):
        for i, r in enumerate(rows):
            maps[r] = np.zeros(1 << 20)
            np.add.at(maps[r], ids[i], v[i])
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(maps[i] @ maps[j] - slow_kernel(s, t)) < 1e-6


def test_words_of_any_length_are_looked_at_whole(monkeypatch):
    rng = np.random.default_rng(4)
    model = Model(rng.normal(size=1 << HASH_BITS).astype(np.float32))
    words = ["a" * n + "bcd" * n for n in (1, 2, 5, 16, 17, 40, 61, 300)] + ["x"]
    whole = model.units(words)
    for wide in (7, 16, 64):
        monkeypatch.setattr(module, "WIDE", wide)
        assert np.allclose(model.units(words), whole)


def test_units():
    assert units("You I.D.I.O.T, i d i o t ok a b!!\nx . y z") == [["you", "idiot", "idiot", "ok"]]  # the dot ends a sentence, so that two letters remain
    assert units("c l o w n. ok id*iot##") == [["clown"], ["ok", "idiot"]]
    assert units("") == [] and units(" ... ### a b ") == []
    assert phrases("a1 b1 c1 d1 e1. f1 g1") == [("a1", "b1"), ("c1", "d1"), ("e1",), ("f1", "g1")] and SPAN == 2


def test_scores_equal_the_plain_way():
    """Words remembered, looked up in batches and put together again, against one text at a time by its phrases."""
    rng = random.Random(8)
    model = Model(np.random.default_rng(5).normal(size=1 << HASH_BITS).astype(np.float32), curve=(1.0, 0.5, -0.3, 0.1))
    words = ["ab", "Cde!", "x", "y", "Z.", "###", "don't", "(((((((((((((a", "((((((((((((b", "((((((((((((c", "é", "w" * 90, "end.", "why?"]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(150)]
    got = Scores(model).texts(texts)
    for t, score in zip(texts, got):
        found = phrases(t)
        flat = model.units([u for p in found for u in p])
        want = model.probability(module.evidence(model.phrases(flat, np.array([len(p) for p in found]))))
        assert abs(score - want) < 1e-9


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.1 * x[:, 1] > 1, 1.0, -1.0)
    w = svm(x, y, np.ones(200), cost=100.0)
    assert ((x @ w - 1 > 0) == (y > 0)).mean() > 0.97


def made(seed, n):
    rng = random.Random(seed)
    syllables = "ba ke li mo nu sa te ri vo du pe ga".split()
    words = lambda k: ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(k)]
    texts, toxic = [], []
    for _ in range(n):
        w, bad = words(rng.randrange(20, 80)), rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zwyrfel", "grumpfox", "quaxling"]))
        texts.append(" ".join(w) + ".")
        toxic.append(int(bad))
    return texts, toxic


def fitted(texts, toxic):
    model = fit([phrases(t) for t in texts], toxic)
    model.curve = calibrate(np.array(list(Scores(model).evidence(texts))), np.array(toxic, float))
    return model


def test_disguised_words_are_found():
    texts, toxic = made(1, 500)
    scores = Scores(fitted(texts, toxic))
    clean = made(2, 60)
    assert all((scores.text(t) >= 0.7) == bool(y) for t, y in zip(*clean))
    plain = "bake limo nusa teri vodu pega bake. "
    for hidden in ("zwyrfel grumpfox", "z-w-y-r-f-e-l g.r.u.m.p.f.o.x", "z w y r f e l and g r u m p f o x", "zwyrrfel quax*ling", "ZWYRFEL!! QUAXLING###", "zwyxrfel grumppfox"):
        assert scores.text(plain + hidden) >= 0.7, hidden
    assert scores.text(plain * 3) < 0.3 and scores.text(None) == scores.text("") < 0.7


def test_nothing_to_learn_from():
    assert Scores(fit([], [])).text("any thing") < 0.7
    assert Scores(fit([phrases("a b cd")], [1])).text("a b cd") < 0.7 and isinstance(fit([[]], [0]), Model)
    assert isinstance(fit([[], [("ab",)]], [1, 0]), Model)


def test_odd_rows(spark):
    texts, toxic = made(3, 400)
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(900, None, None, 0), (901, "", None, 0), (None, "x", None, 0), (902, "ba " * 200_000, None, 0), (0, texts[0], 0.1, 0)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (3, None), (5, 7), (0, toxic[0]), (77777, 1)], "doc_id long, toxic int")
    rows = toxicity(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    held = {r.doc_id: r for r in rows if r.held_out}
    assert 0.2 * len(rows) < len(held) < 0.5 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    wrong = [i for i, r in held.items() if i < 400 and r.predicted != toxic[i]]
    assert len(wrong) <= 0.05 * len(held)
    assert toxicity(spark, docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_labels(spark):
    """Measured: 1,198 of 1,200 clean held-out texts left alone, 131 of 144 toxic ones found (nearly all of the rest hold no insult)."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity(spark, docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hit, missed, wrong = (sum((r.toxic, r.predicted) == k for r in rows) for k in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.97
