"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks, trained on labelled sentences."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, by_place, lean, table

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SIGNS = re.compile(r"[\W_]+")
SPAN = 2  # units of a sentence that stand together; longer sentences fall into so many at a time
MEMO = 150_000  # words whose scores a worker keeps
CHUNK = 1 << 20  # characters of text whose words are scored together
WIDE = 1 << 13  # characters of a word that are hashed at a time


def unit(word: str) -> str:
    """The letters and digits of a word in lower case; signs at its ends and between its letters are no part of it."""
    w = word.lower()
    return w if w.isalnum() else SIGNS.sub("", w)


def units(text: str) -> list[list[str]]:
    """The units of each sentence; three or more single letters in a row are one unit, fewer are none."""
    out = []
    for sentence in SENTENCE.split(text):
        found: list[str] = []
        run: list[str] = []
        for w in map(unit, sentence.split()):
            if len(w) == 1:
                run.append(w)
            elif w:
                if len(run) > 2:
                    found.append("".join(run))
                run = []
                found.append(w)
        if len(run) > 2:
            found.append("".join(run))
        if found:
            out.append(found)
    return out


def phrases(text: str) -> list[tuple[str, ...]]:
    """A text's sentences, cut after every SPAN units."""
    return [tuple(s[i : i + SPAN]) for s in units(text) for i in range(0, len(s), SPAN)]


#: Places of the characters of a gapped subsequence after its first: of three in a span of five, of four in a span of six.
PLACES = [(a, b) for b in range(2, 5) for a in range(1, b)] + [(a, b, c) for c in range(3, 6) for b in range(2, c) for a in range(1, b)]
DECAY = 0.5
WEIGHTS = [DECAY ** (p[-1] - len(p)) for p in PLACES]
#: Odd multipliers of a feature hash; features fall into 2 ** HASH_BITS places.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
HASH_BITS = 20


def lengths(n: np.ndarray) -> np.ndarray:
    """The weights of all subsequences of words of ``n`` characters, bounds included, as one length."""
    return np.sqrt(sum(w * w * np.maximum(0, n - p[-1]) for p, w in zip(PLACES, WEIGHTS)))


def hashed(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Words of like length together: (rows, characters with bounds, for each of PLACES the hashed subsequences at each first place).

    Words of over WIDE characters come in parts, which share their row; each part has the subsequences that begin in it.
    """
    by: dict[int, list[tuple[int, str, int]]] = {}
    reach = PLACES[-1][-1]
    for i, w in enumerate(words):
        s = f"^{w}$"
        for at in range(0, max(1, len(s) - reach), WIDE):
            part = s[at : at + WIDE + reach] if at + WIDE + reach < len(s) else s[at:]
            whole = at + len(part) == len(s)
            by.setdefault(8 << max(0, (len(part) - 1).bit_length() - 3), []).append((i, part, len(part) if whole else -1))
            if whole:
                break
    for width, rows in sorted(by.items()):
        many = max(1, (1 << 17) // width)
        for at in range(0, len(rows), many):
            part = rows[at : at + many]
            text = "".join([s.ljust(width, "\0") for _, s, _ in part])
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width)
            begun: dict[tuple[int, ...], np.ndarray] = {(): c * MULTIPLIERS[0]}  # hashes of the characters so far

            def begin(p: tuple[int, ...], c: np.ndarray = c, begun: dict = begun) -> np.ndarray:
                if p not in begun:
                    h = begin(p[:-1])[:, : c.shape[1] - p[-1]]
                    begun[p] = (h ^ (h >> np.uint32(15))) + c[:, p[-1] :] * MULTIPLIERS[len(p)]
                return begun[p]

            found = []
            for p in PLACES:
                h = begin(p)
                found.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASH_BITS))
            yield np.array([i for i, _, _ in part]), np.array([n for _, _, n in part]), found


def beyond(n: np.ndarray, p: tuple[int, ...], width: int) -> np.ndarray:
    """The first places whose subsequence isn't in its row: beyond the end of a word, or of a part that has another after it."""
    last = np.where(n < 0, WIDE, n - p[-1])
    return np.arange(width)[None, :] >= last[:, None]


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words' gapped subsequences of three and four characters: (rows, hashed features, weights).

    This is the feature map of the gap-weighted subsequence kernel (Lodhi et al. 2002), with bounded spans, divided by
    :func:`lengths`; a word's bounds count as characters.  A weight of 0 marks places beyond a word's end.
    """
    size = np.maximum(lengths(np.array([len(w) + 2 for w in words])), 1e-9) if words else np.empty(0)
    for rows, n, ids in hashed(words):
        weights = [np.where(beyond(n, p, h.shape[1]), 0.0, w) for p, w, h in zip(PLACES, WEIGHTS, ids)]
        yield rows, np.concatenate(ids, axis=1), np.concatenate(weights, axis=1) / size[rows][:, None]


BIAS = -1.0  # fixed: a word like no landmark is clean


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 16.0, rounds: int = 40) -> np.ndarray:
    """Primal linear SVM with squared hinge loss and fixed bias by Newton steps, halved where one overshoots."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])

    def margins(w: np.ndarray) -> np.ndarray:
        return y * (np.concatenate([x[i : i + 2048] @ w for i in range(0, len(x), 2048)]) + BIAS)  # blocks, as memory is bounded

    def loss(w: np.ndarray) -> float:
        return float(w @ w + cost * (weight * np.maximum(0, 1 - margins(w)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        active = np.flatnonzero(margins(w) < 1)
        square, side = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(active), 2048):
            some = active[i : i + 2048]
            xa, c = x[some].astype(np.float64), cost * weight[some]
            square += (xa * c[:, None]).T @ xa
            side += (xa * c[:, None]).T @ (y[some] - BIAS)
        move = np.linalg.solve(square, side) - w
        size = 1.0
        while (new := loss(w + size * move)) > now and size > 1e-3:
            size /= 2
        if now - new < 1e-6 * now:
            break
        w, now = w + size * move, new
    return w


@dataclass
class Model:
    """Weights of hashed subsequences: landmarks and the Nyström map are folded into one sum, as the kernel has an explicit map.

    ``curve`` makes a probability of what :func:`evidence` finds in a text.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << HASH_BITS, np.float32))
    bias: float = BIAS
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, -4.0)

    def units(self, words: list[str]) -> np.ndarray:
        """What each unit adds to a phrase."""
        out = np.zeros(len(words))
        for rows, n, ids in hashed(words):
            total = np.zeros(len(rows))
            for p, w, h in zip(PLACES, WEIGHTS, ids):
                found = self.weights[h]
                found[beyond(n, p, h.shape[1])] = 0
                total += w * found.sum(axis=1, dtype=np.float64)
            np.add.at(out, rows, total)
        return out / np.maximum(lengths(np.array([len(w) + 2 for w in words])), 1e-9) if words else out

    def phrases(self, adds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of phrases of so many units each, of which ``adds`` tells one after another; over 0 is an insult."""
        if not len(sizes):
            return np.empty(0)
        return np.add.reduceat(adds, np.cumsum(sizes) - sizes) + self.bias

    def probability(self, found: np.ndarray) -> float:
        """Of a text with this :func:`evidence`."""
        return float(1 / (1 + np.exp(-np.clip(found @ np.array(self.curve), -30, 30))))


def evidence(scores: np.ndarray) -> np.ndarray:
    """The highest score, how many phrases are over the margin, how many there are; 1."""
    top = min(3.0, max(-3.0, float(scores.max()))) if len(scores) else -1.0
    return np.array([top, math.log1p(float((scores > 0).sum())), math.log1p(max(1, len(scores))), 1.0])


def disguised(word: str) -> list[str]:
    """The word with letters put in, as insults are hidden."""
    half = len(word) // 2
    return [word[:half] + word[half] * 2 + word[half + 1 :], word[:half] + "x" + word[half:], word[: half - 1] + word[half - 1] * 2 + word[half:]] if len(word) > 3 else []


def witnesses(have: np.ndarray, clean: np.ndarray, n_pos: int, n_neg: int, least: int = 3) -> np.ndarray:
    """Units that toxic texts have far oftener than others: the places where this holds.

    ``have`` and ``clean`` count the toxic and the other texts that hold each unit.  By chance, a unit that n texts hold is in k or
    more toxic ones with a binomial probability; witnesses are units so improbable that half of one is expected among all.
    """
    share = n_pos / (n_pos + n_neg)
    tried = np.flatnonzero((have >= least) & (have * n_neg > 8 * (clean + 0.5) * n_pos))

    def tail(k: int, n: int) -> float:
        return math.fsum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, min(n, k + 60) + 1))

    far = [have[w] + clean[w] > 500 or tail(int(have[w]), int(have[w] + clean[w])) * max(1, len(tried)) < 0.5 for w in tried]
    return tried[np.array(far, bool)]


class Landmarks:
    """The kernel of phrases and its Nyström map.  A phrase's feature vector is the sum of its units'."""

    def __init__(self, marks: list[tuple[str, ...]]):
        words = [w for m in marks for w in m]
        of = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
        self.used = np.unique(np.concatenate([ids[v > 0] for _, ids, v in features(words)]))
        self.column = np.full(1 << HASH_BITS, len(self.used), np.int32)
        self.column[self.used] = np.arange(len(self.used))
        self.dense = np.zeros((len(self.used) + 1, len(marks)), np.float32)
        for rows, ids, v in features(words):
            for i, r in enumerate(rows):
                some = v[i] > 0
                np.add.at(self.dense[:, of[r]], self.column[ids[i][some]], v[i][some])
        values, vectors = np.linalg.eigh(self.kernel(marks).astype(np.float64))
        keep = values > 1e-4
        self.map = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def kernel(self, some: list[tuple[str, ...]]) -> np.ndarray:
        """The kernel of phrases with the landmarks."""
        number: dict[str, int] = {}
        at = [[number.setdefault(w, len(number)) for w in p] for p in some]
        rows = np.zeros((len(number), self.dense.shape[1]), np.float32)
        for r, ids, v in features(list(number)):
            c = self.column[ids]
            for i, x in enumerate(r):
                there = (c[i] < len(self.used)) & (v[i] > 0)
                rows[x] += v[i][there].astype(np.float32) @ self.dense[c[i][there]]
        out = np.empty((len(some), rows.shape[1]), np.float32)
        for i, a in enumerate(at):
            out[i] = rows[a].sum(axis=0)
        return out


    def mapped(self, *groups: list[tuple[str, ...]]) -> np.ndarray:
        """The Nyström map of phrases of all groups, a few thousand at a time."""
        every = [p for some in groups for p in some]
        out = np.empty((len(every), self.map.shape[1]), np.float32)
        for i in range(0, len(every), 4096):
            out[i : i + 4096] = self.kernel(every[i : i + 4096]) @ self.map
        return out


def fit(bags: Iterable[list[tuple[str, ...]]], toxic: list[int], landmarks: int = 480, clean: int = 10_000, hard: int = 4000, bad: int = 2500, rounds: int = 2) -> Model:
    """Learn from phrases of labelled texts (of each text, a bag), by rounds of multiple-instance labels; the curve is left to :func:`calibrate`.

    All phrases of clean texts are clean.  Of a toxic text's phrases, those are toxic first that hold a witness, a unit that toxic texts have far
    oftener than others; in later rounds, those that the machine of the round before finds, or the highest of a text where it
    finds none, if that is as high as found ones use to be; but only if they hold a witness or a unit of several toxic texts and no clean
    one.  The others aren't learned from.  The machine learns on toxic phrases (``bad`` at
    most), also with their telling unit disguised, against themselves without it, ``clean`` phrases drawn by chance and, in each round,
    the ``hard`` ones that score highest.  Half of the ``landmarks`` are toxic phrases, half clean ones.
    """
    is_toxic = np.array(toxic, bool)
    number: dict[str, int] = {}
    flat_of, sizes_of = [], []  # of each bag: its units' numbers, and how many each phrase has
    for b in bags:
        flat_of.append(np.array([number.setdefault(w, len(number)) for p in b for w in p], np.int32))
        sizes_of.append(np.array([len(p) for p in b], np.int32))
    known = list(number)
    held = [np.unique(f) for f in flat_of]
    n_pos, n_neg = int(is_toxic.sum()), int((~is_toxic).sum())
    if not n_pos or not n_neg or not known:
        return Model()
    have, other = (np.bincount(np.concatenate([h for h, y in zip(held, is_toxic) if y == side]), minlength=len(known)) for side in (True, False))
    telling = np.zeros(len(known), bool)
    telling[witnesses(have, other, n_pos, n_neg)] = True
    bag_sizes = [len(x) for x in sizes_of]
    of, sizes, flat = np.repeat(np.arange(len(bag_sizes)), bag_sizes), np.concatenate(sizes_of), np.concatenate(flat_of)
    starts = np.cumsum(sizes) - sizes
    numbers = lambda i: flat[starts[i] : starts[i] + sizes[i]].tolist()
    del held, flat_of, sizes_of
    in_toxic = is_toxic[of]
    toxic_now = in_toxic & (np.add.reduceat(telling[flat].astype(int), starts) > 0)
    clean_at = np.flatnonzero(~in_toxic)
    may = in_toxic & (np.add.reduceat(((other == 0) & (have >= 2) | telling)[flat].astype(int), starts) > 0)
    if not toxic_now.any() or not len(clean_at):
        return Model()
    rng = np.random.default_rng(11)
    drawn = set(rng.choice(clean_at, min(clean, len(clean_at)), replace=False).tolist())
    adds, scores, model = np.where(telling, 1.0, 0.0), np.zeros(len(sizes)), Model()
    text = lambda at: [tuple(known[w] for w in numbers(i)) for i in at]
    for _ in range(rounds):
        at = np.flatnonzero(toxic_now)
        at = at if len(at) <= bad else np.sort(rng.choice(at, bad, replace=False))
        minus = sorted(drawn)
        hardest = sorted(minus, key=lambda i: (-scores[i], i))[: landmarks // 2]
        plus = text(at)
        tell = [int(np.argmax(adds[numbers(i)])) for i in at]
        variants = [(*p[:k], d, *p[k + 1 :]) for p, k in zip(plus, tell) for d in disguised(p[k])[:2]]
        step = max(1, len(plus) // (landmarks - len(hardest)) + 1)
        marks = Landmarks(list(dict.fromkeys([*plus[::step], *text(hardest)])))
        without = [q for p, k in zip(plus, tell) if (q := p[:k] + p[k + 1 :]) and not any(adds[number[u]] > 0 for u in q)]
        x = marks.mapped(plus, variants, without, text(minus))
        y = np.r_[np.ones(len(plus) + len(variants)), -np.ones(len(without) + len(minus))]
        weight = np.r_[np.ones(len(plus)), np.full(len(variants), 0.5), np.ones(len(without) + len(minus))]
        w = svm(x, y, weight)
        table = np.zeros(1 << HASH_BITS, np.float32)
        table[marks.used] = (marks.dense @ (marks.map @ w))[:-1]
        model = Model(table)
        del marks, x
        adds = np.concatenate([model.units(known[i : i + 8192]) for i in range(0, len(known), 8192)])
        scores = model.phrases(adds[flat], sizes)
        drawn |= set(clean_at[np.argsort(-scores[clean_at], kind="stable")[:hard]].tolist())
        usual = float(np.quantile(scores[toxic_now], 0.25))
        toxic_now = may & (scores > 0)
        ends = np.cumsum(bag_sizes)
        for i in np.flatnonzero(is_toxic):
            a, b = ends[i] - bag_sizes[i], ends[i]
            if b > a and not toxic_now[a:b].any() and scores[top := a + int(np.argmax(scores[a:b]))] >= min(usual, 0) and may[top]:
                toxic_now[top] = True
        if not toxic_now.any():
            break
    return model


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve (Platt 1999), with softened targets, by Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(a))
        move = np.linalg.solve(h, z.T @ (t - p) - 1e-2 * a)
        a = a + move * min(1.0, 3 / (np.abs(move).max() + 1e-12))
    return tuple(map(float, a))


def sample(docs: DataFrame, labels: DataFrame, most: int, fold: int = 1, folds: int = 3) -> DataFrame:
    """At most ``most`` toxic and twice as many other labelled texts, by a hash of doc_id, as (doc_id, toxic, text).

    Rows whose crc32 of doc_id as text is ``fold`` modulo ``folds`` are held out.  Of several labels of a doc_id the highest holds, of
    several texts the least.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit(23)), "doc_id")
    chosen = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(2 * most))
    texts = docs.select("doc_id", F.col("text").cast("string")).where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most 3 * most rows
    return texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))


def drawn_phrases(texts: DataFrame, of_toxic: int, of_clean: int, longest: int) -> list:
    """Phrases to learn from, as rows (doc_id, toxic, phrases): of each text at most so many, by a hash, of at most ``longest`` characters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for i, toxic, text in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("text")):
                found = [q for p in phrases(text.as_py()) if len(q := " ".join(p)) <= longest]
                most = of_toxic if toxic else of_clean
                if len(found) > most:
                    found = sorted(found, key=lambda q: xxh64_intdigest(q.encode("utf-8", "surrogatepass"), i & 0xFFFFFFFF))[:most]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([toxic], pa.int32()), pa.array([found], pa.list_(pa.string()))], ["doc_id", "toxic", "phrases"])

    rows = texts.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(lean(run), "doc_id long, toxic int, phrases array<string>")
    return sorted(rows.collect(), key=lambda r: r["doc_id"])


class Scores:
    """Scores of texts; what words add is remembered, and all forgotten when there are many, which changes nothing but speed."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, words: set[str]) -> None:
        """What a word's unit adds; NaN stands for a single letter, inf for signs only."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = [(w, unit(w)) for w in words - self.known.keys()]
        long = list({u for _, u in new if len(u) > 1})
        adds = dict(zip(long, self.model.units(long).tolist()))
        for w, u in new:
            self.known[w] = adds[u] if len(u) > 1 else math.nan if u else math.inf

    def evidence(self, texts: list[str]) -> Iterator[np.ndarray]:
        """:func:`evidence` of each text.  Words are looked up about CHUNK characters at a time."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (held == 0 or held < CHUNK):
                held, end = held + len(texts[end]), end + 1
            split = [[s.split() for s in SENTENCE.split(t)] for t in texts[at:end]]
            need = {w for t in split for s in t for w in s}
            self.learn(need)
            for t, sentences in zip(texts[at:end], split):
                yield evidence(self.model.phrases(*self.flat(t, sentences)))
            for w in [w for w in need if len(w) > 256]:  # few, but they may be very long
                del self.known[w]
            at = end

    def flat(self, text: str, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """What the units of a text add, and the sizes of its phrases: just those of :func:`phrases`."""
        known = self.known
        x = np.array([known[w] for s in sentences for w in s], np.float64)
        of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        some = ~np.isinf(x)
        x, of = x[some], of[some]
        letter = np.isnan(x)
        if letter.any():
            if (letter[2:] & letter[1:-1] & letter[:-2] & (of[2:] == of[:-2])).any():  # a word spelled letter by letter
                found = phrases(text)
                return self.model.units([u for p in found for u in p]), np.array([len(p) for p in found], np.int64)
            x, of = x[~letter], of[~letter]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        length = np.diff(np.r_[first, len(of)])
        place = np.arange(len(of)) - np.repeat(first, length)
        begins = np.flatnonzero(place % SPAN == 0)
        return x, np.diff(np.r_[begins, len(of)])

    def texts(self, texts: list[str | None]) -> list[float]:
        return [self.model.probability(z) for z in self.evidence([t or "" for t in texts])]

    def text(self, text: str | None) -> float:
        return self.texts([text])[0]


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, most: int = 1500, of_toxic: int = 300, of_clean: int = 200, longest: int = 128) -> Model:
    """The machine of a sample of labelled texts: ``most`` toxic and twice as many clean ones.

    Texts are cut into phrases by executors.  To the driver come at most ``of_toxic`` or ``of_clean`` phrases of a text, of at most ``longest``
    characters each, and then, for the curve, four figures of each whole text.
    """
    scratch = Scratch(spark, "toxicity")
    texts = scratch.table(sample(docs, labels, most), "sample")
    rows = drawn_phrases(texts, of_toxic, of_clean, longest)
    toxic = [r["toxic"] for r in rows]
    model = fit(([tuple(p.split(" ")) for p in rows.pop(0)["phrases"]] for _ in toxic), toxic)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for b in batches:
            z: list[list[float]] = []
            for i in range(0, b.num_rows, 256):
                z += [x.tolist() for x in scores.evidence(b.column("text").slice(i, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(z, pa.list_(pa.float64()))], ["doc_id", "toxic", "z"])

    seen = texts.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(lean(measure), "doc_id long, toxic int, z array<double>").collect()
    if {r["toxic"] for r in seen} == {0, 1} and model.weights.any():
        seen.sort(key=lambda r: r["doc_id"])
        model.curve = calibrate(np.array([r["z"] for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    shared.unpersist()
    return model


def with_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str, **kw) -> DataFrame:
    """``docs`` with a probability of toxicity of each whole text in a last column, learned from a sample of labelled rows (:func:`learn`).

    Only texts are inputs of a score.  Null and empty texts score as texts without words; without toxic or without clean labelled texts
    all scores are low; repeated rows score alike; an empty table gives no rows; further columns are kept, whatever their names.
    """
    plain, name = by_place(docs)
    own = plain.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"))
    model = spark.sparkContext.broadcast(learn(spark, own, labels, **kw))
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.value)
        for b in batches:
            found: list[float] = []
            for i in range(0, b.num_rows, 256):  # a batch may hold many bytes
                found += scores.texts(b.column(at).slice(i, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(found, pa.float64())], [f"c{i}" for i in range(at + 1)])

    schema = StructType([*plain.schema.fields, StructField(f"c{at}", DoubleType())])
    return plain.select("*", F.col(name["text"]).cast("string").alias("whole")).mapInArrow(lean(run), schema).toDF(*docs.columns, column)


THRESHOLD = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (score of THRESHOLD or more).  See :func:`with_scores`."""
    scored = with_scores(spark, docs.select("doc_id", "text"), labels, "score", **kw)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored as labels.toxic marks them."""
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
