"""Toxicity by a subsequence-kernel support vector machine with Nystrom landmarks.

Units are words reduced to their letters (case, accents, common digit and
sign substitutions undone, punctuation inside dropped), runs of single
letters joined ("i d i o t"), and windows of two or three words. Letters other than
a-z are hashed into codes of their own, so every script is compared. Two units are
compared by the gapped subsequence kernel of order 3: every three letters in order
count, decayed by the length they span, so that inserted, split or doubled letters
lower the similarity only a little.

Landmarks come from all units of all labelled texts. A unit's support in a class is the
number of texts that hold it, at most the number of distinct neighbourhoods (word before, word
after) it stands in, so that copies of one passage count once. A unit
becomes a landmark if its support in toxic texts is beyond chance for the number
of units looked at (a Chernoff bound; less than one unit is expected by chance) and ``PURITY`` times
that in clean ones; words count together with the words much like them. No share of the texts is
asked for. Clean units close to a landmark are landmarks too. A unit's vector holds its similarity to
each landmark of as many words (values under ``NEAR`` count as 0). The
Nystrom map makes the kernel linear, and a squared-hinge support vector machine is trained on the
units of labelled sentences: of a toxic document the units near a toxic
landmark are examples, of a clean one all are. A text's margin is the
weighted sum of the best margins of its distinct units; a logistic fit on the
labelled documents turns it into a score. A window is compared if each of its words
is like some word of a landmark of several words.

Training collects a bounded sample: at most ``PER_CLASS`` labelled documents
of each class, of at most ``MAX_TRAIN_CHARS`` characters, and keeps at most ``LANDMARKS`` landmarks of one
word and as many of several. Scoring is a per-row
function inside ``mapInArrow`` over every whole text, with the margins of
distinct units kept in a bounded cache.

Defined results: null and empty texts get the score of a text without any
unit; repeated labels count once, contradicting labels of one id not at all;
without labels of both classes every score is 0; an empty table gives no
rows; equal evidence ranks by the unit's letters; only doc_id, text and toxic are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from heapq import nlargest
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_checked, packed, stored, unpacked

PER_CLASS = 1_200
MAX_TRAIN_CHARS = 50_000
LANDMARKS, NEIGHBOURS = 64, 8
ORDER, SPAN, DECAY = 3, 6, 0.7
NEAR = 0.4                   # less similar units count as unlike
CLOSE = 0.55                 # clean units from here on become landmarks
ALIKE = 0.7                  # neighbourhood in which texts are counted
LONGEST = 24                 # letters of a unit compared at once; longer ones by windows
OTHER = 17                   # codes that letters outside a-z share
LETTERS = 26 + OTHER + 1     # a-z, the others, and the start of a unit
START = bytes([LETTERS - 1])
TOP_WEIGHTS = np.array([1.0, 0.1, 0.05])   # of a text's best margins
TOP = len(TOP_WEIGHTS)
PURITY = 6                   # times the clean texts' share that the toxic ones' must be
WINDOWS = (3, 2)             # words of a unit of several words; of longer ones first
BATCH = 4_000                # units compared at once (bounds the memory)
CANDIDATES = 300             # words whose neighbourhoods are counted, those of most evidence
CACHE = 500_000
MAX_BROADCAST_REJECTED = 1_000_000   # ids and hashes of rejected rows: 16 MB
SINGLES = re.compile(r"(?<!\S)(?:[^\W\d_]\W* +){2,}[^\W\d_](?=\W*(?:\s|$))")
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})


def letters(word: str) -> bytes:
    """The word as letter codes after ``START``, without anything that is not a letter."""
    word = word.lower().translate(SUBSTITUTES)
    if word.isascii():
        return START + bytes(c - 97 for c in word.encode() if 97 <= c <= 122)
    out = bytearray(START)
    for c in unicodedata.normalize("NFKD", word):
        if "a" <= c <= "z":
            out.append(ord(c) - 97)
        elif c.isalpha():
            out.append(26 + (ord(c) * 2654435761 >> 8) % OTHER)
    return bytes(out)


def joined(words: list[bytes]) -> bytes:
    """The unit of several words; each keeps its start."""
    return b"".join(words)


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a unit of n letters within the span, and their decay."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32) if len(at) else np.empty(0, np.float32)


TRIPLES = {n: _triples(n) for n in range(ORDER, LONGEST + 1)}


def _codes(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (units[:, at[:, 0]] * LETTERS + units[:, at[:, 1]]) * LETTERS + units[:, at[:, 2]]


def features(unit: bytes) -> dict[int, float]:
    """Explicit features of a unit in the kernel's space, of length 1."""
    best: dict[int, float] = {}
    for part in _parts(unit):
        at, decay = TRIPLES[len(part)]
        for code, w in zip(_codes(np.frombuffer(part, np.uint8).astype(np.int64)[None], at)[0].tolist(), decay.tolist()):
            best[code] = best.get(code, 0.0) + w
    norm = sum(v * v for v in best.values()) ** 0.5
    return {c: v / norm for c, v in best.items()} if norm else {}


def _parts(unit: bytes) -> list[bytes]:
    if len(unit) <= LONGEST:
        return [unit] if len(unit) > ORDER else []
    half = LONGEST // 2
    cuts = [unit[i:i + LONGEST] for i in range(0, len(unit) - LONGEST, half)]
    return cuts + [unit[-LONGEST:]]


class Similarities:
    """Kernel of units with fixed landmarks of as many words, by table look-up."""

    def __init__(self, landmarks: list[bytes]):
        self.m = len(landmarks)
        self.words = np.array([z.count(START) for z in landmarks], int)
        own = [features(z) for z in landmarks]
        codes = sorted({c for f in own for c in f})
        self.row = np.zeros(LETTERS ** 3, np.int32)       # row of a code in the table; 0: in no landmark
        self.row[codes] = np.arange(1, len(codes) + 1)
        self.table = np.zeros((len(codes) + 1, self.m), np.float32)
        for j, f in enumerate(own):
            for code, w in f.items():
                self.table[self.row[code], j] = w
        self.any = self.table.max(1) if self.m else np.zeros(1, np.float32)

    def __call__(self, units: list[bytes]) -> np.ndarray:
        """(units, landmarks), values under ``NEAR`` set to 0."""
        parts = [self._some(units[i:i + BATCH]) for i in range(0, len(units), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, self.m), np.float32)

    def _some(self, units: list[bytes]) -> np.ndarray:
        out = np.zeros((len(units), self.m), np.float32)
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i, u in enumerate(units):
            for p in _parts(u):
                by_length.setdefault(len(p), []).append((i, p))
        for n, rows in by_length.items():
            at, decay = TRIPLES[n]
            where = np.array([r[0] for r in rows])
            codes = _codes(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).astype(np.int64).reshape(-1, n), at)
            # the norm is least where no three letters repeat: an upper bound of all similarities
            likely = np.flatnonzero(self.any[self.row[codes]] @ decay >= NEAR * np.sqrt((decay * decay).sum()))
            if not len(likely):
                continue
            codes, where = codes[likely], where[likely]
            raw = np.zeros((len(codes), self.m), np.float32)
            for t in range(codes.shape[1]):
                raw += self.table[self.row[codes[:, t]]] * decay[t]
            order = np.argsort(codes, axis=1, kind="stable")
            ordered, weight = np.take_along_axis(codes, order, 1), decay[order]
            first = np.ones(ordered.shape, bool)       # of equal letters within a unit
            first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
            sums = np.add.reduceat(weight.reshape(-1), np.flatnonzero(first))
            norm = np.sqrt(np.add.reduceat(sums * sums, np.append(0, np.cumsum(first.sum(1))[:-1])))
            values = raw / norm[:, None]
            values[values < NEAR] = 0
            np.maximum.at(out, where, values)
        out[np.array([u.count(START) for u in units])[:, None] != self.words] = 0
        return out


def spelled(text: str) -> list[str]:
    """Runs of single letters, joined."""
    return ["".join(m.group(0).split()) for m in SINGLES.finditer(text)]


def sentences(text: str) -> list[list[str]]:
    """Words by sentence (ended by . ! ? ; or a line break); runs of single
    letters, joined, form sentences of their own."""
    out = []
    for line in text.split("\n"):
        now: list[str] = []
        for w in line.split():
            now.append(w)
            if w[-1] in ".!?;":
                out.append(now)
                now = []
        if now:
            out.append(now)
    out += [[w] for w in spelled(text)]
    return out


class Model:
    """Landmark units, the linear function of their similarities, the
    logistic function of a text's best margins, and the words of landmarks of several words."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, slope: float, offset: float,
                 parts: list[bytes] = ()):
        self.landmarks, self.weights, self.bias, self.slope, self.offset = landmarks, weights, bias, slope, offset
        self.parts = list(parts)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        """Scores of rows of ``TOP`` margins."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (margins @ TOP_WEIGHTS) + self.offset, -40, 40)))


def no_model() -> Model:
    return Model([], np.zeros(0, np.float32), 0.0, 0.0, -40.0)


class Parts:
    """Which words are like a word of some landmark of several words."""

    def __init__(self, parts: list[bytes]):
        self.short = {p for p in parts if len(p) <= ORDER}
        self.similar = Similarities([p for p in parts if len(p) > ORDER])
        self.known: dict[str, bool] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {}
        new = list(words - self.known.keys())
        for i in range(0, len(new), 20_000):
            codes = [letters(w) for w in new[i:i + 20_000]]
            near = self.similar(codes)
            near = (near >= CLOSE).any(1) if self.similar.m else np.zeros(len(codes), bool)
            self.known.update(zip(new[i:i + 20_000], [bool(x) or c in self.short for x, c in zip(near, codes)]))

    def windows(self, words: list[str]) -> set[str]:
        """Windows of words that are all like such words, joined by blanks."""
        self.learn(set(words))
        like = [self.known[w] for w in words]
        return {" ".join(words[i:i + n]) for i, x in enumerate(like) if x for n in WINDOWS if all(like[i:i + n])} if True in like else set()


def unit(text: str) -> bytes:
    """The unit of a word or of words with blanks between."""
    return joined([letters(w) for w in text.split(" ")])


class Scorer:
    """Scores texts with a model; keeps the margins of units."""

    def __init__(self, model: Model):
        self.model = model
        self.similar = Similarities(model.landmarks)
        self.parts = Parts(model.parts)
        self.margin_of: dict[str, float] = {}

    def learn(self, units: set[str]) -> None:
        units, bias = list(units), self.model.bias
        for i in range(0, len(units), 20_000):
            part = units[i:i + 20_000]
            margins = self.similar([unit(w) for w in part]) @ self.model.weights + bias
            self.margin_of.update(zip(part, np.maximum(margins, bias).tolist()))

    def units(self, text: str) -> set[str]:
        words = text.split()
        found = {*words, *spelled(text)}
        return found | self.parts.windows(words) if self.model.parts else found

    def margins(self, texts: list[str]) -> np.ndarray:
        """The ``TOP`` best margins of each text's distinct units, the bias in
        place of missing ones."""
        if len(self.margin_of) > CACHE:
            self.margin_of = {}
        cut = [self.units(t) for t in texts]
        new = {w for words in cut for w in words} - self.margin_of.keys()
        if new:
            self.learn(new)
        at, pad = self.margin_of.__getitem__, [self.model.bias] * TOP
        return np.array([nlargest(TOP, chain(map(at, words), pad)) for words in cut])

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.model.probability(self.margins(texts))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS):
    """(text, toxic) of at most ``per_class`` labelled documents of each class, chosen by a hash of the id."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("_hi")).filter("toxic = _hi")
    order = [F.xxhash64(F.lit(3), F.col("doc_id")), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(per_class)).select(F.col("doc_id").alias("_id"), "toxic")
    found = docs.filter(F.length("text") <= max_chars).select("doc_id", "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most 2 * per_class rows
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, neighbours: int = NEIGHBOURS) -> Model:
    """Fit landmarks, support vector machine and scores on labelled texts."""
    if len({y for _, y in rows}) < 2:
        return no_model()
    toxic = np.array([y == 1 for _, y in rows])
    number: dict[bytes, int] = {b"": 0}
    code: dict[str, int] = {}

    def numbered(words: list[str]) -> np.ndarray:
        for w in words:
            if w not in code:
                code[w] = number.setdefault(letters(w), len(number))
        ids = np.array([code[w] for w in words], np.int64)
        return ids[ids != number.get(START, -1)]          # words without a letter are no units

    texts = [numbered(t.split()) for t, _ in rows]
    alone = [numbered(spelled(t)) for t, _ in rows]
    names = list(number)
    single = _landmarks(texts, alone, toxic, names, landmarks)
    several = _phrases(texts, toxic, names, single, landmarks)
    chosen = single + [joined(p) for p in several]
    if not chosen:
        return no_model()
    long = np.array([len(u) > ORDER for u in names])
    owned = [np.unique(np.concatenate(x)) for x in zip(texts, alone)]
    owned = [o[long[o]] for o in owned]
    # clean units nearest to the landmarks: the machine learns to discount them
    bad, good = (np.bincount(np.concatenate([o for o, y in zip(owned, toxic) if y == c] or [np.zeros(0, np.int64)]), minlength=len(names))
                 for c in (True, False))
    ids = np.flatnonzero(bad + good)
    near = Similarities(chosen)([names[i] for i in ids])
    marks = list(chosen)
    for j in range(len(chosen)):
        order = [i for i in np.argsort(-near[:, j], kind="stable")[:200] if near[i, j] >= CLOSE]
        clean = [names[ids[i]] for i in order if good[ids[i]] > bad[ids[i]] and names[ids[i]] not in marks]
        marks += clean[:max(1, neighbours // 4)]
    similar = Similarities(marks)
    vector = {}
    for i in range(0, len(ids), BATCH):
        part = ids[i:i + BATCH]
        vector.update((u, v.copy()) for u, v in zip(part.tolist(), similar([names[u] for u in part])) if v.any())
    own = [[vector[u] for u in o.tolist() if u in vector] for o in owned]
    if several:
        parts = Parts(sorted({w for p in several for w in p}))
        for (text, _), vectors in zip(rows, own):
            found = similar([unit(w) for w in sorted(parts.windows(text.split()))])
            vectors += list(found[found.any(1)])
    own = [np.array(v, float).reshape(-1, len(marks)) for v in own]
    gram = similar(marks).astype(float)
    gram = np.maximum(gram, gram.T)
    value, basis = np.linalg.eigh(gram)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(value, 0.1))) @ basis.T
    least = np.array([CLOSE] * len(single) + [ALIKE] * len(several))
    x, y = [np.zeros(len(marks))], [-1.0]
    for v, label in zip(own, toxic):
        if label and len(v):
            v = v[(v[:, :len(chosen)] >= least).any(1)]
        x += list(v)
        y += [1.0 if label else -1.0] * len(v)
    w = _svm(np.array(x) @ root, np.array(y))
    weights, bias = root @ w[:-1], float(w[-1])
    best = np.array([nlargest(TOP, chain(np.maximum(v @ weights + bias, bias).tolist(), [bias] * TOP)) for v in own])
    slope, offset = _logistic(best @ TOP_WEIGHTS, toxic.astype(float))
    return Model(marks, weights.astype(np.float32), bias, slope, offset, sorted({w for p in several for w in p}))


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each ``n`` numbers in a row, 0 or more after the last."""
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ x[k:len(x) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _support(texts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, support, words) of the runs of ``n`` words: the number of texts that hold
    a run, at most the number of distinct (word before, word after) it has."""
    runs, around, seen, words = [], [], [], []
    for t in texts:
        h = _mixed(t, n)
        edge = np.concatenate([[0], t, [0]])
        runs.append(h)
        around.append(_mixed(np.stack([h.astype(np.int64), edge[:len(h)], edge[n + 1:]], 1).reshape(-1), 3)[::3])
        seen.append(np.unique(h))
        words.append(np.lib.stride_tricks.sliding_window_view(t, n) if len(t) >= n else np.zeros((0, n), np.int64))
    if not runs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, n), np.int64)
    runs, words = np.concatenate(runs), np.concatenate(words)
    distinct, first = np.unique(runs, return_index=True)
    ways = np.unique(runs[np.unique(np.concatenate(around), return_index=True)[1]], return_counts=True)[1]
    held = np.unique(np.concatenate(seen), return_counts=True)[1]
    return distinct, np.minimum(ways, held), words[first]


def _evidence(bad: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Minus the logarithm of a bound of the chance that this much or more of the
    support is toxic (Chernoff); 0 for units that are not purely enough so."""
    p, n = toxic.mean(), np.maximum(bad + good, 1)
    q = bad / n
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / b), 0.0)
    pure = bad / toxic.sum() >= PURITY * good / (~toxic).sum()
    return np.where((q > p) & pure, n * (part(q, p) + part(1 - q, 1 - p)), 0.0)


def _landmarks(texts, alone, toxic, names: list[bytes], most: int) -> list[bytes]:
    """Words that speak for the toxic class together with the words much like
    them (similarity from ``ALIKE`` on); of words much alike, the best."""
    bad, good = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for count, c in ((bad, True), (good, False)):
        # a run of single letters stands for itself, whatever is around it
        for group in ([t for t, y in zip(texts, toxic) if y == c], [np.unique(a) for a, y in zip(alone, toxic) if y == c]):
            _, support, words = _support(group, 1)
            count[words[:, 0]] += support
    usable = np.array([len(u) > ORDER for u in names])
    ids = np.flatnonzero((bad + good > 0) & usable)
    if not len(ids):
        return []
    own = _evidence(bad[ids], good[ids], toxic)
    order = sorted((i for i in range(len(ids)) if own[i] > 0), key=lambda i: (-own[i], names[ids[i]]))[:CANDIDATES]
    if not order:
        return []
    similar = Similarities([names[ids[i]] for i in order])
    close = np.zeros((len(names), len(order)), bool)
    near_bad, near_good = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for i in range(0, len(ids), BATCH):
        part = ids[i:i + BATCH]
        close[part] = near = similar([names[u] for u in part]) >= ALIKE
        # summed by parts: a product with the whole of ``close`` would make it whole numbers first
        near_bad += bad[part] @ near
        near_good += good[part] @ near
    # much alike words of one text count once
    reach = np.array([close[np.concatenate(x)].any(0) for x in zip(texts, alone)])
    with_bad = np.minimum(near_bad, reach[toxic].sum(0))
    with_good = np.minimum(near_good, reach[~toxic].sum(0))
    weight = _evidence(with_bad, with_good, toxic)
    chosen: list[bytes] = []
    for j in np.argsort(-weight, kind="stable"):
        if len(chosen) == most or weight[j] <= np.log(len(ids)):
            break
        u = names[ids[order[j]]]
        if not chosen or Similarities(chosen)([u]).max() < 0.8:
            chosen.append(u)
    return chosen


def _phrases(texts, toxic, names: list[bytes], single: list[bytes], most: int) -> list[list[bytes]]:
    """Runs of two or three words that speak for the toxic class, without those
    that hold a landmark of one word or overlap a longer or better run."""
    near = np.zeros(len(names), bool)
    if single:
        similar = Similarities(single)
        for i in range(0, len(names), BATCH):
            near[i:i + BATCH] = (similar(names[i:i + BATCH]) >= CLOSE).any(1)
    chosen: list[list[bytes]] = []
    taken: set[tuple] = set()                       # pairs of words in a row of the chosen runs
    for n in WINDOWS:
        runs, bad, words = _support([t for t, y in zip(texts, toxic) if y], n)
        other, support, _ = _support([t for t, y in zip(texts, toxic) if not y], n)
        good = np.zeros(len(runs), np.int64)
        if len(other):
            at = np.minimum(np.searchsorted(other, runs), len(other) - 1)
            good = np.where(other[at] == runs, support[at], 0)
        weight = _evidence(bad, good, toxic)
        weight[near[words].any(1)] = 0
        found = np.flatnonzero(weight > np.log(len(runs) + 1))
        for i in sorted(found, key=lambda i: (-weight[i], [names[w] for w in words[i]])):
            run = tuple(words[i].tolist())
            pairs = set(zip(run, run[1:]))
            if len(chosen) < most and len(joined([names[w] for w in run])) > ORDER and not pairs <= taken:
                taken |= pairs
                chosen.append([names[w] for w in run])
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps, classes weighted alike;
    the zero vector (no near unit) is one more negative of full weight."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    c[0] = max(c[0], 0.2 * len(y))
    w = np.zeros(x1.shape[1])
    penalty = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a = x1[active] * c[active][:, None]
        new = np.linalg.solve(penalty + a.T @ x1[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of P(toxic) from the margin; the rarer
    class weighs more, by the fourth root of the ratio."""
    c = np.where(y > 0, ((1 - y).sum() / max(1, y.sum())) ** 0.25, 1.0)
    x, w = np.stack([margin, np.ones(len(y))], 1), np.zeros(2)
    ridge = np.diag([1e-1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(ridge + (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (c * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    if not np.isfinite(w).all() or w[0] <= 0:
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return train(sample(docs, labels, per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, ids may repeat) and score of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few dozen landmarks and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 512):
                out.append(scorer([t or "" for t in batch.column(2).slice(i, 512).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "text_hash", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The document rows that score below ``threshold``, all columns. Only id
    and text go through Python; rows with the same id and text score alike."""
    bad = score(docs, model).filter(F.col("score") >= threshold).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = broadcast_checked(stored(bad, "toxic-rows"), MAX_BROADCAST_REJECTED)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    return unpacked(packed(docs).join(bad, same, "left_anti"), docs)
