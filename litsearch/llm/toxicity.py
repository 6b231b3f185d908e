"""Toxicity: a support vector machine over a gapped-subsequence string kernel, with Nyström landmarks.

Two words are as alike as they share subsequences of three letters, each counted with a weight that
falls with the length it spans; `id-i_ot` and `idxiot` stay close to `idiot`. The normalised kernel,
squared, is approximated from ``LANDMARKS`` landmark words (Nyström), in whose space a linear machine
is trained on sentences. A sentence scores as its most suspicious word; a labelled toxic document has at
least one toxic sentence, so training alternates between choosing each toxic document's most
suspicious sentences and fitting (multiple-instance learning). A document scores as its worst
sentence, which a logistic curve turns into a probability, fitted on documents that the machine has not seen.

Training reads a sample of labelled documents, ``SAMPLE`` per class at most and ``SAMPLE_CHARS``
characters, chosen by hash. Everything else covers all rows.

Defined results: null and empty texts score as a text without words. Repeated rows are scored one by
one. Rows without a label, or whose label is null, are not learned from; if a class has no rows, all
scores are 0. Equal texts have equal scores.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import crc_class, map_slices

SAMPLE = 2000
SAMPLE_CHARS = 6_000_000
#: Longer labelled texts are scored, but not learned from.
LONGEST_SAMPLED = 200_000
LANDMARKS = 128
DECAY = 0.85
SPAN = 6
#: Words longer than this are looked at in overlapping parts.
LONGEST = 24
THRESHOLD = 0.3
#: Words that a worker remembers.
REMEMBERED = 400_000
#: Words that go through the kernel at a time; a multiple of 64.
BLOCK = 128
#: Characters of texts whose words are looked at together; a longer text is looked at by itself.
TOGETHER = 1_000_000

SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
NOT_LETTER = re.compile(r"[\W\d_]+")
SPELLED = re.compile(r"(?<!\S)\w(?:[\s.\-_*]+\w(?!\w)){2,}(?!\S)")
#: Offsets of the second and third letter.
GAPS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
GAP_WEIGHTS = np.array([DECAY ** (j + 1) for _, j in GAPS])


def letters(word: str) -> str:
    return NOT_LETTER.sub("", word)


def parts(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def words_of(text: str) -> set[str]:
    """Different words of a text in lower case; letters spelled out one by one also count together."""
    text = text.lower()
    found = set(text.split())
    if any(len(w) == 1 for w in found):
        found.update(NOT_LETTER.sub("", m) for m in SPELLED.findall(text))
    return found


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple code, weight) of all words, each pair once, sorted by word and code.
    A mark before the first letter makes beginnings alike."""
    n, words = len(words), ["^" + w for w in words]
    width = LONGEST + 1 + SPAN
    grid = np.zeros((n, width), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    grid[np.arange(width) < lengths[:, None]] = (signs & 63) + 1
    keys = []
    row = np.arange(n, dtype=np.int64)[:, None] << 21
    for gap, (i, j) in enumerate(GAPS):
        a, b, c = (grid[:, s : LONGEST + 1 + s] for s in (0, i, j))
        # the gap's number goes along in the low bits, so that plain numbers are sorted
        keys.append((row | a << 14 | b << 7 | c)[c > 0] << 4 | gap)
    key = np.sort(np.concatenate(keys))
    weights = GAP_WEIGHTS[key & 15]
    key >>= 4
    first = np.empty(len(key), bool)
    first[:1], first[1:] = True, key[1:] != key[:-1]
    sums = np.bincount(np.cumsum(first) - 1, weights)
    key = key[first]
    return key >> 21, key & ((1 << 21) - 1), sums


class Kernel:
    """Squared normalised kernel of words with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        row, code, weight = triples(landmarks)
        self.codes = np.unique(code)
        self.columns = np.zeros((len(landmarks), len(self.codes) + 1), np.float32)
        norm = np.sqrt(np.bincount(row, weight**2, len(landmarks)))
        self.columns[row, np.searchsorted(self.codes, code)] = weight / np.maximum(norm[row], 1e-12)
        self.place = np.full(1 << 21, -1, np.int32)  # of every code in the table; -1: of none
        self.place[self.codes] = np.arange(len(self.codes))

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), BLOCK):
            some = words[at : at + BLOCK]
            row, code, weight = triples(some)
            norm = np.sqrt(np.bincount(row, weight**2, len(some)))
            place = self.place[code]
            hit = place >= 0
            row, place, weight = row[hit], place[hit], weight[hit].astype(np.float32)
            if len(row):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                # a landmark's hits stand side by side, so that neighbours in memory are added up
                likeness = self.columns.take(place, axis=1)
                likeness *= weight
                sums = np.add.reduceat(likeness, starts, axis=1)
                out[at + row[starts]] = sums.T / np.maximum(norm[row[starts]], 1e-12)[:, None]
        return out**2


class ToxicWords:
    """The trained model: landmarks, one weight per landmark, bias, and the logistic curve."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, middle: float):
        self.landmarks, self.weights, self.bias, self.slope, self.middle = landmarks, weights, bias, slope, middle
        self._start()

    def _start(self) -> None:
        self.kernel = Kernel(self.landmarks)
        self.raw: dict[str, float] = {}
        self.older: dict[str, float] = {}
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("landmarks", "weights", "bias", "slope", "middle")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def margins(self, words: list[str]) -> np.ndarray:
        # always the same number of rows, few enough for one thread: how a product is rounded hangs on it,
        # and a word's margin must not hang on the words that it stands with
        found = [np.zeros(0, np.float32)]
        for at in range(0, len(words), BLOCK):
            some = words[at : at + BLOCK]
            likeness = np.zeros((BLOCK, len(self.landmarks)), np.float32)
            likeness[: len(some)] = self.kernel.rows(some)
            found.append((likeness.reshape(-1, 64, len(self.landmarks)) @ self.weights).ravel()[: len(some)])
        return np.concatenate(found) + self.bias

    def learn(self, words: set[str]) -> None:
        """Make every word known. Words that are met again outlive those that are not."""
        new = words.difference(self.raw)
        if len(self.raw) + len(new) > REMEMBERED // 2:
            self.older, self.raw = self.raw, {}
            self.known.clear()
            new = words
        again = [w for w in new if w in self.older]
        for w in again:
            self.raw[w] = self.older[w]
        new = new.difference(again)
        cores = {w: letters(w) for w in new}
        fresh = sorted(set(cores.values()).difference(self.known))
        split = [(w, p) for w in fresh for p in parts(w)]
        best: dict[str, float] = {}
        for (w, _), m in zip(split, self.margins([p for _, p in split]).tolist() if split else (), strict=True):
            best[w] = max(m, best.get(w, m))
        self.known.update(best)
        for w, core in cores.items():
            self.raw[w] = self.known[core]

    def margin(self, words: set[str]) -> float:
        return max(map(self.raw.__getitem__, words), default=self.bias)

    def probabilities(self, texts: list[str | None]) -> list[float]:
        """One per text. Words of many texts are learned together: the kernel works on arrays, and few
        words of one text are new."""
        scores, found, chars = [], [], 0
        for i, text in enumerate(texts):
            found.append(words_of(text or ""))
            chars += len(text or "")
            if i + 1 == len(texts) or chars + len(texts[i + 1] or "") > TOGETHER:
                self.learn(set().union(*found))
                scores += [self.probability(self.margin(words)) for words in found]
                found, chars = [], 0
        return scores

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -50, 50))))


def _machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss over ``x[rows]`` by Newton steps; the last column of x
    is the bias."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6

    def slack_of(w: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - y * (x @ w.astype(np.float32))[rows].astype(np.float64))

    def loss(w: np.ndarray) -> float:
        return float((keep * w * w).sum() + (cost * slack_of(w) ** 2).sum())

    for _ in range(40):
        slack = slack_of(w)
        gradient, curve = keep * w, np.diag(keep)
        for at in range(0, len(rows), 20_000):
            on = at + np.flatnonzero(slack[at : at + 20_000] > 0)
            xo = x[rows[on]].astype(np.float64)
            gradient = gradient - xo.T @ (cost[on] * y[on] * slack[on])
            curve = curve + xo.T @ (xo * cost[on][:, None])
        step = np.linalg.solve(curve, gradient)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def train(docs: list[tuple[str, int]], landmarks: int = LANDMARKS) -> ToxicWords:
    """Fit on (text, label 0 or 1) pairs; every fourth document is kept for the curve."""
    number: dict[str, int] = {}  # of every part of every word
    names: dict[str, int] = {}  # of every word

    def coded(sentence: str) -> tuple[np.ndarray, np.ndarray]:
        found = {c for c in map(letters, words_of(sentence)) if c}
        return (np.array([names.setdefault(w, len(names)) for w in found], np.int32),
                np.array([number.setdefault(p, len(number)) for w in found for p in parts(w)], np.int32))

    bags = [([c for c in map(coded, SENTENCE.split(t)) if len(c[0])], y) for t, y in docs]
    fit, rest = [b for i, b in enumerate(bags) if i % 4 != 3], [b for i, b in enumerate(bags) if i % 4 == 3]
    n = [sum(y == k for _, y in fit) for k in (0, 1)]
    if not n[0] or not n[1]:
        return ToxicWords(["the"], np.zeros(1), 0.0, 0.0, 1e9)

    def holding(which: int, of: int, size: int) -> np.ndarray:
        """Documents of class ``of`` that hold each word (0) or part (1)."""
        total = np.zeros(size, np.int64)
        for bag, y in fit:
            if y == of and bag:
                total[np.unique(np.concatenate([s[which] for s in bag]))] += 1
        return total

    words = list(names)
    clean, toxic = holding(0, 0, len(words)), holding(0, 1, len(words))
    odds = np.log((toxic + 0.1) / (n[1] + 0.2)) - np.log((clean + 0.1) / (n[0] + 0.2))
    usable = [i for i, w in enumerate(words) if 3 <= len(w) <= LONGEST]
    ranked = sorted((i for i in usable if toxic[i]), key=lambda i: (-odds[i] * toxic[i] ** 0.5, words[i]))
    common = sorted((i for i in usable if clean[i]), key=lambda i: (-clean[i], words[i]))
    chosen_words = list(dict.fromkeys(ranked[: landmarks * 3 // 4] + common[: landmarks // 4]))
    marks = [words[i] for i in chosen_words] or ["the"]
    weight = np.maximum(0, odds[chosen_words]) if chosen_words else np.zeros(1)
    kernel = Kernel(marks)
    own = kernel.rows(marks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    firm = value > 1e-3 * value.max()
    half = vector[:, firm] / np.sqrt(value[firm])
    vocabulary = list(number)
    x = np.ones((len(vocabulary), half.shape[1] + 1), np.float32)
    # first guess of a word's suspicion: likeness to a landmark, by the landmark's odds
    suspicion = np.zeros(len(vocabulary))
    for at in range(0, len(vocabulary), 20_000):
        k = kernel.rows(vocabulary[at : at + 20_000])
        x[at : at + len(k), :-1] = k @ half
        suspicion[at : at + len(k)] = (k * weight).max(1)
    in_clean = holding(1, 0, len(vocabulary))
    negative = np.flatnonzero(in_clean)
    price = in_clean[negative] * (n[1] / n[0])  # as if both classes had equally many documents
    weights, bias = np.zeros(half.shape[1]), -1.0
    for _ in range(4):
        witness = []
        for bag, y in fit:
            if y and bag:
                tops = np.array([s[1][suspicion[s[1]].argmax()] for s in bag])
                worst = suspicion[tops].max()
                witness.append(tops[suspicion[tops] >= worst - 0.1 * abs(worst)])
        positive, often = np.unique(np.concatenate(witness) if witness else np.zeros(0, int), return_counts=True)
        rows = np.r_[positive, negative].astype(int)  # a word that clean documents have too stands on both sides
        weights, bias = _machine(x, rows, np.r_[np.ones(len(positive)), -np.ones(len(negative))], np.r_[often, price])
        suspicion = (x[:, :-1] @ weights + bias).astype(np.float64)
    margins = [(max((float(suspicion[s[1]].max()) for s in bag), default=bias), y) for bag, y in (rest or fit)]
    slope, middle = _curve(np.array([m for m, _ in margins]), np.array([y for _, y in margins]))
    return ToxicWords(marks, (half @ weights).astype(np.float32), bias, slope, middle)


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve with smoothed targets, so that a clean split stays a finite slope."""
    good, bad = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    center, width = float(np.mean(margin)), max(float(np.std(margin)), 1e-6)
    z = (margin - center) / width

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((np.logaddexp(0, t) - target * t).sum() + 0.005 * a * a)

    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((p - target) * z).sum() + 0.01 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        step = np.linalg.solve([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]], g)
        while loss(a - step[0], b - step[1]) > loss(a, b) and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return float(a / width), float(center - b * width / a)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE,
                    chars: int = SAMPLE_CHARS, longest: int = LONGEST_SAMPLED) -> list[tuple[str, int]]:
    """At most ``sample`` training documents of each class and ``chars`` characters, by hash of the id.

    Half of the characters are each class's own; what one class leaves goes to the other. A text above ``longest``
    characters is left out by itself, as is one that would go beyond what is left. Of the rows of one id one text counts. Ids and lengths are chosen from first, so that no
    task or driver holds more texts than are taken.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y")).where(crc_class("id", 4) != 2)
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = one if picked is None else picked.unionAll(one)
    n = F.char_length("text").cast("long")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").where(n <= longest)
    rows = texts.join(F.broadcast(picked), "id").withColumn("n", n).withColumn("hash", F.xxhash64("text"))  # at most 2 x sample ids
    places = rows.groupBy("id", "y").agg(F.min(F.struct("hash", "n")).alias("one")).select("id", "y", "one.*", F.xxhash64("id").alias("place"))
    left, chosen, others = {0: chars // 2, 1: chars - chars // 2}, [], []
    for r in sorted(places.collect(), key=lambda r: (r.place, r.id)):
        if r.n <= left[r.y]:
            left[r.y] -= r.n
            chosen.append((r.id, r.hash))
        else:
            others.append(r)
    spare = sum(left.values())
    for r in others:
        if r.n <= spare:
            spare -= r.n
            chosen.append((r.id, r.hash))
    if not chosen:
        return []
    taken = docs.sparkSession.createDataFrame(chosen, rows.select("id", "hash").schema)
    found = rows.join(F.broadcast(taken), ["id", "hash"]).groupBy("id", "y").agg(F.any_value("text").alias("text"), F.first(F.xxhash64("id")).alias("place"))
    return [(r["text"], r["y"]) for r in found.orderBy("place", "id").select("text", "y").collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``. Only the text decides a score."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample_labelled(docs, labels)))
    return score_with(docs.select("doc_id", crc_class("doc_id", 4).eqNullSafe(2).alias("held_out"), "text"), model)


def score_with(rows: DataFrame, model) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(got: dict[str, list]) -> dict[str, list]:
        scores = model.value.probabilities(got["text"])
        return {"doc_id": got["doc_id"], "held_out": got["held_out"], "score": scores,
                "predicted": [int(s >= THRESHOLD) for s in scores]}

    return map_slices(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
