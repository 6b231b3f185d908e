"""Personal data: generous candidate generators, boosted trees over format and context, thresholds.

Spans that the base rules accept always stay. Beside them, generators propose overlapping spans in
looser forms (addresses with `(at)` and `[dot]`, numbers with other separators or without the plus
sign, dotted quads in brackets). Boosted trees give each a probability from the span's format and
the words around it; spans at or above their kind's threshold are added where they do not overlap
one that stays, the likeliest first.

No table marks personal data, so the trees learn from the base rules' own finds: a find in its
context, rewritten into each looser form, is an example. The same forms filled with what is none are
counter-examples: a card number with one digit changed so that Luhn fails, an address with a part above 255,
digits after a word that announces another number (section, order), ordinary words of the text around
`at` and `dot`; so are forms known to be harmless (dates, plain numbers, failed checks, an everyday ` at `).
What the generators propose is neither, since it may be personal data. At most ``SAMPLE`` different ones of
each kind and sort are drawn, by hash. A quarter is kept apart: on it each kind's scores are calibrated by a
logistic curve, and its threshold is the lowest probability, ``FLOOR`` at least, at which ``PRECISION`` of
what passes are examples. A kind without examples adds nothing.

Defined results: a null text is the empty text, without spans. Repeated rows are searched one by
one; other columns are ignored. Texts are searched whole, in one pass without shuffle.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsearch.llm.common import SLICE, map_slices, stored

KINDS = ("email", "ip", "card", "phone")
#: Looser forms that a find is rewritten into.
FORMS = {"email": 3, "ip": 2, "card": 3, "phone": 4}
SAMPLE = 3000
FLOOR = 0.9
PRECISION = 0.99
ROUNDS, LEAVES_DEEP, RATE = 40, 3, 0.3

# The base rules.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# starts at borders of digit runs only: within a run the same dots follow, so nothing else can match
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\])\s?[0-9]{1,3}){3}", re.I),
    "card": re.compile(r"[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{4,7}"),
    "phone": re.compile(r"(?<![0-9+.])(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
HARMLESS = {
    "email": re.compile(r"\b[A-Za-z0-9]{2,64} at [A-Za-z0-9-]+\.[A-Za-z0-9-]+"),
    "ip": IP,
    "card": CARD,
    "phone": re.compile(r"(?<![0-9])(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4}|[0-9]{7,20})(?![0-9])"),
}
# Words that announce a number of another kind, and common ends of host names.
NUMBERED = re.compile(r"\b(?:section|version|order|invoice|page|chapter|item|part|ref|id|no|nr|number|code|"
                      r"artikel|kapitel|article|chapitre|pedido|factura|capitulo)\W{0,3}\Z", re.I)
ANNOUNCING = ("section", "version", "order", "invoice", "page", "chapter", "item", "part", "ref", "id", "no.", "number", "code")
HOST_ENDS = frozenset("com org net edu gov info biz io co eu de fr es it uk us ch at be nl pl se no dk fi pt ru cn jp in br ca au nz example".split())
WORD = re.compile(r"[^\W\d_]{3,20}")
CUES = {
    "email": re.compile(r"mail|write|contact|reach", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|pay|credit|account", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ring", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]+", "", text)


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each `@` with a domain after it and a name before it that
    begins after the last address."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            begin = at
            while begin > last and text[begin - 1] in LOCAL_CHARS:
                begin -= 1
            if begin < at:
                out.append((begin, domain.end()))
                last = domain.end()
        at = text.find("@", max(at + 1, last))
    return out


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": base_emails(text) if "@" in text else []}
    found["ip"] = [m.span() for m in IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16
                     and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15] if "+" in text else []
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of all kinds."""
    out = []
    lower = None
    for kind in KINDS:
        if kind == "email":
            lower = text.lower() if lower is None else lower
            if not any(s in lower for s in ("(at)", "[at]", "{at}", " at ")) or not any(s in lower for s in (".", "dot")):
                continue
            # ` at ` alone is an everyday word: it counts only with a spelled-out dot
            out += [(kind, *m.span()) for m in LOOSE[kind].finditer(text)
                    if re.search(r"[(\[{]at|dot", m.group(), re.I)] if ("(at)" in lower or "[at]" in lower or "{at}" in lower or " dot " in lower or "(dot)" in lower or "[dot]" in lower) else []
        elif kind == "ip":
            if "[.]" in text or "(.)" in text or "[dot]" in (lower or text.lower()):
                out += [(kind, *m.span()) for m in LOOSE[kind].finditer(text)]
        else:
            out += [(kind, *m.span()) for m in LOOSE[kind].finditer(text)]
    return out


def features(text: str, kind: str, begin: int, end: int) -> list[float]:
    """Format of the span and its surroundings; nothing that names the base rule itself."""
    span, before, after = text[begin:end], text[max(0, begin - 40) : begin], text[end : end + 20]
    digits = only_digits(span)
    groups = re.split(r"\D+", span.strip("()+ "))
    labels = re.findall(r"[A-Za-z0-9-]+", span) if kind == "email" else []
    return [
        float(bool(NUMBERED.search(before))), float(labels[-1].lower() in HOST_ENDS) if labels else 0.0, len(labels),
        float(any(c.isdigit() for c in labels[0])) if labels else 0.0,
        float(KINDS.index(kind)), len(span), len(digits), len(digits) / max(1, len(span)), len(groups),
        max(map(len, groups)), sum(c in " .-()/_[]" for c in span), float("(" in span), float("[" in span),
        float(luhn(digits)) if 11 < len(digits) <= 19 else 0.0, max((int(g[:4] or 0) for g in groups), default=0),
        float(bool(CUES[kind].search(before))), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before.rstrip()[-1:] in "=:#\"'"), float(before[-1:] in ".-/_"), float(after[:1] in "-/_"),
        sum(c.isdigit() for c in before + after), len(set(digits)),
    ]


def rewritten(kind: str, span: str, turn: int) -> str:
    """A base find in one of the looser forms."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name}(at){host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}"][turn % 3]
    if kind == "ip":
        return span.replace(".", ["[.]", "(.)"][turn % 2])
    digits = only_digits(span)
    if kind == "card":
        mark = "./_"[turn % 3]
        return mark.join([digits[:4], digits[4:8], digits[8:12], digits[12:]])
    tail = digits[-10:].rjust(10, "5")
    a, b, c = tail[:3], tail[3:6], tail[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits[0]} {a} {b} {c}"][turn % 4]


class BoostedTrees:
    """Gradient boosting with the logistic loss; complete trees of ``LEAVES_DEEP`` levels over bins."""

    def __init__(self) -> None:
        self.trees: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        raw = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
        width = max(map(len, cuts)) + 1
        bins = [np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)]  # bin > i: above cut i
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p) + 1e-6
            leaf = np.zeros(len(y), int)
            splits: list[tuple[int, float]] = []
            for level in range(LEAVES_DEEP):  # one split for a whole level keeps trees small and even
                best, n = (-1.0, 0, 0), 1 << level
                for f, at in enumerate(bins):
                    low_g, low_h = (np.bincount(leaf * width + at, v, n * width).reshape(n, width).cumsum(1) for v in (g, h))
                    high_g, high_h = low_g[:, -1:] - low_g, low_h[:, -1:] - low_h
                    gain = (low_g**2 / (low_h + 1.0) + high_g**2 / (high_h + 1.0)).sum(0)[: len(cuts[f])]
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
                _, f, cut = best
                splits.append((f, float(cuts[f][cut])))
                leaf = leaf * 2 + (bins[f] > cut)
            n = 1 << LEAVES_DEEP
            value = RATE * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1.0)
            raw = raw + value[leaf]
            self.trees.append((splits, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), int)
            for f, cut in splits:
                leaf = leaf * 2 + (x[:, f] > cut)
            raw = raw + value[leaf]
        return raw


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to probabilities, by Newton's method. Targets
    are drawn in by one row of each sort, so that separated scores keep a finite slope."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, x, w = np.where(y == 1, high, low), np.stack([raw, np.ones(len(raw))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class PiiModel:
    def __init__(self, trees: BoostedTrees | None, curves: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.curves, self.thresholds = trees, curves, thresholds

    def probabilities(self, text: str, proposed: list[tuple[str, int, int]]) -> list[float]:
        raw = self.trees.score(np.array([features(text, *c) for c in proposed]))
        return [_probability(r, self.curves.get(c[0], (1.0, 0.0))) for r, c in zip(raw.tolist(), proposed, strict=True)]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Base spans and accepted candidates, by kind as listed, then start."""
        base = base_spans(text)
        kept = [(k, *s) for k in KINDS for s in base[k]]
        proposed = candidates(text) if self.trees else []
        if proposed:
            p = self.probabilities(text, proposed)
            for q, (kind, begin, end) in sorted(zip(p, proposed, strict=True), key=lambda c: (-c[0], c[1][1], c[1][0])):
                if q >= self.thresholds.get(kind, 2.0) and not any(b < end and begin < e for _, b, e in kept):
                    kept.append((kind, begin, end))
        return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _probability(raw: float, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-max(-500.0, curve[0] * raw + curve[1])))


def refuted(kind: str, span: str, before: str, seed: int) -> tuple[str, str] | None:
    """(text before, span in the base form) of something like a base find that is not one."""
    if kind == "email":
        words = WORD.findall(before)[:-1]  # the last may be what announces an address
        if len(words) < 3:
            return None
        at = seed % (len(words) - 2)
        return before[: before.rfind(words[-1])], f"{words[at]}@{words[at + 1]}.{words[at + 2]}"
    if kind == "ip":
        parts = span.split(".")
        parts[seed % 4] = str(256 + seed % 744)
        return before, ".".join(parts)
    digits = only_digits(span)
    if kind == "card":
        at = seed % len(digits)
        return before, digits[:at] + str((int(digits[at]) + 1 + seed % 9) % 10) + digits[at + 1 :]
    return f"{before.rstrip()} {ANNOUNCING[seed % len(ANNOUNCING)]} ", str(10**10 + seed * 7919 % (9 * 10**10))


def examples(text: str) -> list[tuple[str, int, list[float]]]:
    """(kind, 1 for an example or 0 for a counter-example, features) of one text."""
    base, out = base_spans(text), []
    for kind in KINDS:
        for begin, end in base[kind]:
            before, after = text[max(0, begin - 60) : begin], text[end : end + 30]
            found = [(1, before, text[begin:end])]
            for turn in range(FORMS[kind]):
                seed = zlib.crc32(f"{turn}{before}{text[begin:end]}".encode("utf-8", "replace"))
                other = refuted(kind, text[begin:end], before, seed)
                for y, ahead, span in found + ([(0, *other)] if other else []):
                    span = rewritten(kind, span, turn)
                    out.append((kind, y, features(ahead + span + after, kind, len(ahead), len(ahead) + len(span))))
    taken = _merged([s for k in KINDS for s in base[k]] + [(b, e) for _, b, e in candidates(text)])
    ends = [e for _, e in taken]
    for kind, rule in HARMLESS.items():
        for m in rule.finditer(text):
            at = bisect.bisect_right(ends, m.start())
            if m.end() - m.start() > 6 and not (at < len(taken) and taken[at][0] < m.end()):
                out.append((kind, 0, features(text, kind, *m.span())))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def train(rows: list[tuple[str, int, list[float]]]) -> PiiModel:
    if not rows or not any(y for _, y, _ in rows):
        return PiiModel(None, {}, {})
    x, y = np.array([f for _, _, f in rows], float), np.array([v for _, v, _ in rows], float)
    kinds = np.array([k for k, _, _ in rows])
    apart = np.arange(len(rows)) % 4 == 3
    trees = BoostedTrees().fit(x[~apart], y[~apart])
    raw = trees.score(x)
    curves, thresholds = {}, {}
    for kind in KINDS:
        if (y[(kinds == kind) & ~apart] == 1).any():
            own = (kinds == kind) & apart
            curves[kind] = calibrated(raw[own], y[own]) if own.any() else (1.0, 0.0)
            thresholds[kind] = _threshold(np.array([_probability(r, curves[kind]) for r in raw[own].tolist()]), y[own])
    return PiiModel(trees, curves, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Lowest threshold from ``FLOOR`` on at which ``PRECISION`` of what passes are examples."""
    for t in [FLOOR, *np.unique(p[p > FLOOR]).tolist()]:
        if (y[p >= t] == 1).sum() >= PRECISION * (p >= t).sum():
            return t
    return float(p.max(initial=FLOOR)) + 1e-9


def sampled(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int, list[float]]]:
    """Examples and counter-examples of all documents; of each kind and sort the first ``SAMPLE`` different
    ones by hash. A task hands on only its own first ones."""
    size = SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], dict[int, list[float]]] = {}

        def cut(some: dict[int, list[float]]) -> dict[int, list[float]]:
            return {h: some[h] for h in sorted(some)[:size]}

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column("text").slice(at, SLICE).to_pylist():
                    for kind, y, f in examples(text or ""):
                        best.setdefault((kind, y), {})[int.from_bytes(hashlib.blake2b(repr((kind, y, f)).encode(), digest_size=7).digest())] = f
                best = {k: cut(v) if len(v) > 2 * size else v for k, v in best.items()}
        rows = [(*k, f, h) for k, v in best.items() for h, f in cut(v).items()]
        kinds, ys, features, orders = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ys, pa.int32()), pa.array(features, pa.list_(pa.float64())),
                                          pa.array(orders, pa.int64())], ["kind", "y", "features", "order"])

    found = stored(docs.select(F.col(text_col).alias("text")).where("text rlike '[0-9@]| at '")
                   .mapInArrow(run, "kind string, y int, features array<double>, order bigint"), "pii-examples")
    rows = []
    for kind in KINDS:
        for y in (0, 1):
            rows += found.where((F.col("kind") == kind) & (F.col("y") == y)).dropDuplicates(["order"]).orderBy("order").limit(size).collect()
    return [(r["kind"], r["y"], list(r["features"])) for r in sorted(rows, key=lambda r: (r["order"], r["kind"], r["y"]))]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``found`` (array of kind, begin, end), ``base`` (the same, base rules only) and
    ``redacted`` (the text with every span replaced by its kind in brackets; null stays null)."""
    model = docs.sparkSession.sparkContext.broadcast(train(sampled(docs, text_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": got["id"], "found": [], "base": [], "redacted": []}
        for text in got["text"]:
            plain = text or ""
            base = base_spans(plain)
            spans = model.value.spans(plain)
            out["base"].append([{"kind": k, "begin": b, "end": e} for k in KINDS for b, e in base[k]])
            out["found"].append([{"kind": k, "begin": b, "end": e} for k, b, e in spans])
            out["redacted"].append(None if text is None else redact(plain, spans))
        return out

    span = "array<struct<kind:string,begin:bigint,end:bigint>>"
    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                      f"id {kind}, found {span}, base {span}, redacted string").withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of all spans per kind, SHA-256 of the base spans, and all spans as text."""
    model = docs.sparkSession.sparkContext.broadcast(train(sampled(docs, text_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(got: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"id": got["id"], "base_sha256": [], "spans": [], **{f"n_{k}": [] for k in KINDS}}
        for text in got["text"]:
            base = base_spans(text or "")
            spans = model.value.spans(text or "")
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in spans))
            joined = ",".join(f"{k}:{b}:{e}" for k in KINDS for b, e in base[k])
            out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{b}:{e}" for k, b, e in spans))
        return out

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                      f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
                      ).withColumnRenamed("id", id_col)
