"""Small gradient-boosted trees for span candidates, with their seed examples.

No table marks personal data, so the trees learn from a fixed, generated seed set: renderings of the
kinds of spans that count as personal data, and look-alikes that do not (versions, order numbers, dates,
measures, failed checksums), each in a context of its own. Two thirds train the trees, one third
calibrates margins to probabilities. A kind is rarer or commoner among the candidates of documents than in
the seed set, which is half of each: how frequent it is there is estimated from the scores of all candidates
(expectation maximisation of the class share), scores are corrected for it, and a kind's threshold is the
least score that is likelier true than not and from which the corrected scores promise the precision asked for.
"""

from __future__ import annotations

import functools
import math
import random
import re
from dataclasses import dataclass, field, replace

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret", "account")
#: Words that hint at a kind when they stand shortly before a span.
HINTS = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "node", "login"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "payment", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "fon"),
    "secret": ("token", "key", "secret", "password", "passwd", "bearer"),
    "account": ("iban", "account", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "order", "invoice", "isbn", "section", "page", "build", "release", "size", "width", "chapter", "model", "ticket", "commit", "sha", "checksum")
#: Top-level domains that count as common.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu")
CONTEXT = 32
#: Scores are counted in this many bins of log odds, from -REACH to REACH.
BINS, REACH = 100, 10.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in (text.count(x) for x in set(text)))


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    after = text[end : end + 8].lower()
    digits = re.sub(r"[^0-9]", "", span)
    numbers = [int(x[:9]) for x in re.findall(r"[0-9]+", span)] or [0]
    words = re.findall(r"[a-z]+", before)
    return [
        float(KINDS.index(kind)),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        sum(c in " .-()[]" for c in span),
        len(set(span)),
        entropy(span) if span else 0,
        len(numbers),
        max(numbers),
        max(len(x) for x in re.findall(r"[0-9]+", span) or [""]),
        float(span[:1] == "+"),
        float("@" in span),
        float(bool(digits) and 13 <= len(digits) <= 19 and luhn(digits)),
        float(span.lower().rsplit(".", 1)[-1].rsplit(" ", 1)[-1] in DOMAINS),
        float(any(h in w for w in words for h in HINTS[kind])),
        float(any(w.startswith(AGAINST) for w in words)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before.rstrip()[-1:] in ":="),
    ]


def seed_examples(seed: int = 7, rounds: int = 260) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, label); the same list on every machine."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(a, b)))

    def card(valid: bool, n: int = 16) -> str:
        body = digit(n - 1)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        whole = body + (last if valid else str((int(last) + r.randint(1, 9)) % 10))
        return r.choice(["", " ", "-"]).join(whole[i : i + 4] for i in range(0, n, 4))

    good = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.{r.choice(DOMAINS)}", f"{word()} [at] {word()} [dot] {r.choice(DOMAINS)}", f"{word()} (at) {word()}.{r.choice(DOMAINS)}"]),
        "ip": lambda: r.choice([".".join(str(r.randint(1, 254)) for _ in range(4)), ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))]),
        "card": lambda: card(True),
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} {digit(3)} {digit(4)} {digit(3)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"0{digit(3)} {digit(6)}"]),
        "secret": lambda: r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "".join(r.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789") for _ in range(r.randint(28, 48)))]),
        "account": lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{digit(2)} " + " ".join(digit(4) for _ in range(5)),
    }
    bad = {
        "email": lambda: r.choice([f"{word()}@{word()}", f"{word()} (at) {word()}", f"@{word()}.{word()}"]),
        "ip": lambda: r.choice([f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(256, 999)}.1.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{digit(2)}:{digit(2)}:{digit(2)}:{digit(2)}"]),
        "card": lambda: r.choice([card(False), digit(16), digit(14)]),
        "phone": lambda: r.choice([f"20{digit(2)}-{digit(2)}-{digit(2)}", f"{digit(3)} {digit(3)} {digit(3)}", f"{digit(2)} {digit(3)} {digit(3)}"]),
        "secret": lambda: r.choice([word(28, 44), digit(32), "-" * 30 + word(2, 4)]),
        "account": lambda: r.choice([f"{word(2, 2).upper()}{digit(2)} {digit(4)} {digit(3)}", f"ISO{digit(4)} {digit(8)}", f"AB{digit(12)}"]),
    }
    out = []
    for _ in range(rounds):
        for kind in KINDS:
            for label, made in ((1, good[kind]()), (0, bad[kind]())):
                hint = r.choice(HINTS[kind]) if r.random() < (0.55 if label else 0.15) else ""
                other = r.choice(AGAINST) if not label and r.random() < 0.5 else ""
                lead = " ".join(x for x in (word(), word(), hint or other) if x) + r.choice([" ", ": ", " = ", " is "])
                text = lead + made + r.choice([" ", ". ", ", "]) + word()
                out.append((kind, text, len(lead), len(lead) + len(made), label))
    return out


@dataclass
class Boosted:
    """Depth-limited regression trees on quantile bins, logistic loss."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    edges: list[np.ndarray] = field(default_factory=list)
    grown: list[tuple] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p) + 1e-9, np.arange(len(y)), self.depth)
            self.grown.append(tree)
            margin += self._walk(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, binned, gradient, hessian, rows, depth):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 20:
            for j in range(binned.shape[1]):
                size = len(self.edges[j]) + 1
                gs = np.cumsum(np.bincount(binned[rows, j], gradient[rows], size))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], hessian[rows], size))[:-1]
                if not len(gs):
                    continue
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1] is None:
            return (-self.rate * g / (h + 1),)
        j, k = best[1]
        left = binned[rows, j] <= k
        return (j, k, self._grow(binned, gradient, hessian, rows[left], depth - 1), self._grow(binned, gradient, hessian, rows[~left], depth - 1))

    def _walk(self, tree, binned):
        if len(tree) == 1:
            return np.full(len(binned), tree[0])
        j, k, low, high = tree
        left = binned[:, j] <= k
        out = np.empty(len(binned))
        out[left], out[~left] = self._walk(low, binned[left]), self._walk(high, binned[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum(self._walk(t, binned) for t in self.grown)


@dataclass
class SpanModel:
    """Trees, the calibration of their margin, and a threshold of probability for each kind."""

    trees: Boosted
    slope: float
    shift: float
    thresholds: dict[str, float]
    seed_counts: dict[str, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -30, 30)))

    def with_thresholds(self, thresholds: dict[str, float]) -> "SpanModel":
        return replace(self, thresholds=thresholds)

    def calibrated(self, counts: dict[str, np.ndarray], precision: float = 0.97, seed_weight: float = 20) -> "SpanModel":
        """Thresholds for candidates of which counts[kind] have a score in each of BINS bins.

        ``seed_weight`` candidates spread like those of the seed set are added, so that a kind with few or no
        candidates keeps about the threshold of the seed set.
        """
        found = {}
        for kind in KINDS:
            seed = self.seed_counts[kind]
            n = counts[kind] + seed_weight * seed / max(seed.sum(), 1)
            corrected = posterior(class_share(n))
            mean = np.cumsum((n * corrected)[::-1]) / np.maximum(np.cumsum(n[::-1]), 1e-12)  # of this bin and all above
            good = np.flatnonzero((mean >= precision) & (corrected[::-1] >= 0.5) & (n[::-1] > 0))
            lower = odds_at(BINS - 1 - good[-1]) if len(good) and good[-1] < BINS - 1 else 0.0  # the first bin has no lower end
            found[kind] = float(lower / (1 + lower)) if len(good) else 1.1
        return self.with_thresholds(found)


def bin_of(p: np.ndarray) -> np.ndarray:
    odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    return np.clip((odds + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(int)


def odds_at(place: np.ndarray) -> np.ndarray:
    """The odds at a place on the scale of bins: 0 the first's lower end, BINS the last's upper one."""
    return np.exp(np.asarray(place) * (2 * REACH / BINS) - REACH)


def posterior(share: float) -> np.ndarray:
    """Probabilities of the bins' middles, which hold for classes of equal size, where one has that share."""
    odds = odds_at(np.arange(BINS) + 0.5) * share / (1 - share)
    return odds / (1 + odds)


def class_share(n: np.ndarray, rounds: int = 200) -> float:
    """The share of class 1 that makes the counts of scores likeliest (scores hold for classes of equal size)."""
    share = 0.5
    for _ in range(rounds):
        share = float(np.clip((n * posterior(share)).sum() / max(n.sum(), 1e-12), 1e-6, 1 - 1e-6))
    return share


@functools.cache
def trained() -> SpanModel:
    """The model fitted to the seed set, with thresholds for candidates like those of its last third."""
    examples = seed_examples()
    x = np.array([features(*e[:4]) for e in examples])
    y = np.array([float(e[4]) for e in examples])
    fold = np.arange(len(y)) // 12 % 3
    trees = Boosted().fit(x[fold < 2], y[fold < 2])
    margin, truth = trees.margin(x[fold == 2]), y[fold == 2]
    slope, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        slope -= 0.05 * float(((p - truth) * margin).mean())
        shift -= 0.05 * float((p - truth).mean())
    model = SpanModel(trees, slope, shift, {}, {})
    bins = bin_of(model.probability(x[fold == 2]))
    kinds = np.array([e[0] for e in examples])[fold == 2]
    model.seed_counts = {kind: np.bincount(bins[kinds == kind], minlength=BINS).astype(float) for kind in KINDS}
    return model.calibrated({kind: np.zeros(BINS) for kind in KINDS})
