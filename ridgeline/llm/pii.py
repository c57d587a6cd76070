"""Personal data in texts: candidate spans, boosted trees, calibrated selection.

The base rules (email, ip, card, phone) always select their spans. High-recall generators propose more,
overlapping ones (obfuscated addresses, numbers without a plus, keys, account numbers); boosted trees
(``pii_gbdt``) score each from its format and context, a kind's threshold selects, and of overlapping
additions the likelier stays. Additions never replace or overlap a base span.

Thresholds are calibrated on the documents themselves: one pass counts, by kind and score, the candidates of
every text; from these counts (a hundred a kind) follows how frequent the kind is among them, which corrects
the scores, and the least score from which the precision to be expected is reached.

Spans are (kind, start, end) in code points, end exclusive. Every text is read whole, once.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_gbdt
from .common import text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
#: The base rules. ``LOCAL`` then ``DOMAIN`` make an email; looking for the @ first finds
#: the same leftmost matches and stays linear in texts of long unbroken words.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[^0-9]+")

#: Generators of further candidates: kind, what a text must hold for them to run, pattern. Counts in them are
#: formats (groups of a number, labels of an address); runs of letters have no bound, and are entered once each.
GENERATORS = (
    ("email", "at", re.compile(r"(?<![\w.+-])[\w.+-]+\s?[\[(]\s?at\s?[\])]\s?[\w-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[\w-]+){0,3}", re.I)),
    ("email", "@", re.compile(r"(?<![\w@.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*")),
    ("ip", "0", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", "0", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]{0,2}[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", "0", re.compile(r"(?<![0-9A-Za-z])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-][0-9]{3,6}(?:[ .-]?[0-9]{2,6}){0,3}(?![0-9A-Za-z])")),
    ("secret", "0", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{28,}")),
    ("account", "0", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])")),
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base spans, by kind as listed, then start."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        if found := DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = found.end()
                out.append(("email", start, done))
        at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(d) <= 3 and int(d or 0) <= 255 for d in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and pii_gbdt.luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    digit = DIGIT.search(text) is not None
    lower = text.lower() if "[" in text or "(" in text else ""
    out = []
    for kind, needs, pattern in GENERATORS:
        if digit if needs == "0" else ("[at" in lower or "(at" in lower or "[ at" in lower or "( at" in lower) if needs == "at" else needs in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def scored_candidates(text: str, base: list[Span], model: pii_gbdt.SpanModel) -> tuple[list[Span], np.ndarray]:
    """Candidates that overlap no base span, and their probabilities."""
    taken = _disjoint([(s, e) for _, s, e in base])
    found = [c for c in candidates(text) if not _overlaps(taken, c[1], c[2])]
    if not found:
        return [], np.zeros(0)
    return found, model.probability(np.array([pii_gbdt.features(kind, text, s, e) for kind, s, e in found]))


def added_spans(text: str, base: list[Span], model: pii_gbdt.SpanModel) -> list[Span]:
    """Candidates that the model selects and that overlap neither a base span nor a likelier one."""
    found, p = scored_candidates(text, base, model)
    kept: list[Span] = []
    used: list[tuple[int, int]] = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1], found[i][2], found[i][0])):
        kind, s, e = found[i]
        if p[i] >= model.thresholds[kind] and not _overlaps(used, s, e):
            kept.append(found[i])
            bisect.insort(used, (s, e))
    order = {k: i for i, k in enumerate(pii_gbdt.KINDS)}
    return sorted(kept, key=lambda x: (order[x[0]], x[1]))


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) meets one of the sorted, disjoint intervals."""
    i = bisect.bisect_left(taken, (end, 0))
    return i > 0 and taken[i - 1][1] > start


def all_spans(text: str, model: pii_gbdt.SpanModel | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans the method adds)."""
    base = base_spans(text)
    return base, added_spans(text, base, model or pii_gbdt.trained())


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(pii_gbdt.KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def calibrated(docs: DataFrame) -> pii_gbdt.SpanModel:
    """The model with thresholds set on the candidates of all documents; without any, those of its seed set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, counts = pii_gbdt.trained(), Counter()
        for batch in batches:
            for text in batch["text"]:
                found, p = scored_candidates(text, base_spans(text), model)
                counts.update((kind, int(b)) for (kind, _, _), b in zip(found, pii_gbdt.bin_of(p)))
        yield pd.DataFrame([(kind, b, n) for (kind, b), n in counts.items()], columns=["kind", "bin", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInPandas(run, "kind string, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n"))
    histograms = {kind: np.zeros(pii_gbdt.BINS) for kind in pii_gbdt.KINDS}
    for r in counted.collect():  # kinds by bins, at most 600 rows
        histograms[r["kind"]][r["bin"]] = r["n"]
    return pii_gbdt.trained().calibrated(histograms)


def detect(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row per row.

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows are each
    returned; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long"
    thresholds = calibrated(docs).thresholds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pii_gbdt.trained().with_thresholds(thresholds)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, added = all_spans(text, model)
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)


def redact_text(text: str, model: pii_gbdt.SpanModel) -> str:
    """The text with each span, overlapping ones taken together, replaced by its kind in brackets."""
    base, added = all_spans(text, model)
    if not base and not added:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """documents with personal data replaced in ``text``; null texts stay null, other columns as they are.

    n_chars, if there, is counted anew where the text changed.
    """

    thresholds = calibrated(docs).thresholds

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pii_gbdt.trained().with_thresholds(thresholds)
        for texts in batches:
            yield pd.Series([None if t is None else redact_text(t, model) for t in texts], dtype=object)

    out = docs.select("*", redacted("text").alias("__redacted"))
    counted = F.when(F.col("text") == F.col("__redacted"), F.col("n_chars")).otherwise(F.length("__redacted").cast("long")) if "n_chars" in docs.columns else None
    columns = [F.col("__redacted").alias("text") if c == "text" else counted.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
