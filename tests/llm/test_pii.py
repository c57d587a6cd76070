import hashlib
import random
import re

import numpy as np

from ridgeline.llm import pii, pii_gbdt

from .conftest import ODD

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii_gbdt.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_rules():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789012345@@..-+ +() aé9b%") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)


def test_trees_tell_seed_kinds_apart():
    model = pii_gbdt.trained()
    examples = pii_gbdt.seed_examples(seed=99, rounds=60)
    p = model.probability(__import__("numpy").array([pii_gbdt.features(*e[:4]) for e in examples]))
    right = sum((p[i] >= model.thresholds[e[0]]) == bool(e[4]) for i, e in enumerate(examples))
    assert right / len(examples) > 0.9


def test_detect(spark, docs):
    text = "mail a.b@c.org or x [at] y [dot] com, 10.0.0.1, +1 (017) 555-7713, card 4845168114407329 token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\""
    got = {r["doc_id"]: r for r in pii.detect(docs((9, text), *ODD)).collect()}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 1, 1, 1)
    assert got[9]["base_sha256"] == hashlib.sha256(pii.joined(plain(text)).encode()).hexdigest()
    assert "secret:" in got[9]["spans"] and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.detect(docs((9, text), *ODD)).count() == 1 + len(ODD)
    assert pii.detect(docs((9, text)).limit(0)).count() == 0


def test_redact(spark, docs):
    rows = {r["doc_id"]: r for r in pii.redact(docs((8, "write to a@b.org now"), (9, "clean"), (1, None))).collect()}
    assert rows[8]["text"] == "write to [EMAIL] now" and rows[8]["n_chars"] == 20
    assert rows[9]["text"] == "clean" and rows[1]["text"] is None and rows[8]["score"] == "x"


def test_long_numbers_and_keys(spark, docs):
    key = "".join("0123456789abcdef"[i * 7 % 16] for i in range(400))
    zeros = "0" * 6000 + ".1.1.1"
    texts = {1: zeros, 2: "1" * 6000 + ".1.1.1", 3: f"secret = {key}", 4: "-a" * 60_000, 5: "a." * 60_000, 6: "token: abcdefghijklmnopqrstuvwxyzab_cd9fghijkl"}
    rows = {r["doc_id"]: r for r in pii.detect(docs(*texts.items())).collect()}
    assert rows[1]["n_ip"] == 1 and rows[2]["n_ip"] == 0 and rows[4]["n_added"] == rows[5]["n_added"] == 0
    assert f"secret:9:{9 + len(key)}" in rows[3]["spans"]
    assert ("secret", 7, 46) in pii.candidates(texts[6])


def test_added_spans_equal_a_plain_selection():
    """Brute force over overlapping candidates: highest probability first, none over a base span or one taken."""
    model, r = pii_gbdt.trained(), random.Random(5)
    for kind, text, *_ in r.sample(pii_gbdt.seed_examples(seed=23, rounds=60), 150):
        base = pii.base_spans(text)
        left = [(k, *m.span()) for k, _, p in pii.GENERATORS for m in p.finditer(text)]
        left = [c for c in left if c in pii.candidates(text)]
        scores = {c: model.probability(np.array([pii_gbdt.features(c[0], text, c[1], c[2])]))[0] for c in left}
        taken, want = [(s, e) for _, s, e in base], []
        for c in sorted(set(left), key=lambda c: (-scores[c], c[1], c[2], c[0])):
            if scores[c] >= model.thresholds[c[0]] and not any(s < c[2] and c[1] < e for s, e in taken):
                want.append(c)
                taken.append(c[1:])
        assert sorted(set(pii.added_spans(text, base, model))) == sorted(want)


def test_thresholds_follow_the_documents():
    """New seed examples, true spans made rare or common: the share is found, and selections are as precise as asked for."""
    model = pii_gbdt.trained()
    examples = pii_gbdt.seed_examples(seed=99, rounds=400)
    scores = model.probability(np.array([pii_gbdt.features(*x[:4]) for x in examples]))
    for keep in (0.05, 0.5, 1.0):
        r, counts, told = random.Random(1), {k: np.zeros(pii_gbdt.BINS) for k in pii_gbdt.KINDS}, []
        for p, (kind, *_, label) in zip(scores, examples):
            if label and r.random() > keep:
                continue
            counts[kind][pii_gbdt.bin_of(np.array([p]))[0]] += 1
            told.append((kind, p, label))
        fitted = model.calibrated(counts)
        picked = [label for kind, p, label in told if p >= fitted.thresholds[kind]]
        positives = sum(label for *_, label in told)
        share = pii_gbdt.class_share(sum(counts.values()))
        assert abs(share - positives / len(told)) < 0.08
        assert sum(picked) / len(picked) >= 0.85 and sum(picked) / positives >= 0.5
    assert len(set(model.thresholds.values())) > 1
