"""The quality model against slow versions of its features, its training and its verdict."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import quality_rules as Q
from graphloom.llm.common import Hashes


def slow_fit(rows, y, frequency, steps=50, l1=0.0):
    """fit_head with one number at a time."""
    used = sorted({s for slots, _ in rows for s in slots.tolist()})
    at = {s: i for i, s in enumerate(used)}
    x = np.zeros((len(rows), len(used)))
    for i, (slots, values) in enumerate(rows):
        for s, v in zip(slots.tolist(), values.tolist(), strict=True):
            x[i, at[s]] += v
    held = [i % 5 == 0 for i in range(len(rows))]
    n1, n0 = sum(y[i] == 1 for i in range(len(y)) if not held[i]), sum(y[i] == 0 for i in range(len(y)) if not held[i])
    w, b, m, v, mb, vb = [np.zeros(len(used)), 0.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0]
    for t in range(1, steps + 1):
        g, gb = 1e-5 * w, 0.0
        for i in range(len(rows)):
            if not held[i]:
                e = (0.5 / n1 if y[i] == 1 else 0.5 / n0) * (1 / (1 + np.exp(-(x[i] @ w + b))) - y[i])
                g, gb = g + e * x[i], gb + e
        if l1:
            g = np.array([gi + l1 * np.sign(wi) if wi else np.sign(gi) * max(abs(gi) - l1, 0) for gi, wi in zip(g, w, strict=True)])
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 40)
        new = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w = np.where((w * new < 0) & bool(l1), 0, new)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    raw = x @ w
    a, c = Q._platt(np.array([raw[i] + b for i in range(len(y)) if held[i]]), np.array([y[i] for i in range(len(y)) if held[i]]), np.array([frequency[i] for i in range(len(y)) if held[i]]))
    return dict(zip(used, w, strict=True)), a, c + a * b


@pytest.mark.parametrize("l1", [0.0, 6e-3])
def test_fit(l1, monkeypatch):
    r = random.Random(1)
    rows, y = [], []
    for i in range(60):
        slots = np.array(sorted(r.sample(range(40), 8)), np.int32)
        rows.append((slots, np.array([r.random() for _ in slots], np.float32)))
        y.append(int(slots[0] < 3) if i % 7 else 1 - int(slots[0] < 3))
    y, frequency = np.array(y), np.array([1.0 + i % 3 for i in range(60)])
    want, slope, offset = slow_fit(rows, y, frequency, l1=l1)
    monkeypatch.setattr(Q.blocks, "__defaults__", (20,))  # many blocks
    head = Q.fit_head(rows, y, frequency, l1=l1)
    assert head.weights[list(want)] == pytest.approx(list(want.values()), abs=1e-4)
    assert (head.slope, head.offset) == pytest.approx((slope, offset), rel=1e-3)
    assert not head.weights[40:].any()


def test_platt_minimizes_its_loss():
    r = np.random.default_rng(2)
    raw = r.normal(size=200)
    y = (raw + r.normal(size=200) > 0.3).astype(int)
    w = np.where(y == 1, 3.0, 1.0)
    a, c = Q._platt(raw, y, w)
    scale = len(y) / w.sum()
    n1, n0 = w[y == 1].sum() * scale, w[y == 0].sum() * scale
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, c):
        q = 1 / (1 + np.exp(-(a * raw + c)))
        return -(w * scale * (goal * np.log(q) + (1 - goal) * np.log(1 - q))).sum() + 5e-4 * ((a - 1) ** 2 + c**2)

    assert all(loss(a, c) <= loss(a + d, c + e) + 1e-9 for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_features_and_verdict():
    text = "One two three two\tTHREE  one twofold ü"
    raw = text.encode()
    words = raw.split()
    slots, values = Q.quality_features(raw, Hashes().of(words))
    assert len(slots) == len(words) + len(words) - 1 + len(raw) - 3
    families = slots >> Q.BITS
    assert Counter(families.tolist()) == {0: len(words), 1: len(words) - 1, 2: len(raw) - 3}
    assert all(values[families == f] == pytest.approx(1 / n**0.5) for f, n in ((0, len(words)), (1, len(words) - 1), (2, len(raw) - 3)))
    # equal words, pairs and grams have equal slots
    assert [s for s in slots[:8].tolist()].count(slots[1]) == 2
    slots, values = Q.toxic_features(raw, Hashes())
    low = raw.lower()
    begins = {(b" " + low.replace(b"\t", b" ") + b"    ")[i : i + 5] for i, c in enumerate(b" " + low.replace(b"\t", b" ")) if c == 32}
    assert len(slots) == len(set(low.split())) + len(begins) and len(set(slots.tolist())) == len(slots)
    w = np.zeros(Q.FAMILIES << Q.BITS, np.float32)
    w[slots] = 1.0
    head = Q.Head(w, 2.0, -1.0)
    p = 1 / (1 + np.exp(-(2.0 * values.sum() - 1.0)))
    assert head.probability(slots, values) == pytest.approx(p)
    long = " ".join(f"w{i}" for i in range(30))
    good = Q.judge([long, text, None], (None, None), Hashes(), 0.4, 0.5)
    assert good["kept"] == [True, False, False] and good["base_failed"] == [False, True, True]
    sure = Q.Head(np.zeros(Q.FAMILIES << Q.BITS, np.float32), 1.0, 4.0)
    assert Q.judge([long], (sure, sure), Hashes(), 0.4, 0.5)["kept"] == [False]
    assert Q.judge([long], (sure, None), Hashes(), 0.4, 0.5)["kept"] == [True]
