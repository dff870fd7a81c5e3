"""Scores of toxicity against plain Python, remembered or not."""

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import toxicity

TEXTS = ["You IDIOT there. All is well!", "id-iot, idxiot and idioot.", "i d i o t x. stupidity is fine", "", None, "table chair.", "a" * 130 + " idiot" * 3]


def plain_kernel(s, t):
    """The same sum by the textbook recursion over prefixes."""
    n, d = toxicity.ORDER, toxicity.DECAY
    inner = np.zeros((n, len(s) + 1, len(t) + 1))
    inner[0] = 1
    for i in range(1, n):
        for a in range(1, len(s) + 1):
            for b in range(1, len(t) + 1):
                new = sum(inner[i - 1, a - 1, j - 1] * d ** (b - j + 2) for j in range(1, b + 1) if t[j - 1] == s[a - 1])
                inner[i, a, b] = d * inner[i, a - 1, b] + new
    return sum(inner[n - 1, a, b] * d * d for a in range(len(s)) for b in range(len(t)) if s[a] == t[b])


def machine(landmarks=(b"idiot", b"stupid")):
    kernel = toxicity.Kernel(list(landmarks))
    return toxicity.Machine(kernel, np.arange(1.0, 2 * len(landmarks) + 1), -1.0, 1.5, 0.25)


def test_scores_equal_plain_ones():
    m = machine()
    got = m.score(pa.array(TEXTS[:6], pa.large_string()))
    own = [plain_kernel(b"^" + w + b"$", b"^" + w + b"$") for w in m.kernel.words]
    said = [["you", "idiot", "there", "all", "is", "well"], ["idiot", "idxiot", "and", "idioot"], ["i", "d", "o", "t", "x", "idiot", "stupidity", "is", "fine"], [], [], ["table", "chair"]]
    for score, words in zip(got, said, strict=True):
        worst = m.bias
        for w in words:
            k = np.array([plain_kernel(b"^" + w.encode() + b"$", b"^" + t + b"$") / o for t, o in zip(m.kernel.words, own, strict=True)])
            worst = max(worst, np.r_[k, k**3] @ m.weight + m.bias)
        assert score == pytest.approx(1 / (1 + np.exp(-(1.5 * worst + 0.25))), rel=1e-4)


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    text = pa.array([t for i in range(40) for t in (*TEXTS, f"word{i} stup{i}id")], pa.large_string())
    expected = machine().score(text)
    for memory in (0, 400, 5000):
        monkeypatch.setattr(toxicity, "MEMORY", memory)
        m = machine()
        got = np.concatenate([m.score(text.slice(k, 8)) for k in range(0, len(text), 8)])
        assert np.array_equal(got, expected) and m.held <= memory


def test_landmarks_of_any_length():
    long = b"rindfleischetikettierung" * 4
    got = toxicity.Kernel([b"idiot", long])([b"idiot", b"rindfleisch", long, b"x"])
    assert got[0, 0] == pytest.approx(1) and got[1, 1] > 0 and got[2, 1] > 0.2 and not got[3].any()


def test_all_tied_words_are_considered():
    kin = [b"abominableidiot" + bytes([97 + i // 26, 97 + i % 26]) for i in range(650)]
    chosen = toxicity.spread_out([*kin, b"worthless"], 40)
    assert b"worthless" in chosen
    assert toxicity.spread_out([], 40) == []


@pytest.mark.parametrize("pairs", [1, 7, 2048])
def test_landmarks_of_a_length_are_computed_together(monkeypatch, pairs):
    monkeypatch.setattr(toxicity, "PAIRS", pairs, raising=False)
    landmarks = [b"idiot" + bytes([97 + i]) for i in range(20)] + [b"stupid", b"imbecile", b"worthless" * 8]
    words = [b"idiot", b"xidiotb", b"idiiotc", b"stupidity", b"imbeciles", b"worthlessness", b"table", b"", b"id", b"worthless" * 3 + b"idiot" + b"z" * 40]
    kernel = toxicity.Kernel(landmarks)
    calls, real = [], kernel._values
    monkeypatch.setattr(kernel, "_values", lambda s, t: calls.append(len(s)) or real(s, t), raising=False)
    got = kernel(words)
    assert sum(calls) > 60 and max(calls) <= pairs
    if pairs == 2048:  # by width of words and length of landmarks, not by landmark
        assert len(calls) <= 4 * 3 + 1
    for i, w in enumerate(words[:-1]):
        for j, t in enumerate(kernel.landmarks[:-1]):
            s = b"^" + w + b"$"
            assert got[i, j] == pytest.approx(plain_kernel(s, t) / plain_kernel(t, t), rel=1e-4, abs=1e-7)
    each = np.concatenate([kernel([w]) for w in words])
    assert np.array_equal(got, each)
