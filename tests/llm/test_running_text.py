"""The models of operators 1 and 6 against a plain Kneser-Ney, and what they do with running text."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kmerloom.llm import kneser_ney as kn
from kmerloom.llm import quality_classifier, quality_rules

SCHEMA = "doc_id long, text string, lang string"


def sentences(seed, n):
    """A text in which the order of words matters: each has two possible followers."""
    rng, out, at = random.Random(seed), [], 0
    for _ in range(n):
        out.append(f"word{at}")
        at = (2 * at + rng.randint(0, 1)) % 50
    return out


class Plain:
    """Interpolated modified Kneser-Ney over strings, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.texts = order, texts
        self.levels = {order: Counter(g for t in texts for g in self.grams(t))}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discounts = {k: self.of(c) for k, c in self.levels.items()}
        self.contexts = {k: defaultdict(list) for k in self.levels}
        for k, counts in self.levels.items():
            for g, n in counts.items():
                self.contexts[k][g[:-1]].append(n)

    def grams(self, text):
        s = b"\x01" * (self.order - 1) + b" ".join(text.encode().split()) + b"\x02"
        return [s[i : i + self.order] for i in range(len(s) - self.order + 1)]

    @staticmethod
    def of(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0 for i in (1, 2, 3)]
        return [0.0, *[x if 0 < x < i else 0.5 * i for i, x in enumerate(d, 1)]]

    def low(self, g):
        if not g:
            return 1 / 256
        k, seen = len(g), self.contexts[len(g)][g[:-1]]
        if not seen:
            return self.low(g[1:])
        d, n = self.discounts[k], self.levels[k][g]
        return (n - d[min(n, 3)]) / sum(seen) + sum(d[min(x, 3)] for x in seen) / sum(seen) * self.low(g[1:])

    def perplexity(self, text, counted):
        grams = self.grams(text)
        own = Counter(grams) if counted else Counter()
        d, logp = self.discounts[self.order], 0.0
        for g in grams:
            left = {h: n - own[h] for h, n in self.levels[self.order].items() if h[:-1] == g[:-1]}
            all_ = sum(left.values())
            if all_ > 0:
                logp += math.log((left.get(g, 0) - d[min(left.get(g, 0), 3)]) / all_ + sum(d[min(n, 3)] for n in left.values()) / all_ * self.low(g[1:]))
            else:
                logp += math.log(self.low(g[1:]))
        return math.exp(-logp / len(grams))


def test_classifier_against_a_plain_model(spark):
    rows = [(i, " ".join(sentences(i, 12)), "en") for i in range(12)] + [(20, "something  else\nentirely", "en"), (21, "word1 word3 word7", "en"), (22, "ünknown $$", "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), labels, order=4).collect()}
    plain = Plain([t for i, t, _ in rows if i < 8], 4)
    for i, text, _ in rows:
        assert got[i] == pytest.approx(plain.perplexity(text, i < 8), rel=1e-4), i


def test_rules_against_a_plain_model(spark):
    """Both passes: what lies outside the tight band under the first model is not counted by the second."""
    rng = random.Random(3)
    rows = [(i, " ".join(sentences(i, 12)), "en") for i in range(20)] + [(30 + i, " ".join(rng.choice("#$%") * 5 + w for w in sentences(i, 12)), "en") for i in range(2)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), order=4).collect()}
    plain = Plain([t for _, t, _ in rows], 4)
    first = {i: math.log(plain.perplexity(t, True)) for i, t, _ in rows}
    steps = sorted(round(x / 1e-3) for x in first.values())
    q1, q2, q3 = (1e-3 * next(s for j, s in enumerate(steps, 1) if 4 * j >= len(steps) * q) for q in (1, 2, 3))
    inside = {i for i, x in first.items() if q2 - 3 * max(q2 - q1, 0.01) <= x <= q2 + 2 * max(q3 - q2, 0.01)}
    assert 15 <= len(inside) < 22 and not inside & {30, 31}
    plain = Plain([t for i, t, _ in rows if i in inside], 4)
    for i, text, _ in rows:
        assert out[i].perplexity == pytest.approx(plain.perplexity(text, i in inside), rel=1e-4), i
        assert out[i].kept == (not out[i].base_failed and out[i].low <= out[i].perplexity <= out[i].high)


def test_repetition_and_strange_order_cost(spark):
    rows = [(i, " ".join(sentences(i, 200)), "en") for i in range(40)]
    backwards = " ".join(sentences(100, 200))[::-1]
    rows += [(100, " ".join(sentences(100, 200)), "en"), (101, backwards, "en"), (102, " ".join(["word7"] * 200), "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    ppl = {r.doc_id: r.perplexity for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert ppl[100] * 1.1 < ppl[101] and ppl[100] < ppl[102]
    # A trusted text is judged by the others, so it looks like one the model has not seen.
    assert abs(ppl[0] - ppl[100]) < 0.05 * ppl[100]


def test_one_trusted_outlier_does_not_open_the_gate(spark):
    rng = random.Random(1)
    junk = lambda: " ".join("".join(rng.choice("QXZ#$%&!") for _ in range(9)) for _ in range(200))
    rows = [(i, " ".join(sentences(i, 200)), "en") for i in range(100)] + [(100, junk(), "en"), (101, junk(), "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(101)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_classifier.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert not kept[101] and sum(kept[i] for i in range(100)) >= 97


def test_both_sides_of_the_band_reject(spark):
    rng = random.Random(2)
    phrase = "the quick brown fox jumps over the lazy dog".split()
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    usual = lambda: [w for _ in range(10) for w in [*(word() for _ in range(9)), *phrase]]
    rows = [(i, " ".join(usual()), "en") for i in range(90)]
    rows += [(i, " ".join("".join(rng.choice("QXZJV#$%&!") for _ in range(9)) for _ in range(180)), "en") for i in range(90, 100)]
    # Far more predictable than the rest: what all texts have, and nothing else.
    rows += [(i, " ".join(phrase * 20), "en") for i in range(100, 103)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), max_repeat_percent=100).collect()}
    assert sum(out[i].kept for i in range(90)) >= 86
    assert all(out[i].perplexity > out[i].high and not out[i].kept for i in range(90, 100))
    assert all(out[i].perplexity < out[i].low and not out[i].kept for i in range(100, 103))


def test_distinct_grams_in_parts():
    """Parts of any size give the same keys: one text each, all at once, and none without text."""
    texts = [kn.running(t) for t in ("the cat sat", "", None, "the  cat\tsat", "a" * 5000, "été à la mer", "x")]
    whole = np.unique(kn.text_grams([t for t in texts if t], 4)[0])
    for part in (1, 10, 4000, 1 << 20):
        assert kn.distinct_grams(texts, 4, part=part).tolist() == whole.tolist()
    assert len(kn.distinct_grams([b"", b""], 4)) == 0
