"""Hard negatives, whitening and licence scans against plain-Python versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import DOCS
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives, license_rules, licenses, whitening
from tickloom.llm.hard_negatives import Fields

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int"


def negatives(rows, every, k=5, lanes=5):
    """All anchors, positives and negatives by sorting every score."""
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _, _ in fine if i % every == 0}):
        _, label, v = min(r for r in fine if r[0] == i)
        scores = sorted((-sum(a * b for a, b in zip(v, c)), j, l) for j, l, c in fine if j != i)
        for p, j, _ in [s for s in scores if s[2] == label][:k]:
            hard = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:lanes]
            out += [(i, j, r + 1, h[1], -p, -h[0]) for r, h in enumerate(hard)]
    return Counter(out)


def mined(stored, rows, every, **more):
    vectors = stored([(i, v, l, "x", None) for i, v, l in rows], VECTORS)
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(vectors, F.col("vec_id") % every == 0, **more).collect())


def test_hard_negatives(stored, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=7).round(2) + 0.5], int(rng.integers(4))) for i in range(400)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(60)]  # many ties
    rows += [(2000, None, 1), (2010, [1.0, None] + [0.0] * 5, 1), (2020, [float("nan")] * 7, 1), (2030, [float("inf")] * 7, 1), (None, rows[0][1], 1), (2040, rows[5][1], None)]
    rows += [(33, rows[4][1], 2), (20, rows[6][1], 0), (2050, [0.0] * 7, 1), (2060, [-1.0] * 7, 3), (2070, [1.0], 1), (2080, [0.5] * 9, 77), (2090, [], 2)]
    want = negatives(rows, 10)
    assert want and mined(stored, rows, 10) == want
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "LANES", 8)
    assert mined(stored, rows, 10, positives=2, negatives=3) == negatives(rows, 10, 2, 3)
    assert mined(stored, [], 10) == Counter() and mined(stored, rows[:1], 1) == Counter()
    assert mined(stored, [r for r in rows if r[0] is None or r[0] >= 2000][:6], 10) == Counter()


def test_hard_negatives_of_large_components(stored):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 6) for _ in range(3)], i % 2) for i in range(80)]
    assert mined(stored, rows, 5) == negatives(rows, 5)


@pytest.mark.parametrize("most", [1, 150, 1 << 20, 1 << 29, 1 << 40, 1 << 58])
def test_fields_hold_exact_scores(most):
    rng = random.Random(most)
    anchors = [[rng.randint(-most, most) for _ in range(4)] for _ in range(3)] + [[0] * 4]
    rows = [[rng.randint(-most, most) for _ in range(4)] for _ in range(300)] + [[most] * 4, [-most] * 4]
    want = [[sum(a * b for a, b in zip(x, y)) for y in rows] for x in anchors]
    fields = Fields(most, max(sum(map(abs, a)) for a in anchors))
    if max(abs(s) for w in want for s in w) >= 1 << 63:
        with pytest.raises(OverflowError):
            list(fields.scores(np.array(anchors, np.int64), fields.pack(np.array(rows, np.int64)), len(rows)))
        return
    got = list(fields.scores(np.array(anchors, np.int64), fields.pack(np.array(rows, np.int64)), len(rows)))
    assert [g.tolist() for g in got] == want


def exact_whitening(vectors, k):
    """Whitened rows from a dense eigendecomposition, deviations from fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    return deviations, centred @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(got, vectors, k, n, within):
    deviations, white, explained = exact_whitening(vectors, k)
    assert len(got) == len(vectors) * k and {r.n for r in got} == {n}
    by_row = {(r.vec_id, r.component): r for r in got}
    found = np.array([[by_row[i, c + 1].whitened for c in range(k)] for i in range(len(vectors))])
    assert np.abs(found * np.sign((found * white).sum(axis=0)) - white).max() < within
    assert all(int(r.deviation) == deviations[r.vec_id] for r in got)
    assert [by_row[0, c + 1].explained for c in range(k)] == pytest.approx(list(explained), rel=1e-10)
    assert got[0].identity_error < 1e-9


def test_whitening(stored, monkeypatch):
    monkeypatch.setattr(whitening, "ROW_BLOCK", 50)
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(12, 12)) * np.logspace(0, -2, 12)
    vectors = [[float(c) for c in row] for row in rng.normal(size=(300, 12)) @ mixing]
    rows = [(i, v, None, "x", None) for i, v in enumerate(vectors)] + [(900, None, 1, "", 1), (901, [None] * 12, 1, "", 1), (902, [float("nan")] * 12, 1, "", 1), (903, [float("-inf")] * 12, 1, "", 1)]
    got = whitening.whitened(stored(rows, VECTORS)).collect()
    check_whitening(got, vectors, 8, 300, 1e-9)
    # Fewer steps than dimensions end early; identical values still come whitened.
    few = whitening.whitened(stored(rows, VECTORS), components=2, steps=9).collect()
    assert len(few) == 600 and few[0].identity_error < 1e-9


def test_whitening_of_large_and_small_deviations(stored):
    rng = np.random.default_rng(4)
    vectors = [[float(c) for c in row] for row in rng.normal(size=(120, 5)) * [1e7, 1e3, 1.0, 0.1, 0.02]]
    got = whitening.whitened(stored([(i, v, 1, "x", 1) for i, v in enumerate(vectors)], VECTORS), components=3).collect()
    check_whitening(got, vectors, 3, 120, 1e-5)


def test_whitening_with_equal_eigenvalues_and_lost_rank(stored):
    # A cube's corners: three equal eigenvalues; two more dimensions never vary or repeat another.
    corners = [[a, b, c, 0.25, a] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)] * 3
    got = whitening.whitened(stored([(i, v, 1, "x", 1) for i, v in enumerate(corners)], VECTORS)).collect()
    assert len(got) == 24 * 3 and {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-12
    assert sorted({round(r.explained, 12) for r in got}) == [0.25, 0.5]
    ragged = [[1.0], [], [2.0, 3.0], [0.0, 1.0]]
    got = whitening.whitened(stored([(i, v, 1, "x", 1) for i, v in enumerate(ragged)], VECTORS)).collect()
    check_whitening(got, [[1.0, 0.0], [0.0, 0.0], [2.0, 3.0], [0.0, 1.0]], 2, 4, 1e-12)
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(i, [0.5, 0.5]) for i in range(9)], [(1, [])]):
        assert whitening.whitened(stored([(i, v, 1, "x", 1) for i, v in rows], VECTORS)).count() == 0
    repeated = [(None, [0.0, 1.0]), (None, [1.0, 0.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0])]
    assert whitening.whitened(stored([(i, v, 1, "x", 1) for i, v in repeated], VECTORS)).count() == 8


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scanned(text):
    """Every rule on every text, without gates; containment by comparing all pairs."""
    words = WORD.findall((text or "").translate(FOLD))
    spaced = "".join(f" {w} " for w in words)
    hits = []
    for k, rule in enumerate(license_rules.RULES):
        for m in re.finditer(license_rules.over_words(rule.pattern), spaced):
            hits.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, rule.priority, k))
    kept = [a for a in hits if a[2] == license_rules.BASE or not any(b != a and b[0] <= a[0] and b[1] >= a[1] and (b[2], a[1] - a[0] - b[1] + b[0], b[3]) < (a[2], 0, a[3]) for b in hits)]
    base = [a[0] for a in hits if a[2] == license_rules.BASE]
    places = [i for label, p in license_rules.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert sorted(base) == sorted(places)

    def labels(some):
        return ",".join(sorted({license_rules.RULES[a[3]].label for a in some}))

    score = max((license_rules.SURE[a[2]] for a in kept), default=0.0)
    return len(words), len(base), min(base, default=None), max(base, default=None), labels(a for a in hits if a[2] == license_rules.BASE), labels(kept), score


def example(pattern, rng):
    """A text that the pattern matches."""
    import re._parser as parser

    def make(tree):
        out = ""
        for kind, value in tree:
            name = str(kind)
            if name == "LITERAL":
                out += chr(value)
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "IN":
                out += "x" if str(value[0][0]) == "NEGATE" else chr(rng.choice(value)[1])
            elif name == "BRANCH":
                out += make(rng.choice(value[1]))
            elif name == "SUBPATTERN":
                out += make(value[3])
            elif name == "MAX_REPEAT":
                out += "".join(make(value[2]) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
            else:
                raise ValueError(name)
        return out

    return make(parser.parse(pattern))


def test_every_rule_has_its_gate_in_all_its_matches():
    rng = random.Random(2)
    assert len(license_rules.RULES) > 200
    for rule in license_rules.RULES:
        for _ in range(40):
            text = example(rule.pattern, rng)
            assert set(text.split()) & set(rule.gates), (rule, text)
            assert re.search(license_rules.over_words(rule.pattern), "".join(f" {w} " for w in text.split())), (rule, text)


def test_license_scan(stored, odd_docs):
    rng = random.Random(6)
    texts = [
        "Released under the MIT License.", "mit license mit license MIT-License", "mitlicense permit license", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under CC BY-NC 4.0.", "cc by cc by",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "GNU  General\nPublic\tLicense", "GNU Lesser General Public License v3",
        "the İMIT license, MİT License and the MIT Licence", "gnu-general-public-license, gnu/general_public license", "\x7fmit\x00license x", "mit license" * 3, "Mit Lizenz", "apache license " * 400,
        "This work is licensed under the GNU General Public License, version 3.", "https://creativecommons.org/licenses/by-sa/4.0/ and http://www.apache.org/licenses/LICENSE-2.0", "public domain",
    ]
    filler = ["the", "license", "mit", "gnu", "cc", "by", "version", "2", "0", "und", "été", "apache", "Ω"]
    for _ in range(150):
        parts = [rng.choice([example(rng.choice(license_rules.RULES).pattern, rng).upper(), " ".join(rng.choices(filler, k=rng.randint(0, 6))), rng.choice(texts)]) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", ", ", "-"]).join(parts))
    rows = [(i, t, "en", "a", 0, "x", None) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 0, "x", None), (0, texts[1], "en", "a", 0, "x", None)] + [(5000 + k, *r[1:]) for k, r in enumerate(odd_docs)]
    docs = stored(rows, DOCS).withColumn("words", F.lit("clash")).withColumn("labels", F.lit(1))
    got = Counter(tuple(r) for r in licenses.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())
    assert got == Counter((r[0], *scanned(r[1])) for r in rows)
    assert licenses.license_scan(stored([], DOCS)).count() == 0
    # Detections come whole, with places.
    found = licenses.detections(stored([(1, texts[6])], "doc_id long, text string")).where("kept").collect()
    assert {(license_rules.RULES[r.rule].label, r.start) for r in found} == {("apache-2.0", 0), ("apache", 3)}
