"""Statistics and scores of the learned operators against plain-Python versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute_llm import gram_buckets, language_scores, text_statistics

from tickloom.llm import language, mixing, quality

TEXTS = [
    "", "One line.", "two\n\nlines with  gaps\t and\ttabs\n", "a a a b | c ### x=1; 99% (ok)", "É\U0001f600 wörter und ÄÖÜ çà\nÉ", "\n", " \n \n", "longlonglonglonglonglonglong w", "same\nsame\nsame", "tab\x0bx\x0cy\rz\x01\x7f",
    "The Quick BROWN fox; jumps? over! the 2 lazy dogs, isn't it.\nEnd|of|row\n", "日本 の テキスト 123",
]


def test_statistics():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices("ab C9.#|\n é", k=r.randint(0, 80))) for _ in range(200)]
    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        np.testing.assert_allclose(row, text_statistics(text), rtol=1e-9, atol=1e-7, err_msg=repr(text))
    assert (quality.statistics(pa.array([None], pa.string())) == quality.statistics(pa.array([""]))).all()


def test_grams_and_scores(stored):
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choices("abcDE é ß1İ", k=r.randint(1, 40))) for _ in range(60)]
    buckets, docs, _ = language.grams(pa.array(texts))
    for i, text in enumerate(texts):
        assert sorted(buckets[docs == i].tolist()) == sorted(gram_buckets(text)), text
    vocabulary = {"en": "the quick brown fox", "de": "der schnelle braune fuchs über", "fr": "le renard brun passé"}
    train = [(" ".join(r.choices(v.split(), k=8)), lang) for lang, v in vocabulary.items() for _ in range(20 + len(lang))]
    model = language.fit_languages(stored(train, "text string, lang string"))
    tried = ["the fox", "der fuchs", "brun fox über", "le le le", "x"]
    names, scores = language.score_texts(pa.array(tried), model)
    for name, score, want in zip(names, scores, language_scores(train, tried), strict=True):
        assert name == max(want, key=want.get) and score == pytest.approx(want[name], rel=1e-3)


def test_raking_steps():
    """Proportional fitting by plain loops over the cells."""
    r = random.Random(3)
    cells = [(a, b) for a in "xyz" for b in "pqr"]
    tokens = np.array([r.randint(1, 50) for _ in cells], float)
    goals = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.1, "q": 0.6, "r": 0.3}]
    want = tokens / tokens.sum()
    for _ in range(300):
        for dim, goal in enumerate(goals):
            for name, share in goal.items():
                at = [i for i, c in enumerate(cells) if c[dim] == name]
                want[at] *= share / want[at].sum()
    np.testing.assert_allclose(mixing.rake(cells, tokens, goals), want * tokens.sum(), rtol=1e-8)
    taken = mixing.capped(cells, tokens, goals, 0.2)
    assert taken.sum() == pytest.approx(0.2 * tokens.sum()) and (taken <= tokens + 1e-9).all()
