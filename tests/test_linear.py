"""Time of text functions grows with the text, not with its square."""

import random
import time

import numpy as np
import pytest

from weftline.functions import english, finnish
from weftline.functions.sentences import chunk_text, pack_sentences, split_sentences
from weftline.operators.speech import complete_linkage


def _seconds(f, make, n):
    text = make(n)
    t = time.perf_counter()
    f(text)
    return time.perf_counter() - t


CASES = [
    (split_sentences, lambda n: "Some words here stand. And more of them do, too! " * n, 8000),
    (split_sentences, lambda n: "a 5.2 b. c etc. d" * n, 8000),
    (chunk_text, lambda n: "Some words here stand. And more of them do, too! " * n, 8000),
    (lambda t: finnish.run_pass("roman", t), lambda n: "Kustaa II ja muut sanat XIV vuosisata " * n, 3000),
    (lambda t: finnish.run_pass("acronym_fallback", t), lambda n: "SUURI MUSTA DVD KIRJA ja XKJ sana " * n, 3000),
    (lambda t: english.run_pass("acronyms", t), lambda n: "THE BIG RED HOUSE and FBI or " * n, 3000),
    (lambda t: english.run_pass("roman", t), lambda n: "King" + " " * 120 + "VII and Part II or " * n, 3000),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_time(case):
    f, make, n = CASES[case]
    _seconds(f, make, n // 8)
    small, large = (min(_seconds(f, make, k) for _ in range(2)) for k in (n, 4 * n))
    assert large < 9 * small + 0.05


def test_sentences_are_those_of_plain_rules():
    text = "Dr. Smith came e.g. at 5.2 p. 7. Then he left... Äiti sanoi: tule! Nyt? esim. tämä. \"Yes.\" x. end.  last"
    got = split_sentences(text)
    assert "".join("".join(s.split()) for s in got) == "".join(text.split())
    assert got[0] == "Dr. Smith came e.g. at 5.2 p. 7." and got[1] == "Then he left..."


def test_long_sentences_are_split_alone():
    assert pack_sentences(["aa", "bb", "c" * 5 + " " + "d" * 5, "ee", "ff"], 7) == ["aa bb", "ccccc", "ddddd", "ee ff"]


def test_roman_numerals_far_from_their_word():
    assert english.run_pass("roman", "King" + " " * 500 + "VII") == "King" + " " * 500 + "the seventh"


def _naive(x, most):
    groups = [[i] for i in range(len(x))]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    while True:
        best = min(((max(d[i, j] for i in a for j in b), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m), default=None)
        if best is None or best[0] >= most:
            break
        groups[best[1]] += groups.pop(best[2])
    label = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [label[i] for i in range(len(x))]


def test_complete_linkage():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 30, 60):
        x = rng.standard_normal((n, 6)) + rng.integers(0, 3, (n, 1))
        for most in (0.05, 0.3, 0.8, 2.1):
            assert complete_linkage(x, most).tolist() == _naive(x, most)
    assert complete_linkage(np.zeros((0, 3)), 0.5).tolist() == []


def test_random_texts_keep_their_words():
    rng = random.Random(4)
    for _ in range(100):
        t = " ".join(rng.choice(["a.", "Bb", "etc.", "x!", "3.5", "…", "Dr.", "löyly", "Q?"]) for _ in range(60))
        assert " ".join(chunk_text(t, 25)).split() == t.split()
