"""Toxicity, weak labels and quality rules: held-out accuracy, plain models and odd inputs."""

import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm import measures, quality, rules, toxicity


def prose(rng, n, extra=()):
    words = [f"w{rng.integers(0, 400)}" for _ in range(n)]
    for e in extra:
        words.insert(int(rng.integers(0, n)), e)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def talk(spark, frame):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 60, ("you", rng.choice(["idiot", "m0ron", "scumbag!"]), "vermin") if bad else ("friend",))))
        labels.append((i, int(bad)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_score_higher_on_held_out_rows(talk, odd):
    docs, labels = talk
    got = toxicity.scored(odd(docs), labels).select("doc_id", "held_out", "score", "predicted", "features").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 120 and all(0 <= r.score <= 1 and r.features == "x" for r in got)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held)
    assert right > 0.95
    assert toxicity.scored(docs, labels).agg(F.sum("score")).first()[0] == pytest.approx(sum(r.score for r in got), abs=1e-6)


def test_odd_texts_and_labels_score_too(spark, frame, odd, odd_rows, talk):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int").unionByName(talk[1].filter("doc_id > 99"))
    got = toxicity.scored(odd(frame(odd_rows)).unionByName(odd(talk[0].filter("doc_id > 99"))), labels)
    rows = [r for r in got.collect() if r.doc_id is None or r.doc_id < 9]
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize(("label", "score"), [(0, 0.0), (1, 1.0), (None, 0.0)])
def test_one_class_or_none(spark, frame, label, score):
    docs = frame([(i, f"text {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, label) for i in range(40)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, labels).collect()} == {score}
    assert toxicity.scored(frame([]), labels).count() == 0


def test_hidden_letters():
    assert toxicity.plain(toxicity.bare("M0r.0n!")) == "moron" and toxicity.hidden("m0ron") and not toxicity.hidden("2024")


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


@pytest.mark.parametrize("text", [
    "", " \n\x0b", "a", "a b", "a b c a b c", "x " * 200, "a b\na b\n\n a b\nc", "#a *b $ % & | < > é   z", "la la la lb la la la",
])
def test_measures(text):
    assert measures.measures_of(text)[:5] == plain_measures(text)


def test_binomial_bound_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.2), (400, 2, 0.01), (7, 7, 0.5), (0, 0, 0.1)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_safe_and_climb_in_order(frame, spark):
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(1500):  # good texts with few signs, bad ones full of them; a small second stratum
        text = prose(rng, 60)
        rows.append((i, text.replace(" ", "### ") if i % 5 == 0 else text, "xx" if i % 100 == 1 else "en", "s"))
        labels.append((i, int(i % 5 != 0)))
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judged(docs, marks, rules.Risk(alpha=0.1)).collect()}
    good = [r for i, r in got.items() if i % 5]
    assert sum(not r.kept for r in good) / len(good) <= 0.1
    assert all(not r.kept and "symbols per word" in r.failed_rules for i, r in got.items() if i % 5 == 0)
    assert all(r.kept for i, r in got.items() if i % 100 == 1)  # too few labels for any rule


def test_rules_on_odd_rows(frame, odd, odd_rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.judged(odd(frame(odd_rows)), none).collect()
    want = [(r[0], *plain_measures(r[1] or "")) for r in odd_rows]
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(map(str, want))
    assert all(r.kept != r.base_failed for r in got)
    assert rules.judged(frame([]), none).count() == 0


def test_weak_labels_find_faults(frame, odd, odd_rows):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(300):
        text = prose(rng, 80)
        rows.append((i, {0: text.replace(" ", "$$$ "), 1: text.upper().replace(" ", "!! "), 2: "w1 w2 w3 " * 40}.get(i % 10, text)))
    got = {r.doc_id: r for r in quality.scored(odd(frame(rows))).collect()}
    assert sum(r.kept == (i % 10 > 2) for i, r in got.items()) >= 295 and all(0 <= r.score <= 1 for r in got.values())
    assert quality.scored(odd(frame(odd_rows))).count() == len(odd_rows)
    assert quality.scored(frame([])).count() == 0


def test_settled_beliefs_follow_the_votes():
    found = quality.settle([((1, 1, 1), 900), ((0, 1, 1), 50), ((1, 0, 1), 40), ((1, 2, 2), 10)], 40)
    assert found[1, 1, 1] > 0.5 and found[1, 2, 2] > 0.5 and found[0, 1, 1] < 0.5 and found[1, 0, 1] < 0.5
