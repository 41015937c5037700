"""Quality facts against plain counting; estimates against a plain search; planted outliers."""

import itertools
import random
import re

import numpy as np

from shardlens.llm import quality_outliers as Q

SCHEMA = "doc_id long, text string, lang string, source string, key string, mean int, n int, z0 int, kept int, distance int, own int, start int"
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def plain(text):
    words = words_of(text or "")
    lines, seen, dup = 0, set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), lines


def test_facts_against_plain_counting():
    r = random.Random(1)
    alphabet = ["a", "b", "é", "漢", "#", "|x|", "a\xa0b", "\x1c", "\x85"]
    for _ in range(300):
        text = "".join(r.choice(alphabet) + r.choice([" ", " ", "\n", "\t", "\r\n", "\x0b", "  "]) for _ in range(r.randrange(0, 40)))
        assert Q.text_facts(text.encode()) == plain(text)
    assert Q.text_facts(b"") == (0, 0, 0, 0, 0, 0)


def clean(r, words=None):
    vocabulary = ["".join(r.choices("aeioubcdst", k=r.randrange(2, 9))) for _ in range(400)]
    return " ".join(r.choices(vocabulary, k=words or r.randrange(30, 200)))


def frame(spark, rows):
    return spark.createDataFrame([(*row, "k", 1, 1, 1, 1, 1, 1, 1) for row in rows], SCHEMA)


def test_junk_goes_clean_stays(spark):
    r = random.Random(2)
    rows = [(i, clean(r), ["en", "de", None][i % 3], ["a", "b"][i % 2]) for i in range(600)]
    junk = [(1000 + i, re.sub(r"(\w) ", r"\1 | ", clean(r)), ["en", "de", None][i % 3], ["a", "b"][i % 2]) for i in range(90)]
    short = [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "too few words", "en", "a"), (2003, "one two three four five " * 30, "en", "a")]
    out = {x.doc_id: x for x in Q.judged(frame(spark, rows + junk + short).repartition(3)).collect()}
    assert len(out) == len(rows) + len(junk) + len(short)
    assert sum(out[i].kept for i, *_ in rows) >= 0.99 * len(rows)
    assert not any(out[i].kept or out[i].base_failed for i, *_ in junk)
    assert all(out[i].base_failed and not out[i].kept and out[i].distance is None for i, *_ in short)
    for i, text, *_ in (rows + junk)[::40] + short:
        x = out[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.n_lines) == plain(text)


def test_small_groups_and_odd_rows(spark):
    """Sources with few rows are judged together; with too few of all, the plain rules alone hold."""
    r = random.Random(3)
    few = [(i, clean(r), "en", f"s{i}") for i in range(20)] + [(None, clean(r), None, None), (7, "| # " * 3 + clean(r, 40), "xx", "")]
    out = Q.judged(frame(spark, few)).collect()
    assert len(out) == 22 and all(x.kept and x.distance is None for x in out)
    many = few + [(100 + i, clean(r), "en", f"s{i}") for i in range(60)] + [(500, " | ".join(f"w{i}" for i in range(60)), "en", "odd")]
    many += [(600, many[0][1], "en", "s0")] * 2 + [(601, clean(r, 20000), "en", "long")]
    out = {x.doc_id: x for x in Q.judged(frame(spark, many)).collect()}
    assert out[100].kept and not out[500].kept and out[500].distance is not None and out[601].kept and out[600].kept
    assert out[None].distance is None
    assert Q.judged(frame(spark, [])).collect() == []
    assert Q.judged(frame(spark, [(1, None, None, None)])).collect()[0].kept is False


def cloud(spark, x):
    z = np.rint(x * Q.SCALE).astype(int)
    return spark.createDataFrame([("g", *map(int, row)) for row in z], "key string, " + ", ".join(f"z{i} long" for i in range(Q.P)))


def test_estimate_is_near_the_least_determinant(spark):
    """Twelve points, three of them far: of all subsets of nine, the estimate's has (nearly) the least determinant."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (12, Q.P))
    x[9:] += 3
    state = Q.estimates(cloud(spark, x)).collect()[0]
    size = lambda ix: np.linalg.slogdet(np.cov(x[list(ix)].T, bias=True) + np.diag(np.square(Q.FLOOR)))[1]
    least = min(size(ix) for ix in itertools.combinations(range(12), 9))
    assert state["n"] == 9 and abs(state["size"] - least) < 0.01


def test_a_quarter_of_outliers_does_not_move_the_estimate(spark):
    rng = np.random.default_rng(5)
    shape = rng.normal(0, 0.2, (Q.P, Q.P)) + np.eye(Q.P) * 0.3
    good = rng.normal(0, 1, (3000, Q.P)) @ shape
    bad = 4 + rng.normal(0, 0.05, (900, Q.P))
    state = Q.estimates(cloud(spark, np.r_[good, bad]).repartition(5)).collect()[0]
    assert np.abs(np.array(state["mean"])).max() < 0.05
    full = np.zeros((Q.P, Q.P))
    for (i, j), v in zip(Q.PAIRS, state["inverse"]):
        full[i, j] = full[j, i] = v
    ratio = np.linalg.inv(full) * Q.WIDEN / (shape.T @ shape + np.diag(np.square(Q.FLOOR)))
    assert 0.6 < np.diag(ratio).min() and np.diag(ratio).max() < 1.6
