"""Lexical search against plain Python scores."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from kiln.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [] if text is None else TERM.findall(text.translate(SMALL))


def brute(docs, items, k=10):
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, e[3], -e[0]) for i, e in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string").repartition(3))


def random_tables(seed, n=900):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "中文", "x1", "UPPER", "upper"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    weights /= weights.sum()

    def text(lo, hi):
        return rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocabulary, int(rng.integers(lo, hi)), p=weights))

    docs = [(i, text(0, 40)) for i in range(n)]
    docs += [(n + i, "w1 w2 w59 hot") for i in range(n // 2)]  # a third of all rows: one text, one stratum, equal scores
    items = [(i, text(1, 25)) for i in range(40)] + [(50, "hot w59"), (51, None), (52, ""), (53, "nowhere"), (54, "w0 w0 w0")]
    return docs, items


@pytest.mark.parametrize("segment,block_pairs", [(4096, 1 << 16), (64, 1 << 16), (16, 60)])
def test_equals_plain_scores(spark, segment, block_pairs):
    docs, items = random_tables(segment)
    d, i = frames(spark, docs, items)
    assert got(ls.search(d, i, segment=segment, block_pairs=block_pairs)) == brute(docs, items)


def test_small_k_and_one_document(spark):
    docs, items = random_tables(3, 100)
    d, i = frames(spark, docs, items)
    assert got(ls.search(d, i, k=1, segment=8)) == brute(docs, items, 1)
    d, i = frames(spark, [(7, "a b")], [(1, "a"), (1, "B a")])
    assert got(ls.search(d, i)) == brute([(7, "a b")], [(1, "a"), (1, "B a")])


def test_awkward_tables(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(1, "one two THREE"), (None, "secret token"), (2, None), (2, "word word"), (3, "É 中文 ½ 🙂"), (3, "I've don't")]
    i = spark.createDataFrame([(*x, "clash", "c") for x in items], "item_id long, text string, q string, doc_id string")
    assert got(ls.search(awkward, i)) == brute(docs, items)
    assert ls.search(nothing, i).count() == 0 and ls.search(awkward, i.limit(0)).count() == 0
    assert ls.search(nothing, i).columns == ["item_id", "rank", "doc_id", "score"]


def test_text_ids(spark):
    docs, items = random_tables(4, 60)
    d = spark.createDataFrame([(f"d{a:04d}", t) for a, t in docs], "doc_id string, text string")
    _, i = frames(spark, docs, items)
    want = sorted(((a, r, f"d{k:04d}", s) for a, r, k, s in brute(docs, items)), key=str)
    assert got(ls.search(d, i, segment=16)) == want


def test_terms_are_those_of_the_pattern():
    for text in ["".join(map(chr, range(0x0, 0x250))), "a\x85b\xa0c d", "A_b.C`d{e}", "İ Straße"]:
        assert [t.decode() for t in ls.terms_of(text.encode())] == terms(text)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q = ls.Queries([(j, f"t{t}".encode(), int(rng.integers(1, 4))) for j in range(5) for t in rng.choice(20, 6, replace=False)])
    q.weigh(rng.integers(0, 9000, len(q.vocabulary)))
    held = sorted({(int(rng.integers(len(q.vocabulary))), int(rng.integers(1, 5)), int(rng.integers(8))) for _ in range(60)})
    held = [h for i, h in enumerate(held) if (h[0], h[2]) not in {(a, c) for a, _, c in held[:i]}]
    runs = sorted({(t, f) for t, f, _ in held})
    seg = {"m": 90, "size": 8, "run_term": np.array([t for t, _ in runs]), "run_tf": np.array([f for _, f in runs]),
           "run_len": np.array([sum((a, b) == r for a, b, _ in held) for r in runs]), "post": np.array([d for r in runs for a, b, d in held if (a, b) == r])}
    top = {t: max(f for a, f in runs if a == t) for t, _ in runs}
    bounds = q.bounds(np.array(list(top)), ls.impact(np.array(list(top.values())), 90))
    scores = q.scores(seg, np.arange(5))
    assert (scores.max(axis=1) <= bounds).all()
    for j in range(5):
        for d in range(8):
            want = sum(int(w) * int(ls.impact(f, 90)) for t, a, w in zip(q.term, q.query, q.weighted) if a == j for x, f, e in held if x == t and e == d)
            assert scores[j, d] == want
