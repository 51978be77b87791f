"""Exact duplicates against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kiln.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for t, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        out += [(k, best, len(keys), hashlib.sha256(t.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 30])
def test_groups_equal_plain_python(spark, max_bits):
    # a third of all rows is one text; at 2^15 bits the filter is small for 40,000 rows: more rows shuffle, same result
    n = 40_000 if max_bits == 1 << 15 else 3_000
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 5 == 0 else f"only {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = exact_dedup.group_copies(df, max_bits=max_bits)
    assert as_rows(out) == brute(rows)
    assert out.where("kept").count() == out.select("text_sha256").distinct().count()


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = exact_dedup.group_copies(awkward)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert as_rows(out) == brute(rows)
    assert out.where("kept").count() == out.select("text_sha256").distinct().count()
    assert exact_dedup.group_copies(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(4, "a")] * 5 + [(None, "b")] * 3 + [(1, None), (2, "")], "doc_id long, text string")
    out = exact_dedup.group_copies(df)
    assert sorted(((r["doc_id"], r["group_size"]) for r in out.where("kept").collect()), key=str) == sorted([(4, 5), (None, 3), (2, 2)], key=str)


def test_drop_copies_keeps_all_columns(awkward, documents):
    for docs in (awkward, documents):
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == docs.columns
        want = {}
        for r in docs.collect():
            if r["text"] not in (None, "") and (r["text"] not in want or (want[r["text"]] or -1) < (r["doc_id"] or -1)):
                want[r["text"]] = r["doc_id"]
        got = [(r["text"], r["doc_id"]) for r in kept.collect() if r["text"] not in (None, "")]
        assert dict(got) == want and len(got) == len(want)
        assert kept.where("coalesce(text, '') = ''").count() == min(1, docs.where("coalesce(text, '') = ''").count())


def test_normalised_texts(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    out = exact_dedup.group_copies(df, normalise=F.lower)
    assert {r["doc_id"]: r["keep_id"] for r in out.collect()} == {1: 2, 2: 2, 3: 3}


def test_single_rows_do_not_shuffle(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    marked = exact_dedup.possibly_repeated(rows, "d", 20_000)
    assert marked.where("_maybe").count() < 20_000 * 0.005
    twice = rows.unionByName(rows.limit(500))
    assert exact_dedup.possibly_repeated(twice, "d", 20_500).where("_maybe").count() >= 1000


def test_no_python_in_the_plan(documents):
    plan = exact_dedup.group_copies(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
