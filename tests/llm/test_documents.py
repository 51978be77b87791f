import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kiln.llm import bpe, fingerprint, hashed, jaccard, language, pu_quality, quality_rules, secrets, trie
from kiln.llm.components import components, key_filter, passes
from kiln.llm.textcore import Words, string_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = bpe.vocabulary("byte_bpe_50k.tiktoken")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# -- secrets
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_spans_on_random_strings():
    rnd = random.Random(3)
    parts = ["token", "PASSWORD", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef0123", "é", "xyz", "secret=", "ſecret=abcdefg", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    found = secrets.scan_texts(pa.array(texts, pa.large_string()), VOCAB)
    for i, t in enumerate(texts):
        assert [x for x in found.get(i, []) if x[1] < 3] == base_spans(t), t


def test_token_efficiency():
    texts = ["the key is xK9mP2qR7vL4nT8wZ3bJ6 here", "https://example.com/some/long/path_to-file", "getUserAccountInformationByName2",
             "4d44c79e-8bf7-c557-59c4-958dd60ed83d", "D41D8CD98F00B204E9800998ECF8427E", "12345678901234567890123", "einlicheundungverzuberlich"]
    found = secrets.scan_texts(pa.array(texts, pa.large_string()), VOCAB)
    assert [(a, b) for a, k, b in found[0] if k == 3] == [(11, 32)]
    assert not any(k == 3 for i in range(1, len(texts)) for _, k, _ in found.get(i, []))


def test_secret_scan(awkward, documents, nothing):
    for df in (awkward, documents):
        want = collections.Counter()
        for i, t in rows_of(df):
            spans = base_spans(t or "")
            text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            want[(i, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
        got = secrets.scan(df, VOCAB).collect()
        assert collections.Counter((r[0], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    assert secrets.scan(nothing, VOCAB).collect() == []


def test_redaction(awkward, nothing):
    out = secrets.redact(awkward, VOCAB)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    masked = {r["doc_id"]: r for r in out.collect()}
    assert masked[10]["text"] == "[SECRET]\" and [SECRET], [SECRET]" and masked[10]["n_chars"] == len(masked[10]["text"])
    assert masked[0]["text"] is None
    assert not secrets.scan(out, VOCAB).where("n_hex + n_access + n_assign + n_random > 0").count()
    assert secrets.redact(nothing, VOCAB).collect() == []


# -- quality
def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_rules(awkward, documents, labels, nothing):
    model = quality_rules.train(documents, labels)
    for df in (awkward, documents):
        want = collections.Counter((i, *(s := statistics(t)), s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t in rows_of(df))
        got = quality_rules.score(df, model).collect()
        assert collections.Counter((r[0], *(r[s] for s in quality_rules.STATS), r["base_failed"]) for r in got) == want
        assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD) for r in got)
        assert quality_rules.keep(df, model).count() == sum(r["kept"] for r in got)
    assert quality_rules.score(nothing, model).collect() == [] and quality_rules.keep(nothing, model).columns == nothing.columns
    empty = quality_rules.train(nothing, labels.limit(0))
    assert quality_rules.score(documents, empty).count() == documents.count()


def test_quality_rules_held_out_accuracy(spark):
    from kiln.llm.common import fold
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rules.train(docs, labels.where(fold("doc_id", 4) != 0))
    got = quality_rules.score(docs, model).join(labels.where(fold("doc_id", 4) == 0), "doc_id").toPandas()
    assert ((got["score"] >= quality_rules.THRESHOLD) == (got["quality"] == 1)).mean() > 0.93


def test_positive_unlabelled(spark, awkward, nothing, labels):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = pu_quality.train(docs, known)
    got = pu_quality.score(docs, model)
    held = got.where("held_out").join(known, "doc_id").toPandas()
    assert ((held["predicted"]) == held["quality"]).mean() > 0.9
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0
    # labels of held-out rows have no influence
    other = known.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.allclose(pu_quality.train(docs, other).w, model.w)
    assert pu_quality.score(awkward, model).count() == awkward.count()
    assert pu_quality.score(nothing, model).collect() == []
    blank = pu_quality.train(nothing, labels.limit(0))
    assert {r["score"] for r in pu_quality.score(awkward, blank).collect()} == {0.5}


def test_byte_grams_stay_inside_texts():
    texts = ["abcd", "", "ab", "abcdef", "xyz"]
    w = Words(string_array(pa.array(texts)))
    for n in (2, 3):
        g, cut = hashed.byte_grams(w.bytes, w.off, n)
        names = {}
        for t, (a, b) in zip(texts, zip(cut, cut[1:])):
            want = [t[i:i + n] for i in range(len(t) - n + 1)]
            assert b - a == len(want)
            for x, h in zip(want, g[a:b].tolist()):
                assert names.setdefault(x, h) == h
        assert len(set(names.values())) == len(names)


# -- language
def test_language(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got["held_out"]]["lang"] == got[got["held_out"]]["lang_pred"]).mean() > 0.97
    assert got["rejected"].mean() < 0.01
    for r, (_, t) in zip(language.predict(awkward, model).collect(), rows_of(awkward)):
        letters = any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["rejected"])
    assert language.predict(nothing, model).collect() == []
    assert language.keep(docs, model).count() == (~got["rejected"]).sum()
    assert {r["lang_pred"] for r in language.predict(docs, language.train(nothing)).collect()} <= {"und"}


# -- fingerprints
def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        m = len(t) // 3
        yield i, t, nxt, t[:len(t) - m] + nxt[:m]


@pytest.mark.parametrize("span", [3, 4000])
def test_edited_likeness(documents, awkward, span):
    some = awkward.where("doc_id IS NOT NULL AND doc_id <> 5")
    for df in (documents, some):
        got = {r["doc_id"]: r for r in fingerprint.edited_likeness(df, rows_per_range=span).collect()}
        assert len(got) == df.count()
        jac = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        for i, t, nxt, e in edited(rows_of(df)):
            r = got[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
            assert abs(r["near_edited"] - jac(shingles(t), shingles(e))) < 0.15
            assert abs(r["near_next"] - jac(shingles(t), shingles(nxt))) < 0.15
        prints = collections.defaultdict(set)
        for i, t in rows_of(df):
            prints[t or ""].add(got[i]["fingerprint"])
        assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_of_odd_tables(awkward, nothing, spark):
    assert fingerprint.edited_likeness(awkward, rows_per_range=4).count() == awkward.count()
    assert fingerprint.edited_likeness(nothing).collect() == []
    one = fingerprint.edited_likeness(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(0)
    a, b = (np.unique(rnd.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    b = np.unique(np.concatenate([rnd.permutation(a)[:3000], rnd.permutation(b)[:3000]]))
    sa, sb = a[:256], b[:256]
    assert (fingerprint.merge(sa, sb) == np.union1d(a, b)[:256]).all()
    assert abs(fingerprint.distinct(sa) / len(a) - 1) < 0.25
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fingerprint.resemblance(sa, sb) - true) < 0.12
    assert abs(fingerprint.containment(sa, sb) - len(np.intersect1d(a, b)) / len(a)) < 0.2
    assert (fingerprint.decode(fingerprint.encode(sa)) == sa).all()


# -- Jaccard join
def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault((i, t), shingles(t))
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for k in keys:
        if k[0] is not None:
            low[root(k)] = min(low.get(root(k), k[0]), k[0])
    return collections.Counter((i, len(sets[(i, t)]), low.get(root((i, t))) if sets[(i, t)] else i) for i, t in rows)


def near_copies(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(1, 60))] for _ in range(6)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 50)}"
        rows.append((i, " ".join(w + (passage if i % 2 else []))))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_join(awkward, documents, nothing):
    for df in (awkward, documents):
        assert collections.Counter(map(tuple, jaccard.link_components(df).collect())) == brute(rows_of(df))
    assert jaccard.link_components(nothing).collect() == []


def test_jaccard_join_of_hot_shingles_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 5)
    monkeypatch.setattr(jaccard, "HOT_LOCAL", 2)
    monkeypatch.setattr(jaccard, "HUBS", 3)
    df = near_copies(spark).repartition(3)
    assert collections.Counter(map(tuple, jaccard.link_components(df, group=4).collect())) == brute(rows_of(df))


def test_keep_one(awkward, documents, spark):
    for df in (documents, near_copies(spark)):
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows_of(df))})
    ids = collections.Counter(r["doc_id"] for r in jaccard.keep_one(awkward).collect())
    assert ids[None] == 2 and ids[5] == 1 and ids[16] == 1 and 17 not in ids and 18 not in ids and 20 not in ids


def test_trie_join_of_random_sets():
    rnd = random.Random(5)
    for _ in range(60):
        base = [set(rnd.sample(range(60), rnd.randint(1, 25))) for _ in range(4)]
        sets = {}
        for _ in range(rnd.randint(0, 30)):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                s.discard(rnd.choice(sorted(s))) if len(s) > 1 and rnd.random() < .5 else s.add(rnd.randint(0, 80))
            x = np.array(sorted(s), np.uint64) * np.uint64(7919)
            sets[x.tobytes()] = x
        sets = list(sets.values())
        want = {(j, i) for i in range(len(sets)) for j in range(i)
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        links, label = trie.join_block(sets, every_link=True)
        assert {(min(p), max(p)) for p in links} == want
        assert (trie.join_block(sets)[1] == label).all()


def test_components_and_key_filter(spark):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent}
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    bitmap = spark.sparkContext.broadcast(key_filter(keys, "k"))
    hit = {r["k"] for r in spark.range(10_000).withColumnRenamed("id", "k").where(passes(bitmap, "k")).collect()}
    assert set(range(0, 5000, 7)) <= hit and len(hit) < 730
