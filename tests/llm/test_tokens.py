import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kiln.llm import bpe, chunk_bpe, matrices, packing, pieces, token_count

BYTE, WORD = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")


def library(path, texts):
    return [e.ids for e in bpe.load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library_on_random_strings(path):
    rnd = random.Random(1)
    alpha = "ab'stremvlld  \n\t\r é1²½٣!?'’<|>endoftext́İΣς中文ー​\x1c\x85🙂"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    enc, want = bpe.Encoder(path), library(path, texts)
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert enc.count(texts).tolist() == [len(w) for w in want]


def test_chunked_encoding_equals_library(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "LEAST", 3)
    monkeypatch.setattr(chunk_bpe, "MASK_BITS", 2)
    rnd = random.Random(2)
    alpha = ["a", "b ", "'", "s", "t", "ll ", " ", "\n", "é", "É", "1", "²", "!?", "'re", "e", "́", "  ", "<|endoftext|>", "İ", "Σ"]
    texts = ["".join(rnd.choice(alpha[:15] if rnd.random() < .8 else alpha) for _ in range(rnd.randint(0, 120))) for _ in range(600)]
    assert sum(len(chunk_bpe.cut_points(t)) for t in texts) > 5 * len(texts)
    assert [x.tolist() for x in chunk_bpe.ChunkCoder(WORD, {}).encode(texts)] == library(WORD, texts)


def test_cut_points_follow_content():
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    a, b = "x" * 777 + passage, "another beginning " + passage
    chunks = lambda t: {t[i:j] for i, j in zip([0, *chunk_bpe.cut_points(t)], chunk_bpe.cut_points(t))}
    assert sum(map(len, chunks(a) & chunks(b))) > 15_000
    assert chunk_bpe.cut_points("") == [] and chunk_bpe.cut_points("a" * 50_000)[-1] == 50_000


def check_round_trip(df):
    got = Counter(map(tuple, chunk_bpe.encode_decode(df, WORD).collect()))
    lib, want = bpe.load(WORD), Counter()
    rows = rows_of(df)
    for (i, _), ids in zip(rows, library(WORD, [t for _, t in rows])):
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_round_trip(awkward, documents, nothing):
    check_round_trip(awkward)
    check_round_trip(documents.unionByName(documents.selectExpr("doc_id + 1000 AS doc_id", "concat('x y', text) AS text"), allowMissingColumns=True))
    assert chunk_bpe.encode_decode(nothing, WORD).collect() == []


def test_shared_dictionary_holds_repeated_chunks(documents):
    twice = documents.select("text").unionByName(documents.selectExpr("concat('some other start ', text) AS text"))
    shared = chunk_bpe.shared_chunks(twice, WORD)
    assert len(shared) > 50
    assert sum(e.size for e in chunk_bpe.shared_chunks(twice, WORD, most_chars=5000).values()) <= 5000


def test_token_counts(awkward, documents, nothing):
    for df in (awkward, documents):
        rows = rows_of(df)
        want = Counter((i, len((t or "").encode()), len(ids), len(ids) > 512) for (i, t), ids in zip(rows, library(BYTE, [t for _, t in rows])))
        assert Counter(map(tuple, token_count.count_tokens(df, BYTE).collect())) == want
    assert token_count.count_tokens(nothing, BYTE).collect() == []


def test_proven_strings_encode_alone():
    proven = token_count.prove_whole_tokens(BYTE)
    assert len(proven) > 40_000
    assert all(len(x) == 1 for x in library(BYTE, proven[::97]))


def check_packing(df, length=64):
    rows = rows_of(df)
    want = defaultdict(list)
    for (i, _), ids in zip(rows, library(BYTE, [t for _, t in rows])):
        ids = [*ids, 2]
        for k, (s, n) in enumerate(pieces.cut(len(ids), length)):
            want[(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()))].append(1)
    got = packing.pack(df, BYTE, length=length).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter({k: len(v) for k, v in want.items()})
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
    return len(by), -(-sum(r["length"] for r in got) // length)


def test_packing(awkward, documents, nothing):
    used, least = check_packing(awkward)
    assert used <= least + 2
    used, least = check_packing(documents.repartition(7), 1024)
    assert used <= least * 1.02 + 1
    assert packing.pack(nothing, BYTE).collect() == []


def test_cut():
    assert pieces.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and pieces.cut(8, 4) == [(0, 4), (4, 4)] and pieces.cut(3, 4) == [(0, 3)]


def fewest(lengths, cap):
    """Exact by trying every place for each piece, longest first."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            go(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        go(i + 1, rooms + [cap - lengths[i]])

    go(0, [])
    return best[0]


def test_fillings_of_any_number_of_pieces():
    """Planted full sequences of near-equal pieces, of which best-fit decreasing makes 3 to 6 % more."""
    rng = np.random.default_rng(0)
    for parts, spread, most in ((6, 20, 502), (8, 10, 502), (6, 40, 505)):
        hist = Counter()
        for _ in range(500):
            last = 0
            while abs(last - 1024 // parts) > 2 * spread:
                some = rng.integers(1024 // parts - spread, 1024 // parts + spread + 1, parts - 1)
                last = 1024 - int(some.sum())
            hist.update(some.tolist() + [last])
        plan = packing.bin_completion(dict(hist), 1024)
        held = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 1024
            held.update({k: times * c for k, c in Counter(pattern).items()})
        assert held == hist
        assert sum(m for _, m in plan) <= most < sum(m for _, m in packing.best_fit_decreasing(dict(hist), 1024))


def test_fullest_filling_is_the_largest_sum():
    rng = np.random.default_rng(1)
    for _ in range(60):
        hist = dict(Counter(rng.integers(1, 30, 12).tolist()))
        sums = {0}
        for k, c in hist.items():
            sums = {s + k * t for s in sums for t in range(c + 1)}
        for room in (5, 31, 60):
            best = max(s for s in sums if s <= room)
            for longest in (True, False):
                got = packing.fullest(hist, room, longest)
                assert sum(got) == best and all(got.count(k) <= hist[k] for k in got)


def test_bin_completion_is_near_the_optimum():
    rnd = random.Random(4)
    extra = 0
    for _ in range(150):
        cap = rnd.choice([10, 20, 50])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 11))]
        hist = Counter(lengths)
        for plan in (packing.bin_completion(hist, cap), packing.best_fit_decreasing(hist, cap)):
            held = Counter()
            for pattern, times in plan:
                assert sum(pattern) <= cap
                for k in pattern:
                    held[k] += times
            assert held == hist
        best = fewest(lengths, cap) if lengths else 0
        assert packing.lower_bound(hist, cap) <= best
        assert sum(m for _, m in packing.bin_completion(hist, cap)) <= sum(m for _, m in packing.best_fit_decreasing(hist, cap))
        extra += sum(m for _, m in packing.bin_completion(hist, cap)) - best
    assert extra <= 3


def test_segment_tree_gives_the_tightest_room():
    rnd = random.Random(5)
    tree, rooms = matrices.CapacityTree(100), {}
    for k in range(400):
        if rnd.random() < .6 or not rooms:
            r = rnd.randint(0, 100)
            tree.add(r, k)
            rooms[k] = r
        else:
            need = rnd.randint(0, 100)
            hit, fit = tree.best(need), [r for r in rooms.values() if r >= need]
            if not fit:
                assert hit is None
            else:
                assert hit[0] == min(fit) == rooms.pop(hit[1])


def check_matrix(df, **kw):
    length = kw["length"]
    rows = rows_of(df)
    want = Counter()
    for (i, _), ids in zip(rows, library(BYTE, [t for _, t in rows])):
        ids = [*ids, 50256]
        for k, (s, n) in enumerate(pieces.cut(len(ids), length)):
            want[(i, k, tuple(ids[s:s + n]))] += 1
    got, keys = Counter(), set()
    for r in matrices.token_matrix(df, BYTE, **kw).collect():
        keys.add((r["part"], r["shard"], r["sequence"]))
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length
        assert (ids[cu[-1]:] == 50256).all() and len(cu) - 1 == r["n_segments"]
        for a, b, d, k in zip(cu, cu[1:], r["doc_ids"], r["pieces"]):
            assert pos[a:b].tolist() == list(range(b - a))
            got[(d, k, tuple(ids[a:b].tolist()))] += 1
    assert got == want and len(keys) == sum(1 for _ in keys)


def test_matrices(awkward, documents, nothing, tmp_path):
    check_matrix(awkward, length=64, shard_tokens=500)
    check_matrix(documents, length=1024)
    assert matrices.token_matrix(nothing, BYTE).collect() == []
    m = matrices.token_matrix(documents, BYTE)
    matrices.write_matrices(m, str(tmp_path / "m"))
    assert documents.sparkSession.read.parquet(str(tmp_path / "m")).count() == m.count()
