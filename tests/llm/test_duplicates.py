"""SimHash and embedding near duplicates, components, and top-k search against brute force."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plumbline.llm import frames, simhash, topk, vector_dedup


def roots_by_hand(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "Ä É straße x", "a\x1cb c d e f", "word " * 5000, "x" * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("parts", [2, 4])
def test_anchors_bring_all_near_fingerprints_together(parts):
    draw = np.random.default_rng(parts)
    base = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, 3, replace=False)) for _ in base], np.uint64)
    prints = np.concatenate([base, base ^ flips])
    row, anchor, home = simhash.anchors_of(prints, parts, 3)
    at = {(int(r), int(a)) for r, a in zip(row, anchor)}
    own = {int(r): int(a) for r, a, h in zip(row, anchor, home) if h}
    assert len(own) == len(prints)
    for i in range(len(base)):
        j = i + len(base)
        assert (j, own[i]) in at or (i, own[j]) in at


def test_code_words_are_far_apart():
    for bits in (8, 16, 32):
        words = simhash.code_words(bits)
        assert len(set(words.tolist())) == 2 * bits
        assert min(bin(int(a) ^ int(b)).count("1") for a, b in itertools.combinations(words, 2)) == bits // 2


@pytest.mark.parametrize("limit", [2048, 7])
def test_linked_fingerprints_are_all_found(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", limit)
    draw = np.random.default_rng(3)
    prints = set(draw.integers(0, 1 << 63, 150, dtype=np.uint64).tolist())
    for p in list(prints)[:40]:
        for _ in range(3):
            for b in draw.choice(64, draw.integers(1, 5), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [int(np.array(p, np.uint64).astype(np.int64)) for p in prints]
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    want = roots_by_hand(signed, links)
    settled = frames.settle(spark.createDataFrame([(s,) for s in signed], "node long"))
    got = {r.node: r.root for r in simhash.linked_fingerprints(settled).collect()}
    assert {n: got.get(n, n) for n in signed} == want and len(links) > 60


def test_near_duplicates_of_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "other", *words[201:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, None), (8, ""), (7, " \n"), (None, " ".join(words)), (5, " ".join(words)), (1, "quite another text here"), (None, "alone and without id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, mark int")
    prints = {t: plain_fingerprint(t) for _, t in rows}
    links = [(a, b) for a, b in itertools.combinations(set(prints.values()), 2) if bin(a ^ b).count("1") <= 3]
    group = roots_by_hand(set(prints.values()), links)
    least = {}
    for i, t in rows:
        if i is not None:
            g = group[prints[t]]
            least[g] = min(least.get(g, i), i)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r.doc_id or 0), r.fingerprint % 2**64, r.component_id or 0) for r in got) == sorted(((i or 0), prints[t], least.get(group[prints[t]], 0)) for i, t in rows)
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len(set(group.values())) and {r.doc_id for r in kept} == {*least.values(), None}
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint", "mark"}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    links += [(3001, 3000), (3000, 3001), (4000, 4000), (None, 5), (6, None)]
    got = {r.node: r.root for r in frames.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == roots_by_hand({n for e in real for n in e}, real)
    assert frames.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_splits_bring_every_home_to_every_row_once(spark):
    rows = [(1, i, i % 3 == 0) for i in range(50)] + [(2, i, True) for i in range(3)]
    out = frames.with_splits(spark.createDataFrame(rows, "key int, id long, home boolean"), ["key"], frames.F.col("id"), 8).collect()
    met = {}
    for block in {(r.key, r.part_a, r.part_b) for r in out}:
        inside = [r for r in out if (r.key, r.part_a, r.part_b) == block]
        for h in inside:
            for r in inside:
                if h.role > 0 and r.role != 1:
                    pair = (block[0], h.id, r.id)
                    met[pair] = met.get(pair, 0) + 1
    assert met == {(k, a, b): 1 for k, a, home in rows if home for k2, b, _ in rows if k2 == k}


def cosine(a, b):
    return float(np.dot(a, b) / (math.sqrt(np.dot(a, a)) * math.sqrt(np.dot(b, b))))


@pytest.mark.parametrize("limit", [1024, 9])
def test_near_vectors(spark, monkeypatch, limit):
    monkeypatch.setattr(vector_dedup, "PIVOT_ROWS", limit)
    draw = np.random.default_rng(limit)
    base = draw.normal(size=(12, 16))
    vectors = [b + draw.normal(size=16) * draw.choice([0.02, 0.06, 0.12, 0.3]) for b in base for _ in range(8)]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(200 + i, rows[4][1], 0) for i in range(20)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [1.0, None] * 8, 0), (304, [math.nan] * 16, 0), (305, [math.inf] * 16, 0)]
    rows += [(306, rows[4][1], None), (307, rows[4][1], None), (308, [1.0, 2.0], 0), (309, [2.0, 4.0], 0), (310, [x * 1e200 for x in rows[4][1]], 0), (4, rows[4][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    links, n = [], [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = (np.array(v) / max(map(abs, v)) for v in (a[1], b[1]))
            if cosine(x, y) >= 0.98:
                links.append((a[0], b[0]))
                n[i] += 1
                n[j] += 1
    root = roots_by_hand({r[0] for r in rows}, links)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect())
    assert got == sorted((r[0], n[i], root[r[0]], root[r[0]] == r[0]) for i, r in enumerate(rows)) and len(links) > 200
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "DATA_LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_LEAF", 4)
    monkeypatch.setattr(topk, "CHUNK", 3)
    draw = np.random.default_rng(0)
    vectors = np.concatenate([draw.normal(size=(300, 8)), np.repeat(draw.normal(size=(2, 8)), 40, axis=0)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [math.nan] * 8), (1003, [None] * 8), (1004, [0.0] * 8), (None, [1.0] * 8), (1020, [1.0, 2.0]), (1005, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_products(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_products(df.limit(0), df.limit(0), k=5).count() == 0


def test_products_beyond_32_and_64_bits(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e8, 1.0]), (3, [9e7, 1.0]), (4, [-2.5e9, 7.0]), (5, [2.5e9 + 0.25, -1e9]), (6, [1e8, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_products(df, df, 5).collect()}
    whole = {i: [math.floor(64 * c) for c in x] for i, x in rows}
    for q, x in whole.items():
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole.items() if i != q)
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert got[1, 1][1] == 64 * math.floor(64 * (2.5e9 + 0.25)) and got[1, 2] == (2, 409600000000)
    for bad in ([1e18, 1e18], [3e17, 1.0]):
        large = spark.createDataFrame([(1, bad), (2, [1e18, 1.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_products(large, large, 1).collect()


def test_bounds_leave_out_far_blocks():
    draw = np.random.default_rng(1)
    x = np.floor(np.concatenate([draw.normal(size=(400, 6)) * 3 + 100, draw.normal(size=(4000, 6)) * 3 - 100]))
    order, spans, balls = topk.cover_tree(x, 64)
    assert sorted(order.tolist()) == list(range(len(x)))
    for (low, high, child, count), ball in zip(spans.tolist(), balls):
        assert (np.sqrt(((x[order[low:high]] - ball[:-1]) ** 2).sum(1)) <= ball[-1]).all()
        assert not count or (spans[child : child + count, 1] - spans[child : child + count, 0]).sum() == high - low
    pack = lambda v, ids, tree: topk.Block(ids.astype("<i8").tobytes(), v[tree[0]].astype("<i4").tobytes(), tree[1].astype("<i4").tobytes(), tree[2].tobytes(), 6)
    data = pack(x, np.arange(len(x))[order], (order, spans, balls))
    asked = x[:20]
    tree = topk.cover_tree(asked, 4)
    best = topk.Best(np.arange(20)[tree[0]], 5)
    offered = []
    plain = best.offer
    best.offer = lambda low, ids, scores: (offered.append(scores.size), plain(low, ids, scores))
    topk.search(pack(asked, np.arange(20)[tree[0]], tree), data, best)
    assert sum(offered) < 20 * len(x) / 4


def test_groups_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 AS k", "id")
        out = frames.whole_groups(df, ["k"], lambda g: pa.table({"k": g.column("k")[:1], "n": [g.num_rows]}), "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in out) == [(0, 34), (1, 33), (2, 33)]
