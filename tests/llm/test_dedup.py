"""Exact and near duplicates of texts and vectors against brute force, with the odd cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.llm import embedding_dedup, exact_dedup, near_dedup
from cohortile.llm.components import components

ODD = [(1, "Same Text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "SAME TEXT"), (5, "Ünder"), (6, "ünder"),
       (7, "x" * 50_000), (8, "x" * 50_000), (9, "x" * 49_999 + "y"), (10, " same text")]


def frame(spark, rows, extra="name string, level string, _f string, kept string, label string"):
    names = [c.split()[0] for c in extra.split(", ")]
    return spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"doc_id long, text string, {extra}")


def lowered(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("handle", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_exact_groups(spark, handle):
    got = exact_dedup.exact_dedup(frame(spark, ODD), block_bytes=1000, handle=handle).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(lowered(t), []).append(i)
    want = sorted((i is None, i or 0, max(x for x in groups[lowered(t)] if x is not None), len(groups[lowered(t)])) for i, t in ODD)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_drop_keeps_columns_and_empty_table(spark):
    docs = frame(spark, ODD)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({lowered(t) for _, t in ODD})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def shingles(t, k):
    ws = lowered(t).split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)])


def near_brute(rows, k):
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted((rows[i][0], len(sets[i]), min(least[root(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("how", [{}, {"stars": near_dedup.STARS[:1], "block": 4}])
def test_near_groups_equal_brute_force(spark, how):
    rng = random.Random(11)
    rows, n = [], 100
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 9))):
                other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
            rows.append((n, " ".join(other)))
            n += 1
    rows += [(1, "one"), (2, "ONE"), (3, "one two"), (4, "  one\ttwo\n"), (5, None), (6, " \x0b "), (7, ""), (8, "a a a a a a"), (9, "a a"),
             (10, "é x"), (11, "É x"), (12, "a\xa0b c"), (13, "a\xa0b c")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2, **how).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows, 2)
    assert sum(r.first for r in got) == len({r.component_id for r in got})


def test_near_drop_repeated_null_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, text), (1, text), (None, text), (None, text + " more"), (2, None), (2, None), (3, "other words here now then")])
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text is None) for r in left.collect()) == [(1, False), (2, True), (2, True), (3, False)]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    for j in (0.2, 0.5, 0.8, 0.95):
        both, n = rng.integers(0, 2**63, 3000, dtype=np.uint64), int(3000 * j)
        pairs = []
        for _ in range(20):
            common, own = rng.integers(1, 2**63, n, dtype=np.uint64), [rng.integers(1, 2**63, (len(both) - n) // 2, dtype=np.uint64) for _ in "ab"]
            sets = [np.sort(np.concatenate([common, x])) for x in own]
            regs = near_dedup.registers(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            size = np.array([len(sets[0])], float)
            pairs.append(near_dedup.estimate(regs[:1], regs[1:], size, size)[0])
        true = n / (n + 2 * ((3000 - n) // 2))
        assert abs(np.mean(pairs) - true) < 0.03


def test_components_of_a_star_a_chain_and_nothing(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(200)} == {0} and {got[1000 + i] for i in range(61)} == {1000} and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_brute(rows, least=0.93):
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [v is not None and len(v) > 0 and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    ids = {}
    for i in range(n):
        ids.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(ids[root(i)])) for i in range(n))


@pytest.mark.parametrize("block", [2048, 5])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            noise = rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.2, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in centre + noise], int(g % 3)))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, [], 1), (1005, rows[0][1], None),
             (1006, [float("inf")] * 16, 1), (1007, rows[0][1][:8], rows[0][2]), (1008, rows[0][1], rows[0][2]), (1009, rows[0][1], rows[0][2])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("n", F.lit(None))
    got = embedding_dedup.near_vectors(data, block=block).collect()
    want = vectors_brute(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want and sum(w[1] for w in want) > 50
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_empty(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
