"""Packing, archives, shards and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortile.llm import packing, sharding, warc
from cohortile.llm.common import table
from cohortile.session import run_dir
from test_dedup import near_brute

SMALL = "/root/testdata/sf0.001"


def test_ids_equal_the_tokenizers_file():
    encode, rng = packing.Encoder(), random.Random(3)
    texts = ["", " ", "a  b", "a   b\n  c \n d", " \t y  ", "é ' s it's  'll", "<|endoftext|> x", "1 22  333 ", "a\x1c b"]
    texts += ["".join(rng.choice(" \n\tab'1é.  \x1c\x85s") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.whole.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_length_once_and_finds_complements():
    rng = random.Random(4)
    assert packing.plan({}) == [] and packing.plan({1024: 3}) == [((1024,), 3)]
    assert packing.plan({1000: 5, 24: 5}) == [((1000, 24), 5)]
    assert [sum(x) for x, _ in packing.plan({900: 1, 100: 1, 20: 1, 4: 1})] == [1024]
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        made, used = packing.plan(counts, 64), Counter()
        for lengths, times in made:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += times
        assert used == Counter(counts)


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    return len(by)


def test_pieces_and_sequences(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x"), (4, "word " * 500), (5, "a b c d e f g h")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, place int")
    got = packing.pack(docs, capacity=64).collect()
    check_packed(got, 64)
    encode = packing.Encoder()
    for doc_id, text in set(rows):
        ids = np.append(np.frombuffer(encode(text or ""), "<u4"), 2)
        pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == doc_id)
        assert len(pieces) % (-(-len(ids) // 64)) == 0 and all(n == 64 for p, _, n in pieces if p) and pieces[-1][1] + pieces[-1][2] == len(ids)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_is_near_the_bound(spark):
    got = packing.op2_packing(spark, "/root/testdata/sf0.01").collect()
    assert check_packed(got, 1024) <= 1.01 * -(-sum(r.length for r in got) // 1024)


def test_archives(spark):
    x = "h" * 150
    rows = [(1, "u v\n", x), (2, None, x), (3, "a", "short"), (4, "b", "short"), (5, "c", None), (None, "d", x), (2, "e", x),
            (7, "f", "\r\n\r\nWARC/1.1\r\n" + "é" * 100), (8, "g", "y" * 200_000), (6, "g", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "p", 5) for r in rows], "page_id long, url string, html string, payload string, of_f int")
    path = run_dir(spark, "warc-test")
    warc.deduplicated(pages, path)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_resolved(spark, path).collect())
    assert got == sorted([(1, 150, "response", None), (2, 150, "revisit", 1), (2, 150, "revisit", 1), (0, 150, "revisit", 1), (3, 5, "response", None),
                          (4, 5, "response", None), (5, 0, "response", None), (7, 214, "response", None), (6, 200_000, "response", None),
                          (8, 200_000, "revisit", 6)], key=lambda r: (r[0], r[1], r[2], r[3] or 0))
    urls = {r.url for r in warc.read_headers(spark, path).collect()}
    assert b"u%20v%0A" in {bytes(u) for u in urls if u is not None}


def test_archive_of_nothing_and_of_many_members(spark):
    import gzip

    path = run_dir(spark, "warc-test")
    warc.deduplicated(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_resolved(spark, path).count() == 0
    one = lambda i: gzip.compress(warc.record(1, i, i, b"u", b"x" * 100_000, b"\0" * 32) + b"\r\n\r\n")
    assert [len(p) for _, _, p in warc.parse(b"".join(one(i) for i in range(5)))] == [100_000] * 5 and list(warc.parse(b"")) == []


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rows = [(i, f"text {i % 300}" if not hot or i % 3 else "hot") for i in range(2003)] + [(None, None), (7, ""), (7, "text 7")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, shard int, slot string")
    placed = sharding.shard_rows(sharding.documents_by_text(docs))
    got = placed.collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    cut = sharding.cut_links(placed).first()
    scattered = sharding.cut_links(placed.withColumn("shard", F.pmod(F.xxhash64("_f", "_r"), F.lit(16)))).first()
    if hot:  # a group of a third of all rows fills five of sixteen shards at best
        best = scattered.cut - (scattered.links - 5.3 * (len(rows) / 16) ** 2 / 2)
        assert scattered.cut - cut.cut > 0.9 * best > 0
    else:
        assert cut.cut < 0.1 * scattered.cut


def test_pairs_beside_a_group_of_a_third_stay_together(spark):
    rows = [(i, f"pair {i // 2}") for i in range(8000)] + [(8000 + i, "hot") for i in range(4000)]
    placed = sharding.shard_rows(sharding.documents_by_text(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    hot = {r.shard for r in placed if r.doc_id >= 8000}
    at = {r.doc_id: r.shard for r in placed}
    assert Counter(at.values()) == Counter({s: 750 for s in range(16)})
    assert len(hot) <= 7 and sum(at[i] != at[i + 1] for i in range(0, 8000, 2)) < 0.05 * 4000


def test_shards_of_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    got = sharding.shard_rows(sharding.documents_by_text(docs)).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3 and all(r.slot == 0 for r in got)
    assert sharding.shard_rows(sharding.documents_by_text(docs.limit(0))).count() == 0


def test_quotas_keep_capacity():
    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes, wanted = rng.integers(50, 100, 8).astype(float), rng.integers(0, 30, (8, 8)).astype(float)
        np.fill_diagonal(wanted, 0)
        wanted = np.minimum(wanted, sizes[:, None] / 8)
        moved = sharding.quotas(sizes, wanted, 100)
        assert (moved <= wanted + 1e-9).all() and (sizes - moved.sum(axis=1) + moved.sum(axis=0) <= 101.5).all()


def test_pipeline_stages_against_plain_python(spark):
    docs = table(spark, SMALL, "documents")
    extra = docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.upper("text"))
    docs = docs.unionByName(extra).unionByName(spark.createDataFrame([(20_000, None, "en", "s", 0), (None, "", "en", "s", 0)], docs.schema))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, SMALL)
    assert told.columns == columns and told.count() >= 0.97 * docs.count() and told.filter("text IS NULL OR text = ''").count() == 0
    rows = [(r.doc_id, r.text) for r in told.collect()]
    best = {}
    for i, t in rows:
        best[t.encode().lower()] = max(i, best.get(t.encode().lower(), i))
    once = stages["exact_dedup"](spark, told, SMALL)
    kept = {r.doc_id: r.text for r in once.collect()}
    assert once.columns == columns and sorted(kept) == sorted(best.values())
    near = stages["near_dedup"](spark, once, SMALL)
    want = {c for _, _, c in near_brute(sorted(kept.items()), 5)}
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == sorted(want)
    clean = stages["pii"](spark, near, SMALL)
    assert clean.columns == columns and clean.count() == len(want) and clean.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]com'").count() == 0
    packed = stages["packing"](spark, clean, SMALL).collect()
    assert {r.doc_id for r in packed} == want and check_packed(packed, 1024)
