"""Ranked lexical search against brute force, on ties, odd rows and small blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortile.llm import lexical_search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
EXTRA = "item_id string, terms string, n string, score string, rank string, _f string, id string"


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c) in enumerate(held):
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score:
                scores.append((-score, i is None, i or 0, at))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def docs_frame(spark, rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"doc_id long, text string, {EXTRA}")


def made(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(rng.randrange(n), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for _ in range(n)]
    rows += [(1000 + i, "w1 w2 copies Of w3, one TEXT") for i in range(n // 2)]  # ties over a third of all rows
    rows += [(None, "w1 w2 copies"), (None, "w1 w2 copies"), (7, None), (8, ""), (9, " .,;"), (10, "ÜNDER ünder w5"), (11, "w5 " * 50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(20)]
    items += [(30, "copies of one text"), (30, "copies of one text"), (31, None), (32, ""), (None, "ünder W5"), (33, "absent words only"), (34, "w1")]
    return rows, items


@pytest.mark.parametrize("most,docs_a_block", [(32 << 20, 4096), (9000, 37)])
def test_ranks_equal_brute_force(spark, monkeypatch, most, docs_a_block):
    rows, items = made()
    benchmark = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", docs_a_block)
    got = lexical_search.ranked(docs_frame(spark, rows), benchmark, most=most).collect()
    assert sorted(((r.item_id, r["rank"], r.id, r.score) for r in got), key=str) == brute(rows, items)


def test_reads_end_early_and_stay_exact():
    rng = np.random.default_rng(2)
    n_docs, n_terms = 3000, 12
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(n_docs), np.arange(n_terms)))
    keep = rng.random(len(doc)) < 0.3
    doc, term = doc[keep], term[keep]
    impact = rng.integers(1, 1000, len(doc)) * np.array([1000 if t < 3 else 5 for t in term])
    lists = lexical_search.Lists(doc, term, impact, n_docs, n_terms)
    total = np.zeros(n_docs, np.int64)
    np.add.at(total, doc, impact)
    bar = np.sort(total)[-50]
    for first in (1, 64, 10**6):
        found, score = lexical_search.search(lists, np.arange(n_terms), first_read=first)
        best = found[score >= bar]
        assert sorted(best) == sorted(np.flatnonzero(total >= bar)) and (score == total[found]).all()
    assert len(lexical_search.search(lists, np.arange(n_terms), least=int(total.max()) + 1)[0]) == 0


def test_empty_tables(spark):
    rows, items = made(n=20)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.ranked(docs_frame(spark, []), benchmark).count() == 0
    assert lexical_search.ranked(docs_frame(spark, rows), benchmark.limit(0)).count() == 0
    assert lexical_search.ranked(docs_frame(spark, [(1, None), (2, " ")]), benchmark).count() == 0
