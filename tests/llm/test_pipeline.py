"""The stages together, on odd tables, held against plain Python where a decision is plain."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from cohortile.llm.packing import Encoder

EXTRA = "_f long, _r string, label string, n string, id string, piece string"


def folder_with(spark, path, rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    made = [(i, t, lang, "s", len(t or ""), *[None if n == "_f" else "z" for n in names]) for i, t, lang in rows]
    spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (None, None, None), (2, "", "de"), (2, "12 !", "en")]])
def test_nothing_is_left_of_nothing(spark, tmp_path, rows):
    assert corpus_pipeline.run(spark, folder_with(spark, tmp_path / "in", rows)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = {"en": "the of and to in is that it was for on are with as his they be at this have from".split(),
             "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n)) + f" {rng.integers(10**9)}"
    rows = [(i, say(lang, 80), lang) for i, lang in enumerate(["en", "de"] * 40)]
    base = say("en", 300)
    rows += [(200, base, "en"), (201, base.upper(), "en"), (None, base, "en"), (202, base + " more", "en"), (203, "write to me@here.org now and then for the rest of it", "en")]
    rows += [(300, None, "en"), (301, "", "de"), (302, "77 !!", "en"), (303, "the " * 60_000, "en"), (204, rows[0][1], "en"), (204, rows[0][1], "en")]
    docs = spark.read.parquet(folder_with(spark, tmp_path / "in", rows) + "/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "in"))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
    plain = {r.doc_id for r in kept["language"].collect()}
    assert not plain & {300, 301, 302} and len(plain & set(range(80))) >= 76
    for name in list(kept)[:-1]:
        assert kept[name].columns == [c.split()[0] for c in "doc_id long, text string, lang string, source string, n_chars long".split(", ")] + [c.split()[0] for c in EXTRA.split(", ")]
    exact = kept["exact_dedup"].collect()
    assert len({(r.text or "").lower() for r in exact}) == len(exact)
    assert {r.doc_id for r in kept["near_dedup"].collect()} & {201, 202} == {201}
    clean = {r.doc_id: r for r in kept["pii"].collect()}
    assert "me@here.org" not in clean[203].text and "[EMAIL]" in clean[203].text and clean[203].n_chars == len(clean[203].text)
    encode, pieces = Encoder(), kept["packing"].collect()
    for i, r in clean.items():
        ids = encode(r.text or "") + np.array([2], "<u4").tobytes()
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert [(a, n, zlib.crc32(ids[4 * a:4 * (a + n)])) for a, n, _ in mine] == mine and sum(n for _, n, _ in mine) == len(ids) // 4
