"""Token counts and alignment of two tokenizers against the libraries, text by text, with the odd cases."""

import pytest

from cohortile.llm import alignment, token_counts, vocabularies

TEXTS = [None, "", " ", "plain words, don't  run\n\n on", "plain words, don't  run\n\n on", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>",
         "ünïcödé ½ ² ③ 日本語 ֋ ႔0 x", "tab\there   nbsp　wide", "x" * 200_000, "it's we'll 'S 123abc " * 20_000, "▁under <0x41> <s>", "é \u0000 zero"]


def frame(spark, rows, extra="piece string, n string, _f string, tokens string, docs string, at string"):
    names = [c.split()[0] for c in extra.split(", ")]
    return spark.createDataFrame([(*r, *["z"] * len(names)) for r in rows], f"doc_id long, text string, {extra}")


def rows_of(texts):
    return [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("most", [32 << 20, 600, 0])
def test_token_counts_equal_the_library(spark, most):
    rows = rows_of(TEXTS)
    got = token_counts.token_counts(frame(spark, rows), most=most).collect()
    whole = vocabularies.library(token_counts.VOCABULARY)
    want = [(i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=order) == sorted(want, key=order)


def test_token_counts_of_a_table_and_of_none(spark, folder):
    got = {r.doc_id: r for r in token_counts.op12_token_counts(spark, folder).collect()}
    whole = vocabularies.library(token_counts.VOCABULARY)
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        n = len(whole.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 1024)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_vocabularies_that_look_across_pre_tokens_are_refused():
    with pytest.raises(ValueError):
        token_counts.check_vocabulary("word_bpe_49k.json")


def token_bytes(text):
    """Tokens of both sides as (id, start, end), plainly from the libraries; none where bytes differ."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    sp = vocabularies.sentences("piece_bpe_32k.model")
    back = {c: b for b, c in enumerate(vocabularies.byte_alphabet())}
    if not text:
        return [], []
    sides = []
    got = whole.encode(" " + text, add_special_tokens=False)
    sides.append([(i, bytes(back[c] for c in t)) for i, t in zip(got.ids, got.tokens)])
    pieces = [(i, sp.id_to_piece(i)) for i in sp.encode(text)]
    sides.append([(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces])
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return [], []
    out = []
    for side in sides:
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute_alignment(texts):
    import hashlib
    from collections import Counter

    docs = []
    for text in texts:
        a, b = token_bytes(text)
        groups, lo = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append(([i for i, s, e in a if lo <= s and e <= end], [j for j, s, e in b if lo <= s and e <= end]))
            lo = end
        docs.append((len(a), len(b), groups, [(x, y) for g, h in groups for x in g for y in h]))
    held = Counter(p for d in docs for p in set(d[3]))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [32 << 20, 2000, 0])
def test_alignment_equals_brute_force(spark, most, monkeypatch):
    texts = [t if t is None or len(t) < 1000 else t[:700] for t in TEXTS] + ["ÄÖ ß漢字 mixed\tthings 12345678901234", "aaaaaaaaaaaaaaaaaaaaaaa bbb", "plain words"]
    got = alignment.aligned(frame(spark, rows_of(texts)), most=most).collect()
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = [(i, *r) for (i, _), r in zip(rows_of(texts), brute_alignment(texts))]
    assert sorted(((r.id, *(r[c] for c in COLUMNS)) for r in got), key=order) == sorted(want, key=order)


def test_links_in_parts_and_long_texts(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    left, right = (pd.DataFrame({"doc": np.zeros(400, np.int64), "id": rng.integers(0, 40, 400)}) for _ in range(2))
    group = np.sort(rng.integers(0, 5, 400))
    whole = [x.tolist() for x in alignment.linked(left, right, group, group)]
    monkeypatch.setattr(alignment, "PAIRS", 7)
    assert [x.tolist() for x in alignment.linked(left, right, group, group)] == whole
    assert sum(whole[3]) == sum(int((group == g).sum()) ** 2 for g in range(5))
    long = "word " * 60_000
    got = alignment.aligned(frame(spark, [(1, long), (1, long)])).collect()
    assert [(r.n_a, r.n_b) for r in got] == [tuple(map(len, token_bytes(long)))] * 2


def test_alignment_of_a_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, *r) for d, r in zip(docs, brute_alignment([d.text for d in docs]))} if sum(len(d.text or "") for d in docs) < 200_000 else None
    got = alignment.op13_alignment(spark, folder).collect()
    assert len(got) == len(docs)
    if want is not None:
        assert {(r.doc_id, *(r[c] for c in COLUMNS)) for r in got} == want


def test_overlaps_are_the_shared_bytes(spark):
    texts = ["ünder the tables, 123456", None, "plain words"]
    got = sorted(tuple(r)[2:] for r in alignment.overlaps(frame(spark, list(enumerate(texts)))).collect())
    want = []
    for i, t in enumerate(texts):
        a, b = token_bytes(t)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        for x, (ai, s, e) in enumerate(a):
            for y, (bi, u, v) in enumerate(b):
                if max(s, u) < min(e, v):
                    want.append((i, x, y, ai, bi, max(s, u), min(e, v), sum(z <= s for z in ends)))
    assert got == sorted(want)
    assert alignment.aligned(frame(spark, [])).count() == 0 and alignment.overlaps(frame(spark, [])).count() == 0


def test_as_of_merges_look_up_no_document_and_digests_make_no_strings(monkeypatch):
    """What one merge costs: whole rows of bytes are merged without a key, and hashed as they lie."""
    import pandas as pd

    seen, merge = [], pd.merge_asof
    monkeypatch.setattr(pd, "merge_asof", lambda *a, **b: seen.append(b) or merge(*a, **b))
    sides = alignment.Sides()
    texts = ["plain words, don't", "", "▁none", "ünder the tables, 123456", "plain words, don't"]
    ids = sides.encode(texts)
    left, right = alignment._laid(ids[0], sides.a_size), alignment._laid(ids[1], sides.b_size)
    pairs = alignment.overlapping(left, right)
    assert seen and not any("by" in b for b in seen)
    assert (left["doc"].to_numpy()[pairs["i"]] == right["doc"].to_numpy()[pairs["j"]]).all()
    a_group, b_group, _ = alignment.groups(left, right, pairs)
    assert alignment.digests(left, right, a_group, b_group, len(texts)) == [r[-1] for r in brute_alignment(texts)]
