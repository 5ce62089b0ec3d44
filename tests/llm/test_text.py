"""Language, toxicity, personal data, SentencePiece: held-out accuracy, brute force, round trips, odd cases."""

import hashlib
import itertools
import tempfile

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cohortile.llm import language, pii, sentencepiece_lattice, toxicity
from cohortile.llm.common import table

LARGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 34 !!"), (4, "a"), (4, "a"), (None, "Is and the thing of the entire the"), (5, "the " * 30_000)]


def clash(spark, rows):
    return spark.createDataFrame([(*r, "en", "x", "y", "z") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string, term string")


def test_language_held_out_accuracy(spark):
    truth = table(spark, LARGER, "documents").select("doc_id", "lang")
    rows = language.op9_language(spark, LARGER).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(spark):
    docs = clash(spark, ODD)
    model = language.learn(table(spark, LARGER, "documents"))
    got = language.classify(docs, model, out=("lang_pred", "score", "rejected"))
    new = got.columns[len(docs.columns):]
    assert got.columns[:len(docs.columns)] == docs.columns and new == ["lang_pred_", "score_", "rejected"]
    rows = [r.asDict() for r in got.collect()]
    assert len(rows) == len(ODD)
    assert all(r["lang_pred_"] == "und" and r["rejected"] and r["score_"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["lang_pred_"] for r in rows if r["doc_id"] in (None, 5)} == {"en"}
    assert language.drop_rejected(docs).columns == docs.columns
    assert language.learn(docs.limit(0)) == [] and language.classify(docs.limit(0), []).count() == 0
    assert language.classify(docs, []).filter("lang_pred_ <> 'und'").count() == 0


def test_letters_decide_what_is_undetermined(spark):
    texts = ["½ ² ③", "12 !? …", "½ a", "字", None]
    model = [("de", b"der die das und " * 20), ("en", b"the and of to in " * 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.classify(docs, model).collect()}
    assert [got[i].lang_pred == "und" for i in range(5)] == [True, True, False, False, True] and got[0].score == 0


def test_sample_is_drawn_by_row(spark):
    rows = [(None if i % 2 else i, f"das ist Zeile {i} eines Textes" if i % 2 else f"this is line {i} of a text", "de" if i % 2 else "en") for i in range(8000)]
    model = dict(language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=300))
    assert all(200 <= d.count(mark) <= 420 for d, mark in ((model["de"], b"zeile"), (model["en"], b"line")))


def test_dictionaries_and_choices_equal_plain_python(spark):
    """A table smaller than the sample: dictionaries from all training rows, sizes from plain calls of the compressor."""
    import zlib

    import zstandard

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = language.learn(docs, sample_rows=10**6)
    train = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    plain = lambda t: " ".join("".join(c if not c.isascii() else c.lower() if c.isalpha() or c.isspace() else "" for c in t).split())
    middle = lambda t: t[max(1, int((len(t) - 400) / 2)) - 1:][:400]
    order = sorted({r[2] for r in train}, key=lambda k: (-sum(r[2] == k for r in train), k))
    assert [k for k, _ in model] == order
    for k, d in model:
        mine = sorted(" ".join(plain(middle(r[1])) for r in train if r[2] == k).split())
        assert len(d) == language.DICTIONARY_BYTES or sorted(d.decode().split()) == mine

    def size(raw, content, level):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        tool = zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(raw[i:i + 16_384])) for i in range(0, max(1, len(raw)), 16_384))

    some = rows[::7]
    got = {r.doc_id: r for r in language.classify(spark.createDataFrame(some, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in some:
        raw = plain(text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und"
            continue
        sizes = [size(raw, d, 12 if len(raw) <= 1024 else 3) for _, d in model]
        assert got[i].lang_pred == model[min(range(len(sizes)), key=sizes.__getitem__)][0]


def chain(unary, moves):
    """Marginals by summing over all tag sequences."""
    n, total, hit = len(unary), 0.0, np.zeros(len(unary))
    for tags in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(u for u, t in zip(unary, tags) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        total, hit = total + w, hit + w * np.array(tags)
    return hit / total


def test_marginals_equal_sums_over_all_sequences(monkeypatch):
    monkeypatch.setattr(toxicity, "SEGMENT", 3)
    rng = np.random.default_rng(1)
    sizes, moves = [1, 2, 3, 4, 7, 9, 10], rng.normal(size=(2, 2))
    unary = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(unary), bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    got, moved = toxicity.marginals(unary, first, moves, with_moves=True)
    want = np.concatenate([chain(u, moves) for u in np.split(unary, np.cumsum(sizes)[:-1])])
    assert np.allclose(got, want) and np.isclose(moved.sum(), sum(sizes) - len(sizes))


def test_toxicity_held_out_and_offsets(spark):
    labels = table(spark, LARGER, "labels")
    rows = toxicity.op4_toxicity(spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r.predicted == 1 for r in rows if r.toxic == 0), sum(r.predicted == 0 for r in rows if r.toxic == 1)
    toxic = sum(r.toxic == 1 for r in rows)
    assert wrong[0] <= 0.03 * len(rows) and wrong[1] <= 0.35 * toxic
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    model = toxicity.learn(table(spark, LARGER, "documents"), labels)
    text = "Ünd the idiot, of the thing. Moron idiot!"
    _, spans = toxicity.score([text.encode(), b"", b"12 !"], model)
    assert [text[int(a):int(b)] for a, b in (s.split(":") for s in spans[0].split(","))][0].startswith("idiot") and spans[1:] == ["", ""]


def test_toxic_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((len(texts), int(toxic.sum()))) or {})
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 100)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 200)
    import zlib

    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(hot if i < 15_000 else 100_000 + i, f"text {i}" if i % 3 else "same text") for i in range(30_000)]
    labels = [(hot, 1)] + [(100_000 + i, 0) for i in range(30_000)] + [(hot, 0), (hot, None)]
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    toxicity.learn(docs, named)
    (n, hits), = seen
    assert 50 <= hits <= 160 and 130 <= n - hits <= 280


def test_a_fitted_model_meets_odd_tables(spark):
    model = toxicity.learn(table(spark, LARGER, "documents"), table(spark, LARGER, "labels"))
    docs = clash(spark, [*ODD, (77, "word " * 200_000), (77, "idiot " * 50), (77, "idiot " * 50)])
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(empty) == 1 and toxicity.toxicity(docs.limit(0), model).count() == 0


def test_toxicity_odd_tables(spark):
    docs = clash(spark, ODD)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, none) is None and toxicity.learn(docs.limit(0), none.limit(0)) is None
    got = toxicity.toxicity(docs, None).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity.toxicity(docs.limit(0), None).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x * 2 - 9 if i % 2 and x > 4 else x * 2 if i % 2 else x for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in regex.finditer(pattern, text or ""):
            digits = regex.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark):
    import random

    rng = random.Random(1)
    parts = ["a@b.co", "_x@d.com", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", "5", " ", "-",
             "é", "😀", "x", "00.01.2.255", "\n", "%", "4111111111111111", "(", "a.b-c@d-e.f.g"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(800)]
    rows += [(900, None), (901, ""), (902, "a" * 3000 + "@"), (903, "1 " * 20_000), (904, "1." * 4000), (905, "a@b" + ".c" * 20_000), (906, "+1" + " " * 20_000 + "2")]
    texts = dict(rows)
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = plain_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_revealing_terms_are_found_everywhere_and_common_ones_left(spark):
    rows = [(i, f"Write to Zorblax today at zorb@corp.org or number {i}") for i in range(12)]
    rows += [(20, "only ZORBLAX here, today"), (21, "zorblaxian is another word"), (22, None), (23, "")]
    rows += [(100 + i, f"write a number today or at noon to nobody, corp {i}") for i in range(400)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, base string, n_chars int")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[0] == "term:9:16,email:26:39" and spans[20] == "term:5:12" and spans[21] == "" and spans[100] == "" and spans[22] == ""
    clean = pii.sanitised(docs)
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert clean.columns == docs.columns and text[0][0] == "Write to  today at [EMAIL] or number 0" and text[0][1] == len(text[0][0])
    assert text[20][0] == "only  here, today" and text[21] == ("zorblaxian is another word", 7) and text[22] == (None, 7)
    assert pii.report(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).count() == 0


def wilson(hits, tries, z=1.96):
    p = hits / tries
    return (p + z * z / (2 * tries) - z * (p * (1 - p) / tries + z * z / (4 * tries * tries)) ** 0.5) / (1 + z * z / tries)


@pytest.mark.parametrize("others", [600, 40_000])
def test_decisions_rest_on_support_and_not_on_the_corpus(spark, others):
    """The same words beside the same values are judged alike among 600 and among 40,000 other texts."""
    plain = spark.range(others).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("a usual line about nothing, call on card "), F.col("id").cast("string")).alias("text"))
    rows = [(1, "ask Quillfeather (quill@a.org) about nothing")]  # one text is no evidence
    rows += [(2 + i, f"call Brambleton on 1.2.3.4 about nothing {i}") for i in range(2)]  # two are some
    rows += [(10 + i, f"about nothing: cardholder 7.2.3.{i} usual line") for i in range(8)]  # one text a value, eight of the kind
    rows += [(30 + i, f"wending a usual line {i}" + (" b@c.org" if i == 0 else "")) for i in range(9)]  # one of nine
    rows += [(50 + i, "wending a usual line 0 b@c.org") for i in range(40)]  # and its copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(plain)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).filter("doc_id < 1001").collect()}
    assert clean[1] == "ask Quillfeather ([EMAIL]) about nothing" and clean[2] == "call [NAME] on [IP] about nothing 0"
    assert clean[10] == "about nothing:  [IP] usual line" and clean[30] == "wending a usual line 0 [EMAIL]" == clean[50] and clean[31] == rows[12][1]
    assert clean[1000] == "a usual line about nothing, call on card 0"


def test_confidence_bound(spark):
    pairs = [(h, t) for t in range(1, 12) for h in range(t + 1)]
    got = spark.createDataFrame(pairs, "h long, t long").select("h", "t", pii.least_chance(F.col("h"), F.col("t"), 1.96).alias("p")).collect()
    assert all(r.p == pytest.approx(wilson(r.h, r.t), abs=1e-12) for r in got)


def test_pii_has_no_python(spark):
    plan = pii.op1_pii(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    sp = SentencePieceProcessor(model_file=pieces.path)
    texts = ["", None, " ", "  a  b ", "a\nb\n", "日本語 テスト", "x" * 70 + " y", "\n" + "ab" * 50, "é😀 ß", "it's (a).b,c", "a\tb", "same", "same", " \n ",
             "the internationalisation " * 2000]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    for most in (8 << 20, 900, 0):  # all words broadcast, some, none
        got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, pieces, most=most), pieces).collect()
        assert len(got) == len(texts) and {r.id: list(r.ids) for r in got} == {i: sp.encode(t or "") for i, t in enumerate(texts)}
        assert {r.id: r.decoded for r in got} == {i: t or "" for i, t in enumerate(texts)}
    assert sentencepiece_lattice.encode(docs.limit(0), pieces).count() == 0
    again = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted(list(r.ids) for r in sentencepiece_lattice.encode(again, pieces, most=0).collect()) == [sp.encode("a b")] * 3


def test_sentencepiece_shuffles_and_stores_nothing(spark):
    """Words are folded inside the task of their texts: no exchange, no stored table, whatever the number of rare words."""
    from sentencepiece import SentencePieceProcessor

    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    sp = SentencePieceProcessor(model_file=pieces.path)
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdeimnorstäß,.\n1"), rng.integers(1, 14))) for _ in range(300)) for _ in range(40)]
    folder = tempfile.mkdtemp()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(folder)
    docs = spark.read.parquet(folder)
    made = len(spark.sparkContext.__dict__.get("_cohortile_made", []))
    for most in (16 << 20, 20_000):  # one block, several
        got = sentencepiece_lattice.encode(docs, pieces, most=most)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "aggregate(" in plan
        assert not any(x in plan for x in ("ShuffleExchange", "Exchange hashpartitioning", "SortMergeJoin", "HashAggregate"))
        assert {r.id: list(r.ids) for r in got.collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}
    assert len(spark.sparkContext.__dict__.get("_cohortile_made", [])) == made


def test_viterbi_fold_is_the_best_sum(spark):
    rng = np.random.default_rng(2)

    class Own:
        rows = [(p, i, float(s)) for i, (p, s) in enumerate(zip(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "aa"], -rng.uniform(1, 9, 9)))]
        longest, first_byte, unknown, path = 3, None, 99, None

        @classmethod
        def table(cls, spark):
            return F.broadcast(spark.createDataFrame(cls.rows, "piece string, id int, score double"))

    words = ["".join(w) for w in itertools.product("abc", repeat=5)] + ["axb"]
    score = {p: (s, i) for p, i, s in Own.rows}

    def best(word):
        paths = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            paths[e] = max((paths[b][0] + score[word[b:e]][0], paths[b][1] + [score[word[b:e]][1]]) for b in range(max(0, e - 3), e) if word[b:e] in score)
        return paths[-1][0]

    frame = spark.createDataFrame([(0, w) for w in words], "block long, word string")
    got = {r.word: r.ids for r in sentencepiece_lattice.encode_words(frame, Own, fold="viterbi").collect()}
    names = {i: (p, s) for p, i, s in Own.rows}
    assert got.pop("axb") == [0, 99, 1]
    for word, ids in got.items():
        assert "".join(names[i][0] for i in ids) == word and sum(names[i][1] for i in ids) == pytest.approx(best(word))


def test_merges_fold_is_the_best_pair_first(spark):
    """One pass over the edges, and where a merge lets an edge join that the pass has left behind, a search before every merge."""
    names = ["a", "b", "c", "ab", "bc", "ca", "aa", "cb", "abc", "bca", "cab", "aab", "abca", "bcab", "aabc"]
    words = ["".join(w) for n in (1, 2, 3, 6) for w in itertools.product("abc", repeat=n)] + ["axb", "▁", "ü", "abca" * 16]

    def brute(word, score):
        spans = list(word)
        while True:
            pairs = [(-score[a + b][0], i) for i, (a, b) in enumerate(zip(spans, spans[1:])) if a + b in score]
            if not pairs:
                return [x for s in spans for x in ([score[s][1]] if s in score else [99])]
            i = min(pairs)[1]
            spans[i:i + 2] = [spans[i] + spans[i + 1]]

    late = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)

        class Own:
            rows = [(p, i, float(s)) for i, (p, s) in enumerate(zip(names, -rng.permutation(len(names))))]
            longest, first_byte, unknown, path = 4, None, 99, sentencepiece_lattice.model_path()

            @classmethod
            def table(cls, spark):
                return F.broadcast(spark.createDataFrame(cls.rows, "piece string, id int, score double"))

        score = {p: (s, i) for p, i, s in Own.rows}
        frame = spark.createDataFrame([(0, w) for w in words], "block long, word string").coalesce(1)
        got = sentencepiece_lattice.encode_words(frame, Own)
        assert "aggregate(_edges" in got._jdf.queryExecution().executedPlan().toString()
        assert {r.word: r.ids for r in got.collect() if len(r.word) < 60} == {w: brute(w, score) for w in words if len(w) < 60}
        order = sorted(Own.rows, key=lambda r: -r[2])
        for w in words[:-1]:  # the same pass, without a second look
            begins = set(range(len(w) + 1))
            for s, n in [(s, len(p)) for p, _, _ in order for s in range(len(w)) if w.startswith(p, s) and len(p) > 1]:
                if {s, s + n} <= begins and len(begins & set(range(s + 1, s + n))) == 1:
                    begins -= set(range(s + 1, s + n))
            at = sorted(begins)
            late += [score[w[a:b]][1] if w[a:b] in score else 99 for a, b in zip(at, at[1:])] != brute(w, score)
    assert late > 20


def test_sentencepiece_blocks_let_go_of_their_strings():
    """A task's words are handed on for as long as it lasts: meanwhile its worker holds arrays, not dictionaries of strings."""
    import tracemalloc

    import pyarrow as pa

    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    text = " ".join(f"w{i}x" for i in range(100_000))
    rows = pa.RecordBatch.from_pydict({"_f": [0], "_r": [0], "id": [1], "text": [text.encode()]})
    tracemalloc.start()
    try:
        batches = sentencepiece_lattice._blocks(pieces.word, pieces.apart, 1 << 20)(iter([rows]))
        first = next(batches)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    words = [w for b in [first, *batches] for w in b.column("word").to_pylist() if not w.startswith("\n")]
    assert len(words) == len(set(words)) == 100_000 and held < 5_000_000


def test_sentencepiece_blocks_keep_every_row(monkeypatch):
    """Slices with nothing but empty texts, runs of spaces, space marks and bytes that are no UTF-8."""
    import pyarrow as pa

    monkeypatch.setattr(sentencepiece_lattice, "TEXT_BYTES", 1)
    pieces = sentencepiece_lattice.Pieces(sentencepiece_lattice.model_path())
    texts = [b"", None, b"a b", b"", b" ", b"  x  yy. ", "▁m▁▁n".encode(), b"a\n b\n", b"\xff z\xc3", None, b"\n", b"a b"]
    for most in (1 << 20, 0):
        rows = [pa.RecordBatch.from_pydict({"_f": [0], "_r": [i], "id": [i], "text": pa.array([x], pa.binary())}) for i, x in enumerate(texts)]
        whole = pa.RecordBatch.from_pydict({"_f": [0] * len(texts), "_r": list(range(len(texts))), "id": list(range(len(texts))), "text": pa.array(texts, pa.binary())})
        for batches in (rows, [whole], [whole.slice(0, 7), whole.slice(7)]):
            words, got, placed = [], {}, False
            for batch in sentencepiece_lattice._blocks(pieces.word, pieces.apart, most)(iter(batches)):
                row = batch.column("word")[0].as_py()
                if row.startswith(sentencepiece_lattice.TEXTS):
                    part = pa.ipc.open_stream(row[2:].encode("latin-1")).read_next_batch().to_pydict()
                    got |= {r: "".join(words[w] for w in mine) for r, mine in zip(part["_r"], part["words"])}
                    placed = True
                else:  # the words of another block
                    words, placed = ([] if placed else words) + batch.column("word").to_pylist(), False
            assert got == {i: ("▁" + x.decode("utf-8", "replace").replace(" ", "▁") if x else "") for i, x in enumerate(texts)}
