"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of bytes between white space, digits and ASCII punctuation. The model sees a token,
its beginnings, the tokens before and after it, and two states with transitions; forward-backward
marginals give every token's chance of being toxic. A logistic layer on three aggregates of the marginals (the
largest, their sum, their mean) gives the score of a document, and runs of tokens at 0.5 or more are
its offending offsets.

The labelled tokens come from labelled documents: in a toxic document a token is toxic if its word
or a beginning of it is far more frequent in toxic documents than in others, counting it once per
document and once per pair of neighbours, so that a passage copied into many documents counts as one. The fit takes a
bounded sample of labelled rows, about SAMPLE_TOXIC and SAMPLE_CLEAN documents of at most SAMPLE_CHARS
characters, drawn row by row over the whole table. Scoring covers every document and whole text:
texts are cut into segments whose transfer matrices are multiplied, so the marginals are those of the
whole chain.

Defined results: a null, empty or wordless text has the score of a document without toxic tokens.
Several labels of one id count as toxic if one of them does; null labels and ids are not learned
from. Without labels of both kinds, as from empty tables, every score is 0; an empty table of documents
gives an empty result. Repeated rows are scored each. Texts of any length are scored whole; longer ones
than SAMPLE_CHARS are only not learned from. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import joined_small, keyed, scanned, sliced, stored, table
from cohortile.llm.language import split_of
from cohortile.llm.shingles import in_chunks, mixed, words

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1000, 2000, 32_768
LEAST_DOCS, LEAST_LOG_ODDS = 5, 3.0
#: Bytes of a token's beginnings that are features besides the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
SEGMENT, STEPS, RATE, RIDGE = 64, 40, 0.2, 1.0
TOXIC_AT = 0.7
#: Tokens whose chains are summed at a time while fitting.
PART = 100_000
_BLANK = bytes(32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def _words(texts: list[bytes]) -> list[np.ndarray]:
    """``words`` of many texts with their beginnings, a megabyte of text at a time."""
    parts = []
    for a, b in in_chunks(texts):
        value, start, end, owner, *heads = words([t.translate(_BLANK) for t in texts[a:b]], BEGINNINGS)
        parts.append((value, start, end, owner + a, *heads))
    return [np.concatenate(x) for x in zip(*(parts or [words([], BEGINNINGS)]))]


class Tokens:
    """Words of many texts: feature numbers (0 for unknown), byte offsets, text number."""

    def __init__(self, texts: list[bytes], vocabulary: np.ndarray):
        value, self.start, self.end, self.owner, *heads = _words(texts)
        word = _number(value, vocabulary)
        self.first = np.ones(len(word), bool)
        self.first[1:] = self.owner[1:] != self.owner[:-1]
        before, after = np.zeros_like(word), np.zeros_like(word)
        if len(word):
            same = ~self.first[1:]
            before[1:][same] = word[:-1][same]
            after[:-1][same] = word[1:][same]
        self.own = [word, *(_number(h, vocabulary) for h in heads)]
        self.features = [*((0, i) for i in self.own), (1, before), (2, after)]

    def unary(self, model: dict) -> np.ndarray:
        out = np.full(len(self.first), model["bias"])
        for row, index in self.features:
            out += model["weights"][row][index]
        return out


def _number(value: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, value)
    known = at < len(vocabulary)
    known[known] = vocabulary[at[known]] == value[known]
    return np.where(known, at + 1, 0).astype(np.int32)


def marginals_in_parts(unary: np.ndarray, first: np.ndarray, moves: np.ndarray, with_moves: bool = False):
    """``marginals`` of whole chains, about PART tokens at a time."""
    begin = np.flatnonzero(first)
    cuts = [0, *begin[np.flatnonzero(np.diff(begin // PART)) + 1], len(unary)]
    done = [marginals(unary[a:b], first[a:b], moves, with_moves) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.concatenate([p for p, _ in done]), sum(m for _, m in done) if with_moves else None


def marginals(unary: np.ndarray, first: np.ndarray, moves: np.ndarray, with_moves: bool = False):
    """Chance of the second state for every token, and expected moves (2 x 2) summed over all chains if asked for.

    ``unary`` is the second state's log potential against the first's, ``first`` marks the first token
    of a chain, ``moves`` holds the transitions' log potentials.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    chain = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    inside = np.arange(n) - begin[chain]
    # a chain's tokens in segments of SEGMENT, every segment a column
    per_chain = -(-np.diff(np.concatenate([begin, [n]])) // SEGMENT)
    at_chain = np.concatenate([[0], np.cumsum(per_chain)])
    column, row = at_chain[chain] + inside // SEGMENT, inside % SEGMENT
    m = int(at_chain[-1])
    weight, real = np.ones((SEGMENT, m)), np.zeros((SEGMENT, m), bool)
    weight[row, column], real[row, column] = np.exp(np.clip(unary, -30, 30)), True
    opens = np.zeros(m, bool)
    opens[at_chain[:-1]] = True
    step = np.exp(moves)

    def steps(t):  # no transition comes before the first token of a chain
        return [[np.where(opens, float(i == k), step[i, k]) if t == 0 else step[i, k] for k in (0, 1)] for i in (0, 1)]

    # [t, i, k]: product of the steps from state i at the segment's begin to state k at this token
    forward = np.empty((SEGMENT, 2, 2, m))
    f0, f1 = np.stack([np.ones(m), np.zeros(m)]), np.stack([np.zeros(m), np.ones(m)])
    for t in range(SEGMENT):
        s = steps(t)
        f0, f1 = f0 * s[0][0] + f1 * s[1][0], (f0 * s[0][1] + f1 * s[1][1]) * weight[t]
        scale = 1 / (f0 + f1).sum(axis=0)
        f0, f1 = f0 * scale, f1 * scale
        forward[t, :, 0], forward[t, :, 1] = f0, f1  # what follows a chain's end is not read
    # [t, i, k]: product of the steps after this token, from its state i to state k at the segment's end
    backward = np.empty((SEGMENT, 2, 2, m))
    b0, b1 = np.stack([np.ones(m), np.zeros(m)]), np.stack([np.zeros(m), np.ones(m)])
    for t in range(SEGMENT - 1, -1, -1):
        backward[t, 0], backward[t, 1] = b0, b1
        s, w = steps(t), weight[t]
        n0, n1 = b0 * s[0][0] + b1 * (s[0][1] * w), b0 * s[1][0] + b1 * (s[1][1] * w)
        scale = 1 / (n0 + n1).sum(axis=0)
        b0, b1 = np.where(real[t], n0 * scale, b0), np.where(real[t], n1 * scale, b1)
    # chain the segments: what comes into each from the left and from the right
    rank = np.arange(m) - np.repeat(at_chain[:-1], per_chain)
    left = np.repeat(per_chain, per_chain) - 1 - rank
    enter, leave = np.ones((2, m)), np.ones((2, m))
    for r in range(1, int(per_chain.max())):
        here = np.flatnonzero(rank == r)
        v = np.einsum("im,ikm->km", enter[:, here - 1], forward[-1][:, :, here - 1])
        enter[:, here] = v / v.sum(axis=0)
        here = np.flatnonzero(left == r)
        v = np.stack([(b0[:, here + 1] * leave[:, here + 1]).sum(axis=0), (b1[:, here + 1] * leave[:, here + 1]).sum(axis=0)])
        leave[:, here] = v / v.sum(axis=0)
    a0, a1 = ((enter[0] * forward[:, 0, k] + enter[1] * forward[:, 1, k])[row, column] for k in (0, 1))
    z0, z1 = ((backward[:, i, 0] * leave[0] + backward[:, i, 1] * leave[1])[row, column] for i in (0, 1))
    p = a1 * z1 / (a0 * z0 + a1 * z1)
    if not with_moves:
        return p, None
    e = np.exp(np.clip(unary[1:], -30, 30))
    pair = np.stack([a0[:-1] * step[0, 0] * z0[1:], a0[:-1] * step[0, 1] * e * z1[1:], a1[:-1] * step[1, 0] * z0[1:], a1[:-1] * step[1, 1] * e * z1[1:]])
    pair = pair[:, ~first[1:]]
    return p, (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


def _log_odds(texts: list[bytes], toxic: np.ndarray):
    """Vocabulary of words and beginnings (sorted hashes), and which of them are toxic."""
    value, _, _, owner, *heads = _words(texts)
    joined = np.ones(len(value), bool)
    joined[1:] = owner[1:] == owner[:-1]
    before = np.where(joined, np.roll(value, 1), np.uint64(0))
    after = np.where(np.roll(joined, -1), np.roll(value, -1), np.uint64(0))
    context = before * np.uint64(0x9E3779B97F4A7C15) + after
    vocabularies, marks = [], []
    for feature in (value, *heads):
        vocabulary, number = np.unique(feature, return_inverse=True)

        def support(mask: np.ndarray) -> np.ndarray:
            """Documents with a feature, or its pairs of neighbours where these are fewer."""
            def distinct(x):
                pairs = np.unique(mixed(number[mask].astype(np.uint64)) + x[mask].astype(np.uint64), return_index=True)[1]
                return np.bincount(number[mask][pairs], minlength=len(vocabulary))

            return np.minimum(distinct(owner), distinct(context))

        in_toxic = toxic[owner]
        a, b = support(in_toxic), support(~in_toxic)
        odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
        used = ((a + b) >= LEAST_DOCS) & (vocabulary != 0)
        vocabularies.append(vocabulary[used])
        marks.append(((a >= LEAST_DOCS) & (odds >= LEAST_LOG_ODDS))[used])
    vocabulary, at = np.unique(np.concatenate(vocabularies), return_index=True)
    return vocabulary, np.concatenate(marks)[at]


def _aggregates(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    most, total = np.zeros(n), np.bincount(owner, p, n)
    np.maximum.at(most, owner, p)
    count = np.bincount(owner, minlength=n)
    return np.stack([np.ones(n), most, np.log1p(total), total / np.maximum(count, 1)], 1)


def fit(texts: list[bytes], toxic: np.ndarray) -> dict:
    """The field's weights and the logistic layer, from whole texts and their labels."""
    vocabulary, bad = _log_odds(texts, toxic)
    size = len(vocabulary) + 1
    model = {"vocabulary": vocabulary, "bias": -4.0, "weights": np.zeros((3, size)), "moves": np.zeros((2, 2))}
    tokens = Tokens(texts, vocabulary)
    bad = np.concatenate([[False], bad])
    truth = toxic[tokens.owner] & np.any([bad[i] for i in tokens.own], axis=0)
    pairs = ~tokens.first[1:]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (truth[:-1][pairs].astype(int), truth[1:][pairs].astype(int)), 1)
    state = {k: [0.0, 0.0] for k in ("bias", "weights", "moves")}
    for t in range(1, STEPS + 1):  # gradient steps with momentum and per-weight scale
        p, moved = marginals_in_parts(tokens.unary(model), tokens.first, model["moves"], with_moves=True)
        error = truth - p
        slope = {"bias": error.sum(), "weights": -RIDGE * model["weights"], "moves": seen_moves - moved - RIDGE * model["moves"]}
        for row, index in tokens.features:
            slope["weights"][row] += np.bincount(index, error, size)
        slope["weights"][:, 0] = 0  # unknown words have no weight
        for k, g in slope.items():
            state[k] = [0.9 * state[k][0] + 0.1 * g, 0.99 * state[k][1] + 0.01 * g * g]
            model[k] = model[k] + RATE * (state[k][0] / (1 - 0.9**t)) / (np.sqrt(state[k][1] / (1 - 0.99**t)) + 1e-8)
    p, _ = marginals_in_parts(tokens.unary(model), tokens.first, model["moves"])
    x, y, w = _aggregates(p, tokens.owner, len(texts)), toxic.astype(float), np.zeros(4)
    penalty = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty, x.T @ (y - q) - penalty @ w)
    model["layer"] = w
    return model


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", mod: int = 3,
          held: int = 1) -> dict | None:
    """Fit on a bounded sample of the labelled rows outside the held-out part; None without both labels."""
    docs = scanned(docs)
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    named = named.filter(split_of("id", mod) != held).groupBy("id").agg(F.max("y").alias("y"))
    length = F.length(F.col(text_col))
    every = keyed(docs, F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), length.alias("chars"))
    # every row has a draw of its own, however often its id occurs, and the same by whatever path the table is read
    usable = every.filter(F.col("id").isNotNull() & F.col("chars").between(1, SAMPLE_CHARS)).join(named, "id")
    usable = stored(usable.select("_f", "_r", "id", "y", (F.xxhash64("h", "_r") / F.lit(2.0**64) + 0.5).alias("draw")), "labelled-rows")
    counts = {int(r["y"]): r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE_TOXIC / counts[1])).otherwise(min(1.0, SAMPLE_CLEAN / counts[0]))
    chosen = stored(usable.filter(F.col("draw") < share).select("_f", "_r", "id", "y"), "drawn-rows")  # about SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = keyed(docs, F.col(text_col).cast("binary").alias("text"))
    rows = joined_small(texts, chosen, ["_f", "_r"], "inner", 40).select("id", "text", "y").collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    toxic = np.array([r["y"] == 1 for r in rows], bool)
    return fit([bytes(r["text"]) for r in rows], toxic) if toxic.any() and not toxic.all() else None


def _spans(p: np.ndarray, tokens: Tokens, a: int, b: int, text: bytes) -> str:
    """start:end in code points of every run of toxic tokens in one text."""
    hit = p[a:b] >= 0.5
    if not hit.any():
        return ""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return ",".join(f"{points[tokens.start[a + i]]}:{points[tokens.end[a + j - 1]]}" for i, j in zip(edge[0::2], edge[1::2]))


def score(texts: list[bytes], model: dict) -> tuple[np.ndarray, list[str]]:
    """Score of every text and its offending offsets."""
    tokens = Tokens(texts, model["vocabulary"])
    p, _ = marginals(tokens.unary(model), tokens.first, model["moves"])
    scores = 1 / (1 + np.exp(-_aggregates(p, tokens.owner, len(texts)) @ model["layer"]))
    cut = np.searchsorted(tokens.owner, np.arange(len(texts) + 1))
    return scores, [_spans(p, tokens, a, b, t) for a, b, t in zip(cut[:-1], cut[1:], texts)]


def _scored(shared):
    def run(batches):
        model = shared.value
        for batch in sliced(batches, "text"):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            scores, spans = [], []
            for a, b in in_chunks(texts, 1 << 19):
                s, o = score(texts[a:b], model) if model else (np.zeros(b - a), [""] * (b - a))
                scores.append(s)
                spans += o
            found = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()),
                                              pa.array((found >= TOXIC_AT).astype(np.int32), pa.int32()), pa.array(spans, pa.string())],
                                             names=["doc_id", "held_out", "score", "predicted", "spans"])

    return run


def toxicity(docs: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id", mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (split_of(id_col, mod) == held).alias("held_out"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(
        _scored(shared), "doc_id long, held_out boolean, score double, predicted int, spans string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
