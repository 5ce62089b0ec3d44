"""SentencePiece encoding and decoding as a relational lattice.

A text, its spaces written as U+2581 with one more in front, falls into words that no piece can reach across:
a word begins with space marks, and letters and marks that no piece holds side by side lie in different words. Every
distinct word of a block of texts is one row: its substrings, of the lengths that pieces with the same opening
characters have, are exploded and equi-joined to the piece table, the matches are grouped by word as the edges of its
lattice, and a Spark ``aggregate`` over the edges folds them into the borders of its pieces. Their ids are then put in the
places of the word in the texts.

A block is some BLOCK_BYTES of one task's texts. Its rows, words first and then texts as numbers of words, go
through explode, broadcast joins and fold in their order and inside their task, so nothing is shuffled, spilled or
stored, and no word or group of words can crowd a task. The price is that a word is folded once in every block that has it.

Two folds are there. ``viterbi`` finds the segmentation with the largest sum of scores, which is how
unigram models segment. ``merges`` joins the adjacent pair whose piece has the best score, leftmost
first, until none is left, which is how BPE models segment; for them the best sum is not the right
answer. Characters without a piece become their bytes. Words longer than LONG characters, whose
lattice would grow large in one row, are encoded by the sentencepiece library.

Defined results: a null or empty text has no ids and decodes to an empty text. U+2581 in a text is
read as a space, as the library does. Repeated rows and repeated or null ids are encoded each. Pieces with
equal scores are joined leftmost first, then the shorter. An empty table gives an empty result. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import keyed, sliced, table, tidy

ROW = ["_f", "_r"]
MODEL = "piece_bpe_32k.model"
SPACE, LONG = "▁", 60
#: Bytes of text whose distinct words are folded once, bytes of text and words that are handed on at a time.
BLOCK_BYTES, TEXT_BYTES, ROWS = 32 << 20, 512 << 10, 1 << 13
#: Before texts in the column of words: no word has a space mark behind something else.
TEXTS = f"\n{SPACE}"
#: Characters by which the pieces that can begin at a place are told, and the bit that marks a word for the slower fold.
OPENING, LATE = 3, 1 << 62
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Pieces:
    """The piece table of a model, and where words can be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.path, self.unknown = path, sp.unk_id()
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in plain]
        self.first_byte = next((i for i in range(sp.get_piece_size()) if sp.is_byte(i)), None)
        self.longest = max(len(p) for p, _, _ in self.rows)
        names = [p for p, _, _ in self.rows]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece reaches over a space")
        inside = {(a, b) for p in names for a, b in zip(p, p[1:])}
        # marks that no piece holds beside a letter, on either side
        self.apart = "".join(c for c in PUNCTUATION if not any((a.isalpha() and b == c) or (a == c and b.isalpha()) for a, b in inside))
        apart = re.escape(self.apart)
        line = "\n" if not any("\n" in x for x in inside) else ""
        run = rf"\p{{L}}++|[{apart}]++" if apart else r"\p{L}++"
        other = rf"[^\p{{L}}{apart}{SPACE}{line}]++"
        #: A word: a line break, or space marks and then letters or marks, which change sides only across something else.
        self.word = (rf"{line}|" if line else "") + rf"{SPACE}*+(?:{run})?+(?:{other}(?:{run})?+)*+"

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): a row for each piece of the model, which bounds it."""
        return F.broadcast(spark.createDataFrame(self.rows, "piece string, id int, score double"))


def _bits(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joins(mask: Column, edge: Column) -> Column:
    """Whether the ends of ``edge`` are borders of ``mask`` with one border between them."""
    return (mask.bitwiseAND(edge["ends"]) == edge["ends"]) & (F.bit_count(mask.bitwiseAND(edge["inner"])) == 1)


def _cleared(mask: Column, edge: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(edge["inner"]))


def _one_by_one(edges: Column, size: Column, whole: Column) -> Column:
    """``_merged`` by a search through all edges before every merge."""
    def step(mask, _):
        best = F.get(F.filter(edges, lambda e: _joins(mask, e)), F.lit(0))
        return _with(best, lambda e: F.when(e.isNull(), mask).otherwise(_cleared(mask, e)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), whole, step)


def _merged(edges: Column, size: Column) -> Column:
    """Begins of the pieces of a word of ``size`` characters as bits; ``edges`` are in the order of merging.

    One pass over the edges does, as long as no merge lets an edge join that the pass has left behind. Such an edge
    holds the merge's own and shares an end with it; where there is one, the ``before`` edges in front are looked
    through again. A word in which one of them joins is marked and folded by a search before every merge.
    """
    one = F.lit(1).cast("long")

    def step(mask, e):
        m = _cleared(mask, e)
        late = (e["before"] > 0) & F.exists(F.slice(edges, F.lit(1), e["before"]), lambda f: _joins(m, f))
        return F.when(_joins(mask, e), F.when(late, m.bitwiseOR(F.lit(LATE))).otherwise(m)).otherwise(mask)

    whole = _bits("shiftleft", one, size + 1) - 1
    return _with(F.aggregate(edges, whole, step), lambda m: F.when(m < LATE, m).otherwise(_one_by_one(edges, size, whole)))


def _best_path(edges: Column, size: Column) -> Column:
    """Begins of the pieces, as bits, of the segmentation with the largest sum of scores."""
    one, worst = F.lit(1).cast("long"), F.lit(-1e18)
    begin = F.array(F.struct(F.lit(0.0).alias("score"), one.alias("mask")))

    def step(states, end):
        here = F.transform(F.filter(edges, lambda e: e["s"] + e["n"] - 1 == end), lambda e: F.struct(
            (F.element_at(states, e["s"])["score"] + e["score"]).alias("score"),
            (F.element_at(states, e["s"])["mask"] + _bits("shiftleft", one, end)).alias("mask")))
        # a character without a piece costs more than any path of pieces
        alone = F.struct((F.element_at(states, end)["score"] - 1e6).alias("score"),
                         (F.element_at(states, end)["mask"] + _bits("shiftleft", one, end)).alias("mask"))
        best = F.array_max(F.concat(F.array(F.struct(worst.alias("score"), one.alias("mask"))), here, F.array(alone)))
        return F.concat(states, F.array(best))

    return F.aggregate(F.sequence(F.lit(1), size), begin, step, lambda a: F.element_at(a, -1)["mask"])


def _openings(pieces: Pieces, least: int) -> list[tuple[str, list[int]]]:
    """Lengths, from ``least`` on, of the pieces that a text beginning with some OPENING characters can begin with."""
    names = {p for p, _, _ in pieces.rows}
    found: dict[str, set[int]] = {}
    for p in names:
        if len(p) >= OPENING:
            found.setdefault(p[:OPENING], {n for n in range(least, OPENING) if p[:n] in names}).add(len(p))
    return [(p, sorted(n)) for p, n in found.items()]


def _by_library(path: str):
    """Ids of one word, from the sentencepiece library."""
    from cohortile.llm import vocabularies

    def ids(word: str) -> list[int]:
        sp = vocabularies.sentences(path)
        if word.startswith(SPACE):  # the library puts the first mark there itself
            return sp.encode(word[1:].replace(SPACE, " "))
        return sp.encode("\n" + word)[len(sp.encode("\n")):]  # a line break is its own bytes and keeps the mark away from the word

    return ids


def _strings(values) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # quicker than one scalar after another


def _bytes(values) -> np.ndarray:
    """The bytes of strings, one after another."""
    if not len(values):
        return np.zeros(0, np.uint8)
    cuts = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[cuts[0]:cuts[-1]] if values.buffers()[2] else np.zeros(0, np.uint8)


def _piece_ids(pieces: Pieces):
    """Words and the begins of their pieces as bits to the words' ids: values, one word after another, and their number per word.

    A word without bits goes to the library, a single character without a piece becomes its bytes.
    """
    names, first = pa.array([p for p, _, _ in pieces.rows], pa.string()), pieces.first_byte
    own = np.array([i for _, i, _ in pieces.rows] + [pieces.unknown], np.int32)
    library = _by_library(pieces.path)

    def ids(words, masks) -> tuple[np.ndarray, np.ndarray]:
        whole = masks.is_null().to_numpy(zero_copy_only=False)
        if whole.any():
            values, size = ids(words.filter(masks.is_valid()), masks.drop_null())
            more = [library(w) for w in words.filter(masks.is_null()).to_pylist()]
            values = np.concatenate([values, *(np.array(m, np.int32) for m in more)])
            cuts = np.concatenate([[0], np.cumsum(np.concatenate([size, np.array([len(m) for m in more], np.int64)]))])
            return _gathered(values, cuts, np.argsort(np.argsort(whole, kind="stable"), kind="stable"))
        mask, length = masks.to_numpy(), pc.utf8_length(words).to_numpy().astype(np.int64)
        data = _bytes(words)
        ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        begins = (np.repeat(mask, length) >> place & 1).astype(bool)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80)[begins], len(data)).astype(np.int32)
        spans = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        found = pc.fill_null(pc.index_in(spans, value_set=names), -1).to_numpy()
        strange, values, size = found < 0, own[found], np.ones(len(found), np.int64)
        if first is not None and strange.any():
            size = np.where(strange, np.diff(at), 1)
            values = np.repeat(values, size)
            values[np.repeat(strange, size)] = data[np.repeat(strange, np.diff(at))].astype(np.int32) + first
        upto = np.concatenate([[0], np.cumsum(size)])
        before = np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], ends]).astype(np.int64)]
        return values, np.diff(upto[before])

    return ids


def _grouped(kept: int, rows: list, names: list[str], scored: bool):
    """Rows without an edge, each with the edges that follow it, in the order of merging."""
    bits = 14  # of an edge's place: 7 of its begin, 7 of its length
    score = np.zeros(max(i for _, i, _ in rows) + 1)
    rank = np.zeros(len(score), np.int64)  # of scores, the best first
    for _, i, value in rows:
        score[i] = value
    own = [i for _, i, _ in rows]
    rank[own] = np.unique(-score[own], return_inverse=True)[1]

    def held_by(group, rank):
        """Whether a row comes after one of its group, all of which lie together, with a rank as good or better."""
        if not len(group):
            return np.zeros(0, bool)
        new = np.append(True, group[1:] != group[:-1])
        step = np.cumsum(new) * (len(score) + 1)
        best = np.minimum.accumulate(rank - step) + step  # the ranks of another group never count
        return np.append(False, best[:-1] <= rank[1:]) & ~new

    def out(table):
        table = table.combine_chunks()
        edge = table.column(kept).combine_chunks() if table.num_rows else pa.array([], pa.int64())
        head = np.flatnonzero(edge.is_null().to_numpy(zero_copy_only=False))
        code = edge.drop_null().to_numpy(zero_copy_only=False)
        size = np.diff(np.concatenate([head, [table.num_rows]])) - 1
        of, s, n, i = np.repeat(np.arange(len(head)), size), code >> 7 & 127, code & 127, code >> bits
        if not scored:  # edges come by word, begin and length
            longer = held_by((of << 7 | s)[::-1], rank[i][::-1])[::-1].copy()
            end = of << 7 | s + n
            by = np.argsort(end, kind="stable")  # the longest first
            longer[by] |= held_by(end[by], rank[i][by])
        by = np.argsort((of << 46) | (rank[i] << bits) | (code & ((1 << bits) - 1)))
        s, n, i = s[by], n[by], i[by]
        one = np.int64(1)
        if scored:
            has = {"s": s.astype(np.int32), "n": n.astype(np.int32), "score": score[i]}
        else:
            before = np.where(longer[by], np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size), 0)
            has = {"ends": (one << (s - 1)) + (one << (s - 1 + n)), "inner": ((one << (n - 1)) - 1) << s, "before": before.astype(np.int32)}
        edges = pa.StructArray.from_arrays(list(map(pa.array, has.values())), list(has))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), edges)
        mine = table.take(pa.array(head)).select(range(kept)).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in mine.columns]
        return pa.RecordBatch.from_arrays([*columns, listed], names=names)

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            last = np.flatnonzero(batch.column(kept).is_null().to_numpy(zero_copy_only=False))
            if len(last):  # the last row without an edge may have more of them in the next batch
                cut = held.num_rows - batch.num_rows + int(last[-1])
                if cut:
                    yield out(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    return run


def folded(words: DataFrame, pieces: Pieces, fold: str = "merges") -> DataFrame:
    """``words`` (word, and what else a row has) with the begins of its pieces as bits in ``mask``; rows stay in their order and partitions.

    The mask is null where the word is, and for words above LONG characters.
    """
    spark, size, kept = words.sparkSession, F.length("word"), words.columns
    least = 2 if fold == "merges" else 1  # characters of the substrings that are looked up
    lattice = F.coalesce(size <= LONG, F.lit(False)) & (size >= least)
    start = words.select(*kept, F.explode(F.when(lattice, F.sequence(F.lit(0), size - (least - 1))).otherwise(F.array(F.lit(0)))).alias("_s"))
    start = start.withColumn("_opening", F.when(F.col("_s") > 0, F.expr(f"substring(word, _s, {OPENING})")))
    openings = spark.createDataFrame(_openings(pieces, least), "_opening string, _lengths array<int>")
    short = F.sequence(F.lit(least), F.lit(OPENING - 1))
    sub = start.join(F.broadcast(openings), "_opening", "left").select(*kept, "_s", F.explode(
        F.when(F.col("_s") == 0, F.array(F.lit(0))).otherwise(F.coalesce("_lengths", short))).alias("_n"))
    sub = sub.filter((F.col("_s") == 0) | (F.col("_n") <= size - F.col("_s") + 1))
    sub = sub.withColumn("_piece", F.when(F.col("_s") > 0, F.expr("substring(word, _s, _n)")))
    table = pieces.table(spark).select(F.col("piece").alias("_piece"), F.col("id").cast("long").alias("_id"))
    found = sub.join(F.broadcast(table), "_piece", "left").filter("_id IS NOT NULL OR _s = 0")
    code = F.expr("shiftleft(_id, 14) + shiftleft(_s, 7) + _n")
    edges = found.select(*(F.when(F.col("_s") == 0, F.col(c)).alias(c) for c in kept), F.when(F.col("_s") > 0, code).alias("_edge"))
    kind = f"array<struct<{'ends:bigint,inner:bigint,before:int' if fold == 'merges' else 's:int,n:int,score:double'}>>"
    shape = words.withColumn("_edges", F.lit(None).cast(kind)).schema
    grouped = edges.mapInArrow(tidy(_grouped(len(kept), pieces.rows, shape.names, fold != "merges")), shape)
    return grouped.select(*kept, F.when(lattice | (size == 1), (_merged if fold == "merges" else _best_path)(F.col("_edges"), size)).alias("mask"))


def encode_words(words: DataFrame, pieces: Pieces, fold: str = "merges") -> DataFrame:
    """``words`` (word, and what else a row has) with ids, null where the word is; rows stay in their order and partitions."""
    kept, found = words.columns, folded(words, pieces, fold)
    at, ids = kept.index("word"), _piece_ids(pieces)

    def run(batches):
        for batch in batches:
            word = batch.column(at)
            there = word.is_valid()
            values, size = ids(word.filter(there), batch.column(len(kept)).filter(there))
            cuts = np.concatenate([[0], np.cumsum(size)])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
            places = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            lists = lists.take(pa.array(places, pa.int32(), mask=~there.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, "ids"])

    return found.mapInArrow(tidy(run), words.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def _units(text):
    """Parts of texts that each have a space before them, without it, as lists; a null or empty text has none."""
    try:
        text = text.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        text = pa.array([None if raw is None else raw.decode("utf-8", "replace") for raw in text.to_pylist()], pa.string())
    empty = pc.fill_null(pc.equal(pc.binary_length(text), 0), True).to_numpy(zero_copy_only=False)
    text = pc.replace_substring(text.take(pa.array(np.arange(len(text)), mask=empty)), SPACE, " ")
    runs = pc.fill_null(pc.or_(pc.starts_with(text, " "), pc.match_substring(text, "  ")), False)  # further spaces belong to what follows them
    lists = pc.split_pattern(text.filter(pc.invert(runs)), " ")
    if not pc.any(runs).as_py():
        return lists
    odd = pa.array([[part[1:] for part in re.findall(" +[^ ]*", " " + x)] for x in text.filter(runs).to_pylist()], pa.list_(pa.string()))
    return pa.concat_arrays([lists, odd]).take(pa.array(np.argsort(np.argsort(runs.to_numpy(zero_copy_only=False), kind="stable"))))


def _gathered(values: np.ndarray, cuts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of ``values`` cut at ``cuts``, one after another, and their sizes."""
    size = np.diff(cuts)[which]
    ends = np.cumsum(size)
    return values[np.repeat(cuts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def _blocks(pattern: str, apart: str, most: int):
    """Rows of a block: its distinct words, then its texts as numbers of words.

    Some texts are one row, bytes written as a string behind TEXTS: every further or nested column beside the edges costs
    Spark's Arrow writer more than all the rest.
    """

    def laid(heads, places, units, find):
        number, letters = count(), pc.utf8_is_alpha(units).to_numpy(zero_copy_only=False)
        spaced, bare = defaultdict(number.__next__), defaultdict(number.__next__)  # of words without the space mark before them, and others
        spaced.update(zip(_strings(units.filter(pa.array(letters))), number))  # letters alone have no cut
        held, size = [], []
        for unit in _strings(units.filter(pa.array(~letters))):
            before = len(held)
            if unit[-1:] in apart and unit[:-1].isalpha():
                held += spaced[unit[:-1]], bare[unit[-1]]
            else:
                held += [spaced[w[1:]] if w[0] == SPACE else bare[w] for w in find(SPACE + unit.replace(" ", SPACE)) if w]
            size.append(len(held) - before)
        counts = np.ones(len(units), np.int64)
        counts[~letters] = size
        cuts, whole = np.concatenate([[0], np.cumsum(counts)]), np.repeat(letters, counts)
        values = np.empty(len(whole), np.int32)
        values[whole], values[~whole] = np.arange(letters.sum()), held
        words = pa.concat_arrays([pc.binary_join_element_wise(SPACE, pa.array(list(spaced), pa.string()), ""), pa.array(list(bare), pa.string())])
        words = words.take(pa.array(np.argsort([*spaced.values(), *bare.values()])))
        # the strings would otherwise stay while all that follows is done with the rows
        spaced.clear(), bare.clear(), held.clear(), size.clear()
        for lo in range(0, len(words), ROWS):
            yield pa.RecordBatch.from_arrays([words[lo:lo + ROWS]], names=["word"])
        for head, (at, mine) in zip(heads, places, strict=True):
            found, counts = _gathered(values, cuts, mine)
            before = np.concatenate([[0], np.cumsum(counts)])[at]
            lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(found, pa.int32()))
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([*head.columns, lists], names=[*head.schema.names, "words"])
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([TEXTS + sink.getvalue().to_pybytes().decode("latin-1")], pa.string())], names=["word"])

    def block(heads, units, ends, find):
        coded = pa.chunked_array(units, pa.string()).dictionary_encode()
        units.clear()
        names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        # cut by the slices' own sizes: an empty chunk does not come back
        codes = np.concatenate([*(c.indices.to_numpy() for c in coded.chunks), np.zeros(0, np.int32)])
        places = np.split(codes, np.cumsum([at[-1] for at in ends])[:-1])
        return laid(heads, zip(ends, places, strict=True), names, find)

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        heads, units, ends, size = [], [], [], 0
        for batch in sliced(batches, "text", most=TEXT_BYTES):
            lists = _units(batch.column("text"))
            units.append(lists.flatten())
            ends.append(np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())]))
            # copied, or else the texts' buffer stays with them
            heads.append(batch.select(["_f", "_r", "id"]).take(pa.array(np.arange(batch.num_rows))))
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= most:
                yield from block(heads, units, ends, find)
                heads, units, ends, size = [], [], [], 0
        if heads:
            yield from block(heads, units, ends, find)

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, and where each begins and ends; a null list has none."""
    size = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _placed(names: list[str], pieces: Pieces, decoded):
    """Texts with the ids of their words, which come before them."""

    def run(batches):
        ids_of = _piece_ids(pieces)
        values, cuts, ids, size = None, None, [], []
        for batch in batches:
            word = batch.column("word")
            is_word = pc.invert(pc.starts_with(word, TEXTS)).to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(is_word[1:] != is_word[:-1]) + 1), batch.num_rows] if batch.num_rows else [0]
            for lo, hi in zip(turns[:-1], turns[1:]):
                if is_word[lo]:
                    own, counts = ids_of(word[lo:hi], batch.column("mask")[lo:hi])
                    ids.append(own)
                    size.append(counts)
                    continue
                if ids or values is None:  # the words of another block
                    values = np.concatenate([*ids, np.zeros(0, np.int32)])
                    cuts = np.concatenate([[0], np.cumsum(np.concatenate([*size, np.zeros(0, np.int64)]))]).astype(np.int64)
                    ids, size = [], []
                for rows in word[lo:hi].to_pylist():
                    texts = pa.ipc.open_stream(rows[len(TEXTS):].encode("latin-1")).read_next_batch()
                    which, at = _flat(texts.column("words"))
                    got, counts = _gathered(values, cuts, which)
                    begin = np.concatenate([[0], np.cumsum(counts)])[at]
                    lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(got, pa.int32()))
                    more = [decoded(lists)] if decoded else []
                    yield pa.RecordBatch.from_arrays([*texts.columns[:3], lists, *more], names=names)

    return run


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", id_col: str = "doc_id", fold: str = "merges", most: int = BLOCK_BYTES,
           decoded: bool = False) -> DataFrame:
    """(_f, _r, id, ids) per row, and with ``decoded`` the text that the ids decode to; ``most`` bytes of text close a block."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = rows.mapInArrow(tidy(_blocks(pieces.word, pieces.apart, most)), "word string")
    found = folded(blocks, pieces, fold)
    names = ["_f", "_r", "id", "ids", *(["decoded"] if decoded else [])]
    schema = f"_f long, _r long, id {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return found.mapInArrow(tidy(_placed(names, pieces, _decoder(pieces) if decoded else None)), schema)


def _decoder(pieces: Pieces):
    """Lists of ids to texts: the bytes of the ids' pieces, without a space in front."""
    names: list = [b""] * (max([i for _, i, _ in pieces.rows] + [(pieces.first_byte or 0) + 255]) + 1)
    for p, i, _ in pieces.rows:
        names[i] = p.replace(SPACE, " ").encode()
    if pieces.first_byte is not None:
        for b in range(256):
            names[pieces.first_byte + b] = bytes([b])

    def texts(lists):
        ids, at = _flat(lists)
        said = pa.array(names, pa.binary()).take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(said.buffers()[1], np.int32)[said.offset:said.offset + len(said) + 1][at].tolist()
        whole = memoryview(said.buffers()[2]) if len(said) else b""
        every = [bytes(whole[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return pa.array([(t[1:] if t.startswith(b" ") else t).decode("utf-8", "replace") for t in every], pa.string())

    return texts


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``: the bytes of the ids' pieces, as text."""
    at, texts = rows.columns.index(ids_col), _decoder(pieces)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, texts(batch.column(at))], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Pieces(model_path())
    found = encode(table(spark, sf_dir, "documents"), pieces, decoded=True)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids",
                        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
