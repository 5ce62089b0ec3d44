"""Information-theoretic removal of personal data, with DataFrame functions only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) come from patterns and checks of
their matches. They are the protected entities, each value and, since most values are held by one or
two texts only, each kind as a whole. How strongly a term reveals one is estimated from co-occurrence
over the distinct texts of the whole corpus, so that copies are no evidence. Of t texts with the term, ct have it
within WINDOW code points of the entity. The chance of the entity given the term is taken at its lower confidence bound
(Wilson's, at SURE standard errors), so one text alone proves little; minus log2 of it is how many bits a reader who sees
the term still lacks. A term that leaves at most REMOVE_BITS is removed wherever it occurs, one that leaves at most
GENERALISE_BITS is replaced by what kind of word it is, provided that it tells at least GAINED_BITS more than
the share of texts that hold the entity. The decision rests on the texts with the term, not on how many others
there are, so it is the same in a small corpus and in a large one.

Defined results: a null or empty text has no spans. Offsets are code points, the end exclusive. A
term is three or more letters, compared in lower case; an occurrence that overlaps a base span is no
span of its own. Repeated rows are rows of their own. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortile.llm.common import joined_small, keyed, scanned, stored, table

ROW = ["_f", "_r"]
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the kinds. Look-behinds and possessive quantifiers only spare the matcher starts and
#: ways back that cannot match; \\G lets a match begin right after the one before it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WINDOW, SURE = 60, 1.96
REMOVE_BITS, GENERALISE_BITS, GAINED_BITS = 1.0, 2.0, 1.0
BASE_TYPE = "array<struct<start:int,rank:int,end:int>>"
TERM_TYPE = "array<struct<start:int,rank:int,end:int,drop:boolean>>"


def _places(text: Column, pattern: Column, matches: Column) -> Column:
    """(start, end, value) of every match: the lengths of what lies between matches, and of the matches, summed up."""
    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a, x):
        start = a["pos"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("pos"), F.when(x["m"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

    return F.aggregate(parts, begin, step, lambda a: a["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")  # i-th from the right
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        whole = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(whole(p)) <= 3) & (F.concat(F.lit("0"), F.substring(whole(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _found(kind: str, text: Column, matches: Column) -> Column:
    """(start, rank, end, entity) of those of the pattern's ``matches`` that hold."""
    pattern = F.lit(PATTERNS[kind])
    name = {"email": F.lower, "card": _digits, "phone": _digits}.get(kind, lambda v: v)
    rank = KINDS.index(kind) + 1
    good = F.filter(_places(text, pattern, matches), lambda x: _holds(kind, x["value"]))
    as_spans = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                                                    F.concat(F.lit(f"{kind}:"), name(x["value"])).alias("entity")))
    some = F.exists(matches, lambda v: _holds(kind, v))
    return F.when(some, as_spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,entity:string>>"))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)


def _near(text: Column, span: Column) -> Column:
    """Terms in the windows before and after a span; words cut by a window's edge and other base spans are left out."""
    before = F.substring(text, F.greatest(span["start"] - WINDOW, F.lit(0)) + 1, F.least(span["start"], F.lit(WINDOW)))
    before = F.when(span["start"] > WINDOW, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.substring(text, span["end"] + 1, F.lit(WINDOW))
    after = F.when(F.length(text) > span["end"] + WINDOW, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    around = F.concat_ws(" ", before, after)
    return F.array_distinct(_terms(F.regexp_replace(around, r"[^\s@]*@[^\s@]*", " ")))


def base_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(_f, _r, id, base) with the base spans of every row, what is near them: array of (entity, terms), and a digest of the text."""
    rows = keyed(docs, F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = rows.select("*", *[F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias(k) for k in KINDS[:4]])
    each = raw.select(*ROW, "id", "text", F.concat(*[_found(k, F.col("text"), F.col(k)) for k in KINDS[:4]]).alias("all"))
    near = F.transform("all", lambda s: F.struct(s["entity"].alias("entity"), _near(F.col("text"), s).alias("terms")))
    plain = F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    return stored(each.select(*ROW, "id", F.sort_array(plain).alias("base"), near.alias("near"), digest), "base-spans")


def least_chance(hits: Column, tries: Column, sure: float) -> Column:
    """Lower end of Wilson's interval for a share of ``hits`` in ``tries``, ``sure`` standard errors wide."""
    n, p, z = tries.cast("double"), hits / tries, F.lit(sure * sure)
    return (p + z / (2 * n) - F.lit(sure) * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def revealing_terms(docs: DataFrame, base: DataFrame, text_col: str = "text", sure: float = SURE, remove_bits: float = REMOVE_BITS,
                    generalise_bits: float = GENERALISE_BITS, gained_bits: float = GAINED_BITS) -> tuple[DataFrame, DataFrame]:
    """(term, bits, drop) of the terms that leave at most ``generalise_bits`` open, and (_f, _r, term) of the rows that hold them.

    Texts are counted by term over the whole corpus, in the first row of each; only the terms that reveal
    something are then looked up in the documents again, so common words meet no join.
    """
    firsts = stored(base.groupBy("digest").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*"), "distinct-texts")
    total = firsts.count()
    near = joined_small(base.filter(F.size("near") > 0).select(*ROW, "near"), firsts, ROW, "left_semi", 48)
    each = near.select(*ROW, F.explode("near").alias("m"))
    kind = F.substring_index("m.entity", ":", 1)
    mentions = stored(each.select(*ROW, F.explode(F.array("m.entity", kind)).alias("entity"), "m.terms"), "mentions")
    entities = mentions.select(*ROW, "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("c"))
    together = mentions.select(*ROW, "entity", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("ct"))
    pairs = stored(together, "revealing-pairs")
    held = keyed(docs, F.array_distinct(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("terms"))
    counted = joined_small(held, firsts, ROW, "left_semi", 48).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("t"))
    counts = stored(counted.join(pairs.select("term").distinct(), "term", "left_semi"), "revealing-counts")
    open_bits = -F.log2(least_chance(F.col("ct"), F.col("t"), sure))
    told = joined_small(pairs, stored(entities, "entities"), "entity", "inner", 96).join(counts, "term").withColumn("bits", open_bits)
    gained = F.log2(F.lit(float(max(total, 1))) / F.col("c")) - F.col("bits")
    flagged = stored(told.filter((F.col("bits") <= generalise_bits) & (gained >= gained_bits)).groupBy("term").agg(F.min("bits").alias("bits"))
                     .withColumn("drop", F.col("bits") <= remove_bits), "revealing-terms")
    rows = held.select(*ROW, F.explode("terms").alias("term"))
    return flagged, joined_small(rows, flagged.select("term"), "term", "left_semi", 48)


def term_spans(docs: DataFrame, base: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """(_f, _r, terms): spans of revealing terms of the rows that have some, none overlapping a base span."""
    flagged, held = revealing_terms(docs, base, text_col, **how)
    by_row = stored(joined_small(held, flagged, "term", "inner", 48).groupBy(*ROW).agg(F.collect_list(F.struct("term", "drop")).alias("found")), "term-rows")
    rows = joined_small(keyed(docs, F.coalesce(F.col(text_col), F.lit("")).alias("text")), by_row, ROW, "inner", 512)
    rows = rows.join(base.select(*ROW, "base"), ROW)

    any_of = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("found", lambda x: x["term"]), "|"), F.lit(r")(?!\p{L})"))  # letters only
    rows = rows.withColumn("pattern", any_of).withColumn("hits", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    spans = F.transform(_places(F.col("text"), F.col("pattern"), F.col("hits")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(5).alias("rank"), s["end"].alias("end"),
        F.exists("found", lambda x: x["drop"] & (x["term"] == F.lower(s["value"]))).alias("drop")))
    free = F.filter(spans, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return stored(rows.select(*ROW, F.sort_array(free).cast(TERM_TYPE).alias("terms")), "term-spans")


def all_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """(_f, _r, id, base, terms) per row."""
    docs = scanned(docs)
    base = base_spans(docs, text_col, id_col)
    found = term_spans(docs, base, text_col, **how)
    return base.select(*ROW, "id", "base").join(found, ROW, "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERM_TYPE)))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"),
                                                              s["end"].cast("string"))), ",")


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row."""
    found = all_spans(docs, text_col, id_col, **how)
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(F.col("id").alias("doc_id"), *[count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _written(F.sort_array(F.concat("base", plain))).alias("spans"))


def _rewritten(text: Column, spans: Column) -> Column:
    """``text`` with its spans, in order, replaced; a span that begins inside the one before it only extends it."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])

    def step(a, s):
        old = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(old.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        put = F.when(s["rank"] < 5, F.element_at(labels, F.least(s["rank"], F.lit(4)))).when(s["drop"], F.lit("")).otherwise(general)
        more = F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), put)
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.when(s["start"] >= a["pos"], more).otherwise(a["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))


def sanitised(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in the text, with the same columns.

    ``length_col``, if it is there, gets the new length of the texts that changed.
    """
    docs = scanned(docs)
    found = all_spans(docs, text_col, id_col, **how)
    both = F.sort_array(F.concat(F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(False).alias("drop"))), "terms"))
    changed = stored(found.select(*ROW, both.cast(TERM_TYPE).alias("_spans")).filter(F.size("_spans") > 0), "spans-to-replace")
    rows = joined_small(keyed(docs, F.struct("*").alias("_row")), changed, ROW, "left", 256)
    text = F.col("_row")[text_col]
    new = F.when(F.col("_spans").isNull() | text.isNull(), text).otherwise(_rewritten(text, F.col("_spans")))
    rows = rows.withColumn("_new", new)
    out = []
    for name in docs.columns:
        old = F.col("_row")[name]
        if name == text_col:
            old = F.col("_new")
        elif name == length_col:
            old = F.when(F.col("_spans").isNull() | F.col("_new").isNull(), old).otherwise(F.length("_new").cast(docs.schema[name].dataType))
        out.append(old.alias(name))
    return rows.select(*out)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
