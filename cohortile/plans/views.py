"""Domain tables derived from the star-schema test tables (layout in FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortile.operators import cohort, diffexp
from cohortile.operators.matrix import densify, log_cpm, log_zscore
from cohortile.session import fingerprint, kept, ship_package

CONTRASTS = [
    ("asia_vs_europe", "ASIA", "EUROPE"),
    ("asia_vs_africa", "ASIA", "AFRICA"),
    ("europe_vs_africa", "EUROPE", "AFRICA"),
]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "events": "event_id long, user_id long, event_type string, value double",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


class Views:
    """One set of lazily built tables over a data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        ship_package(spark)
        self.spark, self.folder, self._kept, self._files = spark, folder, {}, None

    def keep(self, name: str, build: Callable[[], DataFrame], key: str = "feature") -> DataFrame:
        """A table several passes read is written once, bucketed by ``key``, to a fresh shared folder.

        It is known by the files of the input folder and by its name, so other queries on the same files read it
        too, and changed files make a new one. Later passes scan only the columns they need, and lost executors
        do not rebuild the joins.
        """
        if self._files is None:
            self._files = fingerprint(self.spark, self.folder)
        return kept(self.spark, (self._files, name), build, key)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def samples(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_name").alias("sample"), F.col("r_name").alias("grp"))

    def feature_bound(self) -> int:
        """Features never outnumber parts; the count comes from the file footers."""
        if "bound" not in self._kept:
            self._kept["bound"] = self.table("part").count()
        return self._kept["bound"]

    def cell_bound(self) -> int:
        return self.feature_bound() * self.table("nation").count()

    def cells(self) -> DataFrame:
        """Non-zero (feature, sample) totals, summed on the numeric keys before names are attached."""
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        totals = (
            line.join(orders, line.l_orderkey == orders.o_orderkey)
            .join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy("l_partkey", "c_nationkey").agg(F.sum("l_quantity").alias("value"))
        )
        return totals.join(nation, totals.c_nationkey == nation.n_nationkey).select(
            F.col("l_partkey").cast("string").alias("feature"), F.col("n_name").alias("sample"), "value")

    def matrix(self) -> DataFrame:
        """(feature, sample, value), dense."""
        return densify(self.cells(), self.samples(), unique=True)

    def expr(self) -> DataFrame:
        return self.matrix().join(self.samples(), "sample").select("feature", "sample", "grp", "value")

    def expr_planted(self) -> DataFrame:
        number, v = F.col("feature").cast("int"), F.col("value") + 20
        size = F.when(number % 3 == 0, v).when(number % 3 == 1, v * v).otherwise(v * v * v)
        effect = (
            ((number % 10 == 0) & (F.col("grp") == "ASIA"))
            | ((number % 10 == 1) & F.col("grp").isin("ASIA", "AFRICA"))
            | ((number % 10 == 2) & (F.col("grp") == "EUROPE"))
        )
        return self.expr().withColumn("value", size * F.when(effect, 64).otherwise(1))

    def expr_raw(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_partkey").cast("string").alias("feature"),
            F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("gene_id"))
        return self.expr().join(part, "feature").select("gene_id", F.col("sample").alias("biospecimen"), "value")

    def meta(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("biospecimen"), F.col("o_custkey").alias("sample_id"),
            F.col("o_orderstatus").alias("comp"), F.col("o_orderpriority").alias("strategy"))

    def maf(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name")
        line = self.table("lineitem")
        change = F.when(F.col("l_linenumber") == 1, ".").otherwise(
            F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
        return line.join(part, line.l_partkey == part.p_partkey).select(
            F.col("p_name").alias("symbol"), change.alias("hgvsp"), F.round(F.col("l_discount") * 10, 1).alias("vaf"),
            F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("vclass"), F.col("l_orderkey").alias("biospecimen"))

    def sv(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("biospecimen"), F.col("event_type").alias("sv_type"))

    def sv_meta(self) -> DataFrame:
        kind = F.when(F.col("user_id") % 3 == 0, "S").when(F.col("user_id") % 3 == 1, "A").otherwise("T")
        return self.table("events").select(
            F.col("user_id").alias("biospecimen"), (F.col("user_id") % 20).alias("sample_id"), kind.alias("comp")).distinct()

    def gene_sets(self) -> DataFrame:
        part = self.table("part")
        key = F.col("p_partkey").cast("string").alias("feature")
        number = F.substring("p_brand", 7, 10).cast("int")
        brand = part.select(F.col("p_brand").alias("gs_name"), F.when(number <= 12, "C2").otherwise("H").alias("category"), key)
        size = part.select(F.concat(F.lit("SIZE_"), F.col("p_size").cast("string")).alias("gs_name"), F.lit("C5").alias("category"), key)
        return brand.unionByName(size)

    def gene_set_blocks(self) -> DataFrame:
        """Sets of bounded size whose number grows: each block of 100 parts holds sets of 60, 25, 12 and 3."""
        place = (F.col("p_partkey") - 1) % 100
        part = F.when(place < 60, "A").when(place < 85, "B").when(place < 97, "C").otherwise("D")
        block = F.floor((F.col("p_partkey") - 1) / 100).cast("string")
        return self.table("part").select(
            F.concat(F.lit("BLOCK_"), block, F.lit("_"), part).alias("gs_name"), F.lit("C3").alias("category"),
            F.col("p_partkey").cast("string").alias("feature"))

    def surface(self) -> DataFrame:
        return self.table("part").filter("p_size <= 10").select(F.col("p_partkey").cast("string").alias("feature"))

    def goi(self) -> DataFrame:
        return self.table("part").filter(F.col("p_name").startswith("blue")).select(F.col("p_name").alias("symbol")).distinct()

    def markers(self) -> DataFrame:
        """Ranked marker table: dearer parts first within each type; the price stands for the rank."""
        return self.table("part").select(
            F.col("p_type").alias("cell_type"), F.col("p_partkey").cast("string").alias("feature"),
            F.struct((-F.col("p_retailprice")).alias("a"), F.col("p_partkey").alias("b")).alias("ord"))

    def id_mapping(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("versioned_id"),
            F.col("p_partkey").cast("string").alias("id"),
            F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name")).alias("symbol"))

    def signature(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_retailprice").alias("weight"))

    def train(self) -> DataFrame:
        """(feature, sample, value, positive): one row per embedding position; label 0 is positive."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("sample"), (F.col("label") == 0).alias("positive"), F.posexplode("embedding").alias("feature", "x")
        ).select("feature", "sample", F.col("x").cast("double").alias("value"), "positive")

    def deconv(self) -> DataFrame:
        """Narrow wide-form table: one row per sample, one column per order priority."""
        orders, customer, nation = self.table("orders"), self.table("customer"), self.table("nation")
        rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
        return rows.groupBy(F.col("n_name").alias("sample")).agg(*[
            F.count_if(F.col("o_orderpriority").startswith(code)).alias(name) for name, code in DECONV])

    def scores(self) -> DataFrame:
        """Numbers in skewed groups of people: balances by market segment."""
        return self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("value"))

    def kept_matrix(self) -> DataFrame:
        return self.keep("matrix", self.matrix)

    def kept_expr(self) -> DataFrame:
        return self.keep("expr", self.expr)

    def counts(self) -> DataFrame:
        """The planted count matrix, stored: library sizes and the model are two passes over it."""
        return self.keep("counts", self.expr_planted)

    def log_counts(self) -> DataFrame:
        return log_cpm(self.counts())

    def zscores(self) -> DataFrame:
        """log2 z-scores without constant features, rounded so equal values stay equal in any engine."""
        build = lambda: log_zscore(self.matrix()).withColumn("value", F.round("value", 9) + F.lit(0.0)).filter("value IS NOT NULL")
        return self.keep("zscores", build)

    def de(self) -> DataFrame:
        """The stored result table with moderated t and adjusted p, which overlaps and classes are read from."""
        bound = self.feature_bound() * len(CONTRASTS)
        return self.keep("de", lambda: diffexp.de_table(self.counts(), CONTRASTS, max_rows=bound))

    def training_cells(self) -> DataFrame:
        """(tracking_id, uid, value): every embedding position is a versioned id."""
        place = F.posexplode("embedding").alias("k", "x")
        return self.table("embeddings").select(self.uid(), place).select(
            F.concat((F.col("k") + 1).cast("string"), F.lit("."), (F.col("k") % 3).cast("string")).alias("tracking_id"), "uid", F.col("x").cast("double").alias("value"))

    def uid(self):
        return F.translate(F.concat(F.lit("V-"), F.col("vec_id").cast("string")), "-", ".").alias("uid")

    def training_labels(self) -> DataFrame:
        """(uid, label); label 9 is missing."""
        return self.table("embeddings").select(self.uid(), F.when(F.col("label") != 9, F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"))

    def label_overrides(self) -> DataFrame:
        return self.table("embeddings").filter("label = 9").select(self.uid(), F.when(F.col("vec_id") % 2 == 0, "EB").otherwise("ECTO").alias("label"))

    def mutated_groups(self) -> DataFrame:
        """(sample, stratum, mut_group): nations with more variants of interest than their stratum's mean are mutated."""
        hits = self.maf().join(self.goi(), "symbol", "left_semi").filter("hgvsp <> '.'").groupBy("biospecimen").agg(F.count(F.lit(1)).alias("n"))
        orders, customer, nation = self.table("orders"), self.table("customer"), self.table("nation")
        owner = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("o_orderkey").alias("biospecimen"), "c_nationkey")
        per = hits.join(owner, "biospecimen").groupBy("c_nationkey").agg(F.sum("n").alias("n"))
        named = nation.join(per, nation.n_nationkey == per.c_nationkey, "left").select(
            F.col("n_name").alias("sample"), F.concat(F.lit("S"), (F.col("n_nationkey") % 2).cast("string")).alias("stratum"), F.coalesce("n", F.lit(0)).alias("n"))
        mean = F.avg("n").over(Window.partitionBy("stratum"))
        listed = named.withColumn("m", mean).filter("n > m").select("sample")
        return cohort.group_by_mutation(named.select("sample", "stratum"), listed, "sample", "stratum").select("sample", "stratum", "mut_group")


DECONV = [("urgent", "1"), ("high", "2"), ("medium", "3"), ("unstated", "4"), ("low", "5")]
