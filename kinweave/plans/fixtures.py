"""Fixture views over the given tables: persons, edges, offices and relation text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import fixed
from kinweave.functions.text import surnames
from kinweave.operators.graph import kin_table
from kinweave.operators.shape import bucket

PERIODS = ([1997, 1999], ["Pre-1997", "1997-1998", "1999+"])


class Tables:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def person(self) -> DataFrame:
        c, p = self.t("customer"), self.t("part")
        n, r = self.t("nation"), self.t("region")
        return (
            c.join(p, c["c_custkey"] == p["p_partkey"])
            .join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
            .select(
                F.col("c_custkey").alias("person_id"),
                F.concat(F.lit(fixed.WIKI + "P"), F.col("c_custkey").cast("string")).alias("url"),
                F.col("p_name").alias("nombre"), F.col("r_name").alias("pais"),
                F.col("c_mktsegment").alias("familia"), F.col("n_name").alias("linaje"),
                F.col("p_type").alias("ocupacion"), F.col("p_brand").alias("lugar"), "c_acctbal",
            )
        )

    def known(self) -> DataFrame:
        """Persons with a page of their own; the rest is only mentioned."""
        return self.person().filter(F.col("lugar") != "Brand#1")

    def attr(self) -> DataFrame:
        """Persons with NULL and blank values among place and office."""
        place = F.when(F.col("lugar") == "Brand#1", F.lit(None)).when(F.col("lugar") == "Brand#2", "  ").otherwise(F.col("lugar"))
        office = F.when(
            F.col("c_acctbal") > 6000, F.concat(F.lower("ocupacion"), F.lit(" "), F.lower("linaje"))
        ).when(F.col("c_acctbal") < 0, "")
        return self.person().select(
            "person_id", "url", "nombre", "pais", "familia", "linaje", place.alias("lugar"),
            office.alias("cargos"), "ocupacion", "c_acctbal",
        )

    def edge(self) -> DataFrame:
        n = self.t("customer").agg(F.count("*")).scalar()
        rel = F.col("o_orderpriority")
        return self.t("orders").select(
            F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 37 + 11, n).alias("dst"),
            F.when(rel == "1-URGENT", "conyuge").when(rel == "2-HIGH", "pareja").when(rel == "3-MEDIUM", "padres")
            .when(rel == "4-NOT SPECIFIED", "hijos").otherwise("hermanos").alias("relation_type"),
        ).distinct()

    def house(self) -> DataFrame:
        """Persons by house: the families of one place in one country."""
        return self.person().select("person_id", "pais", F.concat_ws("/", "pais", "lugar").alias("casa"))

    def house_links(self, within: bool = False) -> DataFrame:
        """Marriages contracted to houses; ``within`` keeps those inside one country."""
        p, e = self.house(), self.edge()
        a = p.select(F.col("person_id").alias("src"), F.col("pais").alias("pa"), F.col("casa").alias("a"))
        b = p.select(F.col("person_id").alias("dst"), F.col("pais").alias("pb"), F.col("casa").alias("b"))
        both = e.filter(F.col("relation_type").isin("conyuge", "pareja")).join(a, "src").join(b, "dst")
        both = both.filter(F.col("pa") == F.col("pb")) if within else both
        return both.filter(F.col("a") != F.col("b")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "pa").distinct()

    def spell(self) -> DataFrame:
        return self.t("orders").select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("spell_id"),
            F.year("o_orderdate").alias("anio"), F.lower("o_orderpriority").alias("cargo_text"), "o_orderstatus",
        )

    def mention(self) -> DataFrame:
        """Office facts with surname and period."""
        p = self.person().select("person_id", "pais", "familia", surnames("nombre")["surname_1"].alias("surname_1"))
        return self.spell().join(p, "person_id").withColumn("periodo", bucket("anio", *PERIODS))

    def kin(self, family: str = "familia") -> DataFrame:
        """Edges of known persons with both ends' attributes and classes."""
        known = self.known().withColumn("familia", F.col(family))
        e = self.edge()
        e = e.join(known.select("person_id"), e["src"] == F.col("person_id"), "left_semi")
        return kin_table(e, known, ["nombre", "pais", "familia"])

    def relation_text(self) -> DataFrame:
        """Relation cells ``Name (url); …`` per person and relation, as the sources hold them."""
        e, p = self.edge(), self.person()
        entry = F.concat("nombre", F.lit(" ("), "url", F.lit(")"))
        named = e.join(p.select(F.col("person_id").alias("dst"), entry.alias("entry")), "dst")
        cells = named.groupBy("src", "relation_type").agg(F.array_sort(F.collect_list(F.struct("dst", "entry"))).alias("x"))
        return cells.select("src", "relation_type", F.array_join(F.transform("x", lambda v: v["entry"]), "; ").alias("texto"))

    def person_text(self) -> DataFrame:
        """Person rows with their relation columns as text."""
        wide = self.relation_text().groupBy("src").pivot("relation_type", fixed.RELATION_FIELDS).agg(F.first("texto"))
        p = self.person()
        return p.join(wide, p["person_id"] == wide["src"], "left").drop("src")
