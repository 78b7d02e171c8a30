"""Reading, shared intermediates, identifiers and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.operators.series import materialise

#: Stands for a null identifier inside an operator.
NO_ID = -(2**63)

saved = materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The two columns an operator works on, under names that cannot clash, and those to be handed on."""
    return df.select(*[F.col(c).alias(f"_x{k}") for k, c in enumerate(carry)], F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).cast("string").alias("_text"))


def real_id(c: str = "_id") -> Column:
    """The identifier as it was given: null again where it was null."""
    return F.when(F.col(c) != NO_ID, F.col(c))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b).

    Each round every node takes the smallest label among its neighbours, hands it to
    the node its old label names, and jumps to its label's label; the number of rounds
    grows with the logarithm of the longest path.  All folds combine on the map side and all joins
    read written tables, so that Spark can split a node with very many neighbours.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        near = saved(label.join(near, "id").select("id", "label", F.least("label", "m").alias("m")))
        told = saved(near.select("id", "m").union(near.select(F.col("label").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("m")))
        after = saved(told.join(told.select(F.col("id").alias("m"), F.col("m").alias("root")), "m").select("id", F.col("root").alias("label")))
        if not after.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count():
            return after.withColumnRenamed("label", "component")
        label = after
