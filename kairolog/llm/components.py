"""Connected components of links, in Spark: hook each node to its least neighbour, shorten, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.llm.shared import saved


def components(links: DataFrame, folder: str) -> DataFrame:
    """links: a, b. For each node that has a link: node, component (its least node). Every round at least halves the
    nodes that still have links to others; each is a table in the shared folder."""
    spark = links.sparkSession
    edges = saved(links.filter("a <> b").select("a", "b").distinct(), f"{folder}/edges-0")
    labels = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")), f"{folder}/labels-0")
    step = 0
    while not edges.isEmpty():
        step += 1
        both = edges.union(edges.select("b", "a"))
        hooks = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), f"{folder}/hooks-{step}")
        for jump in range(2):
            over = hooks.select(F.col("node").alias("up"), F.col("up").alias("above"))
            hooks = saved(hooks.join(over, "up", "left").select("node", F.coalesce("above", "up").alias("up")), f"{folder}/hooks-{step}-{jump}")
        to = hooks.select(F.col("node").alias("component"), "up")
        labels = saved(labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")), f"{folder}/labels-{step}")
        a, b = hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = saved(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{folder}/edges-{step}")
    return spark.read.schema(labels.schema).parquet(f"{folder}/labels-{step}")
