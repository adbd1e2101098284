"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps.

Every step is a shuffle of the edges by node with a minimum per node, joined back to the edges; no neighbourhood
is collected, so nodes with very many edges are aggregated map-side and their join can be split. Each round is written
to the shared folder, so a lost executor costs one round at most. Rounds end when the edges stop changing, after
about log(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernstore.llm.shared import dropped, shared_path


def connected_components(edges: DataFrame) -> DataFrame:
    """Per node that has an edge to another node: node, root (the smallest node of its component).

    ``edges`` has the columns a and b (any ordered type); direction, repeats and loops don't matter, edges with a
    null end are none.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    paths: list[str] = []

    def put(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "edges"))
        df.write.parquet(paths[-1])
        return spark.read.schema(f"a {kind}, b {kind}").parquet(paths[-1])

    # every edge points from the larger to the smaller node
    star = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node move to its smallest neighbour
        large = star.join(least, star.b == least.n).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        # small star: smaller neighbours of a node, and itself, move to the smallest of them
        small = large.join(least, large.a == least.n).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        star = put(small.where("a <> b").distinct())
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in paths[:-1]:
            dropped(spark, old)
        del paths[:-1]
        if tuple(now) == state:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = tuple(now)
