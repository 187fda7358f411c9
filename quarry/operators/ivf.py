"""An inverted-file layout for vector search: rows in cells around trained centres, and queries that read the nearest cells.

The exact scan stays the default; this one reads n_probe of the cells, by a partition filter, and so is approximate.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vector as V

#: Rows that centres are trained on, at most about.
TRAINING_ROWS = 100_000


def centres(rows: DataFrame, cells: int, seed: int = 1, vector_col: str = "embedding") -> DataFrame:
    """(cell, centre) by k-means over a sample of bounded size."""
    n = rows.count()
    sample = rows if n <= TRAINING_ROWS else rows.sample(TRAINING_ROWS / n, seed)
    model = KMeans(k=cells, seed=seed, featuresCol="features").fit(sample.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")))
    return rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")


def assign(rows: DataFrame, centre: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows with their cell: the centres are few and one array literal, so no row is joined."""
    listed = [(r["cell"], r["centre"]) for r in centre.collect()]
    best = F.array_min(F.array(*(F.struct(V.l2(F.col(vector_col), F.array(*(F.lit(x) for x in c))).alias("d"), F.lit(i).alias("cell")) for i, c in listed)))
    return rows.withColumn("cell", best["cell"])


def search(assigned: DataFrame, centre: DataFrame, query: list[float], k: int, n_probe: int = 4, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows in the n_probe cells nearest to the query. Written with partitionBy("cell"), other cells are not read."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = centre.withColumn("d", V.l2(F.col("centre"), q)).orderBy("d", "cell").limit(n_probe)
    cells = [r["cell"] for r in near.select("cell").collect()]
    best = Window.orderBy("distance", id_col)
    top = assigned.where(F.col("cell").isin(cells)).withColumn("distance", V.l2(F.col(vector_col), q)).orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(best))
