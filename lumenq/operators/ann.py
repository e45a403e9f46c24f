"""Approximate nearest vectors, for who asks for them: inverted lists with an exact re-rank.

SELECT stays exact.  ``build`` puts every vector into the list of its nearest centre and
writes a folder per list; ``VectorIndex.search`` reads the lists whose centres are nearest
to the query (partitions of the scan) and ranks their rows by the true distance.  If they
hold fewer than ``k`` matching rows, it reads twice as many lists, at last all of them.

Centres are fitted on about ``sample`` rows, all rows are indexed.  Rows go to list files by
a rebalanced shuffle, so a list that holds a third of them is written by many tasks.  The
driver holds the centres only: ``lists`` times the dimension.

Defined results: NULL vectors and those with a NaN are in no centre's list and come last, if
at all; ties go by ``key``; repeated rows stay; a table without vectors gives an index
without centres, whose searches read everything; a column of the list's own name is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lumenq.errors import BinderError
from lumenq.functions.registry import cosine_distance, l2_distance

LIST = "_list"
LISTS, SAMPLE = 64, 50_000
_DISTANCE = {"l2": l2_distance, "cosine": cosine_distance}


def _vector(c: Column, metric: str) -> Column:
    """Vectors as the centres see them: of length 1 under the cosine."""
    c = c.cast("array<double>")
    if metric == "l2":
        return c
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.array(norm), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0]


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    column: str
    metric: str
    key: tuple[str, ...]
    schema: StructType
    centres: np.ndarray

    def search(self, vector: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """The columns of the table and ``distance``: the nearest ``k`` rows of the lists read, nearest first.

        ``probes`` lists are read, half of them if it isn't given: vectors without clusters need
        that many for a recall of 0.9, clustered ones far fewer.
        """
        probes = max(1, (len(self.centres) + 1) // 2) if probes is None else probes
        if len(self.centres) and len(vector) != self.centres.shape[1]:
            raise BinderError("InvalidType", f"vectors of {self.centres.shape[1]} and {len(vector)} dimensions")
        if probes < 1:
            raise BinderError("InvalidOption", "probes must be 1 or more")
        q = np.asarray(vector, dtype=float)
        if self.metric == "cosine" and np.linalg.norm(q) > 0:
            q = q / np.linalg.norm(q)
        nearest = np.argsort(((self.centres - q) ** 2).sum(axis=1), kind="stable") if len(self.centres) else np.empty(0, int)
        while True:
            table = self.spark.read.schema(self.schema).parquet(self.path)
            every = probes >= len(nearest)
            if not every:
                table = table.filter(F.col(LIST).isin([int(x) for x in nearest[:probes]]))
            if where is not None:
                table = table.filter(where)
            distance = _DISTANCE[self.metric](F.col(self.column).cast("array<double>"), F.array(*[F.lit(float(x)) for x in vector]))
            distance = F.when(F.col(self.column).isNotNull(), distance)
            found = table.withColumn("distance", distance).drop(LIST).orderBy(F.col("distance").asc_nulls_last(), *self.key).limit(k)
            if every or found.count() >= k:
                return found
            probes *= 2


def build(df: DataFrame, column: str, path: str, metric: str = "l2", key: list[str] = (), lists: int = LISTS, sample: int = SAMPLE, seed: int = 0) -> VectorIndex:
    """Write the rows of ``df`` to ``path`` by list; ``path`` must be new and shared by all nodes."""
    if metric not in _DISTANCE:
        raise BinderError("InvalidOption", f"{metric}: only {', '.join(_DISTANCE)} have centres; search by other metrics exactly")
    if taken := {LIST, "distance"} & {c.lower() for c in df.columns}:
        raise BinderError("InvalidOption", f"columns {', '.join(sorted(taken))}")
    whole = F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
    usable = df.filter(whole)
    schema = StructType(list(df.schema.fields)).add(LIST, IntegerType())
    rows = usable.count()
    if not rows:
        df.withColumn(LIST, F.lit(-1)).write.partitionBy(LIST).parquet(path)
        return VectorIndex(df.sparkSession, path, column, metric, tuple(key), schema, np.empty((0, 0)))
    points = usable.select(array_to_vector(_vector(F.col(column), metric)).alias("v"))
    if rows > sample:
        points = points.sample(sample / rows, seed)
    model = KMeans(k=lists, seed=seed, maxIter=10, featuresCol="v", predictionCol=LIST).fit(points)
    placed = model.transform(usable.withColumn("v", array_to_vector(_vector(F.col(column), metric)))).drop("v")
    placed = placed.unionByName(df.filter(~whole).withColumn(LIST, F.lit(-1)))
    placed.hint("rebalance", LIST).write.partitionBy(LIST).parquet(path)
    return VectorIndex(df.sparkSession, path, column, metric, tuple(key), schema, np.array(model.clusterCenters()))
