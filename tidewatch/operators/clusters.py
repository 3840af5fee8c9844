"""Clusters that are fitted once, kept in a folder under a version, and applied to any rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..sources.steps import written
from .models import SILHOUETTE_ROWS, choose_k
from .ranks import quantile_row


def nearest(columns: list[Column], centres: list[list[float]]) -> Column:
    """The number of the nearest centre, ties to the smaller: constants of an expression, so that nothing is shuffled."""
    far = [sum(((v - F.lit(c)) * (v - F.lit(c)) for v, c in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]


@dataclass(frozen=True)
class Clusters:
    """Medians, scales (1 where the quartiles are equal) and centres, in order of the mean of the ordering column."""

    columns: list[str]
    medians: list[float]
    scales: list[float]
    centres: list[list[float]]

    def scaled(self) -> list[Column]:
        """The columns as the centres see them; missing and infinite values take the median."""
        return [(F.coalesce(finite(F.col(c).cast("double")), F.lit(m)) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.medians, self.scales, strict=True)]

    def apply(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """Adds each row's cluster; rows needn't be those that were fitted."""
        x = [f"_scaled_{i}" for i in range(len(self.columns))]
        return df.select("*", *[c.alias(n) for c, n in zip(self.scaled(), x, strict=True)]).withColumn(name, nearest([F.col(n) for n in x], self.centres)).drop(*x)

    def save(self, spark: SparkSession, root: str) -> int:
        """Keeps the clusters under root's next version, which is whole once its _SUCCESS is there."""
        version = max(versions(spark, root, whole=False), default=-1) + 1
        rows = [("columns", i, c, m, s, None) for i, (c, m, s) in enumerate(zip(self.columns, self.medians, self.scales, strict=True))]
        rows += [("centres", i, None, None, None, c) for i, c in enumerate(self.centres)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root.rstrip('/')}/version={version}")
        return version


SCHEMA = "part string, i int, name string, median double, scale double, centre array<double>"


def versions(spark: SparkSession, root: str, whole: bool = True) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(p.getName().removeprefix("version=")) for p in found if not whole or fs.exists(p.suffix("/_SUCCESS")))


def load(spark: SparkSession, root: str, version: int | None = None) -> Clusters:
    """The clusters of a version, the last whole one if none is given."""
    known = versions(spark, root)
    if not known or version not in (None, *known):
        raise ValueError(f"{root} has no clusters" if version is None else f"{root} has no version {version}")
    rows = spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/version={known[-1] if version is None else version}").orderBy("i").collect()
    columns = [r for r in rows if r["part"] == "columns"]
    return Clusters([r["name"] for r in columns], [r["median"] for r in columns], [r["scale"] for r in columns], [list(r["centre"]) for r in rows if r["part"] == "centres"])


def fit(df: DataFrame, columns: list[str], key: str, order: str, ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), seeds: tuple[int, ...] = (42, 43, 44)) -> tuple[DataFrame, Clusters]:
    """The table of candidates with one K selected, and that K's clusters: KMeans of least cost over the seeds, after
    scaling by median and quartiles. All rows are fitted; centres are numbered by the mean of order, so that runs agree."""
    q = quantile_row(df, columns, (0.25, 0.5, 0.75))
    medians = [q[c][1] or 0.0 for c in columns]
    scales = [((q[c][2] or 0.0) - (q[c][0] or 0.0)) or 1.0 for c in columns]
    names = [f"_x{i}" for i in range(len(columns))]
    scaled = Clusters(columns, medians, scales, []).scaled()
    x = written(df.select(key, F.col(order).alias("_order"), *[c.alias(n) for c, n in zip(scaled, names, strict=True)]), "cluster-features")
    found: dict[int, Clusters] = {}

    def labels(rows: DataFrame, _: list[str], k: int, by: str, seeds: tuple[int, ...]) -> DataFrame:
        vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(rows)
        best = min((KMeans(k=k, seed=s, featuresCol="_features", predictionCol="_raw").fit(vectors) for s in seeds), key=lambda m: m.summary.trainingCost)
        means = best.transform(vectors).groupBy("_raw").agg(F.avg(by).alias("m")).orderBy(F.col("m").asc_nulls_last(), "_raw").collect()  # k rows
        centres = best.clusterCenters()
        found[k] = Clusters(columns, medians, scales, [[float(v) for v in centres[r["_raw"]]] for r in means])
        return rows.withColumn("cluster", nearest([F.col(n) for n in names], found[k].centres))

    table, _ = choose_k(x, names, key, "_order", ks, seeds, labels, SILHOUETTE_ROWS)
    return table, found[table.filter("selected").first()["k"]]
