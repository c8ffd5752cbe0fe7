"""K-means on daily features and on load shapes, fitted with the distributed library trainer."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterhour.operators.clean import vector_of_day
from quarterhour.sources.stage import shared

# Names of the weather clusters from hottest to coolest, storms last.
CLUSTER_NAMES = ("Hot-Dry", "Pre-Monsoon Humid", "Rainy", "Storm")


def weather_clusters(df: DataFrame, storms: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters of the calm days by daily weather, numbered by temperature from hot to cool; storm days are cluster 3.

    A calm day that lacks one of the readings has no place among the clusters and is left out. Where the other calm days have
    fewer different weathers than ``k``, there are as many clusters as weathers; without calm days only storm days are left.

    One model serves all states, so days of different regions share the cluster meaning.
    """
    d = df.groupBy("state", "date").agg(F.avg("temperature").alias("avg_temp"), F.avg("humidity").alias("avg_hum"), F.sum("precipitation").alias("total_precip"), F.avg("wind_speed_10m").alias("avg_wind"))
    cols = ["avg_temp", "avg_hum", "total_precip", "avg_wind"]
    d = d.join(storms.select("state", "date", "storm"), ["state", "date"])
    # Stored once: means made again may differ in the last bits, and so the number of different rows.
    calm = shared(VectorAssembler(inputCols=cols, outputCol="features").transform(d.where(~F.col("storm")).dropna(subset=cols)))
    storm = d.where("storm").select("state", "date", *cols, F.lit(3).alias("cluster"))
    weathers = calm.select(*cols).distinct().limit(k).count()
    if weathers > 1:  # the trainer wants as many different rows as clusters, two at least
        model = KMeans(k=weathers, seed=seed, initSteps=5, maxIter=50).fit(calm)
        order = sorted(range(len(model.clusterCenters())), key=lambda i: -model.clusterCenters()[i][0])
        rank = F.create_map(*[F.lit(x) for old, new in ((o, i) for i, o in enumerate(order)) for x in (old, new)])
        out = model.transform(calm).select("state", "date", *cols, F.element_at(rank, F.col("prediction")).alias("cluster"))
    else:
        out = calm.select("state", "date", *cols, F.lit(0).alias("cluster"))
    names = F.array(*[F.lit(n) for n in CLUSTER_NAMES])
    return out.unionByName(storm).withColumn("cluster_name", F.element_at(names, F.col("cluster") + 1))


def load_shape_clusters(df: DataFrame, k: int = 4, seed: int = 42, feature: str = "load") -> tuple[DataFrame, DataFrame]:
    """Clusters of daily 96-vectors divided by their own maximum: (day assignments, mean profile per cluster and block)."""
    v = vector_of_day(df, feature)
    v = v.withColumn("_mx", F.array_max("vec")).where(F.col("_mx") > 0)
    v = v.withColumn("features", array_to_vector(F.transform("vec", lambda x: x / F.col("_mx"))))
    model = KMeans(k=k, seed=seed, maxIter=50).fit(v.select("features"))
    a = model.transform(v).select("state", "date", "vec", F.col("prediction").alias("cluster"))
    profile = a.select("cluster", F.posexplode("vec").alias("pos", "x")).groupBy("cluster", (F.col("pos") + 1).alias("block")).agg(F.avg("x").alias("mean_load"), F.count(F.lit(1)).alias("days"))
    return a.select("state", "date", "cluster"), profile
