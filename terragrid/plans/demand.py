"""Synthetic electricity demand: features, boosted trees, cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import leap_hours, local_time, tz_offset_hours, weekend
from ..options import DemandOptions
from ..sources.tables import write_result


def hours(spark, year: int) -> DataFrame:
    """All UTC hours of a year: (hour, utc)."""
    start = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return spark.range(leap_hours(year)).select(F.col("id").alias("hour"), F.timestamp_add("HOUR", F.col("id").cast("int"), start).alias("utc"))


def zones(population: DataFrame, at: Column) -> DataFrame:
    """Per region: most populous zone (the first by name of a tie), weighted mean offset, population."""
    by = population.groupBy("region", "tz").agg(F.sum("population").alias("population"))
    by = by.withColumn("offset", tz_offset_hours(at, F.col("tz")))
    return by.groupBy("region").agg(
        F.min_by("tz", F.struct(-F.col("population"), F.col("tz"))).alias("tz"),
        F.try_divide(F.sum(F.col("population") * F.col("offset")), F.sum("population")).alias("offset"),
        F.sum("population").alias("population"),
    )


def shifted(series: DataFrame, keys: list[str], offset: Column, n: Column | int) -> DataFrame:
    """A cyclic shift of hourly series by a rounded offset (half to even): the hour is re-keyed, no row moves."""
    return series.withColumn("hour", F.pmod(F.col("hour") + F.bround(offset).cast("long"), F.lit(n) if isinstance(n, int) else n))


def regional_economics(pixels: DataFrame, national: DataFrame, compat: bool = False) -> DataFrame:
    """Per region from pixels (region, country, population, popdens, gdp) and national demand per head
    with its growth (country, demand_percapita, multiplier); ``compat`` weighs by density."""
    w = F.col("popdens") if compat else F.col("population")
    met = pixels.join(national, "country", "left")
    out = met.groupBy("region").agg(F.sum(F.coalesce("demand_percapita", F.lit(0.0)) * F.coalesce("multiplier", F.lit(1.0)) * w).alias("demand"), F.sum(w).alias("people"), F.sum("gdp").alias("gdp"))
    return out.select("region", F.try_divide("demand", "people").alias("demandpercapita"), F.try_divide("gdp", "people").alias("gdppercapita"), "people")


def growth(final_energy: DataFrame, year: int) -> DataFrame:
    """(region, multiplier) from wide tables of two models: (model, region, "2020" ... ) columns by year."""
    from ..functions.scalar import demand_multiplier

    ratio = F.try_divide(F.col(f"`{year}`"), F.col("`2020`"))
    mean = final_energy.groupBy("region").agg(F.avg(ratio).alias("g"))
    return mean.select("region", demand_multiplier(F.col("g"), F.col("g"), year).alias("multiplier"))


def features(temperature: DataFrame, zone: DataFrame, economics: DataFrame) -> DataFrame:
    """Hourly features of every region.

    ``temperature`` is (region, utc, hour, temp1, temp_top3).  Months are ranked by their mean
    temperature, the first of a tie first; temp1_mean is the median.
    """
    local = temperature.join(zone.select("region", "tz"), "region").withColumn("t", local_time(F.col("utc"), F.col("tz")))
    rows = local.select("region", "hour", "temp1", "temp_top3", F.hour("t").alias("localhour"), F.month("t").alias("month"), weekend(F.col("t")).alias("weekend01"))
    monthly = rows.groupBy("region", "month").agg(F.avg("temp_top3").alias("temp_monthly"))
    monthly = monthly.withColumn("ranked_month", F.row_number().over(Window.partitionBy("region").orderBy("temp_monthly", "month")))
    q = rows.groupBy("region").agg(F.percentile("temp1", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    q = q.select("region", F.col("q")[0].alias("temp1_qlow"), F.col("q")[1].alias("temp1_mean"), F.col("q")[2].alias("temp1_qhigh"))
    return rows.join(monthly, ["region", "month"]).join(q, "region").join(economics, "region")


def gathered(rows: DataFrame, o: DemandOptions) -> DataFrame:
    return VectorAssembler(inputCols=list(o.variables), outputCol="features").transform(rows)


def trees(o: DemandOptions, label: str, loss: str) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=o.rounds, maxDepth=o.depth, stepSize=o.eta, subsamplingRate=o.subsample, seed=o.seed, lossType=loss)


def train(rows: DataFrame, o: DemandOptions = DemandOptions(), label: str = "normdemand", loss: str = "squared", prepare: Callable[[DataFrame], DataFrame] | None = None) -> PipelineModel:
    """Gradient-boosted trees on the normalised demand.  ``loss`` is squared or absolute; ``prepare`` changes the
    training rows first."""
    held = gathered(prepare(rows) if prepare else rows, o)
    return PipelineModel([VectorAssembler(inputCols=list(o.variables), outputCol="features"), trees(o, label, loss).fit(held)])


def predicted(model: PipelineModel, rows: DataFrame, zone: DataFrame, hours_in_year: int) -> DataFrame:
    """(region, hour, mw) in UTC order."""
    out = model.transform(rows).join(zone.select("region", "offset", "population"), "region")
    mw = F.col("prediction") * F.col("demandpercapita") / 8760 * F.col("population")
    return shifted(out.select("region", "hour", "offset", mw.alias("mw")), ["region"], -F.col("offset"), hours_in_year).select("region", "hour", "mw")


def cross_validated(rows: DataFrame, o: DemandOptions = DemandOptions(), fold: str = "region", label: str = "normdemand", loss: str = "squared", prepare: Callable[[DataFrame], DataFrame] | None = None, at_once: int = 4) -> DataFrame:
    """Out-of-fold predictions, one region left out at a time (region, hour, normdemand, prediction).

    The features are gathered once and kept; ``at_once`` folds are trained side by side.  Folds are the
    values of one column, as many as there are regions.
    """
    held = gathered(rows, o).select(fold, "hour", label, "features").persist()
    folds = sorted(r[0] for r in held.select(fold).distinct().collect())

    def out_of(k) -> DataFrame:
        part = held.where(F.col(fold) != k)
        model = trees(o, label, loss).fit(prepare(part) if prepare else part)
        return model.transform(held.where(F.col(fold) == k)).select(fold, "hour", label, "prediction")

    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(out_of), folds))
    return reduce(DataFrame.unionByName, parts)


def save_training(rows: DataFrame, zone: DataFrame, path: str) -> None:
    """The feature table with its label, and the zones' offsets, for ``entry.demand_result``."""
    write_result(rows, f"{path}/rows", ("region",))
    write_result(zone, f"{path}/zones", ())


def scored(predictions: DataFrame, metric: Callable[[Column, Column], Column], label: str = "normdemand", by: str | None = None) -> DataFrame:
    """Any aggregate of truth and prediction as ``score``, of all rows or by a column."""
    grouped = predictions.groupBy(by) if by else predictions
    return grouped.agg(metric(F.col(label), F.col("prediction")).alias("score"))


def mean_absolute_error(predictions: DataFrame, label: str = "normdemand") -> DataFrame:
    return predictions.agg(F.avg(F.abs(F.col(label) - F.col("prediction"))).alias("mae"))
