"""The driver's tables as inputs of the library: plain SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

VIEWS = {
    "v_pixel": """SELECT p_partkey AS pixel_id, CAST(1 + p_partkey % 100 AS INT) AS lon_idx, CAST(1 + floor(p_partkey / 100.0) AS INT) AS lat_idx,
 CAST(floor((8*(1 + p_partkey % 100) + 224) / 225.0) AS INT) AS era_lon, CAST(floor((8*(1 + floor(p_partkey / 100.0)) + 224) / 225.0) AS INT) AS era_lat,
 CAST(CASE WHEN p_size % 10 = 0 THEN 32767 ELSE 1 + floor((p_partkey % 100) / 20.0) END AS INT) AS region,
 CAST(p_size % 17 AS INT) AS land, CAST(p_size % 11 AS INT) AS protected, CAST(p_partkey % 300 AS DOUBLE) AS popdens,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gridaccess, CAST(2.5 + (p_size % 16) * 0.5 AS DOUBLE) AS atlas, CAST(p_size * -2 AS DOUBLE) AS topo FROM part""",
    "v_cell_hour": """SELECT CAST(1 + user_id % 4 AS INT) AS era_lon, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, avg(value / 12.0) AS value, count(*) AS n FROM events GROUP BY 1, 2""",
    "v_turbine": """SELECT l_partkey AS pixel_id, l_quantity * 100.0 AS capac_kw, CAST(year(l_shipdate) AS INT) AS yr, l_linestatus = 'O' AS onshore FROM lineitem""",
    "v_region_name": """SELECT n_nationkey AS uid, r_name AS n0, n_name AS n1 FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_plant": """SELECT s_suppkey AS plant_id, CAST((s_suppkey * 37 % 360) - 179.5 AS DOUBLE) AS lon, CAST((s_suppkey * 53 % 180) - 89.5 AS DOUBLE) AS lat, abs(s_acctbal) / 10.0 AS capacity_mw, s_nationkey AS country FROM supplier""",
    "v_site": """SELECT c_custkey AS site_id, CAST((c_custkey * 71 % 360) - 179.25 AS DOUBLE) AS lon, CAST((c_custkey * 29 % 180) - 89.25 AS DOUBLE) AS lat, c_nationkey AS country FROM customer""",
    "v_month": """SELECT o_custkey % 50 AS cell, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, avg(o_totalprice / 20000.0) AS value FROM orders GROUP BY 1, 2, 3""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or one of the views, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(" ".join(f"{{{w}}}" if w in TABLES else w for w in VIEWS[name].split()), **{t: view(spark, sf_dir, t) for t in TABLES if t in VIEWS[name].split()})


def sql(body: str, *names: str) -> str:
    """SQL for DuckDB with the views it uses."""
    used = [n for n in VIEWS if n in body or n in names]
    views = ",\n".join(f"{n} AS ({VIEWS[n].replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for n in used)
    if not used:
        return body
    return f"WITH {views},\n{body.strip()[5:]}" if body.strip().startswith("WITH ") else f"WITH {views}\n{body}"
