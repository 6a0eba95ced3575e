"""A lattice city derived from the star-schema tables, and the same city in SQL.

Parts are nodes of a lattice, customers are origins, suppliers are destinations, nations are
obstacles and observers.  Ids are arithmetic on keys, so nothing is ranked or sorted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.staging import bound_broadcasts


@dataclass(frozen=True)
class City:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        bound_broadcasts(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("part").count()

    @property
    def w(self) -> int:
        return math.floor(math.sqrt(self.n))

    @property
    def nodes(self) -> DataFrame:
        """node_id, x, y, z."""
        p, w = F.col("p_partkey"), self.w
        return self.table("part").select(
            p.alias("node_id"), (p % w * 100).cast("double").alias("x"), (F.floor(p / w) * 100).cast("double").alias("y"),
            F.col("p_size").cast("double").alias("z"),
        )

    @property
    def edges(self) -> DataFrame:
        """edge_id, u, v, length, weight: neighbours to the right and below."""
        p, w, n = F.col("p_partkey"), self.w, self.n
        ends = F.array(
            F.when((p % w < w - 1) & (p + 1 < n), F.struct((2 * p).alias("edge_id"), p.alias("u"), (p + 1).alias("v"))),
            F.when(p + w < n, F.struct((2 * p + 1).alias("edge_id"), p.alias("u"), (p + w).alias("v"))),
        )
        out = self.table("part").select(F.explode(F.array_compact(ends)).alias("e")).select("e.*")
        return out.select("*", F.lit(100.0).alias("length"), (100 + F.col("edge_id") * 7919 % 41).cast("double").alias("weight"))

    def points(self, table: str, key: str, a: int, b: int, weight) -> DataFrame:
        """pt_id, weight, edge_id, u, v, w_start, w_end, frac: one point on the network per row of the table."""
        n, w = self.n, self.w
        q = F.col("q")
        edge = F.when((q % w < w - 1) & (q + 1 < n), 2 * q).when(q + w < n, 2 * q + 1).when(q % w > 0, 2 * (q - 1)).otherwise(2 * (q - w) + 1)
        k = F.col(key).cast("long")
        rows = self.table(table).select(
            k.alias("pt_id"), weight.alias("pt_weight"), (k * a % n).alias("q"), ((k * b % 97 + 1) / 100.0).alias("frac")
        ).withColumn("edge_id", edge)
        on = self.edges.withColumnRenamed("weight", "cost").drop("length")
        return rows.join(on, "edge_id").select(
            "pt_id", F.col("pt_weight").alias("weight"), "edge_id", "u", "v",
            (F.col("cost") * F.col("frac")).alias("w_start"), (F.col("cost") * (1 - F.col("frac"))).alias("w_end"), "frac",
        )

    @property
    def origins(self) -> DataFrame:
        return self.points("customer", "c_custkey", 31, 17, F.abs("c_acctbal"))

    @property
    def destinations(self) -> DataFrame:
        return self.points("supplier", "s_suppkey", 131, 29, F.abs("s_acctbal"))

    @property
    def obstacles(self) -> DataFrame:
        """Points with a penalty and a direction."""
        out = self.points("nation", "n_nationkey", 97, 41, F.lit(1.0))
        k = F.col("pt_id")
        return out.withColumns({"penalty": (10 + k).cast("double"), "direction": F.when(k % 3 == 0, "both").when(k % 3 == 1, "ab").otherwise("ba")})

    @property
    def observers(self) -> DataFrame:
        return self.points("nation", "n_nationkey", 61, 53, F.lit(1.0))


def _points_sql(name: str, table: str, key: str, a: int, b: int, weight: str) -> str:
    return f"""{name} AS (
  SELECT q.pt_id, q.pt_weight AS weight, e.edge_id, e.u, e.v, e.weight * q.frac AS w_start, e.weight * (CAST(1 AS DOUBLE) - q.frac) AS w_end, q.frac
  FROM (
    SELECT pt_id, pt_weight, frac, CASE WHEN q % w < w - 1 AND q + 1 < n THEN 2 * q WHEN q + w < n THEN 2 * q + 1
                                        WHEN q % w > 0 THEN 2 * (q - 1) ELSE 2 * (q - w) + 1 END AS edge_id
    FROM (SELECT CAST({key} AS BIGINT) AS pt_id, CAST({weight} AS DOUBLE) AS pt_weight, CAST({key} AS BIGINT) * {a} % n AS q,
                 CAST(CAST({key} AS BIGINT) * {b} % 97 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS frac, n, w FROM {table}, k)
  ) q JOIN edges e ON e.edge_id = q.edge_id
)"""


#: Common table expressions of the same city: k, nodes, edges, origins, destinations, obstacles, observers.
CITY_SQL = f"""
k AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part),
nodes AS (SELECT p_partkey AS node_id, CAST(p_partkey % w * 100 AS DOUBLE) AS x, CAST(p_partkey // w * 100 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part, k),
edges AS (
  SELECT edge_id, u, v, CAST(100 AS DOUBLE) AS length, CAST(100 + edge_id * 7919 % 41 AS DOUBLE) AS weight FROM (
    SELECT 2 * p_partkey AS edge_id, p_partkey AS u, p_partkey + 1 AS v FROM part, k WHERE p_partkey % w < w - 1 AND p_partkey + 1 < n
    UNION ALL SELECT 2 * p_partkey + 1, p_partkey, p_partkey + w FROM part, k WHERE p_partkey + w < n)
),
{_points_sql("origins", "customer", "c_custkey", 31, 17, "abs(c_acctbal)")},
{_points_sql("destinations", "supplier", "s_suppkey", 131, 29, "abs(s_acctbal)")},
{_points_sql("nation_points", "nation", "n_nationkey", 97, 41, "1")},
obstacles AS (SELECT *, CAST(10 + pt_id AS DOUBLE) AS penalty, CASE pt_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'ab' ELSE 'ba' END AS direction FROM nation_points),
{_points_sql("observers", "nation", "n_nationkey", 61, 53, "1")}
"""
