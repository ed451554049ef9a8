"""Cadastral views of the star-schema tables, in SQL that Spark and DuckDB both run, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: View texts. A view may use tables only.
VIEWS = {
    "parcels": """
        SELECT c_custkey AS suid, 77.0E0 + (c_custkey % 40) * 0.013E0 AS x, 28.0E0 + floor(c_custkey / 40) * 0.013E0 AS y
        FROM customer""",
    "parties": """
        SELECT concat('c', cast(c_custkey AS string)) AS pid, c_name AS name,
               CASE WHEN c_custkey % 10 = 0 THEN 'group' ELSE 'person' END AS type, c_mktsegment AS identifier
        FROM customer
        UNION ALL
        SELECT concat('s', cast(s_suppkey AS string)), s_name, 'organization', cast(s_nationkey AS string) FROM supplier""",
    "rights": """
        SELECT cast(n_nationkey AS bigint) AS rid,
               CASE n_nationkey % 5 WHEN 0 THEN 'ownership' WHEN 1 THEN 'lease' WHEN 2 THEN 'easement' WHEN 3 THEN 'mortgage' ELSE 'restriction' END AS type,
               cast(1 AS bigint) AS share_numerator, cast(n_regionkey + 1 AS bigint) AS share_denominator
        FROM nation""",
    "survey_sources": """
        SELECT s_suppkey AS source_id,
               CASE s_suppkey % 6 WHEN 0 THEN 'lidar' WHEN 1 THEN 'drone' WHEN 2 THEN 'gnss' WHEN 3 THEN 'floorplan' WHEN 4 THEN 'bim' ELSE 'cadastral' END AS type,
               abs(s_acctbal) / 1000.0E0 AS accuracy_xy
        FROM supplier""",
    "spatial_units": """
        SELECT l_orderkey * 10 + l_linenumber AS suid, l_orderkey AS parent_suid, l_linenumber - 2 AS floor_level,
               CASE l_linenumber % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'floor' WHEN 2 THEN 'building' ELSE 'parcel' END AS type,
               (l_linenumber - 2) * 3.0E0 AS z_min,
               (l_linenumber - 2) * 3.0E0 + CASE WHEN min(l_suppkey) % 5 = 0 THEN 2.5E0 WHEN min(l_suppkey) % 7 = 0 THEN 3.5E0 ELSE 3.0E0 END AS z_max,
               (l_orderkey % 1000) * 10.0E0 + CASE WHEN min(l_partkey) % 3 = 0 THEN 4.0E0 ELSE 0.0E0 END AS minx,
               (l_orderkey % 1000) * 10.0E0 + CASE WHEN min(l_partkey) % 3 = 0 THEN 8.0E0 ELSE 4.0E0 END AS maxx,
               floor(l_orderkey / 1000) * 10.0E0 AS miny,
               floor(l_orderkey / 1000) * 10.0E0 + CASE WHEN min(l_partkey) % 11 = 0 THEN 9.0E0 ELSE 6.0E0 END AS maxy,
               min(l_suppkey) AS source_id
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "rrr": """
        SELECT o_orderkey AS rrr_id, concat('c', cast(o_custkey AS string)) AS party_ref, o_orderkey % 25 AS right_ref, o_orderkey AS spatial_unit_ref,
               cast(o_orderdate AS date) AS valid_from,
               CASE WHEN o_orderkey % 3 = 0 THEN cast(NULL AS date) ELSE cast(o_orderdate AS date) + cast(o_orderkey % 900 AS int) END AS valid_until,
               CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'historical' ELSE 'pending' END AS status
        FROM orders""",
    "points": """
        SELECT l_orderkey % 16 AS cloud_id, l_orderkey * 10 + l_linenumber AS pt_id, min(l_partkey) * 1.0E0 AS x, min(l_suppkey) * 1.0E0 AS y,
               min(l_quantity) AS z, l_linenumber AS return_number,
               CASE min(l_returnflag) WHEN 'A' THEN 2 WHEN 'N' THEN 6 ELSE 1 END AS classification
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "buildings": """
        SELECT p_partkey AS building_id, p_size * 1.0E0 AS width, (p_partkey % 37 + 8) * 1.0E0 AS height_y,
               cast(p_partkey % 9 + 1 AS int) AS levels,
               CASE p_partkey % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'mixed' WHEN 3 THEN 'apartments'
                    WHEN 4 THEN 'industrial' WHEN 5 THEN 'hospitality' WHEN 6 THEN 'institutional' ELSE 'unknown' END AS building_type,
               p_size * p_retailprice AS area
        FROM part""",
}

#: Tables of views that are dealt before they are grouped, by which columns; and about how many rows a part has.
DEALT = {"points": {"lineitem": ("l_orderkey", "l_linenumber")}}
PART_ROWS = 500_000


def with_views(sql: str) -> str:
    """`sql` with the texts of the views that it names, for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ahead = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ahead + ', ' if ahead else ''}{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {ahead + ', ' if ahead else ''}{sql[5:]}"
    return (f"WITH {ahead} " if ahead else "") + sql


class Tables:
    """The driver's tables and the cadastral views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if re.search(rf"\bFROM {t}\b", text)}
        if name in DEALT:
            used |= {t: self._dealt(used[t], keys) for t, keys in DEALT[name].items()}
        for t in used:
            text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
        return self.spark.sql(text, **used)

    def _dealt(self, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """A table dealt by the keys that a view groups by, into parts of bounded size however large it is: they are grouped there at once."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-table.count() // PART_ROWS))
        return table.repartition(parts, *keys)


Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables as a named query, with its SQL counterpart over tables and views."""

    def registered(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[function.__name__] = (lambda spark, sf_dir: function(Tables(spark, sf_dir)), with_views(sql) if sql else None)
        return function

    return registered
