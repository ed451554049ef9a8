"""The catalogue's tables: their schemas, how they are created and checked, and the table functions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotstack.operators import constraints, topology

#: Columns of each table; the first is its key. `metadata` is a flat map of texts.
TABLES = {
    "party": "pid STRING, name STRING NOT NULL, type STRING NOT NULL, identifier STRING, metadata MAP<STRING, STRING>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "right": "rid STRING, type STRING NOT NULL, share_numerator INT, share_denominator INT, description STRING, metadata MAP<STRING, STRING>, created_at TIMESTAMP",
    "spatial_unit": (
        "suid STRING, code STRING NOT NULL, label STRING, type STRING NOT NULL, geometry STRING NOT NULL, z_min DOUBLE NOT NULL, z_max DOUBLE NOT NULL, floor_level INT, "
        "parent_suid STRING, source_id STRING, accuracy_xy DOUBLE, accuracy_z DOUBLE, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE, "
        "metadata MAP<STRING, STRING>, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "rrr": (
        "rrr_id STRING, party_ref STRING NOT NULL, right_ref STRING NOT NULL, spatial_unit_ref STRING NOT NULL, valid_from DATE NOT NULL, valid_until DATE, status STRING, "
        "metadata MAP<STRING, STRING>, created_at TIMESTAMP"
    ),
    "survey_source": (
        "source_id STRING, type STRING NOT NULL, acquisition_date DATE, crs STRING NOT NULL, accuracy_xy DOUBLE, accuracy_z DOUBLE, file_path STRING, processing_status STRING, "
        "metadata MAP<STRING, STRING>, created_at TIMESTAMP"
    ),
    "topology_tetra": "tet_id BIGINT, suid_1 STRING NOT NULL, suid_2 STRING NOT NULL, shared_face STRING, relationship STRING NOT NULL, metadata MAP<STRING, STRING>, created_at TIMESTAMP",
    "code_sequence": "id INT, component STRING NOT NULL, current_value BIGINT, max_value BIGINT NOT NULL",
}
#: How a table is laid out on disk, where scans of one value are the rule.
PARTITIONS = {"spatial_unit": "type", "rrr": "status"}
#: (table, unique columns) and (table, column, parent, key), which no storage enforces.
UNIQUE = (("spatial_unit", ("code",)), ("topology_tetra", ("suid_1", "suid_2")), ("code_sequence", ("component",)))
FOREIGN = (
    ("spatial_unit", "parent_suid", "spatial_unit", "suid"),
    ("spatial_unit", "source_id", "survey_source", "source_id"),
    ("rrr", "party_ref", "party", "pid"),
    ("rrr", "right_ref", "right", "rid"),
    ("rrr", "spatial_unit_ref", "spatial_unit", "suid"),
)


def create_tables(spark: SparkSession, database: str) -> None:
    """Create the database and its tables, as Parquet; those that are there stay."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        by = f" PARTITIONED BY ({PARTITIONS[name]})" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.`{name}` ({columns}) USING parquet{by}")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.`{name}`")


def violations(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that break a unique or a foreign key, by the rule's name, for the tables given."""
    out = {f"unique {t}({', '.join(c)})": constraints.duplicates(tables[t], *c) for t, c in UNIQUE if t in tables}
    for child, column, parent, key in FOREIGN:
        if child in tables and parent in tables:
            out[f"foreign {child}.{column}"] = constraints.orphans(tables[child], column, tables[parent], key)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a relational store, read by ranges of a column; filters and columns are pushed down to it."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", at_once: int = 10_000, parts: int = 8) -> None:
    """Rows into a table of a relational store, by at most `parts` connections; each commits its own rows, or none of them."""
    df.coalesce(parts).write.option("batchsize", at_once).option("isolationLevel", "READ_COMMITTED").jdbc(url, table, mode)


def register_validators(spark: SparkSession, units: DataFrame) -> None:
    """Table functions over `units`: validate_vertical_continuity, validate_3d_adjacency and validate_boundary_alignment."""
    units.createOrReplaceTempView("validated_units")
    topology.adjacency(units).createOrReplaceTempView("validated_adjacency")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION validate_vertical_continuity(tolerance DOUBLE) RETURNS TABLE (upper_suid BIGINT, lower_suid BIGINT, gap DOUBLE) RETURN "
        "SELECT a.suid, b.suid, a.z_min - b.z_max FROM validated_units a JOIN validated_units b ON a.parent_suid = b.parent_suid AND a.floor_level = b.floor_level + 1 "
        "WHERE abs(a.z_min - b.z_max) > validate_vertical_continuity.tolerance"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION validate_3d_adjacency() RETURNS TABLE (suid_1 BIGINT, suid_2 BIGINT, relation STRING) RETURN "
        "SELECT suid_1, suid_2, relation FROM validated_adjacency"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION validate_boundary_alignment(tolerance DOUBLE) RETURNS TABLE (suid BIGINT, parent_suid BIGINT) RETURN "
        "SELECT c.suid, c.parent_suid FROM validated_units c JOIN validated_units p ON p.suid = c.parent_suid "
        "WHERE c.minx < p.minx - tolerance OR c.miny < p.miny - tolerance OR c.maxx > p.maxx + tolerance OR c.maxy > p.maxy + tolerance"
    )
