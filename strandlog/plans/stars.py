"""Star-schema tables seen as entities and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: table: (key column, {predicate: (foreign key column, table it leads to)})
TABLES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"region": ("n_regionkey", "region")}),
    "customer": ("c_custkey", {"nation": ("c_nationkey", "nation")}),
    "supplier": ("s_suppkey", {"nation": ("s_nationkey", "nation")}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"customer": ("o_custkey", "customer")}),
}


def entity_id(table: str, key: Column) -> Column:
    return F.concat(F.lit(table + ":"), key.cast("string"))


def table_links(df: DataFrame, table: str) -> DataFrame:
    """``(dataset, subject, predicate, object, recorded)`` of one table's foreign keys."""
    key, fks = TABLES[table]
    out = None
    for predicate, (column, target) in fks.items():
        rows = df.where(F.col(column).isNotNull()).select(
            F.lit(table).alias("dataset"), entity_id(table, F.col(key)).alias("subject"), F.lit(predicate).alias("predicate"), entity_id(target, F.col(column)).alias("object"), F.lit(0).cast("bigint").alias("recorded")
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"{table} has no links")
    return out


def event_changes(events: DataFrame) -> DataFrame:
    """The event table as a change log: users are entities, errors tombstones, the value a property."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.lit("events").alias("dataset"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"),
        (micros * 1000).alias("recorded"),
        F.lit(0).alias("batch_seq"),
        (F.col("event_type") == "error").alias("deleted"),
        F.to_json(F.struct(F.col("event_type").alias("type"))).alias("props"),
        F.to_json(F.struct(F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("customer"))).alias("refs"),
    )
