"""Queries over a write-once registry of claims."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.operators import registry
from marketloom.sources.tables import registered, shared_dir, table

SCHEMA = "claim_id string, status string, depends_on string"


def _filled(spark, sf_dir) -> str:
    """A registry to which regions, nations and customers are added as claims; each batch holds the one before it again."""
    def claims(name, prefix, number, status, parent):
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(number).cast("string")).alias("claim_id"), status.alias("status"), parent.alias("depends_on"))

    path = registered(f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}")
    regions = claims("region", "R", "r_regionkey", F.lit("published"), F.lit(None).cast("string"))
    nations = claims("nation", "N", "n_nationkey", F.when(F.col("n_nationkey") == F.col("n_regionkey"), "retracted").otherwise("published"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    parents = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("; R0 ;")).otherwise(""))
    customers = claims("customer", "C", "c_custkey", F.when(F.col("c_acctbal") > 0, "published").otherwise("draft"), parents)
    registry.register(regions, path, "claim_id")
    registry.register(regions.withColumn("status", F.lit("draft")).unionByName(nations), path, "claim_id", strict=False)
    registry.register(nations.unionByName(customers), path, "claim_id", strict=False)
    return path


def registry_edges(spark, sf_dir):
    """What published claims depend on, out of a registry in which every id was written once."""
    return registry.edges(registry.read(spark, _filled(spark, sf_dir), SCHEMA))


QUERIES = {"registry_edges": registry_edges}
SQL = {
    "registry_edges": """
SELECT 'R' || n_regionkey AS "from", 'N' || n_nationkey AS "to", 'depends_on' AS type FROM nation WHERE n_nationkey <> n_regionkey
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'depends_on' FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'R0', 'C' || c_custkey, 'depends_on' FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'
"""
}
