"""Claims and their dependencies, evaluation against labels, research value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators import dedup
from marketloom.operators.graph import reachable

# Strengths of a claim's marks, and scores of impact and uncertainty.
EVIDENCE = {"A": 1.0, "B": 0.85, "C": 0.65, "D": 0.4, "E": 0.2}
MATURITY = {"M0": 0.25, "M1": 0.5, "M2": 0.75, "M3": 0.9, "M4": 1.0}
STRUCTURE = {"structural": 1.5, "descriptive": 1.0, "method": 0.8}


def _strength(column: str, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(column)], F.lit(default))


def dependencies(claims: DataFrame) -> DataFrame:
    """parent, child of every dependency, from the ;-separated list."""
    parts = F.filter(F.transform(F.split(F.coalesce("depends_on", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return claims.select(F.explode(parts).alias("parent"), F.col("claim_id").alias("child")).distinct()


def missing_parents(claims: DataFrame) -> DataFrame:
    return dependencies(claims).join(claims.select(F.col("claim_id").alias("parent")), "parent", "left_anti")


def descendants(claims: DataFrame, of: DataFrame) -> DataFrame:
    """root, node, depth of all that depends on the claims `of` (claim_id), however far."""
    return reachable(dependencies(claims), of.select(F.col("claim_id").alias("node")))


def ancestors(claims: DataFrame, of: DataFrame) -> DataFrame:
    turned = dependencies(claims).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return reachable(turned, of.select(F.col("claim_id").alias("node")))


def impacted(claims: DataFrame, direct: Column) -> DataFrame:
    """claim_id, how: the claims a change touches directly, and those that depend on them."""
    hit = claims.filter(direct).select("claim_id")
    later = descendants(claims, hit).select(F.col("node").alias("claim_id")).distinct().join(hit, "claim_id", "left_anti")
    return hit.withColumn("how", F.lit("direct")).union(later.withColumn("how", F.lit("transitive")))


def active(claims: DataFrame) -> DataFrame:
    return claims.filter(~F.coalesce("status", F.lit("")).isin("superseded", "retracted"))


def with_quality(claims: DataFrame, replicated: DataFrame, impact: dict[str, float]) -> DataFrame:
    """Adds quality: impact, evidence, maturity, structure and replication multiplied; nothing unless published."""
    again = replicated.select("claim_id").distinct().withColumn("_again", F.lit(1.2))
    score = _strength("impact", impact, 3.0) / 5 * _strength("evidence_grade", EVIDENCE, 0.65) * _strength("maturity", MATURITY, 0.25) * _strength("structure", STRUCTURE, 1.0)
    joined = claims.join(again, "claim_id", "left")
    return joined.withColumn("quality", F.when(F.col("status") == "published", F.round(score * F.coalesce("_again", F.lit(1.0)), 4)).otherwise(0.0)).drop("_again")


def superseded(claims: DataFrame, old_id: str, new: DataFrame) -> DataFrame:
    """The registry with the old claim marked and the new one appended; nothing else changes."""
    mark = F.col("claim_id") == old_id
    successor = new.agg(F.min("claim_id").alias("_new"))  # one row
    marked = claims.join(F.broadcast(successor), F.lit(True), "left")
    marked = marked.withColumns({"status": F.when(mark, "superseded").otherwise(F.col("status")), "superseded_by": F.when(mark, F.col("_new")).otherwise(F.col("superseded_by"))}).drop("_new")
    return marked.unionByName(new, allowMissingColumns=True)


def next_id(claims: DataFrame, prefix: str = "C", width: int = 3) -> DataFrame:
    top = F.coalesce(F.max(F.regexp_extract("claim_id", r"(\d+)$", 1).try_cast("int")), F.lit(0)) + 1
    return claims.agg(F.concat(F.lit(prefix), F.lpad(top.cast("string"), width, "0")).alias("claim_id"))


def value_of_information(impact: Column, uncertainty: Column, hours: Column, least: float = 0.5) -> Column:
    return F.round(impact * uncertainty / F.greatest(hours, F.lit(least)), 4)


def accuracy(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, correct, rate: parsed_<field> against correct_<field>, each over the rows that have a label."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    cells = [
        F.struct(F.lit(f).alias("field"), (~blank(F.col(f"correct_{f}"))).alias("has"), (F.lower(F.trim(f"parsed_{f}")) == F.lower(F.trim(f"correct_{f}"))).alias("same")) for f in fields
    ]
    long = rows.select(F.explode(F.array(*cells)).alias("c")).filter("c.has")
    out = long.groupBy("c.field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("c.same", F.lit(False))).alias("correct"))
    return out.withColumn("rate", F.round(F.col("correct") / F.col("n"), 4))


def benchmark(scored: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of labelled pairs: is_duplicate, hit (found by the score), w (how many pairs a row stands for)."""
    n = lambda d, h: F.coalesce(F.sum(F.when((F.col("is_duplicate") == d) & (F.col("hit") == h), F.col("w"))), F.lit(0))
    tp, fp, fn = n(True, True), n(False, True), n(True, False)
    ratio = lambda a, b: F.round(F.try_divide(a, F.nullif(a + b, F.lit(0))), 4)
    return scored.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), n(False, False).alias("tn"), ratio(tp, fp).alias("precision"), ratio(tp, fn).alias("recall"))


def pair_benchmark(pairs: DataFrame, threshold: float, weight: Column | None = None) -> DataFrame:
    """The benchmark of the pair score over labelled pairs (structs x and y, is_duplicate), each of which stands for `weight` pairs."""
    return benchmark(pairs.select(F.col("is_duplicate"), (dedup.pair_score("x", "y") >= threshold).alias("hit"), (F.lit(1) if weight is None else weight).cast("long").alias("w")))


def readiness(report: dict, most_rent: float = 15.0, most_sale: float = 30.0, least_rows: int = 20) -> list[str]:
    """What keeps a valuation report from release; an empty list lets it through."""
    out = []
    if report.get("evaluated", 0) < least_rows:
        out.append("too few evaluated rows")
    for kind, most in (("rent", most_rent), ("sale", most_sale)):
        got = report.get(f"{kind}_mdape")
        if got is not None and got > most:
            out.append(f"{kind} error over {most}")
    return out
