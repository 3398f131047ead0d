"""Published documents as trees: every leaf of every document a row, rules as rows, releases compared leaf by leaf, and a gate.

A document is JSON of any shape. `leaves` takes it apart to any depth; a rule names leaves by pattern and says what must hold;
`broken` joins the two, so that a new rule is a row and not a new query. Comparisons between leaves (a sample and its total, a
new name and the old one) are equi-joins on the document and the other leaf's path, so that no document is gathered whole.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.tables import kept

KINDS = "regexp_extract(schema_of_variant(v), '^[A-Z]+', 0)"


def leaves(docs: DataFrame, key: list[str], document: str = "document", maps: tuple[str, ...] = ()) -> DataFrame:
    """key, path, pattern, names, kind, number, text: a row for each leaf of each document (a JSON string).

    path tells the leaf's place (pulse.metrics.rent.n, sizes[2].n); in pattern places in arrays are [*], and keys of an object
    whose pattern is among `maps` are *; names holds those keys. kind is the JSON type; number is null unless the leaf is one.
    Empty objects and arrays are leaves. Text that is no JSON is one leaf of kind INVALID with the text; a null document has
    none. Each round takes one level apart, so there are as many rounds as the deepest document has levels.
    """
    spark = docs.sparkSession
    parsed = docs.select(*key, F.col(document).alias("_t"), F.try_parse_json(document).alias("v")).filter("_t IS NOT NULL")
    top = parsed.select(*key, "v", F.lit("").alias("path"), F.lit("").alias("pattern"), F.array().cast("array<string>").alias("names"), F.when(F.col("v").isNull(), F.col("_t")).alias("_bad"))
    level, parts = top, []
    while True:
        level = kept(level.withColumn("kind", F.when(F.col("v").isNull(), "INVALID").otherwise(F.expr(KINDS))).withColumn("inner", F.expr("v IS NOT NULL AND cast(v AS string) NOT IN ('{}', '[]') AND kind IN ('OBJECT', 'ARRAY')")), "level")
        parts.append(level.filter(~F.col("inner")))
        if level.filter("inner").isEmpty():
            break
        below = level.filter("inner").withColumnsRenamed({"path": "_path", "pattern": "_pattern"}).drop("kind", "inner")
        each = below.withColumnRenamed("v", "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).withColumnsRenamed({"pos": "_pos", "key": "_key", "value": "v"}))
        dotted = lambda head, name: F.when(F.col(head) == "", name).otherwise(F.concat(F.col(head), F.lit("."), name))
        named = F.col("_pattern").isin(*maps) & F.col("_key").isNotNull() if maps else F.lit(False)
        in_list = F.col("_key").isNull()
        level = each.select(
            *key, "v",
            F.when(in_list, F.concat("_path", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(dotted("_path", F.col("_key"))).alias("path"),
            F.when(in_list, F.concat("_pattern", F.lit("[*]"))).when(named, dotted("_pattern", F.lit("*"))).otherwise(dotted("_pattern", F.col("_key"))).alias("pattern"),
            F.when(named, F.array_append("names", F.col("_key"))).otherwise(F.col("names")).alias("names"), F.lit(None).cast("string").alias("_bad"),
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    number = F.when(F.col("kind").isin("BIGINT", "DECIMAL", "DOUBLE"), F.expr("try_variant_get(v, '$', 'double')"))
    return out.select(*key, "path", "pattern", "names", "kind", number.alias("number"), F.coalesce("_bad", F.expr("try_variant_get(v, '$', 'string')")).alias("text"))


@dataclass(frozen=True)
class Rule:
    """What must hold of the leaves with a pattern. Tests:

    between: a number from low to high (either may be missing). one_of: the text is among known's keys. at_most, same_as: not
    over, or equal to, the leaf `other` (from the root, or a sibling if it starts with a dot); holds where that one is missing.
    named: the last key of a map is among known's keys. registered: the text is what known says of that key. unique: the value
    stands once under the pattern in a document. present: the document has such a leaf that is not null.
    """

    code: str
    level: str
    pattern: str
    test: str
    low: float | None = None
    high: float | None = None
    other: str | None = None
    known: dict[str, str] = field(default_factory=dict)


TESTS = {"between", "one_of", "at_most", "same_as", "named", "registered", "unique", "present"}
RULE = "code string, level string, pattern string, test string, low double, high double, other string, known map<string,string>"


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    unknown = {r.test for r in rules} - TESTS
    if unknown:
        raise ValueError(f"no such test: {sorted(unknown)}")
    as_double = lambda x: None if x is None else float(x)
    return spark.createDataFrame([astuple(replace(r, low=as_double(r.low), high=as_double(r.high))) for r in rules], RULE)


def broken(found: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """key, code, level, path, evidence: a row for each leaf (or document, for present) and rule that it breaks.

    found: a stored table of leaves. rules: rules_table(), as long as its author made it, so it is broadcast.
    """
    hits = found.join(F.broadcast(rules), "pattern")
    name = F.element_at("names", -1)
    text = F.coalesce("text", F.lit("null"))
    known = lambda x: F.coalesce(F.map_contains_key("known", x), F.lit(False))
    alone = (
        F.when(F.col("test") == "between", (F.coalesce(F.col("number").between(F.coalesce("low", "number"), F.coalesce("high", "number")), F.col("kind") == "VOID")) == F.lit(False))
        .when(F.col("test") == "one_of", ~known(text))
        .when(F.col("test") == "named", ~known(F.coalesce(name, F.lit(""))))
        .when(F.col("test") == "registered", known(name) & ~F.col("text").eqNullSafe(F.try_element_at("known", name)))
    )
    out = ["code", "level", "path", "evidence"]
    singles = hits.filter(alone).withColumn("evidence", text)
    # A map's key that is not known is one issue, whatever hangs below it.
    places = F.regexp_replace("pattern", r"[^*]*$", "")
    whole = hits.filter((F.col("test") == "named") & alone).select(*key, "code", "level", F.col("pattern"), name.alias("evidence")).distinct().select(*key, "code", "level", places.alias("path"), "evidence")
    singles = singles.filter("test <> 'named'").select(*key, *out).unionByName(whole)
    twice = hits.filter("test = 'unique'").groupBy(*key, "code", "level", "pattern", text.alias("evidence")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = twice.select(*key, "code", "level", F.col("pattern").alias("path"), "evidence")
    sibling = F.regexp_replace("path", r"[^.]*$", "")
    target = F.when(F.col("other").startswith("."), F.concat(sibling, F.substr("other", F.lit(2)))).otherwise(F.col("other"))
    pairs = hits.filter("test IN ('at_most', 'same_as')").withColumn("_to", target)
    others = found.select(*key, F.col("path").alias("_to"), F.col("number").alias("_number"), F.col("text").alias("_text"))
    differ = F.when(F.col("test") == "at_most", F.col("number") > F.col("_number")).otherwise(~F.coalesce(F.col("number") == F.col("_number"), F.col("text").eqNullSafe(F.col("_text"))))
    against = pairs.join(others, [*key, "_to"]).filter(differ).select(*key, "code", "level", "path", F.concat_ws(" / ", text, F.coalesce("_text", F.lit("null"))).alias("evidence"))
    needed = rules.filter("test = 'present'").select("code", "level", F.col("pattern").alias("path"))
    there = hits.filter("test = 'present' AND kind <> 'VOID'").select(*key, "code", "level", F.col("pattern").alias("path")).distinct()
    wanted = found.select(*key).distinct().join(F.broadcast(needed), F.lit(True))  # a row a document and required leaf
    missing = wanted.join(there, [*key, "code", "level", "path"], "left_anti").withColumn("evidence", F.lit("missing"))
    return singles.unionByName(twice).unionByName(against).unionByName(missing)


def moved(now: DataFrame, before: DataFrame, key: list[str], limits: dict[str, float]) -> DataFrame:
    """key, path, before, now, change_pct: figures that moved by their pattern's limit (per cent) or more since the last release,
    and those that came or went (change_pct null). A figure that was 0 is passed over."""
    picked = lambda df, v: df.filter(F.col("pattern").isin(*limits) & F.col("number").isNotNull()).select(*key, "path", "pattern", F.col("number").alias(v))
    both = picked(now, "now").join(picked(before, "before"), [*key, "path", "pattern"], "full_outer")
    change = F.when(F.col("before") != 0, 100.0 * (F.col("now") - F.col("before")) / F.abs("before"))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("pattern")]
    odd = F.col("now").isNull() | F.col("before").isNull() | (F.abs(change) >= limit)
    return both.withColumn("change_pct", change).filter(odd).select(*key, "path", "before", "now", "change_pct")


def moved_issues(moves: DataFrame, key: list[str], level: str = "WARN") -> DataFrame:
    """The moves as issues, like those of broken()."""
    code = F.when(F.col("now").isNull(), "FIGURE_GONE").when(F.col("before").isNull(), "FIGURE_NEW").otherwise("LARGE_RELEASE_DELTA")
    return moves.select(*key, code.alias("code"), F.lit(level).alias("level"), "path", F.format_number(F.coalesce("change_pct", F.lit(0.0)), 1).alias("evidence"))


def status(issues: DataFrame) -> DataFrame:
    """One row: status (PASS, PASS_WITH_WARNINGS, FAIL), failures, warnings."""
    counts = issues.agg(F.count_if(F.col("level") == "FAIL").alias("failures"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    return counts.select(F.when(F.col("failures") > 0, "FAIL").when(F.col("warnings") > 0, "PASS_WITH_WARNINGS").otherwise("PASS").alias("status"), "failures", "warnings")


def gated(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """docs, unless an issue is a FAIL: then reading or writing them raises an error, in the tasks, before a row is handed on."""
    failures = issues.agg(F.count_if(F.col("level") == "FAIL").alias("failures"))
    stop = F.raise_error(F.concat(F.lit("documents break rules: "), F.col("_failures").cast("string")))
    checked = docs.withColumn("_failures", failures.scalar()).withColumn("_stop", F.when(F.col("_failures") > 0, stop))
    return checked.filter(F.col("_stop").isNull()).drop("_failures", "_stop")


# Limits of movements between releases, and of drops of a coverage in points.
WARN_PCT, RED_PCT, LEAST_SAMPLE, WARN_POINTS, RED_POINTS = 20.0, 45.0, 100, 8.0, 20.0
COVERAGE = "coverage."


def sanity(now: DataFrame, before: DataFrame) -> DataFrame:
    """metric, before, now, change, level for metrics (metric, value, sample_n) of two releases that are not GREEN.

    Metrics are compared in per cent, with limits half as wide again for small samples; those called coverage.… in points, and
    only drops count. A metric that one release lacks, or that was 0, is passed over. No metrics before: nothing to compare.
    """
    both = now.join(before.select("metric", F.col("value").alias("before")), "metric").filter("value IS NOT NULL AND before IS NOT NULL")
    share = F.col("metric").startswith(COVERAGE)
    change = F.when(share, F.col("value") - F.col("before")).when(F.col("before") != 0, 100.0 * (F.col("value") - F.col("before")) / F.abs("before"))
    ease = F.when(F.col("sample_n") < LEAST_SAMPLE, 1.5).otherwise(1.0)
    off = F.when(share, -F.col("change")).otherwise(F.abs("change"))
    limit: dict[str, Column] = {"RED": F.when(share, RED_POINTS).otherwise(RED_PCT * ease), "YELLOW": F.when(share, WARN_POINTS).otherwise(WARN_PCT * ease)}
    level = F.when(off >= limit["RED"], "RED").when(off >= limit["YELLOW"], "YELLOW")
    return both.withColumn("change", change).withColumn("level", level).filter(F.col("level").isNotNull()).select("metric", "before", F.col("value").alias("now"), "change", "level")
