"""Trees of places as intervals, and chains of redirects closed, both in a logarithmic number of joins.

A forest given as slug and parent is turned into its Euler tour: each place is entered and left once, in the order of the
tour, and `lo` and `hi` say when. What lies under a place is then what its interval holds: a range test instead of a walk.
The tour is a linked list of entries and exits, and places in it come from pointer doubling: in each round an element adds the
distance of the element it points at and points where that one points, so 2 ** k steps take k rounds. No round gathers a branch.
Joins of tables that grow with the places are hinted as merge joins: stored rounds are small for their rows, so Spark would
broadcast each of them, and the driver would get the whole list once a round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import key
from marketloom.sources.tables import kept


def closed(edges: DataFrame, start: str = "from_slug", end: str = "to_slug") -> DataFrame:
    """start, end, hops, cyclic: where each chain of redirects ends and after how many steps.

    A chain that comes to a cycle has no end: end and hops are null and cyclic is true. Of several redirects from one place the
    smallest holds; rows with a null on either side say nothing.
    """
    own = edges.select(F.col(start).alias("s"), F.col(end).alias("e")).filter("s IS NOT NULL AND e IS NOT NULL").groupBy("s").agg(F.min("e").alias("e"))
    state = kept(own.withColumn("hops", F.lit(1).cast("long")), "redirects")
    # No chain without a cycle has more steps than there are places, so what still moves after that many rounds is cyclic.
    rounds = math.ceil(math.log2(max(state.count(), 1))) + 1
    for _ in range(rounds):
        ahead = state.select(F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("hops").alias("_hops"))
        joined = state.join(ahead.hint("merge"), F.col("e") == F.col("_s"), "left")
        state = kept(joined.select("s", F.coalesce("_e", "e").alias("e"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_s").isNotNull().alias("moved")), "redirects")
        if state.filter("moved").isEmpty():
            break
    last = state.join(state.select(F.col("s").alias("_s")).hint("merge"), F.col("e") == F.col("_s"), "left")
    cyclic = F.col("_s").isNotNull()
    return last.select(F.col("s").alias(start), F.when(~cyclic, F.col("e")).alias(end), F.when(~cyclic, F.col("hops")).alias("hops"), cyclic.alias("cyclic"))


def ranked_list(elements: DataFrame) -> DataFrame:
    """e, place (from 0) of the elements of a linked list (e, next; null at the end)."""
    state = kept(elements.select("e", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")), "list")
    while not state.filter("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("e").alias("_e"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        joined = state.join(ahead.hint("merge"), F.col("next") == F.col("_e"), "left")
        state = kept(joined.select("e", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "list")
    return state.crossJoin(F.broadcast(state.agg(F.max("left").alias("_most")))).select("e", (F.col("_most") - F.col("left")).alias("place"))  # one row


def intervals(nodes: DataFrame, slug: str = "slug", parent: str = "parent") -> DataFrame:
    """slug, parent, root, depth, lo, hi, cyclic of each place; slugs are unique and not null.

    A place whose parent is null or unknown is a root. Places under a cycle have no interval, and cyclic is true.
    """
    rows = nodes.select(F.col(slug).alias("slug"), F.col(parent).alias("parent"))
    known = rows.select(F.col("slug").alias("_p"))
    rows = kept(rows.join(known.hint("merge"), F.col("parent") == F.col("_p"), "left").select("slug", F.col("_p").alias("parent")), "nodes")
    up = closed(rows, "slug", "parent").select(F.col("slug").alias("_s"), F.col("parent").alias("_root"), "hops", "cyclic")
    placed = kept(
        rows.join(up.hint("merge"), F.col("slug") == F.col("_s"), "left").select("slug", "parent", F.coalesce("_root", F.when(F.col("cyclic").isNull(), F.col("slug"))).alias("root"), F.coalesce("hops", F.when(F.col("cyclic").isNull(), F.lit(0))).alias("depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")),
        "forest",
    )
    good = placed.filter(~F.col("cyclic"))
    siblings = Window.partitionBy("parent").orderBy("slug")
    ordered = good.select("slug", "parent", F.lead("slug").over(siblings).alias("_sibling"), F.row_number().over(siblings).alias("_r"))
    first = ordered.filter("_r = 1 AND parent IS NOT NULL").select(F.col("parent").alias("_p"), F.col("slug").alias("_child"))
    linked = ordered.join(first.hint("merge"), F.col("slug") == F.col("_p"), "left")
    entry, leave = lambda c: F.struct(F.col(c).alias("slug"), F.lit(0).alias("end")), lambda c: F.struct(F.col(c).alias("slug"), F.lit(1).alias("end"))
    steps = F.array(
        F.struct(entry("slug").alias("e"), F.when(F.col("_child").isNotNull(), entry("_child")).otherwise(leave("slug")).alias("next")),
        F.struct(leave("slug").alias("e"), F.when(F.col("_sibling").isNotNull(), entry("_sibling")).when(F.col("parent").isNotNull(), leave("parent")).alias("next")),
    )
    places = ranked_list(linked.select(F.explode(steps).alias("x")).select("x.e", "x.next"))
    both = places.groupBy("e.slug").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).withColumnRenamed("slug", "_s")
    return placed.join(both.hint("merge"), F.col("slug") == F.col("_s"), "left").drop("_s")


def under(lo: Column, hi: Column, above_lo: Column, above_hi: Column) -> Column:
    """Whether an interval lies in another (or is it)."""
    return (lo >= above_lo) & (hi <= above_hi)


def descendants() -> Column:
    """How many places lie under one."""
    return ((F.col("hi") - F.col("lo") - 1) / 2).cast("long")


def _answered(asked: DataFrame, answers: DataFrame, question: list[str]) -> DataFrame:
    """Left join by a question, whose parts may be null."""
    same = F.lit(True)
    for c in question:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    told = [F.col(f"y.{c}") for c in answers.columns if c not in question]
    return asked.alias("x").join(answers.hint("merge").alias("y"), same, "left").select("x.*", *told)


def scoped(names: DataFrame, places: DataFrame, tree: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """id, slug, status for names (id, level, name, within) among places (slug, level, name, aliases).

    A name means a place of its level whose name or alias has the same key and that lies under `within` (a slug, or null for
    anywhere; redirected first, through chains of any length). Of several the one with the least depth, if it is alone there:
    resolved. Else ambiguous; outside if places of that name lie elsewhere only; missing if there are none, and unknown if
    `within` is no place. tree: intervals() of the places.
    """
    spans = tree.select("slug", "lo", "hi", "depth").filter("lo IS NOT NULL")
    entries = places.select("slug", "level", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a"))
    entries = entries.select("slug", "level", key(F.col("_a")).alias("_k")).filter("_k <> ''").distinct().join(spans.hint("merge"), "slug")
    asked = names.select("id", "level", key(F.coalesce("name", F.lit(""))).alias("_k"), "within")
    if redirects is not None:
        to = closed(redirects).filter(~F.col("cyclic")).select(F.col("from_slug").alias("_from"), F.col("to_slug").alias("_to"))
        asked = asked.join(to, F.col("within") == F.col("_from"), "left").withColumn("within", F.coalesce("_to", "within")).drop("_from", "_to")
    scope = spans.select(F.col("slug").alias("_w"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    asked = kept(asked, "asked")
    # What many names ask in the same words is looked up once.
    question = ["level", "_k", "within"]
    questions = kept(asked.select(*question).distinct().join(scope.hint("merge"), F.col("within") == F.col("_w"), "left").drop("_w"), "questions")
    inside = F.col("within").isNull() | under(F.col("lo"), F.col("hi"), F.col("_lo"), F.col("_hi"))
    hits = questions.join(entries.hint("merge"), ["level", "_k"]).withColumn("_in", F.coalesce(inside, F.lit(False)))
    least = F.min(F.when(F.col("_in"), F.struct("depth", "slug")))
    most = F.max(F.when(F.col("_in"), F.struct((-F.col("depth")).alias("d"), "slug")))
    found = hits.groupBy(*question).agg(least.alias("_a"), most.alias("_b"), F.lit(True).alias("_any"))
    out = _answered(questions, found, question)
    alone = F.col("_a.slug") == F.col("_b.slug")
    status = F.when(F.col("within").isNotNull() & F.col("_lo").isNull(), "unknown").when(alone, "resolved").when(F.col("_a").isNotNull(), "ambiguous").when(F.col("_any"), "outside").otherwise("missing")
    answers = out.select(*question, F.when(alone, F.col("_a.slug")).alias("slug"), status.alias("status"))
    return _answered(asked, answers, question).select("id", "slug", "status")
