"""Near duplicates: bottom-k sketches of one hash function, inverted lists of the values kept, exact Jaccard.

1. A text's shingles are hashed once with one function; the sketch is the k least hashes. Texts with equal sets form
   a class, and only classes go on.
2. Two sets over the threshold share at least r of their sketch values (a binomial bound, exact for sets that fit in
   the sketch). So it is enough to list each class under its s - r + 1 rarest values: two similar classes meet in one
   list at least. Values of one class need no list, and those of a passage that thousands share come last.
3. Every member of a list is compared with the list's leader, the class whose values are the most common; lists that lie in
   one component by then are done. In the others, the members outside the list's largest component are compared with one
   another and with that component in blocks of bounded size. A task filters the pairs of two blocks as step 4 does and
   returns the few links that join components. No pair of two blocks becomes a row, and none is left out.
4. The union sketch of a pair estimates its Jaccard similarity; pairs that may reach the threshold are confirmed on full sets.

A class is named by its smallest doc_id; classes of rows without an id get numbers above all ids, so they are linked like others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, documents, frequent_keys, gram_hashes, hashes, row_numbers, spread, stored, text_of, with_salt, words
from marketloom.operators import graph

SKETCH = 64
#: Chance that a pair just at the threshold is missed for want of shared sketch values.
MISS = 1e-6
#: Classes in a block, on average, and set elements of a block: whichever makes more blocks.
BLOCK = 512
ELEMENTS = 1 << 20
#: Set elements that a block's matrix holds at once, and pairs whose union sketches are.
COLUMNS = 4_096
PAIRS = 16_384
#: Ids of candidate classes are broadcast up to this number (8 bytes each), and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000


def least_shared(k: int, num: int, den: int, miss: float = MISS) -> int:
    """The largest r for which fewer than r of k draws hit with chance below `miss`, at hit rate num / den."""
    t, below = num / den, 0.0
    for r in range(k + 1):
        below += math.comb(k, r) * t**r * (1 - t) ** (k - r)
        if below > miss:
            return r
    return k


def needed(size: Column, k: int, num: int, den: int) -> Column:
    """Sketch values that a sketch of this size shares with that of any similar set."""
    exact = F.ceil(size * num / F.lit(den))
    return F.when(size * den <= k * num, exact).otherwise(F.lit(min(least_shared(k, num, den), -(-k * num // den)))).cast("int")


def _shingles(tokens: Column, width: int) -> Column:
    """Distinct hashes of `width` consecutive words; of the whole sequence if there are fewer; empty without words."""
    return F.when(F.size(tokens) == 0, tokens).when(F.size(tokens) < width, F.array(F.xxhash64(tokens))).otherwise(F.array_distinct(gram_hashes(tokens, width)))


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and set (sorted hashes); each step a column of its own, so that none is computed twice."""
    tokens = docs.select("doc_id", hashes(words(ascii_lower(text_of("text")))).alias("_t"))
    return tokens.select("doc_id", F.sort_array(_shingles(F.col("_t"), width)).alias("set"))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprints of the set), sketch."""
    return with_sets(docs, width).select(
        "doc_id", F.size("set").alias("n"), F.xxhash64("set").alias("f1"), F.hash("set").alias("f2"), F.slice("set", 1, k).alias("sketch")
    )


def index_lists(nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """value, node, n, typical: each class under the rarest of its sketch values, as far as another class has them.

    typical is the mean number of classes that have one of its values, in thousandths.
    """
    postings = nodes.select("node", F.explode("sketch").alias("value"))
    shared = stored(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    per_node = postings.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"))
    sized = nodes.select("node", "n", F.size("sketch").alias("s"))
    # Values of no other class are the rarest and fill the first places.
    places = F.col("s") - needed(F.col("s"), k, num, den) + 1 - (F.col("s") - F.size("common"))
    listed = per_node.join(sized, "node").withColumn("_places", places).filter("_places > 0")
    held = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    typical = F.floor(held * 1000 / F.col("s")).cast("long")
    return listed.select("node", "n", typical.alias("typical"), F.explode(F.slice("common", F.lit(1), F.col("_places"))).alias("c")).select("c.value", "node", "n", "typical").distinct()


def alike_in_size(n: str, m: str, num: int, den: int) -> Column:
    return F.least(F.col(n), F.col(m)) * den >= F.greatest(F.col(n), F.col(m)) * num


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def leader_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each member and its list's leader. Members of one group meet the same few leaders in all their lists."""
    heads = lists.groupBy("value").agg(F.max(F.struct("typical", "node", "n")).alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    heads = stored(heads.select("value", F.col("head.node").alias("y"), F.col("head.n").alias("m")), "heads")
    met = lists.join(heads, "value").filter(F.col("node") != F.col("y")).filter(alike_in_size("n", "m", num, den))
    return _ordered(met.select(F.col("node").alias("x"), "y"))


def block_members(lists: DataFrame) -> DataFrame:
    """g, kind, i, j, left, right, node, comp: the blocks that each class is compared in.

    g is the largest component of a list in which there are others. Its group are the classes of such lists: those outside
    it, in blocks that meet one another (kind 0), and those inside, in blocks that meet the blocks outside (kind 1).
    """
    parts = lists.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
    # A list of two has been compared by its leader.
    main = parts.groupBy("value").agg(F.max(F.struct("c", "comp"))["comp"].alias("g"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("c")).filter("k > 1 AND c > 2")
    members = lists.join(stored(main.select("value", "g"), "main"), "value").select("g", "node", "comp", "n").distinct()
    inside = F.col("comp") == F.col("g")
    blocks = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) / ELEMENTS)).cast("int")
    counts = members.groupBy("g").agg(blocks(~inside).alias("no"), blocks(inside).alias("ni"))
    members = members.drop("n")
    dealt = members.join(counts, "g")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cell = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    out = dealt.filter(~inside).withColumn("b", block("no"))
    b = F.col("b")
    each_other = F.transform(up_to("no"), lambda t: cell(0, F.least(b, t), F.greatest(b, t), b <= t, b >= t))
    with_inside = F.when(F.col("ni") > 0, F.transform(up_to("ni"), lambda t: cell(1, b, t, F.lit(True), F.lit(False))))
    out = out.select("g", "node", "comp", F.explode(F.concat(each_other, F.coalesce(with_inside, F.slice(each_other, 1, 0)))).alias("c"))
    into = dealt.filter(inside).withColumn("b", block("ni"))
    into = into.select("g", "node", "comp", F.explode(F.transform(up_to("no"), lambda t: cell(1, t, b, F.lit(False), F.lit(True)))).alias("c"))
    return out.union(into).select("g", "c.*", "node", "comp")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other, by products of 0-1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    rows_a, rows_b = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))

    def placed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        keep = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[keep], kind="stable")
        return at[keep][order], rows[keep][order]

    (at_a, rows_a), (at_b, rows_b) = placed(a, rows_a), placed(b, rows_b)
    for lo in range(0, len(both), COLUMNS):
        x, y = (np.zeros((n, COLUMNS), np.float32) for n in out.shape)
        for at, rows, m in ((at_a, rows_a, x), (at_b, rows_b, y)):
            some = slice(*np.searchsorted(at, (lo, lo + COLUMNS)))
            m[rows[some], at[some] - lo] = 1
        out += x @ y.T
    return out


def enough_hits(k: int, num: int, den: int) -> int:
    """Hits in a full union sketch that a similar pair has, but for the chance MISS."""
    return min(least_shared(k, num, den), -(-k * num // den))


def estimated(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
    """Of pairs (i, j), whether the k least values of both sketches together leave the threshold possible."""
    empty, out = np.iinfo(np.int64).max, np.zeros(len(pairs), bool)
    padded = [np.stack([np.concatenate((x[:k], np.full(k - min(k, len(x)), empty))) for x in side]) for side in (left, right)]
    for lo in range(0, len(pairs), PAIRS):
        some = pairs[lo : lo + PAIRS]
        both = np.sort(np.concatenate((padded[0][some[:, 0]], padded[1][some[:, 1]]), axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != empty)
        new = np.concatenate((np.ones((len(some), 1), bool), ~twice), axis=1) & (both != empty)
        order = np.cumsum(new, axis=1)
        hits, size = (twice & (order[:, 1:] <= k)).sum(axis=1), np.minimum(order[:, -1], k)
        out[lo : lo + PAIRS] = np.where(size < k, hits * den >= size * num, hits >= enough_hits(k, num, den))
    return out


def links_of_blocks(members: DataFrame, sets: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """a, b: links between different components, as many as join what the two blocks join.

    A set is in ascending order, so its first k values are its sketch. Pairs of different components whose union sketch
    allows it are confirmed on full sets.
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[part["left"]], part[part["right"]]
        found: list[tuple[int, int]] = []
        if len(one) and len(two):
            left, right = list(one["set"]), list(two["set"])
            sizes = [np.array([len(x) for x in side]) for side in (left, right)]
            short = overlaps([x[:k] for x in left], [x[:k] for x in right])
            apart = np.not_equal.outer(one["comp"].to_numpy(), two["comp"].to_numpy())
            alike = np.minimum.outer(*sizes) * den >= np.maximum.outer(*sizes) * num
            pairs = np.argwhere(apart & alike & (short > 0))
            pairs = pairs[estimated(left, right, pairs, k, num, den)] if len(pairs) else pairs
            if len(pairs):
                rows, cols = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
                shared = overlaps([left[i] for i in rows], [right[j] for j in cols])
                hits = shared[np.searchsorted(rows, pairs[:, 0]), np.searchsorted(cols, pairs[:, 1])].astype(np.int64)
                pairs = pairs[hits * den >= (sizes[0][pairs[:, 0]] + sizes[1][pairs[:, 1]] - hits) * num]
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for i, j in pairs:
                c, d = find(one["comp"].iat[i]), find(two["comp"].iat[j])
                if c != d:
                    root[max(c, d)] = min(c, d)
                    found.append(tuple(sorted((one["node"].iat[i], two["node"].iat[j]))))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return members.join(sets, "node").groupBy("g", "kind", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def dealt_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs with salts sa and sb, and the frequent classes on both sides: a large group's leader is in all its pairs."""
    pairs = stored(pairs, "pairs")
    often = frequent_keys(pairs, "a"), frequent_keys(pairs, "b")
    return stored(with_salt(with_salt(pairs, "a", often[0], "sa"), "b", often[1], "sb"), "dealt-pairs"), *often


def _with_both(pairs: DataFrame, classes: DataFrame, column: str, often: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Adds p and q, the column of both classes of each pair."""
    one = spread(classes.select(F.col("node").alias("a"), F.col(column).alias("p")), "a", often[0], "sa")
    two = spread(classes.select(F.col("node").alias("b"), F.col(column).alias("q")), "b", often[1], "sb")
    return pairs.join(one, ["a", "sa"]).join(two, ["b", "sb"])


def may_reach(pairs: DataFrame, sketched: DataFrame, often: tuple[DataFrame, DataFrame], k: int, num: int, den: int) -> DataFrame:
    """The pairs whose union sketch leaves the threshold possible."""
    both = _with_both(pairs, sketched, "sketch", often)
    both = both.withColumn("_u", F.slice(F.sort_array(F.array_union("p", "q")), 1, k))
    both = both.withColumn("_hits", F.size(F.array_intersect(F.array_intersect("p", "q"), "_u")))
    # A union of fewer than k values is known in full.
    enough = F.when(F.size("_u") < k, F.col("_hits") * den >= F.size("_u") * num).otherwise(F.col("_hits") >= enough_hits(k, num, den))
    return both.filter(enough).select("a", "b", "sa", "sb")


def confirmed(pairs: DataFrame, sets: DataFrame, often: tuple[DataFrame, DataFrame], num: int, den: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = _with_both(pairs, sets, "set", often).withColumn("_i", F.size(F.array_intersect("p", "q")))
    return both.filter(F.col("_i") * den >= (F.size("p") + F.size("q") - F.col("_i")) * num).select("a", "b").distinct()


def _components(links: DataFrame) -> DataFrame:
    return graph.components(links).withColumnRenamed("component", "comp")


def _with_components(lists: DataFrame, comps: DataFrame) -> DataFrame:
    return lists.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is in the table `ids`: by broadcast if it is small, by shuffle if not."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi")


def numbered(classes: DataFrame) -> tuple[DataFrame, int | None]:
    """The classes (a stored table), those without an id numbered from above the largest id, and that largest id.

    The second is None if every class has an id.
    """
    bare = classes.filter("node IS NULL")
    if bare.isEmpty():
        return classes, None
    top = classes.agg(F.max("node")).first()[0]
    top = -1 if top is None else top
    named = row_numbers(bare.drop("node"), ["n", "f1", "f2"], "node", "_all").drop("_all").withColumn("node", F.col("node") + F.lit(top + 1))
    return stored(classes.filter("node IS NOT NULL").unionByName(named), "classes"), top


def grouped(docs: DataFrame, width: int, num: int, den: int, k: int) -> tuple[DataFrame, int | None]:
    """doc_id, n, f1, f2, node (the row's class) and comp (the smallest node reachable) of each row; and the largest id.

    n is 0 and node null for a text without words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = ["n", "f1", "f2"]
    drawn = stored(sketches(docs, width, k), "sketches")
    nodes, top = numbered(stored(drawn.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "classes"))
    lists = stored(index_lists(nodes, k, num, den), "lists")
    listed = stored(lists.join(lists.groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "value", "left_semi").select("node").distinct(), "listed")
    sketched = stored(among(nodes.select("node", "sketch"), listed, "node"), "listed-sketches")
    sets = with_sets(among(docs, listed, "doc_id"), width).withColumnRenamed("doc_id", "node")
    if top is not None:
        bare = with_sets(docs.filter("doc_id IS NULL"), width).select("set", F.size("set").alias("n"), F.xxhash64("set").alias("f1"), F.hash("set").alias("f2"))
        wanted = among(nodes.filter(F.col("node") > top), listed, "node").select("node", *key)
        sets = sets.union(bare.join(wanted, key).select("node", "set").dropDuplicates(["node"]))
    sets = stored(sets, "sets")
    pairs, *often = dealt_pairs(leader_pairs(lists, num, den))
    links = stored(confirmed(may_reach(pairs, sketched, often, k, num, den), sets, often, num, den), "links")
    placed = stored(_with_components(lists, _components(links)), "placed")
    more = stored(links_of_blocks(block_members(placed), sets, num, den, k), "links")
    comps = _components(links.union(more))
    found = drawn.drop("sketch").join(nodes.select(*key, "node"), key, "left").join(comps, "node", "left")
    return found.withColumn("comp", F.coalesce("comp", "node")), top


def near_duplicates(docs: DataFrame, width: int, num: int = 80, den: int = 100, k: int = SKETCH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links join sets with den * intersection >= num * union; component_id is the smallest doc_id reachable.
    Null or blank text: n_shingles 0, linked with nothing. A very long text is a set like others; only its sketch and, if it
    is a candidate, its set leave its row. Repeated rows are one class; rows with the same doc_id count as linked.
    Null doc_id: linked like others; component_id is its group's smallest id, or null if the group has none, and only then it
    is kept. An empty table gives an empty result.
    """
    found, top = grouped(docs, width, num, den, k)
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    if top is not None:
        component = F.when(F.col("n") > 0, F.when(F.col("comp") <= top, F.col("comp"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def one_of_each(docs: DataFrame, width: int, num: int = 80, den: int = 100, k: int = SKETCH) -> DataFrame:
    """The documents that stay, with the columns they came with: of each group the one with the smallest doc_id.

    Of rows that repeat the doc_id that stays, one stays, and of a group without any id, one row. Texts without words are in
    no group: they stay, but for repeats of a doc_id.
    """
    found, top = grouped(docs, width, num, den, k)
    found = stored(found, "verdicts")
    # Fewer go than stay, and their ids are small: the texts are not shuffled unless very many go.
    gone = found.filter("n > 0 AND doc_id IS NOT NULL AND doc_id <> comp").select(F.col("doc_id").alias("_mx_gone")).distinct()
    gone = stored(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col("_mx_gone"), "left_anti")
    twice = found.filter("doc_id IS NOT NULL AND (n = 0 OR doc_id = comp)").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    if not twice.isEmpty():
        rows = _first_of(rows, twice, ["doc_id"], docs.columns)
    if top is None:
        return rows
    # Rows without an id, by what they say: gone if their group has an id or an earlier class, else one stays.
    key = ["n", "f1", "f2"]
    bare = rows.filter("doc_id IS NULL").withColumn("_mx_row", F.struct(*docs.columns))
    told = bare.withColumn("_mx_t", hashes(words(ascii_lower(text_of("text"))))).withColumn("_mx_s", F.sort_array(_shingles(F.col("_mx_t"), width)))
    told = told.select("_mx_row", F.size("_mx_s").alias("n"), F.xxhash64("_mx_s").alias("f1"), F.hash("_mx_s").alias("f2"))
    stay = found.filter(f"doc_id IS NULL AND n > 0 AND node = comp AND node > {top}").select(*key).distinct()
    one = told.join(stay, key).groupBy(*key).agg(F.min_by("_mx_row", F.xxhash64("_mx_row.text")).alias("_mx_row")).select("_mx_row.*")
    return rows.filter("doc_id IS NOT NULL").union(told.filter("n = 0").select("_mx_row.*")).union(one)


def _first_of(rows: DataFrame, keys: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row for each key that is in the table `keys`; all rows of other keys."""
    marked = rows.join(keys.withColumn("_mx_twice", F.lit(True)), by, "left").select(*columns, "_mx_twice")
    first = Window.partitionBy(*by).orderBy(F.xxhash64(*columns))
    some = marked.filter("_mx_twice").withColumn("_mx_r", F.row_number().over(first)).filter("_mx_r = 1")
    return marked.filter("_mx_twice IS NULL").select(*columns).union(some.select(*columns))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)


#: For tables in which a doc_id names one row.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x
), least_of AS (
  SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
