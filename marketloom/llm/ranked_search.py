"""Ranked lexical search by sort-based accumulation: every document is scored for every item, and each item keeps its best.

A task reads its own range of documents once and keeps what matches the items' terms, a block of documents a row (arrays of
document, term and frequency). Document frequencies are sums over those rows. Then each block concatenates its matched item,
document and impact arrays, sorts the packed (item, document) keys by radix and adds runs of equal keys with reduceat. A
document's words lie in one task, so ranges of documents are ranges of keys, and no impact crosses tasks. Each task hands on
the k best of an item that it has seen; the last selection is a ranking over those.

Items are dealt in blocks of BLOCK_TERMS distinct (item, term) pairs, and the documents are read once a block: that bounds
what a task holds of the items, whatever their number.

Nulls: a null text has no terms and is no document of N; a null doc_id is a document of its own and loses ties; rows of items
with the same item_id (null too) are one item with the terms of all. Texts of any length are read whole. Repeated rows are
documents of their own. Empty tables give an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.bytewords import ASCII_LOWER, byte_table, flat, slices, words_of
from marketloom.llm.common import ascii_lower, documents, stored, text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), inverted=True)
BEST = 50
#: Distinct (item, term) pairs of a block of items (one item at least): what a task holds of the items.
BLOCK_TERMS = 100_000
#: Packed keys that are sorted at a time.
KEYS = 1 << 21

MATCHES = "n_docs long, n_terms long, doc_ids array<bigint>, sizes array<bigint>, docs array<int>, terms array<int>, tfs array<int>"


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    found = F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(TERM), F.lit(0))
    return items.select(F.col(item).alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def item_blocks(terms: DataFrame, size: int = BLOCK_TERMS) -> DataFrame:
    """Adds the block of each item to a stored table of item_terms: blocks follow the order of items and hold about `size` rows."""
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.col("item_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    blocks = sizes.select(F.col("item_id").alias("_item"), F.floor(F.coalesce(before, F.lit(0)) / size).cast("long").alias("block"))
    return terms.join(blocks, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")


def matched(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of MATCHES: for each slice of documents, doc_ids and sizes (terms with repeats) of those that match, and their
    (document, term, frequency) triples; n_docs and n_terms count all documents of the slice with a term."""
    wanted = pa.array(terms, pa.large_string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(flat(part.column("text"), ASCII_LOWER), INSIDE)
                sizes = np.diff(words.before)
                distinct = words.strings.dictionary_encode()
                numbers = pc.fill_null(pc.index_in(distinct.dictionary, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = numbers[distinct.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
                keys = np.repeat(np.arange(len(sizes)), sizes) * max(len(wanted), 1) + at
                keys = np.sort(keys[at >= 0])
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                rows, term = np.divmod(keys[first], max(len(wanted), 1))
                held, local = np.unique(rows, return_inverse=True)
                names = part.column("doc_id").cast(pa.int64()).take(pa.array(held))
                columns = [int((sizes > 0).sum()), int(sizes.sum()), names, sizes[held], local.astype(np.int32), term.astype(np.int32), np.diff(first, append=len(keys)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c]) if isinstance(c, int) else pa.ListArray.from_arrays([0, len(c)], pa.array(c)) for c in columns],
                    ["n_docs", "n_terms", "doc_ids", "sizes", "docs", "terms", "tfs"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable ascending order of unsigned keys below 2 ** bits, 16 bits a pass from the lowest (numpy sorts 16 bits by radix)."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digits = (keys >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digits[order], kind="stable")]
    return order


def accumulated(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, document and summed impact of each distinct pair, ascending by item and document."""
    keys = items.astype(np.uint64) * np.uint64(n_docs) + docs.astype(np.uint64)
    order = radix_order(keys, max(int(keys.max()).bit_length(), 1))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    item, doc = np.divmod(keys[first], np.uint64(n_docs))
    return item.astype(np.int64), doc.astype(np.int64), np.add.reduceat(impacts[order], first)


class Best:
    """The k best documents of each item so far: highest score, then lowest id, nulls last. Null ids are given as a flag."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.held: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, items: np.ndarray, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """items ascending. Scores below an item's k-th best, and scores of 0, are passed over."""
        good = scores >= self.floor[items]
        items, scores, null, ids = items[good], scores[good], null[good], ids[good]
        cuts = np.flatnonzero(np.diff(items)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(items)], strict=True):
            if lo == hi:
                continue
            item = int(items[lo])
            both = (scores[lo:hi], null[lo:hi], ids[lo:hi])
            if item in self.held:
                both = tuple(np.concatenate(x) for x in zip(self.held[item], both, strict=True))
            if len(both[0]) > self.k:
                least = np.partition(both[0], -self.k)[-self.k]
                both = tuple(x[both[0] >= least] for x in both)
                order = np.lexsort((both[2], both[1], -both[0]))[: self.k]
                both = tuple(x[order] for x in both)
                self.floor[item] = least
            self.held[item] = both


def scored(matches: DataFrame, per_item: list[np.ndarray], weights: np.ndarray, n: int, length: int, best: int = BEST) -> DataFrame:
    """item (its number in per_item, arrays of term numbers), doc_id, score: each task's best documents of each item."""
    n_items = len(per_item)
    of_items = np.repeat(np.arange(n_items), [len(x) for x in per_item])
    by_term = np.argsort(np.concatenate(per_item), kind="stable")
    starts = np.searchsorted(np.concatenate(per_item)[by_term], np.arange(len(weights) + 1))
    of_items = of_items[by_term].astype(np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Best(n_items, best)
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes, docs, terms, tfs = (batch.column(c)[i].values for c in ("doc_ids", "sizes", "docs", "terms", "tfs"))
                if not len(names):
                    continue
                null, ids = pc.is_null(names).to_numpy(zero_copy_only=False), pc.fill_null(names, 0).to_numpy(zero_copy_only=False)
                docs, terms, tf = docs.to_numpy(), terms.to_numpy(), tfs.to_numpy().astype(np.int64)
                m = 50 + (50 * sizes.to_numpy() * n) // length
                impacts = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
                fan = starts[terms + 1] - starts[terms]
                done = np.cumsum(fan)
                lo = 0
                while lo < len(docs):  # whole documents, about KEYS keys at a time
                    hi = max(int(np.searchsorted(done, (done[lo - 1] if lo else 0) + KEYS)), lo + 1)
                    hi = int(np.searchsorted(docs, docs[hi - 1], "left")) if hi < len(docs) and docs[hi] == docs[hi - 1] and docs[hi - 1] > docs[lo] else int(np.searchsorted(docs, docs[hi - 1], "right"))
                    f = fan[lo:hi]
                    within = np.arange(int(f.sum())) - np.repeat(np.cumsum(f) - f, f)
                    items = of_items[np.repeat(starts[terms[lo:hi]], f) + within]
                    if len(items):
                        item, doc, score = accumulated(items, np.repeat(docs[lo:hi], f), np.repeat(impacts[lo:hi], f), len(names))
                        top.add(item, score, null[doc], ids[doc])
                    lo = hi
        for item, (score, null, ids) in top.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), pa.array(ids.astype(np.int64), mask=null.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return matches.select("doc_ids", "sizes", "docs", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of each item, the `best` documents with the highest score above 0."""
    spark = docs.sparkSession
    terms = stored(item_blocks(stored(item_terms(items), "item-terms"), block_terms), "item-blocks")
    kind = terms.schema["item_id"].dataType
    parts = []
    for (block,) in sorted(tuple(r) for r in terms.select("block").distinct().collect()):
        rows = terms.filter(F.col("block") == block).select("item_id", "term").collect()  # about block_terms rows
        vocabulary = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        of_item: dict = {}
        for r in rows:
            of_item.setdefault(r.item_id, []).append(number[r.term])
        matches = stored(matched(docs, vocabulary), "matches")
        n, length = matches.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n:
            continue
        df = {r.t: r["count"] for r in matches.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row a term of the block
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        found = scored(matches, [np.array(sorted(x)) for x in of_item.values()], weights, n, length, best)
        named = spark.createDataFrame(list(enumerate(of_item)), f"item long, item_id {kind.simpleString()}")
        parts.append(found.join(F.broadcast(named), "item").drop("item"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", place).filter(F.col("rank") <= best).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ws FROM documents
), sized AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), tfs AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, n, term
), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM dfs, totals),
scores AS (
  SELECT i.item_id, t.r, t.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM items i JOIN tfs t USING (term) JOIN weights USING (term), totals GROUP BY i.item_id, t.r, t.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
