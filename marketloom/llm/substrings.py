"""Substring dedup, seed and extend.

1. Seeds: winnowed anchors (the least 18-gram of every window of 50 words), joined over documents; those of one text are dropped.
2. Partners: the first text with an anchor need not share the words around it, so each window around a seed is dealt by its
   hash, and the earliest text with the same window is its partner. Windows of one diagonal with one partner form a run.
3. Extension: the words of a run are compared with its partner's, to the left and right as far as they agree. What agrees
   over 50 words or more is a repeat, whatever the hashes said.
4. Repeats that meet or overlap are merged; these are the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SALTED_ROWS, broadcast_if_small, documents, hashes, stored, words

#: Words of a repeat, words of an anchor. Each window has LENGTH - ANCHOR + 1 anchors to choose its least from.
LENGTH = 50
ANCHOR = 18
#: Rows and the numbers in their arrays are broadcast up to this sum (8 bytes each), and joined by shuffle beyond.
BROADCAST_NUMBERS = 2_000_000
#: Words of a partner that are compared at once; they are fetched once, however many texts repeat them.
CHUNK = 64

#: An odd multiplier and its inverse modulo 2 ** 64.
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_LAST = 2**63 - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of every window over a row of word hashes, any length, in constant time a window."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(tokens.view(np.uint64) * _powers(_R, self.n), out=sums[1:])
        self.sums, self.back = sums, _powers(_RINV, self.n)

    def windows(self, k: int) -> np.ndarray:
        n = self.n - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[k:] - self.sums[:n]) * self.back[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w consecutive values, by doubling."""
    out, span = values, 1
    while span * 2 <= w:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(values) - w + 1], out[w - span :]) if span < w else out


def anchors(tokens: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the row of all texts' words) and hashes of the anchors: the least k-gram of every window, ties included."""
    w, n = length - k + 1, len(tokens)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = Rolling(tokens).windows(k)
    least = _sliding(grams, w, np.minimum)  # one for each start of a window
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    fit = sizes >= length
    inside[offsets[:-1][fit]] += 1
    np.subtract.at(inside, offsets[1:][fit] - length + 1, 1)
    least = np.where(np.cumsum(inside[: len(least)]) > 0, least, np.uint64(0))
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    best = _sliding(padded, w, np.maximum)[: len(grams)]  # over the windows that hold a gram
    places = np.flatnonzero((best == grams) & (best > 0))
    return places, grams[places]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("t")
        offsets = column.offsets.to_numpy().astype(np.int64)
        tokens = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        places, found = anchors(tokens, offsets)
        row = np.searchsorted(offsets, places, side="right") - 1
        pairs = np.unique(np.stack((row.astype(np.int64), found.view(np.int64)), axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        counts = np.bincount(pairs[:, 0], minlength=batch.num_rows)
        columns = [batch.column(c) for c in ("ord", "f1", "f2", "n")]
        yield pa.RecordBatch.from_arrays([*columns, _lists(pairs[:, 1], counts, pa.int64())], ["ord", "f1", "f2", "n", "anchors"])


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, the windows that hold a shared anchor: extension both ways, as far as a window may reach."""
    reach = LENGTH - ANCHOR
    for batch in batches:
        starts, found, counts = [], [], []
        column, shared = batch.column("t"), batch.column("anchors")
        values, own = column.values.to_numpy(zero_copy_only=False), shared.values.to_numpy(zero_copy_only=False)
        at, own_at = column.offsets.to_numpy(), shared.offsets.to_numpy()
        for i in range(batch.num_rows):
            tokens = values[at[i] : at[i + 1]]
            rolling = Rolling(tokens)
            n = len(tokens) - LENGTH + 1
            places = np.flatnonzero(np.isin(rolling.windows(ANCHOR), own[own_at[i] : own_at[i + 1]].view(np.uint64)))
            cover = np.zeros(len(tokens) + 2, np.int32)
            np.add.at(cover, np.maximum(places - reach, 0), 1)
            np.add.at(cover, places + 1, -1)
            take = np.flatnonzero(np.cumsum(cover)[: max(n, 0)] > 0)
            starts.append(take)
            found.append(rolling.windows(LENGTH)[take].view(np.int64))
            counts.append(len(take))
        counts = np.array(counts, np.int64)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        columns = [batch.column("ord"), batch.column("f1"), _lists(join(starts, np.int32), counts, pa.int32()), _lists(join(found, np.int64), counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["ord", "f1", "starts", "found"])


def _tokens(docs: DataFrame, *more: str) -> DataFrame:
    """ord (doc_id, null last), t (word hashes) and fingerprints of the row of words, with columns of docs."""
    df = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), hashes(words(F.col("text"))).alias("t"), *more)
    return df.select("ord", F.xxhash64("t").alias("f1"), F.hash("t").alias("f2"), F.size("t").alias("n"), "t", *more)


def _hint(df: DataFrame, array: str, width: int = 1) -> DataFrame:
    """A stored table with an array of `width` numbers a place, hinted if all its numbers are few."""
    numbers = df.agg(F.sum(3 + width * F.size(array))).first()[0] or 0
    return F.broadcast(df) if numbers <= BROADCAST_NUMBERS else df


def extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """ord, f1, lo, hi: the parts of runs (ord, f1, e_ord, e_f1, diagonal, lo, hi) whose words are those of the partner.

    Word lo of a run stands at lo + diagonal in the partner. Both sides are cut where the partner's chunks end, and each piece is a
    text of its words. A chunk of a partner is fetched once; one that very many runs need is repeated in shares, so that no
    task meets all runs of a chunk.
    """
    key, run = ["e_ord", "e_f1", "chunk"], ["ord", "f1", "lo", "hi", "e_ord", "e_f1", "diagonal"]
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), "text")

    def opened(wanted: DataFrame) -> DataFrame:
        """The wanted texts with their words: found by id, so that other texts are not parted into words, then by fingerprint.

        Both sides join the same shuffle of the texts, at every size: what is wanted has arrays of any length.
        """
        found = texts.join(wanted, "ord").withColumn("w", words(F.col("text"))).drop("text")
        return found.filter(F.xxhash64(hashes(F.col("w"))) == F.col("f1"))

    chunks = F.sequence(F.floor((F.col("lo") + F.col("diagonal")) / CHUNK), F.floor((F.col("hi") + F.col("diagonal") - 1) / CHUNK))
    needed = runs.select("e_ord", "e_f1", F.explode(chunks).alias("chunk")).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SALTED_ROWS).cast("int").alias("shares"))
    needed = stored(needed, "chunks")
    frequent = broadcast_if_small(stored(needed.filter("shares > 1"), "frequent"))
    at = stored(needed.groupBy(F.col("e_ord").alias("ord"), F.col("e_f1").alias("f1")).agg(F.collect_list(F.struct("chunk", "shares")).alias("chunks")), "partners")
    own = stored(runs.groupBy("ord", "f1").agg(F.collect_list(F.struct("e_ord", "e_f1", "diagonal", "lo", "hi")).alias("runs")), "own-runs")
    piece = lambda start, n: F.array_join(F.slice("w", start.cast("int"), n), " ")
    theirs = opened(at).withColumn("c", F.explode("chunks")).select(F.col("ord").alias("e_ord"), F.col("f1").alias("e_f1"), "c.*", piece(F.col("c.chunk") * CHUNK + 1, CHUNK).alias("theirs"))
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    mine = opened(own).withColumn("r", F.explode("runs")).select("ord", "f1", "w", "r.*").withColumn("chunk", F.explode(chunks))
    start = F.greatest(F.col("lo"), F.col("chunk") * CHUNK - F.col("diagonal")).cast("int")
    end = F.least(F.col("hi"), (F.col("chunk") + 1) * CHUNK - F.col("diagonal")).cast("int")
    mine = mine.withColumns({"start": start, "end": end}).withColumn("mine", piece(F.col("start") + 1, F.col("end") - F.col("start"))).drop("w", "end")
    mine = mine.join(frequent, key, "left").withColumn("salt", F.pmod(F.xxhash64("ord", "lo"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    # A text that stands in two rows is a partner once.
    both = mine.join(theirs.dropDuplicates([*key, "salt"]), [*key, "salt"])
    shift = (F.col("start") + F.col("diagonal") - F.col("chunk") * CHUNK).cast("int")
    both = both.withColumns({"a": F.split("mine", " "), "b": F.split("theirs", " ")}).withColumn("b", F.slice("b", shift + 1, F.size("a")))
    unlike = F.filter(F.transform("a", lambda x, i: F.when(~x.eqNullSafe(F.get("b", i)), F.col("start") + i)), lambda x: x.isNotNull())
    found = both.select(*run, F.when(F.col("a") == F.col("b"), F.array().cast("array<int>")).otherwise(unlike).alias("unlike"))
    ends = found.groupBy(*run).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("unlike")))).alias("cuts"))
    # From one word that differs to the next.
    first, last = F.concat(F.array(F.col("lo") - 1), "cuts"), F.concat("cuts", F.array("hi"))
    parts = ends.select("ord", "f1", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("p")).select("ord", "f1", (F.col("p.a") + 1).alias("lo"), F.col("p.b").alias("hi"))
    return parts.filter(F.col("hi") - F.col("lo") >= LENGTH)


def merged(parts: DataFrame) -> DataFrame:
    """ord, f1, spans: parts (lo, hi) that meet or overlap in one, in order."""
    text = Window.partitionBy("ord", "f1").orderBy("lo", "hi")
    before = F.max("hi").over(text.rowsBetween(Window.unboundedPreceding, -1))
    new = parts.withColumn("new", (F.col("lo") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0))).groupBy("ord", "f1", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("ord", "f1").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """ord, f1, spans (array of lo, hi): the maximal runs of words that an earlier document has, in windows of 50 words."""
    assert length == LENGTH
    drawn = stored(_tokens(docs).mapInArrow(_anchor_rows, "ord long, f1 long, f2 int, n int, anchors array<long>"), "anchors")
    # Texts with the same words: all but the first go whole, so only the first is searched.
    key = ["n", "f1", "f2"]
    first = stored(drawn.groupBy(*key).agg(F.min("ord").alias("first")), "first")
    long_copies = drawn.filter(F.col("n") >= LENGTH).join(first, key).filter("ord > first")
    copies = long_copies.select("ord", "f1", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("spans")).distinct()
    # The seeds: anchors of two texts at least.
    searched = first.filter(F.col("n") >= LENGTH).select(F.col("first").alias("ord"), "f1")
    seeds = drawn.join(searched, ["ord", "f1"], "left_semi").select("ord", "f1", F.explode("anchors").alias("anchor")).distinct()
    common = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    shared = stored(seeds.join(common, "anchor", "left_semi").groupBy("ord", "f1").agg(F.collect_list("anchor").alias("anchors")), "seeds")
    by_id = docs.select("doc_id", "text").join(_hint(shared.withColumnsRenamed({"ord": "_ord", "f1": "_f1"}), "anchors"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col("_ord"))
    opened = _tokens(by_id, "anchors", "_f1").filter(F.col("f1") == F.col("_f1")).select("ord", "f1", "t", "anchors")
    windows = opened.mapInArrow(_window_rows, "ord long, f1 long, starts array<int>, found array<long>")
    windows = windows.select("ord", "f1", F.explode(F.arrays_zip("starts", "found")).alias("w")).select("ord", "f1", F.col("w.starts").alias("start"), F.col("w.found").alias("window"))
    windows = stored(windows, "windows")
    # Stored, so that both sides of the join are shuffled for it alone and a very common window can be split.
    holder = F.min(F.struct("ord", "f1", "start")).alias("e")
    earliest = stored(windows.groupBy("window").agg(holder, F.max("ord").alias("hi")).filter("e.ord < hi").select("window", "e"), "earliest")
    hits = windows.join(earliest, "window").filter("ord > e.ord")
    hits = hits.groupBy("ord", "f1", F.col("e.ord").alias("e_ord"), F.col("e.f1").alias("e_f1"), (F.col("e.start") - F.col("start")).alias("diagonal")).agg(F.sort_array(F.collect_set("start")).alias("s"))
    s = F.col("s")
    los = F.filter(s, lambda x, i: F.coalesce(x - F.get(s, i - 1) > LENGTH, F.lit(True)))
    his = F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) - x > LENGTH, F.lit(True))), lambda x: x + LENGTH)
    runs = hits.select("ord", "f1", "e_ord", "e_f1", "diagonal", F.explode(F.arrays_zip(los.alias("lo"), his.alias("hi"))).alias("r")).select("ord", "f1", "e_ord", "e_f1", "diagonal", "r.*")
    spans = merged(extended(docs, stored(runs, "runs")))
    # A copy's first text may have lost words itself; the copy goes whole either way.
    return stored(spans.union(copies), "repeats")


def _outside(words: Column, spans: Column) -> Column:
    """The words between the spans, which are in order and do not meet."""
    start = lambda i: F.coalesce(F.get(spans, i - 1)["hi"], F.lit(0))
    end = lambda i: F.coalesce(F.get(spans, i)["lo"], F.size(words))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.slice(words, start(i) + 1, end(i) - start(i))))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept (array of the words that stay), n_words, n_removed and spans (the words that go) of each document.

    A word goes if a window of 50 words around it also starts in a document with a smaller doc_id, judged on the input.
    Null or blank text: no words. A very long text is one row throughout. Null doc_id: after all others, and rows without
    id are not earlier than one another. Rows with equal doc_id do not remove each other's words. An empty table gives an
    empty result.
    """
    docs = docs.select("doc_id", "text")
    found = repeats(docs).withColumnsRenamed({"ord": "_ord", "f1": "_f1"})
    cut = docs.withColumn("_w", words(F.col("text"))).withColumn("_t", hashes(F.col("_w")))
    cut = cut.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "_print": F.xxhash64("_t")}).drop("_t")
    joined = cut.join(_hint(found, "spans", 2), (F.col("_key") == F.col("_ord")) & (F.col("_print") == F.col("_f1")), "left")
    kept = F.when(F.col("spans").isNull(), F.col("_w")).otherwise(_outside(F.col("_w"), F.col("spans")))
    out = joined.withColumn("kept", kept).withColumn("n_words", F.size("_w").cast("long"))
    return out.withColumn("n_removed", (F.col("n_words") - F.size("kept")).cast("long")).drop("_w", "_key", "_print", "_ord", "_f1")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.array_join("kept", " ").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM w, unnest(generate_series(1, len(ws) - 49)) AS t(i)
), earliest AS (
  SELECT g, min(doc_id) AS lo FROM win GROUP BY g
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS at FROM win JOIN earliest USING (g), unnest(generate_series(0, 49)) AS t(k) WHERE doc_id > lo GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone.at), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone.at, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
