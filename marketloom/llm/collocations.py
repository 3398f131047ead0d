"""Phrase collocation mining by vertical positional inverted lists.

Documents are dealt into blocks of about BLOCK_WORDS words. A block holds, for each of its words, the ascending positions at
which the word stands (the list's length is its frequency there); positions skip one between pieces and documents, so that
nothing adjoins across them. Level by level, the lists of frequent phrases are merge-joined with the postings of the words one
position further on: the pairs that meet are the phrases that are one word longer, and where they meet is their list. List
lengths are added up over blocks by Spark; phrases that reach `least` get a number, and only their lists go on (no phrase is
frequent whose parts are not). All counts are exact: phrases are told apart by numbers (of two words, or where they stand first), not by hashes.

Tables of phrases have a row a frequent phrase, blocks a row each; nothing is gathered by word or language but sums, so a
frequent word or a large language is no large task.

Nulls: a null text is empty, a null lang is `und`; documents without an id count like others. Texts of any length are read
whole. Repeated rows count each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.bytewords import ASCII_LOWER, byte_table, flat, slices, words_of
from marketloom.llm.common import broadcast_if_small, delete, documents, numbered, written_once

LEAST = 30
LONGEST = 4
FIRST = 2_000
COVERED_PERCENT = 80
SCALE = 2_000_000
#: Words of a block, about (a longer text is in one block).
BLOCK_WORDS = 1_000_000
#: Blocks that are written and read together (a block's lists and keys take about 10 MB each).
GROUP_BLOCKS = 2
#: Lists by block are gathered in the order of blocks, one at a time, not all of a task's at once.
ONE_BLOCK = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1"}
#: Rows that a task hands over at a time.
BATCH_ROWS = 200_000
#: Rows of a table of two numbers that may be broadcast (24 MB).
BROADCAST_ROWS = 1_000_000

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z, and makes every break a line feed and every blank a space.
AS_PIECES = bytes(10 if c in BREAKS else 32 if c in b" \t" else ASCII_LOWER[c] for c in range(256))
INSIDE = byte_table(b" \n", inverted=True)

#: Bits of a block's number in its task, and the low bits of a packed pair.
SEQUENCE, LOW = 12, (1 << 31) - 1

LISTS = "block long, ids array<bigint>, sizes array<int>, places binary"


def _listed(column: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column if isinstance(column, pa.Array) else pa.array(column))


def packed(places: np.ndarray) -> bytes:
    """Positions as differences, which compress well; list after list."""
    return np.diff(places.astype(np.int32), prepend=np.int32(0)).astype("<i4").tobytes()


def unpacked(places: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.frombuffer(places, "<i4"), dtype=np.int32).astype(np.int64)


def vertical(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the length of each one's list, and the lists one after the other. Values and places below 2 ** 31."""
    both = np.sort(values.astype(np.int64) << 31 | places)
    ordered, places = both >> 31, both & LOW
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(both) else np.zeros(0, np.int64)
    return ordered[first], np.diff(first, append=len(both)), places


class Block:
    """Words of the documents of a block by language, until it is full."""

    def __init__(self) -> None:
        self.words, self.base = 0, 0
        self.of: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}

    def add(self, lang: str, texts: pa.Array) -> None:
        pieces = flat(texts, AS_PIECES)
        words = words_of(pieces, INSIDE)
        n = len(words.strings)
        if not n:
            return
        breaks = np.searchsorted(np.flatnonzero(pieces.data == 10), words.starts)
        apart = np.zeros(n, bool)
        apart[1:] = breaks[1:] != breaks[:-1]
        first = words.before[:-1]
        apart[first[first < n]] = True
        places = self.base + np.arange(n) + np.cumsum(apart)
        self.base, self.words = int(places[-1]) + 2, self.words + n
        distinct = words.strings.dictionary_encode()
        self.of.setdefault(lang, []).append((distinct.dictionary, distinct.indices.to_numpy(), places))

    def row(self, number: int) -> pa.RecordBatch:
        langs, words, sizes, places, counts = [], [], [], [], []
        for lang, parts in self.of.items():
            merged = pa.concat_arrays([d for d, _, _ in parts]).dictionary_encode()
            shifts, to = np.cumsum([0, *(len(d) for d, _, _ in parts)]), merged.indices.to_numpy()
            codes = np.concatenate([to[c + s] for s, (_, c, _) in zip(shifts, parts, strict=False)])
            _, size, at = vertical(codes, np.concatenate([p for _, _, p in parts]))
            langs += [lang] * len(size)
            words.append(merged.dictionary.cast(pa.string()))
            sizes.append(size)
            places.append(at)
            counts.append(len(at))
        columns = [
            pa.array([number]), _listed(pa.array(list(self.of), pa.string())), _listed(np.array(counts, np.int64)), _listed(pa.array(langs, pa.string())),
            _listed(pa.concat_arrays(words)), _listed(np.concatenate(sizes).astype(np.int32)), pa.array([packed(np.concatenate(places))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "names", "counts", "langs", "words", "sizes", "places"])


WORD_BLOCKS = "block long, names array<string>, counts array<bigint>, langs array<string>, words array<string>, sizes array<int>, places binary"


def word_lists(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row a block: its words (langs, words) with their lists, and the words of each of its languages (names, counts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), Block()
        number = task << SEQUENCE
        for batch in batches:
            for part in slices(batch):
                langs = pc.fill_null(part.column("lang"), "und")
                for lang in pc.unique(langs).to_pylist():
                    block.add(lang, part.column("text").filter(pc.equal(langs, lang)))
                if block.words >= block_words:
                    yield block.row(number)
                    number, block = number + 1, Block()
                    if number >> SEQUENCE != task or task >> 20:
                        raise OverflowError("too many tasks, or too many blocks in one: their numbers have 32 bits")
        if block.words:
            yield block.row(number)

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, WORD_BLOCKS)


def _by_place(row: dict, sizes: str = "sizes", places: str = "places") -> tuple[np.ndarray, np.ndarray]:
    """Positions in ascending order, and the number of the list that each is in."""
    at = unpacked(row[places].as_py())
    own = np.repeat(np.arange(len(row[sizes].values)), row[sizes].values.to_numpy())
    both = np.sort(at << 31 | own)
    return both >> 31, both & LOW


def met(starts: np.ndarray, heads: np.ndarray, word_places: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of phrases of `length` words with the words right behind them: starts and keys (head << 31 | word).

    Of a phrase that can be frequent all words but the first are frequent too, so a place is left out unless a list has the next one.
    """
    if not len(word_places):
        return starts[:0], heads[:0]
    at = np.minimum(np.searchsorted(word_places, starts + length), len(word_places) - 1)
    hit = word_places[at] == starts + length
    if length > 1:
        hit[:-1] &= starts[1:] == starts[:-1] + 1
        hit[-1:] = False
    return starts[hit], heads[hit] << 31 | words[at[hit]]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}
            pa.default_memory_pool().release_unused()


def _words(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    return _by_place(row) if length == 1 else _by_place(row, "word_sizes", "word_places")


def _joined(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    return met(*_by_place(row), *_words(row, length), length)


def _numbers(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the phrases and of the words that the block has lists of."""
    return row["ids"].values.to_numpy(), row["ids" if length == 1 else "word_ids"].values.to_numpy()


FOUND = ["block", "head", "last", "n", "first"]


def extended(lists: DataFrame, length: int) -> DataFrame:
    """block, head, last, n, first: of each block, the phrases of length + 1 words (the number of all words but the last, and of
    the last), the lengths of their lists and (of three words or more) the first position in them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            starts, keys = _joined(row, length)
            order = np.argsort(keys, kind="stable")
            keys, starts = keys[order], starts[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            n, (ids, words) = np.diff(at, append=len(keys)), _numbers(row, length)
            columns = [np.full(len(at), row["block"].as_py(), np.int64), ids[keys[at] >> 31], words[keys[at] & LOW], n.astype(np.int32), starts[at].astype(np.int32) if length > 1 else np.zeros(len(at), np.int32)]
            for lo in range(0, len(at), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + BATCH_ROWS]) for c in columns], FOUND)

    return lists.mapInArrow(run, "block long, head long, last long, n int, first int")


def _pair() -> Column:
    """The number of a phrase of two words: the words' numbers, below 2 ** 31 each, side by side."""
    return F.shiftleft("head", 31).bitwiseOR(F.col("last"))


def _first() -> Column:
    """The number of a longer phrase: the block and the position where it stands first."""
    return F.shiftleft("block", 31).bitwiseOR(F.col("first").cast("long"))


def _replied(pairs: DataFrame, key: str) -> DataFrame:
    """block, keys, numbers: the frequent ones among each block's keys; a block has at most as many as words."""
    return pairs.groupBy("block").agg(F.collect_list(F.struct(F.col(key).alias("key"), "id")).alias("_r")).select("block", F.col("_r.key").alias("keys"), F.col("_r.id").alias("numbers"))


def frequent_phrases(found: DataFrame, length: int, least: int) -> DataFrame:
    """block, r: of each block, the phrases that are frequent in all blocks together (head, last, id, and a in one block only).

    A phrase has a row a block, and lengths of lists are added up over those. Pairs of words need no id.
    """
    same = Window.partitionBy("head", "last")
    own, number = (F.col("block"), []) if length == 1 else (_first(), ["id"])
    often = found.withColumn("own", own).withColumns({"a": F.sum("n").over(same), "id": F.min("own").over(same)}).filter(F.col("a") >= least)
    return often.groupBy("block").agg(F.collect_list(F.struct("head", "last", *number, F.when(F.col("own") == F.col("id"), F.col("a")).alias("a"))).alias("r"))


def frequent_word_lists(blocks: DataFrame, reply: DataFrame) -> DataFrame:
    """The lists of frequent words; keys of the reply are places in the block's list of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            sizes, keys = row["sizes"].values.to_numpy(), row["keys"].values.to_numpy()
            ids = np.full(len(sizes), -1, np.int64)
            ids[keys] = row["numbers"].values.to_numpy()
            kept = ids >= 0
            places = unpacked(row["places"].as_py())[np.repeat(kept, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()]), _listed(ids[kept]), _listed(sizes[kept]), pa.array([packed(places)], pa.binary())], ["block", "ids", "sizes", "places"])

    return blocks.select("block", "sizes", "places").join(reply, "block").mapInArrow(run, LISTS)


def frequent_lists(lists: DataFrame, reply: DataFrame, length: int) -> DataFrame:
    """The lists of frequent phrases of length + 1 words, and of the words right behind them, in each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            starts, keys = _joined(row, length)
            heads, lasts = row["heads"].values.to_numpy(), row["lasts"].values.to_numpy()
            numbers = heads << 31 | lasts if length == 1 else row["numbers"].values.to_numpy()
            ids, words = _numbers(row, length)
            by_id, by_word = np.argsort(ids), np.argsort(words)
            wanted = by_id[np.searchsorted(ids, heads, sorter=by_id)] << 31 | by_word[np.searchsorted(words, lasts, sorter=by_word)]
            order = np.argsort(wanted)
            wanted, numbers = wanted[order], numbers[order]
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            hit = wanted[at] == keys
            local, sizes, places = vertical(at[hit], starts[hit])
            word_places, of_word = _words(row, length)
            behind = np.isin(word_places, starts[hit] + length + 1, assume_unique=True)
            used, word_local = np.unique(of_word[behind], return_inverse=True)
            _, word_sizes, word_at = vertical(word_local, word_places[behind])
            columns = [
                pa.array([row["block"].as_py()]), _listed(numbers[local]), _listed(sizes.astype(np.int32)), pa.array([packed(places)], pa.binary()),
                _listed(words[used]), _listed(word_sizes.astype(np.int32)), pa.array([packed(word_at)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "places", "word_ids", "word_sizes", "word_places"])

    names = {"head": "heads", "last": "lasts"} | ({} if length == 1 else {"id": "numbers"})
    told = reply.select("block", *[F.col(f"r.{c}").alias(to) for c, to in names.items()])
    return lists.join(told, "block").mapInArrow(run, LISTS + ", word_ids array<bigint>, word_sizes array<int>, word_places binary")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (left + right)) in whole numbers of 38 digits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(19,0)"), (left + right).cast("decimal(20,0)"))


def _lowest(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """score, cut, l and r of the lowest-scoring cut, of equal ones the first."""
    return F.array_min(F.array(*[F.struct(_score(a, x, y).alias("score"), F.lit(k).alias("cut"), x.alias("l"), y.alias("r")) for k, (x, y) in enumerate(cuts, 1)]))


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Word counts (lang, n), frequent words (id, lang, word, a), and for each length from 2 the frequent phrases
    (id, head: number of all words but the last, last: number of the last word, a)."""
    spark = docs.sparkSession
    blocks, blocks_path = written_once(word_lists(docs, block_words), "word-lists", GROUP_BLOCKS)
    totals = blocks.select(F.explode(F.arrays_zip("names", "counts")).alias("x")).groupBy(F.col("x.names").alias("lang")).agg(F.sum("x.counts").alias("n"))
    totals = written_once(totals, "totals")[0]
    listed = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "sizes")).alias("i", "x")).select("block", "i", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.sizes").alias("n"))
    words = numbered(listed.groupBy("lang", "word").agg(F.sum("n").cast("long").alias("a")).filter(F.col("a") >= least), "words").select("id", "lang", "word", "a")
    rows, size = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word") + F.octet_length("lang"))).first()
    if rows > LOW:
        raise OverflowError("pairs of words have 62 bits; raise the least frequency")
    small = rows <= BROADCAST_ROWS and (size or 0) <= 16 * BROADCAST_ROWS
    named = words.select("lang", "word", "id")
    reply = _replied(listed.select("block", "i", "lang", "word").join(F.broadcast(named) if small else named, ["lang", "word"]), "i")
    lists, path = written_once(frequent_word_lists(blocks, reply), "lists", GROUP_BLOCKS, ONE_BLOCK)
    delete(spark, blocks_path)
    levels: list[DataFrame] = []
    for length in range(1, longest):
        found = extended(lists, length)
        if length + 1 == longest:
            last = found.groupBy("head", "last").agg(F.sum("n").alias("a"), F.min(_first() if length > 1 else _pair()).alias("id")).filter(F.col("a") >= least)
            levels.append(written_once(last.select("id", "head", "last", "a"), "phrases")[0])
        else:
            reply, reply_path = written_once(frequent_phrases(found, length, least), "reply", GROUP_BLOCKS, ONE_BLOCK)
            own = reply.select(F.explode(F.filter("r", lambda x: x["a"].isNotNull())).alias("x")).select("x.*")
            levels.append(written_once((own.withColumn("id", _pair()) if length == 1 else own).select("id", "head", "last", "a"), "phrases")[0])
            old, (lists, path) = path, written_once(frequent_lists(lists, reply, length), "lists", GROUP_BLOCKS)
            delete(spark, old)
            delete(spark, reply_path)
    delete(spark, path)
    return totals, words, levels


def _candidates(words: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """For each length: id, lang, a, head, tail (number of all words but the first), words (numbers), best (see _lowest) and
    what the next length needs: counts of the first and last word (fa, la), of head and tail (ha, ta)."""
    by_id = broadcast_if_small(words.select("id", "a"), BROADCAST_ROWS)
    two = (
        levels[0]
        .join(broadcast_if_small(words.select(F.col("id").alias("head"), F.col("a").alias("fa"), "lang"), BROADCAST_ROWS), "head")
        .join(by_id.select(F.col("id").alias("last"), F.col("a").alias("la")), "last")
        .withColumn("tail", F.col("last"))
        .withColumn("words", F.array("head", "last"))
        .withColumn("ha", F.col("fa"))
        .withColumn("ta", F.col("la"))
        .withColumn("best", _lowest(F.col("a"), [(F.col("fa"), F.col("la"))]))
    )
    out = [written_once(two, "candidates")[0]]
    for length, level in enumerate(levels[1:], 3):
        before = out[-1]
        head = before.select(F.col("id").alias("head"), "lang", "fa", F.col("words").alias("_w"), F.col("tail").alias("_inner"), F.col("a").alias("ha"), F.col("ha").alias("hha"))
        tail = before.select(F.col("id").alias("tail"), F.col("head").alias("_inner"), F.element_at("words", -1).alias("last"), "la", F.col("a").alias("ta"), F.col("ta").alias("tta"))
        cuts = [(F.col("fa"), F.col("ta")), (F.col("ha"), F.col("la"))]
        if length == 4:
            cuts.insert(1, (F.col("hha"), F.col("tta")))
        joined = level.join(head, "head").join(tail, ["_inner", "last"]).withColumn("words", F.concat("_w", F.array("last")))
        out.append(written_once(joined.withColumn("best", _lowest(F.col("a"), cuts)).select(*before.columns), "candidates")[0])
    return out


def mined(docs: DataFrame, first: int = FIRST, least: int = LEAST, covered: int = COVERED_PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` phrases of 2 to LONGEST words by the lowest score of their cuts."""
    totals, words, levels = frequencies(docs, least, LONGEST, block_words)
    by_length = _candidates(words, levels)
    kept = []
    for candidates, longer in zip(by_length, [*by_length[1:], None], strict=True):
        # A phrase that covers another holds one of a single word more that does, so looking one word further is enough.
        if longer is not None:
            around = longer.select(F.col("head").alias("id"), F.col("a").alias("_a")).unionByName(longer.select(F.col("tail").alias("id"), F.col("a").alias("_a")))
            most = around.groupBy("id").agg(F.max("_a").alias("_most"))
            outdone = F.lit(100).cast("decimal(10,0)") * F.col("_most") >= F.lit(covered).cast("decimal(10,0)") * F.col("a")
            candidates = candidates.join(most, "id", "left").filter(F.col("_most").isNull() | ~outdone)
        kept.append(candidates.select("lang", "words", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")))
    left = kept[0]
    for part in kept[1:]:
        left = left.unionByName(part)
    left, _ = written_once(left, "left")
    order = [F.desc("score"), F.desc("a")]
    shares = max(1, math.ceil(math.sqrt(left.count() / first)))
    # Ties of score and count stay in until their words are known. A share of a language is ranked before the language is.
    salted = left.withColumn("_s", F.pmod(F.xxhash64("words"), F.lit(shares)))
    for group in (["lang", "_s"], ["lang"]):
        salted = salted.withColumn("_rank", F.rank().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rank") <= first)
    top = numbered(salted.select(*left.columns), "top", "_p")
    spelled = top.select("_p", F.posexplode("words").alias("_i", "id")).join(words.select("id", "word"), "id")
    phrases = spelled.groupBy("_p").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"])).alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = top.join(phrases, "_p").withColumn("rank", place.cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(documents(spark, sf_dir).select("text", "lang"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST}),
parts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM candidates),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.a, p.cut, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * p.a) // (x.a + y.a) AS score FROM parts p
  JOIN f x ON x.lang = p.lang AND x.k = p.cut AND x.phrase = array_to_string(p.ws[1 : p.cut], ' ')
  JOIN f y ON y.lang = p.lang AND y.k = p.k - p.cut AND y.phrase = array_to_string(p.ws[p.cut + 1 : p.k], ' ')
), scores AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(ws[i : i + s - 1], ' ') AS phrase FROM (SELECT lang, a, ws, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates WHERE k > 2))
), most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY lang, phrase),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score::BIGINT AS score
  FROM scores s LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR NOT 100::HUGEINT * most >= {COVERED_PERCENT}::HUGEINT * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""
