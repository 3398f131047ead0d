"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Classes come from the corpus: frequent words are clustered by
the company they keep and cut by frequency; the end of a text is a class, and so are all rarer words together. Within a class,
words are factored once more, by count, into at most WIDE groups: frequent words are alone in theirs, and the words of the other
groups share by count plus one. Both choices are a softmax over hashed features of the words before (w1, w1 w2, and w2 alone,
the skip), so the probabilities of all words sum to 1. Rare words are in HASHED groups by hash, dealt like words, and each
keeps one share for unseen words.

What is gathered grows with the corpus: counts of all words, and rows of weights with the cube root of the number of tokens, so
that they still fit a task at any size. Counts of the TOP most frequent words (a fixed number) go to every task; the rest are
joined by shuffle, so each word gets its exact count however large the vocabulary. As history each word counts by its own hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, documents, hashes, stored, text_of, words
from marketloom.llm.quality_classifier import fold

#: Hash of the token that ends a text; no word hashes to a chosen number but by chance.
END = 1
#: Words whose counts every task holds, at most; their ids fit in 16 bits with two to spare.
TOP = 60_000
RARE, START = 65_534, 65_535
#: Frequent words whose company tells clusters apart, and how far before a word they count.
MARKERS, REACH = 24, 3
CLUSTERS = 6
#: Choices of a softmax, at most: a row of weights is a cache line. Groups of rare words.
WIDE = 16
HASHED = 256
#: Rows of weights, and tokens of a trainer, for each cube root of the number of tokens; so what trainers send grows as the corpus.
ROWS_PER_ROOT, TOKENS_PER_ROOT = 192, 8_192
#: Places of a gradient step, and of the part of one that is worked on at once.
BATCH, PART = 16_384, 2_048
RATE = 0.12
LEAST_LOG = np.float32(-25.0)
ROUNDS = 2
#: Tasks that count company at once, at most, and parts in which weights are averaged.
COUNTERS, SLICES = 2_048, 64


@dataclass
class Vocabulary:
    """The frequent words, sorted by hash: counts, and totals of the whole corpus."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    least: int

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(tokens), RARE, np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, at, RARE).astype(np.uint16)


def tokenized(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id, held_out, t: hashes of the words and of the end, h: a hash of the row."""
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    tokens = hashes(words(ascii_lower(text_of("text"))))
    return docs.select("doc_id", held_out.alias("held_out"), F.concat(tokens, F.array(F.lit(END).cast("long"))).alias("t")).withColumn("h", F.xxhash64("doc_id", "t"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, counts = np.unique(_flat(batch.column("t"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["w", "c"])


def word_counts(tokens: DataFrame) -> DataFrame:
    """w, c of all training texts; every batch is counted before it is shuffled."""
    return tokens.filter("NOT held_out").select("t").mapInArrow(_count_rows, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, top: int = TOP) -> Vocabulary:
    """The words with at least `least` occurrences, `least` being as low as keeps them within `top`."""
    level = F.floor(F.log2("c") * 8).cast("int").alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    kept, least = 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r.level):
        if kept + r.n > top:
            break
        kept, least = kept + r.n, r.least
    rows = counts.filter((F.col("c") >= least) | (F.col("w") == END)).select("w", "c").toPandas().sort_values("w")
    return Vocabulary(rows["w"].to_numpy(np.int64), rows["c"].to_numpy(np.int64), sum(r.c for r in levels), sum(r.n for r in levels), least)


def encoded(tokens: DataFrame, vocab: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, h, ids (16-bit, packed) and the hashes of the rare words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            flat, offsets = _flat(batch.column("t"))
            ids = vocab.ids(flat)
            rare = ids == RARE
            before = np.concatenate(([0], np.cumsum(rare)))[offsets]
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * 2), pa.py_buffer(ids)]).cast(pa.binary())
            rest = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(flat[rare]))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *(batch.column(c) for c in ("doc_id", "held_out", "h")), packed, rest], ["row", "doc_id", "held_out", "h", "ids", "rare"])

    return tokens.mapInArrow(run, "row long, doc_id long, held_out boolean, h long, ids binary, rare array<long>")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in a row, and where each text starts, with the end."""
    column = batch.column("ids")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16), np.concatenate(([0], np.cumsum(sizes)))


def _before(ids: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The id (or key) so many places before each one in its text, START beyond the first."""
    out = np.full(len(ids), START, ids.dtype)
    out[back:] = ids[: max(len(ids) - back, 0)]
    for i in range(back):
        at = starts[:-1] + i
        out[at[at < starts[1:]]] = START
    return out


def company(texts: DataFrame, vocab: Vocabulary, markers: np.ndarray) -> np.ndarray:
    """How often each marker stands within REACH words before each frequent word: a table of TOP rows at most."""
    marker_of = np.full(1 << 16, -1, np.int64)
    marker_of[markers] = np.arange(len(markers))
    n = len(vocab.hashes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n * MARKERS, np.int64)
        for batch in batches:
            ids, starts = _ids(batch)
            for back in range(1, REACH + 1):
                marker = marker_of[_before(ids, starts, back)]
                take = (marker >= 0) & (ids < n)
                cells += np.bincount(ids[take].astype(np.int64) * MARKERS + marker[take], minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "c"])

    rows = texts.filter("NOT held_out").select("ids").coalesce(COUNTERS).mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(n * MARKERS)
    out[rows["cell"].to_numpy(np.int64)] = rows["c"].to_numpy(float)
    return out.reshape(n, MARKERS)


def clusters(table: np.ndarray, weights: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means over how much likelier than usual each marker is; the first centres are frequent words far apart."""
    n = len(table)
    if n == 0:
        return np.zeros(0, np.int64)
    usual = table.sum(axis=0) + 1
    points = np.sqrt((table + usual / usual.sum()) / (table.sum(axis=1, keepdims=True) + 1) / (usual / usual.sum()))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frequent = np.argsort(-weights, kind="stable")[:2_000]
    centres = [points[frequent[0]]]
    while len(centres) < min(k, n):
        near = np.max(points[frequent] @ np.array(centres).T, axis=1)
        centres.append(points[frequent[np.argmin(near)]])
    centres, of = np.array(centres), np.zeros(n, np.int64)
    for _ in range(15):
        of = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            mean = (points[of == c] * np.sqrt(weights[of == c])[:, None]).sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[c] = mean / np.linalg.norm(mean)
    return of


@dataclass
class Model:
    """The tree of choices and the weights.

    A leaf is a frequent word (by id) or, after those, a group of rare words. Leaf i makes the choices first[i] to first[i + 1] of
    nodes and children, and has the share 10 ** inside[i] of the last. prior holds the logarithm of each child's share of its
    node's count (none for missing children).
    """

    keys: np.ndarray
    nodes: np.ndarray
    children: np.ndarray
    first: np.ndarray
    inside: np.ndarray
    prior: np.ndarray
    group_sums: np.ndarray
    weights: np.ndarray

    def leaves(self, ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = ids.astype(np.int64)
        out[ids == RARE] = len(self.keys) + (rare % HASHED)
        return out

    def history(self, ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """A 32-bit key of each word, from its hash."""
        out = np.zeros(len(ids), np.uint32)
        known = ids != RARE
        out[known] = self.keys[ids[known]]
        out[~known] = _key(rare)
        return out

    def choices(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all choices that lead to the leaves: place of the leaf, node, child."""
        sizes = self.first[leaves + 1] - self.first[leaves]
        ends = np.cumsum(sizes)
        at = np.repeat(self.first[leaves] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(np.arange(len(leaves)), sizes), self.nodes[at], self.children[at]

    def rows(self, features: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The row of weights of each feature at a node, one line a feature."""
        mixed = (features ^ (node * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA77)
        return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(len(self.weights) - 1)

    def shares(self, rows: np.ndarray, node: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Probability of each child, a line a choice."""
        w = self.weights if weights is None else weights
        out = self.prior.take(node, axis=0, mode="clip")
        for r in rows:
            out += w.take(r, axis=0, mode="clip")
        out -= out.max(axis=1, keepdims=True)
        # No share is so small that its square would leave the normal numbers, which are much faster.
        np.exp(np.maximum(out, LEAST_LOG, out=out), out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def log10(self, leaves: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each leaf after its history."""
        out = np.zeros(len(leaves))
        for lo in range(0, len(leaves), PART):
            some = leaves[lo : lo + PART]
            place, node, child = self.choices(some)
            share = self.shares(self.rows(features[:, lo + place], node), node)[np.arange(len(child)), child]
            out[lo : lo + PART] = self.inside[some] + np.bincount(place, np.log10(np.maximum(share, 1e-30)), minlength=len(some))
        return out


def _key(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> 29)) & 0xFFFFFFFF).astype(np.uint32)


def features(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """w1, w1 w2 and w2 as 32-bit numbers for every place, one line a feature."""
    w1, w2 = (_before(keys, starts, back) for back in (1, 2))
    return np.stack((w1 * np.uint32(0x1B873593), (w1 * np.uint32(0x01000193) ^ (w2 >> np.uint32(7))) + w2 * np.uint32(0x27D4EB2F), w2 * np.uint32(0x5BD1E995) + np.uint32(0x165667B1)))


def _groups(mass: np.ndarray) -> np.ndarray:
    """Group of each item, at most WIDE, items in descending order of mass: each its own if they are few, else of like mass."""
    if len(mass) <= WIDE:
        return np.arange(len(mass))
    middle = (np.cumsum(mass) - mass / 2) / mass.sum()
    return np.unique(np.minimum((middle * WIDE).astype(np.int64), WIDE - 1), return_inverse=True)[1]


def tree(mass: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """nodes, children, first, inside and prior of Model, from the count of each leaf and its class (fewer than WIDE of them)."""

    def shares(group: np.ndarray, own: np.ndarray) -> np.ndarray:
        sums = np.bincount(group, own, minlength=WIDE)
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(sums / sums.sum()), -1e4)

    # Node 0 chooses the class; a class with several leaves has a node that chooses the group.
    prior, node_of, group_of = [shares(class_of, mass)], np.zeros(len(mass), np.int64), np.zeros(len(mass), np.int64)
    inside = np.zeros(len(mass))
    for c in np.flatnonzero(np.bincount(class_of, minlength=WIDE) > 1):
        own = np.flatnonzero(class_of == c)
        own = own[np.argsort(-mass[own], kind="stable")]
        group_of[own] = _groups(mass[own])
        node_of[own] = len(prior)
        prior.append(shares(group_of[own], mass[own]))
        inside[own] = np.log10(mass[own] / np.bincount(group_of[own], mass[own])[group_of[own]])
    second = node_of > 0
    first = np.concatenate(([0], np.cumsum(1 + second))).astype(np.int64)
    nodes, children = np.zeros(first[-1], np.uint32), np.zeros(first[-1], np.int64)
    children[first[:-1]] = class_of
    nodes[first[:-1][second] + 1], children[first[:-1][second] + 1] = node_of[second], group_of[second]
    return nodes, children, first, inside, np.array(prior, np.float32)


def untrained(vocab: Vocabulary, of: np.ndarray, rare_sums: np.ndarray) -> Model:
    """Classes (each cluster cut where half of its occurrences are passed), groups within them, and weights of zero."""
    n = len(vocab.hashes)
    class_of = np.zeros(n + HASHED, np.int64)
    for c in range(CLUSTERS):
        own = np.flatnonzero(of == c)
        own = own[np.argsort(-vocab.counts[own], kind="stable")]
        share = np.cumsum(vocab.counts[own])
        class_of[own] = 2 * c + (share > share[-1] / 2 if len(own) else 0)
    class_of[:n][vocab.hashes == END] = 2 * CLUSTERS
    class_of[n:] = 2 * CLUSTERS + 1
    rows = 1 << max(12, int(np.ceil(np.log2(ROWS_PER_ROOT * max(vocab.total, 1) ** (1 / 3)))))
    return Model(_key(vocab.hashes), *tree(np.concatenate((vocab.counts + 1.0, rare_sums)), class_of), rare_sums, np.zeros((rows, WIDE), np.float32))


def rare_group_sums(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Counts plus one of the rare words by group, and a share for an unseen word: a row a group."""
    rare = counts.filter((F.col("c") < vocab.least) & (F.col("w") != END))
    out = np.ones(HASHED)
    for r in rare.groupBy(F.pmod("w", F.lit(HASHED)).alias("g")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        out[r.g] += r.s
    return out


def _rare(batch: pa.RecordBatch) -> np.ndarray:
    return _flat(batch.column("rare"))[0]


def step(w: np.ndarray, seen: np.ndarray, model: Model, leaves: np.ndarray, every: np.ndarray) -> None:
    """One gradient step over a batch of places, each row of weights at its own rate."""
    slopes, column = np.zeros(w.size, np.float32), np.arange(WIDE)
    for lo in range(0, len(leaves), PART):
        place, node, child = model.choices(leaves[lo : lo + PART])
        rows = model.rows(every[:, lo + place], node)
        # Arrays that came with the task carry a dtype of their own, with which add.at takes its slow way.
        slope = (-model.shares(rows, node, w)).astype(np.float32)
        slope[np.arange(len(child)), child] += 1
        for r in rows:
            np.add.at(slopes, (r[:, None].astype(np.int64) * WIDE + column).ravel(), slope.ravel())
    slopes = slopes.reshape(w.shape)
    seen += np.einsum("ij,ij->i", slopes, slopes) / WIDE
    w += slopes * (RATE / np.sqrt(seen))[:, None]


def trained(texts: DataFrame, model: Model, total: int, rounds: int = ROUNDS) -> Model:
    """Every training text is seen once. In each round, trainers start from the common weights, make gradient steps over their
    texts in order of hash, and the weights are averaged by number of words. Which trainer has a text depends on the text alone."""
    size = len(model.weights)
    share = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(rounds))
    trainers = max(1, -(-total // int(rounds * TOKENS_PER_ROOT * max(total, 1) ** (1 / 3))))
    trainer = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(trainers)).cast("int")

    def steps(start: np.ndarray):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, seen, count = start.astype(np.float32), np.full(size, 1e-2, np.float32), 0
            for batch in batches:
                ids, starts = _ids(batch)
                rare = _rare(batch)
                leaves, every = model.leaves(ids, rare), features(model.history(ids, rare), starts)
                count += len(ids)
                for lo in range(0, len(ids), BATCH):
                    step(w, seen, model, leaves[lo : lo + BATCH], every[:, lo : lo + BATCH])
            if count:
                parts = [p.astype(np.float16).tobytes() for p in np.split(w, SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([float(count)] * SLICES), pa.array(parts, pa.binary())], ["slice", "n", "w"])

        return run

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        sums, n = np.zeros(size // SLICES * WIDE), 0.0
        for row in part.sort_values(["n", "w"]).itertuples():
            sums += np.frombuffer(row.w, np.float16).astype(float) * row.n
            n += row.n
        return pd.DataFrame({"slice": part["slice"][:1], "w": [(sums / n).astype(np.float16).tobytes()]})

    for at in range(rounds):
        own = texts.filter(~F.col("held_out") & (share == at)).select("h", "ids", "rare", trainer.alias("trainer"))
        own = own.repartitionById(trainers, "trainer").sortWithinPartitions("h").select("ids", "rare")
        parts = own.mapInArrow(steps(model.weights.astype(np.float16)), "slice int, n double, w binary").groupBy("slice").applyInPandas(mean, "slice int, w binary").collect()
        if parts:
            model.weights = np.concatenate([np.frombuffer(r.w, np.float16).reshape(-1, WIDE) for r in sorted(parts, key=lambda r: r.slice)]).astype(np.float32)
    return model


def frequent_scores(texts: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """row, n_tokens, n_known, base and score of each text, without what rare words' own counts add."""
    slots = np.log10(vocab.total + vocab.distinct + 1.0)
    alone = np.zeros(1 << 16)
    alone[: len(vocab.counts)] = np.log10(vocab.counts + 1.0)
    group = np.log10(model.group_sums)
    weights, model.weights = model.weights.astype(np.float16), model.weights[:0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.weights = weights.astype(np.float32)
        for batch in batches:
            ids, starts = _ids(batch)
            words = _rare(batch)
            chosen = model.log10(model.leaves(ids, words), features(model.history(ids, words), starts))
            chosen[ids == RARE] -= group[words % HASHED]
            per_text = lambda x: np.add.reduceat(x, starts[:-1]) if len(x) else np.zeros(0)
            rare = per_text((ids == RARE).astype(np.int64)).astype(np.int64)
            n = np.diff(starts)
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(n - rare), pa.array(per_text(alone[ids]) - n * slots), pa.array(per_text(chosen))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return texts.select("row", "doc_id", "held_out", "ids", "rare").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")


def fitted(docs: DataFrame, folds: int, held: int) -> tuple[DataFrame, DataFrame, Vocabulary, Model]:
    """The encoded texts, the counts, the vocabulary and the trained model."""
    tokens = tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folds, held)
    counts = stored(word_counts(tokens), "counts")
    vocab = vocabulary(counts)
    texts = stored(encoded(tokens, vocab), "encoded")
    # Hashes break ties, so the model does not depend on the order of rows.
    markers = np.lexsort((vocab.hashes, -vocab.counts))
    markers = markers[vocab.hashes[markers] != END][:MARKERS]
    of = clusters(company(texts, vocab, markers), vocab.counts) if len(markers) == MARKERS else np.zeros(len(vocab.hashes), np.int64)
    return texts, counts, vocab, trained(texts, untrained(vocab, of, rare_group_sums(counts, vocab)), vocab.total)


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Null or blank text: one token, the end. A very long text is scored whole, in batches. Null doc_id: never held out.
    Repeated rows are scored, and counted, each. Without training texts all words are unknown. An empty table gives an empty
    result.
    """
    texts, counts, vocab, model = fitted(docs, folds, held)
    rest = counts.filter((F.col("c") < vocab.least) & (F.col("w") != END))
    rare = texts.select("row", F.explode("rare").alias("w")).join(rest, "w")  # words without a count add nothing
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("extra"), F.count(F.lit(1)).alias("known"))
    extra = F.coalesce("extra", F.lit(0.0))
    return frequent_scores(texts, model, vocab).join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
