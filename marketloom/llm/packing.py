"""Packing by lexical retrieval: a sharded BM25 inverted index returns unused neighbours of a seed document, which fill its window.

`index_shards` makes the index, a row a shard (about SHARD_BYTES of text: consecutive documents of a task): token ids of its
documents, and postings of words that stand in two of its documents or more (no other word can find a neighbour). Texts are cut
into parts, and ids and words are found once for each distinct part of ENCODED_BYTES. Distinct words with their document frequencies are counted
over as much and stand in its last shard's row. Document frequencies and the mean length are sums over all documents. `packed` walks
the shards: the longest unused document is a seed; what is left of it after whole windows opens a window, its neighbours are
looked up in the shard's index, best first, and go in until the window is full. The one that flows over is cut there and is the
seed of the next window. So windows are full, and what is left of a task's last window is dealt into lengths that are powers of
two, which need no padding.

Only words that are frequent in the whole corpus are sent to tasks with their frequency: at most FREQUENT of them, by a bound on
the frequency (rarer words count as being at that bound). Words in over STOP of all documents find nothing and are left out.

Nulls: a null text is empty (its piece is the end id), a null doc_id is a document of its own. Texts of any length are packed
whole. Repeated rows are documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import math
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.bytewords import ASCII_LOWER, byte_table, flat, slices, strings_of, words_of
from marketloom.llm.common import documents, stored
from marketloom.llm.tokens import tokenizer_path

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0
WINDOW = 1024
SHARD_BYTES = 2 << 20
#: Shards that are written and read together; more of them would be in a task's memory at once.
GROUP_SHARDS = 4
#: Bytes of text that are encoded together, for several shards.
ENCODED_BYTES = 16 << 20
#: Words whose document frequency tasks know, at most.
FREQUENT = 100_000
#: Share of all documents beyond which a word is not looked up.
STOP = 0.25
K1, B = 1.2, 0.75
#: Parts that are encoded as one text, and strings that are with the tokenizer at once.
TOGETHER = 500

BLANK = byte_table(b"\t\n\x0b\x0c\r ")
MARK = byte_table(bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
LETTER = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Second bytes of the letters of U+00C0 to U+00FF, whose first byte is C3.
LATIN = byte_table(bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)))
# Fixed value: the usual pattern of byte-level tokenizers for parts put together. No white space stands in a row there but line
# feeds, with a space behind them or none; the usual pattern (`\s+(?!\S)|\s+` at its end) takes each of these line feeds alone too.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: White space beyond ASCII; a text that holds any is not cut.
OTHER_BLANKS = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A part of a text without white space but one space or line feed in front.
PLAIN = f"^[ \n]?[^\t-\r\x1c- {OTHER_BLANKS}]+$"

SHARDS = "names array<bigint>, ends array<bigint>, ids binary, lengths array<int>, words array<string>, dfs array<int>, pairs bigint, listed array<string>, counts array<int>, docs binary, tfs binary"
SHARD_COLUMNS = [column.split()[0] for column in SHARDS.split(", ")]


def cuts_everywhere(made: dict) -> bool:
    """Whether a tokenizer's file is of the make whose pattern parts texts before white space and behind letters: byte-level
    with the usual pattern, no normalizer, no space in front, added tokens without white space."""
    steps = made.get("pre_tokenizer") or {}
    return (
        steps.get("type") == "ByteLevel"
        and bool(steps.get("use_regex"))
        and not steps.get("add_prefix_space", True)
        and not made.get("normalizer")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens") or [])
        and all(t["content"][:1] in "<[" and t["content"][1:].strip("|>]_").replace("|", "").isalnum() for t in made.get("added_tokens") or [])
    )


def cut_into_units(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts in parts that are encoded on their own, and the number of parts before each text (and in all).

    A part ends before each run of ASCII white space, and between a letter (ASCII or Latin) and an ASCII mark: nothing that the
    pattern takes reaches across these places, and no word does. whole: which texts are a part as they are.
    """
    data, bounds = flat(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
    blank = BLANK[data]
    letter = LETTER[data]
    letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (blank[1:] & ~blank[:-1]) | (MARK[data[1:]] & letter[:-1])
    if whole.any():
        cut[:-1] &= ~np.repeat(whole, np.diff(bounds))
    cut[bounds] = True
    at = np.flatnonzero(cut)
    return strings_of(data, at[1:]), np.searchsorted(at, bounds)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    done = np.cumsum(sizes)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(starts - (done - sizes), sizes)


def ranked(path: str):
    """tiktoken's encoding of a file of ranks, for parts put together."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Parts(NamedTuple):
    """Texts as numbers of distinct parts, and how many are before each text (and in all); all parts' ids in a row and where each
    part's begin (and the last's end); distinct words, and the same two for the numbers of the parts' words."""

    numbers: np.ndarray
    before: np.ndarray
    ids: np.ndarray
    id_starts: np.ndarray
    words: pa.Array
    held: np.ndarray
    held_starts: np.ndarray

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        return gathered(self.ids, self.id_starts, self.numbers, self.before)

    def all_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for the numbers of their words."""
        return gathered(self.held, self.held_starts, self.numbers, self.before)


class UnitEncoder:
    """Ids and words of texts; those of each distinct part are found once."""

    def __init__(self, path: str, ranks: str | None = None):
        """path: the tokenizer's file; ranks: the same vocabulary as a file of ranks, whose library takes a third of the time for
        strings that are new (a test holds the two against each other)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = ranked(ranks) if ranks else None
        made = json.loads(self.tokenizer.to_str())
        self.by_unit = cuts_everywhere(made)
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        line = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 else -1

    def encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(strings), TOGETHER):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(strings[lo : lo + TOGETHER], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def encoded_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of texts. Those without white space (but in front) are put together, each with a line feed behind it:
        the pattern takes line feeds alone there. Should their number differ, each part is encoded on its own."""
        plain = pc.match_substring_regex(parts, PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(parts, token))
        joined = parts.filter(plain)
        lines = pc.binary_join_element_wise(joined, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        texts = [flat(lines.slice(lo, TOGETHER)).data.tobytes().decode() for lo in range(0, len(lines), TOGETHER)]
        if self.ranked:
            ids = np.concatenate([self.ranked.encode_to_numpy(x, disallowed_special=()) for x in texts]).astype(np.uint32) if texts else np.zeros(0, np.uint32)
        else:
            ids, _ = self.encoded(texts)
        feeds = np.flatnonzero(ids == self.line)
        behind = np.cumsum(pc.starts_with(joined, "\n").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        if len(feeds) != (behind[-1] if len(behind) else 0):
            return self.encoded(parts.to_pylist())
        ends = feeds[behind - 1]
        plain = plain.to_numpy(zero_copy_only=False)
        own, own_sizes = self.encoded(parts.filter(pa.array(~plain)).to_pylist())
        sizes = np.zeros(len(parts), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=-1) - 1, own_sizes
        out, of_plain = np.zeros(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = np.delete(ids, ends), own
        return out, sizes

    def parts(self, texts: pa.Array) -> Parts:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.ones(len(texts), bool)
        if self.by_unit:
            whole = pc.match_substring_regex(texts, f"[{OTHER_BLANKS}]")
            for token in self.added:  # an added token with marks and letters inside must not be cut
                whole = pc.or_(whole, pc.match_substring(texts, token))
            whole = whole.to_numpy(zero_copy_only=False)
        parts, before = cut_into_units(texts, whole)
        parts = parts.dictionary_encode()
        distinct = parts.dictionary
        ids, sizes = self.encoded_parts(distinct) if self.by_unit and self.line >= 0 else self.encoded(distinct.to_pylist())
        found = words_of(flat(distinct, ASCII_LOWER), WORD_BYTES)
        words = found.strings.dictionary_encode()
        return Parts(parts.indices.to_numpy(), before, ids, np.concatenate(([0], np.cumsum(sizes))), words.dictionary, words.indices.to_numpy(), found.before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        return self.parts(texts).all_ids()


def gathered(values: np.ndarray, starts: np.ndarray, numbers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values with these numbers one after the other, and how many values each text has."""
    if not len(numbers):
        return values[:0], np.zeros(len(before) - 1, np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts * values.itemsize), pa.py_buffer(values)])
    _, offsets, data = runs.take(pa.array(numbers)).buffers()
    bounds = np.frombuffer(offsets, np.int64)[before] // values.itemsize
    return np.frombuffer(data, values.dtype, bounds[-1]), np.diff(bounds)


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder_for(*paths: str | None) -> UnitEncoder:
    if paths not in _ENCODERS:
        _ENCODERS[paths] = UnitEncoder(*paths)
    return _ENCODERS[paths]


WORD_BYTES = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), inverted=True)


def _list(column: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column if isinstance(column, pa.Array) else pa.array(column))


def with_ends(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id behind each text, and where each text ends."""
    ends = np.cumsum(lengths + 1)
    out, keep = np.full(len(ids) + len(lengths), end_id, np.uint32), np.ones(len(ids) + len(lengths), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, ends


def narrow(values: np.ndarray) -> bytes:
    """Numbers of 0 or more in as few bytes each as the largest needs: one, two or four."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def wide(raw: bytes, count: int) -> np.ndarray:
    """What narrow() made of so many numbers."""
    return np.frombuffer(raw, f"<u{len(raw) // count}" if count else "<u1")


def shard_row(names: pa.Array, ids: np.ndarray, ends: np.ndarray, held: np.ndarray, per_doc: np.ndarray, words: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """A shard's columns but words and dfs, and the numbers of its distinct words with their document frequencies, most frequent
    first. held: the words of its documents by number in words; per_doc: how many each document has."""
    n, place = len(names), np.arange(len(held), dtype=np.int32)
    seen = np.zeros(len(words), np.int32)
    seen[held[::-1]] = place[::-1]
    distinct = held[seen[held] == place]  # as they come in the shard
    seen[distinct] = place[: len(distinct)]
    keys = np.sort(seen[held].astype(np.int64) * n + np.repeat(np.arange(n), per_doc))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    word, docs = np.divmod(keys[first], max(n, 1))
    tfs = np.diff(first, append=len(keys))
    dfs = np.bincount(word, minlength=len(distinct))
    order = np.argsort(-dfs, kind="stable")  # words with postings first
    listed = int((dfs >= 2).sum())
    starts = np.cumsum(dfs) - dfs
    by_word = spans(starts[order[:listed]], dfs[order[:listed]])
    distinct, dfs = distinct[order], dfs[order]
    columns = {
        "names": _list(names.cast(pa.int64())), "ends": _list(ends), "ids": pa.array([narrow(ids)], pa.binary()), "lengths": _list(per_doc.astype(np.int32)), "pairs": pa.array([len(first)], pa.int64()),
        "listed": _list(words.take(pa.array(distinct[:listed])).cast(pa.string())), "counts": _list(dfs[:listed].astype(np.int32)),
        "docs": pa.array([narrow(docs[by_word])], pa.binary()), "tfs": pa.array([narrow(tfs[by_word])], pa.binary()),
    }
    return columns, distinct, dfs


def index_shards(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of SHARDS. names: the doc_ids; ends: where each document's ids end; lengths: its words; pairs: distinct words of all its
    documents; listed, counts, docs and tfs: its words of two documents or more, most frequent first, how many documents hold
    each, and their postings, one list after the other (ids, docs, tfs: see narrow). words and dfs: distinct words and how many
    documents hold each, of this shard and those before it whose words are empty; most frequent first."""
    if not tokenizer:
        tokenizer, ranks = tokenizer_path(TOKENIZER), tokenizer_path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, ranks)
        for batch in batches:
            for part in slices(batch, size=max(ENCODED_BYTES, shard_bytes)):
                parts = encoder.parts(part.column("text"))
                ids, ends = with_ends(*parts.all_ids(), end_id)
                held, per_doc = parts.all_words()
                word_ends, dfs, doc = np.cumsum(per_doc), np.zeros(len(parts.words), np.int32), 0
                for shard in slices(part, size=shard_bytes):
                    last = doc + shard.num_rows
                    first_id, first_word = (ends[doc - 1], word_ends[doc - 1]) if doc else (0, 0)
                    row, distinct, some = shard_row(shard.column("doc_id"), ids[first_id : ends[last - 1]], ends[doc:last] - first_id, held[first_word : word_ends[last - 1]], per_doc[doc:last], parts.words)
                    dfs[distinct] += some.astype(np.int32)
                    doc, counted = last, np.zeros(0, np.int64)
                    if doc == part.num_rows:
                        counted = distinct if last == shard.num_rows else np.flatnonzero(dfs)
                        counted = counted[np.argsort(-dfs[counted], kind="stable")]
                    row |= {"words": _list(parts.words.take(pa.array(counted)).cast(pa.string())), "dfs": _list(dfs[counted])}
                    yield pa.RecordBatch.from_arrays([row[name] for name in SHARD_COLUMNS], SHARD_COLUMNS)
                pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARDS)


class Index:
    """BM25 over one shard."""

    def __init__(self, row: dict, weights: np.ndarray, mean: float):
        counts = row["counts"].values.to_numpy()
        self.docs, tfs = (wide(row[c].as_py(), int(counts.sum())) for c in ("docs", "tfs"))
        self.n, lengths = len(row["names"].values), row["lengths"].values.to_numpy()
        weight = np.repeat(weights[: len(counts)], counts)
        looked_up = weight > 0
        word = np.repeat(np.arange(len(counts)), counts)[looked_up]
        self.docs, tfs = self.docs[looked_up], tfs[looked_up]
        self.impacts = weight[looked_up] * tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lengths[self.docs] / mean))
        self.ends = np.cumsum(np.bincount(word, minlength=len(counts)))
        self.starts = self.ends - np.diff(self.ends, prepend=0)
        by_doc = np.argsort(self.docs, kind="stable")
        self.words, self.word_ends = word[by_doc], np.cumsum(np.bincount(self.docs, minlength=self.n))

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Scores of all documents of the shard for the words of a document; 0 for those that are used."""
        words = self.words[self.word_ends[doc - 1] if doc else 0 : self.word_ends[doc]]
        at = spans(self.starts[words], self.ends[words] - self.starts[words])
        scores = np.bincount(self.docs[at], weights=self.impacts[at], minlength=self.n)
        scores[used] = 0
        return scores


class Window:
    """Pieces (names, null flags, starts, lengths, checksums, tokens of the document, sequences, offsets) put one behind the other."""

    def __init__(self, base: int, size: int):
        self.sequence, self.size, self.space = base, size, size
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def close(self) -> None:
        self.done += self.open
        self.open, self.sequence, self.space = [], self.sequence + 1, self.size

    def put(self, name: int | None, ids: np.ndarray) -> bool:
        """Whether a window was filled."""
        at, filled = 0, False
        while at < len(ids):
            some = ids[at : at + self.space]
            self.open.append((name, at, some, len(ids), self.sequence, self.size - self.space))
            at, self.space = at + len(some), self.space - len(some)
            if not self.space:
                self.close()
                filled = True
        return filled

    def finish(self) -> None:
        """Deals what the open window holds into sequences whose lengths are powers of two, the longest first."""
        pieces, self.open, left = self.open, [], self.size - self.space
        for name, start, ids, total, _, _ in pieces:
            at = 0
            while at < len(ids):
                if not self.open:
                    self.space = room = 1 << (left.bit_length() - 1)
                some = ids[at : at + self.space]
                self.open.append((name, start + at, some, total, self.sequence, room - self.space))
                at, self.space, left = at + len(some), self.space - len(some), left - len(some)
                if not self.space:
                    self.close()

    def taken(self) -> pa.RecordBatch:
        pieces, self.done = self.done, []
        names, starts, ids, totals, sequences, offsets = zip(*pieces, strict=True) if pieces else [()] * 6
        columns = [
            pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
            pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def frequent_words(shards: DataFrame, most: int = FREQUENT) -> tuple[dict[str, int], int]:
    """Document frequencies of the words in at least `bound` documents, and that bound. The frequencies of all words add up to
    the number of distinct (document, word) pairs, so no more than `most` words can reach a `most`-th of it."""
    counts = shards.select("dfs", F.posexplode("words").alias("place", "word")).groupBy("word").agg(F.sum(F.col("dfs")[F.col("place")]).alias("df"))
    pairs = shards.agg(F.sum("pairs")).first()[0] or 0
    bound = pairs // most + 1
    return {r.word: r.df for r in counts.filter(F.col("df") >= bound).collect()}, bound


def packed(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of PIECES. sequence_id tells tasks apart by its upper half."""
    shards = stored(index_shards(docs, tokenizer, ranks, end_id, shard_bytes), "packing-index", GROUP_SHARDS)
    frequencies, bound = frequent_words(shards)
    n, words = shards.agg(F.sum(F.size("names")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, mean = n or 0, max((words or 0) / max(n or 1, 1), 1.0)
    known = pa.array(list(frequencies), pa.string())

    def weight(df: np.ndarray) -> np.ndarray:
        return np.where(df > STOP * n, 0.0, np.log1p((n - df + 0.5) / (df + 0.5)))

    # The last weight is that of words below the bound; in a table of few documents those too may stand in many.
    weights = weight(np.array([*frequencies.values(), min(bound, math.floor(STOP * n))], np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Window(TaskContext.get().partitionId() << 32, window)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                listed = row["listed"].values
                index = Index(row, weights[pc.fill_null(pc.index_in(listed, value_set=known), len(known)).to_numpy(zero_copy_only=False)], mean)
                names, ends = row["names"].values.to_pylist(), row["ends"].values.to_numpy()
                fill(out, index, names, wide(row["ids"].as_py(), int(ends[-1])), ends)
                yield out.taken()
        out.finish()
        yield out.taken()

    return shards.select("names", "ends", "ids", "lengths", "listed", "counts", "docs", "tfs").mapInArrow(run, PIECES)


def fill(out: Window, index: Index, names: list, ids: np.ndarray, ends: np.ndarray) -> None:
    """Puts all documents of a shard into windows: seeds from the longest, and behind each its unused neighbours, best first."""
    starts = np.concatenate(([0], ends[:-1]))
    used = np.zeros(len(names), bool)

    def put(doc: int) -> bool:
        used[doc] = True
        return out.put(names[doc], ids[starts[doc] : ends[doc]])

    for seed in np.argsort(starts - ends, kind="stable").tolist():
        if used[seed]:
            continue
        put(seed)
        while out.space < out.size:
            scores = index.neighbours(seed, used)
            over = False
            while not over and scores[best := int(scores.argmax())] > 0:
                scores[best] = 0
                over = put(best)
            if not over:
                break  # nothing unused shares a word with the seed; the next longest goes on in its window
            seed = best


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir).select("doc_id", "text"))
