"""Token-ID output: documents encoded with a public tokenizer, one wavelet matrix per shard, read back from the files.

A shard is one row of a Parquet table (one file a shard when written by `write_shards`):

* first_doc, n_docs, n_tokens, width (bits an id), zeros (array: zero bits in each plane)
* doc_ids, doc_ends: little-endian int64, the documents in order and where each one ends
* doc_valid: a bit a document in big-endian order, 0 where doc_id is null (its number in doc_ids is 0 then)
* planes: the bit-planes, most significant first, bits packed in big-endian order; a plane is cut every FRAME bits, and each
  piece is a zstd frame of its own, so that one access opens a piece a plane and not the shard
* ranks: one zstd frame a plane; uint32 number of ones before each block of BLOCK bits

Parquet is only the container, so that any store Spark can write to will do.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import documents, new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK = 512
FRAME = 1 << 19
#: Text bytes that go to one shard on average.
SHARD_BYTES = 16 << 20

SHARD_SCHEMA = (
    "first_doc long, n_docs long, n_tokens long, width int, zeros array<long>, doc_ids binary, doc_valid binary, doc_ends binary, planes array<binary>, ranks array<binary>"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The steps before the merges of a tokenizer that is known to part words at white space.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: A word of Latin letters with ASCII punctuation behind it. The tokenizer's pattern parts the two in the same place, lower-cases
#: the letters one by one and changes nothing else in them, so such a word's ids are its letters' and its punctuation's.
STEM_AND_TAIL = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: Distinct strings that a Python worker remembers before it starts anew, and documents it encodes at a time.
REMEMBERED = 500_000
TOGETHER = 2_000


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] of all spans in a row, and where each span ends in it."""
    sizes = ends - starts
    done = np.cumsum(sizes)
    steps = np.repeat(starts - (done - sizes), sizes)
    steps += np.arange(len(steps))
    return values[steps], done


def parts_at_blanks(made: dict) -> bool:
    """Whether a tokenizer's file is of the known make: the fixed steps above, no added token inside ordinary text but special ones."""
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (made.get("normalizer") or {}).get("normalizers") == NORMALIZER
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and not steps[1].get("add_prefix_space", True)
        and made["model"].get("end_of_word_suffix") == WORD_END
        and all(t["special"] and not any(c.isspace() for c in t["content"]) for t in made.get("added_tokens") or [])
    )


class Encoder:
    """Encodes texts, each distinct word once as long as it is remembered.

    A tokenizer of the known make never joins characters across ASCII white space (its pattern leaves white space out and
    its normalizer works on each character or combining sequence), so a text's ids are its words' ids in a row. With any
    other make each text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = parts_at_blanks(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in a row, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _encoded_pieces(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for strings that the pattern takes whole: many are encoded as one text, and an id that ends a word
        ends a string. Should the numbers of strings and of ends ever differ, each is encoded alone."""
        texts = [" ".join(strings[lo : lo + 1_000]) for lo in range(0, len(strings), 1_000)]
        ids, _ = self._encoded(texts)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(strings):
            return self._encoded(strings)
        return ids, np.diff(ends, prepend=0)

    def _places(self, strings: list[str], whole: np.ndarray) -> np.ndarray:
        """Where in self.starts each string's ids are noted; new strings are encoded. whole: those the pattern takes whole."""
        if len(self.known) > REMEMBERED:
            self._forget()
        known, first = self.known, len(self.known)
        places = np.fromiter((known.get(x, -1) for x in strings), np.int64, len(strings))
        new = np.flatnonzero(places < 0)
        if len(new):
            new = np.concatenate((new[whole[new]], new[~whole[new]]))  # pieces first
            named = [strings[i] for i in new]
            pieces = int(whole[new].sum())
            parts = [self._encoded_pieces(named[:pieces]), self._encoded(named[pieces:])]
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            places[new] = np.arange(first, first + len(new))
            known.update(zip(named, range(first, first + len(new)), strict=True))
            used = int(self.starts[first])
            while used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while len(known) + 1 > len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.ids[used : used + len(ids)] = ids
            self.starts[first + 1 : len(known) + 1] = used + np.cumsum(sizes)
        return places

    def _encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids, sizes = self._encoded(texts.to_pylist())
            return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), np.cumsum(sizes + 1)
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        parts = pc.extract_regex(flat.dictionary, STEM_AND_TAIL)
        plain = pc.is_valid(parts)
        # Two strings a word: letters and punctuation, or the word itself and nothing.
        heads = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "stem")), flat.dictionary)
        tails = pc.if_else(plain, pc.struct_field(parts, "tail"), "")
        both = pa.concat_arrays([heads, tails]).dictionary_encode()
        # A piece stands for itself wherever it comes from; the empty tail and words of another make are encoded alone.
        whole = np.zeros(len(both.dictionary), bool)
        plain = plain.to_numpy(zero_copy_only=False)
        at = both.indices.to_numpy()
        whole[at[: len(heads)][plain]] = True
        whole[at[len(heads) :][plain]] = True
        strings = both.dictionary.to_pylist()
        whole &= np.fromiter(map(bool, strings), bool, len(strings))
        where = self._places(strings, whole)[at]
        pieces = np.stack((where[: len(heads)], where[len(heads) :]), axis=1).ravel()
        word_ids, _ = _gather(self.ids, self.starts[pieces], self.starts[pieces + 1])
        word_ends = np.cumsum((self.starts[pieces + 1] - self.starts[pieces]).reshape(-1, 2).sum(axis=1))
        which = flat.indices.to_numpy()
        stream, done = _gather(word_ids, np.concatenate(([0], word_ends[:-1]))[which] if len(which) else word_ends, word_ends[which])
        total = len(stream)
        offsets = split.offsets.to_numpy().astype(np.int64)
        ends = np.concatenate(([0], done))[offsets[1:] - offsets[0]] + np.arange(1, len(texts) + 1)
        out = np.full(total + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = stream
        return out, ends

    def encode(self, texts: pa.Array, end_id: int = END_ID, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by end_id, and where each text ends. Null is an empty text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ids, ends, before = [np.zeros(0, kind)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(texts), TOGETHER):
            some, at = self._encode(texts.slice(lo, TOGETHER), end_id)
            ids.append(some.astype(kind))
            ends.append(at + before)
            before += len(some)
        return np.concatenate(ids), np.concatenate(ends)


#: One encoder for each file in a Python worker, which Spark keeps for many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# The wavelet matrix.


def build(ids: np.ndarray, width: int) -> tuple[list[bytes], list[bytes], list[int]]:
    """Compressed planes and ranks, and the number of zeros in each plane."""
    planes, ranks, zeros, squeeze = [], [], [], zstandard.ZstdCompressor(level=1)
    level = ids
    for bit in range(width - 1, -1, -1):
        ones = ((level >> bit) & 1).astype(bool)
        packed = np.packbits(ones)
        planes += [squeeze.compress(packed[at : at + FRAME // 8].tobytes()) for at in range(0, max(len(packed), 1), FRAME // 8)]
        ranks.append(squeeze.compress(block_ranks(packed).tobytes()))
        below = level[~ones]
        zeros.append(len(below))
        level = np.concatenate((below, level[ones]))
    return planes, ranks, zeros


def block_ranks(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of BLOCK bits, and after the last."""
    size = BLOCK // 8
    whole = np.zeros(-(-len(packed) // size) * size, np.uint8)
    whole[: len(packed)] = packed
    return np.concatenate(([0], np.cumsum(np.bitwise_count(whole).reshape(-1, size).sum(axis=1, dtype=np.int64)))).astype(np.uint32)


class WaveletMatrix:
    """Access, counting and occurrence lookup over one shard; pieces of planes are unpacked when they are first read."""

    def __init__(self, planes: list[bytes], ranks: list[bytes], zeros: list[int], n: int):
        self.n, self.width, self.zeros = n, len(zeros), list(zeros)
        self.pieces = len(planes) // max(self.width, 1)
        self.planes, self.rank_frames = planes, ranks
        self.open: dict[int, np.ndarray] = {}
        self.ranks: dict[int, np.ndarray] = {}

    def _piece(self, plane: int, i: int) -> np.ndarray:
        at = plane * self.pieces + i // FRAME
        if at not in self.open:
            self.open[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.planes[at]), np.uint8)
        return self.open[at]

    def bit(self, plane: int, i: int) -> int:
        return int(self._piece(plane, i)[i % FRAME >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane: the block's count, then the bytes and bits after it."""
        if plane not in self.ranks:
            self.ranks[plane] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.rank_frames[plane]), np.uint32)
        count = int(self.ranks[plane][i // BLOCK])
        if i % BLOCK == 0:
            return count
        piece, end = self._piece(plane, i), i % FRAME >> 3
        count += int(np.bitwise_count(piece[i % FRAME // BLOCK * BLOCK // 8 : end]).sum())
        return count + (int(piece[end]) >> (8 - (i & 7))).bit_count() if i & 7 else count

    def select(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) equal bit of a plane stands, by bisection over ranks."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(plane, mid + 1)
            lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > k else (mid + 1, hi)
        return lo

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.width):
            one, ones = self.bit(p, i), self.rank1(p, i)
            value = value << 1 | one
            i = self.zeros[p] + ones if one else i - ones
        return value

    def _span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.width):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if value >> (self.width - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a value stands in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        a, b = self._span(value, min(lo, hi), hi)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of a value stands; -1 if there are fewer."""
        a, b = self._span(value, 0, self.n)
        if k >= b - a:
            return -1
        i = a + k
        for p in range(self.width - 1, -1, -1):
            one = value >> (self.width - 1 - p) & 1
            i = self.select(p, one, i - self.zeros[p] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All values: from the last plane up, each plane deals the sorted halves back to their places."""
        level = np.zeros(self.n, np.uint32 if self.width > 16 else np.uint16)
        for bit, p in enumerate(range(self.width - 1, -1, -1)):
            packed = np.concatenate([self._piece(p, at) for at in range(0, max(self.n, 1), FRAME)])
            ones = np.unpackbits(packed, count=self.n).view(bool)
            up = np.empty_like(level)
            up[~ones] = level[: self.zeros[p]]
            up[ones] = level[self.zeros[p] :] | level.dtype.type(1 << bit)
            level = up
        return level


def _pack(doc_ids: list[pa.Array], ids: list[np.ndarray], width: int) -> dict:
    stream = np.concatenate([x for x, _ in ids]) if ids else np.zeros(0, np.uint32)
    shift = np.cumsum([0] + [len(x) for x, _ in ids[:-1]])
    ends = np.concatenate([e + s for (_, e), s in zip(ids, shift, strict=True)])
    docs = pa.chunked_array(doc_ids, pa.int64())
    planes, ranks, zeros = build(stream, width)
    return {
        "first_doc": docs[0].as_py(), "n_docs": len(docs), "n_tokens": len(stream), "width": width, "zeros": zeros,
        "doc_ids": pc.fill_null(docs, 0).to_numpy().astype("<i8").tobytes(), "doc_valid": np.packbits(pc.is_valid(docs).to_numpy()).tobytes(), "doc_ends": ends.astype("<i8").tobytes(), "planes": planes, "ranks": ranks,
    }


#: Rows of a shard row's Arrow type.
ARROW = pa.schema(
    [("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("zeros", pa.list_(pa.int64())),
     ("doc_ids", pa.binary()), ("doc_valid", pa.binary()), ("doc_ends", pa.binary()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]
)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the shards of docs (doc_id, text) to path, documents in ascending order of doc_id over the shards.

    Null text: an empty document, so only end_id. Null doc_id: after all others. Repeated and null ids: each row is a
    document of its own, ordered by its text's CRC. Ranges are cut so that a shard gets about shard_bytes of text.
    """
    tokenizer = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        width = max(1, max(encoder.tokenizer.get_vocab_size() - 1, end_id).bit_length())
        doc_ids: list = []
        ids: list = []
        for batch in batches:
            if batch.num_rows:
                doc_ids.append(batch.column("doc_id"))
                ids.append(encoder.encode(batch.column("text"), end_id, np.uint16 if width <= 16 else np.uint32))
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(doc_ids, ids, width)], schema=ARROW)

    shards = max(1, -(-total // shard_bytes))
    order = [F.col("doc_id").asc_nulls_last(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    ordered = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _named_shards(spark: SparkSession, path: str) -> DataFrame:
    return read_shards(spark, path).withColumn("file", F.col("_metadata.file_path"))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """file, base (tokens of all shards before it), n_tokens: one row a shard, from its counts only."""
    before = Window.orderBy(F.col("first_doc").asc_nulls_last(), "file").rowsBetween(Window.unboundedPreceding, -1)
    counts = _named_shards(spark, path).select("first_doc", "file", "n_tokens")
    return counts.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_tokens")


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["planes"], row["ranks"], row["zeros"], row["n_tokens"])


MATRIX = ["planes", "ranks", "zeros", "n_tokens"]


def token_counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """token_id, n: how often each of the given ids stands in all shards, counted in the files without decoding them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                found = [matrix.count(i) if i >> matrix.width == 0 else 0 for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["token_id", "n"])

    return read_shards(spark, path).select(*MATRIX).mapInArrow(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """token_id, place: every place (over all shards) at which one of the given ids stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                for i in ids:
                    places = [matrix.occurrence(i, k) for k in range(matrix.count(i))] if i >> matrix.width == 0 else []
                    names = ["file", "token_id", "at"]
                    yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(places), pa.string()), pa.array([i] * len(places), pa.int64()), pa.array(places, pa.int64())], names)

    found = _named_shards(spark, path).select("file", *MATRIX).mapInArrow(run, "file string, token_id long, at long")
    return found.join(heads(spark, path), "file").select("token_id", (F.col("base") + F.col("at")).alias("place"))


#: Places share a bucket with the shards that reach into it, by which they are joined.
PLACES = 1 << 20


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, token_id for a table of places (column place, over all shards): each shard opens the pieces that its places need.

    Null places and places beyond the last token give no row; a repeated place gives one.
    """
    up_to = F.floor((F.col("base") + F.col("n_tokens") - 1) / PLACES)
    reach = heads(spark, path).withColumn("_b", F.explode(F.sequence(F.floor(F.col("base") / PLACES), up_to)))
    wanted = places.select(F.col("place").cast("long").alias("place")).filter("place >= 0").distinct().withColumn("_b", F.floor(F.col("place") / PLACES))
    inside = F.col("place").between(F.col("base"), F.col("base") + F.col("n_tokens") - 1)
    own = wanted.join(reach, "_b").filter(inside).groupBy("file", "base").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                found = [matrix.access(p - row["base"]) for p in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array(found, pa.int64())], ["place", "token_id"])

    return _named_shards(spark, path).select("file", *MATRIX).join(own, "file").drop("file").mapInArrow(run, "place long, token_id long")


def document_spans(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    A shard's first place is the sum of the tokens of the shards before it: one row a shard, with its counts only.
    No shards (an empty table): an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _matrix(row).decode().astype("<u4")
                ends = np.frombuffer(row["doc_ends"], "<i8")
                starts = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                null = np.unpackbits(np.frombuffer(row["doc_valid"], np.uint8), count=len(ends)) == 0
                columns = [pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), starts, ends - starts, np.array(crcs, np.int64)]
                names = ["doc_id", "at", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([row["file"]] * len(ends))], [*names, "file"])

    spans = _named_shards(spark, path).mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, file string")
    return spans.join(heads(spark, path).drop("n_tokens"), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards of docs to the shared folder and returns the spans read back from them."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, path, tokenizer)
    return document_spans(spark, path)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(documents(spark, sf_dir).select("doc_id", "text"))
