"""Collocations, packing and ranked search against plain Python, on odd rows and on small random corpora."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import bytewords, collocations, packing, ranked_search
from marketloom.llm.tokens import tokenizer_path

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, lang string, rank string, score string, phrase string, item string, block string, n string, a string, start string, names string"


def rows_of(spark, texts, langs=("en", "fr", None), parts=3):
    rows = [(i if i % 7 else None, t, langs[i % len(langs)], "r", "s", "p", "i", "b", "n", "a", "st", "na") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(parts)


def test_words_are_cut_as_by_a_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab Zé\t\n漢,.1") for _ in range(rng.choice((0, 1, 7, 90)))) for _ in range(200)] + [None, "", " ", "a"]
    column = pa.array(texts).slice(3, 180)
    inside = bytewords.byte_table(b" \t\n\r\x0b\x0c", inverted=True)
    got = bytewords.words_of(bytewords.flat(column, bytewords.ASCII_LOWER), inside)
    words = got.strings.to_pylist()
    for i, t in enumerate(texts[3:183]):
        assert words[got.before[i] : got.before[i + 1]] == re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(bytewords.slices(batch, size=100))
    assert len(parts) > 5 and list(itertools.chain(*(p.column("text").to_pylist() for p in parts))) == texts


# Collocations.


def plain_collocations(rows, first, least, covered=80):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    most = defaultdict(int)
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i : i + k]] = max(most[lang, p[i : i + k]], a)
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * most[lang, p] >= covered * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)}


def mined(docs, **options):
    return {tuple(r) for r in collocations.mined(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("block_words", [50, 1_000_000])
def test_collocations_equal_plain_counts(spark, block_words):
    rng = random.Random(2)
    words = ["the", "of", "Of", "new", "york", "city", "a", "é", "漢字", " x", "1"]
    texts = [" ".join(rng.choices(words, weights=range(11, 0, -1), k=rng.choice((0, 1, 3, 40)))).replace("a", rng.choice(["a", "a,", "a\n", "\ta"])) for _ in range(150)] + [None, "", " ", "...", "one. two"]
    docs = rows_of(spark, texts)
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = mined(docs, first=60, least=4, block_words=block_words)
    assert got == plain_collocations(rows, 60, 4) and len({r[0] for r in got}) == 3


def test_long_repeats_overlap_and_ties(spark):
    texts = ["x " * 5_000, "x x x x x", "a b c d e " * 30, "a b c d f " * 30, "p q, p q; p q\np q"] * 2
    docs = rows_of(spark, texts, ("en",))
    assert mined(docs, first=100, least=8) == plain_collocations([(t, "en") for t in texts], 100, 8)


def test_collocations_of_odd_rows_and_none(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert mined(odd, first=50, least=2) == plain_collocations(rows, 50, 2)
    assert mined(empty) == set() and collocations.mined(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert mined(odd, least=10**9) == set()


def test_op11_reads_the_table(spark, folder):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {tuple(r) for r in collocations.op11_collocations(spark, folder).collect()} == plain_collocations(rows, 2000, 30)


# Packing.


@pytest.fixture(scope="module")
def encoder():
    return packing.UnitEncoder(tokenizer_path(packing.TOKENIZER), tokenizer_path(packing.RANKS))


def encode(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_texts_cut_into_parts_have_the_ids_of_the_whole(encoder):
    rng = random.Random(4)
    texts = ["a  b", "don't we'll x's'x", "\n\n a\t\tb \n", "é. É, naïve's ×. a÷b", "<|endoftext|> a<|endoftext|>b", "漢字 。abc", "a_b-c 1.2e5 ", "it's.'s", "\x1c a\x1cb", "tail ", None, "", "a   b", "　x y"]
    texts += ["".join(rng.choice(" \t\nabcé.,'<|>1 ßs漢×tend  　\u0085") for _ in range(60)) for _ in range(500)]
    assert encoder.by_unit
    slow = packing.UnitEncoder(tokenizer_path(packing.TOKENIZER))
    for e, by_unit in ((encoder, True), (encoder, False), (slow, True)):
        e.by_unit = by_unit
        ids, sizes = e.encode(pa.array(texts))
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == encode(encoder, t), t
    encoder.by_unit = True


def held(encoder, docs, pieces, window):
    """All ids in one piece each, checksums right, sequences gapless; lengths of the sequences."""
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    wanted = defaultdict(list)
    for r in docs:
        wanted[r.doc_id].append(np.array([*encode(encoder, r.text), 0], "<u4"))
    assert set(by_doc) == set(wanted)
    for doc, texts in wanted.items():
        assert sum(map(len, texts)) == sum(p.length for p in by_doc[doc])
        crcs = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc])
        for ids in texts:  # rows with the same id share their pieces
            at = 0
            while at < len(ids):
                fit = next(k for k in crcs if crcs[k] and k[0] == at and k[3] == len(ids) and zlib.crc32(ids[at : at + k[1]]) == k[2])
                crcs[fit] -= 1
                at += fit[1]
        assert not +crcs
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= window and (n == window or n & (n - 1) == 0) for n in lengths)
    return lengths


def test_packing_of_odd_rows_is_a_round_trip(spark, odd, empty, encoder):
    lengths = held(encoder, odd.collect(), packing.packed(odd).collect(), 1024)
    assert sum(n < 1024 for n in lengths) <= 11 * odd.rdd.getNumPartitions()
    assert packing.packed(empty).count() == 0


@pytest.mark.parametrize("shard_bytes", [200, 1 << 20])
def test_small_windows_and_many_shards(spark, encoder, shard_bytes):
    rng = random.Random(6)
    docs = rows_of(spark, [" ".join(rng.choice(["alpha", "beta", "gamma,", "x"]) for _ in range(rng.choice((0, 1, 9, 70)))) for _ in range(60)] + [None], parts=2)
    held(encoder, docs.collect(), packing.packed(docs, window=32, shard_bytes=shard_bytes).collect(), 32)


def test_neighbours_share_windows(spark):
    """Documents of a topic (words of their own) lie together: more of a window's neighbours have one topic than by chance."""
    rng = random.Random(7)
    topics = [[f"{t}word{i}" for i in range(40)] for t in "abcdefgh"]
    rows = [(d, " ".join(rng.choice(topics[d % 8]) for _ in range(30))) for d in range(160)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=512).collect()
    together, all_pairs = 0, 0
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        group = list(group)
        all_pairs += len(group) - 1
        together += sum(a.doc_id % 8 == b.doc_id % 8 for a, b in itertools.pairwise(group))
    assert together > 0.8 * all_pairs


def test_scores_are_bm25(spark, encoder):
    texts = ["red fox", "red red dog", "blue fox jumps", "blue", "", "red blue fox " * 3]
    shards = packing.index_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).toArrow().to_batches()[0]
    row = {name: shards.column(name)[0] for name in shards.schema.names}
    listed = row["words"].as_py()[: len(row["counts"].values)]
    assert sorted(listed) == ["blue", "fox", "red"]  # words of two documents or more
    weights = {"blue": 1.5, "fox": 2.0, "red": 0.5}
    index = packing.Index(row, np.array([weights[w] for w in listed]), 3.0)
    tf = [Counter(t.split()) for t in texts]
    score = lambda q, d: sum(w * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * sum(tf[d].values()) / 3)) for t, w in weights.items() if t in tf[q] and t in tf[d])
    used = np.zeros(6, bool)
    used[3] = True
    for q in range(6):
        assert index.neighbours(q, used).tolist() == pytest.approx([0 if d == 3 else score(q, d) for d in range(6)])


def test_known_words_are_bounded_by_frequency(spark):
    docs = spark.createDataFrame([(d, f"common word{d % 5} own{d}") for d in range(50)], "doc_id long, text string")
    shards = packing.index_shards(docs).cache()
    every, bound = packing.frequent_words(shards, 1000)
    assert bound == 1 and len(every) == 56
    some, bound = packing.frequent_words(shards, 10)
    assert bound == 16 and some == {"common": 50}


def test_words_of_many_shards_are_counted_together(spark):
    """Words in several shards of what is encoded together are one row for the count over all shards, not one a shard."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Red", "red", "blue,", "fox", "x-y"]) for _ in range(6)) + f" own{d}" for d in range(60)]
    docs = [Counter(re.findall(r"[a-z0-9]+", t.lower())) for t in texts]
    shards = packing.index_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), shard_bytes=300).collect()
    assert len(shards) > 5 and [len(s.words) for s in shards[:-1]] == [0] * (len(shards) - 1)
    assert dict(zip(shards[-1].words, shards[-1].dfs, strict=True)) == Counter(w for d in docs for w in d)
    for s in shards:
        own = [docs[name] for name in s.names]
        dfs = Counter(w for d in own for w in d)
        assert s.pairs == sum(dfs.values()) and s.lengths == [sum(d.values()) for d in own]
        assert dict(zip(s.listed, s.counts, strict=True)) == {w: n for w, n in dfs.items() if n > 1}
        word = np.repeat(s.listed, s.counts)
        postings = zip(word, packing.wide(s.docs, len(word)).tolist(), packing.wide(s.tfs, len(word)).tolist(), strict=True)
        assert sorted(postings) == sorted((w, i, n) for i, d in enumerate(own) for w, n in d.items() if dfs[w] > 1)


def test_parts_with_a_line_feed_in_front_are_put_together(encoder, monkeypatch):
    alone, parts = [], ["\nfoo", "\n'sé", " bar", "baz", "\n漢字9"]
    encoded = encoder.encoded
    monkeypatch.setattr(encoder, "encoded", lambda strings: alone.extend(strings) or encoded(strings))
    ids, sizes = encoder.encoded_parts(pa.array(parts, pa.large_string()))
    assert not alone
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encode(encoder, p) for p in parts]


@pytest.mark.parametrize("top", [0, 255, 256, 65535, 65536])
def test_numbers_are_kept_in_as_few_bytes_as_they_need(top):
    raw = packing.narrow(np.array([0, top]))
    assert len(raw) == 2 * (1 if top < 256 else 2 if top < 65536 else 4)
    assert packing.wide(raw, 2).tolist() == [0, top] and packing.wide(packing.narrow(np.zeros(0, np.int64)), 0).tolist() == []


# Ranked search.


def plain_search(docs, items, best=50):
    find = lambda t: re.findall(ranked_search.TERM, (t or "").translate(ASCII_LOWER))
    words = [(d, find(t)) for d, t in docs]
    n, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(find(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, w in words:
            tf, score = Counter(w), 0
            for t in terms & set(tf):
                m = 100 - 50 + (50 * len(w) * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(scores[:best], 1)]
    return Counter(out)


def searched(docs, items, **options):
    return Counter(tuple(r) for r in ranked_search.search(docs, items, **options).collect())


@pytest.mark.parametrize("block_terms", [3, 100_000])
def test_search_equals_a_plain_one(spark, monkeypatch, block_terms):
    monkeypatch.setattr(ranked_search, "KEYS", 64)
    rng = random.Random(9)
    vocabulary = ["the", "The", "x1", "é", "漢字", "a", "b", "rare", "under_score", "dash-ed"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.choice((0, 1, 5, 80)))) for _ in range(300)] + [None, "", "..."]
    docs = rows_of(spark, texts)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(4))) for i in range(12)] + [(3, "rare again"), (None, "the é"), (50, None), (51, ""), (52, "nowhere")]
    got = searched(docs, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    assert got == plain_search([(r.doc_id, r.text) for r in docs.collect()], items)


def test_search_of_odd_rows_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "w1 w2 w3 MIT"), (2, "one two"), (3, None)], "item_id long, text string")
    assert searched(odd, items, best=7) == plain_search([(r.doc_id, r.text) for r in odd.collect()], [(1, "w1 w2 w3 MIT"), (2, "one two")], 7)
    assert not searched(empty, items) and not searched(odd, items.limit(0))
    assert dict(ranked_search.search(empty, items).dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_radix_order_and_sums():
    rng = np.random.default_rng(3)
    for top in (1, 2**16, 2**33, 2**50):
        keys = rng.integers(0, top, 5_000).astype(np.uint64)
        assert (keys[ranked_search.radix_order(keys, max(int(keys.max()).bit_length(), 1))] == np.sort(keys)).all()
    items, docs, x = rng.integers(0, 9, 4_000), rng.integers(0, 70, 4_000), rng.integers(0, 2**40, 4_000)
    want = Counter()
    for i, d, v in zip(items.tolist(), docs.tolist(), x.tolist(), strict=True):
        want[i, d] += v
    got = ranked_search.accumulated(items, docs, x, 70)
    assert {(i, d): s for i, d, s in zip(*(c.tolist() for c in got), strict=True)} == want and (np.diff(got[0]) >= 0).all()


# Small things of earlier operators.


def test_documents_without_ids_are_mixed_to_their_targets(spark):
    from marketloom.llm import mixing

    rows = [(None, f"w{i} " * 10, "ab"[i % 2]) for i in range(4_000)]
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"target": "max", "size": "sum"}).collect()
    taken = {r.source: r.n for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    for r in got:
        assert abs(10 * taken[r.source] / r["max(target)"] - 1) < 0.05


def test_labels_without_documents_leave_the_sample_to_others(spark):
    from marketloom.llm import quality_classifier

    docs = spark.createDataFrame([(i, ("good calm prose " if i % 2 else "$$$ buy now ") * 20) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1) for i in range(1_000, 4_000)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, rows=60)
    scores = {r.doc_id: r.score for r in quality_classifier.scored(docs, model).collect()}
    assert min(s for d, s in scores.items() if d % 2) > max(s for d, s in scores.items() if not d % 2)


def row_groups(monkeypatch, written):
    """written_once that notes the rows of each row group by the table's name."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from marketloom.llm import common

    def write(df, name, *how):
        out = common.written_once(df, name, *how)
        for f in Path(out[1].removeprefix("file://")).glob("*.parquet"):
            about = pq.ParquetFile(f).metadata
            written[name] += [about.row_group(i).num_rows for i in range(about.num_row_groups)]
        return out

    return write


def alike(spark):
    return spark.createDataFrame([(i, f"one two three four five six word{i % 7} seven eight", "en") for i in range(400)], "doc_id long, text string, lang string").coalesce(1)


def test_shards_are_written_in_small_groups(spark, monkeypatch):
    """A row group is in memory at once, with a reader and with a writer, and shards have megabytes."""
    written = defaultdict(list)
    write = row_groups(monkeypatch, written)
    monkeypatch.setattr(packing, "stored", lambda *what: write(*what)[0])
    assert packing.packed(alike(spark), shard_bytes=1000).count() >= 400
    assert sum(written["packing-index"]) > 10 and max(written["packing-index"]) <= packing.GROUP_SHARDS


def test_blocks_are_written_in_small_groups(spark, monkeypatch):
    written = defaultdict(list)
    monkeypatch.setattr(collocations, "written_once", row_groups(monkeypatch, written))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert collocations.mined(alike(spark), block_words=100).count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("word-lists", "lists", "reply"):
        assert sum(written[name]) > 10 and max(written[name]) <= collocations.GROUP_BLOCKS, name
