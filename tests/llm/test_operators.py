"""The operators' own interfaces: pieces, odd columns, and properties that the queries don't show."""

import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import decontamination, language_model, licenses, mixing, near_dups, quality_classifier, quality_rules, sharding, substrings, tokens

from .conftest import prose


@pytest.mark.parametrize("step", [quality_rules.keep_good, lambda d: near_dups.one_of_each(d, 5), mixing.mix])
def test_stages_keep_the_columns(odd, step):
    out = step(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd.collect()}


def test_clean_drops_leaks_and_keeps_the_rest(spark, odd):
    bench = spark.createDataFrame([(1, prose(120, 4))], "item_id long, text string")
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 1 and 17 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("every,found", [(7, True), (2, False)])
def test_leaks_tolerate_substitutions(spark, every, found):
    words = prose(60, 1).split()
    changed = [f"other{i}" if i % every == 1 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "before it " + " ".join(changed) + " after it"), (2, prose(200, 2))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.first_word) for r in decontamination.leaks(docs, bench).collect()]
    assert got == ([(1, 5, 2)] if found else [])


def test_short_benchmark_items_are_sought_whole(spark):
    docs = spark.createDataFrame([(1, "x y alpha beta gamma delta epsilon z"), (2, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "Alpha, beta; gamma delta epsilon"), (6, "x y z")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()] == [(1, 5)]


@pytest.mark.parametrize("n", range(decontamination.LEAST_WORDS, decontamination.WINDOW + 1))
def test_masks_cover_every_pattern_of_differing_words(n):
    own = next(masks for least, masks in decontamination.MASKS if n >= least)
    places = [{at + i for i, bit in enumerate(m) if bit == "1"} for m in own for at in range(n - len(m) + 1)]
    differing = n - -(-n * decontamination.AGREE // 100)
    assert all(any(not p & set(gone) for p in places) for gone in itertools.combinations(range(n), differing))


def test_leaks_equal_a_search_without_seeds(spark):
    """Items of 1 to 20 words, with words changed at random places so that some agree just enough and others just not."""
    rng = random.Random(8)
    items = [(n, [f"i{n}x{j}" for j in range(n)]) for n in range(1, 21)]
    docs = []
    for n, words in items:
        for _ in range(25):
            gone = set(rng.sample(range(n), rng.choice([n // 4, n // 4, n // 4 + 1])))
            cut = rng.choice([0, 0, 1])
            docs.append((len(docs), [f"a{rng.random()}"] * (1 - cut) + [f"b{j}" if j in gone else w for j, w in enumerate(words)][cut:]))

    def leaked(t, u):
        size = min(decontamination.WINDOW, len(u))
        for offset in range(-len(u), len(t) + 1):
            equal = [0 <= j + offset < len(t) and t[j + offset] == w for j, w in enumerate(u)]
            if any(sum(equal[j : j + size]) * 100 >= size * decontamination.AGREE for j in range(len(u) - size + 1)):
                return True
        return False

    expected = {(d, i) for d, t in docs for i, u in items if leaked(t, u)}
    frames = [spark.createDataFrame([(d, " ".join(t).replace(".", "")) for d, t in rows], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(*frames).collect()} == expected
    assert 0 < len(expected) < len(docs)


def test_near_duplicates_in_a_large_group_and_small_blocks(spark, monkeypatch):
    """Variants of one text, many not alike the leader: every link between components must be found in blocks of a few."""
    monkeypatch.setattr(near_dups, "BLOCK", 6)
    monkeypatch.setattr(near_dups, "COLUMNS", 64)
    rng = random.Random(5)
    base = prose(160, 3).split()
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            at = rng.randrange(len(w))
            w[at] = base[at] + rng.choice("xy")
        rows.append((d, " ".join(w)))
    rows += [(100 + i, prose(150, 50 + i)) for i in range(20)]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_overlaps_of_blocks_are_exact():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 3000, rng.integers(1, 400))) for _ in range(n)] for n in (7, 11))
    assert near_dups.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_least_shared_is_a_low_quantile():
    assert near_dups.least_shared(64, 80, 100) == 33 or 30 <= near_dups.least_shared(64, 80, 100) <= 40
    assert near_dups.least_shared(10, 100, 100) == 10


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dups._components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(2)
    shared = rng.integers(-(2**62), 2**62, 60)
    one, two = (np.concatenate((rng.integers(-(2**62), 2**62, n), shared, rng.integers(-(2**62), 2**62, 40))) for n in (33, 71))
    found = [set(substrings.anchors(x, np.array([0, len(x)]))[1].tolist()) for x in (one, two)]
    grams = set(substrings.Rolling(shared).windows(substrings.ANCHOR).tolist())
    assert found[0] & found[1] & grams
    assert len(substrings.anchors(one[:49], np.array([0, 49]))[0]) == 0
    for n in (50, 51, 200):  # every window has an anchor
        places, _ = substrings.anchors(rng.integers(-(2**62), 2**62, n), np.array([0, n]))
        assert all(((places >= s) & (places <= s + 32)).any() for s in range(n - 49))


def test_rolling_hashes_depend_on_order_and_content():
    x = np.arange(1, 200, dtype=np.int64) * 7919
    h = substrings.Rolling(np.concatenate((x, x[::-1], x))).windows(50)
    assert (h[: len(x) - 49] == h[2 * len(x) : 3 * len(x) - 49]).all() and len(set(h[: 2 * len(x) - 49].tolist())) == 2 * len(x) - 49


def test_feistel_is_a_permutation_and_computable():
    for n in (1, 2, 3, 15, 16, 17, 1000, 4097):
        assert sorted(sharding.permuted(np.arange(n), n).tolist()) == list(range(n))
    to = sharding.permuted(np.arange(1000), 1000)
    assert sharding.locate(37, 1000) == (int(to[37]) % 16, int(to[37]) // 16)
    assert abs(np.corrcoef(np.arange(1000), to)[0, 1]) < 0.1


def test_sharded_keeps_columns(odd):
    out = sharding.sharded(odd, ["doc_id", "text"], 4)
    assert set(out.columns) == {*odd.columns, "slot"} and out.count() == odd.count() and {r.shard for r in out.collect()} == {0, 1, 2, 3}


def test_wavelet_matrix_answers_like_the_list():
    rng = random.Random(3)
    for n, top in ((0, 5), (1, 1), (700, 3), (5000, 49_408)):
        ids = [rng.randrange(top) for _ in range(n)]
        width = max(1, (top - 1).bit_length())
        m = tokens.WaveletMatrix(*tokens.build(np.array(ids, np.uint16), width), n)
        assert m.decode().tolist() == ids
        for i in rng.sample(range(n), min(n, 50)):
            assert m.access(i) == ids[i] and m.count(ids[i]) == ids.count(ids[i]) and m.count(ids[i], 10, 90) == ids[10:90].count(ids[i])
            at = [j for j, x in enumerate(ids) if x == ids[i]]
            assert [m.occurrence(ids[i], k) for k in range(min(5, len(at)))] == at[:5] and m.occurrence(ids[i], len(at)) == -1


def test_encoder_agrees_with_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    e = tokens.Encoder(tokens.tokenizer_path())
    texts = ["", None, "  a\x0bb ", "Éá x́ \xa0y z '’s don't 'll ΣΑΣ", "<|endoftext|> a", "٣٤5 ²½ ﬁ İI", "́x ́́", "한글", prose(300, 1), "A.B c,, d!! ***"] * 2
    ids, ends = e.encode(pa.array(texts))
    start = 0
    for t, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        start = end


def test_license_templates_bridge_small_changes(spark):
    words = next(p for p, _ in licenses.NOTICES if p.startswith("permission is hereby granted free of charge to any person obtaining")).split()
    changed = [*words[:8], "very", "freely", *words[8:]]
    rows = [(1, "x y " + " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:6])), (4, "GNU General Public License, version 3!"), (5, None)]
    got = {r.doc_id: (r.labels, r.n_base, round(r.score, 2)) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 0, 1.0) and got[2][0] == "MIT" and got[3][0] == "" and got[4] == ("GPL-3.0-only", 0, 1.0) and got[5] == ("", 0, 0.0)


def test_license_labels_against_a_plain_search(spark):
    """Notices with words changed, at random places; a label holds if the best offset lays enough of its words, and in no longer notice."""
    rng = random.Random(9)
    rows, expected = [], {}
    for d, (phrase, label) in enumerate(licenses.NOTICES):
        for copy, share in enumerate((0.0, 0.02, 0.6)):
            words = phrase.split()
            for at in rng.sample(range(len(words)), int(share * len(words))):
                words[at] = f"other{at}"
            rows.append((d * 10 + copy, prose(30, d) + " " + " ".join(words) + " " + prose(30, 99 + d)))
            if share < 0.1:
                expected[d * 10 + copy] = label
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, _ in rows:
        own = [x for x in got[d][0] if x and not x.islower()]
        if d in expected:
            assert own == [expected[d]] and got[d][1] > 0.9, (d, got[d])
        else:
            assert expected.get(d - 2) not in own


def test_classifier_tells_junk_and_survives_one_class():
    rng = random.Random(1)
    rows = [(prose(150, s), 1) for s in range(120)] + [(" ".join(w + rng.choice(["***", "###", "$$$"]) for w in prose(150, 500 + s).split()), 0) for s in range(60)]
    rng.shuffle(rows)
    model = quality_classifier.train(rows)
    assert model.score([prose(150, 900)])[0] > 0.7 > model.score([" ".join(w + "***" for w in prose(150, 901).split())])[0]
    assert quality_classifier.train([("a", 1)] * 5).score(["x", None]).tolist() == [1.0, 1.0]
    assert quality_classifier.train([]).score([""]).tolist() == [0.5]


def test_language_model_learns_company(spark):
    """Two vocabularies that never meet: the words before tell which one comes, so the model beats the counts."""
    rows = [(d, " ".join(f"{'ab'[d % 2]}{random.Random(d * 977 + i).randrange(60)}" for i in range(200))) for d in range(240)]
    out = language_model.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1] * 0.95  # logarithms: less negative is better


def test_quality_thresholds_adapt_to_the_group(spark):
    """A source whose texts are all rich in marks keeps them; a few such texts elsewhere go."""
    plain, marked = (lambda s: prose(80, s)), (lambda s: " ".join(w + "###" if i % 4 == 0 else w for i, w in enumerate(prose(80, s).split())))
    rows = [(i, plain(i), "en", "prose") for i in range(300)] + [(1000 + i, marked(i), "en", "prose") for i in range(10)] + [(2000 + i, marked(i), "en", "wiki") for i in range(250)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(300)) | set(range(2000, 2250))


def test_mix_is_near_its_targets(spark):
    rows = [(i, prose(20 + i % 7, i), s) for i, s in enumerate(["a"] * 600 + ["b"] * 300 + [None] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect()
    for r in got:
        assert r.taken == pytest.approx(r.target, rel=0.08)


@pytest.mark.parametrize("shard_bytes", [tokens.SHARD_BYTES, 300])
def test_shards_hold_rows_without_an_id(spark, tmp_path, shard_bytes):
    rows = [(3, prose(30, 1)), (None, prose(20, 2)), (1, None), (None, None), (2, prose(40, 3)), (None, prose(25, 4)), (2, prose(10, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write_shards(docs, f"{tmp_path}/shards", shard_bytes=shard_bytes)
    encoder = tokens.encoder_for(tokens.tokenizer_path()).tokenizer
    expected, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        expected.append((start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.document_spans(spark, f"{tmp_path}/shards").collect()]
    assert sorted(got, key=lambda r: r[0]) == expected


def test_files_answer_lookups_without_decoding(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PLACES", 64)
    rows = [(i, prose(10 + 7 * i, i, 30)) for i in range(12)] + [(None, prose(9, 99))]
    tokens.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/shards", shard_bytes=600)
    encoder = tokens.encoder_for(tokens.tokenizer_path()).tokenizer
    stream = [x for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0])) for x in encoder.encode(t, add_special_tokens=False).ids + [tokens.END_ID]]
    path = f"{tmp_path}/shards"
    assert tokens.read_shards(spark, path).count() > 2
    wanted = [tokens.END_ID, stream[5], 49_000, 1 << 20]
    assert {r.token_id: r.n for r in tokens.token_counts(spark, path, wanted).collect()} == {i: stream.count(i) for i in wanted}
    assert {(r.token_id, r.place) for r in tokens.occurrences(spark, path, wanted).collect()} == {(x, i) for i, x in enumerate(stream) if x in wanted}
    places = spark.createDataFrame([(p,) for p in [0, 1, len(stream) // 2, len(stream) - 1, len(stream), None, 1]], "place long")
    assert {r.place: r.token_id for r in tokens.tokens_at(spark, path, places).collect()} == {p: stream[p] for p in (0, 1, len(stream) // 2, len(stream) - 1)}


def test_planes_are_cut_into_frames(monkeypatch):
    monkeypatch.setattr(tokens, "FRAME", 1024)
    ids = np.array([random.Random(4).randrange(300) for _ in range(5_000)], np.uint16)
    m = tokens.WaveletMatrix(*tokens.build(ids, 9), len(ids))
    assert m.access(3_000) == ids[3_000] and len(m.open) <= m.width
    assert m.decode().tolist() == ids.tolist() and m.count(7) == (ids == 7).sum() and [m.access(i) for i in (0, 1023, 1024, 4_999)] == ids[[0, 1023, 1024, 4_999]].tolist()


def test_another_tokenizer_encodes_whole_texts():
    other = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_word and tokens.encoder_for(tokens.tokenizer_path()).by_word
    texts = ["Two  words\n", None, "", "a b"]
    ids, ends = other.encode(pa.array(texts))
    start = 0
    for t, end in zip(texts, ends, strict=True):
        assert ids[start:end].tolist() == other.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        start = end


def test_null_ids_are_linked_like_others(spark):
    base, other = prose(150, 1).split(), prose(150, 2).split()
    near = lambda w: " ".join([*w[:75], "changed", *w[76:]])
    rows = [(1, " ".join(base), 0), (None, near(base), 1), (None, " ".join(other), 2), (None, near(other), 3), (None, near(other), 4), (5, prose(150, 3), 5), (None, "", 6), (None, prose(150, 3), 7), (None, prose(90, 9), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dups.near_duplicates(docs, 4).collect())
    assert got == sorted(
        [("1", 147, "1", True), ("None", 147, "1", False), ("5", 147, "5", True), ("None", 147, "5", False), ("None", 0, "None", True), ("None", 87, "None", True)] + [("None", 147, "None", True)] * 3
    )
    kept = {r.n for r in near_dups.one_of_each(docs, 4).collect()}
    assert {0, 5, 6, 8} <= kept and len(kept) == 5 and len(kept & {2, 3, 4}) == 1


def test_union_sketches_estimate_like_sets():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**62, 400))
    sets = [np.sort(np.concatenate((rng.choice(base, 400 - n, replace=False), rng.integers(0, 2**62, n)))) for n in (0, 10, 40, 90, 200, 390)] + [base[:5], base[:30]]
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets))])
    got = near_dups.estimated(sets, sets, pairs, 64, 80, 100)
    for (i, j), yes in zip(pairs, got, strict=True):
        union = np.union1d(sets[i][:64], sets[j][:64])[:64]
        hits = len(np.intersect1d(np.intersect1d(sets[i][:64], sets[j][:64]), union))
        assert yes == (hits * 100 >= len(union) * 80 if len(union) < 64 else hits >= near_dups.enough_hits(64, 80, 100))


def test_quality_thresholds_change_smoothly_and_equal_a_plain_count(spark):
    """Quartiles weighed by size, against plain Python, for groups of 1 to 3,000 documents; texts with many repeats go below 30 %."""
    rng = random.Random(6)
    rows, rates = [], []
    for source, n, typical in (("a", 1, 300), ("b", 40, 90), ("c", 199, 20), ("d", 201, 20), ("e", 3000, 10)):
        for _ in range(n):
            rates.append((source, {k: rng.randrange(typical) for k in quality_rules.RULES}))
    for source, r in rates:
        rows.append(("x", source, *[r[k] for k in quality_rules.RULES]))
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"r_{k} int" for k in quality_rules.RULES))
    quartile = lambda values, q: sorted(values)[-(-len(values) * q // 4) - 1]
    for got in quality_rules.thresholds(frame).collect():
        for k, least in quality_rules.RULES.items():
            own, every = [r[k] for s, r in rates if s == got.source], [r[k] for _, r in rates]
            q1, q3 = ((len(own) * quartile(own, q) + quality_rules.PRIOR * quartile(every, q)) / (len(own) + quality_rules.PRIOR) for q in (1, 3))
            assert got[f"t_{k}"] == pytest.approx(q3 + 3 * max(q3 - q1, least))
    repeated = lambda d: prose(300, d) + " " + " ".join(prose(300, d).split()[:60])
    docs = [(i, prose(300, i), "en", "s") for i in range(400)] + [(1000 + i, repeated(7000 + i), "en", "s") for i in range(5)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(400))


def test_classifier_fits_on_long_texts_too(spark):
    junk = lambda s, n: " ".join(w + "***" for w in prose(n, s).split())
    rows = [(i, prose(9_000, i) if i % 2 else junk(i, 9_000)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    assert min(len(t) for _, t in rows) > 32_768
    good, bad = quality_classifier.fit(docs, labels).score([prose(9_000, 900), junk(901, 9_000)])
    assert good > 0.7 > bad


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="the driver's tables are not here")
def test_classifier_is_right_and_calibrated_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    got = quality_classifier.op6_quality_classifier(spark, folder).filter("held_out").join(labels, "doc_id").toPandas()
    y, p = got["quality"].to_numpy(float), got["score"].to_numpy(float)
    assert len(got) > 500 and (got["predicted"] == y).mean() > 0.95
    assert ((p - y) ** 2).mean() < 0.04 < y.mean() * (1 - y.mean())
    assert abs(p.mean() - y.mean()) < 0.03


def test_language_model_probabilities_sum_to_one(spark, monkeypatch):
    rows = [(d, " ".join(f"w{int(random.Random(d * 977 + i).paretovariate(0.7)) % 3000}" for i in range(120))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(language_model.vocabulary, "__defaults__", (300,))
    _, counts, vocab, model = language_model.fitted(docs, 7, 2)
    assert np.abs(model.weights).max() > 0.05 and 100 < len(vocab.hashes) <= 301
    n = len(vocab.hashes) + language_model.HASHED
    rng = np.random.default_rng(1)
    for _ in range(5):
        ids = rng.integers(0, len(vocab.hashes), 3).astype(np.uint16)
        f = language_model.features(model.history(ids, np.zeros(0, np.int64)), np.array([0, 3]))[:, 2:3].repeat(n, axis=1)
        assert (10 ** model.log10(np.arange(n), f)).sum() == pytest.approx(1, abs=1e-4)
    # Within a group of rare words: counts plus one, and one share for the unseen.
    shares = np.ones(language_model.HASHED)
    for r in counts.filter((F.col("c") < vocab.least) & (F.col("w") != language_model.END)).collect():
        shares[r.w % language_model.HASHED] += r.c + 1
    assert shares.tolist() == model.group_sums.tolist()


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(d, prose(80, d % 60, 200)) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in language_model.lm_scores(docs.repartition(n)).collect()} for n in (2, 7))
    assert one == pytest.approx(two, rel=1e-6)


def test_extension_compares_words_and_cuts_where_they_differ(spark, monkeypatch):
    """Runs that hashes might claim: only stretches of 50 words or more that are word for word the partner's remain."""
    monkeypatch.setattr(substrings, "SALTED_ROWS", 2)
    base = prose(200, 1, 5_000).split()
    texts = {1: base}
    for d in range(2, 12):
        texts[d] = ["x"] * (d % 3) + [w if j not in (60 + d, 130) else "other" for j, w in enumerate(base)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    prints = {r.ord: r.f1 for r in substrings._tokens(docs).select("ord", "f1").collect()}
    runs = [(d, prints[d], 1, prints[1], -(d % 3), d % 3, d % 3 + 200) for d in range(2, 12)]
    frame = spark.createDataFrame(runs, "ord long, f1 long, e_ord long, e_f1 long, diagonal int, lo int, hi int")
    got = {(r.ord, r.lo, r.hi) for r in substrings.extended(docs, substrings.stored(frame, "runs")).collect()}
    expected = set()
    for d in range(2, 12):
        cuts = [-1, 60 + d, 130, 200]
        expected |= {(d, a + 1 + d % 3, b + d % 3) for a, b in itertools.pairwise(cuts) if b - a - 1 >= 50}
    assert got == expected


def test_near_copies_with_a_common_passage_equal_plain_windows(spark):
    """Many documents that share one passage, with words changed at random: every word that goes, against all windows."""
    rng = random.Random(12)
    passage = prose(130, 5, 5_000).split()
    texts = {}
    for d in range(120):
        w = list(passage)
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(40)}"
        texts[d] = prose(rng.randrange(60), 100 + d).split() + w[rng.randrange(40) :] + prose(rng.randrange(60), 300 + d).split()
    first = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    expected = {d: sorted({j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}) for d, w in texts.items()}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(4)
    for r in substrings.without_repeats(docs).collect():
        gone = set(expected[r.doc_id])
        assert r.n_removed == len(gone) and r.kept == [w for j, w in enumerate(texts[r.doc_id]) if j not in gone]
