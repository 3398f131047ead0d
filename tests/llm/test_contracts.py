"""Every query against a brute-force version on rows with all oddities, and on an empty table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from marketloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines(df):
    return [r.asDict() for r in df.collect()]


def texts(folder, spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_near_dups(spark, folder):
    rows = texts(folder, spark)
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            alike = a and b and 100 * len(a & b) >= 80 * len(a | b)
            if alike or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    expected = collections.Counter()
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        component = min(ids) if ids and sets[i] else d
        expected[d, len(sets[i]), component, d == component if d is not None else component is None] += 1
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in lines(QUERIES["op2_near_dups"](spark, folder)))
    assert got == expected


def test_lm_base_and_scores(spark, folder):
    rows = texts(folder, spark)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    counts = collections.Counter(x for (d, _), w in zip(rows, tokens, strict=True) if not held(d) for x in w)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(d), held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for (d, _), w in zip(rows, tokens, strict=True))
    got = lines(QUERIES["op3_lm_scoring"](spark, folder))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_quality_counts(spark, folder):
    def counts(t):
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        real = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), len(covered), failed

    expected = sorted((str(d), *counts(t)) for d, t in texts(folder, spark))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = lines(QUERIES["op4_quality_rules"](spark, folder))
    assert sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got) == expected
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    from marketloom.llm.tokens import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = sorted(((d, t or "") for d, t in texts(folder, spark)), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32(r[1].encode())))
    expected, start = [], 0
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in lines(QUERIES["op5_token_ids"](spark, folder))]
    assert sorted(got, key=lambda r: r[1]) == expected


def test_classifier_scores_every_row(spark, folder):
    rows = texts(folder, spark)
    got = lines(QUERIES["op6_quality_classifier"](spark, folder))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}


def test_mixing(spark, folder):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    size = lambda t: len(WORD.findall(t or ""))
    sums = collections.Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    target, free = dict.fromkeys(sums, 0.0), set(sums)
    rest = float(sum(sums.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sums[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sums[s]
            rest -= target[s]
        free -= over
    got = lines(QUERIES["op7_mixing"](spark, folder))
    key = lambda d, n, total: (str(d), n, total)
    assert sorted(key(r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted(key(d, size(t), sums[s]) for d, t, s in rows)
    for r in got:
        assert r["target"] == pytest.approx(next(target[s] for s in sums if sums[s] == r["source_size"]))
        if r["size"]:
            copies, rate = r["taken"] / r["size"], r["target"] / r["source_size"]
            assert copies <= 3 and abs(copies - rate) < 1 and copies == int(copies)
        else:
            assert r["taken"] == 0
    again = lines(QUERIES["op7_mixing"](spark, folder))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_substring_dedup(spark, folder):
    rows = [(d if d is not None else math.inf, d, WORD.findall(t or "")) for d, t in texts(folder, spark)]
    first = {}
    for o, _, w in sorted(rows, key=lambda r: r[0]):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), o)
    expected = []
    for o, d, w in rows:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < o for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in lines(QUERIES["op8_substring_dedup"](spark, folder))]
    assert sorted(got) == sorted(expected)


def test_license_phrases(spark, folder):
    from marketloom.llm.licenses import PHRASES

    part = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = []
    for d, t in texts(folder, spark):
        w = part.findall((t or "").translate(LOWER))
        at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        expected.append((str(d), len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = lines(QUERIES["op9_license_scan"](spark, folder))
    assert sorted(map(str, ((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got))) == sorted(map(str, expected))
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got if r["base_labels"])


def test_sharding(spark, folder):
    rows = texts(folder, spark)
    got = lines(QUERIES["op10_sharding"](spark, folder))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    shards = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    sizes = [len(shards[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_decontamination(spark, folder):
    got = {(r["doc_id"], r["item_id"]) for r in lines(QUERIES["op1_decontamination"](spark, folder))}
    assert got == {(17, 1)}


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_empty_tables(spark, tmp_path, folder, name):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
