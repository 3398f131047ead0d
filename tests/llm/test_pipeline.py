"""The pipeline, stage by stage, against SQL where there is some and brute force where there is none."""

import collections
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from marketloom.llm.mixing import OP7_SQL  # noqa: E402
from marketloom.llm.quality_rules import OP4_SQL  # noqa: E402
from marketloom.llm.tokens import tokenizer_path  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_sql(sql: str, documents: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(sql).df()


def near(rows: pd.DataFrame) -> set[int]:
    """Ids that stay: the smallest of each component of five-word shingle sets at 0.8."""
    sets = {}
    for d, t in zip(rows.doc_id, rows.text, strict=True):
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def leaked(text: str | None, items: list[list[str]]) -> bool:
    """Any offset at which 12 of 16 words in a row of an item (or three quarters of a shorter one) agree."""
    t = re.findall(r"[^\W_]+", (text or "").lower())
    where = collections.defaultdict(list)
    for i, w in enumerate(t):
        where[w].append(i)
    for u in items:
        votes = collections.Counter(i - j for j, w in enumerate(u) for i in where[w])
        size = min(16, len(u))
        for offset, n in votes.items():
            if n * 100 >= size * 75:
                equal = [0 <= j + offset < len(t) and t[j + offset] == w for j, w in enumerate(u)]
                if max(sum(equal[j : j + size]) for j in range(len(u) - size + 1)) * 100 >= size * 75:
                    return True
    return False


def stages(docs: pd.DataFrame, benchmark: pd.DataFrame):
    """Rows after each of the first four stages."""
    good = by_sql(OP4_SQL, docs)
    docs = docs[docs.doc_id.isin(set(good[good.kept].doc_id))]
    yield docs
    docs = docs[docs.doc_id.isin(near(docs))]
    yield docs
    items = [re.findall(r"[^\W_]+", t.lower()) for t in benchmark.text]
    docs = docs[[not leaked(t, items) for t in docs.text]]
    yield docs
    taken = by_sql(OP7_SQL, docs).set_index("doc_id")
    copies = (taken.taken / taken["size"]).fillna(0).round().astype(int)
    yield docs.loc[docs.index.repeat(docs.doc_id.map(copies))]


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")
def test_every_stage(spark):
    from tokenizers import Tokenizer

    folder = str(FOLDER)
    docs, bench = (pd.read_parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], stages(docs, bench), strict=True):
        frame = stage(spark, frame, folder)
        assert frame.columns == columns
        got = frame.toPandas()
        assert sorted(zip(got.doc_id, got.text, strict=True)) == sorted(zip(expected.doc_id, expected.text, strict=True)), name
        frame = spark.createDataFrame(got, frame.schema)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows, start = [], 0
    for d, t in sorted(zip(expected.doc_id, expected.text, strict=True), key=lambda r: (r[0], zlib.crc32(r[1].encode()))):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        rows.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(rows)


def test_stages_take_odd_and_empty_rows(spark, odd, empty, folder):
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, folder)
            assert frame.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
