import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, kept string, node long, t string, row string, score string, shard int, spans string"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, names that clash."""
    base = [prose(120, s) for s in range(6)]
    texts = [
        (1, base[0]), (2, base[0]), (3, base[0].upper()), (4, base[1]), (5, base[1] + " tail of five more words"), (6, base[2]),
        (7, None), (8, ""), (9, " \t\n\x0b\x0c\r "), (10, "one two"), (11, "ONE two"), (12, "one two three four"),
        (13, prose(30_000, 99, 5_000)), (14, prose(60, 7) + " " + base[3][: len(base[3]) // 2] + " " + prose(60, 8)), (15, base[3]),
        (16, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (17, "é " * 30 + "ÉÀ ß 漢字 😀 " + base[4]),
        (18, "x " * 200), (19, "%%% ### " * 40), (20, base[5]), (20, base[5]), (None, base[5]), (None, None), (21, "same words\n" * 40),
    ]
    sources = ["a", "b", None, "a", "a", "Z", "b"]
    langs = ["en", None, "fr", "en"]
    return [
        (d, t, langs[i % 4], sources[i % 7], None if t is None else len(t), i, "k", None, i, "t", "r", "s", 1, "x") for i, (d, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """The odd rows as tables of a folder, with a benchmark and labels, for the queries themselves."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = [(1, prose(120, 4)), (2, "unrelated words of an item that stands in no document at all here"), (3, None), (4, "short")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, d % 2, 0) for d in range(1, 22)] + [(1, 0, 0), (None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
