"""License scans by diagonal voting: word k-grams joined to template positions, votes counted by offset, spans verified by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, broadcast_if_small, documents, gram_hashes, hashes, stored, text_of

K = 3
#: Diagonals this close are one copy with words put in or left out.
GAP = 4
#: Share of a template's k-grams, and of its words, that a copy must hold.
COVER = 0.8
#: Texts with a span are broadcast (with their spans) up to this number, and joined by shuffle beyond.
BROADCAST_TEXTS = 100_000

# The phrases and labels of the query.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses and usual notices, words as license_words gives them, and their SPDX names.
NOTICES = [
    ("released under the mit license", "MIT"),
    ("licensed under the mit license", "MIT"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "MIT"),
    ("licensed under the apache license version 2 0", "Apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "Apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
     "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
     "in the documentation and or other materials provided with the distribution", "BSD-2-Clause"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
     "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
     "in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
     "derived from this software without specific prior written permission", "BSD-3-Clause"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "ISC"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
     "to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "Zlib"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
     "binary for any purpose commercial or non commercial and by any means", "Unlicense"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "MPL-2.0"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
     "distribute execute and transmit the software and to prepare derivative works of the software", "BSL-1.0"),
    ("gnu general public license version 2", "GPL-2.0-only"),
    ("gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "GPL-2.0-or-later"),
    ("gnu general public license version 3", "GPL-3.0-only"),
    ("gnu general public license as published by the free software foundation version 3 of the license", "GPL-3.0-only"),
    ("gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "GPL-3.0-or-later"),
    ("gnu lesser general public license version 2 1", "LGPL-2.1-only"),
    ("gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "LGPL-2.1-or-later"),
    ("gnu lesser general public license version 3", "LGPL-3.0-only"),
    ("gnu affero general public license version 3", "AGPL-3.0-only"),
    ("gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "AGPL-3.0-or-later"),
    ("licensed under cc by nc 4 0", "CC-BY-NC-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "CC-BY-4.0"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "CC-BY-SA-4.0"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "CC-BY-NC-4.0"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "CC-BY-ND-4.0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "CC0-1.0"),
]

#: Characters that part words: all of ASCII but letters and digits, upper case being lowered first.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
BARE_PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), PARTS), "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int = K) -> DataFrame:
    """template, label, base, size (k-grams), at, gram. As many rows as the templates have k-grams: a fixed list."""
    table = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, phrase string, label string, base boolean")
    grams = table.withColumn("_t", hashes(license_words(F.col("phrase")))).withColumn("_g", gram_hashes(F.col("_t"), k))
    return grams.select("template", "label", "base", F.size("_g").alias("size"), F.posexplode("_g").alias("at", "gram"))


def diagonals(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """key, template, label, base, size, diagonal, places: the template positions that vote for an offset.

    Rows with the same doc_id and text have one key and count once.
    """
    keyed = docs.select(key_of().alias("key"), hashes(license_words(text_of("text"))).alias("_t"))
    grams = keyed.select("key", F.posexplode(gram_hashes(F.col("_t"), k)).alias("pos", "gram"))
    votes = grams.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    return votes.groupBy("key", "template", "label", "base", "size", "diagonal").agg(F.collect_set("at").alias("places"))


def key_of() -> Column:
    return F.struct("doc_id", F.xxhash64(text_of("text")).alias("text_hash"))


def spans(votes: DataFrame, gap: int = GAP, cover: float = COVER, k: int = K) -> DataFrame:
    """key, template, label, first_word, last_word, diagonals: what may be a copy, neighbouring diagonals merged."""
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(0))
    run = votes.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = run.groupBy("key", "template", "label", "size", "_run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("places") + k - 1).alias("last_word"),
        F.collect_list("diagonal").alias("diagonals"),
    )
    # A span may be longer than the template only by what the gap allows.
    fits = (F.col("last_word") - F.col("first_word") + 1) <= 2 * (F.col("size") + k - 1)
    return merged.filter((F.col("n") >= F.ceil(cover * F.col("size"))) & fits).drop("_run", "n", "size")


def verified(found: DataFrame, docs: DataFrame, templates: list[tuple[str, str, bool]], cover: float = COVER) -> DataFrame:
    """key, label, first_word, last_word, cover: the spans in which so large a share of the template's words stand.

    A word of the template is found if it stands where one of the voting diagonals lays it; words are compared, not hashes.
    All its numbers must be found: they tell versions apart.
    The texts with a span are read again and their spans cut out of them.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, phrase.split(" ")) for i, (phrase, _, _) in enumerate(templates)], "template int, u array<string>")
    grouped = stored(found.groupBy("key").agg(F.collect_list(F.struct("template", "label", "first_word", "last_word", "diagonals")).alias("spans")), "spans")
    texts = docs.select(key_of().alias("key"), "text").join(broadcast_if_small(grouped, BROADCAST_TEXTS), "key").select("key", "spans", license_words(text_of("text")).alias("t"))
    cut = F.transform("spans", lambda s: s.withField("v", F.slice("t", s["first_word"] + 1, s["last_word"] - s["first_word"] + 1)))
    rows = texts.select("key", F.explode(cut).alias("s")).select("key", "s.*").join(F.broadcast(wanted), "template")
    at = lambda j, d: j + d - F.col("first_word")
    same = F.transform("u", lambda w, j: F.exists("diagonals", lambda d: F.coalesce((at(j, d) >= 0) & (F.get("v", F.greatest(at(j, d), F.lit(0)).cast("int")) == w), F.lit(False))))
    rows = rows.withColumn("same", same)
    share = F.size(F.filter("same", lambda x: x)) / F.size("u")
    numbers = F.forall(F.arrays_zip("u", "same"), lambda z: z["same"] | ~z["u"].rlike("^[0-9]+$"))
    # A text that stands in several rows has its spans several times.
    return rows.withColumn("cover", share).filter((F.col("cover") >= cover) & numbers).select("key", "label", "first_word", "last_word", "cover").distinct()


def outermost(found: DataFrame) -> DataFrame:
    """key, label of the spans that lie in no longer one: a license's name inside its whole notice says nothing more."""
    each = found.groupBy("key", "first_word", "last_word").agg(F.collect_set("label").alias("labels"))
    before = F.max("last_word").over(Window.partitionBy("key").orderBy("first_word", F.col("last_word").desc()).rowsBetween(Window.unboundedPreceding, -1))
    outer = each.withColumn("_before", before).filter("_before IS NULL OR _before < last_word")
    return outer.select("key", F.explode("labels").alias("label"))


def license_report(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase stands where one diagonal has all its k-grams. labels are the base labels and the SPDX names of notices whose
    span is verified and lies in no longer one. score is the largest share of a notice's words found (1 for a phrase).
    Null or empty text: no words, no labels, score 0. A very long text is scanned whole. Null doc_id: a document like others.
    Repeated rows: the same result each. An empty table gives an empty result.
    """
    assert all(len(p.split()) >= K for p in [*phrases, *(n for n, _ in notices)]), "a template needs K words"
    spark = docs.sparkSession
    known = [(p, x, True) for p, x in phrases.items()] + [(p, x, False) for p, x in notices]
    votes = stored(diagonals(docs, template_grams(spark, known)), "votes")  # read by both kinds of templates
    exact = votes.filter(F.col("base") & (F.size("places") == F.col("size")))
    base = exact.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    sure = stored(verified(spans(votes.filter(~F.col("base"))), docs, known), "verified")
    own = sure.groupBy("key").agg(F.max("cover").alias("cover")).join(outermost(sure).groupBy("key").agg(F.collect_set("label").alias("own_set")), "key")
    found = stored(base.join(own, "key", "full_outer").withColumnRenamed("key", "_key"), "found")
    counted = docs.select("doc_id", key_of().alias("key"), F.size(F.array_remove(F.split(text_of("text"), BARE_PARTS), "")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    base_set = F.coalesce("base_set", none)
    return counted.join(broadcast_if_small(found, BROADCAST_TEXTS), F.col("key").eqNullSafe(F.col("_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(base_set), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_set, F.coalesce("own_set", none))), ",").alias("labels"),
        F.when(F.size(base_set) > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(documents(spark, sf_dir).select("doc_id", "text"))


def _values(templates: list[tuple[str, str, bool]]) -> str:
    return ", ".join(f"({i}, '{phrase}', '{label}', {base})" for i, (phrase, label, base) in enumerate(templates))


#: For tables in which a doc_id names one row.
OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT template, string_split(phrase, ' ') AS ps, label, base
  FROM (VALUES {_values([(p, x, True) for p, x in PHRASES.items()] + [(p, x, False) for p, x in NOTICES])}) AS v(template, phrase, label, base)
), tg AS (
  SELECT template, label, base, len(ps) - {K - 1} AS size, j - 1 AS place, array_to_string(ps[j:j + {K - 1}], ' ') AS g FROM t, unnest(generate_series(1, len(ps) - {K - 1})) AS s(j)
), dg AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + {K - 1}], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - {K - 1})) AS s(i)
), votes AS (
  SELECT DISTINCT doc_id, template, label, base, size, pos - place AS diagonal, place FROM dg JOIN tg USING (g)
), exact AS (
  SELECT doc_id, label, diagonal FROM votes WHERE base GROUP BY doc_id, template, label, size, diagonal HAVING count(*) = size
), bases AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base_set FROM exact GROUP BY doc_id
), diagonals AS (
  SELECT DISTINCT doc_id, template, diagonal FROM votes WHERE NOT base
), runs AS (
  SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS apart FROM diagonals)
), copies AS (
  SELECT doc_id, template, label, run, min(diagonal + place) AS first, max(diagonal + place + {K - 1}) AS last
  FROM votes JOIN runs USING (doc_id, template, diagonal) WHERE NOT base GROUP BY doc_id, template, label, size, run
  HAVING count(DISTINCT place) >= ceil({COVER} * size) AND max(diagonal + place + {K - 1}) - min(diagonal + place) + 1 <= 2 * (size + {K - 1})
), told AS (
  SELECT doc_id, template, run, first, last, c.label, count(DISTINCT j) / any_value(len(ps)) AS cover,
    count(DISTINCT j) FILTER (regexp_full_match(ps[j], '[0-9]+')) = any_value(len(list_filter(ps, lambda x: regexp_full_match(x, '[0-9]+')))) AS numbers
  FROM copies c JOIN runs USING (doc_id, template, run) JOIN t USING (template) JOIN w USING (doc_id), unnest(generate_series(1, len(ps))) AS s(j)
  WHERE j + diagonal BETWEEN first + 1 AND last + 1 AND ws[j + diagonal] = ps[j] GROUP BY doc_id, template, run, first, last, c.label
), sure AS (
  SELECT * FROM told WHERE cover >= {COVER} AND numbers
), owns AS (
  SELECT doc_id, list(DISTINCT label) FILTER (NOT EXISTS (SELECT 1 FROM sure o WHERE o.doc_id = c.doc_id AND o.first <= c.first AND o.last >= c.last AND o.last - o.first > c.last - c.first)) AS own_set,
    max(cover) AS cover FROM sure c GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(own_set, [])))), ',') AS labels,
  CASE WHEN base_set IS NOT NULL THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bases USING (doc_id) LEFT JOIN owns USING (doc_id)
"""
