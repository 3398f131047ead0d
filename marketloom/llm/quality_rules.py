"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import broadcast_if_small, documents, gram_hashes, hashes, stored, text_of, words

WINDOW = 8
#: Rule: least spread it allows for, in the rule's unit. A rate over Q3 + REACH * max(Q3 - Q1, least spread) fails, and for
#: rules of TWO_SIDED one below Q1 less as much. Rates are thousandths, but `word_size` is tenths of a character a word.
RULES = {"marks": 30, "upper": 30, "dup_lines": 100, "repeats": 50, "runs": 30, "word_size": 12}
TWO_SIDED = ("word_size",)
REACH = 3
#: So many documents' weight has a language's sketch in the quartiles of its sources, and that of all documents in a language's.
PRIOR = 50


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.floor(part * 1000 / whole), F.lit(1000))).otherwise(F.lit(0)).cast("int")


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts of each text and its rates in thousandths, one column a rule (r_<rule>)."""
    text = text_of("text")
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    # Words as hashes, windows as hashes of those: all within the row.
    df = docs.withColumns({"_t": hashes(words(F.col("text"))), "_bare": bare})
    df = df.withColumns(
        {
            "n_words": F.size("_t").cast("long"),
            "word_chars": F.length("_bare").cast("long"),
            "n_symbols": F.length(F.regexp_replace("_bare", r"[^#*$%&|<>]+", "")).cast("long"),
            "_marks": F.length(F.regexp_replace("_bare", r"[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", "")),
            "_upper": F.length(F.regexp_replace("_bare", r"[^\p{Lu}]+", "")),
            "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            "_runs": F.size(F.filter("_t", lambda x, i: F.coalesce(x == F.get(F.col("_t"), i + 1), F.lit(False)))),
            "_grams": gram_hashes(F.col("_t"), WINDOW),
        }
    )
    # Only a text with an equal pair of windows pays for finding which: (hash, place) in order, neighbours compared.
    paired = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(paired, F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, F.get(F.col("_sorted"), i - 1)) | same(x, F.get(F.col("_sorted"), i + 1)))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - x, F.lit(WINDOW))))
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_sum(covered), F.lit(0)).cast("long"),
            "_n_lines": F.size("_lines"),
        }
    )
    rates = {
        "marks": _per_mille(F.col("_marks"), F.col("word_chars")),
        "upper": _per_mille(F.col("_upper"), F.col("word_chars")),
        "dup_lines": _per_mille(F.col("n_dup_lines"), F.col("_n_lines")),
        "repeats": _per_mille(F.col("n_repeat_words"), F.col("n_words")),
        "runs": _per_mille(F.col("_runs"), F.col("n_words")),
    }
    rates["word_size"] = F.when(F.col("n_words") > 0, F.least(F.floor(F.col("word_chars") * 10 / F.col("n_words")), F.lit(1000))).otherwise(F.lit(0)).cast("int")
    df = df.withColumns({f"r_{k}": v for k, v in rates.items()})
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    return df.drop("_t", "_bare", "_marks", "_upper", "_lines", "_runs", "_grams", "_sorted", "_at", "_n_lines")


def sketches(rated: DataFrame) -> DataFrame:
    """Counts per language, source, rule and thousandth: at most 1,001 bins a rule, and sums of bins merge sketches."""
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"r_{k}").alias("bin")) for k in RULES])
    return rated.select("lang", "source", F.explode(cells).alias("c")).groupBy("lang", "source", "c.rule", "c.bin").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile (the least bin that reaches the rank) and number of documents per key and rule."""
    by = [*keys, "rule"]
    merged = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.withColumn("c", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(
        F.max("all").alias("n"),
        F.min(F.when(F.col("c") * 4 >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("c") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"),
    )


def thresholds(rated: DataFrame, reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """One row per language and source with the highest and, of two-sided rules, the lowest rate that passes (t_<rule>, b_<rule>).

    A group's quartiles are weighed means of its own and its language's, and those of its language's and all documents': the
    parent's weigh as much as `prior` documents. So a large group goes by its own sketch, a small one by its parent's, and
    nothing changes at once when a group grows.
    """
    bins = sketches(rated)
    own = _quartiles(bins, ["lang", "source"])
    lang = _quartiles(bins, ["lang"]).select(F.col("lang").alias("_l"), "rule", *[F.col(c).alias(f"l_{c}") for c in ("n", "q1", "q3")])
    every = _quartiles(bins, []).select("rule", *[F.col(c).alias(f"e_{c}") for c in ("q1", "q3")])
    wide = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (own["rule"] == lang["rule"])).drop(lang["rule"]).join(every, "rule")
    mean = lambda n, q, parent: (F.col(n) * F.col(q) + prior * parent).cast("double") / (F.col(n) + prior)
    q1, q3 = (mean("n", q, mean("l_n", f"l_{q}", F.col(f"e_{q}"))) for q in ("q1", "q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule"))
    wide = wide.withColumns({"_q1": q1, "_q3": q3}).withColumn("_reach", reach * F.greatest(F.col("_q3") - F.col("_q1"), least.cast("double")))
    pick = lambda k, value: F.max(F.when(F.col("rule") == k, value))
    tops = [pick(k, F.col("_q3") + F.col("_reach")).alias(f"t_{k}") for k in RULES]
    return wide.groupBy("lang", "source").agg(*tops, *[pick(k, F.col("_q1") - F.col("_reach")).alias(f"b_{k}") for k in TWO_SIDED])


def judged(rated: DataFrame) -> DataFrame:
    """Adds kept. `rated` is read twice (sketches, verdicts), so it should be a stored table."""
    limits = broadcast_if_small(stored(thresholds(rated).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "limits"))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    passed = F.lit(True)
    for k in RULES:
        passed = passed & (F.col(f"r_{k}") <= F.col(f"t_{k}"))
    for k in TWO_SIDED:
        passed = passed & (F.col(f"r_{k}") >= F.col(f"b_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & passed)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Null text: no words, so rejected. A very long text is judged by its rates like others. Null lang or source: a group of its
    own. Repeated rows are judged alike. An empty table gives an empty result.
    """
    packed = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    rated = stored(with_counts(packed).drop("text"), "rated")
    return judged(rated).filter("kept").select("_row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    rated = stored(with_counts(docs).drop("text"), "rated")
    return judged(rated).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 7)) AS s(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, sum(x) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS x FROM twice) GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
    length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(bare, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS marks,
    length(regexp_replace(bare, '[^\p{Lu}]+', '', 'g')) AS upper,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(list_zip(ws[1:-2], ws[2:]), lambda p: p[1] = p[2])) AS runs
  FROM w LEFT JOIN covered USING (doc_id)
), rated AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN least(1000 * marks // word_chars, 1000) ELSE 0 END AS r_marks,
    CASE WHEN word_chars > 0 THEN least(1000 * upper // word_chars, 1000) ELSE 0 END AS r_upper,
    CASE WHEN n_lines > 0 THEN least(1000 * n_dup_lines // n_lines, 1000) ELSE 0 END AS r_dup_lines,
    CASE WHEN n_words > 0 THEN least(1000 * n_repeat_words // n_words, 1000) ELSE 0 END AS r_repeats,
    CASE WHEN n_words > 0 THEN least(1000 * runs // n_words, 1000) ELSE 0 END AS r_runs,
    CASE WHEN n_words > 0 THEN least(10 * word_chars // n_words, 1000) ELSE 0 END AS r_word_size
  FROM counts
), cells AS (
  SELECT lang, source, 'marks' AS rule, r_marks AS bin, 30 AS least FROM rated
  UNION ALL SELECT lang, source, 'upper', r_upper, 30 FROM rated
  UNION ALL SELECT lang, source, 'dup_lines', r_dup_lines, 100 FROM rated
  UNION ALL SELECT lang, source, 'repeats', r_repeats, 50 FROM rated
  UNION ALL SELECT lang, source, 'runs', r_runs, 30 FROM rated
  UNION ALL SELECT lang, source, 'word_size', r_word_size, 12 FROM rated
), own AS (
  SELECT lang, source, rule, least, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM cells GROUP BY ALL
), langs AS (
  SELECT lang, rule, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM cells GROUP BY ALL
), every AS (
  SELECT rule, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM cells GROUP BY ALL
), parents AS (
  SELECT langs.lang, langs.rule, (langs.n * langs.q1 + 50 * every.q1)::DOUBLE / (langs.n + 50)::DOUBLE AS q1, (langs.n * langs.q3 + 50 * every.q3)::DOUBLE / (langs.n + 50)::DOUBLE AS q3
  FROM langs JOIN every USING (rule)
), picked AS (
  SELECT own.lang, own.source, own.rule, own.least, ((own.n * own.q1)::DOUBLE + 50 * p.q1) / (own.n + 50)::DOUBLE AS q1, ((own.n * own.q3)::DOUBLE + 50 * p.q3) / (own.n + 50)::DOUBLE AS q3
  FROM own JOIN parents p ON own.lang IS NOT DISTINCT FROM p.lang AND own.rule = p.rule
), limits AS (
  SELECT lang, source, map(list(rule), list(q3 + 3 * greatest(q3 - q1, least::DOUBLE))) AS t, map(list(rule), list(q1 - 3 * greatest(q3 - q1, least::DOUBLE))) AS b FROM picked GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r_marks <= t['marks'] AND r_upper <= t['upper'] AND r_dup_lines <= t['dup_lines']
    AND r_repeats <= t['repeats'] AND r_runs <= t['runs'] AND r_word_size BETWEEN b['word_size'] AND t['word_size'] AS kept
FROM rated JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang AND rated.source IS NOT DISTINCT FROM limits.source
"""
