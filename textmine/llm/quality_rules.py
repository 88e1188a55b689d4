"""Quality rules: a threshold table compiled into one projection.

A rule is a row ``(name, metric, op, bound)``.  ``counts`` computes the counts
of a text, ``metrics`` the ratios built from them, and ``apply_rules`` turns
the table into columns of one ``select``.  Everything is built-in expressions
on one row at a time: no shuffle, no Python.

Defined cases: a null or empty text has no words, so every count is 0 and the
base rules reject it; each row is judged by itself, so ties cannot occur and
repeated rows are judged alike; an empty table gives an empty result.  Of the
input only the key and the text are read, so other columns may have any name;
a null key is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmine.llm.common import WHITE, read_table

# Frequent function words of the documents' languages, in lower
# case as they stand inside a sentence.
STOP_WORDS = (
    "a", "and", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "what", "with",
    "als", "das", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que",
    "qui", "sur", "un", "une",
    "al", "con", "del", "el", "los", "no", "para", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text when ``metric op bound`` holds."""

    name: str
    metric: str
    op: str
    bound: float


# The production threshold table.
RULES = (
    Rule("words_too_short", "mean_word_chars", "<", 2.0),
    Rule("words_too_long", "mean_word_chars", ">", 20.0),
    Rule("symbols", "symbols_per_word", ">", 0.10),
    Rule("exclamations", "exclamations_per_word", ">", 0.20),
    Rule("stop_words", "stop_word_share", "<", 0.02),
    Rule("duplicate_lines", "duplicate_line_share", ">", 0.50),
    Rule("bullet_lines", "bullet_line_share", ">", 0.90),
    Rule("ellipsis_lines", "ellipsis_line_share", ">", 0.50),
)

_OPS = {"<": Column.__lt__, ">": Column.__gt__}
_RATIOS = (
    ("mean_word_chars", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("exclamations_per_word", "n_exclamations", "n_words"),
    ("stop_word_share", "n_stop_words", "n_words"),
    ("duplicate_line_share", "n_dup_lines", "n_lines"),
    ("bullet_line_share", "n_bullet_lines", "n_lines"),
    ("ellipsis_line_share", "n_ellipsis_lines", "n_lines"),
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics() -> dict[str, Column]:
    """Metric name -> ratio of two counts, 0 where the divisor is 0."""
    return {name: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
            for name, part, whole in _RATIOS}


def _removed(text: str, pattern: str) -> Column:
    """How many characters of ``text`` match the one-character ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _following(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array), F.lit(1)))


def counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the long counts that metrics and base rules read, one row per input row."""
    # Each step names the array of the step before at least twice, so the
    # optimiser keeps the projections apart and builds every array once a row.
    d = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    trimmed = F.regexp_replace("t", rf"^{WHITE}|{WHITE}$", "")
    d = d.select("key", "t", trimmed.alias("s"))
    d = d.select(
        "key", "t",
        F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", WHITE)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    # Words as 64-bit hashes: arrays of longs are cheap to shift and compare.
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    pairs = F.zip_with("h", _following("h", 1), lambda x, y: F.xxhash64(x, y))
    grams = F.slice(F.zip_with(pairs, _following("h", 2), lambda x, y: F.xxhash64(x, y)),
                    1, F.greatest(F.size("h") - 2, F.lit(0)))
    placed = F.arrays_zip(grams.alias("h"), F.sequence(F.lit(0), F.greatest(F.size("h") - 3, F.lit(0))).alias("p"))
    stop = [F.xxhash64(F.lit(w)) for w in STOP_WORDS]
    d = d.select(
        "key",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _removed("t", "[#*$%&|<>]").cast("long").alias("n_symbols"),
        _removed("t", "!").cast("long").alias("n_exclamations"),
        F.size(F.filter("h", lambda x: x.isin(*stop))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.when(F.size("h") > 2, F.sort_array(placed)).otherwise(F.sort_array(F.slice(placed, 1, 0))).alias("g"))
    # Equal 3-word windows are neighbours in ``g``; ``p`` are their positions,
    # and each position covers the words up to the next one, three at most.
    same = F.zip_with("g", _following("g", 1),
                      lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    d = d.withColumn("p", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    spans = F.zip_with("p", _following("p", 1), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.aggregate(spans, F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("g", "p").withColumnRenamed("key", key)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def apply_rules(df: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` (array of names) and ``kept`` of every row."""
    m = metrics()
    broken = F.filter(F.array(*[F.when(_OPS[r.op](m[r.metric], F.lit(r.bound)), F.lit(r.name)) for r in rules]),
                      lambda x: x.isNotNull())
    d = counts(df, key, text).withColumn("base_failed", base_failed())
    d = d.withColumn("failed_rules", broken)
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(df: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text passes: filtered in place, no join."""
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    d = df.select(row)
    judged = apply_rules(d.select("row", F.col(f"row.`{text}`").alias("text")), rules, "row", "text")
    # The row number keeps the filter above the projections: pushed below, it
    # would evaluate the counts again for every rule that reads them.
    judged = judged.select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def _sql(relation: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratios = {name: f"(CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0.0 END)" for name, part, whole in _RATIOS}
    broken = " OR ".join(f"{ratios[r.metric]} {r.op} {r.bound}::DOUBLE" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {relation}),
s AS (SELECT rid, doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) > 2)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
v AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
c AS (SELECT s.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(replace(t, '!', '')) AS n_exclamations,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
        coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN v ON s.rid = v.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({broken})) AS kept
FROM b
"""


SQL = _sql("documents")
