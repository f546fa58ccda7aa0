"""Quality rules: a table of thresholds compiled into one projection of whole-text statistics.

DataFrame functions only; a text's row is all that is needed, so there is no shuffle. Windows of five
words are compared by their 64-bit hash, sorted inside the row: a false match would take two
different windows of one text with one xxHash64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages the rules serve; a text in none of them is judged by the other rules.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "des",
    "de", "la", "que", "el", "en", "los", "las", "y", "por", "con", "una",
    "le", "les", "et", "un", "une", "du", "est", "pour", "dans", "qui",
)
#: (statistic, least words, lowest, highest), bounds may be None. A text is kept if each of its
#: statistics is within its bounds; texts of fewer words than a rule's least are too short for it.
THRESHOLDS = (
    ("symbol_ratio", 0, None, 0.1),
    ("bar_ratio", 0, None, 0.15),
    ("mean_word_chars", 20, 2.0, 15.0),
    ("upper_ratio", 0, None, 0.5),
    ("exclaim_ratio", 0, None, 0.3),
    ("echo_ratio", 0, None, 0.3),
    ("stop_ratio", 100, 0.01, None),
    ("dup_line_ratio", 0, None, 0.5),
)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined into what uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows that a text has twice or more, the first included."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)),
        lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(window)]),
    )

    def covered(places: Column) -> Column:
        # Windows starting at these places: each adds what lies between its start and the next, at most a window.
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).alias("last")), lambda s, p: F.struct(
            (s["sum"] + F.least(F.lit(window), p - s["last"])).alias("sum"), p.alias("last")))["sum"]

    def places(sorted_pairs: Column) -> Column:
        def repeated(pair: Column, i: Column) -> Column:
            before, after = F.get(sorted_pairs, i - 1), F.get(sorted_pairs, i + 1)
            return (pair["h"] == before["h"]) | (pair["h"] == after["h"])

        same = F.filter(sorted_pairs, lambda p, i: F.coalesce(repeated(p, i), F.lit(False)))
        return F.sort_array(F.transform(same, lambda p: p["i"]))

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound(pairs, lambda s: covered(places(s))))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(bound(hashes, of))


def statistics(text: Column) -> Column:
    """Struct of a text's counts and ratios; null counts as a text without a word."""
    text = F.coalesce(text, F.lit(""))

    def lines(t: Column) -> Column:
        return bound(F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("long").alias("n_exclaimed"),
            F.size(F.filter(words, lambda w: w == "|")).cast("long").alias("n_bars"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_echoes"),
        )

    return F.struct(
        bound(words_of(text), of).alias("w"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines(text).cast("long").alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )


def apply_rules(docs: DataFrame, thresholds: tuple = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per input row. Null and empty texts have no word: every count is 0, base_failed is true,
    kept is false. Repeated rows are judged alike; other columns are ignored.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("s"))
    frame = frame.select("doc_id", "s.w.*", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_lines", "s.n_upper")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ratios = {
        "symbol_ratio": F.col("n_symbols") / chars, "mean_word_chars": F.col("word_chars") / words, "upper_ratio": F.col("n_upper") / chars,
        "exclaim_ratio": F.col("n_exclaimed") / words, "stop_ratio": F.col("n_stop") / words,
        "bar_ratio": F.col("n_bars") / words, "echo_ratio": F.col("n_echoes") / words, "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }
    verdict = F.lit(True)
    for name, least, low, high in thresholds:
        within = F.lit(True)
        if low is not None:
            within = within & (ratios[name] >= low)
        if high is not None:
            within = within & (ratios[name] <= high)
        verdict = verdict & (within | (F.col("n_words") < least))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return frame.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """apply_rules to all documents; null and empty texts fail, repeated rows are judged alike."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) > {WINDOW}),
k AS (SELECT r, i, w[i : i + {WINDOW - 1}] AS key FROM x),
often AS (SELECT *, count(*) OVER (PARTITION BY r, key) AS n FROM k),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM often WHERE n > 1) GROUP BY r),
f AS (
  SELECT r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         len(string_split(text, chr(10))) AS n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
         len(list_filter(w, lambda a: lower(a) IN ({_STOP}))) AS n_stop, len(list_filter(w, lambda a: ends_with(a, '!!'))) AS n_exclaimed, len(list_filter(w, lambda a: a = '|')) AS n_bars,
         len(list_filter(list_zip(w, [NULL] || w), lambda p: p[1] = p[2])) AS n_echoes
  FROM d),
g AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(n_words, 1)::DOUBLE AS words, greatest(word_chars, 1)::DOUBLE AS chars FROM f LEFT JOIN covered USING (r)),
h AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM g)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_symbols / chars <= 0.1 AND n_bars / words <= 0.15 AND (n_words < 20 OR word_chars / words BETWEEN 2.0 AND 15.0) AND n_upper / chars <= 0.5 AND n_exclaimed / words <= 0.3
  AND n_echoes / words <= 0.3 AND (n_words < 100 OR n_stop / words >= 0.01) AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept
FROM h
"""
