"""Line-first cleaning: punctuation, navigation and boilerplate rules per line, then documents that lose too much go.

Only built-in column functions. Nulls and empty texts have no words and are not kept; repeated rows are judged alike;
columns of the input whose names clash with result columns are replaced by the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import split_words

WHITE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50       # words that may go with removed lines
MAX_MARK_PERCENT = 30       # words of a line that end in a doubled mark or hold a symbol
MIN_OPEN_WORDS = 8          # a line this long without a closing mark is not prose
NAVIGATION_BARS = 2
BOILERPLATE = r"(?i)^\s*(all rights reserved|copyright|©|licensed under|this work is licensed|released under|terms of (use|service)" \
              r"|privacy policy|cookie policy|click here|subscribe|sign up|log ?in\b|share this|skip to content|back to top)"


def line_passes(line: Column) -> Column:
    """Whether one line is kept: no navigation, no boilerplate, and prose punctuation. A line without words passes."""
    words = split_words(line, WHITE)
    n = F.size(words)
    bars = F.size(F.filter(words, lambda w: w == "|"))
    marked = F.size(F.filter(words, lambda w: w.rlike(r"[#*$%&|<>]|[!?]{2}")))
    open_end = (n >= MIN_OPEN_WORDS) & ~line.rlike(r"[.!?…:;,\"'”’)\]。！？]\s*$")
    return (n == 0) | ((bars < NAVIGATION_BARS) & ~line.rlike(BOILERPLATE) & (marked * 100 <= n * MAX_MARK_PERCENT) & ~open_end)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first finding included.

    Windows are sorted by a 64-bit hash inside the row, so work is n log n however often a window returns."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(t: Column) -> Column:
        twice = F.filter(t, lambda x, j: F.coalesce(F.get(t, j - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(t, j + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")),
                           lambda a: a["n"])

    def bound(w: Column) -> Column:
        hashes = F.transform(w, lambda x: x["h"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w), F.lit(0)).otherwise(
            F.element_at(F.transform(F.array(F.array_sort(w)), covered), 1))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.element_at(F.transform(F.array(windows), bound), 1))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts, the cleaned text (kept lines joined by a line feed), and whether the document is kept.

    Columns: id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, base_failed, kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(F.col("_text"), "\n", -1)
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id", "_text", split_words(F.col("_text"), WHITE).alias("_words"), lines.alias("_lines"))
    wordy = F.filter("_lines", lambda line: line.rlike(rf"[^{WHITE}]"))
    bare = F.translate("_text", " \t\n\x0b\x0c\r", "")
    counted = base.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        wordy.alias("_wordy"),
        F.filter("_lines", line_passes).alias("_kept_lines"))
    joined = counted.select(
        "*", (F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long").alias("n_dup_lines"),
        F.array_join("_kept_lines", "\n").alias("clean_text"))
    judged = joined.select(
        "*", F.size(split_words(F.col("clean_text"), WHITE)).cast("long").alias("kept_words"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("kept_words")) <= MAX_LOST_PERCENT * F.col("n_words"))
    return judged.select(F.col("_id").alias(id_col), "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "kept_words", "base_failed", kept.alias("kept"))
