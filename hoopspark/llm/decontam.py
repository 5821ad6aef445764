"""Benchmark decontamination by a distributed positional inverted index. Only built-in column functions.

Every window of an item is looked up by its two rarest words: their postings in the training texts, shifted by their
offset in the item, are intersected, and the whole window is compared where both lists agree.

Nulls and empty texts have no words and hit nothing; an item without words is no item; repeated rows get the same result;
other columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoopspark.llm.shared import LIMIT_BROADCAST, fold_case, split_words
from hoopspark.session import written

APART = r"\x00-\x2F\x3A-\x60\x7B-\x7F"   # ASCII other than digits and lower-case letters
WINDOW = 13
HIT_PARTS = 20               # contaminated from one word in twenty
TERM_BLOCK = 200_000         # index terms broadcast at once; more of them go in further blocks


def words_of(text: Column) -> Column:
    return split_words(fold_case(text), APART)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's identity is its id and its text, so repeated rows share one result."""
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"),
                       words_of(F.col(text_col)).alias("_words"))


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """A stored table of words, in parts of bounded size."""
    n = max(1, -(-terms.count() // TERM_BLOCK))
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i)) for i in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in the training texts of each of a stored table of words."""
    tokens = docs.select(F.explode("_words").alias("word"))
    return _union([tokens.join(block, "word").groupBy("word").count() for block in _blocks(terms)])


def item_windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, words, s, width, a, b): every window of every item with the places of its rarest and second rarest word.

    Windows with a word that no training text has cannot occur and are left out. b is null for a window of one word."""
    ranked = (items.select("item", "item_words", F.posexplode("item_words").alias("j", "word")).join(counts, "word", "left")
              .groupBy("item").agg(F.first("item_words").alias("item_words"),
                                   F.array_sort(F.collect_list(F.struct("j", F.coalesce("count", F.lit(0)).alias("n"), "word"))).alias("t")))
    width = F.least(F.size("t"), F.lit(window))
    spread = ranked.select("item", "item_words", "t", width.alias("width"),
                           F.explode(F.sequence(F.lit(0), F.size("t") - width)).alias("s"))
    rare = F.array_sort(F.transform(F.slice("t", F.col("s") + 1, F.col("width")), lambda x: F.struct(x["n"].alias("n"), x["j"].alias("j"))))
    return (spread.select("item", "s", "width", F.slice("item_words", F.col("s") + 1, F.col("width")).alias("phrase"),
                          F.col("t")["word"].alias("_item_terms"), rare.alias("r"))
            .where(F.get("r", F.lit(0))["n"] > 0)
            .select("item", "s", "width", "phrase", F.get("r", F.lit(0))["j"].alias("a"), F.get("r", F.lit(1))["j"].alias("b"), "_item_terms")
            .withColumn("a_word", F.get("_item_terms", F.col("a"))).withColumn("b_word", F.get("_item_terms", F.col("b")))
            .drop("_item_terms"))


def postings(docs: DataFrame, terms: DataFrame, window: int) -> DataFrame:
    """The positional index of the chosen words: (id, key, word, pos) and the words around each place."""
    tokens = docs.select("_id", "_key", "_words", F.posexplode("_words").alias("pos", "word"))
    low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    return _union([tokens.join(block, "word").select(
        "_id", "_key", "word", "pos", low.alias("low"), F.slice("_words", low + 1, F.lit(2 * window - 1)).alias("around"))
        for block in _blocks(terms)])


def index(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """The stored postings and the stored windows they serve."""
    keyed = _keyed(docs, id_col, text_col)
    own = (items.select(F.struct(F.col(item_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key")).alias("item"),
                        words_of(F.col(text_col)).alias("item_words")).where(F.size("item_words") > 0).dropDuplicates(["item"]))
    terms = written(own.select(F.explode("item_words").alias("word")).distinct(), "terms")
    windows = written(item_windows(own, written(term_counts(keyed, terms), "counts"), window), "windows")
    chosen = written(windows.select(F.explode(F.array("a_word", "b_word")).alias("word")).where("word is not null").distinct(), "terms")
    return written(postings(keyed, chosen, window), "postings"), windows


def _aligned(post: DataFrame, windows: DataFrame, which: str) -> DataFrame:
    """Postings of the rarest (a) or second rarest (b) word of each window, moved to where the item would begin."""
    side = windows.where(F.col(which).isNotNull()).select("item", "s", F.col(which).alias("j"), F.col(f"{which}_word").alias("word"))
    return post.join(side, "word").select("_id", "_key", "item", "s", (F.col("pos") - F.col("j")).alias("diagonal"), "pos", "low", "around")


def exact_matches(post: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, key, item, start, width): every place where all words of a window stand."""
    a, b = _aligned(post, windows, "a"), _aligned(post, windows, "b").select("_id", "_key", "item", "s", "diagonal").distinct()
    on = [F.col("x._id").eqNullSafe(F.col("y._id")), F.col("x._key") == F.col("y._key"), F.col("x.item") == F.col("y.item"),
          F.col("x.s") == F.col("y.s"), F.col("x.diagonal") == F.col("y.diagonal")]
    lone = windows.where("b is null").select("item", "s")
    both = a.alias("x").join(b.alias("y"), on, "left_semi").unionByName(a.join(lone, ["item", "s"], "left_semi"))
    start = F.col("diagonal") + F.col("s")
    return (both.join(windows.select("item", "s", "width", "phrase"), ["item", "s"])
            .where((start >= F.col("low")) & (F.slice("around", F.greatest(start - F.col("low") + 1, F.lit(1)), F.col("width")) == F.col("phrase")))
            .select("_id", "_key", "item", start.alias("start"), "width").distinct())


def proximity_matches(post: DataFrame, windows: DataFrame, slop: int = 4) -> DataFrame:
    """(id, key, item, s, shift): windows whose two rarest words stand in a text at most slop words off their distance
    in the item. The lists meet on blocks of 'slop' places, own and next, so no list is paired with a whole other list."""
    block = F.floor(F.col("diagonal") / F.lit(max(1, slop)))
    a = _aligned(post, windows, "a").select("_id", "_key", "item", "s", "diagonal", block.alias("block"))
    b = (_aligned(post, windows, "b").select("_id", "_key", "item", "s", F.col("diagonal").alias("other"), block.alias("own"))
         .select("_id", "_key", "item", "s", "other", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("block")))
    shift = F.col("other") - F.col("diagonal")
    return (a.where(F.col("_id").isNotNull()).join(b, ["_id", "_key", "item", "s", "block"]).where(F.abs(shift) <= slop)
            .select("_id", "_key", "item", "s", shift.alias("shift")).distinct())


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id") -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items (their ids), contaminated."""
    found = exact_matches(*index(docs, items, window, id_col, text_col, item_col))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["width"] - 1)))))
    per = (found.groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "width")).alias("spans"), F.collect_set("item").alias("found"))
           .select(F.col("_id").alias("hit_id"), F.col("_key").alias("hit_key"), hit.cast("long").alias("hits"),
                   F.array_sort(F.transform("found", lambda x: F.coalesce(x["id"].cast("string"), F.lit("")))).alias("ids")))
    sized = _keyed(docs, id_col, text_col).select("_id", "_key", F.size("_words").cast("long").alias("n_words"))
    joined = sized.join(per, F.col("_id").eqNullSafe(F.col("hit_id")) & (F.col("_key") == F.col("hit_key")), "left")
    n_hit, ids = F.coalesce("hits", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "n_words", n_hit.alias("n_hit"),
                         F.size(ids).cast("long").alias("n_items"), ids.alias("items"),
                         ((n_hit > 0) & (HIT_PARTS * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id") -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    bad = written(contamination(docs, items, window, id_col, text_col, item_col).where("contaminated")
                  .select(F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= LIMIT_BROADCAST else bad
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (own == bad["_bad_key"]), "left_anti")
