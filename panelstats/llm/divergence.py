"""Quality rules by distribution divergence: how far a text's characters and common words are from its language's.

1. One pass counts the words of every language. From these counts alone come the two references of a language: the
   shares of the character classes of its words, and the shares of its most common words.
2. A second pass gives each text the same two histograms and their Jensen-Shannon distances (base 2, from 0 to 1) to the
   references, next to the plain rules: symbols, repeated lines, repeated three-word windows.
3. A distance counts only for texts long enough to have a histogram (minimum-length guards).

All of it is built from SQL functions; a text never leaves the row it was read in. The references hold one row per
language and are joined by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.llm.common import whole_text
from panelstats.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
COMMON = r"[a-z\x20\x09-\x0D]+"  # in no class and no symbol, and most of a text
# fixed values: the classes of characters inside words; small letters and whatever is in none of them make the last
CLASSES = {"capital": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-", "sign": r"#$%&*+/<=>@\[\\\]^_`{|}~", "beyond": "\\x{80}-\\x{10FFFF}"}
PLACE_BITS = 24  # of a sort key; the rest of its bits are of a window's hash


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _class_counts(text: Column) -> list[Column]:
    """How many characters of each class, but for the last, the text has; white space is in no class."""
    return [F.length(F.regexp_replace(text, f"[^{chars}]+", "")) for chars in CLASSES.values()]


def _with_rest(counts: list[Column], total: Column) -> Column:
    return F.array(*counts, total - sum(counts[1:], counts[0]))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once although the body names it several times."""
    return F.transform(F.array(value), body)[0]


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = 20) -> DataFrame:
    """lang, class_shares, words, word_shares: one row for each language that has words.

    words: its `common` most frequent words, of equally frequent ones the smaller; word_shares: their shares of all
    words. A missing language is the language ''.
    """
    each = docs.select(_language(lang_col).alias("lang"), F.explode(_words(whole_text(text_col))).alias("word"))
    counted = materialise(each.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    sums = [F.sum(c * F.col("n")).alias(f"c{k}") for k, c in enumerate([*_class_counts(F.col("word")), F.length("word")])]
    totals = counted.groupBy("lang").agg(F.sum("n").alias("all_words"), *sums)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= common)
    best = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("best"))
    size = F.col(f"c{len(CLASSES)}")
    return totals.join(best, "lang").select(
        "lang", F.transform(_with_rest([F.col(f"c{k}") for k in range(len(CLASSES))], size), lambda c: c / size).alias("class_shares"),
        F.col("best.word").alias("words"), F.transform("best", lambda b: b["n"] / F.col("all_words")).alias("word_shares"))


def _part(share: Column) -> Column:
    """share * log2(share), which is 0 at 0."""
    return F.when(share > 0, share * F.log2(share)).otherwise(0.0)


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of the same length."""
    terms = F.zip_with(left, right, lambda p, q: (_part(p) + _part(q)) / 2 - _part((p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t), F.lit(0.0)))


def _in_windows(places: Column, width: int) -> Column:
    """How many words stand in the windows that start at the sorted places."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, x: F.struct(
        x.alias("last"), (a["n"] + F.least(F.lit(width), x - a["last"])).alias("n")), lambda a: a["n"])


def _beside(ordered: Column, of) -> Column:
    """Elements of a sorted array whose `of` equals that of a neighbour."""
    same = lambda x, y: F.coalesce(of(x) == of(y), F.lit(False))
    return _let(ordered, lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)))


def _ordered_places(hashes: Column) -> Column:
    """Places of windows that share the upper bits of their hash with another: (those bits, place) in one integer each."""
    keys = F.transform(hashes, lambda h, k: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(k.cast("long")))
    return _beside(F.sort_array(keys), lambda x: F.shiftright(x, PLACE_BITS))


def _slow_places(windows: Column) -> Column:
    """First words of windows that occur at least twice, by the windows themselves."""
    ordered = F.sort_array(F.transform(windows, lambda w, k: F.struct(w.alias("w"), k.cast("int").alias("k"))))
    return F.sort_array(F.transform(_beside(ordered, lambda x: x["w"]), lambda x: x["k"]))


def judge(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          least_words: int = 50, most_repeated: float = 0.5, most_class: float = 0.35, most_word: float = 0.35,
          guard_chars: int = 200, guard_words: int = 100, window_hash=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept. `found` are the references of the languages.

    base_failed: fewer than `least_words` words, or more than `most_repeated` of them in three-word windows that occur
    twice. kept: base did not fail and no distance is above its limit. A distance is missing, and does not count, below
    `guard_chars` characters in words or `guard_words` words, or where the language has no reference. A missing text
    has no words; a missing id is kept; repeated rows each give a row. Texts are judged whole.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _language(lang_col).alias("lang"),
                       whole_text(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    # classes and symbols are counted in the little that is left without the common characters
    cut = base.select("doc_id", "lang", _words(F.col("text")).alias("w"), lines.alias("lines"),
                      F.regexp_replace("text", COMMON, "").alias("rest"))
    w, n = F.col("w"), F.col("n_words")
    classes = [F.col(f"c{k}") for k in range(len(CLASSES))]
    measured = cut.select(
        "doc_id", "lang", "w", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("rest", SYMBOLS, "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        *[c.alias(f"c{k}") for k, c in enumerate(_class_counts(F.col("rest")))])
    triples = lambda make: F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda a, k: make(
        a, F.get(w, k + 1), F.get(w, k + 2)))
    spelt = lambda k: F.concat_ws(" ", F.get(w, k), F.get(w, k + 1), F.get(w, k + 2))
    hashed = measured.withColumn("h", triples(window_hash))
    # windows without equal hashes are different; with equal ones they are compared
    doubtful = (n >= 3) & (F.size(F.array_distinct("h")) < F.size("h"))
    short = F.size("h") < (1 << PLACE_BITS)
    found_places = hashed.withColumn("at", F.when(doubtful & short, _ordered_places(F.col("h"))))
    found_places = found_places.withColumn("doubtful", doubtful).drop("h")
    low = (1 << PLACE_BITS) - 1
    starts = F.transform("at", lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    # as many different windows as different keys: then every key stands for one window
    faithful = F.size(F.array_distinct(F.transform("at", lambda x: F.shiftright(x, PLACE_BITS)))) == F.size(
        F.array_distinct(F.transform("at", lambda x: spelt(x.bitwiseAND(F.lit(low)).cast("int")))))
    slow = _slow_places(triples(lambda a, b, c: F.concat_ws(" ", a, b, c)))
    repeated = F.when(~F.col("doubtful"), 0).when(F.col("at").isNotNull() & faithful, _in_windows(F.sort_array(starts), 3)).otherwise(
        _in_windows(slow, 3))
    near = found_places.withColumn("n_repeat_words", repeated).drop("at", "doubtful").join(found, "lang", "left")
    places = F.filter(F.transform("w", lambda x: F.array_position("words", x)), lambda p: p > 0)
    counts = lambda at: F.transform("words", lambda _, k: F.size(at) - F.size(F.array_remove(at, (k + 1).cast("long"))))
    other = lambda shares: F.aggregate(shares, F.lit(1.0), lambda left, s: left - s)
    whole = lambda shares: F.concat(shares, F.array(F.greatest(other(shares), F.lit(0.0))))
    judged = near.withColumn("own", F.when(n >= guard_words, _let(places, counts))).drop("w", "words")
    own = F.transform("own", lambda c: c / n)
    class_ok = F.col("class_shares").isNotNull() & (F.col("word_chars") >= guard_chars)
    result = judged.select(
        "doc_id", n.cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        ((n < least_words) | (F.col("n_repeat_words") > most_repeated * n)).alias("base_failed"),
        F.round(F.when(class_ok, js_distance(F.transform(_with_rest(classes, F.col("word_chars")), lambda c: c / F.col("word_chars")), F.col("class_shares"))), 6).alias("class_distance"),
        F.round(F.when(F.col("own").isNotNull() & F.col("word_shares").isNotNull(),
                       js_distance(whole(own), whole(F.col("word_shares")))), 6).alias("word_distance"))
    far = F.coalesce(F.col("class_distance") > most_class, F.lit(False)) | F.coalesce(F.col("word_distance") > most_word, F.lit(False))
    return result.withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = 20,
            **limits) -> DataFrame:
    """`judge` by references taken from all the documents themselves; no documents give no rows."""
    found = materialise(references(docs, text_col, lang_col, common), "references")
    return judge(docs, found, id_col, text_col, lang_col, **limits)
