"""Line-first quality rules, as column expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed; a document that loses
too much of its text with them, says more than half of its lines again, or fails the word rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import WORD_GAP, id_text, once

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 20, 30, 40  # words; per cent of words; per cent of characters
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: Phrases of boilerplate lines: fixed values.
BOILERPLATE = ("all rights reserved", "terms of (use|service)", "privacy policy", "cookie (policy|settings)", "accept (all )?cookies",
               "enable javascript", "click here", "sign (up|in)", "log ?in", "subscribe (now|to)", "read more", "share (on|this)",
               "follow us", "back to top", "skip to (main )?content", "powered by", "copyright (©|[0-9]{4})", "lorem ipsum")

#: Line rules by name; each is true for a line that fails. `l` is the line; the patterns read alike in Java and RE2.
LINE_RULES = {
    # more than one character of twenty is a symbol
    "symbols": f"20 * (length(l) - length(regexp_replace(l, '{SYMBOLS}', ''))) > length(l)",
    # runs of exclamation or question marks behind every fifth word or more
    "marks": "5 * regexp_count(l, '[!?][!?]+') > regexp_count(l, '[^ \\\\x09-\\\\x0D]+')",
    # five words or more without a small letter
    "capitals": "(NOT l RLIKE '\\\\p{Ll}') AND l RLIKE '\\\\p{Lu}.*\\\\p{Lu}.*\\\\p{Lu}' AND regexp_count(l, '[^ \\\\x09-\\\\x0D]+') >= 5",
    # separators of a menu
    "menu": "regexp_count(l, ' [|»›·•>/] ') >= 3 AND 3 * regexp_count(l, ' [|»›·•>/] ') >= regexp_count(l, '[^ \\\\x09-\\\\x0D]+')",
    # every third word or more says its predecessor again
    "stutter": "transform(array(split(l, '[ \\\\x09-\\\\x0D]+', -1)), w -> size(w) >= 6 AND 3 * size(filter(w, (x, k) -> x = get(w, k - 1))) >= size(w))[0]",
    # up to three words that end without punctuation
    "fragment": "regexp_count(l, '[^ \\\\x09-\\\\x0D]+') < 4 AND NOT l RLIKE '[.!?:;…\"”’»)\\\\]][ \\\\x09-\\\\x0D]*\\\\z'",
    # a short line with a phrase of boilerplate
    "boilerplate": f"length(l) <= 200 AND l RLIKE '(?i)({'|'.join(BOILERPLATE)})'",
}
_BLANK = "(NOT l RLIKE '[^ \\\\x09-\\\\x0D]')"
LINE_FAILS = " OR ".join(f"({rule})" for rule in LINE_RULES.values())


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = MOST_LOST,
            carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_bad_lines, lost_chars, kept, cleaned.

    `cleaned` is the text without failing lines (blank lines stay). A NULL or empty text has zeros, fails the base and is
    not kept; its cleaned text is what it was. Columns named in *carry* come back in a struct `carried`. Repeated rows are judged alike, each for itself.
    """
    rows = id_text(docs, id_col, text_col, carry)
    also = ["carried"] if carry else []
    # figures are made once per row, filters on them included; arrays are bound as lambda variables, so that each is made once per row
    parts = rows.withColumn("t", F.coalesce("text", F.lit(""))).select(
        "doc_id", "text", *also, "t", F.filter(F.split("t", WORD_GAP, -1), lambda w: w != "").alias("w"), F.split("t", "\n", -1).alias("lines"))
    windows = f"""CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) END"""
    some = parts.select("*", F.expr(f"coalesce(transform(array({windows}), h -> size(array_distinct(h)) < size(h))[0], false)").alias("repeats"),
                        F.expr(f"filter(lines, l -> {_BLANK} OR NOT ({LINE_FAILS}))").alias("good"),
                        F.expr(f"filter(lines, l -> NOT {_BLANK})").alias("full"))
    # only texts with a repeated hash look at the windows themselves, sorted next to their equals
    repeated = f"""CASE WHEN repeats THEN
        transform(array(sort_array(transform(sequence(1, size(w) - {WINDOW - 1}), i -> struct(array_join(slice(w, i, {WINDOW}), ' ') AS g, i AS i)))),
        s -> transform(array(array_sort(transform(filter(transform(s, (x, k) -> struct(x.i AS i, (x.g <=> get(s, k - 1).g OR x.g <=> get(s, k + 1).g) AS twice)),
        y -> y.twice), y -> y.i))), p -> aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x))[0])[0]
        ELSE 0L END"""
    figures = once(
        some, "doc_id", "text", *also, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr("CAST(size(full) - size(array_distinct(full)) AS LONG)").alias("n_dup_lines"), F.expr(repeated).alias("n_repeat_words"),
        F.size("full").cast("long").alias("n_lines"), F.expr("CAST(size(lines) - size(good) AS LONG)").alias("n_bad_lines"),
        F.expr("CAST(length(array_join(lines, '')) AS LONG)").alias("chars"), F.expr("CAST(length(array_join(good, '')) AS LONG)").alias("left_chars"),
        F.when(F.col("text").isNotNull(), F.array_join("good", "\n")).alias("cleaned"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.col("chars") - F.col("left_chars")
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_lines", "n_bad_lines",
        lost.alias("lost_chars"), (
            ~failed & (100 * lost <= most_lost * F.col("chars")) & (2 * F.col("n_dup_lines") <= F.col("n_lines"))).alias("kept"), "cleaned", *also)
