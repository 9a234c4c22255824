"""Line-first cleaning: judge each line, drop failing lines, reject documents that lose too much.

Everything is a DataFrame expression inside the row: no shuffle, no Python, one pass over the text.

Line rules (a line is what lies between newlines and has at least one word):

- *navigation*: at least three separators (``|``, ``>``, bullets, guillemets) standing as words, and one for
  every four words or more: menus and link lists;
- *symbols*: more than a tenth of its characters are ``# * $ % & | < >``;
- *boilerplate*: at most 20 words, with a fixed phrase such as "all rights reserved";
- *punctuation*: fewer than 10 words and no closing punctuation at its end.

A document is kept unless the base rule fails it (under 20 words, or more than 30 % of its words in repeated
8-word windows) or the dropped lines held more than half of its word characters.

Defined cases: a null text has no words and fails; an empty table gives an empty table; repeated rows are judged each
by itself; columns of the input stay, except that those with the names of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlab.llm.store import words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Phrases of lines that are about the site and not of its text, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "click here", "read more", "sign up",
    "log in", "subscribe to our", "share this", "follow us", "skip to content", "back to top", "powered by",
    "lorem ipsum", "licensed under", "released under", "this work is licensed",
)

#: Marks that end a sentence, and what may close behind them.
ENDINGS = r"[.!?…。！？؟۔।:;][\"'’”»)\]]*$"

#: Words that only separate the entries of a menu.
SEPARATORS = ("|", "||", ">", ">>", "»", "›", "·", "•", "/", "::")

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "n_lines", "n_removed_lines", "kept_chars", "clean_text", "kept")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _starts_of_repeats(hashes: Column) -> Column:
    """Ascending positions of the values that occur twice or more in an array."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(hashes) - 1

    def repeated(ordered: Column) -> Column:
        return F.array_sort(F.transform(
            F.filter(ordered, lambda x, j: (
                ((j > 0) & (x.h == F.element_at(ordered, F.greatest(j, F.lit(1))).h))
                | ((j < last) & (x.h == F.element_at(ordered, F.least(j, last - 1) + 2).h)))),
            lambda x: x.i))

    return F.when(last < 1, F.array().cast("array<int>")).otherwise(_bind(ranked, repeated))


def _covered(starts: Column, width: int) -> Column:
    """Length of the union of ``[s, s + width)`` over ascending starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(
        starts, zero,
        lambda acc, s: F.struct((acc.n + F.least(F.lit(width), s - acc.last)).alias("n"), s.alias("last")),
        lambda acc: acc.n)


def window_hashes(tokens: Column) -> Column:
    """64-bit hashes of all windows of 8 words: pairs, then pairs of pairs, then of those."""

    def paired(parts: Column, step: int) -> Column:
        n = F.greatest(F.size(parts) - step, F.lit(0))
        return F.zip_with(F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    return _bind(_bind(paired(tokens, 1), lambda two: paired(two, 2)), lambda four: paired(four, 4))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text. Sorts only where a hash repeats."""
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes),
                  _covered(_starts_of_repeats(hashes), width)).otherwise(0)


def without(text: Column | str, marks: str = SYMBOLS) -> Column:
    """A text without some single characters; plain byte searches, far cheaper than a pattern."""
    text = F.col(text) if isinstance(text, str) else text
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def line_fails(x: Column) -> Column:
    """True for a line that a rule removes; ``x`` has its words (at least one), characters and symbols."""
    n = F.size(x.tokens)
    bars = F.size(F.filter(x.tokens, lambda w: w.isin(*SEPARATORS)))
    phrase = F.lower(F.array_join(x.tokens, " ")).rlike("|".join(BOILERPLATE))
    ended = F.element_at(x.tokens, -1).rlike(ENDINGS)
    return (((n < 10) & ~ended) | (x.symbols * 10 > x.chars) | ((n <= 20) & phrase)
            | ((bars >= 3) & (bars * 4 >= n)))


def clean_lines(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat: int = 30,
                max_lost: int = 50) -> DataFrame:
    """Judge lines and documents; adds the columns of ``RESULT``.

    ``max_repeat``: percent of words in repeated windows; ``max_lost``: percent of word characters in dropped lines.
    ``clean_text`` holds the lines that stayed, in order, blank lines included.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [f"`{c}`" for c in docs.columns if c not in RESULT]
    total = lambda lines, part: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + part(x))

    lines = docs.select(*keep, F.transform(F.split(body, "\n", -1), lambda x: F.struct(
        x.alias("line"), words(x).alias("tokens"))).alias("__lines"))
    lines = lines.select(*keep, F.transform("__lines", lambda x: F.struct(
        x.line, x.tokens, F.array_join(x.tokens, "").alias("joined"))).alias("__lines"))
    lines = lines.select(*keep, F.transform("__lines", lambda x: F.struct(
        x.line, x.tokens, F.length(x.joined).alias("chars"),
        (F.length(x.joined) - F.length(without(x.joined))).alias("symbols"))).alias("__lines"))
    judged = lines.select(
        *keep, F.flatten(F.transform("__lines", lambda x: x.tokens)).alias("__tokens"),
        F.transform("__lines", lambda x: F.struct(
            x.line, x.chars, x.symbols, (x.chars > 0).alias("worded"),
            ((x.chars > 0) & line_fails(x)).alias("fails"))).alias("__lines"))
    hashed = judged.select(*keep, "__lines", F.size("__tokens").cast("long").alias("n_words"),
                           window_hashes(F.col("__tokens")).alias("__hashes"))
    worded = F.transform(F.filter("__lines", lambda x: x.worded), lambda x: x.line)
    counted = hashed.select(
        *keep, "n_words",
        total("__lines", lambda x: x.chars).alias("word_chars"),
        total("__lines", lambda x: x.symbols).alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__hashes")).cast("long").alias("n_repeat_words"),
        F.size(worded).cast("long").alias("n_lines"),
        F.size(F.filter("__lines", lambda x: x.fails)).cast("long").alias("n_removed_lines"),
        total("__lines", lambda x: F.when(x.fails, 0).otherwise(x.chars)).alias("kept_chars"),
        F.array_join(F.transform(F.filter("__lines", lambda x: ~x.fails), lambda x: x.line), "\n").alias("clean_text"))
    counted = counted.withColumn("base_failed", (F.col("n_words") < min_words)
                                 | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    lost = F.col("word_chars") - F.col("kept_chars")
    kept = ~F.col("base_failed") & (100 * lost <= max_lost * F.col("word_chars"))
    # as the fields of one generated row: a filter on the verdict then stays above the work instead of repeating it
    return counted.select(F.inline(F.array(F.struct(*keep, *RESULT[:-1], kept.alias("kept")))))
