"""Operator 3: line-first cleaning with quality rules, in Spark SQL functions only.

Every line of a text is held against three rules; lines that fail are removed, and a
document that loses more than ``MAX_LOST_PERCENT`` of its visible characters is rejected.

* punctuation: no letter at all; or at least ``MIN_RUNS`` runs of doubled marks (``!!``,
  ``$$$``), one for every ``WORDS_PER_RUN`` words or more; or ``PLAIN_WORDS`` words and more
  without any sentence punctuation;
* navigation: two menu separators or more, one for every ``WORDS_PER_RUN`` words or more; or
  nothing but a menu label;
* boilerplate: a notice phrase in a line of at most ``NOTICE_WORDS`` words.

Words are runs of characters other than ASCII white space. Everything stays within one
row: no shuffle, no join, work in proportion to the text (sorting windows of one text aside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_LOST_PERCENT = 50
MIN_RUNS, WORDS_PER_RUN, PLAIN_WORDS, NOTICE_WORDS = 3, 4, 12, 40

# Menu labels and notice phrases.
MENU = ("home", "menu", "search", "next", "previous", "login", "log in", "sign in", "sign up", "register",
        "contact", "contact us", "about", "about us", "back to top", "read more", "share", "site map")
NOTICES = ("all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy",
           "terms of use", "terms of service", "enable javascript", "requires javascript",
           "subscribe to our newsletter", "lorem ipsum", "click here to")

WS = "[ \\t-\\r]"
#: Low bits of a packed window key that hold its place (texts of up to 2^26 words).
PLACE_BITS = 26
_PLACE = (1 << PLACE_BITS) - 1


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (null: empty)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WS}+|{WS}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS}+"))


def _window_hashes(words: str, width: int) -> Column:
    at = ", ".join(f"get({words}, i + {k})" for k in range(width))
    return F.expr(f"if(size({words}) < {width}, cast(array() as array<bigint>), "
                  f"transform(sequence(0, size({words}) - {width}), i -> xxhash64({at})))")


def _twice(windows: str, places: str | None, shift: int) -> Column:
    """Places of windows whose hash, shifted left by ``shift``, has an equal neighbour in its
    high bits when sorted. With ``places``: only these places are looked at."""
    high = f"shiftleft({{h}}, {shift}) & {~_PLACE}"
    if places is None:
        packed = f"transform({windows}, (h, i) -> ({high.format(h='h')}) | i)"
    else:
        packed = f"transform({places}, p -> ({high.format(h=f'get({windows}, p)')}) | p)"
    # ``k`` binds the sorted array once; a lambda over its indexes reads neighbours.
    return F.expr(
        f"transform(array(sort_array({packed})), k -> transform(filter(k, (x, i) -> "
        f"coalesce((x ^ get(k, i - 1)) & {~_PLACE} = 0, false) or coalesce((x ^ get(k, i + 1)) & {~_PLACE} = 0, false)), "
        f"x -> cast(x & {_PLACE} as int)))[0]")


def _failed_line(line: Column) -> Column:
    low = F.lower(F.trim(line))
    n = F.size(F.split(low, f"{WS}+"))
    runs = F.regexp_count(line, F.lit("([!?#*$%&])\\1+"))
    separators = F.regexp_count(line, F.lit("\\s[|\u00bb\u203a>\u2022\u00b7](?=\\s)"))
    punctuation = (~line.rlike("\\p{L}")) | ((runs >= MIN_RUNS) & (runs * WORDS_PER_RUN >= n)) | (
        (n >= PLAIN_WORDS) & ~line.rlike("[.!?,;:\u2026\u3002]"))
    navigation = low.isin(*MENU) | ((separators >= 2) & (separators * WORDS_PER_RUN >= n))
    boilerplate = (n <= NOTICE_WORDS) & low.rlike("|".join(NOTICES))
    return punctuation | navigation | boilerplate


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_failed_lines, lost_chars, clean_text, kept): one row per row of ``docs``.

    ``clean_text`` is the text without its failed lines. Null and empty texts have no words
    and fail the base rules; repeated rows are judged alike; ids may be null or repeated.
    Only the id and the text are read, whatever other columns are called."""
    return _judge(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def clean(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns; failed lines are cut out of the
    text, and ``n_chars`` (where there is such a column) is then counted anew."""
    d = _judge(docs.select(F.struct("*").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    d = d.where("kept")
    cut = F.col("n_failed_lines") > 0
    new = {text_col: F.when(cut, F.col("clean_text")).otherwise(F.col(f"id.`{text_col}`"))}
    if n_chars_col in docs.columns:
        kind = docs.schema[n_chars_col].dataType
        new[n_chars_col] = F.when(cut, F.length("clean_text").cast(kind)).otherwise(F.col(f"id.`{n_chars_col}`"))
    return d.select(*(new.get(c, F.col(f"id.`{c}`")).alias(c) for c in docs.columns))


def _judge(d: DataFrame) -> DataFrame:
    """The columns of ``quality_rules`` for ``d`` (id, text)."""
    d = d.select("id", "text", words_of(F.col("text")).alias("words"), F.filter(
        F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    d = d.select("*", _window_hashes("words", WINDOW).alias("win"))
    d = d.select("*", F.when(F.size(F.array_distinct("win")) < F.size("win"), _twice("win", None, 0))
                 .otherwise(F.array().cast("array<int>")).alias("maybe"),
                 F.transform("lines", lambda x: F.struct(x.alias("line"), _failed_line(x).alias("bad"))).alias("judged"))
    d = d.select("*", F.when(F.size("maybe") > 0, F.sort_array(_twice("win", "maybe", 64 - PLACE_BITS)))
                 .otherwise(F.array().cast("array<int>")).alias("places"),
                 F.filter("judged", lambda x: x["bad"]).alias("failed"))
    visible = lambda c: F.length(F.regexp_replace(c, f"{WS}+", ""))
    repeat = F.expr(f"aggregate(transform(places, (p, i) -> least({WINDOW}, coalesce(get(places, i + 1), p + {WINDOW}) - p)),"
                    " 0L, (a, x) -> a + x)")
    d = d.select("id", F.size("words").cast("long").alias("n_words"), visible(F.col("text")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 repeat.alias("n_repeat_words"), F.size("lines").alias("n_lines"),
                 F.size("failed").alias("n_failed_lines"),
                 F.aggregate("failed", F.lit(0).cast("long"), lambda a, x: a + visible(x["line"])).alias("lost_chars"),
                 F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
                 .alias("clean_text"))
    d = d.select("*", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") >
                        MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"))
    d = d.select("*", (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))
                 .alias("kept"))
    # A generator of one row each: a filter on the verdict would otherwise be pushed down into the
    # rules and repeat their whole expressions many times over.
    return d.select(F.inline(F.array(F.struct(*d.columns))))
