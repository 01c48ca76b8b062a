"""Line-first cleaning in column arithmetic.

Every line is judged by itself: closing punctuation, navigation, boilerplate, symbols, shouting.
The lines that fail are removed, and a document that loses more than ``max_lost`` of its words
goes. Everything stays within a row, so there is no shuffle and no group that could be skewed.
Arrays are paired with shifted copies of themselves instead of being indexed inside a lambda, so
no expression is computed again per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.llm.common import ASCII_SPACES, fresh, split_words

MIN_WORDS = 50
MAX_LOST = 0.5
BOILERPLATE_WORDS = 30  # a boilerplate line is a short one
OPEN_WORDS = 20  # a line this long with a sentence end inside may be cut off at its own end
_SPACE = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"
_SYMBOL = "[#*$%&|<>]"  # fixed value: the symbols counted
_CLOSED = "[.!?…:;。！？؟۔।][\"'”’“‘»«)\\]]*$"
_INNER_END = "[.!?…。！？؟۔।][\"'”’“‘»«)\\]]*[\\x20\\x09-\\x0D]"
_SEPARATOR = "(?:^|\\s)(?:[|•·›»→>/]+)(?=\\s|$)"
#: Phrases of page furniture; a short line that holds one fails.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "forgot password", "leave a comment", "log in", "lorem ipsum",
    "powered by", "previous article", "next article", "privacy policy", "read more", "share this",
    "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
    "use of cookies", "you are here",
)


def _pairs(a: Column, n: Column) -> tuple[Column, Column]:
    """An array without its last and without its first element."""
    m = F.greatest(n - 1, F.lit(0))
    return F.slice(a, 1, m), F.slice(a, 2, m)


def judge_lines(text: Column) -> Column:
    """An array with a struct (line, n, n_symbols, fails) for every line of ``text``."""
    furniture = F.lit("(?i)\\b(?:" + "|".join(BOILERPLATE) + ")\\b")
    counted = F.transform(F.split(text, "\n"), lambda s: F.struct(
        s.alias("line"), F.regexp_count(s, F.lit(_WORD)).alias("n"),
        F.regexp_count(s, F.lit(_SYMBOL)).alias("n_symbols")))
    return F.transform(counted, lambda s: F.struct(
        s["line"].alias("line"), s["n"].alias("n"), s["n_symbols"].alias("n_symbols"),
        F.when(s["n"] == 0, F.lit(False)).otherwise(
            (s["n_symbols"] * 10 >= s["n"] * 3)
            | (~F.substring(F.rtrim(s["line"], F.lit(ASCII_SPACES)), -6, 6).rlike(_CLOSED)
               & ((s["n"] < OPEN_WORDS) | ~s["line"].rlike(_INNER_END)))
            | (F.regexp_count(s["line"], F.lit(_SEPARATOR)) * 4 >= s["n"])
            | ((s["n"] > 2) & s["line"].rlike("\\p{Lu}") & ~s["line"].rlike("\\p{Ll}"))
            | F.when(s["n"] <= BOILERPLATE_WORDS, F.regexp_like(s["line"], furniture)).otherwise(F.lit(False))
        ).alias("fails")))


def judge(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST,
          prefix: str = "q_") -> DataFrame:
    """``docs`` with the counts, the verdict and the cleaned text in columns after ``prefix``.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost (words in the
    removed lines), n_lines_removed, clean_text and kept. A null or empty text has no words, fails
    the base rules and is not kept; lines without a word never fail. Repeated rows are judged
    alike. ``docs`` must have no column of these names; ``judge`` raises ValueError otherwise.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "n_lost", "n_lines_removed", "clean_text", "kept"]
    clash = {c.lower() for c in docs.columns} & {prefix + c for c in made}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    words, lines, ordered, places, body = (
        fresh(c, docs.columns) for c in ("_words", "_lines", "_ordered", "_places", "_body"))
    out = docs.withColumn(body, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({words: split_words(F.col(body)), lines: judge_lines(F.col(body))})

    # Hashes of the 3-word windows with their places, sorted: equal neighbours are repeats.
    n = F.size(words)
    m = F.greatest(n - 2, F.lit(0))
    first, second, third = (F.slice(F.col(words), k, m) for k in (1, 2, 3))
    two = F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    three = F.zip_with(two, third, lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    out = out.withColumns({
        prefix + "n_words": n.cast("long"),
        ordered: F.array_sort(F.transform(three, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))}).drop(words)
    left, right = _pairs(F.col(ordered), F.size(ordered))
    again = F.filter(F.zip_with(left, right, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
                     lambda x: x.isNotNull())
    out = out.withColumn(places, F.array_sort(F.array_distinct(F.flatten(again)))).drop(ordered)
    left, right = _pairs(F.col(places), F.size(places))
    gaps = F.zip_with(left, right, lambda a, b: F.least(b - a, F.lit(3)))
    repeats = F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))

    worded = F.transform(F.filter(F.col(lines), lambda s: s["n"] > 0), lambda s: s["line"])
    total = lambda key, keep=None: F.aggregate(
        F.col(lines), F.lit(0).cast("long"),
        lambda t, s: t + (F.when(keep(s), s[key]).otherwise(F.lit(0)) if keep else s[key]))
    out = out.withColumns({
        prefix + "word_chars": (F.char_length(body) - F.regexp_count(F.col(body), F.lit(_SPACE))).cast("long"),
        prefix + "n_symbols": total("n_symbols"),
        prefix + "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        prefix + "n_repeat_words": repeats.cast("long"),
        prefix + "n_lost": total("n", lambda s: s["fails"]),
        prefix + "n_lines_removed": F.size(F.filter(F.col(lines), lambda s: s["fails"])).cast("long"),
        prefix + "clean_text": F.array_join(
            F.transform(F.filter(F.col(lines), lambda s: ~s["fails"]), lambda s: s["line"]), "\n"),
    }).drop(places, lines, body)
    col = lambda c: F.col(prefix + c)
    failed = (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > 50 * col("n_words"))
    out = out.withColumn(prefix + "base_failed", failed)
    return out.withColumn(prefix + "kept", ~col("base_failed") & (col("n_lost") <= max_lost * col("n_words")))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars",
          max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their failing lines removed, columns as in ``docs``.

    ``chars_col``, where there is such a column, becomes the length of the new text.
    """
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = judge(docs, text_col, max_lost, prefix).withColumn(prefix + "row", F.monotonically_increasing_id())
    # A row number is not pushed down, and so the condition that names it: else the optimizer moves the
    # filter below the steps of judge() and puts all of them into it, again and again.
    out = out.where(F.col(prefix + "kept") & (F.col(prefix + "row") >= 0))
    cleaned = F.when(F.col(prefix + "n_lines_removed") > 0, F.col(prefix + "clean_text")).otherwise(F.col(text_col))
    new = {text_col: cleaned}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col(prefix + "n_lines_removed") > 0,
                                F.char_length(prefix + "clean_text").cast("long")).otherwise(F.col(chars_col))
    return out.withColumns(new).select(*docs.columns)
