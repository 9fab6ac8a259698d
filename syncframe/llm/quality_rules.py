"""Line-first quality rules."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import SPACE, WORD, text_of

SYMBOLS = "[#*$%&|<>]"
#: A line that ends as a sentence does, closing quotes and brackets aside.
SENTENCE_END = r"""[.!?:;…。！？]['"”’»)\]]*[\x20\x09-\x0D]*$"""
#: Separators of menus and breadcrumbs, three or more in a line; an angle bracket counts with a space on either side.
NAVIGATION = r"(?:(?:[|›»•→·]|\x20>\x20)[^\n]*?){3}"
#: Stock phrases of web pages by language, in lower case.  Fixed values.
STOCK = {
    "any": ["cookie", "javascript", "lorem ipsum", "copyright ©"],
    "en": ["privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe now", "subscribe to", "skip to content"],
    "de": ["datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "jetzt anmelden", "jetzt abonnieren", "impressum"],
    "fr": ["politique de confidentialité", "conditions d'utilisation", "tous droits réservés", "cliquez ici", "se connecter", "s'abonner", "mentions légales"],
    "es": ["política de privacidad", "términos de uso", "todos los derechos reservados", "haga clic aquí", "iniciar sesión", "suscríbete", "aviso legal"],
}
PHRASES = [phrase for phrases in STOCK.values() for phrase in phrases]
SIGN_IN = r"(?:sign|log) in\b"


def _stock(line: Column) -> Column:
    """Whether a line in lower case holds a stock phrase."""
    return functools.reduce(Column.__or__, [F.contains(line, F.lit(p)) for p in PHRASES], line.rlike(SIGN_IN))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also when lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _add(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in the same list.  Windows
    are compared as 64-bit hashes of the words' 64-bit hashes; sorting them brings equal ones together,
    and only lists with a repeat are sorted."""
    none = F.lit(0).cast("long")

    def covered(starts: Column) -> Column:
        return _add(F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))).cast("long")))

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["p"]))

    def counted(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(
            _let(ordered, lambda s: _let(repeated(s), covered))
        )

    def windows(hashes: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(width)])
        return F.when(F.size(hashes) < width, none).otherwise(
            _let(F.transform(F.sequence(F.lit(1), F.size(hashes) - (width - 1)), at), counted)
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def line_first_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_words: int = 10, max_repeat_percent: int = 20, max_symbol_percent: int = 10, max_lost_percent: int = 50,
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_failed_lines, lost_chars, cleaned_text.

    A line with a word fails if it has no sentence end (punctuation rule), if more than
    ``max_symbol_percent`` of its characters are symbols, if it has three or more menu separators
    (navigation) or if it holds a stock phrase of web pages in one of four languages (boilerplate).  Failed lines leave
    ``cleaned_text``.  A document is rejected if its base counts fail (fewer than ``min_words`` words, or
    more than ``max_repeat_percent`` of its words in repeated five-word windows) or if the failed lines
    held more than ``max_lost_percent`` of its characters in lines with words.

    One map-side projection without a shuffle; every count is linear or n log n in the text.  A null
    text counts as empty: no words, base_failed, not kept.  Repeated rows are judged alike, an empty
    table gives an empty result."""
    text = text_of(text_col)
    has_word = lambda line: line.rlike(WORD)
    fails = lambda line: (
        ~line.rlike(SENTENCE_END) | line.rlike(NAVIGATION) | F.exists(F.array(F.lower(line)), _stock)
        | (100 * F.regexp_count(line, F.lit(SYMBOLS)) > max_symbol_percent * F.length(line))
    )
    read = df.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"),
        F.array_remove(F.split(text, f"{SPACE}+"), "").alias("_words"),
        F.split(text, "\n").alias("_all"),
    ).withColumn("_lines", F.filter("_all", has_word)).withColumn("_failed", F.filter("_lines", fails))
    size = lambda c: F.size(c).cast("long")
    chars = lambda c: _add(F.transform(c, lambda line: F.length(line).cast("long")))
    counted = read.select(
        "doc_id", size("_words").alias("n_words"), chars("_words").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        size("_lines").alias("n_lines"), size("_failed").alias("n_failed_lines"),
        chars("_lines").alias("_chars"), chars("_failed").alias("lost_chars"),
        F.array_join(F.filter("_all", lambda line: ~(has_word(line) & fails(line))), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~failed & (100 * F.col("lost_chars") <= max_lost_percent * F.col("_chars"))).alias("kept"),
        "n_lines", "n_failed_lines", "lost_chars", "cleaned_text",
    )
