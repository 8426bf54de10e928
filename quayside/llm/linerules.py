"""Line-first cleaning, in DataFrame operations alone.

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses more than ``max_lost`` of
its word characters with them is rejected.  Before that, base rules on the
whole text reject documents of under ``min_words`` words and those where more
than ``max_repeated_pct`` percent of the words lie in five-word windows that
occur twice or more.

All work on a document is done inside its row with array functions: no
shuffle, no explode.  Repeated windows are found by sorting 64-bit values made
of a window's hash (high bits) and its position (low bits); neighbours that
agree in the high bits are the repeats.  Those are compared word by word, and
should two different windows ever agree, the row's windows are sorted as
words instead, so the count is exact.

Navigation is a line of bars, bullets or lone slashes between its words, a line
of six or more capitalised words without a mark of a sentence, or one of a run of five or more
consecutive short lines (up to four words and 40 characters) that end in no
punctuation: a menu with one item a line.  Shorter runs, such as a heading over
a paragraph, pass.

Defined cases: a null text has no words and no lines, and fails; lines
without a word are neither judged nor lost, and do not end a run; repeated rows are judged each; an
empty table gives no rows.  Only the id and text columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# fixed values: phrases that mark boilerplate lines, matched in lower case
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "javascript is disabled", "lorem ipsum",
    "sign up for our newsletter", "subscribe to our newsletter", "click here to",
    "skip to main content", "powered by wordpress", "licensed under the",
)

# an end mark, perhaps inside closing quotes or brackets, ends the line
ENDS = r"""[.?!:;,…。؟"'”’)\]][\x20\x09-\x0D]*\z"""
MARK = r"[.?!:;,…。؟]"
RUN, ITEM_WORDS, ITEM_CHARS, CAPITALS = 5, 4, 40, 6
# a member of a run of RUN ones, whichever place it has in it
IN_RUN = "|".join(f"(?<=1{{{a}}})1(?=1{{{RUN - 1 - a}}})" for a in range(RUN))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _length(text: Column) -> Column:
    return F.length(text).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often and
    inside whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column, span: int) -> Column:
    """Words covered by windows that begin at the (sorted) positions."""
    wide = F.lit(span).cast("long")
    following = F.transform(positions, lambda p, k: F.least(
        wide, F.coalesce(F.get(positions, k + 1) - p, wide)))
    return F.aggregate(following, F.lit(0).cast("long"), lambda a, x: a + x)


def _neighbours(items: Column, same) -> Column:
    """Members of a sorted array that agree with the one before or after."""
    no = F.lit(False)
    return F.filter(items, lambda x, k: F.coalesce(same(x, F.get(items, k + 1)), no) | F.coalesce(
        same(x, F.get(items, k - 1)), no))


def repeated_words(words: Column, span: int = 5) -> Column:
    """Number of words that lie in ``span``-word windows found twice or more."""
    begins = F.sequence(F.lit(0), F.size(words) - span)

    def by_hash(windows, low):
        high = lambda x: x.bitwiseAND(F.bitwise_not(low))
        marks = F.sort_array(F.transform(
            windows, lambda h, i: high(h).bitwiseOR(i.cast("long"))))
        return let(marks, lambda m: _neighbours(m, lambda a, b: high(a) == high(b)))

    def collide(found, low):
        """Whether two neighbours of one hash are different windows."""
        def differ(x, k):
            y = F.get(found, k + 1)
            i, j = (v.bitwiseAND(low).cast("int") for v in (x, y))
            unlike = F.lit(False)
            for s in range(span):
                unlike = unlike | (F.get(words, i + s) != F.get(words, j + s))
            agree = x.bitwiseAND(F.bitwise_not(low)) == y.bitwiseAND(F.bitwise_not(low))
            return F.coalesce(agree & unlike, F.lit(False))
        return F.exists(F.transform(found, differ), lambda d: d)

    def exact():
        windows = F.sort_array(F.transform(begins, lambda i: F.struct(
            F.slice(words, i + 1, span).alias("w"), i.cast("long").alias("i"))))
        return let(windows, lambda w: F.sort_array(F.transform(
            _neighbours(w, lambda a, b: a["w"] == b["w"]), lambda x: x["i"])))

    def count(windows, low):
        return let(by_hash(windows, low), lambda found: F.when(
            F.size(found) == 0, F.lit(0).cast("long")).otherwise(let(
                F.when(collide(found, low), exact()).otherwise(F.sort_array(
                    F.transform(found, lambda x: x.bitwiseAND(low)))),
                lambda at: _covered(at, span))))

    # the low bits hold a position, the high ones a part of the hash
    low = F.call_function("shiftleft", F.lit(1).cast("long"),
                          F.ceil(F.log2(F.size(words) + 1.0)).cast("int")) - 1
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.transform(
        begins, lambda i: F.xxhash64(*[F.get(hashes, i + s) for s in range(span)])))
    # most texts repeat nothing, and a set of their hashes shows it
    some = let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(low, lambda mask: count(h, mask))))
    return F.when(F.size(words) < span, F.lit(0).cast("long")).otherwise(some)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             span: int = 5) -> DataFrame:
    """doc_id, text (null as empty), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, lines (those with a word)."""
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.struct(
        F.size(words).cast("long").alias("n"), _length(F.array_join(words, "")).alias("c"),
        repeated_words(words, span).alias("r")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    df = df.withColumn("counted", counted).withColumn("lines", lines)
    return df.select(
        "doc_id", "text", F.col("counted")["n"].alias("n_words"),
        F.col("counted")["c"].alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("counted")["r"].alias("n_repeat_words"), "lines")


def good_line(line: Column, marked: Column, phrased: Column) -> Column:
    """Whether a line passes the punctuation, navigation and boilerplate rules.

    ``marked`` and ``phrased`` say whether the whole text has any of the marks
    or phrases that the rules look for; most texts have none, and their lines
    need not be searched."""
    words = lambda: F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(f"[{SYMBOLS}!]"))
    bars = F.regexp_count(line, F.lit("[|»›•·]")) + F.when(
        line.contains("/"), _lone_slashes(line)).otherwise(0)
    few_marks = ~marked | (marks * 10 <= F.length(without(line, SPACES)))
    sentence = line.rlike(r"[.?:;,…。؟]") | (words() < 40)
    navigation = ~marked | (bars < 2) | (bars * 10 < words())
    titled = line.rlike(MARK) | ~_capitalised(line)
    low = F.lower(line)
    boilerplate = let(low, _has_phrase)
    return few_marks & navigation & sentence & titled & ~(phrased & boilerplate)


def _capitalised(line: Column) -> Column:
    """Whether a line has CAPITALS words or more, each beginning with a capital."""
    starts = F.regexp_count(line, F.lit(r"(?:^|[\x20\x09-\x0D])\p{Lu}"))
    return (starts >= CAPITALS) & (starts == F.regexp_count(line, F.lit(WORD)))


def _lone_slashes(line: Column) -> Column:
    words = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
    return F.size(F.filter(words, lambda w: w == "/"))


def item(line: Column) -> Column:
    """Whether a line could be an item of a menu with one item a line."""
    return (~line.rlike(ENDS) & (F.length(without(line, SPACES)) <= ITEM_CHARS)
            & (F.regexp_count(line, F.lit(WORD)) <= ITEM_WORDS))


def in_menu(lines: Column) -> Column:
    """For each line, '1' if it is in a run of RUN items or more, else '0'."""
    items = F.array_join(F.transform(lines, lambda x: F.when(item(x), "1").otherwise("0")), "")
    return F.split(F.translate(F.regexp_replace(items, IN_RUN, "n"), "1n", "01"), "")


def _has_phrase(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10,
          max_repeated_pct: int = 20, max_lost: float = 0.5) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, kept, lost_chars (word
    characters of removed lines) and clean_text (the lines that pass)."""
    df = measures(docs, id_col, text_col)
    # no phrase has a line break, so a line's phrase is one of the text's
    # and short texts have no run of lines
    flags = F.struct(F.col("text").rlike(f"[{SYMBOLS}!»›•·/]").alias("marked"),
                     let(F.lower("text"), _has_phrase).alias("phrased"),
                     F.when(F.size("lines") >= RUN, in_menu(F.col("lines"))).alias("menu"))

    def split(keep: bool) -> Column:
        return let(flags, lambda f: F.filter("lines", lambda x, i: (
            F.coalesce(F.get(f["menu"], i) == "0", F.lit(True))
            & good_line(x, f["marked"], f["phrased"])) == F.lit(keep)))

    df = df.withColumn("clean_text", F.array_join(split(True), "\n"))
    df = df.withColumn("lost_chars", _length(without(F.array_join(split(False), ""), SPACES)))
    base = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated_pct * F.col("n_words"))
    df = df.withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                     "n_repeat_words", "base_failed", kept.alias("kept"), "lost_chars",
                     "clean_text")
