"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

The measures of a text are columns of plain Spark functions; every rule of the table compares one of them with a
bound, and all rules together are one Boolean expression. A null text has no words. Rows are judged one by one, so
repeated rows get the same verdict each, an empty table gives an empty result, and other columns pass unread. A measure
that ties with its bound passes. Texts of any length count whole: their words and lines are arrays within the row's task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WHITE = r"[ \x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by this are from at an or not a which have "
    "der die das und in zu den mit von ist nicht auf für im dem des ein eine sich als auch es "
    "le la les de des et en un une du que qui dans pour par sur pas au avec est ce il "
    "el los las y por con del se no una su para al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if its measure is below `least` or above `most`; a bound of None holds always."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. All measures are ratios, so that a bound means the same for short and long texts.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.3),
    Rule("upper_ratio", None, 0.6),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.35),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more. Windows are compared by their hashes first; only
    texts in which two hashes agree sort the windows themselves, so the count is exact."""
    last = F.size(words) - 3
    at = lambda i: [F.get(words, i + k) for k in range(3)]
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*at(i)))

    def exact() -> Column:
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("w"), i.alias("i"))))

        def marked(ws: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(ws, k)["w"] == x["w"], F.lit(False))
            twice = F.filter(ws, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(windows, marked)

    return F.when(last < 1, F.lit(0)).when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(exact())


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts and ratios of every whole text, in columns of their own names; text_col is only read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.withColumn("_words", F.filter(F.split(text, WHITE + "+"), lambda w: w != "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")))
    words, lines = F.col("_words"), F.col("_lines")
    counted = first.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(words).cast("long").alias("n_words"),
        F.length(without(text, WHITE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - F.length(without(text, "!"))).cast("long").alias("n_shouts"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS], *[x.upper() for x in STOP_WORDS]))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "shout_ratio": per("n_shouts", "n_words"),
            "upper_ratio": per("n_upper", "word_chars"),
            "stop_word_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
        }
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean expression that is true for a document that passes every rule."""
    fine = F.lit(True)
    for r in rules:
        if r.least is not None:
            fine = fine & (F.col(r.measure) >= F.lit(float(r.least)))
        if r.most is not None:
            fine = fine & (F.col(r.measure) <= F.lit(float(r.most)))
    return fine


def failed_base() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all measures, base_failed and kept. Columns of docs that clash with a measure are dropped first."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words", "n_upper", "base_failed", "kept", "_words", "_lines", *(r.measure for r in rules)}
    docs = docs.drop(*[c for c in docs.columns if c in own and c != text_col])
    return measures(docs, text_col).withColumn("base_failed", failed_base()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs. A filter would be pushed below the measures and compute each
    anew wherever the rules name it; unfolding an array of the row, or of none, leaves them computed once."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    return judge(inner).select(F.inline(F.filter(F.array("_row"), lambda _: F.col("kept"))))
