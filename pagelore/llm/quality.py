"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Metrics are array and string expressions over the whole text; a rule bounds one metric from below and above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.shared import text_or_empty

SPACES = " \t\n\x0b\f\r"
NOT_WORD = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Very common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was that it for on are as with be at or by this from have has not "
    "der die das und in den von zu mit ist im für auf ein eine des dem nicht sich als auch es "
    "le la les de des et un une du en dans est que qui pour par sur pas au plus il "
    "el los las y del se con no una su al lo por es"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds if lowest <= metric <= highest; a missing bound is open."""

    name: str
    metric: str
    lowest: float | None = None
    highest: float | None = None


#: The production table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("words", "n_words", lowest=20),
    Rule("word_length", "mean_word_chars", lowest=2, highest=14),
    Rule("symbols", "symbol_ratio", highest=0.1),
    Rule("stop_words", "n_stop_words", lowest=2),
    Rule("letters", "letter_word_ratio", lowest=0.6),
    Rule("repeated_lines", "dup_line_ratio", highest=0.5),
    Rule("bullets", "bullet_line_ratio", highest=0.9),
    Rule("ellipses", "ellipsis_line_ratio", highest=0.5),
)


def repeated_words(words: Column, windows: Column, ordered: Column, starts: Column) -> list[dict[str, Column]]:
    """Steps that lead from words to the number of words in windows of WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash of their words' hashes within one text. Only texts in which some hash
    occurs twice sort their windows.
    """
    n = F.size(windows)
    return [
        {"_hashes": F.transform(words, lambda w: F.xxhash64(w))},
        {
            "_windows": F.when(
                F.size("_hashes") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_hashes"), i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>"))
        },
        {"_ordered": F.when(F.size(F.array_distinct(windows)) < n, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {
            "_starts": F.sort_array(
                F.filter(
                    F.transform(ordered, lambda x, k: F.when(x["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]), x["i"])),
                    lambda i: i.isNotNull(),
                )
            )
        },
        {
            "n_repeat_words": F.coalesce(
                F.aggregate(
                    F.transform(starts, lambda s, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, k - 1)))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
                F.lit(0).cast("long"),
            )
        },
    ]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns and the metrics of its text. A null text has no words; metrics named n_* are counts (long).

    Ratios of nothing are 0. Columns of df that bear a metric's name are replaced.
    """
    body = text_or_empty(text)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    steps = [
        {"_text": body},
        {"_trimmed": F.btrim("_text", F.lit(SPACES)), "_lines": lines},
        {"_words": F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", NOT_WORD))},
        *repeated_words(F.col("_words"), F.col("_windows"), F.col("_ordered"), F.col("_starts")),
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike("^\\s*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("long"),
        },
        {
            "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
            "letter_word_ratio": ratio(F.col("n_letter_words"), F.col("n_words")),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "bullet_line_ratio": ratio(F.col("n_bullet_lines"), F.col("n_lines")),
            "ellipsis_line_ratio": ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.drop("_text", "_trimmed", "_lines", "_words", "_hashes", "_windows", "_ordered", "_starts")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row breaks, as one array expression."""
    tests = []
    for rule in rules:
        bounds = [F.col(rule.metric) < rule.lowest] if rule.lowest is not None else []
        bounds += [F.col(rule.metric) > rule.highest] if rule.highest is not None else []
        broken = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        tests.append(F.when(broken, F.lit(rule.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df's columns, the metrics, and: failed_rules array<string>, base_failed and kept booleans.

    base_failed: under 20 words, or over 30 in 100 words lie in 8-word windows that occur twice or more in the text.
    Every row comes out once; repeated rows and null ids are judged by their text alone, null or empty text fails.
    """
    measured = measure(df, text).withColumns(
        {
            "failed_rules": compiled(rules),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    return measured.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that the rules keep, with df's columns, those that bear a metric's name included.

    The optimiser moves a filter below a projection by writing the projection's expressions into it, again and again
    for steps that build on each other. A condition that counts as non-deterministic stays where it is.
    """
    judged = apply_rules(df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("_body")), "_body", rules)
    return judged.withColumn("_keep", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("_keep").select("_row.*")
