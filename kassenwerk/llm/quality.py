"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Null and empty texts have no words and fail the length rule. Ties, repeated rows and
further columns change nothing: each row is judged by its own text. An empty table gives
an empty result. Metric columns replace input columns of the same name.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.llm.texts import SPACES, fresh, let, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with this is in for it on as was by at from are "
    "der die das und in zu den mit von ist dem nicht ein eine auf für "
    "le la les de des et un une du que qui en dans pour est au "
    "el los las y que es por para con una del no se su"
).split()


@dataclass(frozen=True)
class Rule:
    """A document goes if ``metric`` compares by ``against`` with ``limit``."""

    metric: str
    against: str
    limit: float

    @property
    def name(self) -> str:
        return f"{self.metric} {self.against} {self.limit:g}"

    def broken(self) -> Column:
        compare = {"<": operator.lt, ">": operator.gt}[self.against]
        return F.coalesce(compare(F.col(self.metric), F.lit(self.limit)), F.lit(False))


# The first two are the base rules; the others are the verdict on length, symbol,
# stop-word and line ratios.
BASE_RULES = (Rule("n_words", "<", 50), Rule("repeat_word_percent", ">", 50))
RULES = (
    *BASE_RULES,
    Rule("mean_word_chars", "<", 2),
    Rule("mean_word_chars", ">", 20),
    Rule("symbols_per_word", ">", 0.1),
    Rule("exclamations_per_word", ">", 0.3),
    Rule("n_stop_words", "<", 2),
    Rule("stop_words_per_word", "<", 0.01),
    Rule("dup_line_share", ">", 0.5),
    Rule("bullet_line_share", ">", 0.9),
    Rule("ellipsis_line_share", ">", 0.3),
)
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_exclamations", "n_lines", "n_dup_lines",
    "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words",
)


def _covered(windows: Column) -> Column:
    """Words that lie in a window equal to another; windows are given as hashes by position."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_sorted(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(
            F.transform(twice, lambda x: x["i"]),
            lambda p: F.size(
                F.array_distinct(
                    F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))
                )
            ),
        )

    # Most documents repeat no window; they need no sort.
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(placed, of_sorted)
    )


def _repeat_words(w: Column) -> Column:
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.slice(window, 1, F.size(w) - 2), _covered))


def _count(column: Column) -> Column:
    return column.cast("long")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts and ratios of each whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    signs = F.regexp_replace(body, f"[^{SYMBOLS}!]++", "")
    of_signs = let(
        signs,
        lambda x: F.struct(
            _count(F.length(F.replace(x, F.lit("!"), F.lit("")))).alias("n_symbols"),
            _count(F.length(x) - F.length(F.replace(x, F.lit("!"), F.lit("")))).alias("n_exclamations"),
        ),
    )
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            _count(F.size(w)).alias("n_words"),
            _count(F.length(F.array_join(w, ""))).alias("word_chars"),
            _count(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
            _count(_repeat_words(w)).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            _count(F.size(x)).alias("n_lines"),
            _count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            _count(F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•")))).alias("n_bullet_lines"),
            _count(F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…")))).alias("n_ellipsis_lines"),
        ),
    )
    # Made by a generator of one row: a filter on the verdict would otherwise be pushed below
    # the projection, with a copy of all this for each rule.
    made, name = F.struct(of_words.alias("w"), of_lines.alias("l"), of_signs.alias("s")), fresh(df, "_made")
    counted = df.select("*", F.explode(F.array(made)).alias(name)).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in COUNTS], f"{name}.w.*", f"{name}.l.*", f"{name}.s.*"
    )
    share = lambda part, whole: F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    return counted.withColumns(
        {
            # Whole numbers compared exactly: 100 * part > limit * whole.
            "repeat_word_percent": F.try_divide(100.0 * F.col("n_repeat_words"), F.col("n_words").cast("double")),
            "mean_word_chars": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"),
            "exclamations_per_word": share("n_exclamations", "n_words"),
            "stop_words_per_word": share("n_stop_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "bullet_line_share": share("n_bullet_lines", "n_lines"),
            "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
        }
    )


def judge(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with its metrics, the broken rules, ``base_failed`` and ``kept``."""
    measured = metrics(df, text)
    base = reduce(operator.or_, [r.broken() for r in BASE_RULES])
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    return measured.withColumn("base_failed", base).withColumn("broken_rules", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that break no rule, with their own columns only."""
    # Judged under a name of its own, so that no input column is replaced.
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(text).alias("_text"))
    return judge(row, "_text", rules).filter("kept").select("_row.*")
