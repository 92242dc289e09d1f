"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Tokens are summed per cell of (source, language, topic). Iterative proportional fitting
scales the cells' weights until their sums match the target shares of every source, language and topic. A
document stays with a probability in proportion to weight per token of its cell.

No cell can give more tokens than it has. Where the wished share of all tokens asks for that,
the cells are raked again within their own tokens; where no weights within them have
the target shares, the targets come first and fewer tokens are kept than wished, about as many
as the targets allow. A warning then gives the figures, and ``report`` compares wanted,
expected and drawn shares.

Nulls form a source, language or topic of their own. Documents without a word weigh one
token, so that they can be drawn too. Equal ids get equal draws: repeated rows stay or go
together. Rows without id draw by their text. An empty table gives an empty result. Further columns are
carried along untouched.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.llm.texts import SPACE_RUN
from kassenwerk.session import written

MARGINS = ("source", "lang", "topic")
TEMPER = 0.7
KEEP_TOKENS = 0.8
TOLERANCE = 1e-4
SWEEPS, MOST_SWEEPS, BOUNDED_SWEEPS = 4, 40, 24
STEP, TRIES = 0.02, 6  # how near the kept share comes to the most that the targets allow
_LOG = logging.getLogger(__name__)


def word_count(text: Column) -> Column:
    """Words between runs of white space, without building them."""
    body = F.coalesce(text, F.lit(""))
    return F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def topic(text: Column) -> Column:
    """The kind of text, which stands for the topic where a table names none."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains(" | "), "list")
        .when(F.length(body) < 500, "note")
        .when(body.contains("\n"), "article")
        .otherwise("paragraph")
    )


def measured(df: DataFrame) -> DataFrame:
    """Each row as ``_row``, with its id, ``_source``, ``_lang``, ``_topic`` and ``_tokens``."""
    own = F.col("topic") if "topic" in df.columns else topic(F.col("text"))
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col("doc_id").alias("_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.coalesce(F.col("lang"), F.lit("")).alias("_lang"),
        F.coalesce(own, F.lit("")).alias("_topic"),
        F.greatest(word_count(F.col("text")), F.lit(1).cast("long")).alias("_tokens"),
    )


def targets(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """Default shares of one margin: its tokens to the power ``temper``, summing to 1."""
    sums = cells.groupBy(f"_{margin}").agg(F.sum("_tokens").alias("_t"))
    power = F.pow(F.col("_t").cast("double"), F.lit(temper))
    whole = sums.agg(F.sum(power).alias("whole")).first()["whole"] or 1.0
    return sums.select(f"_{margin}", (power / F.lit(whole)).alias(f"_{margin}_share"))


def _gaps(raked: DataFrame, wanted: dict[str, DataFrame]) -> float:
    """The largest distance of a margin's weight from its wanted share."""
    gaps = raked.select(
        *[F.abs(F.sum("_weight").over(Window.partitionBy(f"_{m}")) - F.col(f"_{m}_share")).alias(m) for m in wanted]
    )
    return gaps.agg(F.max(F.greatest(*wanted)).alias("gap")).first()["gap"] or 0.0


def _swept(now: DataFrame, wanted: dict[str, DataFrame], tolerance: float, most: int, bound: Column | None = None) -> tuple[DataFrame, float]:
    """Sweeps from ``_pull`` on; ``_weight`` is the pull, cut at ``bound``. Also the gap that is left."""
    cut = lambda: F.col("_pull") if bound is None else F.least(F.col("_pull"), bound)
    gap = 0.0
    for _ in range(0, most, SWEEPS):
        for _ in range(SWEEPS):
            for m in wanted:
                present = F.sum(cut()).over(Window.partitionBy(f"_{m}"))
                now = now.withColumn(
                    "_pull", F.coalesce(F.try_divide(F.col("_pull") * F.col(f"_{m}_share"), present), F.lit(0.0))
                )
        # One task: cells grow with the names of the margins, not with the rows, and
        # sweeps over them need no shuffle then.
        now = written(now.withColumn("_weight", cut()), "raked").coalesce(1)
        gap = _gaps(now, wanted)
        if gap <= tolerance:
            break
    return now, gap


def rake(cells: DataFrame, wanted: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``_weight``, whose sums are the wanted shares up to ``tolerance``.

    A sweep divides every cell by its margin's present sum and multiplies it by the wanted
    one, margin by margin. Sweeps stop at the tolerance, or after ``MOST_SWEEPS`` where
    empty cells make the margins contradict each other.
    """
    return _swept(_started(cells, wanted), wanted, tolerance, MOST_SWEEPS)[0]


def _started(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    now = cells.withColumn("_pull", F.col("_tokens").cast("double"))
    for margin, shares in wanted.items():
        now = now.join(shares, f"_{margin}", "left")
    return now.fillna(0.0, [f"_{m}_share" for m in wanted]).coalesce(1)


def most_keep(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """Per margin and value its shares in the table and as wanted, and the largest kept share of all tokens
    at which its own tokens suffice (``most_keep``)."""
    parts = []
    for m, shares in wanted.items():
        own = cells.groupBy(f"_{m}").agg(F.sum("_tokens").cast("double").alias("_own"))
        whole = F.sum("_own").over(Window.partitionBy())
        parts.append(
            own.withColumn("table_share", F.try_divide(F.col("_own"), whole))
            .join(shares, f"_{m}", "full")
            .select(
                F.lit(m).alias("margin"),
                F.col(f"_{m}").alias("value"),
                F.coalesce("table_share", F.lit(0.0)).alias("table_share"),
                F.coalesce(f"_{m}_share", F.lit(0.0)).alias("wanted_share"),
            )
        )
    return reduce(DataFrame.unionByName, parts).withColumn(
        "most_keep", F.least(F.lit(1.0), F.coalesce(F.try_divide("table_share", "wanted_share"), F.lit(1.0)))
    )


def rake_to_draw(cells: DataFrame, wanted: dict[str, DataFrame], keep: float) -> tuple[DataFrame, float]:
    """Cells with ``_weight``, and the share of all tokens that draws can keep at these weights.

    No cell can give more tokens than it has. Where the plainly raked weights ask for more at
    the wished ``keep``, cells are raked again, bounded by their own tokens, what is cut going
    to the other cells of the margin. Where no such weights have the wanted shares, the shares
    come first: less is kept, within ``STEP`` of the most or of a bisection's last step.
    """
    tokens = cells.agg(F.sum("_tokens").alias("n")).first()["n"] or 0
    now, gap = _swept(_started(cells, wanted), wanted, TOLERANCE, MOST_SWEEPS)
    share = F.col("_tokens") / F.lit(float(tokens or 1))
    sums = now.agg(F.sum("_weight").alias("all"), F.max(F.try_divide(F.col("_weight"), share)).alias("top")).first()
    low = min(sums["all"] / sums["top"], keep) if sums["top"] else keep
    if low >= keep:
        return now, keep
    # Names without a token cannot be reached at any rate; the gap left above tells of them.
    limit = most_keep(cells, wanted).filter("table_share > 0").agg(F.min("most_keep").alias("x")).first()["x"]
    high = min(keep, limit)
    bounded = high if limit >= keep else high * (1 - STEP)
    for _ in range(TRIES):
        if bounded <= low:
            break
        found, left = _swept(now, wanted, TOLERANCE, BOUNDED_SWEEPS, share * F.lit(sums["all"] / bounded))
        if left <= max(TOLERANCE, 1.01 * gap):
            now, low = found, bounded
            if bounded >= high * (1 - STEP):
                break
        else:
            high = bounded
        bounded = (low * high) ** 0.5
    return now, low


def mix(
    df: DataFrame,
    wanted: dict[str, DataFrame] | None = None,
    keep: float = KEEP_TOKENS,
    seed: int = 42,
) -> DataFrame:
    """``df`` with ``mix_topic``, ``mix_tokens``, ``mix_weight`` (the cell's raked share), ``p_keep`` and ``kept``.

    ``wanted`` maps ``source``, ``lang`` and ``topic`` to tables of shares (columns
    ``_<margin>`` and ``_<margin>_share``); a margin that it lacks gets tempered shares.
    Input columns named like a result are replaced by it.
    """
    told = measured(df)
    keys = [f"_{m}" for m in MARGINS]
    cells = written(told.groupBy(*keys).agg(F.sum("_tokens").alias("_tokens")), "cells")
    wanted = {m: (wanted or {}).get(m) or targets(cells, m) for m in MARGINS}
    raked, reached = rake_to_draw(cells, wanted, keep)
    if reached < keep:
        _LOG.warning("The wanted shares allow %.4f of the tokens to be kept, not %.4f", reached, keep)
    sums = raked.agg(F.sum("_weight").alias("w"), F.sum("_tokens").cast("double").alias("t")).first()
    scale = reached * (sums["t"] or 0.0) / (sums["w"] or 1.0)
    # Read from files of known size: Catalyst broadcasts the cells where they are small.
    rates = written(raked.select(*keys, "_weight", (F.col("_weight") / F.col("_tokens")).alias("_rate")), "rates")
    whole = 1 << 53
    own = F.coalesce(F.col("_id").cast("long"), F.xxhash64(F.col("_row.text")))
    draw = F.pmod(F.xxhash64(F.lit(seed), own), F.lit(whole))
    results = {
        "mix_topic": F.col("_topic"),
        "mix_tokens": F.col("_tokens"),
        "mix_weight": F.col("_weight"),
        "p_keep": F.least(F.lit(1.0), F.col("_rate") * F.lit(scale)),
        "kept": draw / F.lit(float(whole)) < F.least(F.lit(1.0), F.col("_rate") * F.lit(scale)),
    }
    return told.join(rates, keys, "left").select(
        *[F.col(f"_row.`{c}`") for c in df.columns if c not in results], *[v.alias(k) for k, v in results.items()]
    )


def report(mixed: DataFrame, wanted: dict[str, DataFrame] | None = None) -> DataFrame:
    """What a result of ``mix`` makes of the wanted shares, per margin and value.

    ``expected_share`` and ``drawn_share`` are shares of the kept tokens, by probability and as
    drawn; ``kept_share`` is the expected part of all tokens. A wished kept share above
    ``most_keep`` contradicts that value's wanted share.
    """
    names = dict(source=F.col("source"), lang=F.col("lang"), topic=F.col("mix_topic"))
    told = mixed.select(*[F.coalesce(c, F.lit("")).alias(f"_{m}") for m, c in names.items()], F.col("mix_tokens").alias("_tokens"), "p_keep", "kept")
    cells = written(
        told.groupBy(*[f"_{m}" for m in MARGINS]).agg(
            F.sum("_tokens").alias("_tokens"),
            F.sum(F.col("_tokens") * F.col("p_keep")).alias("_expected"),
            F.sum(F.when(F.col("kept"), F.col("_tokens")).otherwise(0)).cast("double").alias("_drawn"),
        ),
        "drawn",
    )
    wanted = {m: (wanted or {}).get(m) or targets(cells, m) for m in MARGINS}
    whole = cells.agg(*[F.sum(c).alias(c) for c in ("_tokens", "_expected", "_drawn")]).first()
    part = lambda c: F.try_divide(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(float(whole[c] or 0.0)))
    got = reduce(
        DataFrame.unionByName,
        [
            cells.groupBy(F.lit(m).alias("margin"), F.col(f"_{m}").alias("value")).agg(
                part("_expected").alias("expected_share"), part("_drawn").alias("drawn_share")
            )
            for m in MARGINS
        ],
    )
    kept = (whole["_expected"] or 0.0) / (whole["_tokens"] or 1)
    return most_keep(cells, wanted).join(got, ["margin", "value"], "left").withColumn("kept_share", F.lit(kept))
