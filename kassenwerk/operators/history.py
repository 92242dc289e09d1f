"""Log of report runs: metadata only, never the query and never its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.functions.text import blank_to_null, status_text

# Fixed values of the run log.
MODE_LABELS = {
    "brand": "Brand-Auswertung",
    "terminal": "Terminal-Report",
    "export": "Transaktions-Export",
    "card": "Kartensuche",
    "settlement": "Settlement / Auszahlung",
}
OWN_ACCOUNT = "hinterlegter Account"
TOKEN_FIELDS = ("portalQueryToken", "queryToken", "token")
FINAL_STATES = ("SUCCESS", "FAILED", "CANCELLED")


def mode_label(mode: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in MODE_LABELS.items() for x in pair])
    return F.coalesce(labels[mode], mode)


def _selected(items: str) -> Column:
    """Ids of the selected entries of an array of struct(id, selected)."""
    return F.transform(F.filter(F.col(items), lambda e: e["selected"]), lambda e: e["id"])


def run_log_rows(submissions: DataFrame) -> DataFrame:
    """One log row per submission.

    Needs token, mode, submitted_at, status, start_date, end_date, card_last4, spaces and
    terminals (arrays of struct(id, selected)), super_user and account_id.
    """
    account = F.when(
        F.col("super_user"), F.coalesce(blank_to_null(F.col("account_id")), F.lit(""))
    ).otherwise("")
    by_account = F.col("mode") == "settlement"
    terminals = F.size(_selected("terminals"))
    filters = F.concat_ws(
        " · ",
        F.when(
            (F.col("mode") == "card") & blank_to_null(F.col("card_last4")).isNotNull(),
            F.concat(F.lit("Karte "), F.col("card_last4")),
        ),
        F.when(terminals > 0, F.concat(terminals.cast("string"), F.lit(" Terminal(s)"))),
    )
    return submissions.select(
        F.col("token").alias("id"),
        "token",
        "mode",
        mode_label(F.col("mode")).alias("mode_label"),
        "submitted_at",
        F.coalesce("status", F.lit("SUCCESS")).alias("status"),
        F.when(
            by_account,
            F.when(account == "", OWN_ACCOUNT).otherwise(F.concat(F.lit("Account "), account)),
        )
        .otherwise(F.array_join(_selected("spaces"), ", "))
        .alias("spaces_summary"),
        F.concat_ws(" – ", "start_date", "end_date").alias("timeframe_summary"),
        F.when(by_account, "").otherwise(filters).alias("filter_summary"),
        account.alias("account"),
    )


def _newest_segment(log: DataFrame, limit: int) -> DataFrame:
    """The end of the log, from its newest entry back until it names ``limit`` tokens.

    Looked at in segments that are four times as long each time. A token whose last entry is
    before the segment is older than all in it, so as soon as a segment names enough tokens
    nothing before it matters. Each look is a range of ``seq``, which files written in order are pruned by.
    """
    ends = log.agg(F.min("seq").alias("first"), F.max("seq").alias("last")).first()
    if ends["last"] is None:
        return log
    width = 4 * limit
    while ends["last"] - width >= ends["first"]:
        segment = log.filter(F.col("seq") > ends["last"] - width)
        if segment.select("token").distinct().limit(limit).count() == limit:
            return segment
        width *= 4
    return log


def newest_runs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """The most recent runs, newest first, each token once with its latest entry.

    ``seq`` is the order of insertion. A token logged again moves to the front. With a limit only
    the end of the log that holds so many tokens is read. There the token and its latest ``seq`` are
    aggregated, and the winners, at most ``limit``, pick their full entries.
    """
    if limit is not None:
        log = _newest_segment(log, limit)
    winners = log.groupBy("token").agg(F.max("seq").alias("seq"))
    if limit is not None:
        winners = F.broadcast(winners.orderBy(F.desc("seq")).limit(limit))
    return log.join(winners, ["token", "seq"]).select(*log.columns).orderBy(
        F.desc("seq")
    )


def runs_of_mode(log: DataFrame, mode: str) -> DataFrame:
    return log.filter(F.col("mode") == mode)


def answer_fields(answers: DataFrame, column: str = "value") -> DataFrame:
    """Token and upper-case status of JSON answers; absent ones are empty text."""
    payload = F.col(column)
    token = F.coalesce(
        *[blank_to_null(F.get_json_object(payload, f"$.{name}")) for name in TOKEN_FIELDS],
        F.lit(""),
    )
    status = status_text(payload)
    return answers.select(
        token.alias("token"),
        status.alias("status"),
        status.isin(*FINAL_STATES).alias("is_final"),
        (status == "SUCCESS").alias("is_success"),
    )
