"""Leaderboards over submitted totals.

Tables: entries (one row per user), submissions (history), and the child tables of model
and agent rows. Each ranking has a total order, so that a result never depends on the
partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assentlake import fixed
from assentlake.functions.arrays import leading
from assentlake.functions.scores import classify_level, shrunk_score
from assentlake.operators.payloads import stored_payloads
from assentlake.session import staged


def prior(rows: DataFrame) -> DataFrame:
    """One row: pooled hits per message, 0 when there are no messages."""
    hits, messages = F.sum("hits"), F.sum("messages")
    rate = F.when(messages > 0, hits.cast("double") / messages.cast("double")).otherwise(F.lit(0.0))
    return rows.agg(rate.alias("rate"))


def cross_prior(rows: DataFrame, prior_row: DataFrame) -> DataFrame:
    """Add ``score``. The prior is a global aggregate, a single row by construction."""
    return (
        rows.crossJoin(F.broadcast(prior_row))
        .withColumn("score", shrunk_score(F.col("hits"), F.col("messages"), F.col("rate")))
        .drop("rate")
    )


def latest_per_user(submissions: DataFrame) -> DataFrame:
    """The latest submission of each user; the higher id wins a tie.

    The optimizer keeps one row per user and task before the shuffle.
    """
    newest = Window.partitionBy("user_id").orderBy(
        F.col("created_at").desc(), F.col("submission_id").desc()
    )
    return (
        submissions.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
    )


def join_latest_submission(children: DataFrame, latest: DataFrame) -> DataFrame:
    """Child rows of latest submissions only: a repeated upload must not count twice."""
    return children.join(latest.select("submission_id"), "submission_id", "left_semi")


def join_entry_dim(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows with what a board shows of their user; rows of users without an entry are dropped."""
    shown = [c for c in ("login", "display_name", "avatar_url") if c in entries.columns]
    return rows.join(entries.select("user_id", *shown), "user_id")


def people_order() -> tuple[Column, ...]:
    return (
        F.col("score").desc(),
        F.col("hits").desc(),
        F.col("messages").desc(),
        F.col("updated_at").asc(),
        F.col("user_id").asc(),
    )


def board_people(entries: DataFrame, limit: int = fixed.BOARD_LIMIT) -> DataFrame:
    """The first ``limit`` users by shrunk score, with rank."""
    top = cross_prior(entries, prior(entries)).orderBy(*people_order()).limit(limit)
    # The window sees the rows of the board only.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*people_order())))


def board_tiers(board: DataFrame) -> DataFrame:
    """The tier on a board follows the score, not the raw rate."""
    return board.withColumn("level", classify_level(F.col("score")))


def board_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("participants"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        F.coalesce(F.avg("mdi"), F.lit(0.0)).alias("average_mdi"),
    )


def best_per_user_model(scored: DataFrame) -> DataFrame:
    """The best row of each user on each model."""
    best = Window.partitionBy("model", "user_id").orderBy(
        F.col("score").desc(),
        F.col("hits").desc(),
        F.col("messages").desc(),
        F.col("created_at").asc(),
        F.col("submission_id").asc(),
    )
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")


def rank_within_model(best: DataFrame, n: int = fixed.ROWS_PER_MODEL) -> DataFrame:
    """The first n users of each model, with rank."""
    order = Window.partitionBy("model").orderBy(
        F.col("score").desc(), F.col("hits").desc(), F.col("messages").desc(), F.col("login").asc()
    )
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def board_models(
    models: DataFrame, submissions: DataFrame, entries: DataFrame, n: int = fixed.ROWS_PER_MODEL
) -> DataFrame:
    """Top users of every model, over latest submissions."""
    current = join_latest_submission(models, latest_per_user(submissions))
    scored = cross_prior(join_entry_dim(current, entries), prior(current))
    return rank_within_model(best_per_user_model(scored), n)


def group_panels(board: DataFrame) -> DataFrame:
    """model and its rows in rank order; a board holds a bounded number of rows per model."""
    columns = ("rank", "login", "display_name", "avatar_url", "hits", "messages", "mdi", "score")
    row = F.struct(*(c for c in columns if c in board.columns))
    return board.groupBy("model").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def hottest(
    children: DataFrame,
    submissions: DataFrame,
    models: DataFrame,
    name: str,
    limit: int = fixed.HOTTEST_LIMIT,
) -> DataFrame:
    """Names by pooled shrunk score over latest submissions.

    ``models`` gives the prior: the agent board uses the prior of the model rows too.
    """
    latest = latest_per_user(submissions)
    pooled = (
        join_latest_submission(children, latest)
        .groupBy(name)
        .agg(
            F.sum("hits").alias("hits"),
            F.sum("messages").alias("messages"),
            F.count_distinct("user_id").alias("contributors"),
        )
        .withColumn(
            "mdi",
            F.coalesce(
                F.col("hits").cast("double") * 1000.0 / F.nullif(F.col("messages"), F.lit(0)).cast("double"),
                F.lit(0.0),
            ),
        )
    )
    scored = cross_prior(pooled, prior(join_latest_submission(models, latest)))
    return scored.orderBy(F.col("score").desc(), F.col("hits").desc(), F.col(name).asc()).limit(limit)


#: Ranges of an order table, about equal in size.
RANGES = 64


@dataclass(frozen=True)
class OrderTable:
    """Scored entries in folders by range of score, and the exact number of users of each range.

    Built once, it answers the rank of any user from the counts and one folder.
    """

    rows: DataFrame
    counts: DataFrame

    @classmethod
    def of(cls, entries: DataFrame) -> OrderTable:
        scored = cross_prior(entries, prior(entries))
        # Approximate bounds do: ranges need not be equal, and the counts are exact.
        shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
        bounds = scored.agg(F.percentile_approx("score", shares).alias("_bounds"))
        # A single row.
        ranged = scored.crossJoin(F.broadcast(bounds)).withColumn(
            "range", leading(F.col("_bounds"), lambda b: b <= F.col("score"))
        )
        rows = staged(ranged.drop("_bounds"), "scored", by="range")
        return cls(rows, staged(rows.groupBy("range").agg(F.count("*").alias("users")), "ranges"))

    def rank(self, person: DataFrame) -> DataFrame:
        """One row: the place of ``person``, a single row of the table, among all users."""
        keys = (-F.col("score"), -F.col("hits"), -F.col("messages"), F.col("updated_at"), F.col("user_id"))
        mine = F.broadcast(person.select(F.col("range").alias("_range"), F.struct(*keys).alias("_mine")))
        above = self.counts.crossJoin(mine).where(F.col("range") > F.col("_range"))
        beside = self.rows.join(mine, F.col("range") == F.col("_range")).where(F.struct(*keys) < F.col("_mine"))
        before = above.select("users").unionByName(beside.select(F.lit(1).cast("bigint").alias("users")))
        return before.agg((F.coalesce(F.sum("users"), F.lit(0)) + 1).alias("rank"))


def _of_user(rows: DataFrame, who: DataFrame) -> DataFrame:
    """The rows of the user that ``who`` names, a table of one row with a login or a user_id."""
    one = F.broadcast(who.limit(1))
    if "user_id" in who.columns:
        return rows.join(one.select("user_id"), "user_id", "left_semi")
    asked = one.select(F.lower("login").alias("_login"))
    return rows.join(asked, F.lower("login") == F.col("_login"), "left_semi")


def profile(entries: DataFrame, submissions: DataFrame, who: DataFrame, table: OrderTable | None = None) -> DataFrame:
    """One user's entry with rank over everybody, and their latest submission.

    ``who`` has one row, a login (in any case) or a user_id. The rank is the number of users
    ahead plus one: counts of the ranges above, and one range that is looked into.
    """
    table = table or OrderTable.of(entries)
    person = _of_user(table.rows, who).orderBy(*people_order()).limit(1)
    latest = latest_payload(submissions, person.select("user_id"))
    return (
        # Single rows.
        person.crossJoin(F.broadcast(table.rank(person)))
        .join(F.broadcast(latest), "user_id", "left")
        .withColumn("submitted_at", F.coalesce("submitted_at", "updated_at"))
        .drop("range")
    )


def viewer_entry(entries: DataFrame, who: DataFrame) -> DataFrame:
    """One user's entry with score, without rank; ``who`` as for a profile."""
    return cross_prior(_of_user(entries, who), prior(entries))


def latest_payload(submissions: DataFrame, who: DataFrame) -> DataFrame:
    """The stored payload of the latest submission of one user, as (user_id, payload_json, submitted_at)."""
    return (
        _of_user(submissions, who.select("user_id"))
        .orderBy(F.col("created_at").desc(), F.col("submission_id").desc())
        .limit(1)
        .select("user_id", "payload_json", F.col("created_at").alias("submitted_at"))
    )


def join_profile_payload(entries: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every entry with the payload of its latest submission; NULL if there is none."""
    latest = latest_per_user(submissions).select(
        "user_id", "submission_id", "payload_json", F.col("created_at").alias("submitted_at")
    )
    return entries.join(latest, "user_id", "left").withColumn(
        "submitted_at", F.coalesce("submitted_at", "updated_at")
    )


def profile_models(profile_row: DataFrame) -> DataFrame:
    """Model rows of a profile's stored payload, highest rate first."""
    stored = stored_payloads(profile_row.select("user_id", "payload_json"))
    return (
        stored.select("user_id", F.inline_outer("model_entries"))
        .where(F.col("name").isNotNull())
        .withColumnRenamed("name", "model")
        .select("user_id", "model", "hits", "messages", "mdi")
        .orderBy(F.col("mdi").desc(), F.col("model").asc())
    )
