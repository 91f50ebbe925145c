"""Checks of submissions and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from assentlake.functions.scores import reconcile_mdi
from assentlake.operators import boards, metrics, payloads
from assentlake.plans.leaderboard import apply_submissions, upsert_entries
from assentlake.session import shared_folder, staged
from assentlake.streaming.submissions import current_tables, write_batch
from verification.registry import query
from verification.relations import (
    ENTRIES,
    SUBMISSION_HARNESSES,
    SUBMISSION_MODELS,
    SUBMISSION_TOTALS,
    SUBMISSIONS,
    Relations,
)
from verification.sql import detection, level, rate, score

BY_NEWEST = "partition by user_id order by created_at desc, submission_id desc"
LATEST = f"select * exclude (n) from (select *, row_number() over ({BY_NEWEST}) as n from ({SUBMISSIONS}) s) x where n = 1"


def current(children: str) -> str:
    return f"select * from ({children}) ch where submission_id in (select submission_id from ({LATEST}) l)"


def prior_sql(rows: str) -> str:
    return f"select case when sum(messages) > 0 then cast(sum(hits) as double) / sum(messages) else 0.0 end as rate from ({rows}) pr"


def scored_sql(rows: str, prior_rows: str) -> str:
    return f"select x.*, {score('hits', 'messages', 'rate')} as score from ({rows}) x, ({prior_sql(prior_rows)}) p"


NOW_MODELS = current(SUBMISSION_MODELS)
SCORED_PEOPLE = scored_sql(ENTRIES, ENTRIES)
PEOPLE = f"select *, row_number() over (order by score desc, hits desc, messages desc, updated_at, user_id) as rank from ({SCORED_PEOPLE}) s"
SCORED_MODELS = scored_sql(
    f"select m.*, login, display_name, avatar_url from ({NOW_MODELS}) m join (select user_id, login, display_name, avatar_url from ({ENTRIES}) e) e using (user_id)", NOW_MODELS
)
BEST = f"""select * exclude (n) from (select *, row_number() over (partition by model, user_id
  order by score desc, hits desc, messages desc, created_at, submission_id) as n from ({SCORED_MODELS}) b) b where n = 1"""
RANKED = f"""select * from (select *, row_number() over (partition by model
  order by score desc, hits desc, messages desc, login) as rank from ({BEST}) r) r"""


def hottest_sql(children: str, name: str) -> str:
    pooled = f"""select {name}, cast(sum(hits) as bigint) as hits, cast(sum(messages) as bigint) as messages,
      count(distinct user_id) as contributors from ({current(children)}) c group by 1"""
    return f"""select {name}, hits, messages, contributors, round(hits * 1000.0 / messages, 6) as mdi, round(score, 6) as score
      from ({scored_sql(pooled, NOW_MODELS)}) h order by score desc, hits desc, {name} limit 12"""


def rounded(df, *columns: str):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def ntz(df, *columns: str):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("prior_people", f"select round(rate, 12) as rate from ({prior_sql(ENTRIES)}) p")
def _(r: Relations):
    return boards.prior(r.entries).select(F.round("rate", 12).alias("rate"))


@query("prior_models", f"select round(rate, 12) as rate from ({prior_sql(NOW_MODELS)}) p")
def _(r: Relations):
    now = boards.join_latest_submission(r.models, boards.latest_per_user(r.submissions))
    return boards.prior(now).select(F.round("rate", 12).alias("rate"))


@query("latest_per_user", LATEST)
def _(r: Relations):
    return ntz(boards.latest_per_user(r.submissions), "created_at")


@query("join_latest_submission", f"select submission_id, user_id, model, hits, messages from ({NOW_MODELS}) x")
def _(r: Relations):
    now = boards.join_latest_submission(r.models, boards.latest_per_user(r.submissions))
    return now.select("submission_id", "user_id", "model", "hits", "messages")


@query(
    "join_entry_dim",
    f"""select submission_id, model, login, display_name, avatar_url from ({SUBMISSION_MODELS}) m
        join (select user_id, login, display_name, avatar_url from ({ENTRIES}) e) e using (user_id)""",
)
def _(r: Relations):
    return boards.join_entry_dim(r.models, r.entries).select("submission_id", "model", "login", "display_name", "avatar_url")


@query("cross_prior", f"select submission_id, model, round(score, 6) as score from ({scored_sql(SUBMISSION_MODELS, SUBMISSION_MODELS)}) x")
def _(r: Relations):
    return rounded(boards.cross_prior(r.models, boards.prior(r.models)), "score").select("submission_id", "model", "score")


@query("shrunk_score", f"select user_id, round(score, 6) as score from ({SCORED_PEOPLE}) x")
def _(r: Relations):
    return rounded(boards.cross_prior(r.entries, boards.prior(r.entries)), "score").select("user_id", "score")


_BOARD = f"select rank, user_id, login, hits, messages, mdi, round(score, 6) as score from ({PEOPLE}) x"


@query("board_people", f"{_BOARD} where rank <= 100")
def _(r: Relations):
    board = rounded(boards.board_people(r.entries), "score")
    return board.select("rank", "user_id", "login", "hits", "messages", "mdi", "score")


@query("board_tiers", f"select rank, user_id, {level('score')} as level from ({PEOPLE}) x where rank <= 50")
def _(r: Relations):
    return boards.board_tiers(boards.board_people(r.entries, 50)).select("rank", "user_id", "level")


@query(
    "board_summary",
    f"""select count(*) as participants, cast(sum(hits) as bigint) as hits, cast(sum(messages) as bigint) as messages,
          round(avg(mdi), 6) as average_mdi from ({ENTRIES}) e""",
)
def _(r: Relations):
    return rounded(boards.board_summary(r.entries), "average_mdi")


@query("best_per_user_model", f"select model, user_id, submission_id, hits from ({BEST}) b")
def _(r: Relations):
    now = boards.join_latest_submission(r.models, boards.latest_per_user(r.submissions))
    scored = boards.cross_prior(boards.join_entry_dim(now, r.entries), boards.prior(now))
    return boards.best_per_user_model(scored).select("model", "user_id", "submission_id", "hits")


@query(
    "rank_within_model",
    f"""select * from (select model, user_id, submission_id, row_number() over (partition by model
          order by score desc, hits desc, messages desc, concat(login, '-', cast(submission_id as varchar(20)))) as rank
        from ({scored_sql(f"select m.*, c_name as login from ({SUBMISSION_MODELS}) m join customer on c_custkey = user_id", SUBMISSION_MODELS)}) s) t
        where rank <= 10""",
)
def _(r: Relations):
    people = r.sql("select c_custkey as user_id, c_name as login from customer")
    scored = boards.cross_prior(boards.join_entry_dim(r.models, people), boards.prior(r.models))
    named = scored.withColumn("login", F.concat_ws("-", "login", F.col("submission_id").cast("string")))
    return boards.rank_within_model(named, 10).select("model", "user_id", "submission_id", "rank")


@query("board_models", f"select model, rank, login, display_name, avatar_url, hits, messages, mdi, round(score, 6) as score from ({RANKED}) x where rank <= 20")
def _(r: Relations):
    board = boards.board_models(r.models, r.submissions, r.entries)
    return rounded(board, "score").select(
        "model", "rank", "login", "display_name", "avatar_url", "hits", "messages", "mdi", "score"
    )


@query(
    "group_panels",
    f"""select model, string_agg(concat_ws(':', cast(rank as varchar(9)), login, display_name, avatar_url, cast(hits as varchar(20)),
            cast(cast(round(mdi * 1000) as bigint) as varchar(20))), ',' order by rank) as panel
        from ({RANKED}) x where rank <= 10 group by 1""",
)
def _(r: Relations):
    panels = boards.group_panels(boards.board_models(r.models, r.submissions, r.entries, 10))
    lines = F.transform(
        "rows",
        lambda row: F.concat_ws(
            ":", row["rank"], row["login"], row["display_name"], row["avatar_url"], row["hits"],
            F.round(row["mdi"] * 1000).cast("bigint"),
        ),
    )
    return panels.select("model", F.array_join(lines, ",").alias("panel"))


@query("hottest_models", hottest_sql(SUBMISSION_MODELS, "model"))
def _(r: Relations):
    return rounded(boards.hottest(r.models, r.submissions, r.models, "model"), "mdi", "score")


@query("hottest_harnesses", hottest_sql(SUBMISSION_HARNESSES, "harness"))
def _(r: Relations):
    return rounded(boards.hottest(r.harness_rows, r.submissions, r.models, "harness"), "mdi", "score")


# Submitted documents. What a submission must look like after cleaning, by kind of untidiness.
KIND = "submission_id % 11"
CLEAN = f"""
select submission_id, user_id, created_at, hits, messages, model_count, version,
  case when messages > 0 then floor((case {KIND}
      when 9 then computed * 1.005 else hits * 1000.0 / messages end) * 1000 + 0.5) / 1000 else 0.0 end as mdi
from (select submission_id, user_id, created_at, messages, hits * 1000.0 / messages as computed,
        case when {KIND} = 1 then 0 else hits end as hits,
        case when {KIND} = 10 then concat('v', repeat('1', 39)) else '0.1.7' end as version,
        case when {KIND} = 2 then named else all_models end as model_count
      from (select submission_id, user_id, created_at, cast(sum(messages) as bigint) as messages,
              cast(sum(hits) as bigint) as hits, count(*) as all_models,
              cast(sum(case when hits % 5 = 0 then 0 else 1 end) as bigint) as named
            from ({SUBMISSION_MODELS}) sm group by 1, 2, 3) t) t
where {KIND} not in (4, 5, 8)
"""
CLEAN_MODELS = f"""
select submission_id, user_id, model, hits, messages, created_at, floor(hits * 1000.0 / messages * 1000 + 0.5) / 1000 as mdi
from ({SUBMISSION_MODELS}) sm where {KIND} not in (4, 5, 8) and not ({KIND} = 2 and hits % 5 = 0)
"""


@query(
    "payload_parse",
    f"""select t.submission_id, case when c.submission_id is null then 0 else 1 end as accepted, coalesce(c.hits, 0) as hits,
          coalesce(c.messages, 0) as messages, coalesce(c.mdi, 0.0) as mdi, coalesce(c.version, '') as version,
          coalesce(names, '') as names
        from ({SUBMISSION_TOTALS}) t left join ({CLEAN}) c on c.submission_id = t.submission_id
        left join (select submission_id, string_agg(concat_ws(':', model, cast(hits as varchar(20)), cast(messages as varchar(20))), ',' order by model, hits, messages) as names
                   from ({CLEAN_MODELS}) m group by 1) m on m.submission_id = t.submission_id""",
)
def _(r: Relations):
    parsed = payloads.parse_payloads(r.raw_payloads)
    ordered = F.transform(
        F.array_sort(F.transform("model_entries", lambda e: F.struct(e["name"], e["hits"], e["messages"]))),
        lambda e: F.concat_ws(":", e["name"], e["hits"], e["messages"]),
    )
    return parsed.select(
        "submission_id", F.col("accepted").cast("int").alias("accepted"), "hits", "messages", "mdi", "version",
        F.array_join(ordered, ",").alias("names"),
    )


@query(
    "payload_sanitize",
    f"select submission_id, hits, messages, model_count, version, 3 as sessions_scanned, 17 as generated_at from ({CLEAN}) c",
)
def _(r: Relations):
    parsed = payloads.parse_payloads(r.raw_payloads).where("accepted")
    return parsed.select(
        "submission_id", "hits", "messages", "model_count", "version", "sessions_scanned", "generated_at"
    )


@query("payload_entries", f"select submission_id, model, hits, messages, mdi from ({CLEAN_MODELS}) c")
def _(r: Relations):
    docs = payloads.documents(r.raw_payloads.select("submission_id", "payload_json"))
    rows = payloads.entry_rows(docs, payloads.MODELS)
    return rows.select("submission_id", F.col("name").alias("model"), "hits", "messages", "mdi")


@query(
    "mdi_reconcile",
    f"""select submission_id, model, case when messages = 0 then 0.0 else floor((case
            when {KIND} = 0 then hits * 1000.0 / messages when {KIND} = 1 then hits * 1000.0 / messages
            when abs(hits * 1000.0 / messages * (1 + {KIND} * 0.0021) - hits * 1000.0 / messages)
              <= greatest(hits * 1000.0 / messages * 0.01, 0.001)
            then hits * 1000.0 / messages * (1 + {KIND} * 0.0021) else hits * 1000.0 / messages end) * 1000 + 0.5) / 1000 end as mdi
        from (select submission_id, model, hits, case when {KIND} = 10 then 0 else messages end as messages
              from ({SUBMISSION_MODELS}) s) m""",
)
def _(r: Relations):
    kind = F.col("submission_id") % 11
    rows = r.models.withColumn("messages", F.when(kind == 10, F.lit(0)).otherwise(F.col("messages")))
    computed = F.col("hits") * F.lit(1000.0) / F.nullif(F.col("messages"), F.lit(0))
    reported = F.when(kind != 1, computed * (F.lit(1) + kind * F.lit(0.0021).cast("double")))
    return rows.select(
        "submission_id", "model", reconcile_mdi(reported, F.col("hits"), F.col("messages")).alias("mdi")
    )


@query(
    "payload_stored",
    f"""select t.submission_id, coalesce(c.hits, 0) as hits, coalesce(c.messages, 0) as messages,
          coalesce(c.model_count, 0) as model_count, coalesce(c.version, '') as version
        from ({SUBMISSION_TOTALS}) t left join ({CLEAN}) c on c.submission_id = t.submission_id""",
)
def _(r: Relations):
    return payloads.stored_payloads(r.raw_payloads).select(
        "submission_id", "hits", "messages", "model_count", "version"
    )


D = detection()


@query(
    "payload_build",
    D
    + f"""select name, hits, messages, {rate('hits', 'messages', 1000)} as mdi from (
            select concat('model ', norm_model) as name, cast(sum(n_hits) as bigint) as hits, count(*) as messages from counted group by 1
            union all select concat('agent ', case harness when 'claude' then 'Claude Code' when 'codex' then 'Codex'
                when 'omp' then 'OMP' when 'pi' then 'Pi Agent' when 'codebuddy' then 'CodeBuddy/WorkBuddy' when 'cline' then 'Cline'
                when 'openclaw' then 'OpenClaw' when 'hermes' then 'Hermes' when 'cursor' then 'Cursor'
                when 'opencode' then 'OpenCode' else 'Other' end), cast(sum(n_hits) as bigint), count(*) from counted group by 1
            union all select 'all', cast(sum(n_hits) as bigint), count(*) from counted) p""",
)
def _(r: Relations):
    # One detection for all rollups.
    counted = staged(r.counted, "counted")
    document = payloads.build_payload(
        metrics.totals(counted),
        metrics.model_counts(counted),
        metrics.harness_stats(counted),
        metrics.sessions(counted),
        "0.1.7",
        r.run_ts,
    )
    back = payloads.parse_payloads(document)
    models = back.select(F.inline("model_entries")).withColumn("name", F.concat(F.lit("model "), "name"))
    agents = back.select(F.inline("harness_entries")).withColumn("name", F.concat(F.lit("agent "), "name"))
    everything = back.select(F.lit("all").alias("name"), "hits", "messages", "mdi")
    # The cleaned rate keeps what the report says; two digits are all a report gives.
    return models.unionByName(agents).unionByName(everything).withColumn("mdi", F.round("mdi", 2))


NEW_ENTRIES = f"""select * exclude (n) from (select *, row_number() over ({BY_NEWEST}) as n from ({CLEAN}) c) c where n = 1"""


@query(
    "entries_upsert",
    f"""select user_id, hits, messages, model_count, created_at as updated_at from ({NEW_ENTRIES}) n""",
)
def _(r: Relations):
    # Two batches, the newer half first: the older half must not overwrite it.
    early = F.col("created_at") < F.lit("1995-06-17").cast("timestamp_ntz")
    newer = apply_submissions(r.raw_payloads.where(~early))
    older = apply_submissions(r.raw_payloads.where(early))
    state = upsert_entries(newer.entries, older.entries)
    return ntz(state, "updated_at").select("user_id", "hits", "messages", "model_count", "updated_at")


@query(
    "submissions_append",
    f"""select submission_id, c.user_id, c.hits, c.messages, c.mdi, c.model_count, c.version,
          coalesce(names, 0) as names, case when e.updated_at = c.created_at then e.hits end as entry_hits
        from ({CLEAN}) c left join (select submission_id, count(*) as names from ({CLEAN_MODELS}) m group by 1) m using (submission_id)
        join (select user_id, hits, created_at as updated_at from ({NEW_ENTRIES}) n) e on e.user_id = c.user_id""",
)
def _(r: Relations):
    # Three batches through the tables a stream feeds, compacted after two. Of a user's
    # submissions at the same time, the one that came in a later batch counts.
    path = shared_folder(r.spark, "history")
    raw = staged(r.raw_payloads, "raw")
    for n in range(3):
        write_batch(raw.where(F.least(F.floor(F.col("submission_id") / 5000), F.lit(2)) == n), n, path, every=2)
    tables = current_tables(r.spark, path)
    names = tables.models.groupBy("submission_id").agg(F.count("*").alias("names"))
    entries = tables.entries.select("user_id", F.col("hits").alias("_hits"), "updated_at")
    rows = tables.submissions.join(names, "submission_id", "left").join(entries, "user_id")
    return rows.select(
        "submission_id", "user_id", "hits", "messages", "mdi", "model_count", "version",
        F.coalesce("names", F.lit(0)).alias("names"),
        F.when(F.col("updated_at") == F.col("created_at"), F.col("_hits")).alias("entry_hits"),
    )


@query(
    "explode_models",
    f"select submission_id, user_id, model, hits, messages, mdi from ({CLEAN_MODELS}) c",
)
def _(r: Relations):
    models = apply_submissions(r.raw_payloads).models
    return models.select("submission_id", "user_id", "model", "hits", "messages", "mdi")


@query(
    "explode_harnesses",
    f"""select submission_id, user_id, harness, hits, messages, floor(hits * 1000.0 / messages * 1000 + 0.5) / 1000 as mdi
        from ({SUBMISSION_HARNESSES}) h""",
)
def _(r: Relations):
    # Every name is sent twice; only its first row may count.
    entry = F.struct(
        F.col("harness"), F.col("hits").alias("droolCount"), F.col("messages").alias("totalMessages")
    )
    again = F.struct(F.col("harness"), F.lit(1).alias("droolCount"), F.lit(1).alias("totalMessages"))
    rows = r.harness_rows.groupBy("submission_id", "user_id", "created_at").agg(
        F.collect_list(entry).alias("a"), F.collect_list(again).alias("b")
    )
    document = F.format_string('{"harnessEntries":%s}', F.to_json(F.concat("a", F.col("b").cast(
        "array<struct<harness:string,droolCount:bigint,totalMessages:bigint>>"))))
    raw = rows.select("submission_id", "user_id", "created_at", document.alias("payload_json"))
    out = apply_submissions(raw).harnesses
    return out.select("submission_id", "user_id", "harness", "hits", "messages", "mdi")


@query(
    "profile",
    f"""select rank, user_id, login, hits, messages, round(score, 6) as score, t.submission_id % 11 as kind,
          t.created_at as submitted_at
        from ({PEOPLE}) p join (select *, row_number() over ({BY_NEWEST}) as n from ({SUBMISSION_TOTALS}) s) t using (user_id)
        where n = 1 and lower(login) = (select lower(max(login)) from ({ENTRIES}) e)""".replace(
        "hits, messages, round", "p.hits, p.messages, round"
    ),
)
def _(r: Relations):
    # The login asked for is a value of the data; two engines must agree on which one.
    who = r.entries.agg(F.upper(F.max("login")).alias("login"))
    history = r.raw_payloads.withColumn("payload_json", (F.col("submission_id") % 11).cast("string"))
    row = boards.profile(r.entries, history, who)
    return rounded(ntz(row, "submitted_at"), "score").select(
        "rank", "user_id", "login", "hits", "messages", "score",
        F.col("payload_json").cast("int").alias("kind"), "submitted_at",
    )


@query(
    "join_profile_payload",
    f"""select user_id, t.submission_id, t.created_at as submitted_at from ({ENTRIES}) e
        join (select *, row_number() over ({BY_NEWEST}) as n from ({SUBMISSION_TOTALS}) s) t using (user_id) where n = 1""",
)
def _(r: Relations):
    joined = boards.join_profile_payload(r.entries, r.raw_payloads)
    return ntz(joined, "submitted_at").select("user_id", "submission_id", "submitted_at")


@query(
    "viewer_entry",
    f"select user_id, login, hits, messages, round(score, 6) as score from ({SCORED_PEOPLE}) s where user_id = (select max(user_id) from ({ENTRIES}) e)",
)
def _(r: Relations):
    who = r.entries.agg(F.max("user_id").alias("user_id"))
    return rounded(boards.viewer_entry(r.entries, who), "score").select("user_id", "login", "hits", "messages", "score")


@query(
    "latest_payload",
    f"""select user_id, created_at as submitted_at, coalesce(hits, 0) as hits, coalesce(model_count, 0) as model_count from
        (select t.*, c.hits as hits, c.model_count as model_count from
          (select submission_id, user_id, created_at from ({SUBMISSION_TOTALS}) s
           where user_id = (select max(user_id) from ({ENTRIES}) e) order by created_at desc, submission_id desc limit 1) t
         left join (select submission_id, hits, model_count from ({CLEAN}) c) c using (submission_id)) x""",
)
def _(r: Relations):
    who = r.entries.agg(F.max("user_id").alias("user_id"))
    stored = payloads.stored_payloads(boards.latest_payload(r.raw_payloads, who))
    return ntz(stored, "submitted_at").select("user_id", "submitted_at", "hits", "model_count")


@query(
    "profile_models",
    f"""select user_id, model, hits, messages, mdi from ({CLEAN_MODELS}) c
        where submission_id in (select submission_id from (select *, row_number() over ({BY_NEWEST}) as n
          from ({SUBMISSION_TOTALS}) s) t where n = 1)""",
)
def _(r: Relations):
    return boards.profile_models(boards.join_profile_payload(r.entries, r.raw_payloads))

