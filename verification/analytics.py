"""Checks of detection, rollups, rankings and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assentlake import fixed
from assentlake.operators import detect, metrics, ranking
from assentlake.plans.report import SECTIONS, Report, build_report, report_summary, write_json, write_tables
from assentlake.plans.scan import configured_sources
from assentlake.session import shared_folder, staged
from verification.registry import query
from verification.relations import MESSAGES, Relations
from verification.sql import detection, level, norm_model, rate

D = detection()

MODELS = f"""select norm_model as model, count(*) as messages, cast(sum(n_hits) as bigint) as hits
  from counted group by 1"""
RATED = f"""select *, {rate('hits', 'messages', 100)} as rate, {rate('hits', 'messages', 1000)} as mdi from ({MODELS}) c"""
RANKING = f"""select *, {level('mdi')} as level, row_number() over (order by hits desc, mdi desc, model) as rank
  from ({RATED}) c"""
PHRASES = "select phrase, count(*) as hits, arg_min(category, rank) as category from hits group by 1"
PER_MODEL = """select model, phrase, n, row_number() over (partition by model order by n desc, phrase) as place
  from (select norm_model as model, phrase, count(*) as n from hits group by 1, 2) c"""
QUOTES = f"""select * exclude (n, phrase_hits) from (
    select q.*, row_number() over (order by round, phrase_hits desc, phrase) as place from (
      select phrase, harness, session_id, ts, model, category, snippet,
        row_number() over (partition by phrase order by ts desc nulls last, harness, session_id, model, snippet) as round,
        count(*) over (partition by phrase) as phrase_hits
      from hits) q) p, (select count(distinct phrase) as n from hits) t
  where place <= least(200, greatest(60, n))"""


def quotes_shown(quotes: DataFrame) -> DataFrame:
    return quotes.select(
        "place", "round", "phrase", "harness", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        "model", "category", "snippet",
    )


@query(
    "match_candidates",
    D + "select msg_id, rank, phrase, category, start, length from cand",
)
def _(r: Relations):
    return detect.match_candidates(r.messages, r.matcher).select(
        "msg_id", "rank", "phrase", "category", "start", "length"
    )


@query("resolve_overlaps", D + "select msg_id, rank, start, length from hits")
def _(r: Relations):
    spans = detect.with_spans(r.messages, r.matcher)
    return spans.select("msg_id", F.inline("spans")).select("msg_id", "rank", "start", "length")


@query("snippet", D + "select msg_id, start, snippet from hits")
def _(r: Relations):
    return r.hits.select("msg_id", "start", "snippet")


@query("display_phrase", D + "select msg_id, start, phrase from hits")
def _(r: Relations):
    return r.hits.select("msg_id", "start", "phrase")


@query(
    "hits",
    D + "select msg_id, harness, session_id, ts, model, norm_model, rank, phrase, category, start, length, snippet from hits",
)
def _(r: Relations):
    return r.hits.select(
        "msg_id", "harness", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "model", "norm_model",
        "rank", "phrase", "category", "start", "length", "snippet",
    )


@query(
    "message_hits",
    D + "select msg_id, n_hits, case when n_hits > 0 then 1 else 0 end as matched from counted",
)
def _(r: Relations):
    return detect.message_hits(r.messages, r.matcher)


@query("agg_model_messages", f"select {norm_model('model')} as model, count(*) as messages from ({MESSAGES}) m group by 1")
def _(r: Relations):
    return metrics.model_messages(r.messages)


@query("agg_model_hits", D + "select norm_model as model, count(*) as hits from hits group by 1")
def _(r: Relations):
    return metrics.model_hits(r.hits)


@query(
    "agg_model_harnesses",
    f"""select {norm_model('model')} as model, array_to_string(list_sort(list(distinct harness)), ',') as harnesses
        from ({MESSAGES}) m group by 1""",
)
def _(r: Relations):
    return metrics.model_harnesses(r.messages).withColumn("harnesses", F.array_join("harnesses", ","))


@query("join_matches_left", D + MODELS)
def _(r: Relations):
    return metrics.join_matches_left(metrics.model_messages(r.messages), metrics.model_hits(r.hits))


@query("agg_sessions", f"select count(distinct session_id) as sessions from ({MESSAGES}) m")
def _(r: Relations):
    return metrics.sessions(r.messages)


@query("agg_daily", D + "select cast(ts as date) as day, count(*) as hits from hits where ts is not null group by 1")
def _(r: Relations):
    return metrics.daily(r.counted)


@query("agg_phrases", D + PHRASES)
def _(r: Relations):
    return metrics.phrases(r.hits)


@query(
    "agg_harness",
    D
    + f"""select dim.*, coalesce(messages, 0) as messages, coalesce(hits, 0) as hits,
            {rate('coalesce(hits, 0)', 'coalesce(messages, 0)', 1000)} as mdi
          from (values ('claude', 'Claude Code'), ('codex', 'Codex'), ('omp', 'OMP'), ('pi', 'Pi Agent'),
            ('codebuddy', 'CodeBuddy/WorkBuddy'), ('cline', 'Cline'), ('openclaw', 'OpenClaw'), ('hermes', 'Hermes'),
            ('cursor', 'Cursor'), ('opencode', 'OpenCode'), ('other', 'Other')) dim(harness, name)
          left join (select harness, count(*) as messages, cast(sum(n_hits) as bigint) as hits from counted
                     group by 1) c using (harness)""",
)
def _(r: Relations):
    return metrics.harness_stats(r.counted)


@query(
    "agg_totals",
    D
    + f"""select *, {level('mdi')} as level from (select *, {rate('hits', 'messages', 100)} as rate,
            {rate('hits', 'messages', 1000)} as mdi
          from (select count(*) as messages, cast(sum(n_hits) as bigint) as hits from counted) c) c""",
)
def _(r: Relations):
    return metrics.totals(r.counted)


@query("active_harnesses", f"select count(distinct harness) + (select count(*) from region) as active from ({MESSAGES}) m")
def _(r: Relations):
    # A home folder for every agent with messages, and empty ones named after the regions; one
    # folder that is asked for is not there.
    home = shared_folder(r.spark, "homes")
    r.messages.select("harness", "msg_id").write.partitionBy("harness").parquet(home)
    r.sql("select concat('region-', cast(r_regionkey as varchar(9))) as harness, r_name from region").write.mode("append").partitionBy("harness").parquet(home)
    regions = [f"region-{row.r_regionkey}" for row in r.sql("select r_regionkey from region").collect()]
    roots = {name: f"{home}/harness={name}" for name in (*fixed.HARNESS_NAMES, *regions, "absent")}
    return metrics.active_harnesses(configured_sources(r.spark, roots))


@query(
    "merge_partials",
    D
    + """select norm_model as model, count(*) as messages, cast(sum(n_hits) as bigint) as hits,
           count(distinct harness) as harnesses, count(distinct session_id) as sessions from counted group by 1""",
)
def _(r: Relations):
    # Three runs over parts that share models and sessions, each rolled up on its own.
    counted = staged(r.counted, "counted")
    keyed = counted.withColumn("model", F.col("norm_model"))
    parts = []
    for k in range(3):
        run = keyed.where(F.pmod(F.xxhash64("msg_id"), F.lit(3)) == k)
        parts.append(
            metrics.Partial(
                run.groupBy("model").agg(F.count("*").alias("messages"), F.sum("n_hits").alias("hits")),
                {
                    "harnesses": run.select("model", F.col("harness").alias("element")).distinct(),
                    "sessions": run.select("model", F.col("session_id").alias("element")).distinct(),
                },
            )
        )
    merged = metrics.merge_partials(parts, ["model"], ["messages", "hits"])
    sessions = metrics.with_distinct(merged, ["model"], "sessions").select("model", "sessions")
    return metrics.with_distinct(merged, ["model"], "harnesses").join(sessions, "model")


@query(
    "corpus_stats",
    D + """select count(*) as messages, cast(sum(length(text)) as bigint) as characters,
             cast(sum(n_hits) as bigint) as hits from counted""",
)
def _(r: Relations):
    return metrics.corpus_stats(r.messages, r.matcher)


@query("rank_models", D + RANKING)
def _(r: Relations):
    return ranking.rank_models(metrics.model_counts(r.counted))


@query("top_models", D + f"select * exclude (rank) from ({RANKING}) t where rank <= 5")
def _(r: Relations):
    return ranking.top_models(metrics.model_counts(r.counted))


@query("top_phrases", D + f"{PHRASES} order by hits desc, phrase limit 5")
def _(r: Relations):
    return ranking.top_phrases(metrics.phrases(r.hits))


@query("top_phrases_per_model", D + f"select model, phrase, n as count, place from ({PER_MODEL}) t where place <= 5")
def _(r: Relations):
    top = ranking.top_phrases_per_model(r.hits)
    rows = top.select("model", F.posexplode("top").alias("at", "entry"))
    return rows.select("model", "entry.phrase", "entry.count", (F.col("at") + 1).alias("place"))


@query("quotes_round_robin", D + QUOTES)
def _(r: Relations):
    return quotes_shown(ranking.quotes_round_robin(r.found))


@query("quotes_by_phrase", D + f"select * from ({QUOTES}) t where contains(lower(phrase), 'you''re right')")
def _(r: Relations):
    return quotes_shown(ranking.quotes_by_phrase(ranking.quotes_round_robin(r.found), "You're Right"))


def _ranked(r: Relations) -> DataFrame:
    return ranking.rank_models(metrics.model_counts(r.counted))


@query("filter_tier", D + f"select * from ({RANKING}) t where mdi > 10")
def _(r: Relations):
    return ranking.ranking_view(_ranked(r), tier="high")


@query("search_model", D + f"select * from ({RANKING}) t where contains(model, 'alpha')")
def _(r: Relations):
    return ranking.ranking_view(_ranked(r), search=" Alpha")


@query("sort_ranking", D + f"select * from ({RANKING}) t order by messages, rank")
def _(r: Relations):
    return ranking.ranking_view(_ranked(r), sort="total", descending=False)


@query(
    "relative_share",
    D
    + f"""select model, mdi, cast(least(100, floor(mdi / greatest(max(mdi) over (), 1.0) * 100 + 0.5)) as int) as share
          from ({RATED}) t""",
)
def _(r: Relations):
    return ranking.relative_share(metrics.model_counts(r.counted)).select("model", "mdi", "share")


def _report(r: Relations) -> Report:
    return build_report(r.messages, r.matcher, active=11)


# What a report says, a row for each of its rows.
CONTENT = f"""
select 'head' as section, 'all' as name, cast(sum(n_hits) as bigint) as hits, count(*) as messages,
  (select {rate('sum(n_hits)', 'count(*)', 1000)} from counted) as mdi,
  concat_ws('|', cast(count(distinct session_id) as varchar), '11', '2024/6/1 20:00:00') as more from counted
union all select 'modelRankings', m.model, hits, messages, mdi,
  concat_ws('|', cast(level as varchar), coalesce(top, ''), harnesses)
  from ({RANKING}) m left join (select model, string_agg(concat(phrase, ':', n), ',' order by place) as top from ({PER_MODEL}) p where place <= 5 group by 1) t on t.model = m.model
  left join (select norm_model as model, array_to_string(list_sort(list(distinct harness)), ',') as harnesses from counted group by 1) h on h.model = m.model
union all select 'harnessStats', harness, coalesce(hits, 0), coalesce(messages, 0), {rate('coalesce(hits, 0)', 'coalesce(messages, 0)', 1000)}, name from
  (values ('claude', 'Claude Code'), ('codex', 'Codex'), ('omp', 'OMP'), ('pi', 'Pi Agent'), ('codebuddy', 'CodeBuddy/WorkBuddy'),
    ('cline', 'Cline'), ('openclaw', 'OpenClaw'), ('hermes', 'Hermes'), ('cursor', 'Cursor'), ('opencode', 'OpenCode'), ('other', 'Other')) dim(harness, name)
  left join (select harness, count(*) as messages, cast(sum(n_hits) as bigint) as hits from counted group by 1) c using (harness)
union all select 'dailyTimeline', strftime(cast(ts as date), '%Y-%m-%d'), count(*), null, null, '' from hits where ts is not null group by 2
union all select 'phraseCloud', phrase, hits, null, null, category from ({PHRASES}) p
union all select 'hallOfShame', phrase, epoch_ms(ts), null, null, concat_ws('|', harness, session_id, model, category, snippet) from ({QUOTES}) q
"""


def contents(parts: DataFrame) -> DataFrame:
    """Rows (section, v) of a report as the columns both engines compare."""

    def text(*names: str):
        return F.coalesce(*(F.try_variant_get("v", f"$.{n}", "string") for n in names))

    def number(*names: str):
        return F.coalesce(*(F.try_variant_get("v", f"$.{n}", "bigint") for n in names))

    top = F.try_variant_get("v", "$.topPhrases", "array<struct<phrase:string,count:bigint>>")
    section = F.col("section")
    more = (
        F.when(section == "head", F.concat_ws("|", text("totalSessionsScanned"), text("activeHarnessCount"), text("generatedDate")))
        .when(
            section == "modelRankings",
            F.concat_ws(
                "|",
                text("droolLevel.level"),
                F.array_join(F.transform(top, lambda t: F.concat_ws(":", t["phrase"], t["count"])), ","),
                F.array_join(F.try_variant_get("v", "$.harnesses", "array<string>"), ","),
            ),
        )
        .when(section == "harnessStats", text("name"))
        .when(section == "phraseCloud", text("category"))
        .when(section == "hallOfShame", F.concat_ws("|", *(text(n) for n in ("harness", "sessionId", "model", "category", "snippet"))))
        .otherwise("")
    )
    return parts.select(
        "section",
        F.when(section == "head", "all")
        .when(section == "hallOfShame", text("phrase"))
        .otherwise(text("model", "harness", "date", "text"))
        .alias("name"),
        number("droolCount", "totalDroolCount", "count", "timestamp").alias("hits"),
        number("totalMessages", "messageCount", "totalAssistantMessages").alias("messages"),
        F.coalesce(*(F.try_variant_get("v", f"$.{n}", "double") for n in ("droolIndex", "overallDroolIndex"))).alias("mdi"),
        more.alias("more"),
    )


@query("report_summary", D + CONTENT)
def _(r: Relations):
    parts = report_summary(_report(r), "1", r.run_ts)
    body = F.when(F.col("section") == "harnessStats", F.regexp_replace("text", '^"[^"]*":', "")).otherwise(F.col("text"))
    return contents(parts.select("section", F.parse_json(body).alias("v")))


@query("sink_json", D + CONTENT)
def _(r: Relations):
    path = shared_folder(r.spark, "report")
    write_json(report_summary(_report(r), "1", r.run_ts), path)
    whole = r.spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = whole.select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.try_variant_get("v", f"$.{n}", "variant").alias("rows")) for n, _ in SECTIONS))).alias("s")
    ).select("s.section", "s.rows")
    rows = lists.lateralJoin(r.spark.tvf.variant_explode(F.col("rows").outer())).select("section", F.col("value").alias("v"))
    return contents(whole.select(F.lit("head").alias("section"), "v").unionByName(rows))


@query(
    "sink_tables",
    D
    + f"""select 'totals' as section, 'all' as name, cast(sum(n_hits) as bigint) as hits, count(*) as messages, cast(count(distinct session_id) as varchar) as more from counted
    union all select 'models', model, hits, messages, cast(level as varchar) from ({RANKING}) m
    union all select 'top_phrases', model, n, place, phrase from ({PER_MODEL}) p where place <= 5
    union all select 'model_harnesses', norm_model, null, null, array_to_string(list_sort(list(distinct harness)), ',') from counted group by 2
    union all select section, name, hits, messages, more from ({CONTENT}) c where section in ('harnessStats', 'dailyTimeline', 'phraseCloud')
    union all select 'quotes', phrase, place, null, snippet from ({QUOTES}) q""",
)
def _(r: Relations):
    path = shared_folder(r.spark, "tables")
    write_tables(_report(r), path)
    none = F.lit(None).cast("bigint")

    def rows(table: str, name, hits, messages, more, section: str | None = None, explode=None) -> DataFrame:
        read = r.spark.read.parquet(f"{path}/{table}")
        read = read if explode is None else read.select("*", explode)
        return read.select(
            F.lit(section or table).alias("section"), name.alias("name"), hits.alias("hits"), messages.alias("messages"), more.cast("string").alias("more")
        )

    c = F.col
    parts = [
        rows("totals", F.lit("all"), c("hits"), c("messages"), c("sessions")),
        rows("models", c("model"), c("hits"), c("messages"), c("level")),
        rows("top_phrases", c("model"), c("entry.count"), (c("at") + 1).cast("bigint"), c("entry.phrase"), explode=F.posexplode("top").alias("at", "entry")),
        rows("model_harnesses", c("model"), none, none, F.array_join("harnesses", ",")),
        rows("harnesses", c("harness"), c("hits"), c("messages"), c("name"), "harnessStats"),
        rows("daily", F.date_format("day", "yyyy-MM-dd"), c("hits"), none, F.lit(""), "dailyTimeline"),
        rows("phrases", c("phrase"), c("hits"), none, c("category"), "phraseCloud"),
        rows("quotes", c("phrase"), c("place").cast("bigint"), none, c("snippet")),
    ]
    return reduce(DataFrame.unionByName, parts)
