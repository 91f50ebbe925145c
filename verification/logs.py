"""Checks of sources and of the functions on log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assentlake.functions import (
    classify_level,
    flatten_content,
    normalize_model,
    parse_ts,
    strip_fences,
)
from assentlake.functions.text import at_least_three_characters, trim_all
from assentlake.operators.audit import line_audit, prefilter_audit
from assentlake.operators.carry import carry_forward
from assentlake.plans.scan import filter_harness, union_messages
from assentlake.session import shared_folder
from assentlake.sources.files import doc_elements, file_stem, parse_docs, parse_lines, read_docs, read_lines, selected
from assentlake.sources.lexicon import load_lexicon
from assentlake.sources.lookups import model_lookup, with_model
from assentlake.sources.normalize import (
    normalize_claude,
    normalize_cline,
    normalize_codebuddy,
    normalize_codex,
    normalize_cursor,
    normalize_hermes,
    normalize_omp,
    normalize_openclaw_docs,
    normalize_openclaw_lines,
    normalize_opencode,
    normalize_pi,
    normalize_pi_workflow,
)
from assentlake.sources.normalize.databases import join_message_part
from assentlake.sources.normalize.lines import is_claude_reply, not_synthetic
from assentlake.sources.normalize.shape import filled
from verification.registry import query
from verification.relations import MESSAGES, THREAD, THREADS, Relations
from verification.sql import (
    CODEX,
    STAMP,
    level,
    model_or,
    norm_model,
    normalized,
    note,
    session_model,
    trim,
)


def shown(messages: DataFrame) -> DataFrame:
    """The columns in which two engines compare messages: long texts as digests."""
    return messages.select(
        "harness",
        "session_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "model",
        F.length("text").alias("chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query(
    "src_jsonl",
    f"""select ord % 16 as bucket,
          cast(sum(1 + case when ord % 5 = 0 then 1 else 0 end + case when ord % 7 = 0 then 1 else 0 end) as bigint) as lines,
          cast(sum(1 + case when ord % 5 = 0 then 1 else 0 end) as bigint) as records
        from ({MESSAGES}) m group by 1""",
)
def _(r: Relations):
    # Written as text files first, then read as any folder of logs.
    path = shared_folder(r.spark, "jsonl")
    bucket = F.floor(F.col("pos") / 4) % 16
    r.claude_lines().select(bucket.alias("bucket"), "value").write.partitionBy("bucket").text(path)
    raw = read_lines(r.spark, path, ".txt", 2)
    folder = F.regexp_extract("file_path", r"bucket=(\d+)/", 1).cast("int")
    parsed = parse_lines(raw).groupBy(folder.alias("bucket")).agg(F.count("*").alias("records"))
    lines = raw.groupBy(folder.alias("bucket")).agg(F.count("*").alias("lines"))
    return lines.join(parsed, "bucket")


@query(
    "src_json_doc",
    f"""select session_id, count(*) as items, cast(sum(length(text)) as bigint) as chars
        from ({MESSAGES}) m where length({trim('text')}) > 0 group by 1""",
)
def _(r: Relations):
    # A file for each session, written first and then read as any folder of documents. A file is
    # written element by element, so no row holds a session.
    path = shared_folder(r.spark, "documents")
    item = F.format_string('{"role":"assistant","content":%s}', "q_text")
    rows = r.shaped.where(F.length(trim_all(F.col("text"))) > 0)
    # Never null, else the writer sorts the rows anew; this is the folder that it takes for null.
    folder = F.coalesce(F.nullif("session_id", F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    session = Window.partitionBy("session_id").orderBy("ord")
    first, last = F.row_number().over(session) == 1, F.lead(F.lit(1)).over(session).isNull()
    items = rows.select(folder.alias("session_id"), "ord", item.alias("item")).select(
        "session_id", F.concat(F.when(first, "[").otherwise(","), "item", F.when(last, "]").otherwise("")).alias("value")
    )
    items.write.option("lineSep", "\n").partitionBy("session_id").text(path)
    docs = parse_docs(read_docs(r.spark, path, ".txt", 2))
    listed = docs.select(
        F.regexp_extract("file_path", "session_id=([^/]+)/", 1).alias("session_id"), F.explode(doc_elements("$")).alias("e")
    )
    chars = F.length(F.try_variant_get("e", "$.content", "string"))
    return listed.groupBy("session_id").agg(F.count("*").alias("items"), F.sum(chars).alias("chars"))


CLAUDE = normalized(
    "claude", "session_id", STAMP, model_or("claude-code"), note(), f"ord % 13 <> 0 and length({note()}) > 0"
)


@query("norm_claude", CLAUDE)
def _(r: Relations):
    return shown(normalize_claude(r.claude_lines(), r.run_ts))


CODEX_ROWS = (
    normalized("codex", "thread", STAMP, "codex_model", note(), f"length({note()}) > 0", CODEX)
)


@query("norm_codex", CODEX_ROWS)
def _(r: Relations):
    return shown(normalize_codex(r.codex_lines(), model_lookup(r.threads), r.run_ts))


OMP = normalized(
    "omp", "session_id", STAMP, "run_model", note(), f"length({note()}) > 0", session_model("omp-model")
)


@query("norm_omp", OMP)
def _(r: Relations):
    return shown(normalize_omp(r.session_lines("omp"), r.run_ts))


PI_ROWS = (
    normalized("pi", "session_id", STAMP, "run_model", note(), f"length({note()}) > 0", session_model("pi-model"))
)


@query("norm_pi", PI_ROWS)
def _(r: Relations):
    return shown(normalize_pi(r.session_lines("pi", "modelId"), r.run_ts))


_RUN = "case when ord % 2 = 0 then session_id else msg_id end"
_NOW = "TIMESTAMP '2024-06-01 12:00:00'"


PI_WORKFLOW_ROWS = (
    normalized("pi", _RUN, _NOW, "'pi-workflow-agent'", "text", "ord % 7 <> 3")
    + " union all "
    + normalized("pi", _RUN, _NOW, "'pi-workflow-agent'", "''", "ord % 7 <> 3")
)


@query("norm_pi_workflow", PI_WORKFLOW_ROWS)
def _(r: Relations):
    return shown(normalize_pi_workflow(r.workflow_docs(), r.run_ts))


# Half of the sessions have a model of their own in the lookup table.
SESSIONS = THREADS.replace(THREAD, "session_id")


CODEBUDDY_ROWS = (
    normalized(
        "codebuddy",
        "session_id",
        STAMP,
        "case when m.model <> '' then m.model else coalesce(known, 'workbuddy-model') end",
        note(),
        f"ord % 11 <> 0 and length({note()}) > 0",
        f"select f.*, s.model as known from ({MESSAGES}) f left join ({SESSIONS}) s on s.id = f.session_id",
    )
)


@query("norm_codebuddy", CODEBUDDY_ROWS)
def _(r: Relations):
    lookup = model_lookup(r.sql(SESSIONS))
    return shown(normalize_codebuddy(r.codebuddy_lines(), lookup, r.run_ts))


CLINE = (
    normalized("cline", "session_id", STAMP, model_or("cline-model"), note(), f"ord % 7 <> 3 and length({note()}) > 0")
    + " union all "
    + normalized("cline", "session_id", STAMP, "'cline-model'", "text", "ord % 7 <> 3")
)


@query("norm_cline", CLINE)
def _(r: Relations):
    return shown(normalize_cline(r.cline_docs(), r.run_ts))


HERMES_ROWS = (
    normalized("hermes", "session_id", STAMP, model_or("hermes-model"), note(), f"ord % 7 <> 3 and length({note()}) > 0")
    + " union all "
    + normalized("hermes", "session_id", STAMP, "'answering'", trim("text"), "ord % 7 <> 3")
)


@query("norm_hermes", HERMES_ROWS)
def _(r: Relations):
    return shown(normalize_hermes(r.hermes_docs(), r.run_ts))


OPENCLAW_ROWS = (
    normalized("openclaw", "session_id", STAMP, model_or("openclaw-model"), trim("text"), f"length({trim('text')}) > 0")
    + " union all "
    + normalized(
        "openclaw",
        "session_id",
        STAMP,
        "case when model <> '' then model when ord % 3 = 1 then 'of-file' else 'openclaw-model' end",
        trim("text"),
        f"ord % 7 <> 3 and length({trim('text')}) > 0",
    )
)


@query("norm_openclaw", OPENCLAW_ROWS)
def _(r: Relations):
    lines = normalize_openclaw_lines(r.openclaw_lines(), r.run_ts)
    return shown(lines.unionByName(normalize_openclaw_docs(r.openclaw_docs(), r.run_ts)))


CURSOR_ROWS = (
    normalized(
        "cursor", "session_id", STAMP, model_or("cursor-model"), trim("text"), f"ord % 9 <> 0 and length({trim('text')}) > 0"
    )
)


@query("norm_cursor", CURSOR_ROWS)
def _(r: Relations):
    return shown(normalize_cursor(r.cursor_rows(), r.run_ts))


OPENCODE_ROWS = (
    normalized(
        "opencode",
        "session_id",
        f"case when ord % 17 = 0 then {_NOW} else ts end",
        model_or("opencode-model"),
        trim("text"),
        f"ord % 9 <> 0 and length({trim('text')}) > 0",
    )
)


@query("norm_opencode", OPENCODE_ROWS)
def _(r: Relations):
    message, part = r.opencode_tables()
    return shown(normalize_opencode(message, part, r.run_ts))


@query(
    "join_message_part",
    f"""select session_id, count(*) as parts from ({MESSAGES}) m, (values (1), (2)) t(i) group by 1""",
)
def _(r: Relations):
    message, part = r.opencode_tables()
    return join_message_part(message, part).groupBy("session_id").agg(F.count("*").alias("parts"))


@query("lookup_codex_models", f"select id, model from ({THREADS}) t")
def _(r: Relations):
    return model_lookup(r.threads)


@query("lookup_codebuddy_models", f"select id, model from ({SESSIONS}) t")
def _(r: Relations):
    return model_lookup(r.sql(SESSIONS))


@query(
    "join_model_lookup",
    f"""select coalesce(th.model, 'codex-unknown') as model, count(*) as messages
        from ({MESSAGES}) m left join ({THREADS}) th on th.id = {THREAD} group by 1""",
)
def _(r: Relations):
    rows = r.messages.select(F.expr(THREAD).alias("thread"), F.lit(None).cast("string").alias("model"))
    named = with_model(rows, model_lookup(r.threads), F.col("thread"), "codex-unknown")
    return named.groupBy("model").agg(F.count("*").alias("messages"))


EVERY = " union all ".join(
    f"select * from ({rows}) x"
    for rows in (
        CLAUDE, CODEX_ROWS, OMP, PI_ROWS, PI_WORKFLOW_ROWS, CODEBUDDY_ROWS, CLINE, HERMES_ROWS, OPENCLAW_ROWS, CURSOR_ROWS, OPENCODE_ROWS,
    )
)


@query(
    "union_harnesses",
    f"select harness, count(*) as messages, cast(sum(chars) as bigint) as chars, count(distinct model) as models from ({EVERY}) u group by 1",
)
def _(r: Relations):
    parts = [
        normalize_claude(r.claude_lines(), r.run_ts),
        normalize_codex(r.codex_lines(), model_lookup(r.threads), r.run_ts),
        normalize_omp(r.session_lines("omp"), r.run_ts),
        normalize_pi(r.session_lines("pi", "modelId"), r.run_ts),
        normalize_pi_workflow(r.workflow_docs(), r.run_ts),
        normalize_codebuddy(r.codebuddy_lines(), model_lookup(r.sql(SESSIONS)), r.run_ts),
        normalize_cline(r.cline_docs(), r.run_ts),
        normalize_hermes(r.hermes_docs(), r.run_ts),
        normalize_openclaw_lines(r.openclaw_lines(), r.run_ts),
        normalize_openclaw_docs(r.openclaw_docs(), r.run_ts),
        normalize_cursor(r.cursor_rows(), r.run_ts),
        normalize_opencode(*r.opencode_tables(), r.run_ts),
    ]
    every = shown(union_messages(parts))
    return every.groupBy("harness").agg(
        F.count("*").alias("messages"), F.sum("chars").alias("chars"), F.count_distinct("model").alias("models")
    )


# Lexicon files in the making: one per brand, a phrase per part.
LEXICON_LINES = """
select p_partkey as line_no, case p_partkey % 7 when 0 then concat('# ', p_name) when 1 then ''
  when 2 then concat('  regex:', p_name, '[,\\s]*ok|', p_type, ' ')
  when 3 then concat('a|b.', p_name, ' |') when 4 then p_name
  else concat(p_name, ' (', cast(p_partkey as varchar(20)), ')|', lower(p_type)) end as value
from part
"""


@query(
    "lexicon_load",
    f"""with e as (select line_no, {trim('value')} as t from ({LEXICON_LINES}) l),
      s as (select line_no, {trim("left(t, length(t) - length(list_last(string_split(t, '|'))) - 1)")} as entry,
              {trim("list_last(string_split(t, '|'))")} as cat
            from e where t <> '' and not starts_with(t, '#') and contains(t, '|')),
      p as (select line_no, starts_with(entry, 'regex:') as re,
              case when starts_with(entry, 'regex:') then substring(entry, 7) else entry end as phrase,
              case when cat = '' then 'direct_agree' else cat end as category from s where entry <> '')
      select row_number() over (order by length(phrase) desc, line_no) as rank, phrase, category,
        case when re then 1 else 0 end as is_regex from p""",
)
def _(r: Relations):
    return load_lexicon(r.sql(LEXICON_LINES.replace("\\", "\\\\"))).select(
        "rank", "phrase", "category", F.col("is_regex").cast("int").alias("is_regex")
    )


@query(
    "line_audit",
    f"""select session_id as session,
          cast(sum(1 + case when ord % 5 = 0 then 1 else 0 end + case when ord % 7 = 0 then 1 else 0 end) as bigint) as lines,
          cast(sum(1 + case when ord % 5 = 0 then 1 else 0 end) as bigint) as parsed,
          cast(sum(case when ord % 4 = 2 then 1 + t else t end) as bigint) as assistant_texts
        from (select *, case when length({trim('text')}) > 0 then 1 else 0 end as t from ({MESSAGES}) m) m group by 1""",
)
def _(r: Relations):
    raw = r.claude_lines().withColumn("session", file_stem(F.col("file_path"), ".jsonl"))
    return line_audit(raw, "session")


@query(
    "prefilter_audit",
    f"""select session_id as session,
          cast(sum(1 + case when ord % 5 = 0 then 1 else 0 end + case when ord % 7 = 0 then 1 else 0 end) as bigint) as lines,
          cast(sum(1 + case when ord % 7 = 0 then 1 else 0 end) as bigint) as candidates,
          cast(sum(case when ord % 5 = 0 then 1 else 0 end) as bigint) as skipped,
          cast(0 as bigint) as skipped_with_text
        from ({MESSAGES}) m group by 1""",
)
def _(r: Relations):
    raw = r.claude_lines().withColumn("session", file_stem(F.col("file_path"), ".jsonl"))
    return prefilter_audit(raw, "session")


@query(
    "flatten_content",
    f"select msg_id, length({note()}) as chars, md5({note()}) as text_md5 from ({MESSAGES}) m",
)
def _(r: Relations):
    body = flatten_content(F.try_parse_json("content"), ["text"])
    rows = r.shaped.select("msg_id", r.content().alias("content")).select("msg_id", body.alias("t"))
    return rows.select("msg_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query(
    "filter_assistant",
    f"select session_id as session, count(*) as replies from ({MESSAGES}) m group by 1",
)
def _(r: Relations):
    v = parse_lines(r.claude_lines())
    replies = v.where(is_claude_reply())
    return replies.groupBy(file_stem(F.col("file_path"), ".jsonl").alias("session")).agg(
        F.count("*").alias("replies")
    )


@query(
    "filter_nonempty",
    f"select msg_id, length({trim('text')}) as chars from ({MESSAGES}) m where ord % 3 <> 0 and length({trim('text')}) > 0",
)
def _(r: Relations):
    blanked = F.when(F.col("ord") % 3 == 0, F.lit('" \\u3000\\n"')).otherwise(F.col("q_text"))
    body = flatten_content(F.try_parse_json("content"), ["text"])
    rows = filled(r.shaped.select("msg_id", blanked.alias("content")), body)
    return rows.select("msg_id", F.length("text").alias("chars"))


@query(
    "filter_synthetic",
    f"select model, count(*) as n from ({MESSAGES}) m where model <> 'model-x' group by 1",
)
def _(r: Relations):
    model = F.when(F.col("model") == "model-x", F.lit("synthetic")).otherwise(F.col("model"))
    rows = r.messages.select(model.alias("model"))
    return rows.where(not_synthetic(F.col("model"))).groupBy("model").agg(F.count("*").alias("n"))


@query(
    "filter_selfref",
    f"select session_id, count(*) as n from ({MESSAGES}) m where not contains(session_id, 'src1') group by 1",
)
def _(r: Relations):
    raw = r.openclaw_lines()
    kept = raw.where(selected(F.col("file_path"), "/logs", [".jsonl"], 3, exclude=["src1"]))
    replies = normalize_openclaw_lines(kept, r.run_ts)
    return replies.groupBy("session_id").agg(F.count("*").alias("n"))


@query(
    "filter_harness",
    f"select harness, count(*) as n from ({MESSAGES}) m where harness in ('claude', 'pi', 'other') group by 1",
)
def _(r: Relations):
    return filter_harness(r.messages, ["claude", "pi", "other"]).groupBy("harness").agg(F.count("*").alias("n"))


@query("parse_ts", f"select msg_id, {STAMP} as ts from ({MESSAGES}) m")
def _(r: Relations):
    record = F.try_parse_json(F.format_string('{"timestamp":%s}', "stamp"))
    rows = r.shaped.select("msg_id", record.alias("v"))
    ts = parse_ts(F.col("v"), ["$.timestamp"], r.run_ts)
    return rows.select("msg_id", ts.cast("timestamp_ntz").alias("ts"))


_DIRTY = "case ord % 5 when 0 then concat('fox-', model) when 1 then concat(' X/', model, '@2025-01-01') when 2 then concat(model, '[1m]') else model end"


@query(
    "normalize_model",
    f"""select raw_model, {norm_model('raw_model')} as model, count(*) as n
        from (select {_DIRTY} as raw_model from ({MESSAGES}) m) d group by 1, 2""",
)
def _(r: Relations):
    rows = r.messages.select(F.expr(_DIRTY).alias("raw_model"))
    return rows.groupBy("raw_model", normalize_model(F.col("raw_model")).alias("model")).agg(
        F.count("*").alias("n")
    )


_STRIPPED = "regexp_replace(text, '```.*?```', ' ', 'gs')"


@query(
    "strip_fences",
    f"select msg_id, length({_STRIPPED}) as chars, md5({_STRIPPED}) as text_md5 from ({MESSAGES}) m",
)
def _(r: Relations):
    t = strip_fences(F.col("text"))
    return r.messages.select(
        "msg_id", F.length(t).alias("chars"), F.md5(t.cast("binary")).alias("text_md5")
    )


@query(
    "min_length",
    f"""select msg_id from (select msg_id, {_STRIPPED} as t from
          (select msg_id, case when ord % 3 = 0 then concat('```', text, '``` a') else text end as text from ({MESSAGES}) m) s) s
        where length({trim('t')}) >= 3""",
)
def _(r: Relations):
    fenced = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("```"), "text", F.lit("``` a"))).otherwise(F.col("text"))
    rows = r.messages.select("msg_id", strip_fences(fenced).alias("t"))
    return rows.where(at_least_three_characters(F.col("t"))).select("msg_id")


@query(
    "classify_level",
    f"select level, count(*) as n from (select {level('l_quantity * 1.25')} as level from lineitem) l group by 1",
)
def _(r: Relations):
    rows = r.sql("select l_quantity from lineitem")
    # Up to 62.5, so that every level occurs.
    return rows.groupBy(classify_level(F.col("l_quantity") * 1.25).alias("level")).agg(F.count("*").alias("n"))


@query(
    "carry_model",
    "select session_id, ord, run_model as model from ("
    + f"select *, coalesce(last_value(case when ord % 3 = 0 then nullif(model, '') end ignore nulls) over "
    + f"(partition by session_id order by ord rows between unbounded preceding and current row), 'start') as run_model "
    + f"from ({MESSAGES}) m) c",
)
def _(r: Relations):
    records = r.messages.select(
        F.col("session_id").alias("file_path"),
        F.floor(F.col("ord") / 8).alias("block_start"),
        F.col("ord").alias("pos"),
        F.when(F.col("ord") % 3 == 0, F.nullif(F.col("model"), F.lit(""))).alias("update"),
    )
    carried = carry_forward(records, F.col("update"), F.lit("start"), "model")
    return carried.select(F.col("file_path").alias("session_id"), F.col("pos").alias("ord"), "model")
