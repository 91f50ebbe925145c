"""Relations derived from the given tables. The SQL texts run in both engines."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assentlake.operators import metrics
from assentlake.session import staged
from assentlake.sources.lexicon import Matcher

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

RUN_TS = "2024-06-01 12:00:00"

# Replies and documents as messages, with phrases and untidy model names worked in.
MESSAGES = """
select concat('c', cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as msg_id,
  case conv_id % 10 when 0 then 'claude' when 1 then 'codex' when 2 then 'omp' when 3 then 'pi'
    when 4 then 'codebuddy' when 5 then 'cline' when 6 then 'openclaw' when 7 then 'hermes'
    when 8 then 'cursor' else 'opencode' end as harness,
  concat('s', cast(conv_id as varchar(20))) as session_id,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * cast((conv_id * 37 + turn * 11) % 720 as int) as ts,
  case (conv_id * 7 + turn) % 6 when 0 then 'vendor-a/Model-X-20250219' when 1 then 'model-x'
    when 2 then 'claude-3.5-alpha' when 3 then 'openrouter-beta:free' when 4 then 'beta[128k]' else '' end as model,
  concat(text, case (conv_id * 5 + turn * 3) % 9 when 0 then ' You''re right, I missed it.'
    when 1 then ' 你说得对，我就改。' when 2 then ' ```你说得对```'
    when 3 then ' 抱歉，是我疏忽了。确实，你说得对'
    when 4 then ' as you suggested, I''ll fix you''re right正如你所说' else '' end) as text,
  cast(turn as bigint) as ord
from conversations where role = 'assistant'
union all
select concat('d', cast(doc_id as varchar(20))), 'other', source,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * cast(doc_id % 720 as int),
  concat('corpus/', lang, '-2024-08-06'),
  concat(text, case doc_id % 50 when 0 then ' fair point' when 1 then ' 听你的，我' else '' end),
  cast(doc_id as bigint)
from documents
"""

SUBMISSIONS = """
select o_orderkey as submission_id, o_custkey as user_id, o_orderdate as created_at from orders
"""

SUBMISSION_MODELS = """
select l_orderkey as submission_id, o_custkey as user_id, p_brand as model,
  cast(sum(cast(l_quantity as bigint) % 7) as bigint) as hits,
  cast(sum(cast(floor(l_extendedprice / 100) as bigint)) as bigint) as messages,
  floor(cast(sum(cast(l_quantity as bigint) % 7) as double) * 1000
    / cast(sum(cast(floor(l_extendedprice / 100) as bigint)) as double) * 1000 + 0.5) / 1000 as mdi,
  min(o_orderdate) as created_at
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
group by l_orderkey, o_custkey, p_brand
"""

SUBMISSION_HARNESSES = SUBMISSION_MODELS.replace("p_brand", "p_type").replace("as model", "as harness")

SUBMISSION_TOTALS = f"""
select submission_id, user_id, created_at, cast(sum(hits) as bigint) as hits,
  cast(sum(messages) as bigint) as messages, cast(count(*) as bigint) as model_count
from ({SUBMISSION_MODELS}) sm group by submission_id, user_id, created_at
"""

ENTRIES = f"""
select user_id, c_name as login, concat('Member ', cast(user_id as varchar(20))) as display_name,
  concat('https://example.org/', c_mktsegment, '/', cast(user_id as varchar(20)), '.png') as avatar_url, hits, messages,
  case when messages > 0 then floor(cast(hits as double) * 1000 / messages * 1000 + 0.5) / 1000 else 0.0 end as mdi,
  model_count, created_at as updated_at
from (select st.*, row_number() over (partition by user_id order by created_at desc, submission_id desc) as n
      from ({SUBMISSION_TOTALS}) st) latest_totals
join customer on c_custkey = user_id where n = 1
"""

# A session as the id of a thread, and the lookup table that knows some of the threads.
THREAD = (
    "concat(substr(md5(session_id), 1, 8), '-', substr(md5(session_id), 9, 4), '-', "
    "substr(md5(session_id), 13, 4), '-', substr(md5(session_id), 17, 4), '-', substr(md5(session_id), 21, 12))"
)
THREADS = f"""
select distinct {THREAD} as id, concat('thread-', substr(md5(session_id), 1, 4)) as model
from ({MESSAGES}) mf where substr(md5(session_id), 1, 1) < '8'
"""


class Relations:
    """The derived relations of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._registered: set[str] = set()

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the given tables; only the tables it names are opened."""
        for table in TABLES:
            if table not in self._registered and re.search(rf"\b{table}\b", text):
                self.spark.read.parquet(f"{self.folder}/{table}.parquet").createOrReplaceTempView(table)
                self._registered.add(table)
        return self.spark.sql(text)

    @property
    def run_ts(self) -> Column:
        return F.lit(RUN_TS).cast("timestamp")

    @cached_property
    def messages(self) -> DataFrame:
        return self.sql(MESSAGES)

    @cached_property
    def matcher(self) -> Matcher:
        return Matcher.shipped(self.spark)

    @cached_property
    def counted(self) -> DataFrame:
        return metrics.count_hits(self.messages, self.matcher)

    @cached_property
    def hits(self) -> DataFrame:
        return metrics.find_hits(self.messages, self.matcher)

    @cached_property
    def found(self) -> DataFrame:
        """The hits, detected once, for queries that read them several times."""
        return staged(self.hits, "hits")

    @cached_property
    def submissions(self) -> DataFrame:
        return self.sql(SUBMISSIONS)

    @cached_property
    def models(self) -> DataFrame:
        return self.sql(SUBMISSION_MODELS)

    @cached_property
    def harness_rows(self) -> DataFrame:
        return self.sql(SUBMISSION_HARNESSES)

    @cached_property
    def entries(self) -> DataFrame:
        return self.sql(ENTRIES)

    @cached_property
    def threads(self) -> DataFrame:
        return self.sql(THREADS)

    # Raw log records, built from the messages in the shape each agent writes.

    @cached_property
    def shaped(self) -> DataFrame:
        def quoted(c: Column) -> Column:
            packed = F.to_json(F.struct(c.alias("x")))
            return packed.substr(F.lit(6), F.length(packed) - 6)

        iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        stamp = (
            F.when(F.col("ord") % 17 == 0, F.lit("null"))
            .when(F.col("ord") % 19 == 0, F.lit('"no date"'))
            .when(F.col("ord") % 2 == 0, F.concat(F.lit('"'), iso, F.lit('"')))
            .otherwise(F.unix_millis("ts").cast("string"))
        )
        return (
            self.messages.withColumn("q_text", quoted(F.col("text")))
            .withColumn("q_model", quoted(F.col("model")))
            .withColumn("stamp", stamp)
            .withColumn("thread", F.expr(THREAD))
        )

    def content(self, block: str = "text") -> Column:
        """Message content in one of four shapes, as JSON text."""
        text_block = F.format_string('{"type":"' + block + '","text":%s}', "q_text")
        return (
            F.when(F.col("ord") % 4 == 0, F.col("q_text"))
            .when(F.col("ord") % 4 == 1, F.format_string("[%s]", text_block))
            .when(F.col("ord") % 4 == 2, F.format_string('["note",%s]', text_block))
            .otherwise(F.format_string('[{"type":"thinking","text":"hidden"},%s]', text_block))
        )

    def lines(self, path: str, reply: Column, control: Column | None = None) -> DataFrame:
        """Raw lines (file_path, block_start, pos, value) with control, user and broken lines."""
        nothing = F.lit(None).cast("string")
        slots = F.array(
            nothing if control is None else control,
            F.when(F.col("ord") % 5 == 0, F.lit('{"type":"user","role":"user","content":"why"}')),
            F.when(F.col("ord") % 7 == 0, F.lit('{"type":"assistant","message":')),
            reply,
        )
        return (
            self.shaped.select(
                F.expr(path).alias("file_path"),
                (F.floor(F.col("ord") / 8) * 1000).cast("bigint").alias("block_start"),
                "ord",
                F.posexplode(slots).alias("slot", "value"),
            )
            .where(F.col("value").isNotNull())
            .select("file_path", "block_start", (F.col("ord") * 4 + F.col("slot")).alias("pos"), "value")
        )

    def claude_lines(self) -> DataFrame:
        model = F.when(F.col("ord") % 13 == 0, F.lit('"<synthetic>"')).otherwise(F.col("q_model"))
        reply = F.format_string(
            '{"type":"assistant","timestamp":%s,"message":{"role":"assistant","model":%s,"content":%s}}',
            "stamp", model, self.content(),
        )
        return self.lines("concat('/logs/claude/projects/', session_id, '.jsonl')", reply)

    def codex_lines(self) -> DataFrame:
        model = F.when(F.col("ord") % 12 == 0, F.col("q_model")).otherwise(F.lit("null"))
        meta = F.format_string(
            '{"type":"session_meta","payload":{"id":"%s","model":%s}}', "thread", model
        )
        context = F.when(
            F.col("ord") % 2 == 0,
            F.format_string('{"type":"turn_context","payload":{"model":%s}}', "q_model"),
        ).otherwise(
            F.format_string(
                '{"type":"turn_context","payload":{"collaboration_mode":{"settings":{"model":%s}}}}', "q_model"
            )
        )
        control = F.when(F.col("ord") % 6 == 0, meta).when(F.col("ord") % 3 == 0, context)
        reply = F.format_string(
            '{"type":"response_item","timestamp":%s,"payload":{"type":"message","role":"assistant","content":%s}}',
            "stamp", self.content("output_text"),
        )
        return self.lines(
            "concat('/logs/codex/sessions/rollout-', thread, '.jsonl')", reply, control
        )

    def session_lines(self, harness: str, key: str = "model") -> DataFrame:
        """Lines of the two formats with model_change records."""
        control = F.when(
            F.col("ord") % 3 == 0, F.format_string('{"type":"model_change","' + key + '":%s}', "q_model")
        )
        own = F.when(F.col("ord") % 10 == 0, F.lit('"own-model"')).otherwise(F.lit("null"))
        reply = F.format_string(
            '{"type":"message","message":{"role":"assistant","model":%s,"timestamp":%s,"content":%s}}',
            own, "stamp", self.content(),
        )
        return self.lines(f"concat('/logs/{harness}/sessions/', session_id, '.jsonl')", reply, control)

    def codebuddy_lines(self) -> DataFrame:
        reply = F.format_string(
            '{"role":"assistant","model":%s,"timestamp":%s,"content":%s}',
            "q_model", "stamp", self.content("output_text"),
        )
        where = "case when ord % 11 = 0 then 'drafts' else 'projects' end"
        return self.lines(f"concat('/logs/codebuddy/', {where}, '/', session_id, '.jsonl')", reply)

    def openclaw_lines(self) -> DataFrame:
        key = F.when(F.col("ord") % 2 == 0, F.lit("content")).otherwise(F.lit("text"))
        reply = F.format_string(
            '{"role":"assistant","model":%s,"timestamp":%s,"%s":%s}', "q_model", "stamp", key, "q_text"
        )
        return self.lines("concat('/logs/openclaw/', session_id, '.jsonl')", reply)

    def docs(self, path: str, value: Column) -> DataFrame:
        """Documents (file_path, value), every seventh one damaged."""
        broken = F.when(F.col("ord") % 7 == 3, F.lit('{"broken":')).otherwise(value)
        return self.shaped.select(F.expr(path).alias("file_path"), broken.alias("value"))

    def cline_docs(self) -> DataFrame:
        value = F.format_string(
            '[{"role":"assistant","ts":%s,"model":%s,"content":%s},{"role":"user","content":"why"},'
            '{"type":"say","say":"text","ts":%s,"text":%s}]',
            "stamp", "q_model", self.content(), "stamp", "q_text",
        )
        return self.docs("concat('/logs/cline/tasks/', session_id, '/api_conversation_history.json')", value)

    def hermes_docs(self) -> DataFrame:
        value = F.format_string(
            '{"session_id":"%s","model":%s,"last_updated":%s,"messages":[{"role":"user","content":"why"},'
            '{"role":"assistant","content":%s}],"timestamp":%s,'
            '"response":{"model":"answering","choices":[{"message":{"role":"assistant","content":%s}}]}}',
            "session_id", "q_model", "stamp", self.content(), "stamp", "q_text",
        )
        return self.docs("concat('/logs/hermes/sessions/', msg_id, '.json')", value)

    def openclaw_docs(self) -> DataFrame:
        item = F.format_string(
            '{"role":"assistant","model":%s,"timestamp":%s,"content":%s}', "q_model", "stamp", "q_text"
        )
        value = (
            F.when(F.col("ord") % 3 == 0, F.format_string("[%s]", item))
            .when(F.col("ord") % 3 == 1, F.format_string('{"model":"of-file","messages":[%s]}', item))
            .otherwise(F.format_string('{"history":[%s]}', item))
        )
        return self.docs("concat('/logs/openclaw/', session_id, '.json')", value)

    def workflow_docs(self) -> DataFrame:
        value = F.format_string(
            '{"runId":%s,"journal":[{"result":%s},{"result":5},{"result":""}]}',
            F.when(F.col("ord") % 2 == 0, F.concat(F.lit('"'), "session_id", F.lit('"'))).otherwise(F.lit("null")),
            "q_text",
        )
        return self.docs("concat('/logs/pi/workflows/', msg_id, '.json')", value)

    def cursor_rows(self) -> DataFrame:
        talk = F.format_string(
            '{"selectedModel":%s,"bubbles":[{"type":"user","text":"why"},{"type":"ai","%s":%s,"timestamp":%s}]}',
            "q_model",
            F.when(F.col("ord") % 2 == 0, F.lit("text")).otherwise(F.lit("rawText")),
            "q_text",
            "stamp",
        )
        value = (
            F.when(F.col("ord") % 4 == 0, F.format_string("[%s]", talk))
            .when(F.col("ord") % 4 == 1, F.format_string('{"tabs":[%s]}', talk))
            .when(F.col("ord") % 4 == 2, F.format_string('{"allComposers":[%s]}', talk))
            .otherwise(F.format_string('{"conversations":[%s]}', talk))
        )
        key = F.when(F.col("ord") % 9 == 0, F.lit("theme")).when(
            F.col("ord") % 2 == 0, F.lit("workbench.chat.data")
        ).otherwise(F.lit("composer.state"))
        return self.shaped.select(
            F.expr("concat('/ws/', session_id, '/state.vscdb')").alias("file_path"),
            key.alias("key"),
            value.alias("value"),
        )

    def opencode_tables(self) -> tuple[DataFrame, DataFrame]:
        path = F.lit("/logs/opencode.db").alias("file_path")
        role = F.when(F.col("ord") % 9 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        message = self.shaped.select(
            path,
            F.col("msg_id").alias("id"),
            "session_id",
            F.when(F.col("ord") % 17 == 0, F.lit(0)).otherwise(F.unix_millis("ts")).cast("string").alias("time_created"),
            F.format_string('{"role":"%s","model":%s}', role, "q_model").alias("data"),
        )
        text = F.when(
            F.col("ord") % 2 == 0, F.format_string('{"type":"text","text":%s}', "q_text")
        ).otherwise(F.format_string('{"type":"step","content":%s}', "q_text"))
        part = self.shaped.select(
            path,
            F.col("msg_id").alias("message_id"),
            F.explode(F.array(text, F.lit('{"type":"tool","name":"x"}'))).alias("data"),
        )
        return message, part

    @cached_property
    def raw_payloads(self) -> DataFrame:
        """Submitted documents, most of them untidy in one way or another."""
        variant = F.col("submission_id") % 11
        name = F.when((variant == 2) & (F.col("hits") % 5 == 0), F.lit("   ")).otherwise(F.col("model"))
        entry = F.struct(
            name.alias("model"),
            F.col("hits").alias("droolCount"),
            F.col("messages").alias("totalMessages"),
            (F.col("hits") * 1000.0 / F.col("messages")).alias("mdi"),
        )
        totals = self.models.groupBy("submission_id", "user_id", "created_at").agg(
            F.sum("hits").alias("hits"),
            F.sum("messages").alias("messages"),
            F.array_sort(F.collect_list(entry)).alias("entries"),
        )
        mdi = F.col("hits") * 1000.0 / F.col("messages")
        reported = F.when(variant == 3, mdi * 2.0).when(variant == 9, mdi * 1.005).when(variant != 7, mdi)
        number = F.when(variant == 1, F.lit("-5")).when(
            variant == 6, F.concat(F.lit('" '), F.col("hits").cast("string"), F.lit(' "'))
        ).otherwise(F.col("hits").cast("string"))
        version = F.when(variant == 10, F.concat(F.lit("  v"), F.repeat(F.lit("1"), 60))).otherwise(F.lit("0.1.7"))
        document = F.format_string(
            '{"version":"%s","droolCount":%s,"assistantMessages":%s%s,"sessionsScanned":3.9,'
            '"modelCount":99,"modelEntries":%s,"harnessEntries":null,"generatedAt":17}',
            version,
            number,
            F.col("messages").cast("string"),
            F.coalesce(F.concat(F.lit(',"mdi":'), reported.cast("string")), F.lit("")),
            F.to_json("entries"),
        )
        text = (
            F.when(variant == 4, F.lit('[{"droolCount":1}]'))
            .when(variant == 5, F.lit('{"droolCount":'))
            .when(variant == 8, F.lit("  "))
            .otherwise(document)
        )
        return totals.select("submission_id", "user_id", "created_at", text.alias("payload_json"))
