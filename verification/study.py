"""Checks of the comparison of two matchers."""

from __future__ import annotations

from pyspark.sql import functions as F

from assentlake import fixed
from assentlake.operators import similarity
from assentlake.session import staged
from verification.registry import query
from verification.relations import MESSAGES, Relations
from verification.sql import detection, text, trim

SPACES = r"[\s\p{Z}" + "﻿]+"


def clean(c: str) -> str:
    return trim(f"lower(regexp_replace(regexp_replace({c}, '```.*?```', ' ', 'gs'), {text(SPACES)}, ' ', 'g'))")


def grams(c: str) -> str:
    return (
        f"list_concat(list_transform(range(1, greatest(length({c}), 1)), lambda i: substring({c}, i, 2)), "
        f"list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substring({c}, i, 3)))"
    )


CHUNKS = f"""select msg_id, i - 1 as chunk_no, {trim("pieces[i]")} as chunk from (
    select *, unnest(range(1, len(pieces) + 1)) as i from (
      select msg_id, string_split_regex(regexp_replace(text, '```.*?```', ' ', 'gs'), '[。！？!?\\n]+') as pieces
      from ({MESSAGES}) m) p) p"""
# Numbered after the short and long pieces are gone, as the matcher numbers them.
KEPT = f"""select msg_id, row_number() over (partition by msg_id order by chunk_no) - 1 as chunk_no, chunk
  from ({CHUNKS}) c where length(chunk) between 2 and 40"""
REFS = ", ".join(f"({n}, {text(p)})" for n, p in enumerate(fixed.REFERENCE_PHRASES))


def tf(rows: str, keys: str, c: str) -> str:
    return f"""select {keys}, gram, count(*) as tf from (
      select {keys}, unnest({grams('cleaned')}) as gram from (select *, {clean(c)} as cleaned from ({rows}) t0) t1) t2
      group by {keys}, gram"""


def reference(rows: str) -> str:
    return f"""
ref as materialized ({rows}),
ref_tf as (select *, count(*) over (partition by gram) as df from ({tf('select * from ref', 'ref_no, phrase', 'phrase')}) f),
ref_w as (select *, ln(((select count(*) from ref) + 1.0) / (df + 1.0)) + 1.0 as idf,
    (1.0 + ln(tf)) * (ln(((select count(*) from ref) + 1.0) / (df + 1.0)) + 1.0) as weight from ref_tf),
ref_v as materialized (select *, sqrt(sum(weight * weight) over (partition by ref_no)) as norm from ref_w)
"""


SCORED = f"""
chunk_tf as materialized ({tf(KEPT, 'msg_id, chunk_no', 'chunk')}),
chunk_w as (select c.*, (1.0 + ln(tf)) * coalesce(idf, ln((select count(*) from ref) + 1.0) + 1.0) as w
  from chunk_tf c left join (select distinct gram, idf from ref_v) i using (gram)),
chunk_n as (select msg_id, chunk_no, sqrt(sum(w * w)) as cnorm from chunk_w group by 1, 2),
dots as (select msg_id, chunk_no, ref_no, phrase, norm, sum(w * weight) as dot
  from chunk_w join ref_v using (gram) group by 1, 2, 3, 4, 5),
sims as (select msg_id, chunk_no, ref_no, phrase, round(dot / (cnorm * norm), 9) as score from dots join chunk_n using (msg_id, chunk_no)),
best as (select msg_id, phrase, score from (select *, row_number() over (partition by msg_id
  order by score desc, chunk_no, ref_no) as n from sims) b where n = 1)
"""
REFERENCE = reference(f"select * from (values {REFS}) r(ref_no, phrase)")
D = detection()
COMPARED = (
    D + "," + REFERENCE + "," + SCORED
    + """, compared as (select msg_id, n_hits, coalesce(best.score, 0.0) as score, coalesce(best.phrase, '') as phrase
           from counted left join best using (msg_id))
"""
)


@query(
    "sample_messages",
    f"select msg_id, harness from ({MESSAGES}) m where harness in ('claude', 'omp', 'pi') order by msg_id limit 40",
)
def _(r: Relations):
    return similarity.sample_messages(r.messages, ["claude", "omp", "pi"], 40).select("msg_id", "harness")


@query("sentence_chunks", f"select msg_id, chunk_no, chunk from ({KEPT}) c")
def _(r: Relations):
    return similarity.sentence_chunks(r.messages)


@query(
    "char_ngrams",
    f"""select gram, count(*) as chunks, cast(sum(tf) as bigint) as total from ({tf(KEPT, 'msg_id, chunk_no', 'chunk')}) t
        group by 1""",
)
def _(r: Relations):
    chunks = similarity.sentence_chunks(r.messages)
    rows = similarity.char_ngrams(chunks, ["msg_id", "chunk_no"], "chunk")
    return rows.groupBy("gram").agg(F.count("*").alias("chunks"), F.sum("tf").alias("total"))


_PHRASES = "select p_partkey as ref_no, concat(p_name, ' ', lower(p_type), ' ', p_brand) as phrase from part"


@query(
    "tfidf_reference",
    f"with {reference(_PHRASES)} select ref_no, gram, tf, df, round(weight, 6) as weight, round(norm, 6) as norm from ref_v",
)
def _(r: Relations):
    weights = similarity.tfidf_reference(r.sql(_PHRASES))
    return weights.select(
        "ref_no", "gram", "tf", "df", F.round("weight", 6).alias("weight"), F.round("norm", 6).alias("norm")
    )


def _compared(r: Relations):
    return similarity.compare_matchers(r.messages, r.matcher, similarity.References.of(r.spark))


def _staged(r: Relations):
    """For a query that looks at the comparison twice."""
    return staged(_compared(r), "compared")


@query("cosine_best", COMPARED + "select msg_id, phrase, round(score, 6) as score from compared")
def _(r: Relations):
    best = similarity.cosine_best(r.messages.select("msg_id", "text"), similarity.References.of(r.spark))
    return best.select("msg_id", "phrase", F.round("score", 6).alias("score"))


@query(
    "matcher_sweep",
    COMPARED
    + """, swept as (select threshold, count(*) filter (n_hits > 0) as regex_hits,
           count(*) filter (score >= threshold) as cosine_hits,
           count(*) filter (score >= threshold and n_hits > 0) as agree,
           count(*) filter (score < threshold and n_hits > 0) as missed,
           count(*) filter (score >= threshold and n_hits = 0) as cosine_only
         from compared, (values (0.15::double), (0.25), (0.35), (0.5), (0.7)) t(threshold) group by 1)
      select *, case when cosine_hits > 0 then round(agree / cosine_hits, 4) else 0.0 end as precision,
        case when regex_hits > 0 then round(agree / regex_hits, 4) else 0.0 end as recall from swept""",
)
def _(r: Relations):
    return similarity.matcher_sweep(_compared(r))


@query(
    "matcher_disagreements",
    COMPARED
    + f""", phrased as (select msg_id, string_agg(phrase, '|' order by rank, start) as phrases from hits group by msg_id),
         shown as (select c.msg_id, n_hits, round(score, 6) as score, c.phrase, coalesce(phrases, '') as phrases,
             regexp_replace(text, {text(SPACES)}, ' ', 'g') as body
           from compared c left join phrased p on p.msg_id = c.msg_id join mf on mf.msg_id = c.msg_id)
         select * exclude (body), left(body, {fixed.EXCERPT_COSINE}) as excerpt from (select 'cosine_only' as side, * from shown
           where score >= 0.35 and n_hits = 0 order by score desc, msg_id limit 12)
         union all
         select * exclude (body), left(body, {fixed.EXCERPT_LEXICON}) from (select 'dropped' as side, * from shown
           where score < 0.35 and n_hits > 0 order by msg_id limit 12)""",
)
def _(r: Relations):
    rows = similarity.matcher_disagreements(_staged(r), threshold=0.35)
    return rows.withColumn("score", F.round("score", 6)).withColumn("phrases", F.array_join("phrases", "|"))
