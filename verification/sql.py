"""SQL pieces for the comparison engine."""

from __future__ import annotations

from functools import cache

from assentlake import fixed
from assentlake.functions.text import WHITESPACE
from assentlake.sources.lexicon import SHIPPED
from verification.relations import MESSAGES, RUN_TS, THREAD, THREADS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(expression: str) -> str:
    return f"trim({expression}, {text(WHITESPACE)})"


def norm_model(c: str) -> str:
    prefixes = "|".join(fixed.ROUTING_PREFIXES)
    m = f"list_last(string_split(lower({trim(c)}), '/'))"
    m = f"regexp_replace({m}, '^({prefixes})-', '')"
    m = f"regexp_replace({m}, ':free$', '')"
    m = f"regexp_replace({m}, '\\[\\d+[mk]?\\]', '')"
    m = f"regexp_replace({m}, '[-_@](202[4-9]\\d{{4}}|202[4-9]-\\d{{2}}-\\d{{2}})$', '')"
    m = f"regexp_replace({m}, '^claude-3\\.([57])-', 'claude-3-\\1-')"
    return f"case when coalesce({c}, '') = '' then 'unknown-model' else {trim(m)} end"


def rate(hits: str, messages: str, factor: int) -> str:
    return (
        f"case when {messages} > 0 then cast(({hits} * {200 * factor} + {messages}) // ({messages} * 2) as double)"
        f" / 100.0 else 0.0 end"
    )


def level(mdi: str) -> str:
    whens = " ".join(f"when {mdi} <= {bound} then {number}" for bound, number, *_ in fixed.LEVELS[:-1])
    return f"case {whens} else {fixed.LEVELS[-1][1]} end"


def score(hits: str, messages: str, prior: str) -> str:
    return f"({hits} + {fixed.PRIOR_MASS} * {prior}) / ({messages} + {fixed.PRIOR_MASS}) * 1000.0"


@cache
def lexicon_values() -> list[tuple[int, str, str, str, bool]]:
    """The shipped entries for the other engine, whose \\b is an ASCII boundary already."""
    import re

    entries = []
    for line in SHIPPED.read_text(encoding="utf-8").split("\n"):
        if line.strip() and not line.startswith("#"):
            phrase, category = line.strip().rsplit("|", 1)
            is_regex = phrase.startswith("regex:")
            entries.append((phrase.removeprefix("regex:"), category, is_regex))
    entries.sort(key=lambda e: -len(e[0]))
    rows = []
    for rank, (phrase, category, is_regex) in enumerate(entries, start=1):
        pattern = phrase if is_regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", phrase)
        if not is_regex and phrase[0].isascii() and phrase[0].isalpha():
            pattern = rf"\b{pattern}\b"
        rows.append((rank, phrase, category, "(?i)" + pattern, any(m in phrase for m in "[.?")))
    return rows


@cache
def detection() -> str:
    """CTEs mf (messages), tried, lex, cand (all matches), kept and hits."""
    values = ",\n".join(
        f"({r}, {text(p)}, {text(c)}, {text(x)}, {s})" for r, p, c, x, s in lexicon_values()
    )
    any_of = "|".join("(" + x.removeprefix("(?i)") + ")" for _, _, _, x, _ in lexicon_values())
    before, after = fixed.SNIPPET_BEFORE, fixed.SNIPPET_AFTER
    return f"""
with mf as materialized (select *, {norm_model('model')} as norm_model from ({MESSAGES}) m0),
lex(rank, lex_phrase, category, pattern, shows) as (values {values}),
tried as materialized (
  select * from (select *, regexp_replace(text, '```.*?```', ' ', 'gs') as t from mf) m1
  where length(text) >= 3 and length({trim('t')}) >= 3 and regexp_matches(t, {text('(?i)' + any_of)})),
pairs as (
  select *, regexp_extract_all(t, pattern) as ms, string_split_regex(t, pattern) as ps
  from tried join lex on regexp_matches(t, pattern)),
nth as (select *, unnest(range(1, len(ms) + 1)) as i from pairs),
cand as materialized (
  select * exclude (ms, ps, i),
    cast(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as int) as start,
    cast(length(ms[i]) as int) as length,
    case when shows then ms[i] else lex_phrase end as phrase
  from nth),
kept as (
  select msg_id, unnest(list_reduce(
    list_transform(list({{'r': rank, 's': start, 'l': length}} order by rank, start), lambda c: [c]),
    lambda acc, y: case when len(list_filter(acc, lambda a:
        greatest(a.s, y[1].s) < least(a.s + a.l, y[1].s + y[1].l))) > 0
      then acc else list_concat(acc, y) end)) as k
  from cand group by msg_id),
hits as materialized (
  select cand.*,
    case when start > {before} then '...' else '' end
    || {trim(f"regexp_replace(substring(t, greatest(start - {before}, 0) + 1, least(start + cand.length + {after}, length(t)) - greatest(start - {before}, 0)), chr(13) || '?' || chr(10) || '+', ' ', 'g')")}
    || case when start + cand.length + {after} < length(t) then '...' else '' end as snippet
  from cand join kept on cand.msg_id = kept.msg_id and rank = k.r and start = k.s),
counted as (
  select mf.*, coalesce(n, 0) as n_hits from mf
  left join (select msg_id, count(*) as n from hits group by msg_id) per using (msg_id))
"""


# Log records: what the messages look like after a round through a log format.

STAMP = f"case when ord % 17 = 0 then TIMESTAMP '{RUN_TS}' when ord % 19 = 0 then null else ts end"


def note(t: str = "text") -> str:
    """Text of a content in one of the four shapes."""
    return trim(f"case when ord % 4 = 2 then concat('note ', {t}) else {t} end")


def model_or(default: str, c: str = "model") -> str:
    return f"case when {c} = '' then {text(default)} else {c} end"


def normalized(harness: str, session: str, ts: str, model: str, body: str, where: str = "true", source: str = MESSAGES) -> str:
    """Expected rows of one format, in the columns every format query returns."""
    return (
        f"select {text(harness)} as harness, {session} as session_id, {ts} as ts, {model} as model, "
        f"length({body}) as chars, md5({body}) as text_md5 from ({source}) m where {where}"
    )


def running(update: str, key: str = "session_id") -> str:
    return (
        f"last_value({update} ignore nulls) over (partition by {key} order by ord "
        "rows between unbounded preceding and current row)"
    )


CODEX = f"""
select *, coalesce({running("upd", "thread")}, thread_model, 'codex-unknown') as codex_model
from (select m.*, {THREAD} as thread, th.model as thread_model,
        case when ord % 6 = 0 then coalesce(case when ord % 12 = 0 then nullif(m.model, '') end, th.model)
             when ord % 3 = 0 then nullif(m.model, '') end as upd
      from ({MESSAGES}) m left join ({THREADS}) th on th.id = {THREAD}) c
"""


def session_model(default: str) -> str:
    update = "case when ord % 3 = 0 then nullif(model, '') end"
    return (
        f"select *, case when ord % 10 = 0 then 'own-model' else coalesce({running(update)}, {text(default)}) end "
        f"as run_model from ({MESSAGES}) m"
    )
