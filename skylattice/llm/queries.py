"""The queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import chat, decontam, html, langid, merkle, mixing, pii, simhash, tokens, warc
from skylattice.llm.common import table


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle": op1_merkle,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_langid": op4_langid,
    "op5_decontam": op5_decontam,
    "op6_chat": op6_chat,
    "op7_tokens": op7_tokens,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

_CHAT_SQL = r"""
with recursive messages as (
  select row_number() over () as rid, conv_id, turn, role, text, regexp_split_to_array(coalesce(text, ''), '\r?\n') as ls from conversations),
places as (select rid, conv_id, turn, ls, unnest(range(1, len(ls) + 1)) as n from messages),
marked as (select rid, conv_id, turn, n, ls[n] as line, regexp_extract(ls[n], '^[\x20\t]{0,3}(?:>[\x20\t]?)+') as marks from places),
lines as (
  select *, lead(level, 1, 0) over w as next_level, lag(level) over w as last_level
  from (select rid, conv_id, turn, n, len(marks) - len(replace(marks, '>', '')) as level, substr(line, len(marks) + 1) as body from marked)
  window w as (partition by rid order by n)),
own as (
  select * from lines where level = 0
  and not (next_level > 0 and regexp_matches(body, '(?i)\bwrote:\s*$|\bschrieb.*:\s*$|\ba écrit\s*:\s*$|\bescribió:\s*$'))),
runs as (
  select *, sum(case when level is distinct from last_level then 1 else 0 end) over (partition by rid order by n) as run from lines),
passages as (
  select rid, conv_id, turn, run, level, string_agg(body, ' ' order by n) as whole, list(body order by n) as bodies
  from runs where level > 0 group by rid, conv_id, turn, run, level),
quoted as (
  select distinct rid, conv_id, turn, run, level, unit from (
    select rid, conv_id, turn, run, level, whole as raw, 1 as least from passages
    union all select rid, conv_id, turn, run, level, unnest(bodies), 12 from passages),
    lateral (select trim(lower(regexp_replace(raw, '\s+', ' ', 'g'))) as unit) where len(unit) >= least),
said as (
  select conv_id, unit, min(turn) as source from (
    select conv_id, turn, string_agg(body, ' ' order by n) as raw, 1 as least from own group by rid, conv_id, turn
    union all select conv_id, turn, body, 12 from own),
    lateral (select trim(lower(regexp_replace(raw, '\s+', ' ', 'g'))) as unit) where len(unit) >= least group by conv_id, unit),
met as (
  select rid, q.conv_id, turn, run, level, len(unit) as chars, source from quoted q join said s using (conv_id, unit) where source < turn),
scored as (select rid, conv_id, turn, level, source, sum(chars) as chars from met group by rid, conv_id, turn, level, source),
links as (
  select rid, conv_id, turn, arg_max(source, row(-level, chars, source)) as reply_to from scored group by rid, conv_id, turn),
replies as (select conv_id, turn, max(reply_to) as reply_to from links group by conv_id, turn),
walk as (
  select conv_id, turn, reply_to as thread, cast(1 as bigint) as depth from replies
  union all
  select w.conv_id, w.turn, r.reply_to, w.depth + 1 from walk w join replies r on r.conv_id = w.conv_id and r.turn = w.thread),
ends as (select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from walk group by conv_id, turn),
texts as (select rid, regexp_replace(string_agg(body, chr(10) order by n), '^\s+|\s+$', '', 'g') as own from own group by rid),
counts as (select rid, count(*) as n_quotes from passages group by rid),
linked as (select rid, count(distinct run) as n_linked from met group by rid)
select m.conv_id, case when l.rid is null then m.turn else e.thread end as thread, m.turn, case when l.rid is null then 0 else e.depth end as depth,
  m.role, l.reply_to, case when c.rid is null then m.text else coalesce(t.own, '') end as text, coalesce(c.n_quotes, 0) as n_quotes,
  coalesce(k.n_linked, 0) as n_linked
from messages m left join links l using (rid) left join ends e on e.conv_id = m.conv_id and e.turn = m.turn left join texts t using (rid)
left join counts c using (rid) left join linked k using (rid)"""

#: SQL can't express the others: XXH64, trees, profiles, byte pair encoding and keys drawn from hashes.
ORACLES: dict[str, str] = {
    "op6_chat": _CHAT_SQL,
    "op10_warc": """
select page_id, n as payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
    (cast('0x' || substr(x, cast(j // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (j % 4) as integer)) & 31 as bigint) + 1, 1)),
    'string_agg', '') as payload_digest,
  case when page_id = head then 'response' else 'revisit' end as record_type,
  case when page_id <> head then head end as refers_to
from (select page_id, cast(strlen(coalesce(html, '')) as bigint) as n, sha1(coalesce(html, '')) as x,
  max(page_id) over (partition by coalesce(html, '')) as head from pages)""",
}
