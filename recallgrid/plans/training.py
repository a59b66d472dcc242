"""Queries of the core operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.changefeed import apply_changes
from ..sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return apply_changes(table(spark, d, "state_changes"), table(spark, d, "canonical_values"))


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": r"""
with recursive ops as (
  select distinct regexp_replace(lower(w), '[\s_\-]+', ' ', 'g') as op_key
  from (select unnest(list_append(coalesce(known_spellings, []), canonical)) as w
        from canonical_values where field_name = 'state_operation' and canonical = 'remove')),
src as (
  select chat_id, change_seq, coalesce(revision, -2147483648) as revision, subject,
    nullif(array_to_string(list_filter(list_transform(string_split(path, '.'), lambda x: trim(x)), lambda x: x <> ''), '.'), '') as path,
    regexp_replace(regexp_replace(lower(coalesce(operation, '')), '[\s_\-]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') as op_key, value
  from state_changes),
latest as (
  select * from src where change_seq is not null and subject is not null and path is not null
  qualify row_number() over (partition by chat_id, change_seq order by revision desc, subject desc, path desc, op_key desc, value desc nulls last) = 1),
marked as (
  select l.*, op_key in (select op_key from ops) as removal,
    coalesce(json_type(try_cast(value as json)) = 'OBJECT', false) as is_object from latest l),
flat as (
  select chat_id, subject, change_seq, path || '.' || k as path, value -> ('$."' || k || '"') as value
  from (select chat_id, subject, change_seq, path, value::json as value, unnest(json_keys(value::json)) as k
        from marked where is_object and not removal)
  union all
  select chat_id, subject, change_seq, path || '.' || k, value -> ('$."' || k || '"')
  from (select chat_id, subject, change_seq, path, value, unnest(json_keys(value)) as k from flat where json_type(value) = 'OBJECT')),
sets as (
  select chat_id, subject, change_seq, path, value from marked where not is_object and not removal
  union all
  select chat_id, subject, change_seq, path, value::varchar from flat where json_type(value) <> 'OBJECT'),
resets as (
  select chat_id, subject, path, max(change_seq) as seq from marked where is_object or removal group by all),
last as (
  select * from sets qualify row_number() over (partition by chat_id, subject, path order by change_seq desc) = 1)
select l.chat_id, l.subject, l.path, l.value from last l
where not exists (
  select 1 from resets r
  where r.chat_id = l.chat_id and r.subject = l.subject and r.seq > l.change_seq
    and (r.path = l.path or starts_with(l.path, r.path || '.')))
""",
}
