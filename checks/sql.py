"""Shared SQL fragments for the oracle: the derived views, in plain SQL."""

from __future__ import annotations

from promptsieve.sources.tables import CATEGORIES, SEEDS


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quote(i) if isinstance(i, str) else repr(i) for i in items) + "]"


def doubles(items) -> str:
    return "[" + ", ".join(f"cast({float(i)!r} as double)" for i in items) + "]"


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) as {name}"


def hashed(key: str, seed: int = 42) -> str:
    return f"cast('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 8) as bigint)"


TEXTS = "texts as (select doc_id as prompt_id, coalesce(text, '') as prompt_text from documents)"
LABELS = f"""labelled as (
  select d.doc_id as prompt_id, cast(coalesce(l.toxic, 0) as integer) as is_malicious,
         case when l.toxic = 1 then ({sql_list(CATEGORIES)})[d.doc_id % 3 + 1] else 'benign_control' end as attack_category
  from documents d left join labels l on l.doc_id = d.doc_id)"""
SEEDED = f"""seeded as (
  select doc_id as prompt_id, ({sql_list(SEEDS)})[doc_id % {len(SEEDS)} + 1] || coalesce(text, '') as prompt_text from documents)"""
VECTORS = """vecs as (
  select vec_id as prompt_id, embedding, label, cast(label < 6 as integer) as is_malicious, label % 4 as category from embeddings)"""
SCORES = f"""{LABELS},
scores as (select prompt_id, is_malicious, attack_category, (prompt_id * 7919 % 1000) / cast(1000 as double) as score from labelled)"""
FEEDBACK = """feedback as (
  select user_id as stream_id, event_id, ts, (event_id * 37 % 100) / cast(100 as double) as score,
         cast((event_id * 37 % 100) / cast(100 as double) >= cast(0.55 as double) as integer) as pred,
         cast(event_type = 'error' as integer) as label from events)"""
WORDS = r"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: x <> '')"


def words(column: str) -> str:
    return WORDS.format(t=column)
