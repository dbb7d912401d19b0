"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .chat import TEMPLATE
from .mixing import WEIGHTS

_BLANK = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

NEAR = rf"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) end as s
  from words),
held as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from held a join held b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, p.b from reach r join pairs p on p.a = r.b),
named as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join named using (doc_id)
"""

_KEY = "-ln(((('0x' || substr(md5('mix/' || doc_id), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0) / w"
MIX = rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size, coalesce(pow(4.0, q - 0.5), 1.0) as w
  from documents left join (select doc_id, avg(quality) as q from labels where quality is not null group by doc_id) using (doc_id)),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] as weight, 2.0 * source_size as cap from sources),
levels as (
  select *, row_number() over (order by cap / weight, source nulls last) as nth, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over ahead, 0.0)) / (sum(weight) over () - coalesce(sum(weight) over ahead, 0)) as level
  from ranked window ahead as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
goals as (
  select *, case when level * weight >= cap then cap else weight * min_by(level, nth) filter (where level * weight < cap) over () end as target
  from levels),
parts as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from goals),
drawn as (select *, sum(size) over (partition by source order by {_KEY}, doc_id, size rows unbounded preceding) as upto from sized)
select doc_id, size, source_size, target, size * (epochs + (2 * upto - size <= 2 * (target - epochs * source_size) and size > 0)::bigint) as taken, d.source
from drawn d join parts p on d.source is not distinct from p.source
"""

SHARDS = """
with crc_table as (
  select list(list_reduce(list_prepend(n, range(8)), lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by n) as t from range(256) r(n)),
sized as (
  select doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)),
      lambda c, b: xor(c // 256, t[1 + (xor(c, b) % 256)]))) as text_crc32
  from documents, crc_table),
summed as (select *, sum(size) over (order by doc_id, text_crc32 rows unbounded preceding) as upto, sum(size) over () as total from sized),
placed as (select *, least(15, (2 * upto - size) * 16 // (2 * total))::int as shard from summed)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by doc_id, text_crc32) - 1)::bigint as slot, null::int as grown_shard from placed
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for k, mark in enumerate(TEMPLATE.controls):
        out = f"replace({out}, {_quoted(mark)}, '\\{k};')"
    return out


def _chat() -> str:
    around = " ".join(f"when {_quoted(name)} then {len(t.opener) + len(t.closer)}" for name, t in TEMPLATE.roles.items())
    other = len(TEMPLATE.other.opener) + len(TEMPLATE.other_name_end) + len(TEMPLATE.other.closer)
    follows = " ".join(f"when {_quoted(name)} then before in ({', '.join(map(_quoted, t.follows))})" for name, t in TEMPLATE.roles.items())
    loss = ", ".join(_quoted(name) for name, t in TEMPLATE.roles.items() if t.loss)
    final = ", ".join(map(_quoted, TEMPLATE.final))
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, row_number() over o - 1 as i, coalesce(lag(role) over o, 'START') as before, count(*) over (partition by conv_id) as n
  from turns window o as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role in ({loss})), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (where role in ({loss})), '')) as loss_sha256,
  sum(length({_escaped('text')}) + case role {around} else {other} + length({_escaped('role')}) end)::bigint as formatted_chars,
  bool_and(case role {follows} else false end) and bool_or(i = n - 1 and role in ({final})) as valid,
  min(i) filter (where not (case role {follows} else false end)) as broken_at
from placed group by conv_id
"""


_INTEGERS = "list_transform(embedding, lambda x: floor(256 * x::double)::bigint)"
_WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _codes() -> str:
    """Three assignments with two updates between them, each spelled out."""
    def assigned(n: int) -> str:
        away = " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, 5))
        return f"""near{n} as (select vec_id, p, min({away}) as d, arg_min(e, ({away}) * 64 + e) as e from parts a join book{n} b using (p) group by vec_id, p)"""

    def moved(n: int) -> str:
        mean = ", ".join(f"((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*))::bigint" for i in range(1, 5))
        return f"""means{n} as (select p, e, [{mean}] as v from parts join near{n} using (vec_id, p) group by p, e),
book{n + 1} as (select p, e, coalesce(m.v, b.v) as v from book{n} b left join means{n} m using (p, e))"""

    return f"""
with kept as (select vec_id, label, {_INTEGERS} as q from embeddings where {_WHOLE}),
parts as (select vec_id, p, q[4 * p + 1:4 * p + 4] as v from kept, range(16) r(p)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64),
book0 as (select p, e, v from parts join first using (vec_id)),
{assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near2 group by vec_id),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as digest from book2)
select vec_id, code, error, label, sum(error) over (partition by label)::bigint as label_error, digest as codebooks_sha256 from coded join kept using (vec_id), books
"""


NEGATIVES = f"""
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_INTEGERS} as q
  from embeddings where label is not null and {_WHOLE}),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q::double[], b.q::double[])::bigint as score
  from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over o)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
window o as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over o <= 5
"""

SQL = {"op4_near_dedup": NEAR, "op5_mixing": MIX, "op6_sharding": SHARDS, "op8_chat_format": _chat(), "op11_vector_codes": _codes(), "op12_hard_negatives": NEGATIVES}
