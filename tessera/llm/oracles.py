"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

PASSAGES = r"""
with words as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as w from documents
), windows as (
  select doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) as m
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from words where len(w) >= 50)
), firsts as (
  select m, min(doc_id) as first from windows group by m
), gone as (
  select distinct doc_id, unnest(range(s, s + 50)) as i from windows join firsts using (m) where doc_id > first
), kept as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by i) as t
  from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from words) as e
  where not exists (select 1 from gone where gone.doc_id = e.doc_id and gone.i = e.i)
  group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (doc_id)
"""

NEGATIVES = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from rows as a join rows as r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives as p join scored as s on s.anchor_id = p.anchor_id and not s.same
 and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 3
"""


#: CRC-32 of the document's number as text, bit by bit.
CRC = """4294967295 - list_reduce(
    [4294967295::bigint] || [ascii(x)::bigint for x in string_split(doc_id::varchar, '')],
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, i: xor(d >> 1, (d & 1) * 3988292384)))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


def _siblings(nodes: str, key: str) -> str:
    """Of every node below the last level: digests of its run to the left and to the right."""
    span = f"string_agg(h, '') over (partition by {key}level, pos // 3 order by pos rows between "
    return (
        f"select {key}level, pos, coalesce({span}unbounded preceding and 1 preceding), '') as l, coalesce({span}1 following and unbounded following), '') as r"
        f" from {nodes} qualify count(*) over (partition by {key}level) > 1"
    )


MERKLE = f"""
with recursive leaves as (
  select doc_id, source, {_leaf("text")} as leaf,
         case when ({CRC}) % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as now,
         row_number() over (partition by source order by doc_id) - 1 as pos
  from documents
), low(source, level, pos, h) as (
  select source, 0, pos, leaf from leaves
  union all
  select source, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by source) as n from low)
  where n > 1 group by source, level, pos // 3
), subroots as (
  select source, arg_max(h, level) as h, max(level) as top, row_number() over (order by source nulls first) - 1 as pos from low group by source
), high(level, pos, h) as (
  select 0, pos, h from subroots
  union all
  select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as n from high)
  where n > 1 group by level, pos // 3
), below as ({_siblings("low", "source, ")}
), above as ({_siblings("high", "")}
), climb(doc_id, source, level, pos, now, proof) as (
  select doc_id, source, 0, pos, now, '' from leaves
  union all
  select doc_id, c.source, c.level + 1, c.pos // 3, sha256(l || now || r), proof || l || r
  from climb as c join below as b on c.source is not distinct from b.source and c.level = b.level and c.pos = b.pos
), reach(doc_id, level, pos, now, proof) as (
  select doc_id, 0, s.pos, now, proof from climb as c join subroots as s on c.source is not distinct from s.source and c.level = s.top
  union all
  select doc_id, c.level + 1, c.pos // 3, sha256(l || now || r), proof || l || r from reach as c join above as a on c.level = a.level and c.pos = a.pos
), ends as (
  select doc_id, now as folded_root, sha256(proof) as proof_sha256 from reach where level = (select max(level) from high)
)
select doc_id, leaf, s.h as subroot, (select arg_max(h, level) from high) as root, proof_sha256, folded_root,
       folded_root = (select arg_max(h, level) from high) as verified
from leaves join ends using (doc_id) join subroots as s on leaves.source is not distinct from s.source
"""

ORACLES = {"op11_passages": PASSAGES, "op12_hard_negatives": NEGATIVES, "op13_merkle": MERKLE}
