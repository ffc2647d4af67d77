"""SQL definitions of the dealt operators that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos
  from documents
), keyed as (select *, {_KEY} as key from lines),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
), judged as (
  select k.*, coalesce(k.doc_id <> c.keeper, false) as dropped from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""

_TAGGED = "coalesce(concat(strlen(({0})::varchar), ':', {0}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_TAGGED.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + "))"

#: Checksums are computed from their polynomial, trees level by level, proofs by walking up from every leaf.
MERKLE = f"""
with recursive crc as materialized (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps
),
sums as (
  select doc_id, source, lang, n_chars, text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)),
           lambda c, d: xor(steps[xor(c, d) % 256 + 1], c >> 8))) as sum
  from documents, crc
),
digests as (
  select doc_id, lang, {_LEAF.format(n_chars="n_chars")} as leaf,
         case when sum % 7 = 0 then {_LEAF.format(n_chars="(n_chars + 1)")} else {_LEAF.format(n_chars="n_chars")} end as shown
  from sums
),
leaves as materialized (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as size
  from digests
),
tree as (
  select lang, 0 as level, place, size, leaf as digest from leaves
  union all
  select lang, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' order by place)) from tree
  where size > 1 group by lang, level, place // 2, size
),
subroots as materialized (
  select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as top_place, count(*) over () as size from tree where size = 1
),
top as (
  select 0 as level, top_place as place, size, subroot as digest from subroots
  union all
  select level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' order by place)) from top
  where size > 1 group by level, place // 2, size
),
walk as (
  select lang, place as leaf_place, place, size, 0 as level, '' as proof, shown as folded from leaves
  union all
  select w.lang, leaf_place, w.place // 2, (w.size + 1) // 2, w.level + 1, concat(proof, s.digest),
         sha256(case when w.place % 2 = 1 then concat(s.digest, folded) else concat(folded, s.digest) end)
  from walk w left join tree s on s.lang is not distinct from w.lang and s.level = w.level and s.place = xor(w.place, 1)
  where w.size > 1
),
top_walk as (
  select w.lang, leaf_place, top_place as place, b.size, 0 as level, proof, folded
  from walk w join subroots b on b.lang is not distinct from w.lang where w.size = 1
  union all
  select w.lang, leaf_place, w.place // 2, (w.size + 1) // 2, w.level + 1, concat(proof, s.digest),
         sha256(case when w.place % 2 = 1 then concat(s.digest, folded) else concat(folded, s.digest) end)
  from top_walk w left join top s on s.level = w.level and s.place = xor(w.place, 1) where w.size > 1
)
select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = digest as verified
from leaves l join top_walk w on w.lang is not distinct from l.lang and w.leaf_place = l.place and w.size = 1
join subroots b on b.lang is not distinct from l.lang join top t on t.size = 1
"""

PHRASES = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as piece,
         list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') as words
  from (select lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
),
words as (select lang, piece, unnest(words) as w, generate_subscripts(words, 1) as i from pieces),
runs as (
  select lang, w as w1, lead(w) over here as w2, lead(w, 2) over here as w3 from words window here as (partition by lang, piece order by i)
),
counts as materialized (
  select lang, 1 as size, w1, null as w2, null as w3, w1 as phrase, count(*) as n from runs group by all
  union all
  select lang, 2, w1, w2, null, concat(w1, ' ', w2), count(*) from runs where w2 is not null group by all
  union all
  select lang, 3, w1, w2, w3, concat(w1, ' ', w2, ' ', w3), count(*) from runs where w3 is not null group by all
),
totals as (select lang, sum(n)::bigint as n from counts where size = 1 group by lang),
frequent as materialized (select * from counts where size > 1 and n >= 10),
cuts as (
  select lang, phrase, n as a, 1 as k, w1 as first, case when size = 2 then w2 else concat(w2, ' ', w3) end as rest from frequent
  union all
  select lang, phrase, n, 2, concat(w1, ' ', w2), w3 from frequent where size = 3
),
scored as (
  select c.lang, c.phrase, a, k, l.n as l, r.n as r, (1000000::hugeint * a * a // (l.n::hugeint * r.n))::bigint as score
  from cuts c join counts l on l.lang = c.lang and l.phrase = c.first join counts r on r.lang = c.lang and r.phrase = c.rest
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
free as (
  select * from lowest p where not exists (
    from frequent t where t.size = 3 and t.lang = p.lang and 100 * t.n >= 50 * p.a
      and p.phrase in (concat(t.w1, ' ', t.w2), concat(t.w2, ' ', t.w3)))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from free join totals using (lang) qualify rank <= 2000
"""

EXACT_SEARCH = """
with ints as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
)
select q.vec_id as query_id, row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id)::int as rank,
       c.vec_id, list_dot_product(q.v, c.v)::bigint as score
from ints q join ints c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0 qualify rank <= 5
"""


def mixing(alphas: dict[str, float], rate: float, rounds: int = 30) -> str:
    dims = list(alphas)
    listed = ", ".join(dims)
    step = "select * from raked"
    for dim, alpha in alphas.items():
        step = f"""
        select {listed}, tokens, round_, share_{dim} * weight / sum(weight) over (partition by {dim}) as weight
               {''.join(f", share_{d}" for d in dims)} from ({step})"""
    shares = ", ".join(
        f"(select sum(tokens) from cells c where c.{d} is not distinct from cells.{d}) ^ {a} as power_{d}" for d, a in alphas.items()
    )
    totals = ", ".join(
        f"power_{d} / (select sum(p) from (select any_value(power_{d}) as p from powers group by {d})) as share_{d}" for d in dims
    )
    same = " and ".join(f"d.{d} is not distinct from w.{d}" for d in dims)
    carried = "".join(f", share_{d}" for d in dims)
    return f"""
with recursive topics as (select vec_id, min(label) as topic from embeddings group by vec_id),
docs as (
  select doc_id, source, lang, topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n_tokens
  from documents left join topics on vec_id = doc_id
),
cells as (select {listed}, sum(n_tokens)::double as tokens from docs group by {listed} having sum(n_tokens) > 0),
powers as materialized (select *, {shares} from cells),
start as materialized (select *, {totals} from powers),
raked as (
  select {listed}, tokens, 0 as round_, tokens as weight{carried} from start
  union all
  select {listed}, tokens, round_ + 1, weight{carried} from ({step}) where round_ < {rounds}
),
wanted as (
  select {listed}, weight / tokens * {rate} * sum(tokens) over () / sum(weight) over () as expected
  from raked where round_ = {rounds}
),
drawn as (
  select d.*, coalesce(w.expected, 0) as expected,
         ('0x' || md5(doc_id::varchar)[1:8])::bigint / 4294967296.0::double as u
  from docs d left join wanted w on {same}
)
select doc_id, {listed}, n_tokens, round(expected, 4) as expected,
       (floor(expected) + case when u < expected - floor(expected) then 1 else 0 end)::bigint as copies
from drawn
"""
