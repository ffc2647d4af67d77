"""SQL that gives the results of the registered queries, for DuckDB.

The SQL is the plain definition of each operator: all pairs are compared one by one.
"""

from __future__ import annotations

import re

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = r"[\p{L}\p{N}_]"

VIEWS = {
    "facts": """
        select p_partkey % 4 as user_id, p_partkey as id, p_name as title,
               concat(p_type, ' ', p_name, ' ', p_brand) as text, p_type as category,
               timestamp '2024-01-01' + to_minutes(cast(p_partkey as int)) as ts,
               p_brand as brand, case when p_size >= 10 then p_size end as size,
               split_part(p_name, ' ', 2) as word2
        from part""",
    "vectors": """
        select user_id, id, category, cast(embedding as double[]) as v
        from facts join embeddings on vec_id = id""",
    "lines": """
        select l_orderkey, l_linenumber, min(l_partkey) as part, min(l_returnflag) as flag
        from lineitem group by all""",
    "edges": """
        select a.part % 4 as user_id, a.part as src, concat('BOUGHT_', a.flag) as rel, b.part as dst, count(*) as orders
        from lines a join lines b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber
        where a.part <> b.part and a.part % 4 = b.part % 4 group by all""",
    "queries": """
        select p_partkey as query_id, p_partkey % 4 as user_id, p_name as query, cast(embedding as double[]) as vec,
               case when p_size > 25 then p_type end as category
        from part join embeddings on vec_id = p_partkey""",
    "diary": """
        select doc_id % 4 as user_id, doc_id as id,
               date '2024-01-01' + cast((doc_id // 8) % 3650 as int) as date, text as content
        from documents""",
    "names": """
        select u as user_id, item_id * 4 + u as id, text from benchmark, unnest([0, 1, 2, 3]) as t(u)""",
    "mentions": """
        select distinct d.user_id, d.id as diary_id, n.id as fact_id
        from diary d join names n on d.user_id = n.user_id and contains(lower(d.content), lower(n.text))""",
    "turns": "select conv_id, turn, role as speaker, text from conversations",
    "changes": """
        select event_id as seq, ts, (event_id // 5) % 4 + case when value < 1 and event_type <> 'signup' then 4 else 0 end as user_id,
               case when event_type = 'signup' then 'add' when event_type = 'click' then 'link'
                    when event_type = 'error' and value >= 15 then 'delete' else 'update' end as op,
               case when event_type = 'signup' then -1 - event_id else event_id // 5 end as id,
               case when event_type = 'signup' then concat('new ', event_id) when event_type = 'purchase' then concat('title ', event_id) end as title,
               case when event_type = 'signup' then concat('signup of ', user_id) when event_type = 'view' then concat('seen ', event_id) end as text,
               case when event_type = 'signup' then 'General' when event_type = 'error' then 'People' end as category,
               case when event_type <> 'signup' then props ->> '$.k' end as k, event_type
        from events""",
    "mchanges": """
        select c.* replace (case when e.event_type = 'error' and e.value >= 8 and e.value < 15 then 'merge' else c.op end as op,
                            case when e.event_type = 'error' and e.value >= 8 and e.value < 15 then concat('merged ', c.seq) else c.title end as title)
        from changes c join events e on e.event_id = c.seq""",
    "born": "select user_id, id, min(seq) filter (op = 'delete') as deleted from (select user_id, id, null as seq, '' as op from facts union all select user_id, id, seq, op from mchanges) group by all",
    "masked": """
        select m.seq, m.user_id, m.id as master, m.id + 4 as dup, row_number() over (order by m.seq) as n,
               a.id is not null and b.id is not null and coalesce(x.deleted > m.seq, true) and coalesce(y.deleted > m.seq, true) as fine
        from mchanges m left join facts a on a.user_id = m.user_id and a.id = m.id left join facts b on b.user_id = m.user_id and b.id = m.id + 4
        left join born x on x.user_id = m.user_id and x.id = m.id left join born y on y.user_id = m.user_id and y.id = m.id + 4
        where m.op = 'merge'""",
    # One merge after another, with the list of those that are gone.
    "judged": """
        select cast(0 as bigint) as n, cast([] as bigint[]) as gone, cast(null as bigint) as seq, cast(null as bigint) as user_id,
               cast(null as bigint) as master, cast(null as bigint) as dup, false as done
        union all
        select m.n, case when m.fine and not list_contains(gone, m.master) and not list_contains(gone, m.dup) then list_append(gone, m.dup) else gone end,
               m.seq, m.user_id, m.master, m.dup, m.fine and not list_contains(gone, m.master) and not list_contains(gone, m.dup)
        from judged j join masked m on m.n = j.n + 1""",
    "done": "select seq, user_id, master, dup from judged where done",
    "spans": """
        select f.user_id, f.id, least(b.deleted, d.seq) as ended, d.seq as merged from facts f
        left join born b on b.user_id = f.user_id and b.id = f.id left join done d on d.user_id = f.user_id and d.dup = f.id""",
    "tree": """
        select user_id, id as root, id as node, cast([] as bigint[]) as way from spans where ended is null
        union all
        select t.user_id, t.root, d.dup, list_append(t.way, d.seq) from tree t join done d on d.user_id = t.user_id and d.master = t.node""",
    "mwrites": """
        select c.user_id, c.id, c.seq, c.ts, c.title, c.text, c.category, c.k, c.event_type in ('purchase', 'view') as keyed
        from mchanges c join spans s on s.user_id = c.user_id and s.id = c.id where c.op = 'update' and coalesce(c.seq < s.ended, true)
        union all
        select d.user_id, d.master, d.seq, c.ts, c.title, null, null, null, false from done d join mchanges c on c.seq = d.seq""",
    "owned": """
        select f.user_id, f.id, f.title, f.text, f.category, f.brand, cast(f.size as varchar) as size,
               arg_max(w.title, w.seq) filter (w.title is not null) as new_title, arg_max(w.text, w.seq) filter (w.text is not null) as new_text,
               arg_max(w.category, w.seq) filter (w.category is not null) as new_category, arg_max(w.k, w.seq) filter (w.keyed) as k,
               max(w.ts) as updated_at
        from facts f left join mwrites w on w.user_id = f.user_id and w.id = f.id group by all""",
    "exact_all": """
        select q.query_id, f.id, f.category, q.category as wanted,
               case when lower(f.title) = lower(q.query) then 2.0 when contains(lower(f.title), lower(q.query)) then 1.5
                    else 1.0 end as score
        from queries q join facts f on f.user_id = q.user_id
        where (contains(lower(f.title), lower(q.query)) or (length(q.query) > 3 and contains(lower(f.text), lower(q.query))))
          and (q.category is null or q.category = f.category)""",
    "exact": """
        select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank
                       from exact_all) where rank <= 5""",
    "vector": """
        select * from (
          select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank
          from (select q.query_id, f.id, round(list_cosine_similarity(q.vec, f.v), 9) as score
                from queries q join vectors f on f.user_id = q.user_id
                where q.category is null or q.category = f.category)
          where score >= 0.3) where rank <= 50""",
    "boosted": """
        select h.query_id, h.id, h.score
          + case when lower(title) = lower(query) then 0.5
                 when contains(lower(title), lower(query)) or contains(lower(query), lower(title)) then 0.2 else 0 end
          + case when lower(query) = lower(brand) then 0.9 * 0.2
                 when contains(lower(brand), lower(query)) or contains(lower(query), lower(brand)) then 0.9 * 0.05 else 0 end
          + case when lower(query) = lower(word2) then 0.5 * 0.2
                 when contains(lower(word2), lower(query)) or contains(lower(query), lower(word2)) then 0.5 * 0.05 else 0 end as score
        from vector h join queries q using (query_id) join facts f on f.id = h.id""",
    "found": """
        select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
        from (select query_id, id, max(score) as score
              from (select query_id, id, score from exact union all select query_id, id, score from boosted)
              group by query_id, id)""",
    "text_slots": rf"""
        select id, kind, slot, cast(cast(n / sqrt(sum(n * n) over (partition by id, kind)) as float) as double) as w
        from (select id, kind, cast('0x' || substr(md5(token), 1, 4) as int) % 64 as slot, count(*) as n
              from (select id, 'fact' as kind, unnest(string_split(lower(concat(title, ': ', text)), ' ')) as token from facts
                    union all select id, 'query', unnest(string_split(lower(text), ' ')) from facts) group by all)""",
    "text_norms": "select id, kind, sqrt(sum(w * w)) as norm from text_slots group by all",
    "text_hits": """
        select query_id, id, score from (
          select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank
          from (select q.id as query_id, f.id as id, round(sum(a.w * b.w) / max(na.norm) / max(nb.norm), 9) as score
                from facts q join facts f on f.user_id = q.user_id and f.category = q.category
                join text_slots a on a.id = q.id and a.kind = 'query' join text_slots b on b.id = f.id and b.kind = 'fact' and b.slot = a.slot
                join text_norms na on na.id = q.id and na.kind = 'query' join text_norms nb on nb.id = f.id and nb.kind = 'fact'
                group by q.id, f.id)
          where score >= 0.55) where rank <= 50""",
    "text_boosted": """
        select h.query_id, h.id, h.score + case when contains(lower(q.text), lower(f.title)) then 0.2 else 0 end
          + case when contains(lower(q.text), lower(f.brand)) then 0.9 * 0.05 else 0 end
          + case when contains(lower(q.text), lower(f.word2)) then 0.5 * 0.05 else 0 end as score
        from text_hits h join facts q on q.id = h.query_id join facts f on f.id = h.id""",
    "text_exact": """
        select query_id, id, cast(1.0 as double) as score from (
          select q.id as query_id, f.id, row_number() over (partition by q.id order by f.id) as rank
          from facts q join facts f on f.user_id = q.user_id and f.category = q.category and contains(lower(f.text), lower(q.text)))
        where rank <= 3""",
    "items": """
        select v.user_id, v.category, v.id, v.v, lower(f.title) as t, f.ts,
               list_distinct(string_split(lower(f.title), ' ')) as words
        from vectors v join facts f on f.id = v.id""",
    "cosines": """
        select a.user_id, a.category, a.id as i, b.id as j, a.t = b.t as same, list_cosine_similarity(a.v, b.v) as cos,
               len(list_filter(list_intersect(a.words, b.words), lambda w: length(w) > 2 or a.category = 'People'))
                 / least(len(a.words), len(b.words)) as ratio
        from items a join items b on a.user_id = b.user_id and a.category = b.category and a.id < b.id""",
    "scores": """
        select user_id, category, i, j,
               case when same then greatest(cos, 1.0) when ratio >= 1 then greatest(cos + 0.25 * ratio, 0.86)
                    else cos + 0.25 * ratio end as similarity
        from cosines""",
    "pairs": "select * from scores where similarity >= 0.4",
    "sides": """
        select user_id, category, i as id, j as other, similarity from pairs
        union all select user_id, category, j, i, similarity from pairs""",
    "reach": """
        select user_id, category, id, id as node from sides
        union select r.user_id, r.category, s.other, r.node from reach r
        join sides s on s.user_id = r.user_id and s.category = r.category and s.id = r.id""",
    "component": "select user_id, category, id, min(node) as component from reach group by all",
    "cluster": """
        select *, row_number() over (partition by user_id, category order by ts desc, first_id) as cluster_id
        from (select c.user_id, c.category, c.component, count(distinct c.id) as size, avg(s.similarity) as average,
                     max(f.ts) as ts, arg_max(c.id, f.ts) as first_id
              from component c join sides s on s.id = c.id join facts f on f.id = c.id group by all)""",
    "ranked": """
        select c.user_id, c.category, k.cluster_id, c.component, c.id,
               4 + case when f.size is null then 0 else 1 end as non_empty, length(f.text) as text_len,
               row_number() over (partition by c.user_id, c.category, c.component
                 order by 4 + case when f.size is null then 0 else 1 end desc, length(f.text) desc, c.id) as rank
        from component c join cluster k using (user_id, category, component) join facts f on f.id = c.id""",
    "merges": """
        select d.user_id, m.id as master_id, d.id as dup_id
        from ranked d join ranked m using (user_id, category, component) where m.rank = 1 and d.rank > 1""",
    "requests": """
        select distinct (event_id // 5) % 4 as user_id, event_id // 5 as seed from events where event_type = 'view'""",
    "hops": """
        select user_id, src as node, dst as next, concat(src, rel, '>', dst) as edge from edges
        union all select user_id, dst, src, concat(src, rel, '>', dst) from edges""",
    "known": "select user_id, id, title, text, category, brand, size from facts",
    "dead": "select distinct user_id, id from changes where op = 'delete'",
    "corrections": rf"""
        select distinct unnest(regexp_extract_all(text, '{_WORD}+')) as wrong from benchmark""",
    "pieces": rf"""
        select conv_id, turn, unnest(regexp_extract_all(text, '{_WORD}+|[^\p{{L}}\p{{N}}_]+')) as piece,
               generate_subscripts(regexp_extract_all(text, '{_WORD}+|[^\p{{L}}\p{{N}}_]+'), 1) as pos
        from turns""",
    "asked": """
        select distinct user_id, name from (
          select user_id, concat(title, ' ', brand) as name from facts
          union all select user_id, word2 from facts
          union all select u, c_mktsegment from customer, unnest([0, 1, 2, 3]) as t(u))""",
}


def _marked(text: str) -> str:
    return rf"regexp_replace({text}, '({_WORD}+)', concat(chr(1), '\1', chr(2)), 'g')"


# Views that others are defined by, beyond those their text names in a from clause.
_RECURSIVE = {"reach", "judged", "tree"}


def _needed(text: str, known: dict[str, None]) -> None:
    for name in VIEWS:
        if name not in known and re.search(rf"\b(from|join) {name}\b", text):
            known[name] = None
            body = VIEWS[name]
            del known[name]
            if name in _RECURSIVE:
                body = re.sub(rf"\b{name}\b", "", body)
            _needed(body, known)
            known[name] = None


def with_views(body: str) -> str:
    """``body`` with the views it uses as common table expressions."""
    needed: dict[str, None] = {}
    _needed(body, needed)
    views = ",\n".join(f"{name} as ({VIEWS[name]})" for name in needed)
    return f"with recursive {views}\n{body}" if views else body


_SIMPLE = {
    "find_patterns": """
        select * from (
          select user_id, cat1, cat2, weight, row_number() over (partition by user_id order by weight desc, cat1, cat2) as rank
          from (select e.user_id, a.category as cat1, b.category as cat2, count(*) as weight
                from (select user_id, src, dst from edges union all select user_id, dst, src from edges) e
                join facts a on a.id = e.src join facts b on b.id = e.dst
                where a.category <> b.category group by all)) where rank <= 10""",
    "list_facts_links": """
        select f.user_id, f.id, f.title, f.category, f.brand, f.size, e.rel, t.id as target_id, t.title as target_title
        from facts f left join edges e on e.user_id = f.user_id and e.src = f.id
        left join facts t on t.user_id = e.user_id and t.id = e.dst""",
    "list_categories": "select distinct user_id, category from facts",
    "list_diary_mentions": """
        select d.user_id, d.id, cast(d.date as varchar) as date, m.fact_id
        from diary d left join mentions m on m.diary_id = d.id""",
    "graph_nodes": """
        select user_id, cast(id as varchar) as id, 'Fact' as label, title, category as grp from facts
        union all select distinct user_id, category, 'Category', category, 'CategoryNode' from facts""",
    "graph_edges": """
        select distinct user_id, cast(src as varchar) as from_id, cast(dst as varchar) as to_id, rel as label from edges
        union all select user_id, cast(id as varchar), category, 'IN_CATEGORY' from facts""",
    "search_exact": "select query_id, id, cast(score as double) as score, rank from exact",
    "search_vector": """
        select query_id, id, round(score, 4) as score, rank from vector""",
    "search_boosted": "select query_id, id, round(score, 4) as score from boosted",
    "search_facts": """
        select r.query_id, r.id, f.title, f.text, f.category, round(r.score, 4) as score, r.rank
        from found r join facts f on f.id = r.id where r.rank <= 5""",
    "search_diary": """
        select h.query_id, h.id, cast(d.date as varchar) as date, round(h.score, 4) as score, m.fact_id as mention_id
        from (select query_id, id, user_id, score, row_number() over (partition by query_id order by score desc, id) as rank
              from (select q.query_id, q.user_id, e.vec_id as id,
                           round(list_cosine_similarity(q.vec, cast(e.embedding as double[])), 9) as score
                    from queries q join embeddings e on e.vec_id % 4 = q.user_id join documents on doc_id = vec_id)
              where score >= 0.3) h
        join diary d on d.id = h.id
        left join (select m.user_id, date, fact_id from mentions m join diary x on x.id = m.diary_id) m
          on m.user_id = d.user_id and m.date = d.date
        where h.rank <= 3""",
    "search_text": """
        select query_id, id, round(score, 4) as score, rank from (
          select query_id, id, score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
          from (select coalesce(e.query_id, h.query_id) as query_id, coalesce(e.id, h.id) as id, greatest(e.score, h.score) as score
                from text_exact e full join text_boosted h on h.query_id = e.query_id and h.id = e.id))
        where rank <= 3""",
    "vector_functions": """
        select vec_id, round(sqrt(list_dot_product(v, v)), 4) as norm, round(list_dot_product(v, list_reverse(v)), 4) as dot,
               round(list_cosine_similarity(v, list_reverse(v)), 4) as cosine
        from (select vec_id, cast(embedding as double[]) as v from embeddings)""",
    "typed_graph": """
        select concat('f:', src) as src, rel, concat('f:', dst) as dst from edges
        union all select concat('u:', user_id), 'KNOWS', concat('f:', id) from facts
        union all select concat('f:', id), 'IN_CATEGORY', concat('c:', category) from facts
        union all select concat('u:', user_id), 'WROTE_DIARY', concat('d:', id) from diary
        union all select concat('d:', diary_id), 'MENTIONS', concat('f:', fact_id) from mentions""",
    "save_diary": """
        select d.user_id, d.id, cast(d.date as varchar) as date, m.fact_id
        from diary d left join mentions m on m.diary_id = d.id and d.id not in (select doc_id from labels)""",
    "deleted_facts": """
        select user_id, id from facts f where exists (from dead d where d.user_id = f.user_id and d.id = f.id)""",
    "name_ids": """
        select id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab'), h[18:20], '-', h[21:32]) as name_id
        from (select id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat('diary_', user_id, '_', cast(date as varchar)))) as h
              from diary)""",
    "metadata_json": """
        select event_id, key, props ->> concat('$.', key) as value from (select event_id, props, unnest(json_keys(props)) as key from events)""",
    "recency_pool": """
        select user_id, category, id, recency from (
          select *, row_number() over (partition by user_id, category order by ts desc, id) as recency from facts)
        where recency <= 500""",
    "recency_pool_cut": """
        select user_id, category, id, recency from (
          select *, row_number() over (partition by user_id, category order by ts desc, id) as recency from facts)
        where recency <= 3""",
    "duplicate_partners": """
        select user_id, category, id, count(*) as partners, round(avg(similarity), 4) as mean_similarity,
               round(max(similarity), 4) as best_similarity from sides group by all""",
    "duplicate_clusters": """
        select user_id, category, cluster_id, size, round(average, 4) as avg_similarity,
               case when average > 0.9 then 'MERGE - high overlap' else 'MERGE - verify and combine' end as recommendation
        from cluster""",
    "duplicate_members": """
        select c.user_id, c.category, k.cluster_id, c.id, round(avg(s.similarity), 4) as similarity
        from component c join cluster k using (user_id, category, component) join sides s on s.id = c.id group by all""",
    "suggest_merge": """
        select user_id, category, cluster_id, id, non_empty, text_len, rank, rank = 1 as is_master from ranked""",
    "suggest_merge_json": """
        select id as cluster_id, position, record_id, non_empty, text_len,
               row_number() over (partition by id order by non_empty desc, text_len desc, record_id) as rank, date
        from (select id, 0 as position, cast(id as varchar) as record_id, 5 + case when size is null then 0 else 1 end as non_empty,
                     length(text) as text_len, '' as date from facts
              union all select id, 1, concat(id, '-copy'), 3, length(category), cast(cast(ts as date) as varchar) from facts)""",
    "suggest_merge_extra": """
        select id as cluster_id, 0 as position, 2 as record_count, unnest(['category', 'brand', 'note']) as key, unnest([category, brand, '']) as value from facts
        union all select id, 0, 2, 'size', cast(size as varchar) from facts where size is not null
        union all select id, 1, 2, 'tags', '[]' from facts""",
    "merge_edges": """
        select user_id, src, rel, dst from (
          select e.user_id, coalesce(a.master_id, e.src) as src, e.rel, coalesce(b.master_id, e.dst) as dst,
                 a.master_id is not null or b.master_id is not null as moved
          from edges e left join merges a on a.dup_id = e.src left join merges b on b.dup_id = e.dst)
        where not (moved and src = dst) group by all""",
    "merge_facts": """
        select f.user_id, f.id, f.title, f.category, f.brand, coalesce(cast(f.size as varchar), x.size) as size
        from facts f left join (
          select m.master_id, min(cast(p.size as varchar)) as size from merges m join facts p on p.id = m.dup_id group by 1
        ) x on x.master_id = f.id
        where f.id not in (select dup_id from merges)""",
    "merge_chain": """
        select user_id, min(id) as id, case when count(*) > 1 then concat('kept ', list_sort(list(id))[2]) else min(title) end as title,
               arg_min(text, id) as text, category from facts group by user_id, category""",
    "apply_changes_merges": """
        select r.user_id, r.id, coalesce(r.new_title, r.title) as title, coalesce(r.new_text, r.text) as text,
               coalesce(r.new_category, r.category) as category, r.brand, x.k, x.size, r.updated_at
        from owned r join (
          select t.user_id, t.root, arg_min(o.k, t.way) filter (o.k is not null) as k, arg_min(o.size, t.way) filter (o.size is not null) as size
          from tree t join owned o on o.user_id = t.user_id and o.id = t.node group by all) x on x.user_id = r.user_id and x.root = r.id
        union all
        select user_id, id, title, text, category, null, null, null, null from mchanges where op = 'add'""",
    "link_upsert_merges": """
        select distinct e.user_id, a.root as src, e.rel, b.root as dst
        from (select user_id, src, rel, dst from edges
              union all
              select c.user_id, c.id, 'WORKS_ON', c.id + 4 from mchanges c
              join spans a on a.user_id = c.user_id and a.id = c.id and coalesce(c.seq < a.ended, true)
              join spans b on b.user_id = c.user_id and b.id = c.id + 4 and coalesce(c.seq < b.ended, true) where c.op = 'link') e
        join tree a on a.user_id = e.user_id and a.node = e.src join tree b on b.user_id = e.user_id and b.node = e.dst
        where a.root <> b.root or (e.src = a.root and e.dst = b.root)""",
    "merge_mentions": """
        select distinct m.user_id, m.diary_id, coalesce(x.keep, m.fact_id) as fact_id
        from mentions m left join (select user_id, id, min(id) over (partition by user_id, left(text, 3)) as keep from names) x
          on x.id = m.fact_id""",
    "merge_properties": """
        select distinct user_id, g.master_id as id, key, value
        from (select master_id, dup_id as id from merges union select master_id, master_id from merges) g
        join (select user_id, id, 'brand' as key, brand as value from facts
              union all select user_id, id, 'size', cast(size as varchar) from facts where size is not null) p using (id)""",
    "neighborhood_paths": """
        select user_id, seed, id, depth, paths from (
          select r.user_id, r.seed, h.next as id, 1 as depth, count(*) as paths
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed group by all
          union all
          select r.user_id, r.seed, g.next, 2, count(*)
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed
          join hops g on g.user_id = h.user_id and g.node = h.next and g.edge <> h.edge group by all)""",
    "neighborhood_types": """
        select user_id, seed, id, depth, paths from (
          select r.user_id, r.seed, h.next as id, 1 as depth, count(*) as paths
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed and contains(h.edge, 'BOUGHT_R>') group by all
          union all
          select r.user_id, r.seed, g.next, 2, count(*)
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed and contains(h.edge, 'BOUGHT_R>')
          join hops g on g.user_id = h.user_id and g.node = h.next and g.edge <> h.edge and contains(g.edge, 'BOUGHT_R>') group by all)""",
    "neighborhood_distinct": """
        select user_id, seed, id, min(depth) as min_depth from (
          select r.user_id, r.seed, h.next as id, 1 as depth
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed
          union all
          select r.user_id, r.seed, g.next, 2
          from requests r join hops h on h.user_id = r.user_id and h.node = r.seed
          join hops g on g.user_id = h.user_id and g.node = h.next)
        where id <> seed group by all""",
    "link_mentions": "select user_id, diary_id, fact_id from mentions",
    "mentions_by_alias": """
        select distinct d.user_id, d.id as diary_id, n.id as fact_id
        from diary d join names n on d.user_id = n.user_id
          and (contains(lower(d.content), lower(n.text)) or contains(lower(d.content), lower(left(n.text, 24))))""",
    "apply_changes": """
        select f.user_id, f.id, coalesce(arg_max(c.title, c.seq) filter (c.title is not null), f.title) as title,
               coalesce(arg_max(c.text, c.seq) filter (c.text is not null), f.text) as text,
               coalesce(arg_max(c.category, c.seq) filter (c.category is not null), f.category) as category,
               f.brand, arg_max(c.k, c.seq) filter (c.event_type in ('purchase', 'view')) as k, max(c.ts) as updated_at
        from facts f left join changes c on c.user_id = f.user_id and c.id = f.id and c.op = 'update'
        where not exists (from dead d where d.user_id = f.user_id and d.id = f.id)
        group by f.user_id, f.id, f.title, f.text, f.category, f.brand
        union all
        select user_id, id, title, text, category, null, null, null from changes where op = 'add'""",
    "delete_detach": """
        select user_id, src, rel, dst from edges
        where not exists (from dead d where d.user_id = edges.user_id and d.id in (edges.src, edges.dst))""",
    "link_upsert": """
        select user_id, src, rel, dst, max(orders) as orders, max(k) as k from (
          select user_id, src, rel, dst, cast(orders as varchar) as orders, null as k from edges
          union all
          select c.user_id, c.id, 'WORKS_ON', c.id + 4, null, arg_max(c.k, c.seq)
          from changes c join facts a on a.user_id = c.user_id and a.id = c.id
          join facts b on b.user_id = c.user_id and b.id = c.id + 4
          where c.op = 'link' group by c.user_id, c.id) e
        where not exists (from dead d where d.user_id = e.user_id and d.id in (e.src, e.dst))
        group by user_id, src, rel, dst""",
    "transcript_stats": f"""
        select conv_id, turn, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda t: t <> '')) as word_count,
               length(text) as char_count from turns""",
    "filler_removal": rf"""
        select conv_id, turn, regexp_replace(regexp_replace(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(um|uh|like|you know|sort of)($|[^\p{{L}}\p{{N}}_])', '\1\3', 'g'),
          '(?i)(^|[^\p{{L}}\p{{N}}_])(um|uh|like|you know|sort of)($|[^\p{{L}}\p{{N}}_])', '\1\3', 'g') as text
        from turns""",
    "turn_lines": "select conv_id, turn, concat('[', speaker, ']: ', text) as line from turns",
    "relabel": """
        select conv_id, turn, coalesce(c_name, speaker) as speaker, text
        from turns left join customer on c_custkey = conv_id and speaker = 'user'""",
    "corrections": """
        select conv_id, turn, string_agg(case when wrong is null then piece else concat(piece, '_fixed') end, '' order by pos) as text
        from pieces left join corrections on piece = wrong group by all""",
    "alias_parse": """
        select user_id, id, title as alias, cast(1 as double) as confidence from facts
        union all select user_id, id, brand, 0.9 from facts
        union all select user_id, id, word2, 0.5 from facts""",
    "people_resolution": """
        select a.user_id, a.name, count(f.id) as candidates,
               case count(f.id) when 0 then 'none' when 1 then 'single' else 'multiple' end as resolution,
               case when count(f.id) = 1 then min(f.id) end as match_id
        from asked a left join facts f on f.user_id = a.user_id
          and (contains(lower(f.title), lower(a.name)) or (length(a.name) > 3 and contains(lower(f.text), lower(a.name))))
        group by a.user_id, a.name""",
    "fuzzy_names": """
        select a.user_id, a.name, b.title as pattern, levenshtein(a.name, b.title) as distance
        from (select distinct user_id, concat(left(title, 3), substr(title, 5)) as name from facts) a
        join (select distinct user_id, title from facts) b on a.user_id = b.user_id and levenshtein(a.name, b.title) <= 2""",
    "people_resolution_fuzzy": """
        select a.user_id, a.name, count(f.id) as candidates,
               case count(f.id) when 0 then 'none' when 1 then 'single' else 'multiple' end as resolution,
               case when count(f.id) = 1 then min(f.id) end as match_id
        from (select distinct user_id, concat(left(title, 3), substr(title, 5)) as name from facts
              union select user_id, concat(left(brand, 3), substr(brand, 5)) from facts) a
        left join facts f on f.user_id = a.user_id
          and (contains(lower(f.title), lower(a.name)) or (length(a.name) > 3 and contains(lower(f.text), lower(a.name)))
               or contains(lower(f.brand), lower(a.name)) or contains(lower(f.word2), lower(a.name))
               or levenshtein(lower(f.title), lower(a.name)) <= 1 or levenshtein(lower(f.brand), lower(a.name)) <= 1
               or levenshtein(lower(f.word2), lower(a.name)) <= 1)
        group by a.user_id, a.name""",
    "reprocessing_guard": """
        select i.event_id, i.user_id, i.title, case when k.id is null then 'insert' else 'update' end as op, k.id as existing_id
        from (select event_id, (event_id // 5) % 4 as user_id,
                     case when event_type = 'purchase' then upper(p_name) else concat('event ', event_id) end as title
              from events left join part on p_partkey = event_id // 5) i
        left join (select user_id, title, min(id) as id from facts group by all) k
          on k.user_id = i.user_id and lower(k.title) = lower(i.title)""",
    # chr(1) and chr(2) mark where words begin and end, so that names match whole words only.
    "wikilinks": rf"""
        select d.id, case when p.pattern is null then d.content else translate(regexp_replace({_marked('d.content')},
            concat('\[\[([^\[\]]*)\]\]|(', p.pattern, ')'), '[[\1\2]]', 'g'), concat(chr(1), chr(2)), '') end as content
        from diary d left join (
          select d.id, string_agg(regexp_escape({_marked('n.text')}), '|' order by length(n.text) desc, n.text) as pattern
          from diary d join names n on n.user_id = d.user_id and contains(d.content, n.text) group by d.id) p using (id)""",
    "file_name_dates": "select event_id, date_trunc('second', ts) as recorded_at from events",
    "direct_addresses": r"""
        select distinct t.conv_id, t.turn, t.name
        from (select conv_id, turn, unnest(regexp_extract_all(text, '(?:^|[.!?]\s+)(\p{Lu}[\p{L}''-]*(?: \p{Lu}[\p{L}''-]*)?),', 1)) as name
              from turns where speaker = 'assistant') t
        join (select conv_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}''-]*')) as name from turns where speaker = 'user') p
          on p.conv_id = t.conv_id and p.name = t.name""",
    "tags": """
        select p_partkey as id, unnest(list_filter([p_type, trim(p_name), p_brand], lambda t: t <> '')) as tag from part""",
    "embed_text": rf"""
        select doc_id, slot, round(cast(cast(n / sqrt(sum(n * n) over (partition by doc_id)) as float) as double), 4) as weight
        from (select doc_id, cast('0x' || substr(md5(token), 1, 4) as int) % 64 as slot, count(*) as n
              from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{_SPACE}+'), lambda t: t <> '')) as token
                    from documents) group by all)""",
    "check_new_facts": """
        select user_id, category, -1 - i as id, count(*) as partners, round(max(similarity), 4) as best_similarity
        from (select user_id, category, i, similarity from scores union all select user_id, category, j, similarity from scores
              union all select user_id, category, id, 1.0 from items)
        where similarity >= 0.4 group by all""",
}

# A streamed result equals its batch twin; the path for large data that of small data.
_TWINS = {
    "stream_mentions": "link_mentions",
    "stream_changes": "apply_changes",
    "stored_changes": "apply_changes_merges",
    "stored_links": "link_upsert_merges",
    "stream_duplicates": "check_new_facts",
    "duplicate_clusters_tiled": "duplicate_clusters",
    "duplicate_partners_tiled": "duplicate_partners",
    "search_vector_tiled": "search_vector",
    "search_vector_index": "search_vector",
}


def oracle_sql() -> dict[str, str]:
    sql = {name: with_views(body) for name, body in _SIMPLE.items()}
    sql.update({name: sql[twin] for name, twin in _TWINS.items()})
    return sql
