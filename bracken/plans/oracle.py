"""Pieces of SQL, for a second engine, that derive the same workspaces and operators; registered queries are held against them."""

from __future__ import annotations

from ..functions.text import LOW_SIGNAL_WORDS, STOPWORDS
from .corpora import TRADE_QUERIES

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHOR = r"\b[A-Z][A-Z0-9]+(?:-[A-Z0-9]+){2,}\b"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, QUIET = _list(STOPWORDS), _list(LOW_SIGNAL_WORDS)


def asc(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def first_only(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def anchors(x: str) -> str:
    return f"list_filter(regexp_extract_all({x}, '{ANCHOR}'), lambda a: strlen(a) <= 64)"


def plain_words(x: str) -> str:
    return rf"len(list_filter(string_split_regex(regexp_replace({x}, '{ANCHOR}', ' ', 'g'), '[^\p{{L}}]+'), lambda w: strlen(w) >= 4 and not list_contains({QUIET}, {asc('w')})))"


def content_term(x: str) -> str:
    return rf"(strlen(lower({x})) between 4 and 30 and regexp_full_match(lower({x}), '\p{{L}}+') and not list_contains({STOP}, lower({x})))"


def norm_date(x: str) -> str:
    v = f"trim({x})"
    p = f"string_split({v}, case when contains({v}, '/') then '/' else '-' end)"
    n = [f"try_cast({p}[{k}] as integer)" for k in (1, 2, 3)]
    y = f"case when length({p}[1]) = 4 then {n[0]} when {n[2]} < 100 then {n[2]} + 2000 else {n[2]} end"
    d = f"case when length({p}[1]) = 4 then {n[2]} else {n[0]} end"
    ok = f"(contains({v}, '/') or contains({v}, '-')) and len({p}) = 3 and len(list_filter({p}, lambda q: regexp_full_match(q, '[0-9]+'))) = 3"
    return f"case when {ok} and {n[1]} between 1 and 12 and {d} between 1 and 31 then printf('%04d-%02d-%02d', {y}, {n[1]}, {d}) end"


def norm_entity(x: str) -> str:
    shaped = f"case when regexp_full_match(trim({x}), '[A-Z][A-Z0-9]+(?:-[A-Z0-9]+){{2,}}') and strlen(trim({x})) <= 64 then trim({x}) end"
    plain = squeeze(rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', ' ', 'g'))")
    return f"coalesce({norm_date(x)}, {shaped}, {plain})"


def terms(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda t: strlen(t) >= 2))"


def index_terms(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) between 1 and 40)"


def route_terms(x: str) -> str:
    return f"list_filter(string_split_regex({asc(x)}, '[^a-z0-9]+'), lambda t: length(t) > 2)"


def phrase_in(hay: str, needle: str) -> str:
    return f"({needle} <> '' and contains(' ' || {hay} || ' ', ' ' || {needle} || ' '))"


SANITIZED = """translate({x}, '+:-()[]^"~*?\\/', '              ')"""

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "prose_docs": ((), "select 'doc-' || lpad(d.doc_id::varchar, 9, '0') as doc_id, 'doc_' || d.doc_id || '.txt' as filename, 'content' as doc_class, case when l.quality = 0 then 'error' else 'indexed' end as status, d.text as text from documents d left join labels l on d.doc_id = l.doc_id"),
    "places": ((), "select n.*, r.*, 'NAT-' || n_nationkey || '-' || replace(r_name, ' ', '') as nat from nation n join region r on n_regionkey = r_regionkey"),
    "lines": (("places",), "select c_custkey, c_acctbal, o_orderkey, n_nationkey, n_name, nat, 'Order ORD-' || o_orderkey || '-' || o_orderstatus || ' by ' || c_name || ' shipped on ' || strftime(o_orderdate, '%d/%m/%Y') || ' under ' || nat || '. Priority Handling was requested for the ' || c_mktsegment || ' Segment goods.' as line from orders join customer on o_custkey = c_custkey join places on c_nationkey = n_nationkey"),
    "trade_docs": (
        ("lines",),
        """select 'cust-' || lpad(c_custkey::varchar, 9, '0') as doc_id, 'cust_' || c_custkey || '.txt' as filename, 'content' as doc_class, case when any_value(c_acctbal) < 0 then 'error' else 'indexed' end as status, string_agg(line, chr(10) order by o_orderkey) as text from lines group by c_custkey
union all select 'nation-' || lpad(n_nationkey::varchar, 3, '0'), 'README-' || n_name || '.md', 'reference', 'indexed', 'Nation listing of ' || nat || ' with customer files. ' || string_agg('cust_' || c_custkey || '.txt holds shipped orders.', ' ' order by c_custkey) from (select distinct n_nationkey, n_name, nat, c_custkey from lines) group by n_nationkey, n_name, nat
union all select 'region-' || r_regionkey, 'region_' || r_regionkey || '.txt', 'content', 'indexed', 'Related anchors: ' || string_agg(nat, ' ' order by nat) from places group by r_regionkey
union all select 'title-' || r_regionkey, 'title_' || r_regionkey || '.md', 'content', 'indexed', 'title: Region card tags: trade company: ' || r_name || ' anchors: ' || string_agg(nat, ' ' order by nat) from places group by r_regionkey, r_name
union all select 'zindex-' || r_regionkey, 'region' || r_regionkey || '_index.md', 'reference', 'indexed', 'Every nation of the region ' || r_name || ' has a listing of its customer files, see there: ' || string_agg(nat, ' ' order by nat) || '.' from places group by r_regionkey, r_name""",
    ),
    "docs": (("trade_docs",), "select *, row_number() over (order by doc_id) as arrival from trade_docs"),
    "pdocs": (("prose_docs",), "select * from prose_docs"),
    "queries": ((), "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in TRADE_QUERIES) + ") t(query_id, text)"),
}


def _chunk_parts(docs: str, cut: str, chunks: str) -> None:
    look = "substr(text, {s} + 1, 385) || case when {s} + 384 >= total then chr(10) else '' end"
    size = r"length(regexp_extract(" + look + r", '(?s)^(.*[.!?])\s', 1))"
    end = "case when {n} >= 50 and {s} + {n} <= least(total, {s} + 384) then {s} + {n} else least(total, {s} + 384) end"
    nxt = "case when e - 64 > s then e - 64 else e end"
    first = end.format(n=size.format(s="0"), s="0")
    later = end.format(n=size.format(s=f"({nxt})"), s=f"({nxt})")
    PARTS[cut] = ((docs,), f"select doc_id, text, length(text) as total, 0 as s, {first} as e from (select doc_id, text, length(text) as total from {docs}) where total >= 50 union all select doc_id, text, total, {nxt}, {later} from {cut} where e < total")
    PARTS[chunks + "_raw"] = ((cut,), f"select doc_id, doc_id || '#' || lpad((row_number() over w - 1)::varchar, 5, '0') as chunk_id, (row_number() over w - 1)::integer as chunk_index, s as char_start, e as char_end, substr(text, s + 1, e - s) as content from {cut} where e - s >= 50 window w as (partition by doc_id order by s, e)")
    meta = f"(contains({asc('c')}, 'title:') or contains({asc('c')}, 'tags:') or contains({asc('c')}, 'company:'))"
    ratio = "list_sum(list_transform(an, lambda a: strlen(a))) / greatest(strlen(c), 1)"
    label = f"(contains({asc('c')}, 'document anchors') or contains({asc('c')}, 'related anchors') or contains({asc('c')}, 'anchors:'))"
    PARTS[chunks] = (
        (chunks + "_raw",),
        f"select * exclude (c, an), case when c = '' then 'metadata' when {meta} and len(an) >= 1 and len(list_filter(string_split_regex(c, '[.!?]'), lambda s: {plain_words('s')} >= 8)) = 0 and ({plain_words('c')} <= 18 or {ratio} >= 0.25) then 'metadata' when len(an) >= 2 and {label} and ({plain_words('c')} <= 14 or {ratio} >= 0.35) then 'anchor_list' else 'content' end as chunk_signal from (select *, {squeeze('content')} as c, {anchors(squeeze('content'))} as an from {chunks}_raw)",
    )


_chunk_parts("docs", "cut", "chunks")
_chunk_parts("pdocs", "pcut", "pchunks")


def _entity_parts(chunks: str, p: str) -> None:
    tok = r"list_filter(string_split_regex(content, '[^\p{L}\p{N}.'']+'), lambda x: x <> '')"
    clean = r"list_transform(tk, lambda t: regexp_replace(t, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
    PARTS[p + "tok"] = ((chunks,), f"select *, {clean} as cl from (select chunk_id, doc_id, content, {tok} as tk from {chunks})")
    PARTS[p + "ent_anchor"] = ((p + "tok",), f"select chunk_id, doc_id, i as k, 'ANCHOR' as entity_type, v as value, 1.0::double as confidence from (select chunk_id, doc_id, unnest(a) as v, generate_subscripts(a, 1) as i from (select *, ({first_only(anchors('content'))})[:20] as a from {p}tok))")
    date = r"list_filter(regexp_extract_all(content, '(\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4})'), lambda x: true)"
    PARTS[p + "ent_date"] = ((p + "tok",), f"select chunk_id, doc_id, i as k, 'DATE' as entity_type, v as value, 1.0::double as confidence from (select chunk_id, doc_id, unnest(a) as v, generate_subscripts(a, 1) as i from (select *, {date} as a from {p}tok))")
    proper = rf"list_filter(tk, lambda t, i: i > 1 and not suffix(tk[i - 1], '.') and regexp_full_match(t, '[A-Z]\p{{L}}*') and strlen(t) between 4 and 30 and not list_contains({STOP}, lower(t)))"
    PARTS[p + "ent_proper"] = ((p + "tok",), f"select chunk_id, doc_id, i as k, 'PROPER' as entity_type, v as value, 0.7::double as confidence from (select chunk_id, doc_id, unnest(b) as v, generate_subscripts(b, 1) as i from (select *, {first_only('a')} as b from (select *, {proper} as a from {p}tok)))")
    up = "(regexp_matches(a, '^[A-Z]') and regexp_matches(b, '^[A-Z]'))"
    PARTS[p + "ent_phrase"] = (
        (p + "tok",),
        f"select chunk_id, doc_id, k, 'PHRASE' as entity_type, value, confidence from (select *, row_number() over (partition by chunk_id order by j) as k from (select *, row_number() over (partition by chunk_id, lower(value) order by j) as dup from (select chunk_id, doc_id, j, a || ' ' || b as value, case when {up} then 0.85 else 0.65 end::double as confidence from (select chunk_id, doc_id, j, cl[j] as a, cl[j + 1] as b from (select chunk_id, doc_id, cl, unnest(range(1, len(cl))) as j from {p}tok)) where a <> '' and b <> '' and ({up} or ({content_term('a')} and {content_term('b')})))) where dup = 1) where k <= 8",
    )
    PARTS[p + "ent_keyword"] = ((p + "tok",), f"select chunk_id, doc_id, k, 'KEYWORD' as entity_type, t as value, least(1.0, n / 10)::double as confidence from (select *, row_number() over (partition by chunk_id order by n desc, t) as k from (select chunk_id, doc_id, t, count(*) as n from (select chunk_id, doc_id, unnest(list_transform(list_filter(tk, lambda x: {content_term('x')}), lambda x: lower(x))) as t from {p}tok) group by all)) where k <= 5 and n >= 2")
    kinds = [p + "ent_" + k for k in ("anchor", "date", "phrase", "proper", "keyword")]
    PARTS[p + "entities"] = (tuple(kinds), f"select *, {norm_entity('value')} as normalized_value from ({' union all '.join(f'select {n} as fam, * from {k}' for n, k in enumerate(kinds))})")


_entity_parts("chunks", "")
_entity_parts("pchunks", "p")

_CONTENT = "select e.*, d.arrival, coalesce(e.normalized_value, e.value) as v from entities e join chunks c on c.chunk_id = e.chunk_id join docs d on d.doc_id = c.doc_id where c.chunk_signal = 'content'"
_FIRST = "(select *, row_number() over (partition by entity_type, v order by arrival, chunk_id, fam, k) as place from {src}) where place <= 8"
_PAIR = "least(a.chunk_id, b.chunk_id) as src_chunk, greatest(a.chunk_id, b.chunk_id) as dst_chunk"
PARTS |= {
    "own_entities": (("entities", "chunks", "docs"), _CONTENT + " and d.doc_class = 'content'"),
    "ref_entities": (("entities", "chunks", "docs"), _CONTENT + " and d.doc_class = 'reference'"),
    "all_entities": (("entities", "chunks", "docs"), _CONTENT),
    "same_doc": (("chunks",), f"select {_PAIR}, 0.5 as weight, 'same_doc' as edge_type, 'same_doc' as reason from chunks a join chunks b on a.doc_id = b.doc_id and a.chunk_index < b.chunk_index where a.chunk_signal = 'content' and b.chunk_signal = 'content'"),
    "shared_anchor": (("own_entities",), f"select {_PAIR}, 0.9 as weight, 'shared_anchor' as edge_type, 'anchor:' || a.v as reason from own_entities a join (select * from {_FIRST.format(src='own_entities')}) b on a.entity_type = b.entity_type and a.v = b.v and b.arrival < a.arrival where a.entity_type = 'ANCHOR'"),
    "manifest_overlap": (("ref_entities",), f"select {_PAIR}, 0.3 as weight, 'manifest_overlap' as edge_type, 'manifest:' || a.v as reason from ref_entities a join (select * from {_FIRST.format(src='ref_entities')}) b on a.entity_type = b.entity_type and a.v = b.v and b.arrival < a.arrival where a.entity_type = 'ANCHOR'"),
    "held": (("all_entities",), "select entity_type, v, arrival, row_number() over (partition by entity_type, v order by arrival) as df from (select distinct entity_type, v, arrival from all_entities where entity_type in ('DATE', 'PROPER', 'PHRASE'))"),
    "shared_entity": (
        ("own_entities", "held"),
        f"select {_PAIR}, case a.entity_type when 'DATE' then 0.6 when 'PROPER' then 0.65 else 0.7 end as weight, 'shared_entity' as edge_type, lower(a.entity_type) || ':' || a.v as reason from own_entities a join held h on a.entity_type = h.entity_type and a.v = h.v and a.arrival = h.arrival join (select * from {_FIRST.format(src='own_entities')}) b on a.entity_type = b.entity_type and a.v = b.v and b.arrival < a.arrival where a.entity_type in ('DATE', 'PROPER', 'PHRASE') and not (a.arrival > 4 and h.df > ceil(a.arrival * 0.5))",
    ),
    "raw_edges": (("same_doc", "shared_anchor", "shared_entity", "manifest_overlap"), " union all ".join(f"select *, {n} as seq from (select * exclude (one) from (select *, row_number() over (partition by src_chunk, dst_chunk order by weight desc, reason) as one from {k}) where one = 1)" for n, k in enumerate(("same_doc", "shared_anchor", "shared_entity", "manifest_overlap")))),
    "edges": (("raw_edges",), "select src_chunk, dst_chunk, max(weight)::double as weight, arg_max(edge_type, weight * 100 - seq) as edge_type, arg_max(reason, weight * 100 + seq) as reason from raw_edges group by all"),
    "both_ways": (("edges",), "select src_chunk as node, dst_chunk as other, weight, edge_type, reason from edges union all select dst_chunk, src_chunk, weight, edge_type, reason from edges where src_chunk <> dst_chunk"),
    "visible": (("chunks", "docs"), "select c.*, d.filename, d.doc_class from chunks c join docs d on c.doc_id = d.doc_id where d.status = 'indexed'"),
    "vposts": (("visible",), f"select t as term, chunk_id, count(*) as tf, any_value(dl) as dl from (select chunk_id, unnest(tt) as t, len(tt) as dl from (select chunk_id, {index_terms('content')} as tt from visible)) group by t, chunk_id"),
    "vstats": (("visible",), f"select count(*) as n, avg(len({index_terms('content')})) as avgdl from visible"),
    "bm25": (
        ("vposts", "vstats", "queries"),
        f"select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from (select w.query_id, p.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from vposts p join (select term, count(*) as df from vposts group by term) s on s.term = p.term join (select distinct query_id, unnest({index_terms(SANITIZED.format(x='text'))}) as term from queries) w on w.term = p.term, vstats group by all)",
    ),
    "asked": (("queries",), f"select query_id, qn, {terms('qn')} as qt from (select query_id, {norm_entity('text')} as qn from queries)"),
    "ent_scores": (
        ("entities", "visible", "asked"),
        f"select query_id, chunk_id, sum(m) as score from (select query_id, e.chunk_id, case when en = '' then 0.0 when en = qn then 3.0 when {phrase_in('qn', 'en')} then 2.5 when strlen(qn) >= 4 and {phrase_in('en', 'qn')} then 2.0 when len(list_intersect({terms('en')}, qt)) > 0 then 0.4 + 0.8 * len(list_intersect({terms('en')}, qt)) / len({terms('en')}) else 0.0 end as m from (select chunk_id, normalized_value as en from entities) e join (select chunk_id from visible) v on v.chunk_id = e.chunk_id cross join asked where qn <> '' and len(qt) > 0) where m > 0 group by all",
    ),
    "ent_top": (("ent_scores",), "select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from ent_scores) where rank <= 10"),
    "lex_top": (("bm25",), "select * from bm25 where rank <= 10"),
    "ref_text": (("visible", "queries"), f"select query_id, tq, {asc('content')} as ref from visible, (select query_id, {route_terms('text')} as tq from queries) where doc_class = 'reference' and chunk_signal = 'content' and len(tq) > 0 and len(list_filter(tq, lambda t: not contains({asc('content')}, t))) = 0"),
    "route_files": (("ref_text", "visible"), f"select distinct query_id, filename, tq from ref_text, (select distinct filename from visible where doc_class = 'content') where contains(ref, {asc('filename')})"),
    "routed": (("route_files", "visible"), f"select distinct r.query_id, f.chunk_id from route_files r join (select *, row_number() over (partition by filename order by chunk_index, chunk_id) as place from visible where doc_class = 'content' and chunk_signal = 'content') f on f.filename = r.filename and place <= 6 where len(list_filter(tq, lambda t: not contains({asc('content')}, t))) = 0"),
    "pool": (
        ("lex_top", "ent_top", "routed"),
        "select query_id, chunk_id, max(l) as score_bm25, max(e) as score_entity, max(g) as score_graph from (select query_id, chunk_id, least(1, score / max(score) over (partition by query_id)) as l, 0.0::double as e, 0.0::double as g from lex_top union all select query_id, chunk_id, 0.0::double, least(1, score / max(score) over (partition by query_id)), 0.0::double from ent_top union all select query_id, chunk_id, 0.0::double, 0.0::double, 1.0::double from routed) group by all",
    ),
    "scored": (
        ("pool", "visible"),
        "select p.*, v.doc_id, v.filename, v.doc_class, v.chunk_signal, v.content, greatest(0, least(1, 0.35 * score_bm25 * (case when v.doc_class = 'reference' then 0.6 else 1 end) * (case when v.chunk_signal = 'content' then 1 else 0.25 end) + 0.10 * score_entity * (case when v.chunk_signal = 'content' then 1 else 0.25 end) + case when greatest(score_bm25, score_entity) >= 0.2 then 0.15 * score_graph else 0 end)) as score from pool p join visible v on v.chunk_id = p.chunk_id",
    ),
    "told_text": (("scored", "ref_text"), f"select query_id, {asc('content')} as ref from scored where greatest(score_bm25, score_entity) >= 0.2 and doc_class = 'reference' union all select query_id, ref from ref_text where query_id not in (select query_id from scored where greatest(score_bm25, score_entity) >= 0.2 and doc_class = 'reference')"),
    "told": (("told_text", "scored"), f"select distinct t.query_id, f.filename from told_text t, (select distinct filename from scored where doc_class = 'content') f where contains(ref, {asc('f.filename')})"),
    "ranked": (
        ("scored", "told"),
        "select *, row_number() over (partition by query_id order by (of_doc > 10)::int, low, (not promoted)::int, round(score, 9) desc, chunk_id) as rank from (select *, row_number() over (partition by query_id, doc_id order by low, (not promoted)::int, round(score, 9) desc, chunk_id) as of_doc from (select s.*, (s.chunk_signal <> 'content')::int as low, t.filename is not null and s.doc_class = 'content' and row_number() over (partition by s.query_id, s.filename order by round(s.score, 9) desc, s.chunk_id) = 1 as promoted from scored s left join told t on t.query_id = s.query_id and t.filename = s.filename))",
    ),
    "visible_docs": (("docs",), "select * from docs where status = 'indexed'"),
}


def token_bucket(t: str) -> str:
    """The place of a token among the 384 of the hash embedding."""
    octets = f"list_transform(range(1, strlen({t}) + 1), lambda i: ('0x' || substr(hex(encode({t})), 2 * i - 1, 2))::int::uhugeint)"
    return f"(list_reduce([1469598103934665603::uhugeint] || {octets}, lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) % 384)::integer"


_TOKENS = r"unnest(list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')) as t"
PARTS |= {
    "chunk_tokens": (("visible",), f"select chunk_id, t, count(*) as n from (select chunk_id, {_TOKENS.format(x='content')} from visible) group by all"),
    "query_tokens": (("queries",), f"select query_id, t, count(*) as n from (select query_id, {_TOKENS.format(x='text')} from queries) group by all"),
    "buckets": (("chunk_tokens", "query_tokens"), f"select t, {token_bucket('t')} as b from (select t from chunk_tokens union select t from query_tokens)"),
    "chunk_vectors": (("chunk_tokens", "buckets"), "select chunk_id, b, n / sqrt(sum(n * n) over (partition by chunk_id)) as w from (select chunk_id, b, sum(n)::double as n from chunk_tokens join buckets using (t) group by all)"),
    "query_vectors": (("query_tokens", "buckets"), "select query_id, b, n / sqrt(sum(n * n) over (partition by query_id)) as w from (select query_id, b, sum(n)::double as n from query_tokens join buckets using (t) group by all)"),
    "vec_top": (("chunk_vectors", "query_vectors"), "select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from (select query_id, chunk_id, least(1, sum(q.w * c.w)) as score from query_vectors q join chunk_vectors c using (b) group by all)) where rank <= 10"),
}
#: The same ranking with vector candidates: the parts of the one without, changed where vectors come in.
_DENSE = {
    "pool": (("select query_id, chunk_id, max(l) as score_bm25", "select query_id, chunk_id, max(v) as score_vec, max(l) as score_bm25"), ("as l, 0.0::double as e, 0.0::double as g from lex_top", "as l, 0.0::double as e, 0.0::double as g, 0.0::double as v from lex_top"), ("0.0::double from ent_top", "0.0::double, 0.0::double from ent_top"), ("0.0::double, 0.0::double, 1.0::double from routed", "0.0::double, 0.0::double, 1.0::double, 0.0::double from routed union all select query_id, chunk_id, 0.0::double, 0.0::double, 0.0::double, least(1, score / max(score) over (partition by query_id)) from vec_top")),
    "scored": (("0.35 * score_bm25 *", "(0.40 * score_vec + 0.35 * score_bm25) *"), ("from pool p", "from pool_dense p")),
    "told_text": (("greatest(score_bm25, score_entity)", "greatest(score_vec, score_bm25, score_entity)"), ("from scored", "from scored_dense")),
    "told": (("from told_text", "from told_text_dense"), ("from scored", "from scored_dense")),
    "ranked": (("from scored s", "from scored_dense s"), ("left join told t", "left join told_dense t")),
}
for _name, _changes in _DENSE.items():
    _needs, _text = PARTS[_name]
    for _old, _new in _changes:
        if _old not in _text:
            raise ValueError(f"{_name}: {_old}")
        _text = _text.replace(_old, _new)
    PARTS[f"{_name}_dense"] = (tuple(f"{n}_dense" if n in _DENSE else n for n in _needs) + ("vec_top",) * (_name == "pool"), _text)


def lines(x: str) -> str:
    """Lines without white space at both ends, empty ones dropped."""
    return rf"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


def estimate(x: str) -> str:
    return f"greatest(1, ceil(length({x}) / 4))::integer"


def excerpt_key(x: str) -> str:
    kept = rf"regexp_replace(regexp_replace({x}, '\s', ' ', 'g'), '[^A-Za-z0-9 ]', '', 'g')"
    return f"substr({squeeze(asc(kept))}, 1, 220)"


def literal(kind: str = "edge_type", reason: str = "reason") -> str:
    return f"case {kind} when 'shared_anchor' then substr({reason}, 8) when 'shared_entity' then substr({reason}, instr({reason}, ':') + 1) when 'manifest_overlap' then substr({reason}, 10) end"


#: Tokens of the packs that are held against SQL.
PACK_BUDGET = 1500
_UPTO = r"regexp_extract(substr(t, 1, most), '(?s)^(.*[.\n;])', 1)"
_TRIMMED = rf"case when length(t) <= most then t else regexp_replace(case when {_UPTO} <> '' and strlen({_UPTO}) >= most // 2 then {_UPTO} else substr(t, 1, most) end, '\s+$', '') || '...' end"
_SAID = "l.edge_type || ' ' || coalesce(l.reason, '') || ' ' || l.filename || ' ' || coalesce(l.lit, '')"
PARTS |= {
    "offers": (("ranked",), f"select query_id, row_number() over (partition by query_id order by low, rank) as n, chunk_id, doc_id, low = 1 as low, {lines('content')} as t from ranked where rank <= 10"),
    "item_walk": (
        ("offers", "queries"),
        f"select query_id, 0::bigint as n, {estimate('text')} + 24 as used, 0 as lost, 0 as good, 0 as held, []::varchar[] as met, ''::varchar as chunk_id, ''::varchar as doc_id, 0 as tokens, ''::varchar as excerpt, 'start' as verdict from queries "
        "union all select query_id, n, used + case when verdict = 'buy' then tokens + 18 else 0 end, lost + (verdict in ('none', 'dear'))::integer, good + (verdict = 'buy' and not low)::integer, held + (verdict = 'buy')::integer, case when key <> '' and verdict in ('dear', 'buy') then list_append(met, key) else met end, chunk_id, doc_id, tokens, excerpt, verdict "
        f"from (select *, case when (low and good >= 3) or (held > 0 and rest = 0) then 'none' when key <> '' and list_contains(met, key) then 'same' when held > 0 and used + tokens + 18 > {PACK_BUDGET} then 'dear' else 'buy' end as verdict "
        f"from (select *, {excerpt_key('excerpt')} as key, {estimate('excerpt')} as tokens from (select *, {_TRIMMED} as excerpt from (select *, 4 * greatest(rest, 8) as most "
        f"from (select w.query_id, c.n, w.used, w.lost, w.good, w.held, w.met, c.chunk_id, c.doc_id, c.low, c.t, greatest(0, {PACK_BUDGET} - w.used - 18) as rest from item_walk w join offers c on c.query_id = w.query_id and c.n = w.n + 1)))))",
    ),
    "pack_items": (("item_walk",), "select * from item_walk where verdict = 'buy'"),
    "pack_ends": (("item_walk",), "select query_id, arg_max(used, n) as used, arg_max(lost, n) as lost, arg_max(held, n) as held from item_walk group by query_id"),
    "pack_links": (
        ("both_ways", "chunks", "docs", "pack_items"),
        f"select i.query_id, row_number() over (partition by i.query_id order by i.n, l.rank) as m, i.n as place, l.node, l.other, l.edge_type, l.weight, l.chunk_signal = 'content' and l.doc_class <> 'reference' as plain, {estimate(_SAID)} + 14 as tokens, least(l.node, l.other) || chr(10) || greatest(l.node, l.other) as pair from pack_items i join "
        f"(select b.*, c.chunk_signal, d.filename, d.doc_class, {literal()} as lit, row_number() over (partition by node order by weight desc, other) as rank from both_ways b join chunks c on c.chunk_id = b.other join docs d on d.doc_id = c.doc_id where node in (select chunk_id from pack_items)) l on l.node = i.chunk_id where l.rank <= 25",
    ),
    "link_walk": (
        ("pack_links", "pack_ends"),
        "select query_id, 0::bigint as m, used, 0 as spent, 0 as lost, 0 as bought, 0::bigint as place, true as is_open, greatest(3, 3 * held) as most, []::varchar[] as met, ''::varchar as node, ''::varchar as other, ''::varchar as edge_type, 0.0::double as weight, 0 as tokens, 'start' as verdict from pack_ends "
        "union all select query_id, m, used + case when verdict = 'buy' then tokens else 0 end, spent + case when verdict = 'buy' then tokens else 0 end, lost + (verdict in ('bad', 'dear'))::integer, bought + (verdict = 'buy')::integer, place, is_open, most, case when verdict in ('dear', 'buy') then list_append(met, pair) else met end, node, other, edge_type, weight, tokens, verdict "
        f"from (select *, case when not is_open then 'shut' when not plain then 'bad' when list_contains(met, pair) then 'met' when spent + tokens > {PACK_BUDGET} // 5 or used + tokens > {PACK_BUDGET} or bought >= most then 'dear' else 'buy' end as verdict "
        "from (select l.query_id, l.m, w.used, w.spent, w.lost, w.bought, l.place, case when l.place = w.place then w.is_open else w.bought < w.most end as is_open, w.most, w.met, l.node, l.other, l.edge_type, l.weight, l.tokens, l.plain, l.pair from link_walk w join pack_links l on l.query_id = w.query_id and l.m = w.m + 1))",
    ),
}


def sql(select: str, *parts: str) -> str:
    """The select, below the parts it names and those that these need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for p in PARTS[name][0]:
                add(p)
            order.append(name)

    for p in parts:
        add(p)
    return ("with recursive " + ",\n".join(f"{n} as ({PARTS[n][1]})" for n in order) + "\n" if order else "") + select
