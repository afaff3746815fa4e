"""The training-data operators as registered queries, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .cross_polytope import nearest
from .histogram_shards import histogram_shards
from .language_id import is_held_out, label_languages, train
from .license_scan import HINT, RULES, SENTENCES, rule_pattern, rule_rest, scan_licenses
from .line_runs import dedup_lines
from .minhash_dedup import near_duplicates
from .packing import pack, token_pieces, tokenizer_path
from .quality_rules import RULES as QUALITY
from .quality_rules import STOP_WORDS, quality_rules
from .secret_scan import BASE, KINDS, digest_text, scan_secrets
from .source_mixing import mix_sources


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(read(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out()))
    out = label_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license")


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(token_pieces(read(spark, sf_dir, "documents"), tokenizer_path()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, BASE), F.sha2(digest_text(BASE), 256).alias("base_sha256"), digest_text(KINDS).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_cross_polytope, op2_histogram_shards, op3_quality_rules, op4_language_id, op5_license_scan, op6_bestfit_packing, op7_secret_scan, op8_line_dedup, op9_source_mixing, op10_minhash_dedup)
    return {f.__name__: f for f in own}


def _quality_sql() -> str:
    rules = []
    for r in QUALITY:
        bad = [f"{r.numerator} < {r.least!r} * {r.denominator}"] * (r.least > 0) + [f"{r.numerator} > {r.most!r} * {r.denominator}"] * (r.most < float("inf"))
        rules.append(f"({' or '.join(bad)}) and {r.denominator} > 0 and n_words >= {r.from_words}" + " and 2 * n_more_bytes < word_chars" * r.latin)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))
    trimmed = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    return rf"""
with a as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln
  from documents),
g as (
  select doc_id, i, count(*) over (partition by doc_id, hash_key) as n from (
    select doc_id, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] as hash_key from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from a where len(w) >= 5))),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2, i+3, i+4]) as p from g where n > 1) group by doc_id),
m as (
  select a.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    strlen(t) - length(t) as n_more_bytes, cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    len(list_filter(w, lambda x: x in ({stops}))) as n_stop_words, len(ln) as n_lines,
    len(list_filter(ln, lambda x: regexp_matches({trimmed}, '(\.\.\.|…)$'))) as n_ellipsis_lines,
    len(list_filter(ln, lambda x: regexp_matches({trimmed}, '^[-*•‣▪] '))) as n_bullet_lines
  from a left join c on a.doc_id = c.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {" or ".join(f"({r})" for r in rules)}) as kept
from b"""


def _license_sql() -> str:
    case = " ".join(f"when regexp_matches(s, '{p}') then '{k}'" for k, p in SENTENCES.items())
    rules = ", ".join(f"{{'seq': '', 'names': '', 'name': '{n}', 'pat': '{rule_pattern(s)}', 'rest': '{rule_rest(s, chr(92))}'}}" for n, s in RULES)
    step = "lambda a, r: {'seq': regexp_replace(a.seq, r.pat, r.rest, 'g'), 'names': a.names || case when regexp_matches(a.seq, r.pat) then ',' || r.name else '' end, 'name': '', 'pat': '', 'rest': ''}"
    return rf"""
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\x20\t]+', '\1' || chr(10), 'g'), chr(10))) as x, generate_subscripts(string_split(regexp_replace(text, '([.!?])[\x20\t]+', '\1' || chr(10), 'g'), chr(10)), 1) as i from documents),
n as (select doc_id, i, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) as s from s where regexp_matches(x, '{HINT}')),
k as (select doc_id, i, case {case} end as k from n),
q as (select doc_id, string_agg(k, ',' order by i) as ids, string_agg('<' || k || '>', '' order by i) as seq from k where k is not null group by doc_id),
r as (select doc_id, ids, list_reduce([{{'seq': seq, 'names': '', 'name': '', 'pat': '', 'rest': ''}}] || [{rules}], {step}) as hit from q),
d as (select doc_id, ids, list_filter(string_split(hit.names, ','), lambda x: x <> '') as all_names from r),
u as (select doc_id, ids, list_filter(all_names, lambda x, i: list_position(all_names, x) = i) as own from d)
select t.doc_id, coalesce(u.ids, '') as sentence_ids, coalesce(array_to_string(u.own, ','), '') as licenses, u.own[1] as license
from documents t left join u on t.doc_id = u.doc_id"""


_LINES_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (key in (from f)) as n_dropped,
  sha256(coalesce(string_agg(x, chr(10) order by i) filter (key not in (from f)), '')) as kept_sha256
from k group by doc_id"""

_NEAR_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept from c left join n on n.doc_id = c.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality_sql(), "op5_license_scan": _license_sql(), "op8_line_dedup": _LINES_SQL, "op10_minhash_dedup": _NEAR_SQL}
