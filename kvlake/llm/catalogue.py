"""Queries opN_<name> over the driver's tables, and SQL where it can express them."""
from __future__ import annotations

from pyspark.sql import functions as F

from kvlake.llm import bpe, byte_dedup, cover_tree, fingerprint, mixing, pii, secret_scan, simhash, toxicity, warc, xxh64_sql
from kvlake.llm.common import table
from kvlake.sources import scratch


def _hex(col):
    return F.sha2(col, 256)


def op1_warc(spark, d):
    base = scratch.new_path(spark, "warc")
    index = warc.write(table(spark, d, "pages"), base)
    return warc.read(spark, base, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, d, "labels")))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark, d):
    found = secret_scan.scan(table(spark, d, "documents"))
    count = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *count, _hex(secret_scan.spelled(F.col("base"))).alias("base_sha256"), secret_scan.spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op5_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents")).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer(spark):
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))


def op6_bpe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = tokenizer(spark).fit(docs)
    coded = t.encode(docs, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"))


def op7_suffix_dedup(spark, d):
    out = byte_dedup.remove_repeats(table(spark, d, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), _hex("kept").alias("kept_sha256"))


def op8_fingerprint(spark, d):
    out = fingerprint.with_next(table(spark, d, "documents"))
    return out.select("doc_id", "n_chars", _hex("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix")


def op9_pii(spark, d):
    out = pii.replace(table(spark, d, "documents").select("doc_id", "text"))
    count = lambda keep: F.coalesce(F.size(F.filter("__types", keep)), F.lit(0)).cast("long")
    per = [count((lambda k: lambda t: t == k)(k)).alias(f"n_{k}") for k in pii.TYPES]
    return out.select("doc_id", count(lambda t: t.isNotNull()).alias("n_entities"), *per, "text")


def op10_cover_tree(spark, d):
    return cover_tree.near_duplicates(table(spark, d, "embeddings")).select("vec_id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity, op3_mixing, op4_secret_scan, op5_simhash, op6_bpe, op7_suffix_dedup, op8_fingerprint, op9_pii, op10_cover_tree)}

def _spans(kind: int, least: str = "true") -> str:
    """Spans of the matches `m{kind}` of a pattern from what lies between them, `g{kind}`."""
    sizes = lambda x, n: f"coalesce(list_sum(list_transform({x}[1:{n}], lambda y: length(y))), 0)"
    start = f"{sizes(f'g{kind}', 'i')} + {sizes(f'm{kind}', 'i - 1')}"
    return f"list_transform(list_filter(range(1, len(m{kind}) + 1), lambda i: {least}), lambda i: {{'s': ({start})::bigint, 'k': {kind}, 'e': ({start} + length(m{kind}[i]))::bigint}})"


_ASSIGN = secret_scan.ASSIGN.replace("'", "''")

ORACLE = {
    "op1_warc": f"""with p as (select page_id, coalesce(html, '') as h from pages), s as (select page_id, strlen(h) as n, sha256(h) as d from p),
 f as (select d, min(page_id) as first from s where n >= {warc.MIN_REVISIT} group by d)
 select s.page_id, s.n as payload_bytes, s.d as payload_digest, case when f.first <> s.page_id then 'revisit' else 'response' end as record_type, case when f.first <> s.page_id then f.first end as refers_to
 from s left join f on f.d = s.d""",
    # the base is SQL's; the models add nothing on the given tables, and a span they added to these would show as a difference
    "op4_secret_scan": f"""with d as (select doc_id, coalesce(text, '') as t from documents),
 m as (select doc_id, regexp_extract_all(t, '{_ASSIGN}') as m0, regexp_extract_all(t, '{_ASSIGN}', 2) as v0, regexp_split_to_array(t, '{_ASSIGN}') as g0,
  regexp_extract_all(t, '{secret_scan.ACCESS}') as m1, regexp_split_to_array(t, '{secret_scan.ACCESS}') as g1, regexp_extract_all(t, '{secret_scan.HEX}') as m2, regexp_split_to_array(t, '{secret_scan.HEX}') as g2 from d),
 s as (select doc_id, {_spans(0, f"length(v0[i]) >= {secret_scan.ASSIGN_LEAST}")} as a, {_spans(1)} as b, {_spans(2)} as c from m),
 x as (select doc_id, len(a) as n_assign, len(b) as n_access, len(c) as n_hex, array_to_string(list_transform(list_sort(list_concat(a, list_concat(b, c))), lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s || ':' || x.e), ',') as spans from s)
 select doc_id, n_assign, n_access, n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from x""",
    "op3_mixing": f"""with d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end as size from documents),
 p as (select source, sum(size)::bigint as source_size from d group by source),
 r as (select *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1]::double as w, source_size * {mixing.MAX_EPOCHS} as cap from p),
 o as (select *, row_number() over win as n, (sum(source_size) over ())::double - coalesce(sum(cap) over (win rows between unbounded preceding and 1 preceding), 0)::double as rest,
  sum(w) over () - coalesce(sum(w) over (win rows between unbounded preceding and 1 preceding), 0) as w_left from r window win as (order by cap / w, source nulls last)),
 f as (select min(n) as n, arg_min(rest / w_left, n) as level from o where cap >= w * (rest / w_left)),
 t as (select source, source_size, case when f.n is null or o.n < f.n then cap::double else w * f.level end as target from o cross join f),
 g as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t),
 x as (select d.doc_id, d.size, g.source_size, g.target, g.whole, floor(g.target)::bigint - g.whole * g.source_size as rest,
  coalesce(sum(d.size) over (partition by d.source order by md5('{mixing.SEED}|' || coalesce(d.doc_id::varchar, '') || '|' || d.size::varchar), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as earlier
  from d join g on d.source is not distinct from g.source)
 select doc_id, size, source_size, target, (whole * size + least(size, greatest(0, rest - earlier)))::bigint as taken from x""",
    "op5_simhash": f"""with recursive w as (select doc_id, row_number() over (order by doc_id, text) as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 g as (select r, unnest(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - {simhash.NGRAM - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {simhash.NGRAM - 1}], ' ')) end) as s from w),
 gs as (select distinct s from g), {xxh64_sql.tables("gs", simhash.SEED)},
 b as (select g.r, count(*) as n, {", ".join(f"sum(h >> {k} & 1) as b{k}" for k in range(64))} from g join hashed on hashed.s = g.s group by g.r),
 f as (select w.doc_id, coalesce({" + ".join(f"case when b{k} * 2 > n then {xxh64_sql.number(1 << k)} else {xxh64_sql.number(0)} end" for k in range(64))}, {xxh64_sql.number(0)})::ubigint as f from w left join b on b.r = w.r),
 d as (select distinct f from f), l as (select a.f as a, b.f as b from d a join d b on a.f <> b.f and bit_count(xor(a.f, b.f)) <= {simhash.TAU}),
 r as (select f as a, f as b from d union select r.a, l.b from r join l on l.a = r.b), c as (select r.a, min(f.doc_id) as component_id from r join f on f.f = r.b group by r.a)
 select f.doc_id, lpad(lower(hex(f.f)), 16, '0') as fingerprint, c.component_id from f join c on c.a = f.f""",
    # every window by its hash, and gaps between the repeated ones
    "op7_suffix_dedup": f"""with d as (select doc_id, encode(coalesce(text, '')) as b, row_number() over (order by doc_id, text) as r from documents),
 w as (select r, unnest(range(0, octet_length(b) - {byte_dedup.LENGTH - 1})) as p, md5(b[p + 1:p + {byte_dedup.LENGTH}]) as h from d where octet_length(b) >= {byte_dedup.LENGTH}),
 t as (select r, p from w qualify count(*) over (partition by h) > 1),
 g as (select r, p, case when p > coalesce(lag(p) over (partition by r order by p), -{5 * byte_dedup.LENGTH}) + {byte_dedup.LENGTH} then 1 else 0 end as opens from t),
 s as (select r, p, sum(opens) over (partition by r order by p) as k from g),
 x as (select r, k, min(p) as s, max(p) + {byte_dedup.LENGTH} as e from s group by r, k),
 y as (select r, list(s order by s) as starts, list(e order by s) as ends, sum(e - s) as n from x group by r)
 select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(y.n, 0)::bigint as n_removed, coalesce(len(starts), 0)::bigint as n_spans,
  sha256(case when y.r is null then b else unhex(array_to_string(list_transform(range(0, len(starts) + 1), lambda i: hex(b[(case when i = 0 then 0 else ends[i] end) + 1:(case when i = len(starts) then octet_length(b) else starts[i + 1] end)])), '')) end) as kept_sha256
 from d left join y on y.r = d.r""",
    "op10_cover_tree": f"""with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
 l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= {cover_tree.COSINE}),
 r as (select vec_id as a, vec_id as b from e union select r.a, l.b from r join l on l.a = r.b),
 n as (select a, count(*) as n from l group by a)
 select e.vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, c.c = e.vec_id as kept from e left join n on n.a = e.vec_id join (select a, min(b) as c from r group by a) c on c.a = e.vec_id""",
}
