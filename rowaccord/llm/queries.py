"""One query per operator over its whole table, and the SQL to match where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, settled
from .decontaminate import contamination
from .fill_middle import fill_in_middle, restored
from .html_text import main_text
from .jaccard import jaccard_components
from .language import fit_language, languages
from .mixing import mixture_plan, words_taken
from .near_vectors import near_vectors
from .packing import document_pieces, pack
from .quality import fit_quality, quality_scores
from .secret_scan import fit_from_documents, secrets
from .spelling import spelling_variants
from .token_counts import Unigram, token_counts
from .warc import archived

LEAST_QUALITY = 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), cosine=0.98)


def quality_model(spark: SparkSession, folder: str):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return fit_quality(docs, labels, remainder(labels["doc_id"], 5) != 0)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_scores(table(spark, folder, "documents"), quality_model(spark, folder))
    predicted = (F.col("score") >= LEAST_QUALITY).cast("int")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), Unigram(public_tokenizers.path("piece_bpe_32k.model")))


def op4_contamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets(docs, fit_from_documents(docs, remainder(docs["doc_id"], 5) != 0))


def packed(docs: DataFrame) -> DataFrame:
    pieces = document_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(settled(digests, "pack-pieces"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_language(docs, remainder(docs["doc_id"], 3) != 1)
    held_out = remainder(F.col("doc_id"), 3) == 1
    return languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return words_taken(mixture_plan(table(spark, folder, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_vectors,
        op2_quality,
        op3_token_counts,
        op4_contamination,
        op5_secrets,
        op6_packing,
        op7_jaccard,
        op8_language,
        op9_warc,
        op10_main_text,
        op11_spelling,
        op12_fill_middle,
        op13_mixture,
    )
}

# Components: all pairs, then everything that links reach.
REACH = """
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, least(x, min(y)) as component_id from reach group by x)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op1_near_vectors": f"""
with recursive v as materialized (
  select vec_id, label, embedding::double[] as e, list_dot_product(embedding::double[], embedding::double[]) as n
  from embeddings where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
links as materialized (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where a.n > 0 and b.n > 0 and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) >= 0.98 * sqrt(a.n) * sqrt(b.n)),
{REACH},
counts as (select x, count(*) as n_links from links group by x)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
  vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join counts on vec_id = counts.x left join least on vec_id = least.x
""",
    "op4_contamination": rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
places as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0),
windows as (select distinct item_id, w[p : p + 9] as win, len(w[p : p + 9]) as n from places),
sizes as (select distinct n from windows),
spots as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
hits as (
  select distinct doc_id, p, windows.n, item_id from spots, sizes, windows
  where sizes.n = windows.n and p + sizes.n - 1 <= len(w) and array_to_string(w[p : p + sizes.n - 1], ' ') = array_to_string(win, ' ')),
hit_words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as names
  from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join items using (doc_id)
""",
    "op7_jaccard": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from w where len(w) > 0),
s as materialized (select distinct doc_id, array_to_string(w[p : p + 4], ' ') as sh from places),
sizes as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as n from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
links as materialized (
  select x, y from common join sizes p on x = p.doc_id join sizes q on y = q.doc_id
  where 100 * common.n >= 80 * (p.n + q.n - common.n)),
{REACH}
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, w.doc_id) as component_id
from w left join sizes on w.doc_id = sizes.doc_id left join least on w.doc_id = least.x
""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select sha1(h) as k, max(page_id) as m, count(*) as n from p group by 1),
digits as (
  select k, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(k, (1 + 10 * (i // 8))::int, 10))::ubigint >> (35 - 5 * (i % 8))::ubigint) & 31)::int + 1, 1)) as d from g)
select page_id, strlen(h)::bigint as payload_bytes, array_to_string(d, '') as payload_digest,
  case when n > 1 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> m then m end as refers_to
from p join g on sha1(h) = g.k join digits on g.k = digits.k
""",
    "op11_spelling": rf"""
with recursive texts as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
runs as (select doc_id, run, hex(doc_id::varchar || ':' || run) as x, count(*) as n from texts group by all having length(run) >= 6),
bytes as (select doc_id, run, n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::ubigint) as b from runs),
hashed as (
  select run, n, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, b), lambda c, y:
    list_reduce(list_prepend(xor(c, y), list_transform(range(8), lambda k: k::ubigint)), lambda v, k:
      xor(v >> 1, 3988292384::ubigint * (v & 1)))
    )) as h from bytes),
counted as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word,
    sum(n)::bigint as n from hashed group by 1),
w as materialized (select word, n from counted where length(word) >= 6 and n >= 5),
spots as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from spots),
one_way as (
  select a.word as x, b.word as y from cut a join cut b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select a.word, b.word from cut a join w b on a.d = b.word
  union select b.word, a.word from cut a join w b on a.d = b.word),
near as (select x, y, w.n as near_n, row_number() over (partition by x order by w.n desc, y) as place from one_way join w on y = w.word),
best as (select x, count(*) as n_near, max(y) filter (place = 1) as y, max(near_n) as near_n from near group by x),
f as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * n then y end as form, case when near_n >= 5 * n then near_n end as form_n
  from w left join best on word = x),
walk(word, place) as (select word, word from f union all select walk.word, f.form from walk join f on walk.place = f.word where f.form is not null),
roots as (select walk.word, place from walk join f on place = f.word where form is null)
select f.word, form, place as root, n, n_near, form_n from f join roots on f.word = roots.word
""",
    "op12_fill_middle": """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || doc_id) as h from documents),
draws as (
  select *, len(w) as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::ubigint) as g from d),
placed as (
  select *, least(g[1] % (n + 1), g[2] % (n + 1))::bigint as a, greatest(g[1] % (n + 1), g[2] % (n + 1))::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or g[3] % 100 >= 90 then 'plain'
      when g[4] % 100 < 20 then 'spm' else 'psm' end as form from draws),
parts as (
  select *, coalesce(array_to_string(w[1 : a], ''), '') as p, coalesce(array_to_string(w[a + 1 : b], ''), '') as m,
    coalesce(array_to_string(w[b + 1 : n], ''), '') as s from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
  sha256(t) as restored_sha256
from parts
""",
    "op13_mixture": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    substr(md5('0:' || coalesce(doc_id::varchar, '')), 1, 16) as place, row_number() over () as r from documents),
sources as (
  select source, sum(size)::bigint as source_size, ([5.0, 2.0, 1.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from d group by source),
filled as (
  select *, sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows unbounded preceding) as bounds,
    sum(weight) over (order by 2 * source_size / weight, source nulls last rows unbounded preceding) as weights from sources),
whole as (select sum(weight) as all_weights, sum(source_size)::double * 1.5::double as budget from sources),
level as (
  select greatest(max(budget / all_weights), max(case when all_weights > weights then (budget - bounds::double) / (all_weights - weights) end)) as level
  from filled, whole),
wanted as (select source, source_size, least(2 * source_size::double, level * weight) as target from filled, level),
queued as (
  select *, sum(size) over (partition by source order by place, doc_id nulls last, size, r rows unbounded preceding) as served from d),
turns as (
  select doc_id, queued.source, size, source_size, target, turn, place, r,
    case when target > 0 and size > 0 then (turn * source_size + served)::double / target end as finish
  from queued join wanted on queued.source is not distinct from wanted.source, range(2) as t(turn)),
mix as (
  select *, sum(size) over (order by finish, source nulls last, turn, place, doc_id nulls last, size, r rows unbounded preceding) as until
  from turns where finish is not null),
taken as (select r, sum(size)::bigint as taken from mix, whole where until::double - size / 2 < budget group by r)
select doc_id, size, wanted.source_size, wanted.target, coalesce(taken, 0)::bigint as taken
from d join wanted on d.source is not distinct from wanted.source left join taken on d.r = taken.r
""",
}
