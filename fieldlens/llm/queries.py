"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, contamination, conversation_queries, exact, langid, mixing, pages, quality, simhash, substrings, tokens
from .storage import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.fold("doc_id", 3) == 1)
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs, model).withColumn("held_out", langid.fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(_table(spark, sf_dir, "documents"), width=35)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archives.pages_to_warc(_table(spark, sf_dir, "pages"), shared_dir(spark, "warc"), least_bytes=0)
    return back.select(F.col("location").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4, radius=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13, share=20)
    return got.select("doc_id", "n_words", "n_hit", "n_items", contamination.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUALITY_METADATA = ("n_chars",)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Machine:
    """Fitted on labelled rows outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return quality.fit(docs, labels.filter(langid.fold("doc_id", 4) != 2), metadata=QUALITY_METADATA)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = quality.score(docs, quality_model(spark, sf_dir, docs), metadata=QUALITY_METADATA, threshold=0.7)
    return got.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_substring_dedup, op3_warc_archives, op4_simhash_near_dedup, op5_main_text, op6_decontamination, op7_token_counts,
    op8_quality, op9_mix_sources, op10_exact_dedup,
)} | conversation_queries.QUERIES

_NINE = r"""
with sized as (select doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from sums),
filled as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / weight as fills from ranked),
levels as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by fills, source nulls last rows between current row and unbounded following) as own, row_number() over (order by fills, source nulls last) as place from filled),
plan as (select source, source_size, least(cap, coalesce(arg_min(own, case when own <= fills then place end) over (), 0) * weight) as target from levels),
rates as (select d.doc_id, d.size, p.source_size, p.target, case when p.source_size > 0 then least(p.target / p.source_size, 3.0::double) else 0.0 end as rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::varchar, 'text:' || md5(coalesce(d.text, '')))), 1, 12))::bigint::double / 281474976710656.0::double as draw
    from sized d join plan p on d.source is not distinct from p.source)
select doc_id, size, source_size, target, ((floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from rates
"""

_TEN = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256 from t window w as (partition by text_sha256)
"""

_SIX = r"""
with items as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where text is not null),
gramlists as (select item_id, case when len(w) < 13 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) end as g, least(len(w), 13) as n from items where len(w) > 0),
grams as (select distinct item_id, unnest(g) as gram, n from gramlists),
docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
sizes as (select distinct n from grams),
windows as (select doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') as gram from docs, sizes s, unnest(range(1, len(w) - s.n + 2)) as u(i)),
hits as (select w.doc_id, w.i, w.n, g.item_id from windows w join grams g on w.gram = g.gram and w.n = g.n),
covered as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as u(p) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items, sha256(coalesce(f.ids, '')) as items_sha256,
    coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from docs d left join covered c using (doc_id) left join found f using (doc_id)
"""

ORACLES = {"op6_decontamination": _SIX, "op9_mix_sources": _NINE, "op10_exact_dedup": _TEN} | conversation_queries.ORACLES
