"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteweave.llm import (
    decontaminate, embedding_dedup, langid, main_text, packing, phrases, pii, simhash, suffix_dedup, token_output, tokens,
    toxicity, warc, whitening,
)
from siteweave.plans.stages import fresh_path


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(_table(spark, sf, "pages"), path, min_bytes=0)
    return warc.read_warc(spark, path, payloads=False).drop("url")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP1_SQL = f"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, strlen(html)::bigint as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest
  from p
), l as (select payload_digest, max(page_id) as last from d group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from d join l using (payload_digest)
"""


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = tokens.public_path("word_bpe_49k.json")
    return packing.pack(_table(spark, sf, "documents"), vocabulary, end_id=1, window=2048).drop("ids")


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf, "embeddings"), least=0.9)


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    held_out = langid.fold("doc_id", 3) == 1
    found = langid.predict(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
b as (select item_id::varchar as item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
s as (select distinct least(13, len(w)) as k from b where len(w) > 0),
bw as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') as g
  from (select item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0)
),
dw as (
  select doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') as g
  from (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) as i from d, s where len(w) >= k)
),
h as (select doc_id, item_id, i, dw.k from dw join bw on dw.k = bw.k and dw.g = bw.g),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
t as (
  select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) as items_sha256
  from h group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""


def op7_token_output(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(_table(spark, sf, "documents"), path, tokens.public_path("byte_bpe_50k.json"), end_id=2)
    return token_output.checksums(token_output.read_tokens(spark, path))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    held_out = langid.fold("doc_id", 5) == 0
    found = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(_table(spark, sf, "documents"))
    counts = [pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.spans_text(F.col("spans")).alias("spans"))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf, "documents"), least=10, words=3, share=50, top=2000)


# Pieces keep their words; phrases are lists of neighbouring words, counted as they occur.
OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from t
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), g as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) v(k) where len(w) >= k)
  group by lang, k, phrase
), n as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from g where k > 1 and f >= 10),
cuts as (
  select c.lang, c.k, c.phrase, c.a, j, x.f as l, y.f as r, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, k)) as j from c) c
  join g x on x.lang = c.lang and x.k = j and x.phrase = array_to_string(w[1 : j], ' ')
  join g y on y.lang = c.lang and y.k = c.k - j and y.phrase = array_to_string(w[j + 1 : c.k], ' ')
), best as (
  select * from cuts qualify row_number() over (partition by lang, k, phrase order by score, j) = 1
), long as (
  select lang, array_to_string(w[i : i + 1], ' ') as phrase, max(a) as most
  from (select *, unnest([1, 2]) as i from c where k = 3) group by all
), kept as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score from best b left join long on b.k = 2 and long.lang = b.lang and long.phrase = b.phrase
  where most is null or 100 * most < 50 * a
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join n using (lang) qualify rank <= 2000
"""


def op12_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(_table(spark, sf, "pages"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"), most=8)


QUERIES = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_packing": (op2_packing, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_embedding_dedup": (op4_embedding_dedup, None),
    "op5_language": (op5_language, None),
    "op6_decontamination": (op6_decontamination, OP6_SQL),
    "op7_token_output": (op7_token_output, None),
    "op8_simhash": (op8_simhash, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_pii": (op10_pii, None),
    "op11_phrases": (op11_phrases, OP11_SQL),
    "op12_main_text": (op12_main_text, None),
    "op13_whitening": (op13_whitening, None),
}
