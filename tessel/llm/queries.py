"""The queries opN_<name> of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, minhash, phrases, quality, secrets, toxicity, urls, vectors, warc
from .store import settle


def ranks_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    if public_tokenizers.PATTERN != bpe.PATTERN:
        raise ValueError("the vocabulary's splitting pattern isn't the one that bpe.split follows")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), ranks_path(), outputs=("ids_sha256", "decoded_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"), ranks_path())


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(_table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(_table(spark, sf_dir, "documents"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(_table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


#: Words are runs of characters other than space and \\x09-\\x0D; A-Z alone fall to lower case.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

MINHASH_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, {_SPLIT}) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as shingle
      from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id
          having 100 * count(*) >= 85 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) as component_id,
       d.doc_id <= coalesce(r.b, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least r on r.a = d.doc_id
"""

WARC_SQL = """
select page_id, n as payload_bytes, d as payload_digest, case when f < page_id then 'revisit' else 'response' end as record_type,
       case when f < page_id then f end as refers_to
from (select *, case when n >= 100 then min(page_id) over (partition by d, n >= 100) else page_id end as f
      from (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(encode(coalesce(html, ''))) as d from pages))
"""

PHRASES_SQL = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPLIT}) as ws from documents),
s as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h
      from (select doc_id, ws, unnest(generate_series(1, len(ws) - 34)) as i from w where len(ws) >= 35)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from s) where c > 1),
gone as (select distinct doc_id, i + k as pos from again, range(35) r(k)),
each_word as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.pos) as t, count(*) as n from each_word e anti join gone g on e.doc_id = g.doc_id and e.pos = g.pos group by e.doc_id)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from w left join kept k on k.doc_id = w.doc_id
"""

DECONTAMINATION_SQL = f"""
with i as (select item_id, regexp_extract_all({_LOW}, {_ALNUM}) as ws from benchmark),
iw as (select distinct item_id, size, array_to_string(ws[k:k + size - 1], ' ') as win
       from (select item_id, ws, least(13, len(ws)) as size, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) as k from i where len(ws) > 0)),
d as (select doc_id, regexp_extract_all({_LOW}, {_ALNUM}) as ws from documents),
dw as (select doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') as win
       from (select doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as k from d, (select distinct size from iw) where len(ws) >= size)),
hits as (select dw.doc_id, dw.k, dw.size, iw.item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(k, k + size - 1)) as pos from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": MINHASH_SQL, "op6_warc": WARC_SQL, "op7_phrases": PHRASES_SQL, "op9_decontamination": DECONTAMINATION_SQL}
