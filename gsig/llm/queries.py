"""The queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, exact_topk, infill, line_dedup, lm, mixing, ngram_join, packing, quality, search, secrets, urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, digest=True)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(infill.stored(table(spark, sf_dir, "documents")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict:
    own = (op1_mixing, op2_line_dedup, op3_lm, op4_nearest, op5_quality, op6_ngram_join, op7_topk, op8_bpe, op9_secrets, op10_urls, op11_search, op12_infill, op13_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_ngram_join": r"""
            with recursive words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
            sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                     else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from words),
            grams as (select doc_id, unnest(s) as g from sets),
            shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
            links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where n * 1.8 >= 0.8 * (len(x.s) + len(y.s)) - 1e-6),
            both_ways as (select a, b from links union all select b, a from links),
            walk as (select doc_id as a, doc_id as b from documents union select w.a, l.b from walk w join both_ways l on w.b = l.a)
            select d.doc_id, (select min(b) from walk where walk.a = d.doc_id) as class_id, (select count(*) from both_ways where both_ways.a = d.doc_id) as n_links from documents d""",
        "op7_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings),
            p as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
                  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
        "op11_search": r"""
            with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
            docs as (select r, doc_id, t, len(t) as n from d where len(t) > 0),
            total as (select count(*) as n_docs, cast(sum(n) as bigint) as l from docs),
            asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
            wanted as (select item_id, term, count(*) as c from asked group by 1, 2),
            tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from docs) where term in (select term from wanted) group by 1, 2),
            weight as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term),
            part as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))) as p from tf join docs using (r) join weight using (term), total),
            scores as (select item_id, r, doc_id, cast(sum(c * p) as bigint) as score from wanted join part using (term) group by 1, 2, 3),
            ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
            select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10""",
        "op12_infill": r"""
            with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
            u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as t, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
            c as (select *, len(t) as n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) as a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) as b from u),
            f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
                  array_to_string(t[1:a], '') as p, array_to_string(t[a + 1:b], '') as m, array_to_string(t[b + 1:], '') as s from c)
            select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
                   sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
            from f""",
    }
