"""The queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, line_dedup, sentencepiece_viterbi, toxicity, url_filter
from factloom.llm.common import shared_dir
from factloom.llm.near_dedup import classes
from factloom.llm.sampling import held_out
from factloom.llm.substring_dedup import remove_repeats
from factloom.llm.token_files import token_digests, write_token_files
from factloom.llm.topk_search import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), *url_filter.train(spark)).drop("url")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_digests(spark, path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes each text, decodes the ids, and digests both."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text).alias("text_crc32"))
    coded = sentencepiece_viterbi.encode(docs, path, keep_text=False)
    ids = coded.select("doc_id", "text_crc32", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "ids")
    back = sentencepiece_viterbi.decode(ids, path, out="decoded")
    return back.select("doc_id", "n_tokens", "ids_crc32", F.crc32("decoded").alias("decoded_crc32"), (F.crc32("decoded") == F.col("text_crc32")).alias("round_trip"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from p)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_files": op8_token_files,
    "op9_near_dedup": op9_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

OP7_SQL = """
with d as (
  select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
), g as (
  select rid, doc_id, i, array_to_string(w[i:i + 12], ' ') as k
  from (select rid, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)
), f as (select k, min(doc_id) as m from g group by k),
c as (select distinct rid, unnest(range(i, i + 13)) as p from g join f using (k) where m < doc_id),
r as (select rid, list(p) as gone from c group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, p: not list_contains(gone, p)) end, ' ')) as kept_sha256
from d left join r using (rid)
"""

ORACLE: dict[str, str] = {"op1_topk_search": OP1_SQL, "op7_substring_dedup": OP7_SQL}
