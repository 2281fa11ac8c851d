"""Registered queries over the corpus in trained ids: the documents are encoded
with the trained tokenizer into a written table, and the split, the blocks, the
store, the sidecar and the decoder work on that table (T7-T9, K1-K5, S5-S7)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators import bpe
from pressline.operators import packing as K
from pressline.plans.fixtures import sql_stage, stage_cfg, stage_rows
from pressline.plans.q_packing import STREAM, _blocks_of, _size, _split, _sum, _weighted, _with_ids, sql_tokens
from pressline.plans.q_text import LIBRARY, _model
from pressline.plans.registry import register
from pressline.plans.sql_bpe import VOCAB
from pressline.session import materialize_table, scratch_path
from pressline.sources import sinks
from pressline.sources.tables import table

ID_BYTES = 4   # of an id on its way between tasks
SQL_SPLIT = sql_stage("documents_tok", "CAST(len(text) AS BIGINT)")
SQL_STREAMS = sql_tokens(SQL_SPLIT, "text")


# DuckDB twins over ``documents_tok``, the documents with a list of ids in the
# place of the text; the tests fill that table by the public library
TWINS: dict[str, str] = {}


def _twin(name: str, *ctes: str, body: str):
    """Registers a query without SQL on the driver's tables; its twin needs the ids."""
    TWINS[name] = ("WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) if ctes else "") + body
    return register(name, rows_only=LIBRARY)


@lru_cache(maxsize=4)
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus in trained ids, encoded once a session and written."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", F.char_length("text").alias("chars"), "text")
    return bpe.token_table(docs, _model(spark, sf, VOCAB), keep=("n_chars", "lang", "source", "chars"))


def _lengths(spark: SparkSession, sf: str, tokens: DataFrame) -> DataFrame:
    return materialize_table(stage_rows(spark, sf, tokens.select("doc_id", "n_chars", "n")), "token-lengths")


def _split_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tokens, their lengths by stage, and their split by the stage budgets."""
    tokens = _tokens(spark, sf)
    corpus = _lengths(spark, sf, tokens)
    return tokens, corpus, _split(spark, sf, corpus)


@_twin("trained_split", SQL_SPLIT, body="""
SELECT stage, doc_id, n, start, val_take, train_take, lost FROM split""")
def trained_split(spark: SparkSession, sf: str) -> DataFrame:
    """K1/K2 over trained ids: every document's place and its share of each split."""
    return _split_of(spark, sf)[2].select("stage", "doc_id", "n", "start", "val_take", "train_take", "lost")


@_twin("trained_blocks", SQL_STREAMS, body="""
SELECT stage, split, block_idx, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(CAST(id AS BIGINT) * (idx + 1)) AS BIGINT) AS weighted
FROM blk GROUP BY stage, split, block_idx""")
def trained_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """K5 over trained ids: the fixed windows of every stage's streams."""
    tokens, corpus, split = _split_of(spark, sf)
    p = K.split_pieces(split)
    b = _blocks_of(p, corpus, tokens.select("doc_id", "ids"), ID_BYTES * _size(corpus), lens=K.stream_lengths(p, by=STREAM))
    return b.select("stage", "split", "block_idx", F.size("tokens").alias("n_tokens"),
                    _sum(F.col("tokens")).alias("id_sum"), _weighted(F.col("tokens")).alias("weighted"))


@_twin("trained_store", SQL_STREAMS, body="""
SELECT stage, split, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum, max(id) AS max_id,
       CAST(max(pos) AS BIGINT) AS last_pos, 'uint16' AS store_dtype
FROM tok GROUP BY stage, split""")
def trained_store(spark: SparkSession, sf: str) -> DataFrame:
    """The streams of trained ids written under the vocabulary's bound
    and read back."""
    tokens, corpus, split = _split_of(spark, sf)
    path = scratch_path(spark, f"trained-{uuid.uuid4().hex[:12]}")
    p = _with_ids(K.split_pieces(split), tokens.select("doc_id", "ids"), ID_BYTES * _size(corpus))
    sinks.write_tokens(K.cut_to_take(p), path, vocab_size=VOCAB)
    return spark.read.parquet(path).groupBy("stage", "split").agg(
        F.sum(F.size("ids")).cast("long").alias("tokens"), F.sum(_sum(F.col("ids"))).cast("long").alias("id_sum"),
        F.max(F.array_max("ids")).alias("max_id"), (F.max("pend") - 1).alias("last_pos"),
        F.lit(sinks.store_dtype(VOCAB)).alias("store_dtype"))


@_twin("trained_meta", SQL_SPLIT, body=f"""
SELECT g.stage, {VOCAB} AS vocab_size, g.train_target AS train_tokens_target,
       CAST(sum(s.train_take) AS BIGINT) AS total_train_written,
       g.val_target AS val_tokens_target, CAST(sum(s.val_take) AS BIGINT) AS total_val_written
FROM split s JOIN stage_cfg g USING (stage) GROUP BY g.stage, g.train_target, g.val_target""")
def trained_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and written counts per stage, in trained ids."""
    corpus = _lengths(spark, sf, _tokens(spark, sf))
    cfg = stage_cfg(corpus)
    return sinks.stage_sidecar(K.split_by_budget(K.token_offsets(corpus), cfg), cfg, vocab_size=VOCAB).drop("sidecar")


@register("trained_decode", sql="""
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, true AS ok FROM documents""")
def trained_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The stored ids decode to the text of the document; its literal
    special tokens, which the decoder skips, set aside."""
    from pressline.functions.text import SPECIAL_ALT

    tokens = _tokens(spark, sf)
    back = bpe.bpe_decode(tokens, _model(spark, sf, VOCAB), spark).withColumnRenamed("text", "decoded")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), SPECIAL_ALT, "")
    docs = table(spark, sf, "documents").select("doc_id", F.xxhash64(plain).alias("was"))
    seen = back.select("doc_id", F.xxhash64("decoded").alias("now"))
    return (tokens.select("doc_id", "chars").join(seen, "doc_id").join(docs, "doc_id")
            .select("doc_id", "chars", (F.col("was") == F.col("now")).alias("ok")))


@_twin("trained_chars_per_token", body="""
SELECT lang, source, round(sum(chars) / sum(len(text)), 9) AS chars_per_token, CAST(count(*) AS BIGINT) AS docs
FROM documents_tok GROUP BY ROLLUP (lang, source)""")
def trained_chars_per_token(spark: SparkSession, sf: str) -> DataFrame:
    """Compression of the trained tokenizer, by language and source."""
    e = _tokens(spark, sf).select("lang", "source", F.col("chars").alias("c"), "n")
    return e.rollup("lang", "source").agg(F.round(F.sum("c") / F.sum("n"), 9).alias("chars_per_token"),
                                          F.count(F.lit(1)).alias("docs"))
