"""Registered queries: text and tokenisation."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions import text as TX
from pressline.functions.bytes_ import byte_id_sql, byte_ids, ids_to_text, utf8_bytes
from pressline.functions.bytes_ import byte_to_char, byte_to_id
from pressline.operators import bpe, bpe_train
from pressline.operators.packing import byte_doc_len
from pressline.plans.fixtures import SQL_RUN_LOG, run_log
from pressline.plans.registry import register, with_ctes
from pressline.plans.sql_bpe import SPECIAL_ALT_RE2, SQL_ENCODED, SQL_MERGES, SMALL_VOCAB, SQL_TRAIN, VOCAB, char_sql, pretoken_sql
from pressline.session import scratch_path
from pressline.sources.tables import head_sample, table

LIBRARY = "the recursive SQL twin is too slow at this vocabulary: tested against the public library, and against SQL at 300 entries"
WHOLE_CORPUS = 0         # the store key of a tokenizer trained on every document


@lru_cache(maxsize=4)
def _model(spark: SparkSession, sf: str, vocab: int) -> bpe.BpeModel:
    return bpe_train.train_bpe(bpe.word_histogram(table(spark, sf, "documents").select("doc_id", "text")), vocab)


SQL_BYTES = """
bytes AS (
  SELECT doc_id, lang, CAST(('0x' || h) AS INTEGER) AS b
  FROM (SELECT doc_id, lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)
)"""


@register("byte_alphabet", sql=with_ctes(SQL_BYTES, body=f"""
SELECT b AS byte, {char_sql('b')} AS char, {byte_id_sql('b')} AS id, CAST(count(*) AS BIGINT) AS occurrences
FROM bytes GROUP BY b"""))
def byte_alphabet(spark: SparkSession, sf: str) -> DataFrame:
    """The byte -> printable char -> id alphabet, for every byte value that
    occurs in the corpus (256-row broadcast table joined to byte counts)."""
    chars, ids = byte_to_char(), byte_to_id()
    alpha = spark.createDataFrame([(b, chars[b], ids[b]) for b in range(256)], "byte int, char string, id int")
    d = table(spark, sf, "documents").select(F.explode(utf8_bytes(F.col("text"))).alias("byte"))
    counts = d.groupBy("byte").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(F.broadcast(alpha), "byte").select("byte", "char", "id", "occurrences")


@register("byte_encode", sql=with_ctes(SQL_BYTES, body=f"""
SELECT {byte_id_sql('b')} AS id, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
FROM bytes GROUP BY 1"""))
def byte_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level ids (no merges): per-id occurrences and documents."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(byte_ids(F.col("text"))).alias("id"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("docs"))


@register("pretokenize", sql=f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(w) AS INTEGER) AS n_words,
       CAST(length(array_to_string(w, '')) AS INTEGER) AS covered_chars
FROM (SELECT doc_id, text, {pretoken_sql('text')} AS w FROM documents)""")
def pretokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Words per document and their total length (must equal the text length)."""
    d = table(spark, sf, "documents")
    w = d.select("doc_id", F.char_length("text").alias("n_chars"), TX.pretokenize(F.col("text")).alias("w"))
    return w.select("doc_id", "n_chars", F.size("w").alias("n_words"),
                    F.char_length(F.array_join("w", "")).alias("covered_chars"))


@register("special_audit", sql="""
SELECT lang, CAST(count(*) FILTER (WHERE contains(text, '<|pad_token|>') OR contains(text, '<|begin_of_doc|>')
                                   OR contains(text, '<|end_of_doc|>') OR contains(text, '<|unk|>')) AS BIGINT) AS with_special,
       CAST(count(*) AS BIGINT) AS docs
FROM documents GROUP BY lang""")
def special_audit(spark: SparkSession, sf: str) -> DataFrame:
    """T4: documents whose text contains a literal special token (it would
    become a real special id and a false document boundary)."""
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count_if(TX.has_special(F.col("text"))).cast("long").alias("with_special"),
                                 F.count(F.lit(1)).alias("docs"))


@register("word_histogram", sql=f"""
SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (
  SELECT unnest({pretoken_sql('part')}) AS word FROM (
    SELECT unnest(regexp_split_to_array(text, '{SPECIAL_ALT_RE2}')) AS part FROM documents))
GROUP BY word""")
def word_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """T5: distinct words of the whole corpus and their counts."""
    return bpe.word_histogram(table(spark, sf, "documents"))


@register("word_histogram_ws", sql=r"""
SELECT w AS word, CAST(count(*) AS BIGINT) AS freq
FROM (SELECT unnest(regexp_split_to_array(text, '[ \n\t]+')) AS w FROM documents) WHERE w <> '' GROUP BY w""")
def word_histogram_ws(spark: SparkSession, sf: str) -> DataFrame:
    """T5 twin on whitespace-separated words (same aggregation plan)."""
    d = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \\n\\t]+")).alias("word"))
    return d.filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _encoded(spark: SparkSession, sf: str, vocab: int) -> DataFrame:
    e = bpe.bpe_encode(bpe.dealt(table(spark, sf, "documents").select("doc_id", "text")), _model(spark, sf, vocab))
    return e.select("doc_id", F.size("ids").alias("n_ids"),
                    F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@register("bpe_train", rows_only=LIBRARY)
def bpe_train_q(spark: SparkSession, sf: str) -> DataFrame:
    """Merges learned on the whole corpus (vocabulary of 8 192)."""
    return _model(spark, sf, VOCAB).merges_df(spark)


@register("bpe_train_300", sql=with_ctes(SQL_TRAIN, SQL_MERGES, body="SELECT * FROM merge_rows", recursive=True))
def bpe_train_300(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 merges, next to training one merge at a time in SQL."""
    return _model(spark, sf, SMALL_VOCAB).merges_df(spark)


@register("bpe_encode", rows_only=LIBRARY)
def bpe_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded with the trained merges (+ BOD/EOD)."""
    return _encoded(spark, sf, VOCAB)


@register("bpe_encode_300", sql=with_ctes(SQL_TRAIN, SQL_ENCODED, body="""
SELECT doc_id, CAST(len(text) AS INTEGER) AS n_ids, CAST(list_sum(text) AS BIGINT) AS id_sum FROM documents_tok""", recursive=True))
def bpe_encode_300(spark: SparkSession, sf: str) -> DataFrame:
    """T7 with the first 40 merges, next to its SQL twin."""
    return _encoded(spark, sf, SMALL_VOCAB)


@register("decode_roundtrip", sql="""
SELECT doc_id, true AS ok, CAST(length(text) AS INTEGER) AS n_chars FROM documents""")
def decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """decode(encode(text)) equals the text (byte-level ids with markers;
    the specials are skipped by the decoder)."""
    d = table(spark, sf, "documents")
    ids = F.concat(F.array(F.lit(1)), byte_ids(F.col("text")), F.array(F.lit(2)))
    return d.select("doc_id", (ids_to_text(ids) == F.col("text")).alias("ok"),
                    F.char_length("text").alias("n_chars"))


@register("chars_per_token", sql="""
SELECT lang, source, round(sum(length(text)) / sum(octet_length(encode(text)) + 2), 9) AS chars_per_token,
       CAST(count(*) AS BIGINT) AS docs
FROM documents GROUP BY ROLLUP (lang, source)""")
def chars_per_token(spark: SparkSession, sf: str) -> DataFrame:
    """Characters per (byte-level) token, rolled up by language and source."""
    d = table(spark, sf, "documents").select("lang", "source", F.char_length("text").alias("c"),
                                             byte_doc_len(F.col("text")).alias("n"))
    return d.rollup("lang", "source").agg(F.round(F.sum("c") / F.sum("n"), 9).alias("chars_per_token"),
                                          F.count(F.lit(1)).alias("docs"))


@register("chat_template", sql="""
SELECT conv_id, string_agg('<|begin_of_doc|>' || role || chr(10) || text || '<|end_of_doc|>', '' ORDER BY turn) AS rendered,
       CAST(count(*) AS BIGINT) AS messages
FROM conversations GROUP BY conv_id""")
def chat_template(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation rendered with the chat template."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))).alias("m"))
    return g.select("conv_id", TX.chat_template(F.col("m")).alias("rendered"), F.size("m").cast("long").alias("messages"))


@register("humanize_tokens", sql=with_ctes(SQL_RUN_LOG, body="""
SELECT run, step, CASE WHEN v >= 1e9 THEN printf('%.3fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.3fM', v / 1e6)
                       WHEN v >= 1e3 THEN printf('%.3fK', v / 1e3) ELSE format('{:,}', v) END AS human
FROM (SELECT run, step, tokens_processed * 4096 AS v FROM run_log)"""))
def humanize_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts as short labels (B / M / K)."""
    return run_log(spark, sf).select("run", "step", TX.humanize_tokens(F.col("tokens_processed") * 4096).alias("human"))


@register("head_sample", sql="""
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents ORDER BY doc_id LIMIT 50""")
def head_sample_q(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the first 50 documents (a top-k: the limit is the operator)."""
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return head_sample(d, 50)


@register("tokenizer_store", rows_only=LIBRARY)
def tokenizer_store(spark: SparkSession, sf: str) -> DataFrame:
    """The stored merges of the trained tokenizer, one row each, read from
    the store under vocab=<V>/samples=<N> (0: the whole corpus)."""
    m = _model(spark, sf, VOCAB)
    path = bpe.save_model(m, spark, scratch_path(spark, f"tokenizers-{uuid.uuid4().hex[:12]}"), WHOLE_CORPUS)
    return spark.read.parquet(f"{path}/merges")
