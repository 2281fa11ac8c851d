"""Registered queries: scans, sinks and configuration tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.fixed import OVERFIT_OVERRIDES
from pressline.functions.text import segments, special_map
from pressline.plans.fixtures import SQL_STAGE, stage_cfg, stage_lengths
from pressline.plans.q_packing import BYTE_VOCAB, SQL_TOKENS, _pieces
from pressline.plans.registry import register, with_ctes
from pressline.session import scratch_path
from pressline.sources import sinks
from pressline.sources.tables import batched_scan, corpus_scan, source_catalog, table


@register("corpus_scan", sql="""
SELECT doc_id, lang, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents WHERE lang = 'en'""")
def corpus_scan_q(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset named by a catalog row (documents, config 'en')."""
    cat = source_catalog(spark, [("documents", "en")]).first()
    d = corpus_scan(spark, sf, cat["name"], cat["config"])
    return d.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"))


@register("batched_scan", sql="""
SELECT CAST((rn - 1) // 100 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS docs,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1""")
def batched_scan_q(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in fixed batches of 100 by doc_id order."""
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("b"))
    b = batched_scan(d, 100)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("b").cast("long").alias("bytes"),
                                     F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@register("token_sink_roundtrip", sql=with_ctes(SQL_TOKENS, body="""
SELECT p.stage, p.split, p.pieces, p.tokens, t.id_sum
FROM (SELECT stage, split, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(take) AS BIGINT) AS tokens
      FROM pieces GROUP BY stage, split) p
JOIN (SELECT stage, split, CAST(sum(id) AS BIGINT) AS id_sum FROM tok GROUP BY stage, split) t USING (stage, split)"""))
def token_sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the split pieces partitioned by (stage, split), read them back."""
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex[:12]}")
    sinks.write_tokens(_pieces(spark, sf), path, vocab_size=BYTE_VOCAB)
    back = spark.read.parquet(path)
    return back.groupBy("stage", "split").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("take").cast("long").alias("tokens"),
        F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long").alias("id_sum"))


@register("token_source", sql=with_ctes(SQL_STAGE, body="""
SELECT doc_id, pstart, take FROM pieces
WHERE stage = 'initial_stage' AND split = 'train' AND pstart < 50000 AND pstart + take > 10000"""))
def token_source(spark: SparkSession, sf: str) -> DataFrame:
    """Random access by token position: the stored pieces overlapping
    positions [10 000, 50 000) of the initial training stream (partition
    pruning on stage/split, pushed-down range on pstart and pend)."""
    path = scratch_path(spark, f"tokens-src-{uuid.uuid4().hex[:12]}")
    sinks.write_tokens(_pieces(spark, sf), path, vocab_size=BYTE_VOCAB)
    return sinks.read_tokens(spark, path, "initial_stage", "train", 10_000, 50_000).select("doc_id", "pstart", "take")


@register("config_roundtrip", sql=with_ctes(SQL_STAGE, """
js AS (SELECT stage, to_json({'stage': stage, 'val_target': val_target, 'train_target': train_target, 'seq_len': seq_len})::VARCHAR AS j
       FROM stage_cfg)""", body="""
SELECT stage, j AS json, CAST(json_extract(j, '$.val_target') AS BIGINT) AS val_target,
       CAST(json_extract(j, '$.train_target') AS BIGINT) AS train_target, CAST(json_extract(j, '$.seq_len') AS INTEGER) AS seq_len
FROM js"""))
def config_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Stage configs dumped to JSON and validated back with an explicit schema (FAILFAST)."""
    cfg = stage_cfg(stage_lengths(spark, sf))
    j = cfg.select("stage", F.to_json(F.struct("stage", "val_target", "train_target", "seq_len")).alias("json"))
    schema = "stage string, val_target bigint, train_target bigint, seq_len int"
    p = j.withColumn("p", F.from_json("json", schema, {"mode": "FAILFAST"}))
    return p.select("stage", "json", "p.val_target", "p.train_target", "p.seq_len")


@register("special_tokens", sql="""
WITH r AS (SELECT conv_id, string_agg('<|begin_of_doc|>' || role || chr(10) || text || '<|end_of_doc|>', '' ORDER BY turn) AS s
           FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST((length(s) - length(replace(s, '<|begin_of_doc|>', ''))) // 16 AS BIGINT) AS bod_ids,
       CAST((length(s) - length(replace(s, '<|end_of_doc|>', ''))) // 14 AS BIGINT) AS eod_ids FROM r""")
def special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """token_to_id of the literal specials in rendered chats (literal map lookup)."""
    from pressline.functions.text import chat_template

    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))).alias("m"))
    ids = F.transform(segments(chat_template(F.col("m"))), lambda s: F.try_element_at(special_map(), s))
    t = g.select("conv_id", ids.alias("ids"))
    return t.select("conv_id", F.size(F.filter("ids", lambda i: i == 1)).cast("long").alias("bod_ids"),
                    F.size(F.filter("ids", lambda i: i == 2)).cast("long").alias("eod_ids"))


_OVR_STAGE = {"initial_stage": ("initial_tokens", "initial_val_tokens", "initial_seq_len"),
              "lc_stage": ("lc_tokens", "lc_val_tokens", "lc_seq_len"),
              "annealing_stage": ("anneal_tokens", "anneal_val_tokens", "anneal_seq_len")}


def _override_rows() -> list[tuple[str, str, int]]:
    rows = []
    for stage, (t, v, s) in _OVR_STAGE.items():
        for key, name in (("train_target", t), ("val_target", v), ("seq_len", s)):
            if name in OVERFIT_OVERRIDES:
                rows.append((stage, key, int(OVERFIT_OVERRIDES[name])))
    return rows


@register("profile_override", sql=with_ctes(SQL_STAGE, f"""
base AS (
  SELECT stage, 'train_target' AS key, CAST(train_target AS BIGINT) AS value FROM stage_cfg
  UNION ALL SELECT stage, 'val_target', CAST(val_target AS BIGINT) FROM stage_cfg
  UNION ALL SELECT stage, 'seq_len', CAST(seq_len AS BIGINT) FROM stage_cfg
),
ovr(stage, key, value) AS (VALUES {", ".join(f"('{a}', '{b}', CAST({c} AS BIGINT))" for a, b, c in _override_rows())})""",
        body="""
SELECT b.stage, b.key, coalesce(o.value, b.value) AS value, o.value IS NOT NULL AS overridden
FROM base b LEFT JOIN ovr o USING (stage, key)"""))
def profile_override(spark: SparkSession, sf: str) -> DataFrame:
    """The small-profile overrides applied on top of the data-derived
    stage configuration (long form, left join, coalesce)."""
    cfg = stage_cfg(stage_lengths(spark, sf))
    base = cfg.select("stage", F.explode(F.array(
        F.struct(F.lit("train_target").alias("key"), F.col("train_target").cast("long").alias("value")),
        F.struct(F.lit("val_target").alias("key"), F.col("val_target").cast("long").alias("value")),
        F.struct(F.lit("seq_len").alias("key"), F.col("seq_len").cast("long").alias("value")))).alias("kv"))
    base = base.select("stage", "kv.key", "kv.value")
    ovr = spark.createDataFrame(_override_rows(), "stage string, key string, ovalue bigint")
    t = base.join(F.broadcast(ovr), ["stage", "key"], "left")
    return t.select("stage", "key", F.coalesce("ovalue", "value").alias("value"),
                    F.col("ovalue").isNotNull().alias("overridden"))
