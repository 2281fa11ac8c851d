"""Registered queries: stage budgets, offsets, split, blocks, segments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.bytes_ import byte_id_sql
from pressline.functions.fixed import EOD_ID, N_SPECIAL
from pressline.operators import packing as K
from pressline.plans.fixtures import SQL_STAGE, STAGE_SEQ_LEN, stage_cfg, stage_corpus, stage_lengths
from pressline.plans.registry import register, with_ctes
from pressline.session import materialize_table
from pressline.sources.tables import table

BYTE_ID = byte_id_sql("b")
BYTE_VOCAB = N_SPECIAL + 256   # what byte ids may be stored under

BYTE_DOC_IDS = f"""[1] || list_transform(regexp_extract_all(hex(encode(text)), '..'),
                               lambda h: {BYTE_ID.replace('b', "CAST(('0x' || h) AS INTEGER)")}) || [2]"""


def sql_tokens(stage: str, ids: str) -> str:
    """DuckDB: token rows of every split piece and the blocks; ``ids`` is a document's id list."""
    return stage + f""",
piece_ids AS (
  SELECT stage, split, seq_len, doc_id, pstart, take, {ids} AS ids FROM pieces
),
tok AS (
  SELECT stage, split, seq_len, pstart + i - 1 AS pos, id FROM (
    SELECT stage, split, seq_len, pstart, take, unnest(ids) AS id, generate_subscripts(ids, 1) AS i
    FROM piece_ids) WHERE i <= take
),
stream AS (
  SELECT stage, split, seq_len, CAST((sum(take) - 1) // seq_len AS BIGINT) AS total_blocks
  FROM pieces GROUP BY stage, split, seq_len
),
btok AS (
  SELECT t.stage, t.split, t.seq_len, CAST(t.pos // t.seq_len AS BIGINT) AS block_idx,
         CAST(t.pos % t.seq_len AS BIGINT) AS idx, t.id
  FROM tok t
  UNION ALL
  SELECT t.stage, t.split, t.seq_len, CAST(t.pos // t.seq_len - 1 AS BIGINT), CAST(t.seq_len AS BIGINT), t.id
  FROM tok t WHERE t.pos % t.seq_len = 0 AND t.pos >= t.seq_len
),
blk AS (
  SELECT b.* FROM btok b JOIN stream s USING (stage, split) WHERE b.block_idx < s.total_blocks
)"""


SQL_TOKENS = sql_tokens(SQL_STAGE, BYTE_DOC_IDS)


def _split(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    corpus = stage_lengths(spark, sf) if corpus is None else corpus
    cfg = stage_cfg(corpus)
    off = K.token_offsets(corpus)
    return K.split_by_budget(off, cfg).join(cfg.select("stage", "seq_len"), "stage")


STREAM = ("stage", "split", "seq_len")


def _with_ids(pieces: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The split pieces with the ``(doc_id, ids)`` rows of their documents (``size``
    bytes or so), ids or texts. Only the pieces (not the whole corpus through
    the offset shuffle) meet them, as one row per document that holds its few
    pieces (stages x splits), so ids move once, dealt over tasks by their size."""
    kept = [c for c in pieces.columns if c == "_alone"]
    # dealt like the ids: else Spark deals the ids anew, over the tasks of the pieces
    p = K.spread(pieces, "doc_id", size).groupBy("doc_id").agg(F.collect_list(F.struct(*STREAM, "pstart", "take", *kept)).alias("_p"))
    both = K.spread(ids, "doc_id", size).join(p, "doc_id").select("doc_id", F.explode("_p").alias("_c"), "ids")
    return both.select("doc_id", "_c.*", "ids")


def _size(corpus: DataFrame) -> int:
    """Tokens of all documents: every one is in the initial stage."""
    return corpus.where(F.col("stage") == "initial_stage").agg(F.sum("n")).first()[0] or 0


def _blocks_of(pieces: DataFrame, corpus: DataFrame, ids: DataFrame, size: int, **wanted) -> DataFrame:
    """The blocks of split pieces. A key of several documents gives pieces with
    each one's ids at the same positions; a document without a length takes all
    positions up to the budget."""
    again = corpus.where(F.col("stage") == "initial_stage").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    endless = pieces.where(F.col("n").isNull()).groupBy(*STREAM).agg(F.min("pstart").alias("_endless"))
    p = pieces.join(again.where(F.col("_n") > 1), "doc_id", "left").join(F.broadcast(endless), [*STREAM], "left")
    p = p.withColumn("_alone", F.when(F.col("_n").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("_endless")))
    return K.make_blocks(_with_ids(p, ids, size), F.col("seq_len"), by=STREAM, alone="_alone", **wanted)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' texts in the place of their byte ids, which the tasks make."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("ids"))


def _pieces(spark: SparkSession, sf: str, corpus: DataFrame | None = None) -> DataFrame:
    corpus = stage_lengths(spark, sf) if corpus is None else corpus
    p = K.split_pieces(_split(spark, sf, corpus))
    return K.cut_to_take(_with_ids(p, _texts(spark, sf), _size(corpus)))


def _blocks(spark: SparkSession, sf: str, first: F.Column | int = 0, last: int | None = None) -> DataFrame:
    """The blocks ``first .. last`` of every stream; the block index picks the
    pieces, and only their documents' ids are made."""
    corpus = stage_lengths(spark, sf)
    p = K.split_pieces(_split(spark, sf, corpus))
    lens = K.stream_lengths(p, by=STREAM)
    p = K.wanted_pieces(p, F.col("seq_len"), first, last)
    docs = _texts(spark, sf)
    docs = docs.join(p.select("doc_id").distinct(), "doc_id", "left_semi") if last is not None else docs
    return _blocks_of(p, corpus, docs, _size(corpus), lens=lens, first=first, last=last)


def _summed(weigh) -> Callable[[F.Column], F.Column]:
    """Per list of a column the sum of its ids, each times its ``weigh(place)``."""
    @F.arrow_udf("bigint")
    def sums(lists: pa.Array) -> pa.Array:
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n) - n
        total = np.append(0, np.cumsum(flat if weigh is None else flat * weigh(np.arange(len(flat)) - np.repeat(at, n))))
        return pa.array(total[at + n] - total[at], mask=lists.is_null().to_numpy(zero_copy_only=False))

    return sums


def _weighted(arr: F.Column) -> F.Column:
    return _summed(lambda place: place + 1)(arr)


def _sum(arr: F.Column) -> F.Column:
    return _summed(None)(arr)


# ------------------------------------------------------------------ S2 / S7 / flagship


@register("stage_budget", sql=with_ctes(SQL_STAGE, body="""
SELECT s.stage, CAST(count(*) AS BIGINT) AS docs, CAST(sum(s.n) AS BIGINT) AS corpus_tokens,
       CAST(sum(s.val_take) AS BIGINT) AS val_tokens, CAST(sum(s.train_take) AS BIGINT) AS train_tokens,
       CAST(sum(s.lost) AS BIGINT) AS lost_tokens,
       CAST(count(*) FILTER (WHERE s.val_take > 0) AS BIGINT) AS val_docs,
       CAST(count(*) FILTER (WHERE s.train_take > 0) AS BIGINT) AS train_docs,
       CAST(greatest(0, (sum(s.val_take) - 1) // max(s.seq_len)) AS BIGINT) AS val_blocks,
       CAST(greatest(0, (sum(s.train_take) - 1) // max(s.seq_len)) AS BIGINT) AS train_blocks
FROM split s GROUP BY s.stage"""))
def stage_budget(spark: SparkSession, sf: str) -> DataFrame:
    """How many train / validation tokens, documents and blocks each stage gets."""
    sp = _split(spark, sf)
    agg = sp.groupBy("stage").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("n").cast("long").alias("corpus_tokens"),
        F.sum("val_take").cast("long").alias("val_tokens"),
        F.sum("train_take").cast("long").alias("train_tokens"),
        F.sum("lost").cast("long").alias("lost_tokens"),
        F.count_if(F.col("val_take") > 0).cast("long").alias("val_docs"),
        F.count_if(F.col("train_take") > 0).cast("long").alias("train_docs"),
        F.max("seq_len").alias("_L"),
    )
    return agg.select(
        "stage", "docs", "corpus_tokens", "val_tokens", "train_tokens", "lost_tokens", "val_docs", "train_docs",
        F.greatest(F.lit(0), F.expr("(val_tokens - 1) div _L")).cast("long").alias("val_blocks"),
        F.greatest(F.lit(0), F.expr("(train_tokens - 1) div _L")).cast("long").alias("train_blocks"),
    )


@register("stage_sources", sql=with_ctes(SQL_STAGE, body="""
SELECT stage, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM stage_corpus GROUP BY stage"""))
def stage_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = stage_corpus(spark, sf)
    return c.groupBy("stage").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("tokens"),
                                  F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@register("stage_meta", sql=with_ctes(SQL_STAGE, body="""
SELECT g.stage, 260 AS vocab_size, g.train_target AS train_tokens_target,
       CAST(sum(s.train_take) AS BIGINT) AS total_train_written,
       g.val_target AS val_tokens_target, CAST(sum(s.val_take) AS BIGINT) AS total_val_written,
       to_json({'stage': g.stage, 'vocab_size': 260, 'train_tokens_target': g.train_target,
                'total_train_written': CAST(sum(s.train_take) AS BIGINT),
                'val_tokens_target': g.val_target,
                'total_val_written': CAST(sum(s.val_take) AS BIGINT)})::VARCHAR AS sidecar
FROM split s JOIN stage_cfg g USING (stage) GROUP BY g.stage, g.train_target, g.val_target"""))
def stage_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Per-stage sidecar (targets and written counts); byte-level vocab = 260."""
    from pressline.sources.sinks import stage_sidecar

    corpus = stage_lengths(spark, sf)
    cfg = stage_cfg(corpus)
    sp = K.split_by_budget(K.token_offsets(corpus), cfg)
    return stage_sidecar(sp, cfg, vocab_size=260)


# ------------------------------------------------------------------ K1-K3


@register("token_offsets", sql=with_ctes(SQL_STAGE, body="""
SELECT stage, doc_id, n, start FROM offsets"""))
def token_offsets_q(spark: SparkSession, sf: str) -> DataFrame:
    return K.token_offsets(stage_lengths(spark, sf)).select("stage", "doc_id", "n", "start")


@register("split_by_budget", sql=with_ctes(SQL_STAGE, body="""
SELECT stage, doc_id, n, start, val_take, train_take, lost FROM split"""))
def split_by_budget_q(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("stage", "doc_id", "n", "start", "val_take", "train_take", "lost")


@register("budget_stop", sql=with_ctes(SQL_STAGE, body="""
SELECT doc_id, start, n FROM offsets WHERE stage = 'initial_stage' AND start < 100000"""))
def budget_stop(spark: SparkSession, sf: str) -> DataFrame:
    """K3: documents read before an initial-stage budget of 100 000 tokens."""
    d = table(spark, sf, "documents").select("doc_id", K.byte_doc_len(F.col("text")).alias("n"))
    return K.budget_prefix(d, F.col("n"), 100_000).select("doc_id", F.col("_start").alias("start"), "n")


# ------------------------------------------------------------------ P2-P5, P13


@register("doc_markers", sql=f"""
SELECT doc_id, CAST(octet_length(encode(text)) + 2 AS BIGINT) AS n_ids, 1 AS first_id,
       {BYTE_ID.replace('b', "CAST(('0x' || substr(hex(encode(text)), 1, 2)) AS INTEGER)")} AS second_id,
       2 AS last_id
FROM documents""")
def doc_markers(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", K.byte_doc_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.element_at("ids", 1).alias("first_id"),
                    F.element_at("ids", 2).alias("second_id"), F.element_at("ids", -1).alias("last_id"))


SQL_DOC_IDS = f"""
doc_ids AS (
  SELECT doc_id, lang, [1] || list_transform(regexp_extract_all(hex(encode(text)), '..'),
                 lambda h: {BYTE_ID.replace('b', "CAST(('0x' || h) AS INTEGER)")}) || [2] AS ids
  FROM documents
)"""


@register("truncate_ids", sql=with_ctes(SQL_DOC_IDS, body="""
SELECT doc_id, CAST(len(ids[1:16]) AS INTEGER) AS head_len, CAST(list_sum(ids[1:16]) AS BIGINT) AS head_sum,
       CAST(len(ids[greatest(len(ids) - 16, 0) + 1:]) AS INTEGER) AS tail_len,
       CAST(list_sum(ids[greatest(len(ids) - 16, 0) + 1:]) AS BIGINT) AS tail_sum
FROM doc_ids"""))
def truncate_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", K.byte_doc_ids(F.col("text")).alias("ids"))
    h = K.truncate_head(F.col("ids"), 16)
    t = K.truncate_tail(F.col("ids"), 16)
    return d.select("doc_id", F.size(h).alias("head_len"), _sum(h).alias("head_sum"),
                    F.size(t).alias("tail_len"), _sum(t).alias("tail_sum"))


@register("dtype_audit", sql=with_ctes(SQL_DOC_IDS, body="""
SELECT lang, max(list_max(ids)) AS max_id,
       CAST(sum(len(list_filter(ids, lambda i: i >= 65536))) AS BIGINT) AS over_uint16,
       CAST(sum(len(list_filter(ids, lambda i: i < 0))) AS BIGINT) AS negative,
       CASE WHEN max(list_max(ids)) < 65536 THEN 'uint16' ELSE 'uint32' END AS store_dtype
FROM doc_ids GROUP BY lang"""))
def dtype_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", K.byte_doc_ids(F.col("text")).alias("ids"))
    return K.dtype_audit(d, "ids", by=["lang"])


@register("length_guard", sql="""
SELECT lang, CAST(count(*) FILTER (WHERE octet_length(encode(text)) + 2 <= 1024) AS BIGINT) AS accepted,
       CAST(count(*) FILTER (WHERE octet_length(encode(text)) + 2 > 1024) AS BIGINT) AS rejected
FROM documents GROUP BY lang""")
def length_guard(spark: SparkSession, sf: str) -> DataFrame:
    """A sequence starting at 0 with n tokens fits a 1 024-token window iff n <= 1 024."""
    from pressline.operators.evalops import length_guard as guard

    d = table(spark, sf, "documents").select("lang", K.byte_doc_len(F.col("text")).alias("n"))
    g = guard(d, start_pos=F.lit(0), seq_len=F.col("n"), window=1024)
    return g.groupBy("lang").agg(F.count_if("fits").cast("long").alias("accepted"),
                                 F.count_if(~F.col("fits")).cast("long").alias("rejected"))


# ------------------------------------------------------------------ K4-K14


@register("flat_stream", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(CAST(id AS BIGINT) * pos) AS BIGINT) AS pos_weighted, max(pos) AS last_pos,
       CAST(count(*) FILTER (WHERE id = 2) AS BIGINT) AS eod_tokens
FROM tok GROUP BY stage, split"""))
def flat_stream(spark: SparkSession, sf: str) -> DataFrame:
    corpus = stage_lengths(spark, sf)
    t = K.flat_stream(_pieces(spark, sf, corpus))
    id_, pos = F.col("id").cast("long"), F.col("pos")
    # positions in two halves: the sum of products goes beyond 64 bits from some
    # 10^8 tokens on, the sums of the halves do not
    t = t.groupBy("stage", "split").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("id").cast("long").alias("id_sum"),
        F.sum(id_ * F.shiftright(pos, 16)).cast("decimal(28,0)").alias("_hi"), F.sum(id_ * (pos % (1 << 16))).cast("decimal(28,0)").alias("_lo"),
        F.max("pos").alias("last_pos"), F.count_if(F.col("id") == EOD_ID).cast("long").alias("eod_tokens"))
    n = _size(corpus)
    weighted = (F.col("_hi") * F.lit(1 << 16).cast("decimal(9,0)") + F.col("_lo")).cast("long" if _fits_long(n) else "decimal(38,0)")
    return t.select("stage", "split", "tokens", "id_sum", weighted.alias("pos_weighted"), "last_pos", "eod_tokens")


def _fits_long(n: int) -> bool:
    """Whether the position-weighted sum of ``n`` byte ids has 64 bits at most, whatever the ids."""
    return (BYTE_VOCAB - 1) * n * (n - 1) // 2 < 1 << 63


@register("make_blocks", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, block_idx, CAST(count(*) AS INTEGER) AS n_tokens, CAST(sum(id) AS BIGINT) AS id_sum,
       CAST(sum(CAST(id AS BIGINT) * (idx + 1)) AS BIGINT) AS weighted
FROM blk GROUP BY stage, split, block_idx"""))
def make_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    return b.select("stage", "split", "block_idx", F.size("tokens").alias("n_tokens"),
                    _sum(F.col("tokens")).alias("id_sum"), _weighted(F.col("tokens")).alias("weighted"))


@register("shift_xy", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, block_idx,
       CAST(sum(id) FILTER (WHERE idx < seq_len) AS BIGINT) AS x_sum,
       CAST(sum(id) FILTER (WHERE idx >= 1) AS BIGINT) AS y_sum,
       max(id) FILTER (WHERE idx = 0) AS x_first, max(id) FILTER (WHERE idx = seq_len) AS y_last
FROM blk GROUP BY stage, split, block_idx"""))
def shift_xy(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    return b.select("stage", "split", "block_idx", _sum(F.col("x")).alias("x_sum"), _sum(F.col("y")).alias("y_sum"),
                    F.element_at("x", 1).alias("x_first"), F.element_at("y", -1).alias("y_last"))


@register("resume_skip", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, block_idx, max(id) FILTER (WHERE idx = 0) AS x_first
FROM blk WHERE block_idx >= 1000 // seq_len GROUP BY stage, split, block_idx"""))
def resume_skip(spark: SparkSession, sf: str) -> DataFrame:
    """K7: after 1 000 tokens seen, the blocks from ``1000 div L`` on (L per
    stage), from the pieces that reach so far."""
    b = _blocks(spark, sf, first=K.resume_block(1000, F.col("seq_len")))
    return b.select("stage", "split", "block_idx", F.element_at("x", 1).alias("x_first"))


SQL_WRAP = """
tb AS (SELECT total_blocks AS total, 6 % total_blocks AS skip FROM stream WHERE stage = 'initial_stage' AND split = 'train'),
served AS (SELECT block_idx, max(id) FILTER (WHERE idx = 0) AS x_first FROM blk
           WHERE stage = 'initial_stage' AND split = 'train' GROUP BY block_idx),
wrap AS (
  SELECT CAST(e * total + block_idx - skip AS BIGINT) AS fetch_i, block_idx, x_first
  FROM served, tb, (SELECT range AS e FROM range(0, 3))
  WHERE e * total + block_idx - skip BETWEEN 0 AND 2 * total - 1
),
marked AS (SELECT *, coalesce(block_idx < lag(block_idx) OVER (ORDER BY fetch_i), false) AS epoch_mark FROM wrap)"""


def _fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Two epochs over the initial-stage training blocks, resumed after 6 * L tokens."""
    L = STAGE_SEQ_LEN["initial_stage"]
    corpus = stage_lengths(spark, sf)
    p = K.split_pieces(_split(spark, sf, corpus).filter(F.col("stage") == "initial_stage")).filter(F.col("split") == "train")
    lens = K.stream_lengths(p, by=STREAM)
    b = _blocks_of(p, corpus, _texts(spark, sf), _size(corpus), lens=lens)
    total = lens.select(F.expr(f"(stream_len - 1) div {L}")).scalar()
    return K.epoch_wrap(b.select("block_idx", F.element_at("x", 1).alias("x_first")), total, 2, 6 * L, L)


@register("epoch_wrap", sql=with_ctes(SQL_TOKENS, SQL_WRAP, body="""
SELECT fetch_i, block_idx, epoch_mark, x_first FROM marked"""))
def epoch_wrap(spark: SparkSession, sf: str) -> DataFrame:
    """K8: which block every fetch serves, with its first token, over two epochs."""
    return _fetches(spark, sf).select("fetch_i", "block_idx", "epoch_mark", "x_first")


@register("epoch_marks", sql=with_ctes(SQL_TOKENS, SQL_WRAP, body="""
SELECT fetch_i, block_idx FROM marked WHERE epoch_mark"""))
def epoch_marks(spark: SparkSession, sf: str) -> DataFrame:
    """K9: the fetches at which an epoch starts over."""
    return _fetches(spark, sf).filter("epoch_mark").select("fetch_i", "block_idx")


@register("micro_batches", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, CAST(block_idx // 4 AS BIGINT) AS batch, CAST(count(DISTINCT block_idx) AS BIGINT) AS n_blocks,
       min(block_idx) AS first_block, CAST(sum(id) FILTER (WHERE idx < seq_len) AS BIGINT) AS x_sum
FROM blk GROUP BY stage, split, block_idx // 4"""))
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive blocks in micro-batches of 4; the last may be short."""
    b = _blocks(spark, sf).withColumn("batch", F.floor(F.col("block_idx") / 4).cast("long"))
    return b.groupBy("stage", "split", "batch").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("block_idx").alias("first_block"),
        F.sum(_sum(F.col("x"))).cast("long").alias("x_sum"))


@register("tile_sequence", sql=with_ctes(SQL_TOKENS, body="""
SELECT stage, split, r AS row_id, CAST(count(*) FILTER (WHERE idx < seq_len AND idx < 300) * 0 + 300 AS INTEGER) AS n_tokens,
       CAST(sum(CAST(id AS BIGINT) * ((299 - idx) // seq_len + 1)) FILTER (WHERE idx < seq_len AND idx < 300) AS BIGINT) AS tile_sum
FROM blk, (SELECT range AS r FROM range(0, 2))
WHERE block_idx = 0 GROUP BY stage, split, r"""))
def tile_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Block 0's x of every stream, tiled to 300 tokens, copied to a
    micro-batch of 2 rows; only the pieces of block 0 are read."""
    t = K.tile_to_length(_blocks(spark, sf, last=0), "x", 300, 2)
    return t.select("stage", "split", "row_id", F.size("tiled").alias("n_tokens"), _sum(F.col("tiled")).alias("tile_sum"))


@register("doc_segments", sql=with_ctes(SQL_TOKENS, """
seg AS (
  SELECT stage, split, block_idx, idx, id,
         sum(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stage, split, block_idx ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN id = 2 THEN 1 ELSE 0 END AS segment
  FROM blk b WHERE idx < seq_len
)""", body="""
SELECT stage, split, block_idx, CAST(max(segment) + 1 AS INTEGER) AS segments,
       CAST(sum(segment) AS BIGINT) AS segment_sum
FROM seg GROUP BY stage, split, block_idx"""))
def doc_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segment ids per x-token (exclusive running count of EOD)."""
    b = _blocks(spark, sf).withColumn("seg", K.doc_segments(F.col("x")))
    return b.select("stage", "split", "block_idx", (F.array_max("seg") + 1).alias("segments"),
                    _sum(F.col("seg")).alias("segment_sum"))


@register("visible_pairs", sql=with_ctes(SQL_TOKENS, """
seg AS (
  SELECT stage, split, block_idx, idx AS pos, id,
         sum(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stage, split, block_idx ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN id = 2 THEN 1 ELSE 0 END AS segment
  FROM blk WHERE idx < seq_len
),
keys AS (SELECT stage, split, block_idx, row_number() OVER (PARTITION BY stage, split, block_idx, segment ORDER BY pos) AS k FROM seg)""", body="""
SELECT stage, split, block_idx, CAST(sum(k) AS BIGINT) AS visible FROM keys GROUP BY stage, split, block_idx"""))
def visible_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Per block of every stream, the (q, k) pairs a query may attend to
    (same document, not in the future), counted from the segment lengths."""
    b = K.mask_cost(_blocks(spark, sf), "x", key=["stage", "split", "block_idx"])
    return b.select("stage", "split", "block_idx", F.col("visible_pairs").alias("visible"))


@register("mask_cost", sql=with_ctes(SQL_TOKENS, """
seg AS (
  SELECT stage, split, block_idx, seq_len, idx, id,
         sum(CASE WHEN id = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stage, split, block_idx ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN id = 2 THEN 1 ELSE 0 END AS segment
  FROM blk WHERE idx < seq_len
),
segn AS (SELECT stage, split, block_idx, seq_len, segment, count(*) AS n FROM seg GROUP BY ALL)""", body="""
SELECT stage, split, block_idx, CAST(max(seq_len) AS BIGINT) AS L, CAST(count(*) AS INTEGER) AS segments,
       CAST(sum(n * (n + 1) // 2) AS BIGINT) AS visible_pairs,
       CAST(max(seq_len) * (max(seq_len) + 1) // 2 AS BIGINT) AS causal_pairs
FROM segn GROUP BY stage, split, block_idx"""))
def mask_cost(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf)
    return K.mask_cost(b, "x", key=["stage", "split", "block_idx"])
