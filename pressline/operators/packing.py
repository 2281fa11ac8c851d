"""Token stream layout: markers, offsets, budget split, blocks, segments.

A stage's token stream is never materialised token by token. A document is a
*piece* ``(doc_id, start, n[, ids])`` on the stream; blocks are assembled from
the pieces that overlap them, so a document adds about ``n / L + 1`` rows
instead of ``n``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.bytes_ import byte_ids, byte_to_id
from pressline.functions.fixed import BOD_ID, EOD_ID
from pressline.operators.ordered import prefix_sums

# ---------------------------------------------------------------- markers


def add_markers(ids: Column, bod: bool = True, eod: bool = True) -> Column:
    """``[BOD] + ids + [EOD]``."""
    parts = []
    if bod:
        parts.append(F.array(F.lit(BOD_ID)))
    parts.append(ids)
    if eod:
        parts.append(F.array(F.lit(EOD_ID)))
    return F.concat(*parts)


def byte_doc_ids(text: Column, bod: bool = True, eod: bool = True) -> Column:
    """Byte-level ids of a document with its markers."""
    return add_markers(byte_ids(text), bod, eod)


def byte_doc_len(text: Column, bod: bool = True, eod: bool = True) -> Column:
    """Length of ``byte_doc_ids`` without building it (fully native)."""
    return F.octet_length(text).cast("long") + F.lit(int(bod) + int(eod))


def truncate_head(ids: Column, k: Column | int) -> Column:
    """First ``k`` ids."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(ids, 1, F.greatest(k, F.lit(0)))


def truncate_tail(ids: Column, k: Column | int) -> Column:
    """Last ``k`` ids."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(ids, F.greatest(F.size(ids) - k, F.lit(0)) + 1, F.greatest(k, F.lit(0)))


def dtype_audit(df: DataFrame, ids: str, by: Sequence[str] = ()) -> DataFrame:
    """P5: range audit for the uint16 / uint32 store types."""
    mx = F.array_max(F.col(ids))
    return df.groupBy(*by).agg(
        F.max(mx).alias("max_id"),
        F.sum(F.size(F.filter(F.col(ids), lambda i: i >= 65536))).cast("long").alias("over_uint16"),
        F.sum(F.size(F.filter(F.col(ids), lambda i: i < 0))).cast("long").alias("negative"),
        F.when(F.max(mx) < 65536, F.lit("uint16")).otherwise(F.lit("uint32")).alias("store_dtype"),
    )


# ---------------------------------------------------------------- offsets and split


def token_offsets(pieces: DataFrame, length: str = "n", order: str = "doc_id",
                  by: Sequence[str] = ("stage",), out: str = "start") -> DataFrame:
    """K1: global start of each document on its stream (exclusive running total)."""
    return prefix_sums(pieces, order, {out: F.col(length).cast("long")}, by=by)


def split_by_budget(offsets: DataFrame, budgets: DataFrame, by: Sequence[str] = ("stage",),
                    n: str = "n", start: str = "start") -> DataFrame:
    """K2: validation first, then training, by token budget.

    ``budgets`` has ``by`` columns plus ``val_target`` and ``train_target``
    (null = 0). Validation takes whole documents until the one that reaches
    its target, which contributes only its head; that document's tail is
    dropped and training starts with the next document, cut at its own
    target. Output adds ``val_take``, ``train_take``, ``lost``,
    ``val_start`` and ``train_start`` (positions on each split's stream).
    """
    by = list(by)
    b = budgets.select(*by,
                       F.coalesce(F.col("val_target"), F.lit(0)).cast("long").alias("_V"),
                       F.coalesce(F.col("train_target"), F.lit(0)).cast("long").alias("_T"))
    t = offsets.join(b, on=by, how="inner")
    end = F.col(start) + F.col(n)
    # end of the document that completes validation (one row per group)
    boundary = (t.filter((F.col("_V") > 0) & (end >= F.col("_V")))
                 .groupBy(*by).agg(F.min(end).alias("_vend")))
    t = t.join(boundary, on=by, how="left")
    # V > 0 and never reached -> no training at all
    vend = F.when(F.col("_V") == 0, F.lit(0)).otherwise(F.col("_vend"))
    val_take = F.when(F.col("_V") > 0,
                      F.greatest(F.lit(0), F.least(F.col(n), F.col("_V") - F.col(start))))
    tstart = F.col(start) - vend
    train_take = F.when(vend.isNotNull() & (F.col(start) >= vend),
                        F.greatest(F.lit(0), F.least(F.col(n), F.col("_T") - tstart)))
    t = (t.withColumn("val_take", F.coalesce(val_take, F.lit(0)).cast("long"))
          .withColumn("train_take", F.coalesce(train_take, F.lit(0)).cast("long"))
          .withColumn("val_start", F.when(F.col("val_take") > 0, F.col(start)))
          .withColumn("train_start", F.when(F.col("train_take") > 0, tstart)))
    lost = F.when((F.col("_V") > 0) & (end == vend) & (F.col("val_take") < F.col(n)),
                  F.col(n) - F.col("val_take")).otherwise(F.lit(0))
    return t.withColumn("lost", lost.cast("long")).drop("_V", "_T", "_vend")


def split_pieces(split: DataFrame, by: Sequence[str] = ("stage",)) -> DataFrame:
    """Explode a split result into one piece per (split, document) with a
    ``take`` count and a stream ``start`` for that split."""
    def piece(name: str) -> Column:
        return F.when(F.col(f"{name}_take") > 0, F.struct(
            F.lit(name).alias("split"), F.col(f"{name}_start").alias("pstart"), F.col(f"{name}_take").alias("take")))

    both = F.array_compact(F.array(piece("val"), piece("train")))
    return split.select("*", F.explode(both).alias("_piece")).select(*split.columns, "_piece.*")


def budget_prefix(docs: DataFrame, est_len: Column, budget: int, order: str = "doc_id",
                  by: Sequence[str] = ()) -> DataFrame:
    """K3: the documents a budgeted stream reads: those starting before the budget.

    ``est_len`` is a native length (e.g. byte length + markers); the running
    start is distributed (K1) and the filter is a plain predicate.
    """
    t = prefix_sums(docs.withColumn("_len", est_len.cast("long")), order, {"_start": F.col("_len")}, by=by)
    return t.filter(F.col("_start") < F.lit(budget)).drop("_len")


# ---------------------------------------------------------------- stream and blocks

#: tokens of a batch that a task hands on, about: what its Python process holds
#: besides the batch it reads
BATCH_TOKENS = 1 << 20
#: bytes of documents that a task of the join with the pieces reads, about
TASK_BYTES = 1 << 25


def _tokens_of(col: pa.Array):
    """Of a column of id lists, or of texts that stand for their byte ids with
    markers: the lengths of the rows, and the tokens at (row, position) pairs."""
    if pa.types.is_list(col.type):
        n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, at = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
        return n, lambda row, pos: flat[at[row] + pos]
    _, offsets, data = (whole := col.fill_null("").cast(pa.large_string())).buffers()
    off = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] > off[0] else np.zeros(1, np.uint8)
    lut, n = np.array(byte_to_id(), np.int32), np.diff(off)

    def tokens(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
        ids = lut[raw[np.clip(off[row] + pos - 1, 0, len(raw) - 1)]]
        ids[pos == 0] = BOD_ID
        ids[pos == n[row] + 1] = EOD_ID
        return ids

    return np.where(col.is_null().to_numpy(zero_copy_only=False), 0, n + 2), tokens


def _token_lists(tokens, null: pa.Array, row: np.ndarray, pos: np.ndarray, n: np.ndarray):
    """The runs of ``n`` tokens from ``pos`` on in ``row``, as (first run, last
    run, list array) of about ``BATCH_TOKENS`` tokens each; null in ``null`` rows."""
    ends, null = np.cumsum(n), null.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + BATCH_TOKENS, "right")))
        k = n[at:stop]
        off = np.append(0, np.cumsum(k))
        where = np.arange(off[-1]) + np.repeat(pos[at:stop] - off[:-1], k)
        ids = tokens(np.repeat(row[at:stop], k), where)
        yield at, stop, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=pa.array(null[row[at:stop]]))
        at = stop


def _ids_type(df: DataFrame, ids: str) -> T.DataType:
    kind = df.schema[ids].dataType
    return kind if isinstance(kind, T.ArrayType) else T.ArrayType(T.IntegerType())


def cut_to_take(pieces: DataFrame, ids: str = "ids", take: str = "take") -> DataFrame:
    """The pieces with the first ``take`` ids of each. ``ids`` are id lists, or
    texts, whose byte ids with markers are made here, a bounded batch at a time."""
    rest = [c for c in pieces.columns if c != ids]

    def run(batches):
        for b in batches:
            have, tokens = _tokens_of(b.column(ids))
            n = np.minimum(have, np.maximum(b.column(take).to_numpy(), 0))
            for i, j, lists in _token_lists(tokens, b.column(ids).is_null(), np.arange(len(n)), np.zeros(len(n), np.int64), n):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in rest), lists], names=[*rest, ids])

    fields = [*(pieces.schema[c] for c in rest), T.StructField(ids, _ids_type(pieces, ids))]
    return pieces.select(*rest, ids).mapInArrow(run, T.StructType(fields))


def spread(docs: DataFrame, key: str, size: int) -> DataFrame:
    """``docs`` (``size`` bytes or so) dealt by ``key`` over tasks of about
    ``TASK_BYTES``, however large they are, for a join by that key."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(tasks, -(-size // TASK_BYTES)), key)


def flat_stream(pieces: DataFrame, ids: str = "ids", start: str = "pstart",
                by: Sequence[str] = ("stage", "split")) -> DataFrame:
    """K4: one row per token ``(pos, id)`` -- for inspection only."""
    return pieces.select(*by, F.posexplode(ids).alias("i", "id"), F.col(start)).select(
        *by, (F.col(start) + F.col("i")).alias("pos"), "id")


def stream_lengths(pieces: DataFrame, take: str = "take",
                   by: Sequence[str] = ("stage", "split")) -> DataFrame:
    return pieces.groupBy(*by).agg(F.sum(take).cast("long").alias("stream_len"))


def wanted_pieces(pieces: DataFrame, L: int | Column, first: int | Column = 0, last: int | Column | None = None,
                  start: str = "pstart", take: str = "take") -> DataFrame:
    """The block index: of the pieces of a stream those that hold a token of the
    blocks ``first .. last`` (to the stream's end without ``last``). Block ``b``
    is the positions ``bL .. bL + L``, so a range of blocks is one range of
    positions and a plain predicate on the piece table, before any ids are read
    or made; on a stored stream it is pushed into the scan (``read_blocks``)."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    p = pieces.filter(F.col(start) + F.col(take) > lit(first) * lit(L))
    return p if last is None else p.filter(F.col(start) <= (lit(last) + 1) * lit(L))


def make_blocks(pieces: DataFrame, L: int | Column, ids: str = "ids", start: str = "pstart",
                take: str = "take", by: Sequence[str] = ("stage", "split"),
                with_xy: bool = True, lens: DataFrame | None = None,
                first: int | Column = 0, last: int | Column | None = None, alone: str | None = None) -> DataFrame:
    """K5/K6: fixed windows of ``L + 1`` tokens at stride ``L``.

    Block ``b`` holds stream positions ``bL .. bL+L``; there are
    ``(len - 1) div L`` blocks and the rest is dropped. A piece ``[s, e)`` feeds
    blocks ``max(0, ceil(s/L) - 1) .. floor((e-1)/L)``. Of ``ids`` the first
    ``take`` count; they are id lists, or texts that stand for their byte ids
    with markers. ``lens`` gives the stream lengths where they are
    known without the ids; it must be given when ``pieces`` are only the
    ``wanted_pieces`` of the blocks ``first .. last``. ``alone`` names a
    column of the position before which no other piece has a piece's positions
    (null: none has); all that pieces hold of a block they share stands in it,
    one after the other.
    """
    by = list(by)
    Lc = F.lit(L) if isinstance(L, int) else L
    lens = (stream_lengths(pieces, take, by) if lens is None else lens).withColumn(
        "total_blocks", F.floor((F.col("stream_len") - 1) / Lc).cast("long"))
    # a row per stream: a shuffle by it would bring all ids of a stream to one task
    p = pieces.join(F.broadcast(lens), on=by, how="inner")
    s = F.col(start)
    e = F.col(start) + F.col(take)
    bound = lambda x: F.lit(x) if isinstance(x, int) else x
    lo = F.greatest(bound(first), F.ceil(s / Lc) - 1)
    hi = F.least(F.floor((e - 1) / Lc), F.col("total_blocks") - 1, *([] if last is None else [bound(last)]))
    long = lambda x, name: x.cast("long").alias(name)
    p = p.filter(hi >= lo).select(*by, long(s, "_s"), long(e, "_e"), long(lo, "_lo"), long(hi, "_hi"), long(Lc, "_L"),
                                  long(F.coalesce(F.lit(None) if alone is None else F.col(alone), F.lit((1 << 63) - 1)), "_alone"), ids)
    # most blocks lie within one piece and are whole as they are cut; only the
    # parts at the ends of the pieces are put together by a shuffle
    blocks = _block_parts(p, by, ids, whole=True).select(*by, "block_idx", F.col("_part").alias("tokens"))
    blocks = blocks.unionByName(_block_parts(p, by, ids, whole=False).groupBy(*by, "block_idx").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_part"))),
                              lambda x: x["_part"])).alias("tokens")))
    if with_xy:
        blocks = blocks.select(*by, "block_idx", "tokens",
                               F.slice("tokens", 1, Lc).alias("x"),
                               F.slice("tokens", 2, Lc).alias("y"))
    return blocks


def _block_parts(pieces: DataFrame, by: list[str], ids: str, whole: bool) -> DataFrame:
    """(by, block_idx, _from, _part): what the pieces ``[_s, _e)`` have of their
    blocks ``_lo .. _hi``; the blocks that a piece holds whole, or the others."""
    def run(batches):
        for b in batches:
            have, tokens = _tokens_of(b.column(ids))
            s, e, lo, hi, L = (b.column(c).to_numpy() for c in ("_s", "_e", "_lo", "_hi", "_L"))
            k = hi - lo + 1
            row = np.repeat(np.arange(len(k)), k)
            block = np.arange(len(row)) + np.repeat(lo - (np.cumsum(k) - k), k)
            frm = np.maximum(s[row], block * L[row])
            to = np.minimum(np.minimum(e, s + have)[row], block * L[row] + L[row] + 1)
            alone = block * L[row] + L[row] < b.column("_alone").to_numpy()[row]
            keep = np.flatnonzero(((to - frm == L[row] + 1) & alone) == whole)
            row, block, frm, n = row[keep], block[keep], frm[keep], np.maximum(to - frm, 0)[keep]
            for i, j, lists in _token_lists(tokens, b.column(ids).is_null(), row, frm - s[row], n):
                at = pa.array(row[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in by), pa.array(block[i:j]), pa.array(frm[i:j]), lists],
                                                 names=[*by, "block_idx", "_from", "_part"])

    fields = [*(pieces.schema[c] for c in by), T.StructField("block_idx", T.LongType()), T.StructField("_from", T.LongType()),
              T.StructField("_part", _ids_type(pieces, ids))]
    return pieces.mapInArrow(run, T.StructType(fields))


def resume_block(tokens_seen: int | Column, L: int | Column) -> Column:
    """K7: the first block after ``tokens_seen`` tokens, ``tokens_seen div L`` (current L)."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.floor(lit(tokens_seen) / lit(L)).cast("long")


def epoch_wrap(blocks: DataFrame, total_blocks: Column, epochs: int, tokens_seen: int, L: int) -> DataFrame:
    """K8/K9: the fetches that serve the rows of ``blocks`` (one stream's blocks
    by ``block_idx``) ``epochs`` times over, from the block where ``tokens_seen``
    tokens end: fetch ``i`` serves block ``(i + skip) mod total``. ``epoch_mark``
    flags a fetch at which the index went backwards. Every block names its own
    fetches, so nothing is joined or shuffled."""
    start = F.pmod(F.lit(tokens_seen // L), F.col("_tb"))
    t = blocks.withColumn("_tb", total_blocks).withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
    t = t.withColumn("fetch_i", F.col("_e") * F.col("_tb") + F.col("block_idx") - start)
    t = t.filter((F.col("fetch_i") >= 0) & (F.col("fetch_i") < F.col("_tb") * epochs))
    mark = (F.col("fetch_i") > 0) & (F.col("block_idx") == 0) & (F.col("_tb") > 1)
    return t.withColumn("epoch_mark", mark).drop("_tb", "_e")


# ---------------------------------------------------------------- segments and visibility


def _lengths(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Segment lengths of all blocks of a batch end to end, and how many each has."""
    n = blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = blocks.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    last = np.zeros(len(flat), bool)
    last[ends[n > 0] - 1] = True  # the end of a block closes its last segment
    cut = np.flatnonzero((flat == EOD_ID) | last)
    return np.diff(cut, prepend=-1), np.diff(np.searchsorted(cut, ends), prepend=0)


def _lists(n: np.ndarray, values: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    off = np.append(0, np.cumsum(n)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.int32)), mask=null)


def doc_segments(tokens: Column) -> Column:
    """Segment id per token = number of EOD tokens strictly before it
    (the EOD belongs to the document it closes; ids start at 0). One numpy pass
    over a batch of blocks."""
    @F.arrow_udf("array<int>")
    def segments(blocks: pa.Array) -> pa.Array:
        lens, k = _lengths(blocks)
        number = np.arange(len(lens)) - np.repeat(np.cumsum(k) - k, k)
        n = blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _lists(n, np.repeat(number, lens))

    return segments(tokens)


def segment_lengths(tokens: Column) -> Column:
    """Lengths of the document segments of a block, from the places of its EOD
    tokens: one numpy pass over a batch of blocks."""
    @F.arrow_udf("array<int>")
    def lengths(blocks: pa.Array) -> pa.Array:
        lens, k = _lengths(blocks)
        return _lists(k, lens, blocks.is_null())

    return lengths(tokens)


def visible_pairs(tok_rows: DataFrame, key: Sequence[str] = ("block_idx",)) -> DataFrame:
    """(q, k) pairs a query position may attend to: same segment, k <= q.

    Equi-join on (block, segment) with a ``k <= q`` residual, so the plan is a
    hash / sort-merge join, never a cartesian product. Input rows:
    ``key + pos + segment``.
    """
    key = list(key)
    q = tok_rows.select(*key, "segment", F.col("pos").alias("q"))
    k = tok_rows.select(*key, "segment", F.col("pos").alias("k"))
    return q.join(k, on=[*key, "segment"], how="inner").filter(F.col("k") <= F.col("q"))


def block_token_rows(blocks: DataFrame, tokens: str = "x", key: Sequence[str] = ("block_idx",)) -> DataFrame:
    """Per-token rows with segment ids (row form of K12)."""
    key = list(key)
    t = blocks.select(*key, F.posexplode(tokens).alias("pos", "id"))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eod = F.when(F.col("id") == EOD_ID, 1).otherwise(0)
    return t.withColumn("segment", (F.sum(eod).over(w) - eod).cast("int"))


def mask_cost(blocks: DataFrame, tokens: str = "x", key: Sequence[str] = ("block_idx",)) -> DataFrame:
    """Visible pairs per block in closed form: sum n(n+1)/2 over segments,
    versus L(L+1)/2 for a causal-only mask."""
    key = list(key)
    t = blocks.select(*key, F.size(tokens).cast("long").alias("L"), segment_lengths(F.col(tokens)).alias("_segs"))
    vis = F.aggregate("_segs", F.lit(0).cast("long"),
                      lambda acc, n: acc + ((n.cast("long") * (n + 1)) / 2).cast("long"))
    L = F.col("L")
    return t.select(*key, "L", F.size("_segs").alias("segments"),
                    vis.alias("visible_pairs"), (L * (L + 1) / 2).cast("long").alias("causal_pairs"))


def tile_to_length(df: DataFrame, seq: str, L: int, rows: int) -> DataFrame:
    """Repeat ``seq`` until it reaches ``L`` tokens, cut to ``L`` and copy
    it to ``rows`` rows (``row_id`` 0..rows-1)."""
    n = F.size(seq)
    reps = F.when(n < L, F.floor(F.lit(L) / n) + 1).otherwise(F.lit(1)).cast("int")
    tiled = F.slice(F.flatten(F.array_repeat(F.col(seq), reps)), 1, L)
    return df.withColumn("tiled", tiled).withColumn("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
