"""Post-training and long-context data operators.

Per-prompt selections use aggregates (``max_by`` / ``min_by`` over a struct
key) that are partially aggregated before the shuffle, so a prompt holding a
large share of the candidates never lands whole on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.hashing import Bloom, span_hashes, word_gram_spans
from pressline.session import materialize_table


def pair_loss(r_chosen: Column, r_rejected: Column) -> Column:
    """``-log(sigmoid(rc - rr))`` in the stable form ``log1p(exp(-d))``
    (``-d + log1p(exp(d))`` for negative d)."""
    d = r_chosen - r_rejected
    return F.when(d >= 0, F.log1p(F.exp(-d))).otherwise(-d + F.log1p(F.exp(d)))


def build_pairs(cands: DataFrame, prompt: str = "prompt", response: str = "response", score: str = "score") -> DataFrame:
    """Per prompt the best (chosen) and worst (rejected) response; ties
    go to the lower response id."""
    best = F.max_by(F.col(response), F.struct(F.col(score), -F.col(response)))
    worst = F.min_by(F.col(response), F.struct(F.col(score), F.col(response)))
    return cands.groupBy(prompt).agg(
        best.alias("chosen"), worst.alias("rejected"),
        F.max(score).alias("chosen_score"), F.min(score).alias("rejected_score"),
        F.count(F.lit(1)).alias("candidates"))


def best_of_k(cands: DataFrame, k: int, prompt: str = "prompt", response: str = "response",
              score: str = "score") -> DataFrame:
    """D3: among the first ``k`` candidates of each prompt (by response id)
    keep the top-scored one. The per-prompt top-k is a window group limit
    (each task keeps its own k before the shuffle)."""
    w = Window.partitionBy(prompt).orderBy(response)
    first_k = cands.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return first_k.groupBy(prompt).agg(
        F.max_by(F.col(response), F.struct(F.col(score), -F.col(response))).alias("best_response"),
        F.max(score).alias("best_score"))


def strength(quality: Column, toxic: Column) -> Column:
    """Preference strength label derived from the label table."""
    return (F.when((quality == 1) & (toxic == 0), F.lit("significantly better"))
            .when(quality == 1, F.lit("better"))
            .when(toxic == 0, F.lit("slightly better"))
            .otherwise(F.lit("negligibly better or unsure")))


def rank_pairs(ranked: DataFrame, by: Sequence[str], rank: str, item: str) -> DataFrame:
    """Ordered preference pairs (a over b) for ranks a < b within a group;
    the input is limited to a bounded number of ranks per group (three:
    edited > chosen > rejected), so the self-join emits at most three pairs."""
    by = list(by)
    a = ranked.select(*by, F.col(rank).alias("rank_a"), F.col(item).alias("preferred"))
    b = ranked.select(*by, F.col(rank).alias("rank_b"), F.col(item).alias("other"))
    return a.join(b, by).filter(F.col("rank_a") < F.col("rank_b"))


def seeded_order(seed: int, *key: Column) -> Column:
    """A reproducible shuffle key (MD5 of a seed and the row key)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def data_mix(df: DataFrame, weight: Column, key: Column, seed: int = 0) -> DataFrame:
    """Weight a row: the integer part of ``weight`` gives whole copies,
    the fraction one more copy when a seeded hash falls under it. Exact and
    reproducible, no sampling of the driver."""
    whole = F.floor(weight).cast("int")
    frac = weight - whole
    u = F.conv(F.substring(seeded_order(seed, key), 1, 7), 16, 10).cast("double") / float(1 << 28)
    n = whole + F.when(u < frac, 1).otherwise(0)
    return df.withColumn("_n", n).filter(F.col("_n") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def _gram_keys(docs: DataFrame, n: int, key: str | None, text: str, held: Bloom | None) -> DataFrame:
    """(key, h, a, b): the word n-grams of the texts that ``held`` may hold (all
    without it), by a rolling hash and by a 128-bit hash, which is their
    identity. A text is hashed in one pass; nothing is built for the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            for i, t in enumerate(texts):
                raw = t.as_py() or b""
                starts, ends = word_gram_spans(np.frombuffer(raw, np.uint8), n)
                if not len(starts):
                    continue
                h = span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
                at = np.arange(len(h)) if held is None else np.flatnonzero(held.may_hold(h))
                if not len(at):
                    continue
                full = [xxhash.xxh3_128_intdigest(raw[s:e]) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                both = np.array([((x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)) for x in full], np.int64)
                cols = [batch.column(0).take(pa.array(np.full(len(at), i)))] if key else []
                yield pa.RecordBatch.from_arrays([*cols, pa.array(h[at]), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                                 names=[*([key] if key else []), "h", "a", "b"])

    head = f"`{key}` {docs.schema[key].dataType.simpleString()}, " if key else ""
    return docs.select(*([key] if key else []), text).mapInArrow(run, f"{head}h long, a long, b long")


def holdout_check(docs: DataFrame, bench: DataFrame, n: int, key: str = "doc_id", text: str = "text",
                  bench_text: str = "text") -> DataFrame:
    """Documents that share a word n-gram (words parted by single spaces)
    with a benchmark item, with the number of their n-grams that do.

    The n-grams of every text are hashed in one rolling pass and looked up in a
    Bloom filter of the benchmark's hashes; the few that pass are joined with
    the benchmark's n-grams on 128 bits of hash. No n-gram is ever a string in
    a shuffle, and what is shuffled grows with the matches."""
    theirs = materialize_table(_gram_keys(bench, n, None, bench_text, None).distinct(), "holdout-grams")
    ours = _gram_keys(docs, n, key, text, Bloom.of(theirs, "h"))
    return ours.join(theirs.select("a", "b"), ["a", "b"]).groupBy(key).agg(F.count(F.lit(1)).alias("matched_ngrams"))


def holdout_clean(docs: DataFrame, bench: DataFrame, n: int, key: str = "doc_id", text: str = "text",
                  bench_text: str = "text") -> DataFrame:
    """``docs`` without those that share a word n-gram with the benchmark."""
    found = holdout_check(docs, bench, n, key, text, bench_text).select(F.col(key).alias("_found"))
    return docs.join(found, docs[key].eqNullSafe(found["_found"]), "left_anti")


def needle_cases(docs: DataFrame, needle: Column, depths: list[float], lengths: list[int],
                 text: str = "text", key: str = "doc_id") -> DataFrame:
    """Insert a needle at relative depth d into the first L characters
    of each document long enough; the grid is a small literal array exploded
    per document (no join)."""
    grid = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(L).alias("len")) for d in depths for L in lengths])
    t = docs.select(key, text, needle.alias("needle"), F.explode(grid).alias("cell"))
    t = t.select(key, "needle", "cell.depth", "cell.len", text).filter(F.char_length(text) >= F.col("len"))
    hay = F.substring(F.col(text), F.lit(1), F.col("len"))
    at = F.floor(F.col("depth") * F.col("len")).cast("int")
    ins = F.concat(F.substring(hay, F.lit(1), at), F.col("needle"), F.expr("substr(substring(" + text + ", 1, len), "
                                                                             "cast(floor(depth * len) as int) + 1)"))
    return t.withColumn("insert_at", at).withColumn("haystack", ins)


def needle_recall(cases: DataFrame, answer: Column, expected: Column) -> DataFrame:
    """Recall per cell of the (depth, length) grid with all totals, for
    given answers: a case counts when its answer is what the needle holds. A
    null answer is a miss. Only the cell and the hit reach the cube."""
    hit = F.when(answer == expected, 1.0).otherwise(0.0)
    return cases.select("depth", "len", hit.alias("hit")).cube("depth", "len").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("hit"), 9).alias("recall"))
