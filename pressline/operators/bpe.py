"""Byte-level BPE: word histogram, model, encoding, decoding, store.

The merges are learned in ``bpe_train``. The only state on the driver is the
model itself, at most ``vocab_size`` entries.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.bytes_ import byte_to_char, byte_to_id
from pressline.functions.fixed import N_SPECIAL, SPECIAL_TOKENS
from pressline.functions.text import pretokenize_with_specials, special_map
from pressline.session import materialize_table


# ------------------------------------------------------------------ histogram


def words_of(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per word occurrence ``(*keep, wpos, word)``."""
    return docs.select(*keep, F.posexplode(pretokenize_with_specials(F.col(text))).alias("wpos", "word"))


def tasks(df: DataFrame) -> int:
    """Tasks of a heavy step: the shuffle's partitions, every core at least."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` dealt row by row over all tasks if they lie in fewer files than
    there are cores. One task scans a row group, however large; taking its words
    costs far more than moving its texts."""
    enough = len(docs.inputFiles()) >= docs.sparkSession.sparkContext.defaultParallelism
    return docs if enough else docs.repartition(tasks(docs))


def word_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """T5: distinct words and their counts (specials excluded). Partial
    aggregation before the shuffle absorbs Zipf-hot words."""
    w = dealt(docs.select(text)).select(F.explode(pretokenize_with_specials(F.col(text))).alias("word"))
    w = w.filter(F.element_at(special_map(), F.col("word")).isNull())
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


# ------------------------------------------------------------------ model


@dataclass
class BpeModel:
    """Vocabulary and ordered merges. ``tokens[i]`` is the byte-level string of id i."""

    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)  # (left, right, new_id)
    rounds: int = 0

    @classmethod
    def base(cls) -> "BpeModel":
        chars = byte_to_char()
        ids = byte_to_id()
        alpha = [""] * 256
        for b in range(256):
            alpha[ids[b] - N_SPECIAL] = chars[b]
        return cls(tokens=[tok for _, tok, _ in SPECIAL_TOKENS] + alpha)

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a, b, n, self.tokens[a], self.tokens[b]) for r, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left_id int, right_id int, new_id int, left string, right string")


# ------------------------------------------------------------------ encode / decode


def _encoder(model: BpeModel):
    ranks = {(a, b): (r, n) for r, (a, b, n) in enumerate(model.merges)}
    lut = byte_to_id()
    specials = {tok: i for _, tok, i in SPECIAL_TOKENS}

    def enc(word: str) -> list[int]:
        """Merges by rank, then from the left, from a heap over a linked list:
        n log n steps however long the word."""
        if word in specials:
            return [specials[word]]
        ids = [lut[b] for b in word.encode("utf-8")]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two was merged before
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    p = ids[k], ids[after[k]]
                    if p in ranks:
                        heapq.heappush(heap, (*ranks[p], k, *p))
        return [x for x in ids if x >= 0]

    return enc


ENCODE_CACHE_WORDS = 200_000
# encoded words by model, as 4-byte ids, kept by a Python worker from task to task
_ENCODED: dict[int, dict[str, bytes]] = {}


def _encoded_words(model_key: int) -> dict[str, bytes]:
    if model_key not in _ENCODED:
        _ENCODED.clear()  # one model at a time
    return _ENCODED.setdefault(model_key, {})


def encode_word_arrays(words: Column, model: BpeModel) -> Column:
    """ids of a document from its word array: an Arrow UDF applies the merge
    ranks to the distinct words of a batch, with a bounded cache of encoded words
    that a worker keeps from task to task (Zipf: most words are cache hits), and
    lays their ids end to end. The merge table travels with the function and is
    bounded by the vocabulary size."""
    enc, key = _encoder(model), hash(tuple(model.merges))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_udf(docs: pa.Array) -> pa.Array:
        cache, parts = _encoded_words(key), []
        coded = docs.flatten().dictionary_encode()
        for w in coded.dictionary.to_pylist():
            r = cache.get(w)
            if r is None:
                r = np.array(enc(w), np.int32).tobytes()
                if len(cache) < ENCODE_CACHE_WORDS:
                    cache[w] = r
            parts.append(r)
        n = np.array([len(r) // 4 for r in parts], np.int64)
        at, ids = np.cumsum(n) - n, np.frombuffer(b"".join(parts), np.int32)
        word = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(n[word]))  # of the words' ids
        ids = ids[np.arange(ends[-1]) + np.repeat(at[word] - ends[:-1], n[word])]
        each = docs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = ends[np.append(0, np.cumsum(each))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=docs.is_null())

    return encode_udf(words)


def bpe_encode(docs: DataFrame, model: BpeModel, key: str = "doc_id", text: str = "text",
               bod: bool = True, eod: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents -> ids, map-only: the JVM pre-tokenizer (the same one the
    histogram used) splits the text, one numpy pass per Arrow batch applies
    the merges, and the markers are added natively. Nothing is shuffled. A
    null text counts as empty."""
    ids = encode_word_arrays(pretokenize_with_specials(F.coalesce(F.col(text), F.lit(""))), model)
    parts = ([F.array(F.lit(1))] if bod else []) + [ids] + ([F.array(F.lit(2))] if eod else [])
    return docs.select(key, *keep, F.concat(*parts).alias("ids"))


def token_table(docs: DataFrame, model: BpeModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """The corpus as trained ids, ``(doc_id, *keep, ids, n)``: encoded once and
    written, so that lengths, offsets, split, blocks and store read this table
    and never the texts."""
    return materialize_table(bpe_encode(dealt(docs), model, keep=keep).withColumn("n", F.size("ids").cast("long")), "corpus-tokens")


def bpe_decode(ids_df: DataFrame, model: BpeModel, spark: SparkSession, key: str = "doc_id",
               ids: str = "ids") -> DataFrame:
    """Ids -> text; special ids are skipped. Map-only: the bytes of every
    token (bounded by vocab_size) travel with the function."""
    back = {c: b for b, c in enumerate(byte_to_char())}
    raw = [b"" if i < N_SPECIAL else bytes(back[c] for c in t) for i, t in enumerate(model.tokens)]

    @F.pandas_udf(T.StringType())
    def decode(rows: pd.Series) -> pd.Series:
        return pd.Series([b"".join([raw[i] for i in r]).decode("utf-8", "replace") for r in rows], dtype=object)

    return ids_df.select(key, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))).alias("text"))


# ------------------------------------------------------------------ store


def save_model(model: BpeModel, spark: SparkSession, root: str, samples: int) -> str:
    """Vocab, merges and info under ``root/vocab=<V>/samples=<N>``."""
    path = f"{root.rstrip('/')}/vocab={len(model.tokens)}/samples={samples}"
    model.vocab_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_df(spark).write.mode("overwrite").parquet(f"{path}/merges")
    spark.createDataFrame([(len(model.tokens), samples, len(model.merges), model.rounds)],
                          "vocab_size int, samples int, merges int, rounds int").write.mode("overwrite").json(f"{path}/info")
    return path


def load_model(spark: SparkSession, root: str, vocab_size: int, samples: int) -> BpeModel | None:
    """The stored model for (vocab_size, samples), or ``None`` when absent
    (only the first phase may train; later phases must load)."""
    path = f"{root.rstrip('/')}/vocab={vocab_size}/samples={samples}"
    try:
        vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    except AnalysisException as e:  # an unreadable model is an error, not an absent one
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return BpeModel(tokens=[r["token"] for r in vocab],
                    merges=[(r["left_id"], r["right_id"], r["new_id"]) for r in merges])
