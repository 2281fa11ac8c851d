"""Chat formatting with cumulative-snapshot collapse.

A chat that was logged after every turn stands in the log as many
conversations, each a prefix of the next. A rolling hash over the turns names
every prefix; a conversation whose whole hash is a proper prefix of another is
anti-joined away, equal ones are one, and what is left is rendered.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

START, END = "<|im_start|>", "<|im_end|>"


def _render(turns: list[tuple[str, str]]) -> str:
    """A marker inside a turn is broken up, so that no text can forge one."""
    safe = lambda s: s.replace("<|im_", "< |im_")
    return "".join(f"{START}{safe(r)}\n{safe(t)}{END}\n" for r, t in turns)


def _prefixes(turns: list[tuple[str, str]]) -> list[bytes]:
    """128-bit hash of the first 1, 2, ... turns."""
    out, h = [], b""
    for role, text in turns:
        r, t = role.encode(), text.encode()
        h = xxhash.xxh3_128_digest(h + len(r).to_bytes(8, "little") + r + t)
        out.append(h)
    return out


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns long, copies long, text): the maximal conversations.

    Turns are ordered by turn, then role and text, nulls first; exact repeats
    of a row are one turn; a null role or text is empty. Rows without a
    conv_id form one conversation without one. Of equal conversations the
    least conv_id stands for all, ``copies`` says how many there are. Extra
    columns are not read. A conversation is gathered in one row, as its
    rendering is one text; copies and prefixes are matched by hashes that are
    pre-aggregated, however many share one."""
    turn = F.struct("turn", "role", "text")
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [[(t["role"] or "", t["text"] or "") for t in x] for x in b.column(1).to_pylist()]
            pre = [_prefixes(x) for x in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([x[-1] for x in pre], pa.binary()),
                 pa.array([x[:-1] for x in pre], pa.list_(pa.binary())), pa.array([_render(x) for x in got], pa.string())],
                names=["conv_id", "n_turns", "whole", "shorter", "text"])

    schema = f"conv_id {kind}, n_turns long, whole binary, shorter array<binary>, text string"
    named = cut(whole.mapInArrow(run, schema), "conversations")
    shorter = named.select(F.explode("shorter").alias("whole")).distinct()
    best = named.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    best = best.join(shorter, "whole", "left_anti").select("whole", F.col("conv_id").alias("_id"), "copies")
    kept = named.join(best, (named["whole"] == best["whole"]) & named["conv_id"].eqNullSafe(best["_id"]))
    return kept.select("conv_id", "n_turns", "copies", "text")
