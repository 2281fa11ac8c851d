"""Byte-level alphabet and byte <-> id column expressions.

The 256-symbol alphabet maps every byte to a printable character: the bytes
that are already printable (33-126, 161-172, 174-255) keep their own code
point, the other 68 bytes take code points 256, 257, ... in byte order. Token
ids 4..259 are assigned in code-point order of the mapped character, right
after the four special ids. Everything here is derived from that rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.fixed import N_SPECIAL


def _printable(b: int) -> bool:
    return 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255


@lru_cache(maxsize=1)
def byte_to_char() -> list[str]:
    out, extra = [], 0
    for b in range(256):
        if _printable(b):
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


@lru_cache(maxsize=1)
def byte_to_id() -> list[int]:
    chars = byte_to_char()
    order = sorted(range(256), key=lambda b: ord(chars[b]))
    ids = [0] * 256
    for rank, b in enumerate(order):
        ids[b] = N_SPECIAL + rank
    return ids


@lru_cache(maxsize=1)
def id_to_byte() -> list[int]:
    inv = [0] * 256
    for b, i in enumerate(byte_to_id()):
        inv[i - N_SPECIAL] = b
    return inv


def byte_id_sql(b: str) -> str:
    """SQL CASE for the byte -> id rule (used by oracle queries, DuckDB syntax)."""
    return (
        f"(4 + CASE WHEN {b} BETWEEN 33 AND 126 THEN {b} - 33 "
        f"WHEN {b} BETWEEN 161 AND 172 THEN 94 + {b} - 161 "
        f"WHEN {b} >= 174 THEN 106 + {b} - 174 "
        f"WHEN {b} <= 32 THEN 188 + {b} "
        f"WHEN {b} BETWEEN 127 AND 160 THEN 188 + 33 + {b} - 127 "
        f"ELSE 188 + 67 END)"
    )


def _lut(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _per_byte(text: Column, values: list[int]) -> Column:
    """ARRAY<INT> with ``values[b]`` for every UTF-8 byte b of ``text``: one
    table lookup over the buffer of an Arrow batch. Null stays null."""
    lut = np.array(values, np.int32)

    @F.arrow_udf("array<int>")
    def lookup(col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.list_(pa.int32()))
        whole = col.fill_null("").cast(pa.large_string())
        _, offsets, data = whole.buffers()
        off = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
        return pa.ListArray.from_arrays(pa.array((off - off[0]).astype(np.int32)), pa.array(lut[raw]), mask=col.is_null())

    return lookup(text)


def utf8_bytes(text: Column) -> Column:
    """ARRAY<INT> of the UTF-8 bytes of ``text``."""
    return _per_byte(text, list(range(256)))


def byte_ids(text: Column) -> Column:
    """Byte-level token ids (no merges) for ``text``."""
    return _per_byte(text, byte_to_id())


def ids_to_text(ids: Column) -> Column:
    """Decode byte-level ids back to text; special ids are skipped."""
    lut = _lut(id_to_byte())
    body = F.filter(ids, lambda i: i >= N_SPECIAL)
    hexes = F.transform(
        body, lambda i: F.lpad(F.hex(F.element_at(lut, i - N_SPECIAL + 1)), 2, "0")
    )
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")


def byte_alphabet_rows() -> list[tuple[int, str, int]]:
    """(byte, char, id) for all 256 bytes, by rule."""
    chars, ids = byte_to_char(), byte_to_id()
    return [(b, chars[b], ids[b]) for b in range(256)]


def duck_byte_ids_sql(text_expr: str) -> str:
    """DuckDB list expression of the byte-level ids of ``text_expr`` (oracle side)."""
    case = byte_id_sql("b").replace("b", "CAST(('0x' || h) AS INTEGER)")
    return f"list_transform(regexp_extract_all(hex(encode({text_expr})), '..'), lambda h: {case})"
