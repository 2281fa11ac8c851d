"""DuckDB twins of the tokenizer: pre-tokens, BPE training one merge at a time
by a recursive query, and the encoded corpus.

A word is a string of its symbols, each as ``,id,``: ``replace`` of
``,a,,b,`` by ``,new,`` then merges from the left without overlaps.
"""

from __future__ import annotations

from pressline.functions.bytes_ import byte_id_sql
from pressline.functions.fixed import N_SPECIAL, SPECIAL_TOKENS

SPECIAL_ALT_RE2 = "|".join(t.replace("|", "[|]") for _, t, _ in SPECIAL_TOKENS)
VOCAB = 8192             # specials + 256 alphabet + 7 932 merges: the registered tokenizer
SMALL_VOCAB = 300        # 40 merges: as far as the recursive query below is affordable
FIRST_MERGE = N_SPECIAL + 256


def char_sql(b: str) -> str:
    return (f"CASE WHEN {b} BETWEEN 33 AND 126 OR {b} BETWEEN 161 AND 172 OR {b} >= 174 THEN chr({b}) "
            f"WHEN {b} <= 32 THEN chr(256 + {b}) WHEN {b} BETWEEN 127 AND 160 THEN chr(256 + 33 + {b} - 127) "
            f"ELSE chr(256 + 67) END")


# RE2 has no lookahead: a mark goes before the last blank of a run that a word
# follows, so that the run ends there; the words are then taken around the marks
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = r"\x{e000}"


def pretoken_sql(text: str) -> str:
    """DuckDB list of the pre-tokens of ``text``."""
    marked = rf"regexp_replace({text}, '([{_BLANK}])([{_BLANK}][^{_BLANK}])', '\1' || chr(57344) || '\2', 'g')"
    return (rf"regexp_extract_all({marked}, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+"
            rf"| ?[^{_BLANK}\p{{L}}\p{{N}}{_MARK}]+|[{_BLANK}]+')")


_SPECIALS = ", ".join(f"'{t}'" for _, t, _ in sorted(SPECIAL_TOKENS, key=lambda x: x[2]))
_BYTE = byte_id_sql("CAST(('0x' || h) AS INTEGER)")

SQL_TRAIN = f"""
docparts AS (
  SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{SPECIAL_ALT_RE2}') AS pt,
         regexp_extract_all(coalesce(text, ''), '{SPECIAL_ALT_RE2}') AS sp FROM documents
),
docwords AS (
  SELECT doc_id, flatten(list_transform(generate_series(1, len(pt)), lambda k: {pretoken_sql('pt[k]')}
                         || CASE WHEN k <= len(sp) THEN [sp[k]] ELSE CAST([] AS VARCHAR[]) END)) AS w FROM docparts
),
tokword AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docwords),
hist AS (SELECT word, count(*) AS freq FROM tokword WHERE word NOT IN ({_SPECIALS}) GROUP BY word),
step AS (
  SELECT 0 AS i, word, freq, 0 AS l, 0 AS r,
         array_to_string(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ',' || {_BYTE} || ','), '') AS sym
  FROM hist
  UNION ALL
  SELECT t.i + 1, t.word, t.freq, b.l, b.r,
         replace(t.sym, ',' || b.l || ',,' || b.r || ',', ',' || ({FIRST_MERGE} + t.i) || ',')
  FROM step t, (SELECT l, r FROM (SELECT freq, CAST(unnest(s[:-2]) AS INTEGER) AS l, CAST(unnest(s[2:]) AS INTEGER) AS r
                                  FROM (SELECT freq, string_split(trim(sym, ','), ',,') AS s FROM step) WHERE len(s) > 1)
                GROUP BY l, r ORDER BY sum(freq) DESC, l, r LIMIT 1) b
  WHERE t.i < {SMALL_VOCAB - FIRST_MERGE}
)"""

SQL_MERGES = f"""
merges AS (SELECT DISTINCT i - 1 AS rank, l AS left_id, r AS right_id, {FIRST_MERGE} - 1 + i AS new_id FROM step WHERE i > 0),
tokmap AS (
  SELECT 0 AS i, [{_SPECIALS}] || list(c ORDER BY id) AS m
  FROM (SELECT {char_sql('b')} AS c, {byte_id_sql('b')} AS id FROM (SELECT CAST(range AS INTEGER) AS b FROM range(256)))
  UNION ALL
  SELECT t.i + 1, list_append(t.m, t.m[g.left_id + 1] || t.m[g.right_id + 1]) FROM tokmap t JOIN merges g ON g.rank = t.i
),
merge_rows AS (
  SELECT g.rank, g.left_id, g.right_id, g.new_id, m[g.left_id + 1] AS "left", m[g.right_id + 1] AS "right"
  FROM merges g, (SELECT arg_max(m, i) AS m FROM tokmap)
)"""

# the corpus with its ids (markers included) in the place of the text
SQL_ENCODED = f"""
enc AS (
  SELECT word, list_transform(string_split(trim(sym, ','), ',,'), lambda x: CAST(x AS INTEGER)) AS ids
  FROM step WHERE i = (SELECT max(i) FROM step)
  UNION ALL
  SELECT * FROM (VALUES {", ".join(f"('{t}', [{i}])" for _, t, i in SPECIAL_TOKENS)})
),
docenc AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM tokword JOIN enc USING (word) GROUP BY doc_id),
documents_tok AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, length(d.text) AS chars, [1] || coalesce(e.ids, CAST([] AS INTEGER[])) || [2] AS text
  FROM documents d LEFT JOIN docenc e USING (doc_id)
)"""
