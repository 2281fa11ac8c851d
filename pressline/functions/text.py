"""Scalar text functions (T3, T4, T9-T11) as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.fixed import PRETOKEN_PATTERN, SPECIAL_TOKENS

SPECIAL_ALT = "|".join(re.escape(tok) for _, tok, _ in SPECIAL_TOKENS)
# a special literal, or a maximal run of text that does not start one
SEGMENT_PATTERN = f"(?s){SPECIAL_ALT}|(?:(?!{SPECIAL_ALT}).)+"


def pretokenize(text: Column) -> Column:
    """Words of the byte-level pre-tokenizer (no added prefix space)."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), 0)


def special_map() -> Column:
    return F.create_map(*[x for _, tok, i in SPECIAL_TOKENS for x in (F.lit(tok), F.lit(i))])


def segments(text: Column) -> Column:
    """T4: the text cut into special literals and the runs between them."""
    return F.regexp_extract_all(text, F.lit(SEGMENT_PATTERN), 0)


def pretokenize_with_specials(text: Column) -> Column:
    """Words, with each literal special token kept whole (it becomes its
    special id when encoded); the runs between are pre-tokenized separately,
    as the reference's tokenizer does. A text without a special literal is one
    run, so the search for them, character by character, is left out."""
    sm = special_map()
    parts = F.flatten(F.transform(
        segments(text),
        lambda s: F.when(F.element_at(sm, s).isNotNull(), F.array(s))
        .otherwise(F.regexp_extract_all(s, F.lit(PRETOKEN_PATTERN), 0))))
    return F.when(has_special(text), parts).otherwise(pretokenize(text))


def has_special(text: Column) -> Column:
    """T4 audit: does the text contain any literal special token."""
    cond = F.lit(False)
    for _, tok, _ in SPECIAL_TOKENS:
        cond = cond | F.contains(text, F.lit(tok))
    return cond


def chat_template(messages: Column, bod: str = "<|begin_of_doc|>", eod: str = "<|end_of_doc|>") -> Column:
    """Per message ``BOD + role + "\\n" + content + EOD``, concatenated.

    ``messages`` is ``ARRAY<STRUCT<turn, role, content>>``; it is sorted by
    turn first."""
    ordered = F.array_sort(messages)
    return F.array_join(F.transform(ordered, lambda m: F.concat(F.lit(bod), m["role"], F.lit("\n"),
                                                                m["content"], F.lit(eod))), "")


def humanize_tokens(v: Column) -> Column:
    """``>= 1e9 -> x.xxxB``, ``>= 1e6 -> M``, ``>= 1e3 -> K``, else with separators."""
    return (F.when(v >= 1e9, F.format_string("%.3fB", v / 1e9))
            .when(v >= 1e6, F.format_string("%.3fM", v / 1e6))
            .when(v >= 1e3, F.format_string("%.3fK", v / 1e3))
            .otherwise(F.format_number(v, 0)))
