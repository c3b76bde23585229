"""Tokens of mixed scripts, and phrases of clip requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A CJK character that begins a token stands alone; otherwise a run of letters, digits, "_" or "-".
TOKEN = r"([\x{4e00}-\x{9fff}]|[\p{L}\p{N}_-]+)"
_CJK = r"[\x{4e00}-\x{9fff}]"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def trim_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[、。，]+\z", "")


def detokenize(tokens: Column) -> Column:
    """CJK tokens are joined bare, others after a space."""
    bare = lambda t: (t >= "一") & (t <= "鿿")
    joined = F.array_join(F.transform(tokens, lambda t: F.when(bare(t), t).otherwise(F.concat(F.lit(" "), t))), "")
    return trim_marks(F.ltrim(joined))


def normalize_phrase(text: Column) -> Column:
    """Punctuation goes, CJK characters stand apart by single spaces, one space at the end goes."""
    plain = F.regexp_replace(text, "[，。！？、,.?!]", "")
    spaced = F.regexp_replace(plain, f"({_CJK})", "$1 ")
    return F.regexp_replace(F.regexp_replace(spaced, f"(?<=[^ ])({_CJK})", " $1"), r" \z", "")


def filled(text: Column) -> Column:
    """Whether there is any text but white space; null counts as none."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
