"""The public word-punct tokenizer as Spark columns: counting stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond what Java's ``\s`` holds, so that it means the same as Unicode white space.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD, PUNCT = r"[0-9A-Z_a-z\p{L}\p{N}]", rf"[^\p{{L}}\p{{N}}_{SPACE}]"
#: One token, never given back in part.
TOKEN = rf"(?:{WORD}++|{PUNCT}++)"


def token_count(text: Column) -> Column:
    """Tokens of ``text``; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
