r"""Problem 8: cut oversized texts into pieces under a token limit, at natural boundaries where possible, with an overlap.

Method: bounded-quantifier regex extraction.  One expression with alternatives ordered by boundary strength (paragraph,
line, sentence, then any token) consumes up to the limit; one ``regexp_extract_all`` walks the text once.  Where a piece
ends tells whether its cut is natural.  The overlap is found by a lookback expression on the reversed text before each cut
and put in front of the next piece by SQL array functions.  Everything stays in the JVM and no row leaves its task.

The expression engine recurses once for every repetition it may have to give back, so tokens are consumed in atomic blocks of
``BLOCK``: its stack grows with ``limit / BLOCK + BLOCK``, not with the limit.

Stronger boundaries are preferred only while at least half of the limit is used, so a heading does not become a piece.
A piece after the first holds the overlap plus at most ``limit - overlap`` new tokens.  A stretch without a boundary that
does not fit there is cut at a token (one token is never divided), and the piece says ``forced``.

Defined results: null, empty and blank texts and texts of at most ``limit`` tokens are not oversized; :func:`split_oversized`
gives no rows for them.  White space before a token belongs to the piece of that token; white space at the very end of a
text belongs to no piece.  Repeated rows give repeated pieces; a column
that has the name of the result column is kept with a trailing underscore.  A piece above the limit is an error, never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.tokens import SPACE, TOKEN, token_count

_UNIT = rf"(?:[{SPACE}]*+{TOKEN})"
#: White space other than a line feed.
_BLANK = rf"[{SPACE}&&[^\n]]"
PARAGRAPH = rf"(?={_BLANK}*+\n{_BLANK}*+\n)"
LINE = rf"(?={_BLANK}*+\n)"
NATURAL = rf"(?={_BLANK}*+\n|(?<=[.!?])[{SPACE}]|[{SPACE}]*+\z)"


#: Tokens of an atomic block.
BLOCK = 256
#: Pieces whose lengths are summed up in one go.
GROUP = 256


def units(least: int, most: int) -> str:
    """``least`` to ``most`` tokens, as many as possible first, in blocks that are never given back in part."""
    if most <= BLOCK:
        return rf"{_UNIT}{{{least},{most}}}"
    block = rf"(?>{_UNIT}{{{BLOCK}}})"
    top, rest = divmod(most, BLOCK)
    low, over = divmod(least, BLOCK)
    if top == low:
        return rf"{block}{{{low}}}{_UNIT}{{{over},{rest}}}"
    ways = [rf"{block}{{{top - low}}}{_UNIT}{{0,{rest}}}", *([rf"{block}{{1,{top - low - 1}}}{_UNIT}{{0,{BLOCK - 1}}}"] if top - low > 1 else []), rf"{_UNIT}{{{over},{BLOCK - 1}}}"]
    return (rf"{block}{{{low}}}" if low else "") + "(?:" + "|".join(ways) + ")"


def extraction(limit: int, first: int | None = None) -> str:
    """Expression for one piece of at most ``limit`` tokens (``first`` at the start of the text)."""

    def piece(n: int) -> str:
        half = max(1, n // 2)
        full, rest = divmod(n, BLOCK)
        forced = rf"(?>(?>{_UNIT}{{{BLOCK}}}){{0,{full}}}){_UNIT}{{0,{rest}}}+" if full else rf"{_UNIT}{{1,{n}}}+"
        return rf"(?:{units(half, n)}{PARAGRAPH}|{units(half, n)}{LINE}|{units(1, n)}{NATURAL}|{forced})"

    return piece(limit) if first in (None, limit) else rf"\A{piece(first)}|(?!\A){piece(limit)}"


def oversized(df: DataFrame, text_col: str, limit: int) -> DataFrame:
    """Rows whose text has more than ``limit`` tokens."""
    # A text has no more tokens than characters: most short ones are passed over without counting.
    return df.where(F.length(text_col) > limit).where(token_count(F.col(text_col)) > limit)


def _is_natural(before: Column, after: Column) -> Column:
    """Is the cut between two neighbouring pieces a natural boundary?"""
    return after.rlike(rf"\A{_BLANK}*+\n") | (before.rlike(r"[.!?]\z") & after.rlike(rf"\A[{SPACE}]"))


def _cores(text: Column, limit: int, first: int | None = None) -> Column:
    """The pieces without their overlaps, in order; none is empty."""
    return F.filter(F.regexp_extract_all(text, F.lit(extraction(limit, first)), F.lit(0)), lambda x: x != "")


def _forced(cores: Column) -> Column:
    """For each piece: is it followed by another without a natural boundary between them?"""
    return F.transform(cores, lambda x, i: F.when(i + 1 < F.size(cores), ~_is_natural(x, F.get(cores, i + 1))).otherwise(F.lit(False)))


def _running(lengths: Column) -> Column:
    """Sums of all numbers before each: first over groups, then inside them, so that no long array is copied for every number."""
    zero = F.array().cast("array<bigint>")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / GROUP).cast("int")), lambda g: F.slice(lengths, g * GROUP + 1, F.lit(GROUP)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    sums = lambda a, base: F.aggregate(a, F.struct(zero.alias("out"), base.alias("at")), lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + x).alias("at")))["out"]
    bases = sums(F.transform(parts, total), F.lit(0).cast("bigint"))
    return F.flatten(F.zip_with(parts, bases, sums))


def pieces(text: Column, limit: int, overlap: int) -> Column:
    """Array of ``(start, overlap_chars, tokens, forced, piece_text)`` of an oversized text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    back = rf"\A(?:{TOKEN}[{SPACE}]*+){{1,{overlap}}}+"
    # Reversed, the end of a piece begins with its last token, perhaps after white space that a forced cut cannot leave.
    last = lambda x: F.reverse(F.regexp_extract(F.reverse(x), back, 0))

    def tail(c: Column, i: Column) -> Column:
        """The last ``overlap`` tokens before piece ``i``: of the piece before, or of as many as can hold them."""
        near = last(F.get(c, i - 1))
        far = last(F.array_join(F.slice(c, F.greatest(i - overlap + 1, F.lit(1)), F.least(i, F.lit(overlap))), ""))
        return F.when(i == 0, F.lit("")).when(token_count(near) >= overlap, near).otherwise(far)

    def texts(c: Column) -> Column:
        heads = F.transform(c, lambda x, i: tail(c, i)) if overlap else F.transform(c, lambda x: F.lit(""))
        parts = F.struct(c.alias("c"), _running(F.transform(c, lambda x: F.length(x).cast("bigint"))).alias("at"), heads.alias("head"), _forced(c).alias("forced"))

        def piece(p: Column, x: Column, i: Column) -> Column:
            head = F.get(p["head"], i)
            return F.struct((F.get(p["at"], i) - F.length(head)).cast("int").alias("start"), F.length(head).alias("overlap_chars"), F.get(p["forced"], i).alias("forced"), F.concat(head, x).alias("piece_text"))

        return once(parts, lambda p: F.transform(p["c"], lambda x, i: piece(p, x, i)))

    def counted(r: Column) -> Column:
        def piece(tokens: Column, x: Column, i: Column) -> Column:
            n = F.get(tokens, i)
            ok = F.when(n > limit, F.raise_error(F.concat(F.lit("a piece has "), n, F.lit(f" tokens, more than {limit}"))).cast("bigint")).otherwise(n)
            return F.struct(x["start"].alias("start"), x["overlap_chars"].alias("overlap_chars"), ok.alias("tokens"), x["forced"].alias("forced"), x["piece_text"].alias("piece_text"))

        return once(F.transform(r, lambda x: token_count(x["piece_text"])), lambda t: F.transform(r, lambda x, i: piece(t, x, i)))

    # Each ``once`` evaluates what several parts read a single time.
    once = lambda value, use: F.flatten(F.transform(F.array(value), use))
    return once(once(_cores(text, limit - overlap, limit), texts), counted)


def cut_kind(df: DataFrame, text_col: str = "text", limit: int = 512, overlap: int | None = None, out: str = "cut") -> DataFrame:
    """Oversized rows with ``out``: ``forced`` if some stretch between neighbouring boundaries exceeds the limit, else ``natural``.

    A text whose pieces all end at natural boundaries has no such stretch.  Otherwise the overlap alone may have left too little
    room for a stretch, and an exact check follows: the same extraction without overlap, which is an eighth of the limit unless given.
    """
    text = F.col(text_col)
    alone = F.exists(F.flatten(F.transform(F.array(_cores(text, limit)), _forced)), lambda x: x)
    kind = F.when(~F.exists(pieces(text, limit, limit // 8 if overlap is None else overlap), lambda p: p["forced"] & (p["tokens"] > 0)), "natural").when(alone, "forced").otherwise("natural")
    return oversized(df, text_col, limit).select(*[F.col(c).alias(f"{c}_" if c == out else c) for c in df.columns], kind.alias(out))


def split_oversized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64) -> DataFrame:
    """``(id, piece, n_pieces, start, overlap_chars, tokens, forced, piece_text)`` of every oversized text.

    ``start`` is the offset of the piece's first character in the text, counted from 0 with the overlap included.
    """
    rows = oversized(df, text_col, limit).select(F.col(id_col).alias("id"), pieces(F.col(text_col), limit, overlap).alias("p"))
    return rows.select("id", F.size("p").alias("n_pieces"), F.posexplode("p").alias("piece", "x")).select("id", "piece", "n_pieces", "x.start", "x.overlap_chars", "x.tokens", "x.forced", "x.piece_text")
