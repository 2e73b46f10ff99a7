"""Column builders that every text operator shares. All are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as a class body for Java and RE2 alike.
WS = r"\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters as a string, for the native trimming functions.
WS_CHARS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]+(?:['.’:][\p{L}\p{N}_]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHARS_PER_TOKEN, DEFAULT_MAX_TOKENS, BYPASS_CHARS = 4, 2048, 1000


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column that is evaluated once a row, however often it is used later.

    A one-row generator keeps the optimiser from copying a long expression into each use.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that the table does not have (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is evaluated once, however often ``fn`` uses it, within one expression."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def flat_lines(t: Column) -> Column:
    """The text with line breaks of one character and none at the end."""
    one = bound(t, lambda x: F.when(x.contains("\r\n"), F.replace(x, F.lit("\r\n"), F.lit("\n"))).otherwise(x))
    return bound(one, lambda x: F.when(x.endswith("\n"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines(t: Column) -> Column:
    """Lines of a text: a final line break gives no empty last line; '' and null have none."""
    return bound(t, lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(flat_lines(x), "\n")))


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def ascii_lower(t: Column) -> Column:
    return F.translate(t, UPPER, LOWER)


def trim(t: Column) -> Column:
    return F.btrim(t, F.lit(WS_CHARS))


def trim_end(t: Column) -> Column:
    return F.rtrim(t, F.lit(WS_CHARS))


def trim_start(t: Column) -> Column:
    return F.ltrim(t, F.lit(WS_CHARS))


def json_value(t: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else null.

    The parser itself stops after the first value; inside a list, what follows is seen.
    """
    v = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def token_count(t: Column) -> Column:
    """Estimate: the larger of a quarter of the characters and 1.3 per word, both rounded up; 0 for ''."""
    t = F.coalesce(t, F.lit(""))
    by_chars = F.ceil(F.length(t) / CHARS_PER_TOKEN).cast("long")
    by_words = F.floor((13 * F.regexp_count(t, F.lit(WORD)) + 9) / 10).cast("long")
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.greatest(by_chars, by_words, F.lit(1).cast("long")))


def byte_floor(t: Column, n: int | Column) -> Column:
    """Longest prefix of whole characters within n UTF-8 bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    raw = t.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, F.lit(1), n - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(t) <= n, t).otherwise(F.coalesce(*tries, F.lit("")))


def truncate(t: Column, max_tokens: int | Column) -> Column:
    """Cut to max_tokens * 4 bytes, with a marker, if the estimate is above max_tokens."""
    max_tokens = max_tokens if isinstance(max_tokens, int) else max_tokens.cast("int")
    return F.when(token_count(t) <= max_tokens, t).otherwise(F.concat(byte_floor(t, max_tokens * CHARS_PER_TOKEN), F.lit("\n…[truncated]")))


def first_sentence(t: Column, max_bytes: int) -> Column:
    """Up to the first of . ! ? and max_bytes; an ellipsis tells that something was cut."""
    flat = F.regexp_replace(t, "\n", " ")
    head = F.regexp_extract(flat, r"^[^.!?]*[.!?]?", 0)
    cut = byte_floor(head, max_bytes)
    return F.concat(trim(cut), F.when(F.octet_length(flat) > F.octet_length(cut), F.lit("…")).otherwise(F.lit("")))


def metrics(before: Column, after: Column) -> Column:
    """original_tokens, result_tokens and the share saved (0 for empty input or growth)."""
    a, b = token_count(before), token_count(after)
    return F.struct(a.alias("original_tokens"), b.alias("result_tokens"), F.when((a == 0) | (b >= a), F.lit(0.0)).otherwise((a - b) / a).alias("reduction_ratio"))
