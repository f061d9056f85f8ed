"""Text expressions: trimming, splitting, markup, printable share, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space when text is trimmed.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TAG = r"<[^>]+>"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, also where `use` needs it for every array item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(value: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(_col(value), F.lit(WHITE_SPACE))


def is_blank(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def split_terms(value: Column | str) -> Column:
    """Comma list to trimmed, non-empty terms."""
    parts = F.transform(F.split(_col(value), ","), strip)
    return F.filter(parts, lambda part: part != "")


def split_form_terms(value: Column | str, language: Column | str, words: dict[str, str]) -> Column:
    """Form text to lower-case terms; in Urdu mode single words are looked up."""
    tokens = F.transform(F.split(F.coalesce(_col(value), F.lit("")), r"[,\n;]+"), lambda part: F.lower(strip(part)))
    tokens = F.filter(tokens, lambda part: part != "")
    table = F.create_map(*[F.lit(item) for pair in words.items() for item in pair])

    def look_up(token: Column) -> Column:
        joined = F.regexp_replace(token, r"(?U)\s+", "_")
        return F.coalesce(F.try_element_at(table, joined), F.try_element_at(table, token), token)

    return F.when(_col(language) == "ur", F.transform(tokens, look_up)).otherwise(tokens)


def normalise_term(value: Column | str) -> Column:
    """F1: trimmed, lower case, blanks to underscores."""
    return F.replace(F.lower(strip(value)), F.lit(" "), F.lit("_"))


def strip_markup(value: Column | str) -> Column:
    """P5 for one string."""
    return strip(F.regexp_replace(_col(value), TAG, ""))


def strip_markup_deep(value: Column, data_type: T.DataType) -> Column:
    """P5 through structs, arrays and map values, following the type."""
    if isinstance(data_type, T.StringType):
        return strip_markup(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: strip_markup_deep(item, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, item: strip_markup_deep(item, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [strip_markup_deep(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def printable_ratio(value: Column | str) -> Column:
    """Share of printable ASCII characters; an empty text counts one place."""
    text = _col(value)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7E]", ""))
    return printable / F.greatest(F.length(text), F.lit(1))


def printable_only(value: Column | str) -> Column:
    """Drop control, format, unassigned and separator characters other than the blank."""
    return F.regexp_replace(_col(value), r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", "")


def context_snippet(value: Column | str, size: int = 300) -> Column:
    return F.substring(printable_only(value), 1, size)


def fixed_chunks(value: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of `size` characters, each starting `size - overlap` after the last.

    The last start is the first whose chunk reaches the end of the text.
    """
    text, stride = _col(value), size - overlap
    steps = F.greatest(F.ceil((F.length(text) - size) / stride), F.lit(0)).cast("int")
    return F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(0), steps), lambda at: F.substr(text, at * stride + 1, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def contains_any(value: Column | str, words: list[str]) -> Column:
    """Whether one of `words` is part of the text."""
    return let(_col(value), lambda text: F.exists(F.lit(words), lambda word: F.contains(text, word)))
