"""What the text operators share: white space, ASCII lower case, null texts."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a regular expression and as text.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def strip_spaces(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACES))


def count_words(col: Column) -> Column:
    """Number of words between white space, without making an array of them."""
    one = F.btrim(F.regexp_replace(col, SPACE_RUN, " "))
    return F.when(one == "", F.lit(0)).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "))) + 1).cast("long")


def small_parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts) of a column of texts, of about ``most`` bytes or characters each: what is worked on at once doesn't grow with a batch."""
    part: list = []
    first = size = 0
    for i, x in enumerate(column):
        value = x.as_py()
        part.append(value)
        size += len(value)
        if size > most:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def named(name: str) -> Column:
    """A column of any name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*cols: Column) -> Column:
    """128 bits that tell rows apart by ``cols``; never null, and null differs from every text."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.concat(F.when(c.isNull(), "0").otherwise("1"), F.coalesce(c.cast("string"), F.lit(""))) for c in cols]).cast("binary")))
