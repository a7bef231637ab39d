"""Column expressions for text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters stripped from both ends of a document.
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed value: why a raw record isn't kept; duplicates are found later.
DROP_REASONS = ("utf8", "too_short", "duplicate", "control_char")


def strip(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unix_lines(text: Column) -> Column:
    """``text`` with CR LF and CR as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def json_line(text: Column, source: Column, record_id: Column) -> Column:
    """The corpus line without its newline: an object of text, source and id in this order."""
    return F.to_json(F.struct(text.alias("text"), source.alias("source"), record_id.alias("id")))


def record_id(domain: Column, n: Column) -> Column:
    """``domain/000000042``."""
    return F.format_string("%s/%09d", domain, n)
