"""Column functions over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contacts import normalize_link
from .text import clean_content_line, filled, let, normalize_whitespace, strip_decorations

# What makes a line ignorable.
SEPARATOR = r"^\s*[-=_~]{3,}\s*$"
HASHTAG = r"(?iu)^#\S+$"


def split_lines(c: Column) -> Column:
    """Non-empty lines with normalised blanks."""
    raw = F.split(F.translate(F.coalesce(c, F.lit("")), " ​\r", "  \n"), "\n")
    return F.filter(F.transform(raw, normalize_whitespace), lambda x: x != "")


def nonempty(lines: Column) -> Column:
    return F.filter(lines, lambda x: x != "")


def compact(lines: Column, separator: str = " ") -> Column:
    """Cleaned lines as one; null if none is left."""
    return filled(normalize_whitespace(F.array_join(nonempty(F.transform(lines, clean_content_line)), separator)))


def multiline(lines: Column) -> Column:
    """Distinct cleaned lines, one below the other; null if none is left."""
    return filled(F.array_join(F.array_distinct(nonempty(F.transform(lines, clean_content_line))), "\n"))


def merge_multiline(a: Column, b: Column) -> Column:
    """The cleaned lines of both texts, each once, in order of first place."""
    both = F.concat(*(F.split(F.coalesce(x, F.lit("")), "\n") for x in (a, b)))
    return multiline(both)


def subtract_lines(a: Column, b: Column, key) -> Column:
    """The lines of array a whose key is not that of any line of array b."""
    return let(F.transform(b, key), lambda keys: F.filter(a, lambda x: ~F.array_contains(keys, key(x))))


def ordered_distinct(a: Column) -> Column:
    return F.array_distinct(a)


def position(a: Column, test) -> Column:
    """The place, from 0, of the first element that passes, else the size of the array."""
    flags = F.transform(a, lambda x: F.coalesce(test(x), F.lit(False)))
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(F.size(a)).cast("int")


def take_until(a: Column, test) -> Column:
    """The elements before the first that passes."""
    return let(a, lambda x: F.slice(x, F.lit(1), position(x, test)))


def trim_edges(a: Column, test) -> Column:
    """Without the elements at both ends that pass; those between stay."""

    def cut(x: Column) -> Column:
        kept = F.transform(x, lambda y: F.coalesce(~test(y), F.lit(False)))
        begin, end = (lambda k: F.array_position(k, True)), (lambda k: F.array_position(F.reverse(k), True))
        return let(kept, lambda k: F.when(begin(k) > 0, F.slice(x, begin(k).cast("int"), (F.size(x) - begin(k) - end(k) + 2).cast("int"))).otherwise(F.slice(x, 1, 0)))

    return let(a, cut)


def is_ignorable(line: Column, own: Column, message_url: Column) -> Column:
    """Blank, separator, hashtag, own name, own link or without any letter or digit."""
    own_link = F.contains(line, F.lit("/")) & F.coalesce(normalize_link(line) == F.coalesce(normalize_link(message_url), message_url), F.lit(False))

    def empty(plain: Column) -> Column:
        return plain.rlike(HASHTAG) | ~plain.rlike(r"[\p{L}\p{Nd}]") | F.array_contains(own, F.regexp_replace(F.lower(plain), "^@", ""))

    return (line == "") | line.rlike(SEPARATOR) | let(strip_decorations(line), empty) | own_link
