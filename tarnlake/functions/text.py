"""Column expressions for identifiers and object names that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's ``\s`` is ASCII only.
SPACE = r"[\s\p{Z}\x85\x1c-\x1f]"
#: The same characters, for functions that take a set of them.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.btrim(c, F.lit(SPACES))


def unescaped(c: Column) -> Column:
    """``c`` with URI escapes undone; a plus sign stays, and text with a broken escape is left as it is."""
    return F.when(F.instr(c, "%") == 0, c).otherwise(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))


def identifier(c: Column) -> Column:
    """``c`` without surrounding white space, letter case and URI escapes."""
    return F.lower(stripped(unescaped(stripped(c))))


def letters(c: Column) -> Column:
    """The letters of ``c`` alone, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))


def object_name(c: Column) -> Column:
    """The object that a path names: scheme in lower case with s3a as s3, escapes undone, ``.``, ``..`` and empty segments resolved.

    A ``..`` never climbs above the bucket. A path without a scheme is taken as all segments.
    """
    # most paths are spelled as they are named, which takes no pattern to see
    rest = F.substr(c, F.lit(6))
    named = F.startswith(c, F.lit("s3://")) & ~F.startswith(rest, F.lit("/")) & ~F.startswith(rest, F.lit(".")) & ~F.endswith(c, F.lit("/"))
    named &= ~F.contains(c, F.lit("%")) & ~F.contains(c, F.lit("/.")) & ~F.contains(rest, F.lit("//"))
    return F.when(named, c).otherwise(_object_name(c))


def _object_name(c: Column) -> Column:
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = unescaped(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""))
    parts = F.split(rest, "/")
    floor = F.when(scheme == "", F.lit(0)).otherwise(F.lit(1))
    plain = F.filter(parts, lambda x: (x != "") & (x != "."))
    resolved = F.aggregate(
        plain,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > floor, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
    )
    names = F.when(F.array_contains(plain, ".."), resolved).otherwise(plain)
    return F.concat(F.when(scheme == "s3a", F.lit("s3")).otherwise(scheme), F.lit("://"), F.array_join(names, "/"))
