"""The scalar functions of the builder surface, as columns, with the semantics that its users rely on.

All give null for a null argument unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.errors import LakeError
from tarnlake.functions.text import stripped

#: Option letters of the regular expression functions.
OPTIONS = frozenset("cigmnpsl")
_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
PARTS = ("year", "month", "day", "hour")


def trim(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return stripped(s)


def substr(s: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the 0-based ``start``; a negative start counts from the end."""
    n = F.length(s)
    begin = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start)
    end = start + length
    stop = F.when(end < 0, n + end).otherwise(F.least(end, n))
    return F.when(s.isNotNull() & start.isNotNull() & length.isNotNull(), F.substring(s, (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int")))


def _flags(name: str, options: str, replace: bool) -> tuple[str, bool, bool]:
    """Inline flags, whether the pattern is literal, whether all matches are meant."""
    unknown = set(options) - OPTIONS
    if unknown or ("g" in options and not replace):
        raise LakeError("TYPE_ERROR", f"{name}: unsupported option {''.join(sorted(unknown)) or 'g'}")
    case = [o for o in options if o in "ci"][-1:] == ["i"]
    multi = any(o in options for o in "mnp")
    flags = "i" * case + "m" * multi + "s" * ("s" in options)
    return flags and f"(?{flags})", "l" in options, "g" in options


def _pattern(pattern: str, flags: str, literal: bool) -> str:
    quoted = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else pattern
    try:
        if not literal:
            re.compile(pattern)
    except re.error as e:
        raise LakeError("TYPE_ERROR", f"invalid regular expression: {e}") from e
    return flags + quoted


def matching(pattern: str, options: str) -> str:
    """A pattern with its options put in."""
    flags, literal, _ = _flags("regexp_matches", options, False)
    return _pattern(pattern, flags, literal)


def regexp_matches(s: Column, pattern: str, options: str = "") -> Column:
    return s.rlike(matching(pattern, options))


def _java_replacement(text: str) -> str:
    """``\\1`` names a group; dollar signs and other backslashes stand for themselves."""
    return re.sub(r"\\([0-9])|([\\$])", lambda m: f"${m[1]}" if m[1] else "\\" + m[2], text)


def replacing(pattern: str, replacement: str, options: str) -> tuple[str, str]:
    """Pattern and replacement by which replacing all matches replaces the first match of ``pattern``, or all with ``g``.

    For the first match, the pattern takes the whole text: the shortest text before a match, the match, and the rest,
    of which the outer two are put back. Flags hold for the match alone.
    """
    flags, literal, everywhere = _flags("regexp_replace", options, True)
    full, new = _pattern(pattern, flags, literal), _java_replacement(replacement)
    if everywhere:
        return full, new
    body = full[len(flags) :]
    match = body if literal else _shift_backrefs(body, 2)
    around = f"(?s:^(.*?))({f'(?{flags[2:-1]}:{match})' if flags else match})(?s:(.*)$)"
    shifted = re.sub(r"(?<!\\)\$([0-9])", lambda m: f"${int(m[1]) + 2}", new)
    return around, f"$1{shifted}${_groups(full) + 3}"


def regexp_replace(s: Column, pattern: str, replacement: str, options: str = "") -> Column:
    """The first match replaced, or all with option ``g``."""
    return F.regexp_replace(s, *map(F.lit, replacing(pattern, replacement, options)))


def _groups(pattern: str) -> int:
    """How many capturing groups a pattern has."""
    plain = re.sub(r"\\Q.*?\\E|\\.|\[(?:\\.|[^\]])*\]", "", pattern, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", plain))


def _shift_backrefs(pattern: str, by: int) -> str:
    return re.sub(r"(?<!\\)\\([1-9])", lambda m: f"\\{int(m[1]) + by}", pattern)


def least(*xs: Column) -> Column:
    """Null if any argument is."""
    return F.when(_all_there(xs), F.least(*xs) if len(xs) > 1 else xs[0])


def greatest(*xs: Column) -> Column:
    """Null if any argument is."""
    return F.when(_all_there(xs), F.greatest(*xs) if len(xs) > 1 else xs[0])


def _all_there(xs: tuple[Column, ...]) -> Column:
    there = xs[0].isNotNull()
    for x in xs[1:]:
        there &= x.isNotNull()
    return there


def cast(x: Column, kind: str, to: str) -> Column:
    """To string, number (double; null if it can't be read) or boolean (false for 0, not a number, and the empty string)."""
    if to == "string":
        return x.cast("string")
    if to in ("number", "float64"):
        return trim(x).try_cast("double") if kind == "string" else x.cast("double")
    if to == "boolean":
        if kind == "string":
            return x != ""
        return x if kind == "boolean" else (x != 0) & ~F.isnan(x.cast("double")) if kind == "number" else x.isNotNull()
    raise LakeError("TYPE_ERROR", f"cast to {to} is not supported")


def moment(x: Column, kind: str) -> Column:
    """A timestamp from a timestamp, ISO text, or milliseconds since 1970."""
    if kind == "number":
        return F.timestamp_millis(x.cast("bigint"))
    return F.try_to_timestamp(x) if kind == "string" else x


def date_part(part: str, x: Column, kind: str) -> Column:
    at = moment(x, kind)
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[part](at)


def date_trunc(part: str, x: Column, kind: str, iso: bool = False) -> Column:
    """The start of the year, month, day or hour; as ISO text if ``iso``."""
    if part not in PARTS:
        raise LakeError("TYPE_ERROR", f"date_trunc: unsupported part {part}")
    cut = F.date_trunc(part, moment(x, kind))
    return F.date_format(cut, _FORMAT) if iso else cut


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity."""
    scale = F.lit(10.0**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def divide(a: Column, b: Column) -> Column:
    """Floating-point division: by zero it gives an infinity, or NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    over = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, over).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of ``a``; NaN for a divisor of 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))


def h3_parent(cell: Column, resolution: Column) -> Column:
    """The cell of a coarser ``resolution`` that holds an H3 cell: its resolution bits set, its finer digits filled with ones."""
    bits = F.conv(F.lower(cell), 16, 10).cast("decimal(20,0)").cast("bigint")
    own = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(15).cast("bigint"))
    res = resolution.cast("bigint")
    cleared = bits.bitwiseAND(F.lit(~(15 << 52)))
    fill = F.lit(0).cast("bigint")
    for r in range(1, 16):
        fill = fill.bitwiseOR(F.when(res < r, F.lit(7 << (45 - 3 * r)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    parent = F.lower(F.hex(cleared.bitwiseOR(F.when(res.between(0, 15), res * F.lit(1 << 52))).bitwiseOR(fill)))
    return F.when((res <= own) & cell.rlike("(?i)^8[0-9a-f]{14}$"), parent)


def h3_in(cell: Column, cells_json: Column) -> Column:
    """Whether ``cell`` is in a JSON array of cells."""
    return F.array_contains(F.from_json(cells_json, "array<string>"), cell)


#: Functions of columns only; those that need kinds or literals are in ``plans.compile``.
PLAIN: dict[str, tuple[Callable[..., Column], int, int | None]] = {
    "lower": (F.lower, 1, 1),
    "upper": (F.upper, 1, 1),
    "trim": (trim, 1, 1),
    "substr": (substr, 3, 3),
    "replace": (F.replace, 3, 3),
    "coalesce": (F.coalesce, 1, None),
    "nullif": (F.nullif, 2, 2),
    "least": (least, 1, None),
    "greatest": (greatest, 1, None),
    "floor": (lambda x: F.floor(x.cast("double")).cast("double"), 1, 1),
    "ceil": (lambda x: F.ceil(x.cast("double")).cast("double"), 1, 1),
    "abs": (lambda x: F.abs(x.cast("double")), 1, 1),
    "h3_in": (h3_in, 2, 2),
    "h3_parent": (h3_parent, 2, 2),
}
