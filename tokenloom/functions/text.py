"""String and number-format expressions (all built-in functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and their powers of ten; beyond the last, "P" for each further thousand is not added.
SUFFIXES = (("K", 3), ("M", 6), ("B", 9), ("T", 12))


def hw_to_string(h: Column, w: Column) -> Column:
    return F.concat_ws("*", h.cast("string"), w.cast("string"))


def string_to_hw(s: Column) -> Column:
    """Array of integers; null where a part is not an integer."""
    return F.transform(F.split(s, "[*]"), lambda x: x.try_cast("int"))


def parse_large_int(s: Column) -> Column:
    """"1.5k" -> 1500: suffix K, M, B or T in either case, truncated; else a plain integer."""
    text = F.trim(s)
    number = F.regexp_extract(text, "^([+-]?[0-9]*[.]?[0-9]+)[KkMmBbTt]$", 1)
    unit = F.upper(F.right(text, F.lit(1)))
    scaled = F.lit(None).cast("double")
    for name, power in SUFFIXES:
        scaled = F.when(unit == name, number.try_cast("double") * float(10**power)).otherwise(scaled)
    return F.when(number != "", scaled.cast("bigint")).otherwise(text.try_cast("bigint"))


def one_decimal(x: Column) -> Column:
    """A double with one decimal as C's printf gives it: by the binary value, exact halves to the even digit.

    ``format_string`` rounds the shortest decimal text, halves up, so 1.25 and 1.15 (which is below the half) go the other way.
    """
    size = F.abs(x)
    whole = F.floor(size).cast("bigint")
    part = ((size - whole) * float(1 << 52)).cast("bigint") * 10  # tenths in 2 ** 52nds: nothing is lost from 1 on
    digit, rest, half = F.shiftright(part, 52), part.bitwiseAND((1 << 52) - 1), 1 << 51
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole * 10 + digit + up.cast("bigint")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_large_int(v: Column) -> Column:
    """Below 1000 plain; else one decimal and K, M, B, T, or P for all beyond."""
    size = F.abs(v)
    shown = lambda name, power: F.concat(one_decimal(v / float(10**power)), F.lit(name))
    out = shown("P", 15)
    for name, power in reversed(SUFFIXES):
        out = F.when(size < 10 ** (power + 3), shown(name, power)).otherwise(out)
    return F.when(size < 1000, v.cast("string")).otherwise(out)


def matching_parenthesis(text: Column, opening: Column) -> Column:
    """0-based index of the parenthesis that closes the one at ``opening``; null if there is none."""
    rest = F.split(F.substring(text, opening + 1, F.length(text)), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("hit"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        hit = F.when((acc["hit"] < 0) & (c == ")") & (depth == 0), acc["at"]).otherwise(acc["hit"])
        return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), hit.alias("hit"))

    found = F.aggregate(rest, start, step, lambda acc: acc["hit"])
    return F.when((F.substring(text, opening + 1, F.lit(1)) == "(") & (found >= 0), opening + found)


def pretty_map(m: Column) -> Column:
    """Sorted "key: value" lines of a map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(": ", e["key"], e["value"].cast("string"))), "\n")


def compare_versions(a: Column, op: str, b: Column) -> Column:
    """Dotted release numbers, compared part by part, trailing zeros aside."""
    if op not in ("<", "<=", "==", "!=", ">=", ">"):
        raise ValueError(f"unknown comparison {op!r}")

    def parts(v: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(v, "([.]0+)+$", ""), "[.]"), lambda x: x.cast("int"))

    x, y = parts(a), parts(b)
    return {"<": x < y, "<=": x <= y, "==": x == y, "!=": x != y, ">=": x >= y, ">": x > y}[op]


def make_seed(*args: Column) -> Column:
    """Fold (seed * 31 + value) mod 2**31; strings count as their crc32."""
    values = F.array(*args)
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, a: (s * 31 + a).bitwiseAND(0x7FFFFFFF))
