"""Nested values as indented text.

``pretty_nested`` lays out JSON of any depth as block text: keys sorted, four more columns a level, items of
lists behind dashes.  Levels are opened one after another with ``variant_explode``, so a round is one pass over
the nodes that are still open and a value's lines are put together once, at the end.

Defined results: an empty map or list is ``{}`` or ``[]``; null is ``null``; a text that would read as something
else is quoted (in single quotes if it is printable ASCII, as JSON if not); text that is no JSON, and null, give
null; a plain value is one line.  Long lines are not folded.  Rows are told apart by ``key`` columns, which must
be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ordering import checkpointed
from tokenloom.functions.text import matching_parenthesis

INDENT = 4
# Words that a YAML reader takes for something other than text, in any of their three cases.
RESERVED = ["yes", "no", "true", "false", "on", "off", "null"]
_WORDS = "|".join(f"{w}|{w.capitalize()}|{w.upper()}" for w in RESERVED)
_PLAIN = f"^(?!(?:{_WORDS})$)[A-Za-z_/](?:[A-Za-z0-9_./+()*^@$;,'\"%&!=<>?|~{{}}`\\\\\\[\\]-]|[:](?=[A-Za-z0-9_./])|[ ](?=[^ #]))*$"


def _quoted(text: Column) -> Column:
    """A text (or key) as a plain or quoted scalar."""
    single = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    as_json = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(text.rlike(_PLAIN), text).when(text.rlike(r"^[\x20-\x7E]*$"), single).otherwise(as_json)


def _kind(value: Column) -> Column:
    """map, list, or leaf; empty containers are leaves."""
    shown = F.to_json(value)
    first = F.left(shown, F.lit(1))
    return F.when(first.isin("{", "[") & ~shown.isin("{}", "[]"), F.when(first == "{", "map").otherwise("list")).otherwise("leaf")


def _leaf(value: Column) -> Column:
    shown = F.to_json(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.startswith(shown, F.lit('"')), _quoted(text)).otherwise(F.coalesce(shown, F.lit("null")))


def pretty_nested(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """``key`` columns and ``shown``."""
    value = F.try_parse_json(F.col(json))
    start = rows.select(*key, value.alias("_v")).where("_v IS NOT NULL")
    kind = _kind(F.col("_v"))
    nodes = start.select(*key, F.lit(0).alias("_col"), F.lit("").alias("_lead"), F.array().cast("array<int>").alias("_path"), kind.alias("_kind"), "_v")
    nodes = checkpointed(nodes)
    lines = nodes.where("_kind = 'leaf'").select(*key, "_path", _leaf(F.col("_v")).alias("_line"))
    open_ = nodes.where("_kind <> 'leaf'")
    spaces = F.repeat(F.lit(" "), F.col("_col"))
    while open_.limit(1).count():
        opened = open_.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_child")))
        own = F.when(F.col("_pos") == 0, F.col("_lead")).otherwise(spaces)
        kind = F.coalesce(_kind(F.col("_child")), F.lit("leaf"))
        inner, in_map = kind != "leaf", F.col("_kind") == "map"
        head = F.concat(own, F.when(in_map, F.concat(_quoted(F.col("_key")), F.lit(":"))).otherwise("-"))
        deeper = F.col("_col") + F.when(in_map & (kind == "list"), 0).otherwise(INDENT)  # a list stands under its key
        line = F.when(~inner, F.concat(head, F.lit(" "), _leaf(F.col("_child")))).when(in_map, head)
        lead = F.when(in_map, F.repeat(F.lit(" "), deeper)).otherwise(F.rpad(head, F.length(head) + INDENT - 1, F.lit(" ")))
        nodes = opened.select(*key, deeper.alias("_col"), lead.alias("_lead"), F.concat("_path", F.array("_pos")).alias("_path"), kind.alias("_kind"), F.col("_child").alias("_v"), line.alias("_line"))
        nodes = checkpointed(nodes)
        lines = lines.unionByName(nodes.where("_line IS NOT NULL").select(*key, "_path", "_line"))
        open_ = nodes.where("_kind <> 'leaf'").drop("_line")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_path", "_line"))), lambda x: x["_line"]), "\n")
    done = lines.groupBy(*key).agg(shown.alias("shown"))
    return rows.select(*key).join(done, key, "left")


def pretty_call(text: Column, indent: int = INDENT) -> Column:
    """``Name(a=1, b={'k': 2}, c=x)rest`` with an argument a line; values in braces as indented JSON; null if no parenthesis closes.

    Braces do not nest (an argument's value ends at the first closing one), as commas outside them end a value;
    single quotes inside braces stand for double ones, and what is no JSON then is shown as it came.
    """
    opening = F.position(F.lit("("), text) - 1
    closing = matching_parenthesis(text, opening)
    name = F.substring(text, F.lit(1), opening)
    body = F.rtrim(F.substring(text, opening + 2, closing - opening - 1), F.lit(")"))
    rest = F.trim(F.trim(F.substring(text, closing + 2, F.length(text)), F.lit(",")), F.lit(" "))
    pairs = F.regexp_extract_all(body, F.lit(r"(\w+=(?:\{[^}]*\}|[^,]*))"), 1)
    pad, deep = " " * indent, " " * (2 * indent)

    def shown(pair: Column) -> Column:
        at = F.position(F.lit("="), pair)
        key, value = F.substring(pair, F.lit(1), at - 1), F.substring(pair, at + 1, F.length(pair))
        entries = F.map_entries(F.from_json(F.replace(value, F.lit("'"), F.lit('"')), "map<string,variant>"))
        lines = F.transform(entries, lambda e: F.concat(F.lit(f'{deep}"'), e["key"], F.lit('": '), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
        block = F.when(F.size(lines) > 0, F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit(f"\n{pad}}}"))).when(F.size(lines) == 0, "{}")
        braces = F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}"))
        return F.concat(F.lit(pad), key, F.lit("="), F.when(braces, F.coalesce(block, value)).otherwise(value), F.lit(","))

    tail = F.replace(rest, F.lit("\t"), F.lit(pad))
    return F.concat(name, F.lit("(\n"), F.array_join(F.transform(pairs, shown), "\n"), F.lit("\n),\n"), tail)
