"""Secret scans over a trigram inverted index (built-in functions only).

Each rule is a regular expression.  ``trigram_query`` derives from it a Boolean query over the
trigrams that every match must contain (lower case): a conjunction of alternatives, each a set of
trigrams.  The index holds, for every trigram that some rule asks for, the postings of the
documents that contain it, in segments of bounded size.  Intersecting and uniting postings gives
each rule's candidates, which are then verified with the expression itself; a rule without
mandatory trigrams (long hexadecimal runs) scans all documents.

Rule kinds and what they accept are listed in ``RULES``; spans are code-point offsets of whole
matches, end exclusive, leftmost non-overlapping within a kind.

Defined results
---------------
* null text: no spans (``redact`` keeps the null); empty text: none;
* postings hold hashes of id and text: repeated rows share candidates, and every row is verified on
  its own text, so null and repeated ids and hash collisions change nothing;
* ties of spans are ordered by kind as listed;
* texts of any length are scanned whole;
* empty tables give empty results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import free_name, stash, text_of

#: Rows of a segment of the index, about.
SEGMENT_ROWS = 20_000
#: Candidates that are sent to all tasks (two numbers each); if there are more, rows are dealt by hash to meet theirs.
BROADCAST_ROWS = 500_000
#: Strings that an exact set may hold before its trigrams are taken.
EXACT = 128
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0


#: A private key: to its END line, with no other line of five hyphens between; without one, header
#: lines and a base64 run of 16 characters or more; else the BEGIN line.  Repeated groups are bounded, since the JVM recurses on them.
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,50}-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:[\x20\x09\x0A\x0D]*[A-Za-z0-9-]+:[^\x0A]*\x0A){0,10}[\x20\x09\x0A\x0D\\nr]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\x20\x09\x0A\x0D\\]*)?"
)
#: The base rules, then those added.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", _PEM),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]{3,}@"),
)
BASE = ("assign", "access", "hex")

#: A query: all of these must hold; each holds if one of its sets of trigrams is contained.
Query = tuple[frozenset[frozenset[str]], ...]


def _clause(strings: Iterable[str]) -> Query:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if not sets or frozenset() in sets:
        return ()
    return (frozenset(s for s in sets if not any(o < s for o in sets)),)


#: Escapes that stand for one character.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}

#: A node: ("chars", strings or None), ("branch", lists of nodes) or ("repeat", least, most or None, nodes).
Node = tuple


def parse(pattern: str) -> list[Node]:
    """Syntax tree of an expression: characters, classes, groups, alternatives, repetitions.

    The strings of "chars" are those it matches, in lower case; None stands for any of many.
    """

    def escape(i: int) -> tuple[str | None, int]:
        c = pattern[i + 1]
        if c == "x":
            return chr(int(pattern[i + 2 : i + 4], 16)), i + 4
        return (None if c in "sSdDwW" else "" if c in "bB" else _ESCAPES.get(c, c)), i + 2

    def in_class(i: int) -> tuple[Node, int]:
        few: set[str] | None = set()
        if pattern[i] == "^":
            few, i = None, i + 1
        first = i
        while pattern[i] != "]" or i == first:
            c, j = escape(i) if pattern[i] == "\\" else (pattern[i], i + 1)
            if pattern[j] == "-" and pattern[j + 1] != "]":  # a range
                c, j = None, (escape(j + 1)[1] if pattern[j + 1] == "\\" else j + 2)
            few = None if few is None or c is None else few | {c.lower()}
            i = j
        return ("chars", few), i + 1

    def atom(i: int) -> tuple[Node, int]:
        c = pattern[i]
        if c == "(":
            node, i = branches(pattern.index(":", i) + 1 if pattern[i + 1] == "?" else i + 1)
            return node, i + 1
        if c == "[":
            return in_class(i + 1)
        if c == "\\":
            c, i = escape(i)
            return ("chars", None if c is None else {c.lower()}), i
        return ("chars", None if c == "." else {""} if c in "^$" else {c.lower()}), i + 1

    def times(i: int) -> tuple[int, int | None, int]:
        least, most, c = 1, 1, pattern[i : i + 1]
        if c and c in "*+?":
            least, most, i = int(c == "+"), 1 if c == "?" else None, i + 1
        elif c == "{":
            end = pattern.index("}", i)
            low, comma, high = pattern[i + 1 : end].partition(",")
            least, most, i = int(low or 0), (int(high) if high else None) if comma else int(low), end + 1
        else:
            return 1, 1, i
        return least, most, i + (pattern[i : i + 1] in ("?", "+"))  # lazy or possessive

    def branches(i: int) -> tuple[Node, int]:
        parts: list[list[Node]] = [[]]
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                parts.append([])
                i += 1
                continue
            node, i = atom(i)
            least, most, i = times(i)
            parts[-1].append(node if (least, most) == (1, 1) else ("repeat", least, most, [node]))
        return ("branch", parts), i

    return [branches(0)[0]]


def _exact(node: Node) -> set[str] | None:
    """All strings that a node matches, in lower case, if they are few."""
    if node[0] == "chars":
        return node[1]
    if node[0] == "branch":
        parts = [_exact_all(p) for p in node[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    _, least, most, nodes = node
    one = _exact_all(nodes) if most is not None and most <= 4 else None
    if one is None:
        return None
    out, power = set(), {""}
    for n in range(most + 1):
        out |= power if n >= least else set()
        power = {a + b for a in power for b in one}
        if len(out) + len(power) > EXACT:
            return None
    return out


def _exact_all(nodes: Iterable[Node]) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(out) * len(part) > EXACT:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes: Iterable[Node]) -> Query:
    out, held = (), {""}
    for node in nodes:
        part = _exact(node)
        if part is not None and len(held) * len(part) <= EXACT:
            held = {a + b for a in held for b in part}
            continue
        out, held = out + _clause(held), {""}
        if node[0] == "branch" and len(node[1]) == 1:
            out += _query(node[1][0])
        elif node[0] == "repeat" and node[1] >= 1:
            out += _query(node[3])
        elif part is not None:
            out += _clause(part)
    return out + _clause(held)


def trigram_query(pattern: str) -> Query:
    """The trigrams that a match of ``pattern`` must contain, in lower case; () if there are none."""
    return tuple(dict.fromkeys(_query(parse(pattern))))


QUERIES = {r.kind: trigram_query(r.pattern) for r in RULES}
GRAMS = sorted({g for q in QUERIES.values() for c in q for s in c for g in s})


def build_index(docs: DataFrame, id_col: str, text_col: str, segments: int) -> DataFrame:
    """segment, gram, docs (hashes of ids): postings of the trigrams that the rules ask for."""
    low = docs.select(F.xxhash64(id_col, text_col).alias("doc"), F.lower(text_of(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), i) for i, g in enumerate(GRAMS)]))
    rows = low.select("doc", F.explode(found).alias("gram"))
    return rows.groupBy(F.pmod("doc", F.lit(segments)).alias("segment"), "gram").agg(F.collect_set("doc").alias("docs"))


def _postings(clause: frozenset[frozenset[str]], of: dict[str, Column]) -> Column:
    """Documents that contain all trigrams of one of the sets."""
    either = None
    for grams in sorted(clause, key=sorted):
        both = None
        for g in sorted(grams):
            both = of[g] if both is None else F.array_intersect(both, of[g])
        either = both if either is None else F.array_union(either, both)
    return either


def candidates(index: DataFrame) -> DataFrame:
    """doc (hash of id), rules (bit set of rules whose trigrams it contains)."""
    none = F.array().cast("array<bigint>")
    by_segment = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("m"))
    lists = by_segment.select(*[F.coalesce(F.try_element_at("m", F.lit(i)), none).alias(f"g{i}") for i in range(len(GRAMS))])
    of, asked = {g: F.col(f"g{i}") for i, g in enumerate(GRAMS)}, []
    for i, rule in enumerate(RULES):
        if query := QUERIES[rule.kind]:
            got = None
            for clause in query:
                part = _postings(clause, of)
                got = part if got is None else F.array_intersect(got, part)
            asked.append(F.struct(F.lit(1 << i).alias("rule"), got.alias("docs")))
    rows = lists.select(F.explode(F.array(*asked)).alias("x")).select("x.rule", F.explode("x.docs").alias("doc"))
    return rows.groupBy("doc").agg(F.bit_or("rule").alias("rules"))


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of a rule: gaps and matches alternate, so their lengths add up to the places."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)) if rule.group else whole
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["0"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["1"]).alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(x["2"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((begin + F.coalesce(x["1"], F.lit(0))).alias("at"), out.alias("out"))

    zipped = F.filter(F.arrays_zip(gaps.alias("0"), whole.alias("1"), counted.alias("2")), lambda x: x["1"].isNotNull())
    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with a column of spans: array of (start, rank, end, kind), ordered by start and kind.

    The column is ``out_col``, with underscores in front if ``docs`` has one of that name.
    """
    n = docs.count()
    index = stash(build_index(docs, id_col, text_col, max(1, -(-n // SEGMENT_ROWS))), "secrets-index")
    found = stash(candidates(index).select(F.col("doc").alias("_doc"), "rules"), "secrets-candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(id_col, text_col).alias("doc"), text_of(text_col).alias("body"))
    rows = keyed.join(found, F.col("doc") == F.col("_doc"), "left").select("row", "body", F.coalesce("rules", F.lit(0)).alias("rules"))
    none, parts = F.array().cast(f"array<{_SPAN}>"), []
    for i, rule in enumerate(RULES):
        candidate = F.col("rules").bitwiseAND(1 << i) != 0 if QUERIES[rule.kind] else F.lit(True)
        parts.append(F.when(candidate & F.col("body").rlike(rule.pattern), _spans(rule, i, F.col("body"))).otherwise(none))
    return rows.select("row.*", F.sort_array(F.concat(*parts)).alias(free_name(docs.columns, out_col)))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by MARK in the text."""
    own = free_name(docs.columns, "secret_spans")
    found = scan(docs, id_col=id_col, text_col=text_col, out_col=own)

    def clean(text: Column, spans: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            fresh = x["start"] >= acc["at"]
            piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit(MARK))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))

    text = F.col(f"`{text_col}`")
    return found.select(*[F.when(F.size(own) > 0, clean(text, F.col(own))).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
