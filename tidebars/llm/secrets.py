"""Secret scans by a trigram inverted index, all in DataFrame functions.

A Boolean query over trigrams is derived from each rule's regex: a text that matches the regex has,
for one of the query's clauses, every trigram of that clause. The inverted index holds a posting for
each trigram of any query and each text that has it; intersecting the postings of the clauses leaves
the candidates of each rule, and only these texts are searched with its regex. A rule whose regex has
no mandatory trigram (a run of hex digits) searches every text.

Defined results: a null text counts as empty; without a match n_* are 0 and spans is ''. Repeated rows
and repeated or null ids each get their own result. Columns of other names pass through `redact`.
"""

from __future__ import annotations

import re._constants as rx_kinds
import re._parser as rx_parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: name in the spans; regex: for Java; least: least number of characters of `group`."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False

    def __post_init__(self) -> None:
        if _recurses(rx_parser.parse(self.regex)):
            raise ValueError(f"{self.kind}: Java matches a repeated group by recursion, so that a long text overflows the stack; repeat it possessively")


def _recurses(items) -> bool:
    """Whether a group of more than one character is repeated often, and not possessively."""
    for op, arg in items:
        if op is rx_kinds.BRANCH:
            parts = arg[1]
        elif op in (rx_kinds.MAX_REPEAT, rx_kinds.MIN_REPEAT, rx_kinds.POSSESSIVE_REPEAT):
            parts = [arg[2]]
            single = len(arg[2]) == 1 and arg[2][0][0] in (rx_kinds.LITERAL, rx_kinds.NOT_LITERAL, rx_kinds.IN, rx_kinds.ANY)
            if op is not rx_kinds.POSSESSIVE_REPEAT and not single and arg[1] > MOST_REPEATS:
                return True
        else:
            parts = [arg[-1]] if op is rx_kinds.SUBPATTERN else []
        if any(_recurses(x) for x in parts):
            return True
    return False


#: A group may be repeated so often without being possessive.
MOST_REPEATS = 100


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("private_key", r"-----BEGIN(?: (?!PRIVATE KEY-----)[A-Z]+)*+ PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
#: Alternatives that are followed one by one while a query is derived; beyond it they only lose precision.
MOST_STRINGS = 32

Query = frozenset  # of clauses, each a frozenset of trigrams; one empty clause: no mandatory trigram
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _short(frozenset(x | y for x in a for y in b))


def _short(q: Query) -> Query:
    """Without clauses that another one implies."""
    return frozenset(c for c in q if not any(d < c for d in q))


def _grams(strings: set[str]) -> Query:
    return _short(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a piece of the regex: all strings it can match, if few, and the query that any match fulfils."""
    strings, query, whole = {""}, ANY, True
    for op, arg in items:
        some, need = _item(op, arg)
        query = _both(query, need)
        if some is not None and len(strings) * len(some) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in some}
        else:
            query, whole = _both(query, _grams(strings)), False
            strings = some if some is not None else {""}
    return (strings, query) if whole else (None, _both(query, _grams(strings)))


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is rx_kinds.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is rx_kinds.IN and all(k is rx_kinds.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}, ANY
    if op is rx_kinds.SUBPATTERN:
        return _walk(arg[-1])
    if op in (rx_kinds.AT, rx_kinds.ASSERT_NOT):
        return {""}, ANY
    if op is rx_kinds.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), _short(frozenset().union(*(q for _, q in parts)))
        whole = [q if s is None else _both(q, _grams(s)) for s, q in parts]
        return None, _short(frozenset().union(*whole))
    if op in (rx_kinds.MAX_REPEAT, rx_kinds.MIN_REPEAT, rx_kinds.POSSESSIVE_REPEAT):
        least, most, part = arg
        some, need = _walk(part)
        if (least, most) == (0, 1) and some is not None:
            return some | {""}, ANY
        return None, (ANY if not least else need if some is None else _both(need, _grams(some)))
    return None, ANY


def trigram_query(regex: str) -> Query:
    """Clauses of lower-case trigrams; a text that matches regex has all those of one clause, if lowered."""
    strings, query = _walk(rx_parser.parse(regex))
    return query if strings is None else _both(query, _grams(strings))


def postings(texts: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: a row (__gram, __key) for each trigram of the rules' queries and each text with it."""
    vocabulary = _vocabulary(rules)

    def grams(folded: Column) -> Column:
        return F.array_compact(F.array(*[F.when(folded.contains(g), F.lit(i)) for i, g in enumerate(vocabulary)]))

    # the lambda's argument is lowered once; a plain column would be lowered again for each trigram
    lists = texts.select("__key", F.flatten(F.transform(F.array(F.lower("__text")), grams)).alias("__grams"))
    return lists.select(F.explode("__grams").alias("__gram"), "__key")


def _vocabulary(rules) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.regex) for g in clause})


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(__key, __rules): the numbers of the rules whose query the postings of the text fulfil.

    The postings of a text meet as bits of a few longs, added up before and after the shuffle.
    """
    vocabulary = _vocabulary(rules)
    at = {g: i for i, g in enumerate(vocabulary)}
    longs = (len(vocabulary) + 61) // 62
    bits = [
        F.bit_or(F.when((F.col("__gram") >= 62 * k) & (F.col("__gram") < 62 * (k + 1)), F.expr(f"shiftleft(1L, __gram - {62 * k})")).otherwise(F.lit(0).cast("long"))).alias(f"__bits{k}")
        for k in range(longs)
    ]
    met = index.groupBy("__key").agg(*bits)

    def holds(clause) -> Column:
        masks = [0] * longs
        for g in clause:
            masks[at[g] // 62] |= 1 << at[g] % 62
        return reduce(lambda a, b: a & b, [F.col(f"__bits{k}").bitwiseAND(F.lit(m).cast("long")) == m for k, m in enumerate(masks) if m])

    passed = [F.when(reduce(lambda a, b: a | b, [holds(c) for c in trigram_query(r.regex)]), F.lit(i)) for i, r in enumerate(rules) if trigram_query(r.regex) != ANY]
    found = met.select("__key", F.array_compact(F.array(*passed)).alias("__rules"))
    return found.where(F.size("__rules") > 0)


#: A fold copies what it has gathered at each step, so spans are gathered in blocks of so many.
BLOCK = 128


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _by_blocks(xs: Column, total: Callable[[Column], Column], so_far: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """The arrays build(block, start) of the blocks of xs (not empty), joined; start is so_far of the totals of the blocks before."""

    def cut(all_of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_of, b * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        return _bound(F.transform(blocks, total), lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda b: so_far(F.slice(t, F.lit(1), b))))

    return _bound(xs, lambda all_of: _bound(cut(all_of), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), build))))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind number, end) of the rule's matches in code points, leftmost and non-overlapping.

    What lies between matches comes from split(), so that places are sums of lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.regex, -1)
    parts = F.zip_with(F.transform(whole, F.length), F.transform(gaps, F.length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    parts = F.zip_with(parts, F.transform(value, F.length), lambda p, v: F.struct(F.coalesce(p["m"], F.lit(0)).alias("m"), p["g"].alias("g"), v.alias("v")))
    kind = "struct<at:int,found:array<struct<start:int,kind:int,end:int>>>"

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["g"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + p["m"]).alias("end"))
        fits = p["v"] >= rule.least
        return F.struct((start + p["m"]).alias("at"), F.when(fits, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    def build(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("found")).cast(kind)
        return F.aggregate(block, first, step, lambda s: s["found"])

    return _by_blocks(parts, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + p["g"] + p["m"]), lambda t: F.aggregate(t, F.lit(0), lambda n, x: n + x), build)


def find_spans(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with a column __spans: all spans as structs (start, kind, end) by start, then kind as listed.

    Texts are shuffled once, by a key of the whole row's content and not by id alone, so that rows with
    the same id or the same text neither mix nor meet in one task unless they are equal in both.
    """
    named = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    by = [F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    keyed = named.withColumn("__key", F.xxhash64(*by))
    met = candidates(postings(keyed.select("__key", "__text"), rules), rules)
    joined = keyed.join(met, "__key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.regex) == ANY:
            may = F.col("__text").rlike(rule.regex)
        else:
            may = F.coalesce(F.array_contains("__rules", i), F.lit(False))
        found.append(F.when(may, _spans(F.col("__text"), rule, i)).otherwise(none))
    return joined.withColumn("__spans", F.array_sort(F.concat(*found))).drop("__key", "__rules", "__text")


def spans_text(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, spans as an array of structs (kind, start, end)."""
    found = find_spans(docs.select(id_col, text_col), text_col, rules)
    names = F.array(*[F.lit(r.kind) for r in rules])
    return found.select(id_col, F.transform("__spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, the counts of the base kinds, the SHA-256 of their spans and all spans."""
    found = find_spans(docs.select(id_col, text_col), text_col, rules)
    base = [i for i, r in enumerate(rules) if r.base]

    def of(kinds: list[int]) -> Column:
        return F.filter("__spans", lambda s: s["kind"].isin(kinds))

    counts = [F.size(of([i])).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    of_base = of(base)
    return found.select(id_col, *counts, F.sha2(spans_text(of_base, rules), 256).alias("base_sha256"), spans_text(F.col("__spans"), rules).alias("spans"))


def mask(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with its spans (structs with start and end, ascending, at least one) replaced by mark(span), overlapping ones by the first one's."""

    def build(block: Column, start: Column) -> Column:
        """What stands before each of the block's spans, and its mark, taken from the part of the text that the block covers."""

        def step(part: Column) -> Callable[[Column, Column], Column]:
            def add(state: Column, s: Column) -> Column:
                piece = F.concat(F.substring(part, state["at"] - start + 1, s["start"] - state["at"]), mark(s))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.array_append(state["out"], piece)).otherwise(state["out"]).alias("out"))

            return add

        first = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out")).cast("struct<at:int,out:array<string>>")
        last = F.array_max(F.transform(block, lambda s: s["end"]))
        return _bound(F.substring(text, start + 1, last - start), lambda part: F.aggregate(block, first, step(part), lambda s: s["out"]))

    pieces = _by_blocks(spans, lambda b: F.array_max(F.transform(b, lambda s: s["end"])), lambda t: F.coalesce(F.array_max(t), F.lit(0)), build)
    rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.array_join(F.concat(pieces, F.array(rest)), "")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules=RULES) -> DataFrame:
    """docs with every span (overlapping ones as one) in the text replaced by mark; null texts stay null."""
    found = find_spans(docs, text_col, rules)
    text = F.col(text_col)
    clean = mask(text, F.col("__spans"), lambda s: F.lit(mark))
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(text)).drop("__spans").select(docs.columns)
