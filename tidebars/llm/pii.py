"""Personal data by weak supervision, all in DataFrame functions.

Regexes propose candidates of each kind; the four base kinds that pass their own check are always
spans. Six labelers vote on every candidate (yes, no or nothing): the value's format, a gazetteer, cue
words before it, words that speak against it, its borders, and other kinds in the same text.
Expectation-maximisation over the counts of all votes estimates how often each labeler votes how on
true and on false candidates; there are at most 3 ** 6 votes a kind, so a round adds up a table whose
size doesn't depend on the corpus, and only its sums come to the driver. The probabilities that it
leaves are the soft labels on which a final classifier is trained: naive Bayes over the votes, the
kind, the length, the neighbouring characters and the word before, counted over all candidates.
A candidate is a span if the classifier's log odds aren't negative.

All sums are of whole numbers (millionths), so that the result doesn't depend on the order of the rows.

Defined results: a null text counts as empty; without a span n_* are 0 and spans is ''. Repeated rows and
repeated or null ids each get their own result, and each counts in the training. Texts are never shuffled.
An empty table gives an empty one. `redact` passes all columns, whatever their names; `digest` takes two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import ascii_lower, materialize
from tidebars.llm.secrets import _bound, _by_blocks, mask

# Names, words and number ranges that the labelers know.
GIVEN_NAMES = "Alice|Anna|Antonio|Carlos|Carmen|Charles|Claire|David|Elena|Emma|Fatima|Hans|Hugo|Ivan|James|Jean|John|Jose|Juan|Julia|Karl|Laura|Linda|Louis|Lucia|Maria|Marie|Martin|Mary|Michael|Mohammed|Olga|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas|William"
TITLES = "Dr|Frau|Herr|Madame|Monsieur|Mr|Mrs|Ms|Prof"
DOMAINS = "ca|com|de|edu|es|eu|fr|gov|info|io|it|net|nl|org|uk|us"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "2[2-7]|3[47]|4|5[1-5]|6011|65"
MAIL_CUES = "contact|correo|courriel|e-?mail|mailto|reach|write to"
CARD_CUES = "account|amex|card|carte|compte|credit|cuenta|karte|konto|tarjeta|visa"
PHONE_CUES = "anruf|call|cell|contact|fax|llam|mobile|phone|tel"
HOST_CUES = "addr|client|host|ip|login|server"
AGAINST = r"(?:chapter|commit|figure|hash|invoice|isbn|order|page|secret|serial|sku|token|version|[$#%&=])[^a-z0-9]{0,4}\z"
NEVER = r"[^\x{0}-\x{10FFFF}]"


@dataclass(frozen=True)
class Kind:
    """regex: proposes candidates (for Java: repeated groups possessive, so that no text is matched by recursion);
    format, known: what a value of good form has, and one that a gazetteer lists; cue: what stands before, in lower case."""

    name: str
    regex: str
    format: str
    known: str = NEVER
    cue: str = NEVER
    base: bool = False
    alone: bool = False


_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    # a local part is looked for at its first character only, or where the last match ended
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"\.[A-Za-z]{2,}\z", rf"\.(?:{DOMAINS})\z", MAIL_CUES, base=True),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\A(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.", cue=HOST_CUES, base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"\A[3-6]", rf"\A(?:{ISSUERS})", CARD_CUES, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"(?:[0-9][^0-9]*){10}", rf"\A\+(?:{CALLING_CODES})", PHONE_CUES, base=True),
    Kind("account", r"[0-9](?:[\x20-]?[0-9])++", r"\A[3-6]", rf"\A(?:{ISSUERS})", CARD_CUES),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", rf"\A(?:{IBAN_COUNTRIES})", "account|bank|compte|cuenta|iban|konto"),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\A(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:[0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)\z", cue="national id|security|social|ssn|tax", alone=True),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"\A\(?[2-9][0-9]{2}\)?[\x20.-][2-9]", cue=PHONE_CUES, alone=True),
    Kind("spelled_email", rf"[{_LOCAL}]{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,64}}\x20?[\[(]dot[\])]\x20?[A-Za-z]{{2,10}}", r"[a-z]\z", rf"[^A-Za-z](?:{DOMAINS})\z", MAIL_CUES),
    Kind("birth_date", r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", rf"\A(?:{_YEAR}[./-]{_MONTH}[./-]{_DAY}|{_DAY}[./-]{_MONTH}[./-]{_YEAR}|{_MONTH}[./-]{_DAY}[./-]{_YEAR})\z", cue="birth|born|dob|geboren|nacid", alone=True),
    Kind("person", rf"(?:(?:{TITLES})\.?|{GIVEN_NAMES})\x20[A-Z][a-z]{{1,20}}", r"\x20[A-Z][a-z]{2,}\z", rf"\b(?:{GIVEN_NAMES})\b", "author|contact|dear|name|regards|signed"),
    Kind("ipv6", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", r":", cue=HOST_CUES),
)
LABELERS = ("format", "gazetteer", "cue", "against", "border", "company")
#: Characters before and after a match that labelers see, back to the last match of its kind.
BEFORE, AFTER = 40, 12
#: How often labelers are taken to have voted no, nothing, yes on true and on false candidates before any is seen.
PRIOR_TRUE, PRIOR_FALSE = (5, 10, 20), (20, 10, 5)
#: True and false candidates of each kind before any is seen.
PRIOR_KIND = (2, 8)
ROUNDS = 12
MILLION = 1_000_000
VOTES, KIND_AT, LENGTH_AT, LAST_AT, NEXT_AT, WORD_AT, TOKENS = 0, 18, 32, 256, 384, 4096, 8192


def _matches(text: Column, regex: str) -> Column:
    """Leftmost matches: start, end, value, and what stands before and after it, by code points."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")

    def parts(values: Column, gaps: Column) -> Column:
        return F.transform(
            values,
            lambda v, i: F.struct(
                F.length(F.get(gaps, i)).alias("g"), F.length(v).alias("m"), v.alias("value"), F.substring(F.get(gaps, i), -BEFORE, BEFORE).alias("left"), F.substring(F.get(gaps, i + 1), 1, AFTER).alias("right")
            ),
        )

    def build(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("found")).cast("struct<at:int,found:array<struct<start:int,end:int,value:string,left:string,right:string>>>")

        def step(state: Column, p: Column) -> Column:
            begin = state["at"] + p["g"]
            return F.struct((begin + p["m"]).alias("at"), F.array_append(state["found"], F.struct(begin.alias("start"), (begin + p["m"]).alias("end"), p["value"], p["left"], p["right"])).alias("found"))

        return F.aggregate(block, first, step, lambda s: s["found"])

    found = _bound(F.split(text, regex, -1), lambda gaps: parts(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), gaps))
    placed = _by_blocks(found, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + p["g"] + p["m"]), lambda t: F.aggregate(t, F.lit(0), lambda n, x: n + x), build)
    return F.when(text.rlike(regex), placed).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, each second one from the right doubled, is divisible by 10."""
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda n, d: n + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _remainder(value: Column) -> Column:
    """An account number's remainder by 97, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55) % 97)


def _passes(kind: Kind, m: Column) -> Column:
    """Whether a match is a candidate: the base kinds' own checks, and no digits next to a number."""
    value = m["value"]
    if kind.name == "ip":
        return value.rlike(r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[1-9])?+(?:\.|\z)){4}\z")
    if kind.name in ("card", "account"):
        luhn = F.length(_digits(value)).between(16, 19) & F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value)))
        return luhn if kind.base else F.length(_digits(value)).between(12, 19) & ~luhn
    if kind.name == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind.alone:
        return ~m["left"].rlike(r"[0-9+][\x20().-]{0,2}\z") & ~m["right"].rlike(r"\A[\x20.-]?[0-9]")
    return F.lit(True)


def _class(c: Column) -> Column:
    """0 nothing, 1 blank, 2 letter, 3 digit, 4 to 7 signs."""
    for regex, n in ((r"[\x20\x09-\x0D]", 1), (r"[A-Za-z]|[^\x00-\x7F]", 2), (r"[0-9]", 3), (r"[:=]", 4), (r"""[(<\["'|]""", 5), (r"[.,;!?)>\]]", 6)):
        out = F.when(c.rlike(regex), n) if n == 1 else out.when(c.rlike(regex), n)
    return F.when(c == "", 0).otherwise(out.otherwise(7))


def _judged(number: int, kind: Kind, m: Column) -> Column:
    """A candidate with the votes of all labelers but the last, and the tokens that need no votes."""
    value, left, right = m["value"], ascii_lower(m["left"]), m["right"]
    good = _remainder(value) == 1 if kind.name == "iban" else value.rlike(kind.format)
    stands = left.rlike(r"""(?:\A|[\x20\x09-\x0D(\[<"'|:;,])\z""") & right.rlike(r"""\A(?:\z|[\x20\x09-\x0D)\]>"'|:;,.!?])""")
    votes = F.array(
        F.when(good, 1).otherwise(-1), F.when(value.rlike(kind.known), 1).otherwise(0), F.when(left.rlike(kind.cue), 1).otherwise(0), F.when(left.rlike(AGAINST), -1).otherwise(0), F.when(stands, 1).otherwise(-1)
    )
    word = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z", 1)
    tokens = F.array(
        F.lit(KIND_AT + number),
        LENGTH_AT + number * 16 + F.least(F.floor(F.length(value) / 4).cast("int"), F.lit(15)),
        LAST_AT + number * 8 + _class(F.substring(m["left"], -1, 1)),
        NEXT_AT + number * 8 + _class(F.substring(right, 1, 1)),
        WORD_AT + F.conv(F.substring(F.md5(F.concat(F.lit(f"{kind.name} "), word)), 1, 3), 16, 10).cast("int"),
    )
    return F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), votes.alias("votes"), tokens.alias("tokens"))


FOUND = "array<struct<kind:int,start:int,end:int,pattern:int,tokens:array<int>>>"


def candidates(text: Column) -> Column:
    """All candidates of a text by kind, then start: kind, start, end, pattern (the votes as a number) and tokens."""
    text = F.coalesce(text, F.lit(""))

    def of(number: int, kind: Kind) -> Column:
        return F.transform(F.filter(_matches(text, kind.regex), lambda m: _passes(kind, m)), lambda m: _judged(number, kind, m))

    def finished(every: Column, company: Column) -> Column:
        def finish(c: Column) -> Column:
            votes = F.concat(c["votes"], F.array(company))
            pattern = F.aggregate(votes, F.lit(0), lambda n, v: n * 3 + v + 1)
            return F.struct(c["kind"], c["start"], c["end"], pattern.alias("pattern"), F.concat(F.transform(votes, lambda v, i: VOTES + i * 3 + v + 1), c["tokens"]).alias("tokens"))

        return F.transform(every, finish)

    def with_company(every: Column) -> Column:
        kinds = F.transform(every, lambda c: c["kind"])
        return _bound(F.when(F.array_min(kinds) < F.array_max(kinds), 1).otherwise(0), lambda company: finished(every, company))

    return _bound(F.concat(*[of(n, k) for n, k in enumerate(KINDS)]), with_company).cast(FOUND)


def _vote(labeler: int) -> Column:
    return F.floor(F.col("pattern") / 3 ** (len(LABELERS) - 1 - labeler)).cast("int") % 3


@dataclass(frozen=True)
class Reliabilities:
    """The probability of each kind's candidates to be true; of each labeler's votes (no, nothing, yes) on true and on false ones."""

    kinds: tuple[float, ...]
    true: tuple[tuple[float, ...], ...]
    false: tuple[tuple[float, ...], ...]

    def odds(self) -> Column:
        """Log odds of (kind, pattern)."""
        kinds = F.get(F.array(*[F.lit(log(p / (1 - p))) for p in self.kinds]), F.col("kind"))
        return reduce(lambda a, b: a + b, [F.get(F.array(*[F.lit(log(t / f)) for t, f in zip(ts, fs)]), _vote(n)) for n, (ts, fs) in enumerate(zip(self.true, self.false))], kinds)

    def chance(self) -> Column:
        """The probability to be true, in millionths."""
        return F.round(MILLION / (1 + F.exp(-self.odds()))).cast("long")


def estimate(votes: DataFrame, rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation over votes: kind, pattern, n (how many candidates); at most 3 ** 6 rows a kind."""
    norm = lambda counts: tuple(c / sum(counts) for c in counts)
    now = Reliabilities(tuple(norm(PRIOR_KIND)[0] for _ in KINDS), tuple(norm(PRIOR_TRUE) for _ in LABELERS), tuple(norm(PRIOR_FALSE) for _ in LABELERS))
    cells = [(F.col("kind") == k) for k in range(len(KINDS))] + [(_vote(n) == v) for n in range(len(LABELERS)) for v in range(3)]
    add = lambda value: [F.sum(F.when(c, value).otherwise(0)).alias(f"c{i}") for i, c in enumerate(cells)]
    every = votes.agg(*add(F.col("n") * MILLION)).first()
    for _ in range(rounds if every[0] is not None else 0):
        good = votes.agg(*add(F.col("n") * now.chance())).first()
        true, false = [x / MILLION for x in good], [(x - y) / MILLION for x, y in zip(every, good)]
        kinds = tuple((t + PRIOR_KIND[0]) / (t + f + sum(PRIOR_KIND)) for t, f in zip(true[: len(KINDS)], false))
        by_vote = lambda counts, prior: tuple(norm([counts[len(KINDS) + n * 3 + v] + prior[v] for v in range(3)]) for n in range(len(LABELERS)))
        now = Reliabilities(kinds, by_vote(true, PRIOR_TRUE), by_vote(false, PRIOR_FALSE))
    return now


def train(found: DataFrame) -> list[int]:
    """The classifier: a weight in millionths for each token; found: `candidates` in a column named found, one row a text."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.pattern", "c.tokens")
    votes = materialize(each.groupBy("kind", "pattern").agg(F.count("*").alias("n")), "votes", rows=len(KINDS) * 3 ** len(LABELERS))
    chances = votes.select("kind", "pattern", estimate(votes).chance().alias("chance"))
    tokens = each.select("kind", "pattern", F.explode("tokens").alias("token")).groupBy("kind", "pattern", "token").agg(F.count("*").alias("n"))
    # at most 3 ** 6 rows a kind
    soft = tokens.join(F.broadcast(chances), ["kind", "pattern"]).groupBy("token", "kind").agg(F.sum(F.col("n") * F.col("chance")).alias("true"), F.sum("n").alias("n"))
    rows = soft.collect()  # TOKENS tokens, of which the votes and words have a row for each kind
    true, every, kind_true, kind_every = [0] * TOKENS, [0] * TOKENS, [0] * len(KINDS), [0] * len(KINDS)
    owner = {}
    for r in rows:
        true[r["token"]] += r["true"]
        every[r["token"]] += r["n"] * MILLION
        owner.setdefault(r["token"], set()).add(r["kind"])
        if KIND_AT <= r["token"] < LENGTH_AT:
            kind_true[r["kind"]] += r["true"]
            kind_every[r["kind"]] += r["n"] * MILLION
    weights = [0] * TOKENS
    for t in owner:
        of_kinds = range(len(KINDS)) if t < KIND_AT else owner[t]
        all_true, all_every = sum(kind_true[k] for k in of_kinds), sum(kind_every[k] for k in of_kinds)
        yes, no = true[t] / MILLION, (every[t] - true[t]) / MILLION
        if KIND_AT <= t < LENGTH_AT:
            ratio = log((yes + PRIOR_KIND[0]) / (no + PRIOR_KIND[1]))
        else:
            ratio = log((yes + 1) / (all_true / MILLION + 4)) - log((no + 1) / ((all_every - all_true) / MILLION + 4))
        weights[t] = round(ratio * MILLION)
    return weights


def accepted(found: Column, weights: list[int]) -> Column:
    """The candidates that are spans: the base kinds, and those whose log odds aren't negative."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")
    base = sum(k.base for k in KINDS)
    return F.filter(found, lambda c: (c["kind"] < base) | (F.aggregate(c["tokens"], F.lit(0).cast("long"), lambda n, t: n + F.get(table, t)) >= 0))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the counts of the base kinds, the SHA-256 of their spans, and all spans.

    Texts are read once; their candidates are written, and training and verdicts read those.
    """
    found = materialize(docs.select(F.col(id_col).alias("__id"), candidates(F.col(text_col)).alias("found")), "candidates")
    weights = train(found)
    kept = found.select("__id", accepted(F.col("found"), weights).alias("spans"))
    base = [n for n, k in enumerate(KINDS) if k.base]

    def of(kinds: list[int]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    counts = [F.size(of([n])).cast("long").alias(f"n_{KINDS[n].name}") for n in base]
    return kept.select(F.col("__id").alias(id_col), *counts, F.sha2(spans_text(of(base)), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, weights: list[int], text_col: str = "text", mark: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> DataFrame:
    """docs with each span in the text replaced by its kind's mark (overlapping ones by the first one's); null texts stay null."""
    marks = F.array(*[F.lit(mark(k.name)) for k in KINDS])
    spans = F.array_sort(F.transform(accepted(candidates(F.col(text_col)), weights), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    clean = _bound(spans, lambda found: F.when(F.size(found) > 0, mask(F.col(text_col), found, lambda s: F.get(marks, s["kind"]))).otherwise(F.col(text_col)))
    return docs.withColumn(text_col, clean).select(docs.columns)
