"""DuckDB SQL for personal data by weak supervision: the same votes, rounds and counts, as joins of small tables."""

from __future__ import annotations

# The kinds' regexes and what labelers know, in RE2's syntax.
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_NAMES = "Alice|Anna|Antonio|Carlos|Carmen|Charles|Claire|David|Elena|Emma|Fatima|Hans|Hugo|Ivan|James|Jean|John|Jose|Juan|Julia|Karl|Laura|Linda|Louis|Lucia|Maria|Marie|Martin|Mary|Michael|Mohammed|Olga|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas|William"
_TOPS = "ca|com|de|edu|es|eu|fr|gov|info|io|it|net|nl|org|uk|us"
_ISSUER = r"^(?:2[2-7]|3[47]|4|5[1-5]|6011|65)"
_MAIL, _CARD = "contact|correo|courriel|e-?mail|mailto|reach|write to", "account|amex|card|carte|compte|credit|cuenta|karte|konto|tarjeta|visa"
_PHONE, _HOST = "anruf|call|cell|contact|fax|llam|mobile|phone|tel", "addr|client|host|ip|login|server"
_DIGITS = "[0-9](?:[ -]?[0-9])+"
# name, regex, value of good form, value that is listed, cue before
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\.[A-Za-z]{2,}$", rf"\.(?:{_TOPS})$", _MAIL),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.", None, _HOST),
    ("card", _DIGITS, "^[3-6]", _ISSUER, _CARD),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "(?:[0-9][^0-9]*){10}", r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", _PHONE),
    ("account", _DIGITS, "^[3-6]", _ISSUER, _CARD),
    ("iban", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", None, "^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)", "account|bank|compte|cuenta|iban|konto"),
    ("national_id", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "^(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:[0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)$", None, "national id|security|social|ssn|tax"),
    ("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", None, _PHONE),
    ("spelled_email", r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64} ?[\[(]dot[\])] ?[A-Za-z]{2,10}", "[a-z]$", rf"[^A-Za-z](?:{_TOPS})$", _MAIL),
    ("birth_date", "[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", f"^(?:{_YEAR}[./-]{_MONTH}[./-]{_DAY}|{_DAY}[./-]{_MONTH}[./-]{_YEAR}|{_MONTH}[./-]{_DAY}[./-]{_YEAR})$", None, "birth|born|dob|geboren|nacid"),
    ("person", rf"(?:(?:Dr|Frau|Herr|Madame|Monsieur|Mr|Mrs|Ms|Prof)\.?|{_NAMES}) [A-Z][a-z]{{1,20}}", " [A-Z][a-z]{2,}$", rf"\b(?:{_NAMES})\b", "author|contact|dear|name|regards|signed"),
    ("ipv6", "(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", ":", None, _HOST),
]
_AGAINST = r"(?:chapter|commit|figure|hash|invoice|isbn|order|page|secret|serial|sku|token|version|[$#%&=])[^a-z0-9]{0,4}$"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"\x09-\x0D "
_LUHN = "list_sum(list_transform(string_split(reverse(d), ''), lambda c, j: CASE WHEN j % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_IBAN = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(v, ' ', ''), 5) || replace(v, ' ', '')[:4], ''), lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)), lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1"""


def _case(column: str, choices: list[tuple[int, str]], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {what}" for k, what in choices) + f" ELSE {otherwise} END"


def _like(value: str, regex: str | None) -> str:
    return "false" if regex is None else f"regexp_matches({value}, '{regex}')"


def _class(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 WHEN {_like(c, f'[{_SPACE}]')} THEN 1 WHEN {_like(c, '[A-Za-z]')} OR unicode({c}) > 127 THEN 2 WHEN {_like(c, '[0-9]')} THEN 3 WHEN {c} IN (':', '=') THEN 4 WHEN {c} IN ('(', '<', '[', '\"', '''', '|') THEN 5 WHEN {c} IN ('.', ',', ';', '!', '?', ')', '>', ']') THEN 6 ELSE 7 END"


def build(rounds: int = 12) -> str:
    first = " UNION ALL ".join(f"SELECT r, {k} AS k, regexp_extract_all(t, '{rx}') AS ms, string_split_regex(t, '{rx}') AS gs FROM d WHERE regexp_matches(t, '{rx}')" for k, (_, rx, *_) in enumerate(_KINDS))
    n = len(_KINDS)
    luhn = f"len(d) BETWEEN 16 AND 19 AND {_LUHN}"
    passes = [(1, "list_min(list_transform(string_split(v, '.'), lambda x: len(ltrim(x, '0')) <= 3 AND ('0' || ltrim(x, '0'))[-4:]::INT <= 255))"), (2, luhn), (4, f"len(d) BETWEEN 12 AND 19 AND NOT ({luhn})"), (3, "len(d) BETWEEN 8 AND 15")]
    passes += [(k, r"NOT regexp_matches(l, '[0-9+][ ().-]{0,2}$') AND NOT regexp_matches(a, '^[ .-]?[0-9]')") for k in (6, 7, 9)]
    good = _case("k", [(k, _IBAN if name == "iban" else _like("v", form)) for k, (name, _, form, _, _) in enumerate(_KINDS)], "false")
    known = _case("k", [(k, _like("v", x)) for k, (_, _, _, x, _) in enumerate(_KINDS)], "false")
    cue = _case("k", [(k, _like("f", x)) for k, (*_, x) in enumerate(_KINDS)], "false")
    stands = rf"""regexp_matches(f, '(?:^|[{_SPACE}(\[<"''|:;,])$') AND regexp_matches(a, '^(?:$|[{_SPACE})\]>"''|:;,.!?])')"""
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        f"x AS ({first})",
        "u AS (SELECT r, k, unnest(ms) AS v, unnest(gs[:len(ms)]) AS g, unnest(gs[2:]) AS nx, generate_subscripts(ms, 1) AS i FROM x)",
        "e AS (SELECT *, sum(len(g) + len(v)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM u)",
        f"m AS (SELECT r, k, (e - len(v))::BIGINT AS s, e::BIGINT AS e, v, g[-40:] AS l, nx[:12] AS a, regexp_replace(v, '[^0-9]', '', 'g') AS d, {_FOLD.format('g[-40:]')} AS f FROM e)",
        f"""c AS MATERIALIZED (SELECT row_number() OVER () AS c, r, k, s, e, CASE WHEN {good} THEN 1 ELSE -1 END AS v0, CASE WHEN {known} THEN 1 ELSE 0 END AS v1, CASE WHEN {cue} THEN 1 ELSE 0 END AS v2,
        CASE WHEN regexp_matches(f, '{_AGAINST}') THEN -1 ELSE 0 END AS v3, CASE WHEN {stands} THEN 1 ELSE -1 END AS v4, CASE WHEN min(k) OVER (PARTITION BY r) < max(k) OVER (PARTITION BY r) THEN 1 ELSE 0 END AS v5,
        32 + k * 16 + least(len(v) // 4, 15) AS t0, 256 + k * 8 + {_class("l[-1:]")} AS t1, 384 + k * 8 + {_class("a[:1]")} AS t2,
        4096 + ('0x' || md5({_case("k", [(k, f"'{name} '") for k, (name, *_) in enumerate(_KINDS)], "''")} || regexp_extract(f, '([^{_SPACE}]+)[{_SPACE}]*$', 1))[:3])::INT AS t3 FROM m WHERE {_case("k", passes, "true")})""",
        "vt AS MATERIALIZED (SELECT k, v0, v1, v2, v3, v4, v5, count(*) AS n FROM c GROUP BY ALL)",
        "cell AS MATERIALIZED (SELECT k, v0, v1, v2, v3, v4, v5, n, unnest([100 + k, v0 + 1, v1 + 4, v2 + 7, v3 + 10, v4 + 13, v5 + 16]) AS cell FROM vt)",
        f"cells AS (SELECT unnest([{', '.join(map(str, [*range(18), *range(100, 100 + n)]))}]) AS cell)",
        "w0 AS MATERIALIZED (SELECT cell, CASE WHEN cell >= 100 THEN ln(2 / 8) WHEN cell % 3 = 0 THEN ln(5 / 20) WHEN cell % 3 = 1 THEN 0 ELSE ln(20 / 5) END AS w FROM cells)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"p{k} AS MATERIALIZED (SELECT k, v0, v1, v2, v3, v4, v5, any_value(n) AS n, round(1000000 / (1 + exp(-sum(w))))::BIGINT AS p FROM cell JOIN w{k} USING (cell) GROUP BY k, v0, v1, v2, v3, v4, v5)")
        if k < rounds:
            ctes.append(f"q{k} AS (SELECT cells.cell, coalesce(sum(c.n * p.p), 0) / 1000000 AS t, coalesce(sum(c.n * (1000000 - p.p)), 0) / 1000000 AS f FROM cells LEFT JOIN cell c USING (cell) LEFT JOIN p{k} p USING (k, v0, v1, v2, v3, v4, v5) GROUP BY cells.cell)")
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT cell, CASE WHEN cell >= 100 THEN ln((t + 2) / (f + 8)) ELSE ln((t + [5, 10, 20][cell % 3 + 1]) / (a + 35)) - ln((f + [20, 10, 5][cell % 3 + 1]) / (b + 35)) END AS w FROM q{k}, (SELECT sum(t) AS a, sum(f) AS b FROM q{k} WHERE cell >= 100))")
    ctes += [
        f"tk AS MATERIALIZED (SELECT c, k, unnest([v0 + 1, v1 + 4, v2 + 7, v3 + 10, v4 + 13, v5 + 16, 18 + k, t0, t1, t2, t3]) AS tok, p FROM c JOIN p{rounds} USING (k, v0, v1, v2, v3, v4, v5))",
        "kt AS MATERIALIZED (SELECT k, sum(p) / 1000000 AS a, (count(*) * 1000000 - sum(p)) / 1000000 AS b FROM tk WHERE tok BETWEEN 18 AND 31 GROUP BY k)",
        "tt AS (SELECT tok, sum(p) / 1000000 AS t, (count(*) * 1000000 - sum(p)) / 1000000 AS f, list_distinct(list(k)) AS ks FROM tk GROUP BY tok)",
        "tot AS (SELECT tok, t, f, CASE WHEN tok < 18 THEN (SELECT sum(a) FROM kt) ELSE (SELECT sum(a) FROM kt WHERE k IN (SELECT unnest(ks))) END AS a, CASE WHEN tok < 18 THEN (SELECT sum(b) FROM kt) ELSE (SELECT sum(b) FROM kt WHERE k IN (SELECT unnest(ks))) END AS b FROM tt)",
        "nb AS MATERIALIZED (SELECT tok, round_even(1000000 * CASE WHEN tok BETWEEN 18 AND 31 THEN ln((t + 2) / (f + 8)) ELSE ln((t + 1) / (a + 4)) - ln((f + 1) / (b + 4)) END, 0)::BIGINT AS w FROM tot)",
        "ok AS (SELECT c FROM tk JOIN nb USING (tok) GROUP BY c HAVING sum(w) >= 0 OR any_value(k) < 4)",
        f"s AS (SELECT r, k, s, {_case('k', [(k, chr(39) + name + chr(39)) for k, (name, *_) in enumerate(_KINDS)], chr(39) * 2)} || ':' || s || ':' || e AS x FROM c JOIN ok USING (c))",
        "g AS (SELECT r, " + ", ".join(f"count(*) FILTER (k = {k}) AS n{k}" for k in range(4)) + ", string_agg(x, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(x, ',' ORDER BY k, s) AS spans FROM s GROUP BY r)",
    ]
    names = ", ".join(f"coalesce(n{k}, 0) AS n_{_KINDS[k][0]}" for k in range(4))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"


PERSONAL_DATA = build()
