"""Personal data against brute force for the base kinds and against the SQL for all, on texts made to be hard."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import pii, pii_sql, secrets

SCHEMA = "doc_id long, text string, found string, spans string"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


CARD = next(c for c in (f"41111111{k:08d}" for k in range(11)) if luhn(c))
TEXTS = [
    None, "", "   ", "nothing here", "write to a.b@c.d.example.com, or x@y", "a@b.c_x@d.e a@b..c @d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 000255.0.0.1 1.2.3.0004 1.2.3",
    f"card {CARD} or {CARD[:4]}-{CARD[4:8]} {CARD[8:12]} {CARD[12:]}, not {CARD[:-1]}0 nor 1234567890123", "call +1 (918) 555-3922 or +44 20 7946 0958, not +1 2 nor +1234567890123456 +1.",
    "my ssn 123-45-6789, not 000-12-3456 or 1123-45-67890", "phone (212) 555-0187 and 212.555.0187; 999 111 2222", "iban DE89 3704 0044 0532 0130 00 and DE00370400440532013000, GB82WEST12345698765432",
    "born 1984-02-29 in; dob: 31/12/1999. Version 10.11.2012 order 1/2/3", "name: Maria Gomez, Dr. Strange, Frau Merkel, Peter x", "john [at] example [dot] com, j(at)x(dot)zz", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ok",
    "\U0001f600 é a@b.co é\n+1 (918) 555-3922 +1 (918) 555-3922\x0b1.2.3.4", 'token = "473a0a5afa59a0df9c0d8d3cd5867fe7054a91c7"', "1" * 17, "+" * 50, "%" * 40 + "@x.yz",
]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    pieces = [t for t in TEXTS if t] + ["mail", "card", "tel", "ssn", "invoice", "born", ",", ": ", "\n", "="]
    out = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[4]), (3, TEXTS[4]), (None, TEXTS[8])]
    return out + [(100 + k, "".join(str(pieces[int(i)])[int(a) : int(a) + 60] + " " * int(b) for i, a, b in zip(r.integers(0, len(pieces), 8), r.integers(0, 12, 8), r.integers(0, 2, 8)))) for k in range(300)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def base_spans(text):
    """By the contract, kind by kind."""
    out = []
    for kind, regex in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_stay(docs, rows):
    got = pii.digest(docs).collect()
    want = sorted((str(i), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in base_spans(t)) for k in ("email:", "ip:", "card:", "phone:"))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    by_text = {i: t for i, t in rows}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("email", "ip", "card", "phone")] == base_spans(by_text[r["doc_id"]])


def test_all_spans_are_those_of_the_sql(docs, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sorted(con.execute(pii_sql.PERSONAL_DATA).fetchall(), key=str)
    got = pii.digest(docs)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == want
    assert {s.split(":")[0] for r in want for s in r[-1].split(",") if s} >= {"email", "ip", "card", "phone", "iban", "person"}


def test_reliabilities_are_found(spark):
    """Planted labelers: votes drawn by known probabilities."""
    r = np.random.default_rng(8)
    truth = r.random(20000) < 0.3
    sure = [0.95, 0.8, 0.7, 0.6, 0.9, 0.55]
    votes = np.stack([np.where(r.random(len(truth)) < p, truth, ~truth) * 2 for p in sure])
    pattern = votes.T @ 3 ** np.arange(5, -1, -1)
    table = spark.createDataFrame([(0, int(p), int((pattern == p).sum())) for p in np.unique(pattern)], "kind int, pattern int, n long")
    found = pii.estimate(table, 40)
    assert abs(found.kinds[0] - truth.mean()) < 0.02
    for n, p in enumerate(sure):
        assert abs(found.true[n][2] - p) < 0.03 and abs(found.false[n][0] - p) < 0.03


def test_masked_texts(docs, rows):
    weights = pii.train(docs.select(pii.candidates(F.col("text")).alias("found")))
    masked = pii.redact(docs, weights)
    assert masked.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in masked.collect()}
    assert (0, None) in texts and (1, "") in texts and (3, "nothing here") in texts and (3, "write to [EMAIL], or x@y") in texts
    assert any(t.startswith("call [PHONE] or [PHONE], not +1 2 nor +") for i, t in texts if i == 8 and t.startswith("call"))
    assert not any(base_spans(t) for _, t in texts if t and "[" not in t)


def test_long_texts(spark):
    """Nothing is matched by recursion or in quadratic time."""
    runs = ["a" * 200_000, "a@b" + ".c" * 100_000, "1" * 200_000, "1." * 100_000, "1 " * 100_000, "+1" + " " * 100_000, "A1" * 100_000, "a@b.co " * 5000, "-----BEGIN" + " A" * 200_000 + " PRIVATE KEY-----"]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert [found[k]["n_email"] for k in range(9)] == [0, 1, 0, 0, 0, 0, 0, 5000, 0] and found[3]["n_ip"] == 25_000
    scanned = {r["doc_id"]: r["spans"] for r in secrets.digest(docs).collect()}
    assert scanned[8] == f"private_key:0:{len(runs[8])}"
    assert secrets.redact(docs).where("doc_id = 8").first()["text"] == "[SECRET]"


def test_no_rows(spark, docs):
    assert pii.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    plain = pii.digest(docs.where("doc_id < 3")).collect()
    assert {(r["n_email"], r["spans"]) for r in plain} == {(0, "")}


def test_rules_that_recurse_are_refused():
    with pytest.raises(ValueError):
        secrets.Rule("bad", "x(?: [A-Z]+)*y")
    secrets.Rule("good", "x(?: [A-Z]+)*+y(?:ab){1,9}[a-z]+(?:q|[0-9]+)?")
