import hashlib
import random
import re
import time

import pytest
from whence.llm import personal as P

REGEXES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base kinds as their expressions say, each over the whole text."""
    out = []
    for kind, expression in REGEXES.items():
        for m in re.finditer(expression, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def texts(seed, n, long=40):
    rng = random.Random(seed)
    pool = ["@", ".", "+", "-", " ", "  ", "(", ")", "%", "_", "a", "Zz", "é", "日", "\n", "0", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "x@y.z", "://", "IBAN", "٠", "tel:"]
    for _ in range(n):
        few = rng.sample(pool, rng.randint(2, 9))
        yield "".join(rng.choice(few) for _ in range(rng.randint(0, long)))


def test_base_kinds_against_their_expressions():
    hits = dict.fromkeys(P.BASE, 0)
    for text in [*texts(1, 30_000), *texts(2, 200, 3000)]:
        got = [s for s in P.find(text) if s[0] in P.BASE]
        assert got == brute(text), text
        for kind, _, _ in got:
            hits[kind] += 1
    assert min(hits.values()) > 100, hits


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 IS MINE", [("account", "DE89 3704 0044 0532 0130 00")]),
        ("iban GB82WEST12345698765432.", [("account", "GB82WEST12345698765432")]),
        ("IBAN: DE88 3704 0044 0532 0130 00", []),
        ("My account no. 12345678, thanks", [("account", "12345678")]),
        ("accounts 12345678; accountability 12345678; account of 2024", []),
        ("SSN 123-45-6789 and SSN 000-12-3456", [("ssn", "123-45-6789")]),
        ("social security number: 219 09 9999", [("ssn", "219 09 9999")]),
        ("Passport No: X1234567 passport office", [("passport", "X1234567")]),
        ("see https://joe:secret@example.org/x and http://example.org/a@b", [("email", "secret@example.org"), ("login", "https://joe:secret@example.org")]),
        ("http://[2001:db8::1]/ http://[::zz]/", [("ip6", "2001:db8::1")]),
        ("tel:0171-555-1234 hotel:0171-555-1234", [("tel", "0171-555-1234")]),
        ("account: 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ("write to me@host or a.b+c@x-y.example.com.", [("email", "a.b+c@x-y.example.com")]),
        ("1.2.3.4.5.6.7.8 300.1.1.1 1.2.3", [("ip", "1.2.3.4"), ("ip", "5.6.7.8")]),
        ("+1 (743) 555-3824 +49 +123", [("phone", "+1 (743) 555-3824")]),
    ],
)
def test_cases(text, want):
    assert [(k, text[s:e]) for k, s, e in P.find(text)] == want


def test_plain_prose_has_nothing():
    assert P.find("On 12 May 2024 we met at 10.30, paid 1,234.50 and read 300 pages; see https://example.org/a?b=1 - a passport is needed, no account.") == []


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1" + " " * 1_000_000, "a@" * 400_000, "a@b" * 300_000, "a@b.c " * 100_000 + "http://u:p@h " * 50_000, "IBAN DE" * 100_000):
        began = time.time()
        P.find(text)
        assert time.time() - began < 10, text[:20]


def test_masking():
    assert P.masked("mail joe@example.com, call +1 743 555 3824") == "mail <EMAIL>, call <PHONE>"
    assert P.masked("https://joe:secret@example.org/x") == "<LOGIN>/x"
    assert P.masked("") == ""


def test_query_columns(spark):
    rows = [(1, "me@x.org 10.0.0.1", 7, "k"), (2, None, 7, "k"), (None, "+1 743 555 3824", 7, "k"), (1, "me@x.org 10.0.0.1", 7, "k"), (4, "é " * 50_000 + "a@b.c", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, id string").repartition(2)
    got = sorted(((r.id, [tuple(s) for s in r.spans]) for r in P.spans(df).collect()), key=str)
    assert got == sorted(((i, brute(t or "")) for i, t, *_ in rows), key=str)
    assert P.spans(df.limit(0)).collect() == []
    kept = P.redacted(df).collect()
    assert sorted(((r.doc_id, r.text, r.spans) for r in kept), key=str) == sorted(((i, None if t is None else P.masked(t), n) for i, t, n, _ in rows), key=str)


def test_query(spark, tmp_path):
    text = "me@x.org 10.0.0.1, 4111 1111 1111 1111 and SSN 123-45-6789"
    spark.createDataFrame([(5, text), (6, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = sorted(P.op12_personal(spark, str(tmp_path)).collect())
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    assert (a.doc_id, a.n_email, a.n_ip, a.n_card, a.n_phone) == (5, 1, 1, 1, 0)
    assert a.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and a.spans == base + ",ssn:47:58"
    assert (b.n_email, b.spans, b.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
