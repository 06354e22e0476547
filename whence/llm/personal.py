"""Personal data in texts, by anchors that local parsers expand.

One Aho-Corasick automaton runs over a whole text and stops at anchors only: at
signs, dots and blanks between digits, plus signs before digits, schemes, and
cues such as `IBAN` or `passport`.  At each a small parser goes left and right as
far as its kind reaches, and then validates what it holds.  Anchors of a kind
come in the order of the text, so a parser that remembers where its last match
ended gives leftmost matches that don't overlap.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds whose matches are fixed, in the order in which they are listed, and those that this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "ip6", "tel", "account", "ssn", "passport")
ORDER = {kind: i for i, kind in enumerate(BASE + ADDED)}

#: How each kind goes on to the right of where it starts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = "0123456789"
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LOGIN = re.compile(r"[^\s/?#@:\[\]<>\"']{1,256}(?::[^\s/?#@<>\"']{0,256})?@(?:\[[0-9A-Fa-f:.]{2,45}\]|[A-Za-z0-9.-]{1,253})(?::[0-9]{1,5})?")
_SIX = re.compile(r"\[([0-9A-Fa-f:.]{2,45})\]")
_TEL = re.compile(r"[0-9](?:[-.()\x20]?[0-9()]){5,19}")
#: What may stand between a cue and its value.
_GAP = re.compile(r"(?:\x20?(?:no|nr|num|number|nummer|numéro|número|is|ist|est|es)\b\.?|[\x20:#=.°-]){1,6}", re.IGNORECASE)
_ACCOUNT = re.compile(r"[0-9](?:[-\x20]?[0-9]){5,16}(?![0-9A-Za-z])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){1,30}")
#: Characters of an IBAN by country.
_IBAN_SIZES = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 "
        "RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_SSN = re.compile(r"([0-9]{3})[-\x20]([0-9]{2})[-\x20]([0-9]{4})(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"[A-Z0-9]{6,9}(?![0-9A-Za-z])")
#: Cues of identifiers, by the parser that takes over; also written Large and LARGE.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "kontonummer": "account",
    "konto": "account",
    "compte": "account",
    "cuenta": "account",
    "ssn": "ssn",
    "social security": "ssn",
    "passport": "passport",
    "passeport": "passport",
    "pasaporte": "passport",
    "reisepass": "passport",
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "scheme", "tel:": "tel"}
    for a in _DIGITS:
        anchors["+" + a] = "phone"
        for b in _DIGITS:
            anchors[f"{a}.{b}"] = "ip"
            anchors |= {a + between + b: "card" for between in ("", " ", "-")}
    for cue, kind in CUES.items():
        anchors |= {cue: kind, cue.capitalize(): kind, cue.upper(): kind}
    for anchor, kind in anchors.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its digits added: the sum ends in zero."""
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _email(text: str, at: int, last: int) -> tuple[int, int] | None:
    right = _DOMAIN.match(text, at + 1)
    if not right:
        return None
    start = at
    while start > last and text[start - 1] in _LOCAL:
        start -= 1
    return (start, right.end()) if start < at else None


def _ip(text: str, at: int, last: int) -> tuple[int, int, bool] | None:
    """at: the digit before the first dot."""
    start = at
    while start > last and text[start - 1] in _DIGITS:
        start -= 1
    m = _IP.match(text, start)
    return m and (start, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()))


def _card(text: str, at: int) -> tuple[int, int, bool]:
    end = _CARD.match(text, at).end()
    if end - at > 40:  # 19 digits with a blank between all are 37 characters
        return at, end, False
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at)
    return m and (at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)


def _scheme(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """at: the colon.  A login in an address, or a literal IPv6 host."""
    start = at
    while start > 0 and at - start < 20 and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    if start == at:
        return
    host = at + 3
    if m := _LOGIN.match(text, host):
        yield "login", start, m.end()
        host = text.index("@", host) + 1
    if m := _SIX.match(text, host):
        try:
            ipaddress.IPv6Address(m[1])
        except ValueError:
            return
        yield "ip6", m.start(1), m.end(1)


def _tel(text: str, at: int) -> tuple[str, int, int] | None:
    m = _TEL.match(text, at)
    return ("tel", at, m.end()) if m and 7 <= sum(c in _DIGITS for c in m[0]) <= 15 else None


def _iban(text: str, at: int) -> int | None:
    """Where the account number that begins here ends, if its length and check digits are right."""
    m = _IBAN.match(text, at)
    size = _IBAN_SIZES.get(text[at : at + 2])
    if not m or not size:
        return None
    code, end = "", at
    while len(code) < size and end < m.end():
        code += text[end].strip()
        end += 1
    if len(code) < size or text[end : end + 1].isalnum() or int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 != 1:
        return None
    return end


def _cued(text: str, cue: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The identifier after a cue, which must be a word of its own."""
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return None
    gap = _GAP.match(text, end)
    at = gap.end() if gap else end
    if at == end:
        return None
    if cue in ("iban", "account") and (m := _iban(text, at)):
        return "account", at, m
    if cue == "account" and (m := _ACCOUNT.match(text, at)):
        return "account", at, m.end()
    if cue == "ssn" and (m := _SSN.match(text, at)) and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
        return "ssn", at, m.end()
    if cue == "passport" and (m := _PASSPORT.match(text, at)) and sum(c in _DIGITS for c in m[0]) >= 5:
        return "passport", at, m.end()
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, by kind and start, in code points.

    Of a kind of BASE, a match that fails validation still takes its place.  A
    span of an added kind that lies in one of BASE is left out.
    """
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    base: list[tuple[str, int, int]] = []
    added: dict[tuple[str, int, int], None] = {}
    email = ip = card = phone = tel = 0  # where the last match of each kind ended
    for last, (kind, size) in _ANCHORS[0].iter(text):
        at = last - size + 1
        if kind == "card":
            if at >= card:
                _, card, good = _card(text, at)
                if good:
                    base.append(("card", at, card))
        elif kind == "ip":
            if at >= ip and (m := _ip(text, at, ip)):
                start, ip, good = m
                if good:
                    base.append(("ip", start, ip))
        elif kind == "email":
            if m := _email(text, at, email):
                base.append(("email", *m))
                email = m[1]
        elif kind == "phone":
            if at >= phone and (m := _phone(text, at)):
                _, phone, good = m
                if good:
                    base.append(("phone", at, phone))
        elif kind == "scheme":
            added.update(dict.fromkeys(_scheme(text, at)))
        elif kind == "tel":
            if last + 1 >= tel and not text[at - 1 : at].isalnum() and (m := _tel(text, last + 1)):
                added[m] = None
                tel = m[2]
        elif m := _cued(text, kind, at, last + 1):
            added[m] = None
    base.sort(key=lambda s: (ORDER[s[0]], s[1]))
    return base + sorted(_outside(list(added), base), key=lambda s: (ORDER[s[0]], s[1], s[2]))


def _outside(added: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those that no span of base holds."""
    if not added or not base:
        return added
    starts, ends = zip(*sorted((s, e) for _, s, e in base), strict=True)
    reach = list(accumulate(ends, max))
    return [a for a in added if (n := bisect_right(starts, a[1])) == 0 or reach[n - 1] < a[2]]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for every row of docs; nulls count as empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind string, start long, end long>>")


def masked(text: str) -> str:
    """The text with <KIND> in place of each span; of overlapping ones the first, and the longer of two that start together."""
    out, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:  # what reaches beyond the one before it goes with it
            at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in one column; nulls stay null, other columns as they came."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    return docs.withColumn(text_col, mask(F.col(f"`{text_col}`").cast("string")))


def op12_personal(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    from .common import table

    found = spans(table(spark, sf_dir, "documents"))

    def told(column: Column) -> Column:
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("id").alias("doc_id"), *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
