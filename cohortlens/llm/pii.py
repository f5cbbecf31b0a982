"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digit pairs (adjacent, or
joined by a point, space or hyphen), plus-signs before digits, URL schemes and
identifier cues.  At each anchor a deterministic local parser expands to the left and
right and validates what it has (label structure, octets, Luhn, IBAN mod 97, ...).

Base kinds are leftmost and do not overlap within their kind: ``email``, ``ip``,
``card``, ``phone``.  Added kinds: ``account``, ``iban``, ``ssn``, ``url`` and ``secret`` (what is
assigned to a token, key or password).

Edge cases: a null or empty text has no spans; texts of any length are read whole;
repeated rows give equal rows; columns of the input are never looked at besides the
id and the text, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import with_id

# Order of kinds in the output.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "ssn", "url", "secret")
# Cues, matched in lower, upper and title case.
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")

SPANS_SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

_DIGITS = "0123456789"
_DIGIT_SET = frozenset(_DIGITS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"[ ().0-9-]+")
_URL = re.compile(r"[^\s<>\"'`]+")
_AFTER_CUE = re.compile(r"[ \t]*(?:(?:number|no\.?|nr\.?|#)[ \t]*)?[:=#]?[ \t]*", re.I)
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: What is assigned to a secret's name: a word of some length with a digit in it.
_SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_+/=.-]{8,})")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")


def build_automaton():
    """The anchor automaton; a value is the tag and length of its anchor."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for a in _DIGITS:
        found.add_word(f"+{a}", ("plus", 2))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("dot", 3))
            for joint in ("", " ", "-"):
                found.add_word(f"{a}{joint}{b}", ("pair", 2 + len(joint)))
    for tag, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("iban", IBAN_CUES), ("ssn", SSN_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                found.add_word(form, (tag, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find_spans(text: str | None, automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of the kind ended
    for end, (tag, length) in automaton.iter(text):
        start = end + 1 - length
        if tag == "pair":
            if start < done["card"]:
                continue
            stop = _CHAIN.match(text, start).end()
            done["card"] = stop
            digits = text[start:stop].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append((start, stop))
        elif tag == "at":
            lo, i = done["email"], end
            while i > lo and text[i - 1] in _LOCAL:
                i -= 1
            if i < end and (m := _DOMAIN.match(text, end + 1)):
                out["email"].append((i, m.end()))
                done["email"] = m.end()
        elif tag == "dot":
            lo, i = done["ip"], start
            if i < lo:
                continue
            while i > lo and text[i - 1] in _DIGITS:
                i -= 1
            if m := _QUAD.match(text, i):
                done["ip"] = m.end()
                if all(map(_octet, m[0].split("."))):
                    out["ip"].append((i, m.end()))
        elif tag == "plus":
            if start < done["phone"] or not (m := _DIAL.match(text, end + 1)):
                continue
            stop = m.end()
            while stop > end + 2 and text[stop - 1] not in _DIGITS:
                stop -= 1
            if stop <= end + 2:
                continue
            done["phone"] = stop
            if 9 <= sum(c in _DIGITS for c in text[start:stop]) <= 15:
                out["phone"].append((start, stop))
        elif tag == "secret":
            m = _SECRET.match(text, end + 1)
            if m and m.start(1) >= done["secret"] and not _DIGIT_SET.isdisjoint(m[1]):
                done["secret"] = m.end()
                out["secret"].append((m.start(1), m.start(1) + len(m[1].rstrip("."))))
        elif tag == "scheme":
            if start < done["url"] or not (m := _URL.match(text, end + 1)):
                continue
            stop = end + 1 + len(m[0].rstrip(".,;:!?)]}"))
            done["url"] = m.end()
            if stop > end + 1 and text[end + 1].isalnum():
                out["url"].append((start, stop))
        else:
            value, check = {"account": (_ACCOUNT, None), "iban": (_IBAN, _iban_ok), "ssn": (_SSN, None)}[tag]
            at = _AFTER_CUE.match(text, end + 1).end()
            m = value.match(text, at)
            if tag == "iban" and m:  # the shortest tail that is valid: what follows may be a word in capitals
                stop = next((m.end() - cut for cut in range(m.end() - at - 14) if text[m.end() - cut - 1] != " " and check(text[at : m.end() - cut])), None)
            else:
                stop = m and m.end()
            if stop and at >= done[tag]:
                out[tag].append((at, stop))
                done[tag] = stop
    return [(k, s, e) for k in KINDS for s, e in sorted(out[k])]


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span as ``<KIND>``; overlapping spans become one, of the first kind."""
    if not text or not spans:
        return text
    parts, at, merged = [], 0, []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans array<struct<kind,start,end>>`` for each row of ``df``; no shuffle."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    return source.mapInArrow(run, with_id(source, "spans array<struct<kind:string,start:long,end:long>>")).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, SHA-256 of the base spans and all spans as text, from :func:`detect`."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col(id_col), *[count(k) for k in BASE_KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), count("secret"), F.size("spans").cast("long").alias("n_spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data in ``text_col`` replaced by ``<KIND>`` markers; other columns as they are."""
    at, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton()
        for b in batches:
            texts = pa.array([redact_text(t, find_spans(t, automaton)) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, schema)


def spans_sha256(spans: list[tuple[str, int, int]]) -> str:
    """What :func:`digest` has as ``base_sha256``, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE_KINDS).encode()).hexdigest()
