"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, schemes, plus signs,
digits and identifier cues. From each anchor a local parser expands to the left
and right and validates what it finds: email addresses, IP addresses (parts of at
most 255), card numbers (13 to 19 digits, Luhn), phone numbers (9 to 15 digits).
These base kinds give exactly the leftmost non-overlapping matches of ``PATTERNS``
whose check holds; a match that fails its check is passed over whole.

Added spans, where they overlap no base span: ``account`` (the value behind a cue
such as ``account no:`` or ``token =``, of six characters or more and with at least
four digits, IBANs by their check digits; user name and password in a URL). Cues count
in any case of letters; values have no upper length, and no parser looks at a place twice. Offsets are code points, the end exclusive.

Defined results: null text counts as empty; texts of any length are searched whole,
in time linear in their length; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches

KINDS = ["email", "ip", "card", "phone", "account"]
BASE_KINDS = KINDS[:4]
# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CUES = ["account", "acct", "iban", "passport", "ssn", "token", "secret", "password", "api_key", "apikey"]
IBAN_MOST = 34  # fixed value: the longest IBAN of the standard
SPANS = "array<struct<kind:string,start:long,end:long>>"

_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # keeps every offset, where lower() makes two letters of one
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP, _CARD, _PHONE = (re.compile(PATTERNS[k]) for k in ("ip", "card", "phone"))
_VALUE = re.compile(r"(?: ?(?:number|no\.?|id|key|code))? ?[:=#] ?[\"']?([A-Za-z0-9_-]{6,})", re.IGNORECASE)
_LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@")


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign in "@+":
        found.add_word(sign, (sign, 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(match: str) -> bool:
    return 9 <= sum(c.isdigit() for c in match) <= 15


def _is_iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return len(moved) <= IBAN_MOST and moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as listed, then start."""
    text = text or ""
    ats, pluses, runs, schemes, cues = [], [], [], [], []
    run_end = -1
    small = text.lower()
    for end, (what, size) in anchors().iter(small if len(small) == len(text) else text.translate(_SMALL)):
        if what == "digit":
            if end != run_end:
                runs.append(end)
            run_end = end + 1
        elif what == "@":
            ats.append(end)
        elif what == "+":
            pluses.append(end)
        elif what == "scheme":
            schemes.append(end + 1)
        else:
            cues.append((end + 1 - size, end + 1))
    spans = []

    done = 0
    for at in ats:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            spans.append(("email", start, done))
    for kind, pattern, holds, starts in (("ip", _IP, _is_ip, runs), ("card", _CARD, _is_card, runs), ("phone", _PHONE, _is_phone, pluses)):
        done = 0
        for start in starts:
            if start >= done and (match := pattern.match(text, start)):
                done = match.end()
                if holds(match[0]):
                    spans.append((kind, start, done))

    added = []
    for start, end in cues:
        if start and text[start - 1].isalnum():
            continue
        if value := _VALUE.match(text, end):
            word = value[1]
            if sum("0" <= c <= "9" for c in word) >= 4 and (text[start:end].lower() != "iban" or word.isascii() and _is_iban(word.replace("-", "").replace("_", ""))):
                added.append(value.span(1))
    added += [login.span(1) for end in schemes if (login := _LOGIN.match(text, end))]
    taken, at, reach = sorted((s, e) for _, s, e in spans), 0, 0
    for start, end in sorted(set(added)):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            spans.append(("account", start, end))
            reach = end
    return spans


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every row's spans, by kind as listed in ``KINDS``, then start."""
    small_batches(docs.sparkSession)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, pa.list_(struct))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, spans {SPANS}")


def redacted(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first, longest one."""
    if not text:
        return text
    out, at = [], 0
    for start, _, kind, end in sorted((s, -e, k, e) for k, s, e in find(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` redacted; where it has a column ``n_chars``, that follows."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
