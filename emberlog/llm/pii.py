"""PII by anchor expansion.

One Aho-Corasick pass over each text finds anchors: at-signs, scheme marks, plus
signs, digits and identifier cues in any case of A-Z. A deterministic local parser grows each anchor
to a span and validates it; no parser reads far beyond its own span, so the work
is linear in the text. Parsers of one kind never overlap: a kind's cursor stands
behind its last match, and a match that fails validation still moves the cursor.

Kinds, in the order of the results: email, ip, card, phone, then what the
expansion adds: url (scheme://...), iban (valid check digits), account (digits
behind a cue word) and ssn (3-2-4 digits behind a cue word).

A null text counts as empty and has no spans. Offsets are code points, the end
exclusive. Very long texts are read whole. There is no shuffle; repeated rows
repeat their result, other columns pass through, except that ``spans`` is replaced.
Spans of unlike kinds may overlap and all are listed; of one kind the leftmost stays. An
empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from emberlog.llm.common import small_batches, text_groups, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
#: Bytes of text that are decoded together.
GROUP_BYTES = 4 << 20
KINDS = (*BASE_KINDS, "url", "iban", "account", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"'`{}|\\^\[\]]+")
_CUE_GAP = r"(?:[\x20]?(?i:no|nr|num|number|code|id)\b\.?)?[\x20]*[:=#]?[\x20]*"
_IBAN = re.compile(_CUE_GAP + r"([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(_CUE_GAP + r"([0-9](?:[\x20-]?[0-9]){5,17})(?![0-9A-Za-z])", re.I)
_SSN = re.compile(_CUE_GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")

#: Words that announce an identifier, and the parser that follows each.
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "ssn": "ssn", "social security": "ssn"}

_FOLD = {i: i + 32 for i in range(65, 91)}
_AUTOMATON = None


def automaton():
    """One automaton for each worker process; values name the parser."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        made.add_word("@", "email")
        made.add_word("+", "phone")
        made.add_word("://", "url")
        for digit in "0123456789":
            made.add_word(digit, "digit")
        for cue, kind in CUES.items():
            made.add_word(cue, kind)
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def folded(text: str) -> str:
    """A-Z as a-z; offsets stay."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_checks(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    cursor = dict.fromkeys(KINDS, 0)
    for last, kind in automaton().iter(folded(text)):
        if kind == "digit":
            at = last
            if at >= cursor["ip"] and (at == 0 or text[at - 1] not in "0123456789" or at == cursor["ip"]):
                if m := _IP.match(text, at):
                    cursor["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                        found["ip"].append(m.span())
            if at >= cursor["card"] and (m := _CARD.match(text, at)):
                cursor["card"] = m.end()
                digits = _digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "phone":
            if last >= cursor["phone"] and (m := _PHONE.match(text, last)):
                cursor["phone"] = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    found["phone"].append(m.span())
        elif kind == "email":
            start = last
            while start > cursor["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last)):
                cursor["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "url":
            mark = last - 2
            start = mark
            while start > cursor["url"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < mark and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < mark and (m := _URL.match(text, mark)):
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                cursor["url"] = m.end()
                if end > mark + 3:
                    found["url"].append((start, end))
        else:
            m = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[kind].match(text, last + 1)
            if m and m.start(1) >= cursor[kind]:
                start, end = m.span(1)
                if kind == "iban":
                    # the longest run that reads as an identifier; words behind it are given back
                    value = m[1]
                    while value and not iban_checks(value.replace(" ", "")):
                        value = value.rpartition(" ")[0]
                    if len(value.replace(" ", "")) < 15:
                        continue
                    end = start + len(value)
                cursor[kind] = end
                found[kind].append((start, end))
    return [(kind, a, z) for kind in KINDS for a, z in found[kind]]


def with_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``, an array of (kind, start, end) by kind as listed, then start."""

    small_batches(df.sparkSession)

    @arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def found(text: pa.Array) -> pa.Array:
        per_text, kinds, starts, ends = [0], [], [], []
        for t in (t for group in text_groups(text, GROUP_BYTES) for t in group):
            for kind, a, z in spans(t):
                kinds.append(kind)
                starts.append(a)
                ends.append(z)
            per_text.append(len(kinds))
        rows = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), rows)

    return df.withColumn("spans", found(text_or_empty(text_col)))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for kind, a, z in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = z
    return "".join([*out, text[at:]])
