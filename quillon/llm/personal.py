"""Personal data in texts: anchors found by an Aho-Corasick automaton, expanded by local parsers.

One pass of the automaton over a text yields the places where something may be: at-signs, schemes, a plus
with a digit, digits with a dot, a blank or a hyphen between them, and words that announce an identifier. Each
anchor is expanded to both sides by a parser that reads only the characters it accepts, so a span of any
length is read once or twice; an anchor inside what a parser of its kind has read already is passed over.

Base kinds equal leftmost, non-overlapping matches of these patterns, of which those that fail their check
are dropped without a second try:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* ``card``   ``[0-9]([\\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn's check
* ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 8 to 15 digits

Further kinds, which add spans and never change base ones:

* ``mailbox``  an address whose local part or domain holds letters beyond ASCII, or whose local part is quoted
* ``address``  ``scheme://`` with a host (name with a dot, IPv4 or bracketed IPv6), port up to 65535, path and query
* ``iban``     two letters, two digits and 11 to 30 letters or digits in blocks of four or together, remainder 97 is 1
* ``account``  an identifier of 5 to 34 letters and digits, 4 digits at least, behind a cue (``CUES``) and up to
  12 blanks and signs

Places are code points, ends exclusive. Null and empty texts have no spans. Texts of any length are handled
whole; what a task holds is one text and its spans. Rows are independent: no shuffle, repeated rows
and null ids give rows of their own. Columns that the operator adds replace those of the same name.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import shared

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "address", "iban", "account")
#: Words that announce an identifier, lower-case; a letter or digit around them makes them another word.
CUES = (
    "account", "acct", "a/c", "passport", "ssn", "social security", "tax id", "customer id", "member id", "driver license",
    "konto", "kontonummer", "steuernummer", "ausweis", "compte", "cuenta", "pasaporte", "conto",
)
_DIGITS = frozenset("0123456789")
_ASCII = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _ASCII | frozenset("._%+-")
_LABEL = _ASCII | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_PATH = _ASCII | frozenset("-._~:/?#[]@!$&'()*+,;=%")
_AUTHORITY = _ASCII | frozenset("-._~:@[]!$&'*+,;=%")
_BETWEEN = frozenset(" \t:#.=-")
_NUMBER = re.compile(r"[ \t]*(?:no|nr|number|nummer|id|num)\b", re.I | re.A)
SPAN = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    back = [int(c) for c in reversed(digits)]
    return (sum(back[0::2]) + sum(x * 2 - 9 * (x > 4) for x in back[1::2])) % 10 == 0


def anchors() -> ahocorasick.Automaton:
    """The automaton of all anchors; a value is (what it announces, length)."""
    a = ahocorasick.Automaton()
    for x in "0123456789":
        a.add_word("+" + x, ("phone", 2))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(x + gap + y, ("card", len(gap) + 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("address", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(form, ("account", len(form)))
    for form in ("IBAN", "iban", "Iban"):
        a.add_word(form, ("iban", 4))
    a.make_automaton()
    return a


def _right(text: str, at: int, accepted) -> int:
    n = len(text)
    while at < n and text[at] in accepted:
        at += 1
    return at


def _left(text: str, at: int, least: int, accepted) -> int:
    while at > least and text[at - 1] in accepted:
        at -= 1
    return at


def _domain(text: str, at: int, label=_LABEL.__contains__) -> int:
    """The end of labels joined by dots from ``at``; -1 if there aren't two."""
    end, labels, n = -1, 0, len(text)
    while True:
        stop = at
        while stop < n and label(text[stop]):
            stop += 1
        if stop == at:
            return end
        labels += 1
        if labels > 1:
            end = stop
        if stop >= n or text[stop] != ".":
            return end
        at = stop + 1


def _ip(text: str, at: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """Groups of four numbers, of the chain of numbers joined by dots around ``at``; the chain's end."""
    start = _left(text, at, floor, _DIGITS)
    while start - 2 >= floor and text[start - 1] == "." and text[start - 2] in _DIGITS:
        start = _left(text, start - 1, floor, _DIGITS)
    cuts, end = [], start
    while True:
        stop = _right(text, end, _DIGITS)
        cuts.append((end, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            end = stop + 1
        else:
            break
    out = []
    for k in range(0, len(cuts) - 3, 4):
        parts = [text[a:b].lstrip("0") for a, b in cuts[k : k + 4]]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((cuts[k][0], cuts[k + 3][1]))
    return out, cuts[-1][1]


def _card(text: str, at: int, floor: int) -> tuple[int, int]:
    """The run of digits with at most one blank or hyphen between two of them, around ``at``."""
    start = at
    while start > floor:
        if text[start - 1] in _DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 2 >= floor and text[start - 2] in _DIGITS:
            start -= 2
        else:
            break
    end = at + 1
    while end < len(text):
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return start, end


def _mailbox(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """An address around the at-sign ``at`` that ASCII alone doesn't spell, or None."""
    if at - 1 > floor and text[at - 1] == '"':
        start = at - 2
        while start >= floor and text[start] not in '"\n' and at - start <= 66:
            start -= 1
        if start < floor or text[start] != '"' or start == at - 2:
            return None
    else:
        start = at
        while start > floor and (text[start - 1] in _LOCAL or (text[start - 1] > "\x7f" and text[start - 1].isalnum())):
            start -= 1
        if start == at:
            return None
    end = _domain(text, at + 1, lambda c: c in _LABEL or (c > "\x7f" and c.isalnum()))
    if end < 0 or text[start] != '"' and text[start:end].isascii():
        return None
    return start, end


def _host(host: str) -> bool:
    """Whether an authority's host and port hold."""
    found = re.fullmatch(r"(\[[0-9A-Fa-f:.]{2,45}\]|[A-Za-z0-9.-]+)(?::([0-9]{1,5}))?", host)
    if not found or found[2] and int(found[2]) > 65535:
        return False
    name = found[1]
    if name[0] == "[":
        try:
            return ipaddress.ip_address(name[1:-1]).version == 6
        except ValueError:
            return False
    labels = name.split(".")
    if len(labels) < 2 or not all(0 < len(x) < 64 and x[0] != "-" and x[-1] != "-" for x in labels):
        return False
    return not all(x.isdigit() for x in labels) or len(labels) == 4 and all(int(x) <= 255 for x in labels)


def _address(text: str, at: int) -> tuple[int, int] | None:
    """scheme://[user@]host[:port][path] whose "://" is at ``at``, or None if the host doesn't hold.

    The authority ends at a slash, which every further anchor has, so no character is read for two of them.
    """
    start = _left(text, at, max(0, at - 32), _ASCII | frozenset("+.-"))
    while start < at and not (text[start].isascii() and text[start].isalpha()):
        start += 1
    if start == at:
        return None
    stop = _right(text, at + 3, _AUTHORITY)
    path = stop < len(text) and text[stop] in "/?#"
    if not path:
        while stop > at + 3 and text[stop - 1] in ".,;:!'":
            stop -= 1
    if not _host(text[at + 3 : stop].rsplit("@", 1)[-1]):
        return None
    if path:
        begin, stop = stop, _right(text, stop, _PATH)
        while stop > begin and (text[stop - 1] in ".,;:!?'" or text[stop - 1] == ")" and text.find("(", begin, stop) < 0):
            stop -= 1
    return start, stop


def _alone(text: str, start: int, at: int) -> bool:
    """Whether a cue is a word of its own."""
    return not (start and text[start - 1].isalnum() or at < len(text) and text[at].isalnum())


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The account number behind the cue that ends at ``at``, if its check digits hold."""
    start = at
    while start < len(text) and start - at < 12 and text[start] in _BETWEEN:
        start += 1
    own, end, places = [], start, []
    while end < len(text) and len(own) < 34:
        if text[end] in _ASCII:
            own.append(text[end].upper())
            end += 1
            places.append(end)
        elif text[end] == " " and own and len(own) % 4 == 0 and end + 1 < len(text) and text[end + 1] in _ASCII:
            end += 1
        else:
            break
    # blanks part words too, so shorter readings are tried, down to the least length
    for n in range(len(own), 14, -1):
        whole = "".join(own[:n])
        if places[n - 1] < len(text) and text[places[n - 1]].isalnum():
            continue
        if whole[:2].isalpha() and whole[2:4].isdigit() and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1:
            return start, places[n - 1]
    return None


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier behind the cue that ends at ``at``, or None."""
    begin = at
    word = _NUMBER.match(text, at)
    if word:
        begin = at = word.end()
    while begin < len(text) and begin - at < 12 and text[begin] in _BETWEEN:
        begin += 1
    end = begin
    while end < len(text) and end - begin <= 40:
        if text[end] in _ASCII:
            end += 1
        elif text[end] in "-/" and end + 1 < len(text) and text[end + 1] in _ASCII and end > begin:
            end += 1
        else:
            break
    own = [c for c in text[begin:end] if c in _ASCII]
    if begin == at or not 5 <= len(own) <= 34 or sum(c in _DIGITS for c in own) < 4 or end < len(text) and text[end].isalnum():
        return None
    return begin, end


_AUTOMATON = None


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind in the order of ``KINDS``, then by start."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = anchors()
    found = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # the end of what a parser of each kind has read
    for last, (what, size) in _AUTOMATON.iter(text):
        at = last - size + 1
        if what == "card":
            if at >= free["card"]:
                start, end = _card(text, at, free["card"])
                free["card"] = end
                digits = text[start:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((start, end))
        elif what == "ip":
            if at >= free["ip"]:
                more, free["ip"] = _ip(text, at, free["ip"])
                found["ip"] += more
        elif what == "phone":
            stop = _right(text, at + 2, _PHONE)
            end = stop
            while end > at + 3 and text[end - 1] not in _DIGITS:
                end -= 1
            if end > at + 3 and 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                found["phone"].append((at, end))
        elif what == "at":
            start = _left(text, at, free["email"], _LOCAL)
            end = _domain(text, at + 1) if start < at else -1
            if end > 0:
                found["email"].append((start, end))
                free["email"] = end
            more = _mailbox(text, at, free["mailbox"])
            if more:
                found["mailbox"].append(more)
                free["mailbox"] = more[1]
        elif at >= free[what] and (what == "address" or _alone(text, at, last + 1)):
            more = _address(text, at) if what == "address" else _iban(text, last + 1) if what == "iban" else _account(text, last + 1)
            if more and more[0] >= free[what]:
                found[what].append(more)
                free[what] = more[1]
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def joined(each: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in each)


ADDED = ("spans", *(f"n_{k}" for k in BASE), "base_sha256")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with spans (array of kind, start, end), the numbers of base spans and the digest of these."""
    shared.ship(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add("spans", SPAN)
    for k in BASE:
        schema = schema.add(f"n_{k}", LongType())
    schema = schema.add("base_sha256", StringType())

    def work(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in (part for whole in batches for part in shared.parts(whole)):
            out, counts, digests = [], [], []
            for text in batch.column(at).to_pylist():
                own = spans(text or "")
                out.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                base = [x for x in own if x[0] in BASE]
                counts.append([sum(x[0] == k for x in base) for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind), *numbers, pa.array(digests)], names=[*batch.schema.names, *ADDED])

    return docs.mapInArrow(shared.tidy(work), schema)


def masked(text: str, own: list[tuple[str, int, int]]) -> str:
    """A text with every span replaced by its kind in brackets; of spans that overlap the longest, then the first, names the cover."""
    out, at = [], 0
    cover: list[list] = []
    for kind, start, end in sorted(own, key=lambda x: (x[1], -x[2])):
        if cover and start < cover[-1][2]:
            cover[-1][2] = max(cover[-1][2], end)
        else:
            cover.append([kind, start, end])
    for kind, start, end in cover:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by [kind]; null stays null."""
    shared.ship(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches):
        for batch in (part for whole in batches for part in shared.parts(whole)):
            new = [None if t is None else masked(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).with_nullable(True), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(shared.tidy(work), docs.schema)


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string").alias("text"))
    each = F.transform("spans", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string")))
    return find(docs).select("doc_id", *ADDED[1:], F.array_join(each, ",").alias("spans"))
