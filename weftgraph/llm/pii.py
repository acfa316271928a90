"""Personal data in texts, also where it is written in disguise, with spans in the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import groups_of

#: Kinds, in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")

# ---- detection ----

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ to both sides, as a search from the left would match, but without trying each
    letter of a long word as a start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in IN_LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    """Four numbers at a time of each longest chain of numbers and dots."""
    for chain in DIGIT_CHAIN.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(m.group().count, "0123456789")) <= 15:
                yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


def detect(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of identifiers that stand in the text as they are."""
    return [(start, end, kind) for kind in kinds for start, end in FINDERS[kind](text)]


# ---- transducers ----


@dataclass
class Rewritten:
    """A text after a transducer, with what each rewritten piece was: (start, end) in the new text
    and in the old one, in order.  Between pieces both run side by side."""

    text: str
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The old text's span of a span of the new one, and whether any of it was rewritten.  A
        span that touches a piece takes all that the piece was made from."""
        i = bisect_right(self.pieces, (start, float("inf")))
        a = start
        if i:
            new_start, new_end, old_start, old_end = self.pieces[i - 1]
            a = old_start if start < new_end else old_end + start - new_end
        j = bisect_right(self.pieces, (end - 1, float("inf")))
        b = end
        if j:
            new_start, new_end, old_start, old_end = self.pieces[j - 1]
            b = old_end if end <= new_end else old_end + end - new_end
        inside = j > i or (i > 0 and start < self.pieces[i - 1][1])
        return a, b, inside


def rewrite(text: str, pattern: re.Pattern, make: Callable[[re.Match], str | None]) -> Rewritten | None:
    """``text`` with each match replaced by what ``make`` gives (None: it stays); None if all stay."""
    out, pieces, at, size = [], [], 0, 0
    for m in pattern.finditer(text):
        new = make(m)
        if new is None or new == m.group():
            continue
        out += [text[at : m.start()], new]
        size += m.start() - at
        pieces.append((size, size + len(new), m.start(), m.end()))
        size += len(new)
        at = m.end()
    return Rewritten("".join([*out, text[at:]]), pieces) if pieces else None


# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhlqwABEKMHOPCTYXIJS", strict=True))
LOOKALIKES |= dict(zip("αινορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivoptuxABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= dict(zip("‐‑‒–—―−․‧∙·。｡⁃", "-------......" + "-", strict=True))
#: Characters without width, which go.
INVISIBLE = "­͏᠎​‌‍⁠⁡⁢⁣⁤﻿"


def plain(c: str) -> str | None:
    """What a character beyond ASCII stands for: nothing, one ASCII character, or itself (None).

    Digits of any script, full-width, mathematical and other compatibility forms follow from
    Unicode's own tables; look-alikes of other scripts from the list above."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if unicodedata.category(c) == "Zs":
        return " "
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else None


class Homoglyphs:
    """The first transducer: one character at a time, each kind of character looked up once."""

    def __init__(self) -> None:
        self.known: dict[str, str | None] = {}

    def __call__(self, text: str) -> Rewritten | None:
        if text.isascii():
            return None
        known = self.known
        for c in set(text) - known.keys():
            known[c] = None if c.isascii() else plain(c)
        hit = [c for c in set(text) if known[c] is not None]
        if not hit:
            return None
        return rewrite(text, re.compile("[" + re.escape("".join(hit)) + "]"), lambda m: known[m.group()])


# The names of the digits from 0 on, in the languages of the texts.
DIGIT_NAMES = [
    ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
]
SPELLED = {name: str(d) for names in DIGIT_NAMES for d, name in enumerate(names)} | {"oh": "0"}
TIMES = {"double": 2, "triple": 3}
_NAME = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))})"
#: Names of digits in a row.
SPELLED_RUN = re.compile(rf"\b{_NAME}(?:[ ,-]{{1,2}}{_NAME})*\b", re.IGNORECASE)
#: Letters written for digits, in words that hold a digit.
MIXED_DIGITS = re.compile(r"\b(?=[OoIl]{0,19}[0-9])[0-9OoIl]{2,20}\b")
AS_DIGITS = str.maketrans("OoIl", "0011")


def _digits(m: re.Match) -> str:
    times, out = 1, []
    for word in re.split(r"[ ,-]+", m.group().lower()):
        if word in TIMES:
            times = TIMES[word]
        else:
            out.append(SPELLED[word] * times)
            times = 1
    return "".join(out)


def spelled_digits(text: str) -> Rewritten | None:
    return rewrite(text, SPELLED_RUN, _digits)


def mixed_digits(text: str) -> Rewritten | None:
    return rewrite(text, MIXED_DIGITS, lambda m: m.group().translate(AS_DIGITS))


# Words for @ , . and + in the languages of the texts.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt", "plus|más|mas"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_MARKED, _DOT_MARKED = rf"\s{{0,3}}{_OPEN}\s?(?:{AT_WORDS}|@)\s?{_CLOSE}\s{{0,3}}", rf"\s{{0,3}}{_OPEN}\s?(?:{DOT_WORDS}|\.)\s?{_CLOSE}\s{{0,3}}"
_AT_BARE, _DOT_BARE = rf"(?:\s{{1,3}}(?:{AT_WORDS})\s{{1,3}}|_(?:{AT_WORDS})_)", rf"(?:\s{{1,3}}(?:{DOT_WORDS})\s{{1,3}}|_(?:{DOT_WORDS})_)"
_DOT = rf"(?:{_DOT_MARKED}|{_DOT_BARE})"
DOTS = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.IGNORECASE)
#: A bare word for @ counts only before a domain whose dots are in disguise as well.
ATS = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{_AT_MARKED}(?=[A-Za-z0-9-])|{_AT_BARE}(?=[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9]))", re.IGNORECASE)
PLUSES = re.compile(rf"(?:{_OPEN}\s?(?:{PLUS_WORDS}|\+)\s?{_CLOSE}|\b(?:{PLUS_WORDS})\b)\s{{0,3}}(?=[0-9(])", re.IGNORECASE)


def ats(text: str) -> Rewritten | None:
    return rewrite(text, ATS, lambda m: "@")


def dots(text: str) -> Rewritten | None:
    return rewrite(text, DOTS, lambda m: ".")


def pluses(text: str) -> Rewritten | None:
    return rewrite(text, PLUSES, lambda m: "+")


#: What reads a kind, after the homoglyphs: names of digits are words in an address of mail.
CHAINS = ((("email",), (ats, dots)), (("ip", "card", "phone"), (spelled_digits, mixed_digits, dots, pluses)))


def disguised(text: str, homoglyphs: Homoglyphs) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, as read) of identifiers that show only after the transducers; the ends
    are those of the source."""
    found = []
    plain_text = homoglyphs(text)
    for kinds, steps in CHAINS:
        stages, now = ([plain_text], plain_text.text) if plain_text else ([], text)
        for step in steps:
            done = step(now)
            if done is not None:
                stages.append(done)
                now = done.text
        for start, end, kind in detect(now, kinds) if stages else ():
            a, b, any_rewritten = start, end, False
            for stage in reversed(stages):
                a, b, here = stage.source(a, b)
                any_rewritten |= here
            if any_rewritten:
                found.append((a, b, kind, now[start:end]))
    return found


def identifiers(text: str, homoglyphs: Homoglyphs) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, kind, base, as read): those that stand as they are, then those in disguise.

    A number in disguise that meets one of its kind found as it is would only add words beside it
    and isn't listed; nor is an address that such a one contains."""
    base = [(start, end, kind, True, text[start:end]) for start, end, kind in detect(text)]
    taken: dict[str, list[Span]] = {k: sorted((a, b) for a, b, kind, _, _ in base if kind == k) for k in KINDS}
    more = []
    for a, b, kind, read in disguised(text, homoglyphs):
        i = bisect_right(taken[kind], (b - 1, float("inf")))
        met = i > 0 and taken[kind][i - 1][1] > a
        if not met or (kind == "email" and not (taken[kind][i - 1][0] <= a and b <= taken[kind][i - 1][1])):
            more.append((a, b, kind, False, read))
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- over a table ----

FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("text", pa.string()), ("value", pa.string())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """(id, ``found_col``): the personal data of each text, as an array of (kind, start, end, base,
    text, value) by start, then kind (email, ip, card, phone).

    ``base`` marks identifiers that stand in the text as they are: per kind the leftmost matches
    that don't overlap, of which those with a number over 255, a wrong count of digits or a wrong
    check digit go.  Others are found after transducers have read the text: homoglyphs and
    characters without width, spelled digits (four languages, "double five"), letters written for
    digits, and words and brackets for @, . and +.  Each keeps what its rewritten pieces were, so
    spans are in code points of the source, ends exclusive; ``text`` is the source of the span and
    ``value`` what it reads.

    A null text is an empty one and has an empty array.  Rows are handled one by one: repeated rows
    and ids give repeated results, and other columns are not returned.  Time is linear in the text;
    memory is some ten times the text, and only where something is rewritten.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homoglyphs = Homoglyphs()
        for batch in batches:
            texts = batch.column(1)
            for i, j in groups_of(_lengths(texts)):
                rows = []
                for text in texts.slice(i, j - i).to_pylist():
                    text = text or ""
                    rows.append([{"kind": k, "start": a, "end": b, "base": base, "text": text[a:b], "value": read} for a, b, k, base, read in identifiers(text, homoglyphs)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, FOUND)], names=["i", "found"])

    struct = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, text: string, value: string>>"
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, found {struct}")
    return found.select(F.col("i").alias(id_col), F.col("found").alias(found_col))


class _Sized:
    """Stands for a text of so many bytes, to cut a batch into groups before any is read."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def _lengths(texts: pa.Array) -> list[_Sized]:
    return [_Sized(n or 0) for n in pc.binary_length(texts).to_pylist()]


def listed(found: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of each entry, joined by commas."""
    some = F.filter(found, lambda x: x["base"]) if base_only else found
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    """How many entries of a kind stand in the text as they are."""
    return F.size(F.filter(found, lambda x: x["base"] & (x["kind"] == kind))).cast("bigint")
