"""Op 5. Offset-preserving PII detection.

find_base() finds plain identifiers. find_spans() adds disguised ones: transducers rewrite the text and remember, for each
character they emit, the source characters it stands for; identifiers found in the rewritten text are mapped back through that
record, so a span always addresses the source. Three transducers run one after another, only on texts that hold their
triggers: FOLD (homoglyphs, full-width forms, invisible characters), SPELL (runs of spelled digits and `plus`), SIGNS (at and
dot disguises). A disguised span that overlaps a plain one of its kind is dropped; plain ones always stay.

Prose has `at` and `dot` too, so an address whose signs are all bare words counts only if they are of one language, its host does not
begin with a determiner ("at the dot of"), and it ends in a word of two letters or more; any other sign that is bracketed or real
is enough for the rest to be bare.

Null and empty texts have no spans. All work is linear in the text's length; a text that holds a trigger takes sixteen bytes a
character more. Ties don't arise (leftmost first, by kind). Repeated rows give equal results, empty tables empty ones; other columns
are carried along except that one named like a result (in whatever case) gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import carried
from .words import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever a digit stands, so a long run is read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1
            done = max(done, at)  # what stands before this sign can't begin a later match


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}
_HAS_DIGIT = re.compile(r"[0-9]")


def find_base(text: str) -> list[Span]:
    """Plain identifiers, by kind as listed, then start."""
    out: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(kind, *s) for s in _FINDERS[kind](text)]
    return out


class Tape:
    """Rewritten text with the source start and end of each of its characters."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> Tape:
        """edits: (from, to, new) over this tape, in order, apart. Each new character stands for the whole edited stretch."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += (self.start[at:a], np.full(len(new), self.start[a]))
            end += (self.end[at:a], np.full(len(new), self.end[b - 1]))
            at = b
        if not at:
            return self
        return Tape("".join(text) + self.text[at:], np.concatenate([*start, self.start[at:]]), np.concatenate([*end, self.end[at:]]))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


# Letters of other scripts that look like these Latin ones, in order.
_LOOKALIKES = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оο", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", ".": "。｡․·", "-": "‐‑‒–—−",
}
_FOLD = {c: k for k, cs in _LOOKALIKES.items() for c in cs}
_FOLD |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_FOLD |= {chr(c): " " for c in (0x00A0, 0x2007, 0x2009, 0x202F, 0x3000)}
_FOLD |= {chr(c): "" for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_FOLDED = re.compile("[" + "".join(map(re.escape, sorted(_FOLD))) + "]")


def _fold(tape: Tape) -> Iterator[tuple[int, int, str]]:
    for m in _FOLDED.finditer(tape.text):
        yield m.start(), m.end(), _FOLD[m.group()]


# The digits as words, English, German, French and Spanish.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DOT_WORDS = ("dot", "point", "punkt", "punto")
_AT_WORDS = ("at", "arroba", "chez")
#: Words that say how often the digit after them stands.
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DIGIT = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + "|[0-9])"
_SAID = rf"(?:(?:{'|'.join(_TIMES)})[\x20-])?{_DIGIT}"
_GAP = r"[\x20,.()\[\]-]{1,3}"
#: A run of at least four spelled digits, digits or dots in words, perhaps after a plus sign, with one spelled at least.
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[\x20-]?)?[(\[]?{_SAID}(?:{_GAP}(?:{_SAID}|{'|'.join(_DOT_WORDS)})(?![^\W_]))" + r"{3,}", re.I)
_PART = re.compile(r"[^\x20,.()\[\]-]+")


def _spell(tape: Tape) -> Iterator[tuple[int, int, str]]:
    for m in _SPELLED.finditer(tape.text):
        parts = [(p.start(), p.end(), p.group().lower()) for p in _PART.finditer(tape.text, m.start(), m.end())]
        if not any(p in _DIGITS for *_, p in parts):
            continue
        times = 1
        for k, (a, b, p) in enumerate(parts):
            if k and parts[k - 1][1] < a:
                gap = tape.text[parts[k - 1][1] : a]
                yield parts[k - 1][1], a, "." if gap.strip() == "." else ""
            if p in _TIMES:
                times = _TIMES[p]
                yield a, b, ""
            elif p.startswith("+") and p[1:] in _DIGITS:
                yield a + 1, b, _DIGITS[p[1:]]
            elif times > 1 or p in _DIGITS or p in _DOT_WORDS or p == "plus":
                yield a, b, (_DIGITS.get(p, "+" if p == "plus" else p if p.isdigit() else ".")) * times
                times = 1


_NAME = r"[A-Za-z0-9._%+-]+"
_AT = rf"(?:\s{{0,2}}{_OPEN}\s{{0,2}}(?:{'|'.join(_AT_WORDS)}|@)\s{{0,2}}{_SHUT}\s{{0,2}}|\s{{1,2}}(?:{'|'.join(_AT_WORDS)})\s{{1,2}}|\s{{1,2}}@\s{{1,2}}|\s{{1,2}}@|@\s{{1,2}}|@)"
_DOT = rf"(?:\s{{0,2}}{_OPEN}\s{{0,2}}(?:{'|'.join(_DOT_WORDS)}|\.)\s{{0,2}}{_SHUT}\s{{0,2}}|\s{{1,2}}(?:{'|'.join(_DOT_WORDS)})\s{{1,2}}|\s{{1,2}}\.\s{{1,2}}(?=[a-z]{{2,6}}\b)|\.)"
_SIGN_AT, _SIGN_DOT, _LABEL = re.compile(_AT, re.I), re.compile(_DOT, re.I), re.compile(r"[A-Za-z0-9-]+")
_AT_CUE = re.compile(rf"{_OPEN}\s{{0,2}}(?:{'|'.join(_AT_WORDS)}|@)\s{{0,2}}{_SHUT}|\s(?:{'|'.join(_AT_WORDS)})\s|@", re.I)
#: A disguised dot of a local part, before the place where the search ends.
_LOCAL_DOT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:\s{{0,2}}{_OPEN}\s{{0,2}}(?:{'|'.join(_DOT_WORDS)}|\.)\s{{0,2}}{_SHUT}\s{{0,2}}|\s{{1,2}}(?:{'|'.join(_DOT_WORDS)})\s{{1,2}})\Z", re.I)
_OCTETS = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I)
_HOST_END = re.compile(r"[A-Za-z]{2,24}\Z")
#: The words for at and dot that go together, and determiners, which never begin a host said in words.
_TOGETHER = {"at": ("dot", "punkt"), "arroba": ("punto", "dot"), "chez": ("point", "dot")}
_DETERMINERS = {"the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "each", "every", "any", "some", "no", "which", "what", "one", "le", "la", "les", "un", "une", "el", "los", "las", "der", "die", "das", "ein", "eine"}


def _signs(tape: Tape) -> Iterator[tuple[int, int, str]]:
    """At and dot disguises of addresses, and dot disguises between four numbers."""
    text, edits, done = tape.text, [], 0
    for cue in _AT_CUE.finditer(text):
        at = cue.start()
        while at > done and text[at - 1].isspace() and cue.start() - at < 2:
            at -= 1
        sign = _SIGN_AT.match(text, at)
        if not sign or at < done or not at or text[at - 1] not in _LOCAL:
            continue
        plain, end, dots = sign.group() == "@", sign.end(), []
        label = _LABEL.match(text, end)
        bracketed = any(c in sign.group() for c in "[({<")
        disguised = 0
        while label:
            end = label.end()
            dot = _SIGN_DOT.match(text, end)
            after = dot and _LABEL.match(text, dot.end())
            if not after:
                break
            dots.append(dot)
            disguised += dot.group() != "."
            label = after
        if not dots or not _HOST_END.search(text, dots[-1].end(), end) or (plain and not disguised):
            continue
        if not (bracketed or "@" in sign.group() or disguised):
            continue  # "look at example.com" is prose
        if not (bracketed or "@" in sign.group() or any(c in d.group() for d in dots for c in "[({<")):
            said = {d.group().strip().lower() for d in dots} - {"."}
            if not said <= set(_TOGETHER[sign.group().strip().lower()]) or _LABEL.match(text, sign.end()).group().lower() in _DETERMINERS:
                continue
        edits.append((sign.start(), sign.end(), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots]
        # the local part stands before; of bare words only those that the host has too are its dots
        words, left = {d.group().strip().lower() for d in dots}, at
        while True:
            while left > done and text[left - 1] in _LOCAL:
                left -= 1
            dot = _LOCAL_DOT.search(text, max(done, left - 20), left)
            if not dot or dot.group()[:1].isspace() and dot.group().strip().lower() not in words and not any(c in dot.group() for c in "[({<"):
                break
            edits.append((dot.start(), dot.end(), "."))
            left = dot.start()
        done = end
    edits += [(m.start() + d.start(), m.start() + d.end(), ".") for m in _OCTETS.finditer(text) for d in _SIGN_DOT.finditer(m.group()) if d.group() != "."]
    at = 0
    for a, b, new in sorted(set(edits)):
        if a >= at:
            yield a, b, new
            at = b


def find_both(text: str) -> tuple[list[Span], list[Span]]:
    """Plain identifiers, and plain and disguised ones; each by kind as listed, then start."""
    base = find_base(text)
    tape = Tape(text)
    if not text.isascii() and _FOLDED.search(text):
        tape = tape.rewrite(_fold(tape))
    if _SPELLED.search(tape.text):
        tape = tape.rewrite(_spell(tape))
    if _AT_CUE.search(tape.text) or _OCTETS.search(tape.text):
        tape = tape.rewrite(_signs(tape))
    if tape.text == text:
        return base, base
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, a, b in base:
        taken[kind].append((a, b))
    every = list(base)
    for kind, a, b in find_base(tape.text):
        a, b = tape.source(a, b)
        if not _overlaps(taken[kind], a, b):
            every.append((kind, a, b))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(text: str) -> list[Span]:
    """Plain and disguised identifiers, by kind as listed, then start."""
    return find_both(text)[1]


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """spans: in order and apart."""
    from bisect import bisect_left

    i = bisect_left(spans, (b, -1))
    return i > 0 and spans[i - 1][1] > a


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans are merged under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def detect(docs: DataFrame, text_col: str = "text", redacted: bool = False) -> DataFrame:
    """docs with pii_base and pii_spans (arrays of kind, start, end in code points, end exclusive) and, if asked, pii_text.
    Columns of those names give way."""
    own = ("pii_base", "pii_spans", "pii_text")
    rest = carried(docs, own)
    at = rest.index(text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(at), 8 << 20):
                part = batch.slice(i, j - i)
                base, spans, texts = [], [], []
                for text in part.column(at).to_pylist():
                    plain, every = find_both(text) if text else ([], [])
                    spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in every])
                    base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in plain])
                    if redacted:
                        texts.append(redact(text, every) if every else text)
                new = [pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN)), *([pa.array(texts, pa.string())] if redacted else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*rest, *own[: len(new)]])

    added = [T.StructField("pii_base", SPANS), T.StructField("pii_spans", SPANS), *([T.StructField("pii_text", T.StringType())] if redacted else [])]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def joined(column: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(column: str, kind: str):
    return F.size(F.filter(F.col(column), lambda s: s["kind"] == kind)).cast("long")
