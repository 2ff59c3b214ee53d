"""Personal data with exact source offsets, disguised forms included.

Base detectors find e-mail addresses, IP addresses, card and phone numbers in the text as it is. Then a chain of transducers
rewrites the text and keeps, for every character written, the source characters it stands for: look-alike letters and digits
become ASCII and invisible characters vanish; spelled digits become digits; spelled or bracketed "at", "dot", "plus" and "dash"
become signs. The same detectors run on the rewritten text and their spans are mapped back to the source. A mapped span is
added if something inside was rewritten and no base span of its kind covers it (for numbers: touches it); base spans stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, picked, text_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Look-alikes of ASCII letters in Cyrillic and Greek, each with the letter it resembles.
_ALIKE = dict(zip("АВСЕНІЈКМОРЅТХУасеһіјорѕухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχ", "ABCEHIJKMOPSTXYacehijopsyxdqwABEZHIKMNOPTYXavoptux"))
# Names of the digits in English, German, French and Spanish.
_DIGITS = {"zero": 0, "null": 0, "zéro": 0, "cero": 0, "one": 1, "eins": 1, "un": 1, "uno": 1, "two": 2, "zwei": 2, "zwo": 2, "deux": 2,
           "dos": 2, "three": 3, "drei": 3, "trois": 3, "tres": 3, "four": 4, "vier": 4, "quatre": 4, "cuatro": 4, "five": 5, "fünf": 5,
           "cinq": 5, "cinco": 5, "six": 6, "sechs": 6, "seis": 6, "seven": 7, "sieben": 7, "sept": 7, "siete": 7, "eight": 8, "acht": 8,
           "huit": 8, "ocho": 8, "nine": 9, "neun": 9, "neuf": 9, "nueve": 9}
_AT, _DOT = "at|arobase|arroba|klammeraffe|ät", "dot|point|punkt|punto|period"
_TLD = "com|net|org|edu|gov|info|io|co|de|fr|es|uk|eu|us"  # endings in any case, after a local part of digits too
# Words after which a bare "at" is mostly a preposition, and words that tell of an address.
_PLACED = frozenset("""look looks looked looking see seen find finds found available online hosted host based located listed sold live working work works worked
    employed engineer developer manager visit visiting visited read reading more us me him her them it you we here there site website page pages
    shop store store's is are was were be been being and or but the a an this that these those information info details docs documentation
    posted published appeared starts started start ends arrive arrived arriving stay stayed stop stops stopped meet meeting met up only not out
    back aimed pointed points down over free registered register buy bought order ordered download downloads all also even just now today""".split())
_ADDRESS = re.compile(r"(?<!\w)(?:e-?mails?|mails?|mailto|contact|reach|write|address|addresses|send|message|reply|cc|bcc|adresse|courriel|schreib\w*|"
                      r"correo|écri\w*|escrib\w*|kontakt|contacto)(?!\w)", re.I)


def _folds() -> dict[int, str]:
    """Single characters whose compatibility form is one ASCII character, and the look-alikes above."""
    table = {}
    for low, high in ((0x00B2, 0x00BA), (0x2010, 0x2100), (0x2460, 0x2500), (0x3002, 0x3003), (0xFE50, 0xFE70), (0xFF01, 0xFF62), (0x1D400, 0x1D800)):
        for c in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and " " < plain < "\x7f":
                table[c] = plain
    dashes = {c: "-" for c in (*range(0x2010, 0x2016), 0x2212)}
    return table | dashes | {0x3002: ".", 0xFF0E: "."} | {ord(a): b for a, b in _ALIKE.items()}


_FOLD = _folds()
_HIDDEN = "­​‌‍⁠﻿"


def _class(points: list[int]) -> str:
    """A character class written as ranges, which is what the regular-expression engine searches fast."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges)


_SMALL_FOLDS = _class([c for c in (*_FOLD, *map(ord, _HIDDEN)) if c < 1 << 16])
_FOLDED = re.compile(f"[{_SMALL_FOLDS}]")
_MATH = re.compile("[\U0001d400-\U0001d7ff]")
_ANY_FOLDED = re.compile(f"[{_SMALL_FOLDS}]|[\U0001d400-\U0001d7ff]")
_NUMBER = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:double|triple)\s+)?(?:{_NUMBER})(?:[\s,-]+(?:(?:double|triple)\s+)?(?:{_NUMBER}))*(?!\w)", re.I)
_SIGN = re.compile(rf"\s*[(\[{{<]\s*(?:(?P<a1>{_AT}|@)|(?P<d1>{_DOT}|\.))\s*[)\]}}>]\s*"
                   rf"|(?<=[\w])\s+(?:(?P<a2>{_AT}|@)|(?P<d2>{_DOT}|\.))\s+(?=\w)"
                   rf"|(?<!\w)(?P<plus>plus)\s+(?=[0-9])|(?<=[0-9])\s+(?P<dash>dash|hyphen)\s+(?=[0-9])", re.I)
_BRACKETED = re.compile(rf"[(\[{{<]\s*(?:{_AT}|{_DOT}|[@.])\s*[)\]}}>]", re.I)
_SPACED = re.compile(rf"\s(?:{_DOT}|[@.])\s", re.I)
_BARE = re.compile(rf"\s(?:{_AT})\s+[a-z0-9-]+\.[a-z0-9]|[0-9]\s+(?:{_AT})\s", re.I)
_SPOKEN = re.compile(r"(?<!\w)plus\s+[0-9]|[0-9]\s+(?:dash|hyphen)\s+[0-9]")
_DOT_WORDS, _SIGN_WORDS = tuple(_DOT.split("|")), frozenset([*_DOT.split("|"), "plus", "double", "triple"])
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?P<end>[A-Za-z]{2,})(?![\w.-]*\w)")
_KNOWN_END = re.compile(_TLD, re.I)
_PUNCTUATION = str.maketrans(dict.fromkeys("-,.;:!?()[]{}<>\"'/+*|", " "))
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\s().-]*$"), re.compile(r"[\s().-]*[0-9]")

_SIGN_BEFORE = re.compile(rf"(?<!\w)(?:{_DOT}|plus)\s+$", re.I)
_SIGN_AFTER = re.compile(rf"\s+(?:{_DOT})(?!\w)", re.I)

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    spans = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


@dataclass
class Aligned:
    """A rewritten text; character i stands for source[start[i]:end[i]]."""

    text: str
    start: list[int]
    end: list[int]

    def rewritten(self, pattern: re.Pattern, write) -> Aligned:
        """Each match replaced by ``write(match)`` (None keeps it); all its characters stand for the whole match."""
        pieces, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = write(m)
            if new is None or m.start() < at:
                continue
            a, b = m.span()
            pieces += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            if b > a:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        if not at and not pieces:
            return self
        pieces.append(self.text[at:])
        return Aligned("".join(pieces), start + self.start[at:], end + self.end[at:])


def _digits(m: re.Match) -> str | None:
    times, out = 1, []
    words = re.split(r"[\s,-]+", m[0].lower())
    for w in words:
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out.append(str(_DIGITS[w]) * times)
            times = 1
    if len(words) == 1:
        before, after = m.string[max(0, m.start() - 12):m.start()], m.string[m.end():m.end() + 12]
        sign = _SIGN_BEFORE.search(before) or _SIGN_AFTER.match(after)
        if not sign and not _DIGIT_BEFORE.search(before) and not _DIGIT_AFTER.match(after):
            return None
    return "".join(out)


def _sign(m: re.Match) -> str | None:
    if m["plus"]:
        return "+"
    if m["dash"]:
        return "-"
    if m["d1"] or m["d2"]:
        return "."
    if m["a1"] or m["a2"] == "@":
        return "@"
    before, after = m.string[max(0, m.start() - 64):m.start()], m.string[m.end():m.end() + 128]
    local = re.search(r"[A-Za-z0-9._%+-]+$", before)
    if not local:
        return None
    spelled = re.match(rf"[A-Za-z0-9-]+(?:\s*[(\[{{<]\s*(?:{_DOT}|\.)\s*[)\]}}>]\s*|\s+(?:{_DOT})\s+)[A-Za-z0-9-]", after, re.I)
    return "@" if spelled or _names_mailbox(local[0], m["a2"], before[:local.start()], after) else None


def _names_mailbox(local: str, at: str, before: str, after: str) -> bool:
    """Whether a bare "at" before a domain without spelled dots stands in an address.

    Any alphabetic ending in one case will do. A local part with a digit, dot or underscore counts at once (numbers alone only
    before a common ending), a plain word unless a preposition mostly follows it; words that tell of an address let all count."""
    domain = _PLAIN_DOMAIN.match(after)
    known = domain and _KNOWN_END.fullmatch(domain["end"])
    if not domain or not (known or domain["end"].islower() or domain["end"].isupper()):
        return False
    if at.lower() != "at" or _ADDRESS.search(before):
        return True
    marked = re.search(r"[0-9._]", local)
    return bool(known or re.search("[A-Za-z]", local)) if marked else local.lower() not in _PLACED


def hints(text: str) -> bool:
    """Whether the text may hold a disguise; cheap looks first, as nearly all texts have none."""
    if not text.isascii() and (_FOLDED.search(text) or _MATH.search(text)):
        return True
    low = text.lower()
    if any(c in low for c in "([{<") and _BRACKETED.search(low):
        return True
    if any(w in low for w in ("plus", "dash", "hyphen")) and _SPOKEN.search(low):
        return True
    if any(w in low for w in (*_DOT_WORDS, " @", " .")) and _SPACED.search(low):
        return True
    if re.search(r"\.[a-z]", low) and _BARE.search(low):
        return True
    words = low.translate(_PUNCTUATION).split()
    if _DIGITS.keys().isdisjoint(words):
        return False
    last = len(words) - 1
    for i, w in enumerate(words):
        if w in _DIGITS and i < last:
            after = words[i + 1]
            if after in _DIGITS or after in _SIGN_WORDS or "0" <= after[0] <= "9":
                return True
        elif w in _SIGN_WORDS and i < last and words[i + 1] in _DIGITS:
            return True
        elif "0" <= w[-1] <= "9" and i < last and words[i + 1] in _DIGITS:
            return True
    return False


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans in source characters that only the rewritten text shows."""
    if not hints(text):
        return []
    now = Aligned(text, list(range(len(text))), list(range(1, len(text) + 1)))
    if not text.isascii():
        now = now.rewritten(_ANY_FOLDED, lambda m: _FOLD.get(ord(m[0]), "" if m[0] in _HIDDEN else m[0]))
    now = now.rewritten(_SPELLED, _digits).rewritten(_SIGN, _sign)
    out = []
    for kind, a, b in base_spans(now.text) if now.text != text else []:
        start, end = now.start[a], now.end[b - 1]
        known = any(k == kind and (s <= start and end <= e if k == "email" else s < end and start < e) for k, s, e in base)
        if not known and text[start:end] != now.text[a:b]:
            out.append((kind, start, end))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _span_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for part in text_slices(batch):
        out = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in part.column("text").to_pylist():
            base = base_spans(text or "")
            added = added_spans(text or "", base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(base + added))
            out["n_added"].append(len(set(added)))
        yield {"doc_id": part.column("doc_id")} | out


def find_pii(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row, repeated ids included.

    The four counts and the digest are of base spans, ``spans`` lists base and added ones as kind:start:end in code points, end
    exclusive, by start and then kind; ``n_added`` counts those that only the rewritten text shows. A null text is an empty one:
    no spans, and the digest of an empty string. An empty table gives no rows; other columns are not read.
    """
    rows = picked(df, doc_id=doc_id, text=text)
    return arrow_map(rows, _span_rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, "
                     "n_phone bigint, base_sha256 string, spans string, n_added bigint")


def redacted_text(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced and ``n_chars`` (if named) set to the new length; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                new = [None if t is None else redacted_text(t) for t in part.column(text).to_pylist()]
                old = part.schema
                columns = {text: pa.array(new, old.field(text).type)}
                if n_chars:
                    columns[n_chars] = pa.array([None if t is None else len(t) for t in new], old.field(n_chars).type)
                yield pa.RecordBatch.from_arrays([columns.get(f.name, part.column(i)) for i, f in enumerate(old)], schema=old)

    return df.mapInArrow(run, df.schema)
