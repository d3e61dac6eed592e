"""Personal information in free text, replaced by placeholders of its kind.

Regular expressions propose spans, structural and checksum validators (Luhn, mod 97, dates inside
national ids) confirm them, and words near a span raise or lower its score; spans that reach the
threshold are replaced, the rest of the text stays as it is. Matching is done on a copy in which
width and style forms, kinds of space, look-alike letters and invisible characters are
plain, with each character's place in the original kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.lookalikes import _expand

KINDS = ("email", "phone", "id_number", "address", "name", "card", "iban")
THRESHOLD = 0.5
#: Characters before a span in which context words count.
NEAR = 32


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(digits: str) -> bool:
    """Whether the last two digits are 97 minus the rest mod 97 (national register numbers)."""
    head, tail = int(digits[:-2] or 0), int(digits[-2:])
    return tail in (97 - head % 97, 97 - (2 * 10 ** len(digits[:-2]) + head) % 97)


def resident_id(digits: str) -> bool:
    """A 16-digit resident number: digits 7 to 12 are a birth date, 40 added to the day for women."""
    if len(digits) != 16:
        return False
    day, month = int(digits[6:8]), int(digits[8:10])
    return (1 <= day <= 31 or 41 <= day <= 71) and 1 <= month <= 12


def _phone(digits: str) -> bool:
    return 8 <= len(digits) <= 15


# First digits and lengths of payment cards by issuer.
_ISSUERS = (
    (r"4", (13, 16, 19)), (r"5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), (r"3[47]", (15,)), (r"30[0-5]|3095|3[689]", (14,)), (r"6011|64[4-9]|65", (16, 19)), (r"35(?:2[89]|[3-8])", (16,)), (r"62", (16, 17, 18, 19)),
)
# Length of an account number by country.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def card(digits: str) -> bool:
    """A payment card: an issuer's first digits and length, and the Luhn check."""
    return luhn(digits) and any(len(digits) in lengths and re.match(first, digits) for first, lengths in _ISSUERS)


def iban(text: str) -> bool:
    """An account number of its country's length whose rearranged digits leave 1 when divided by 97."""
    code = re.sub(r"\s", "", text).upper()
    return len(code) == _IBAN_LENGTH.get(code[:2]) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


# Words that speak for or against a kind when they stand before a span.
_FOR_PHONE = re.compile(r"\b(?:wa|hub|hubungi|telp|tlp|telepon|phone|tel|call|chat|nomor(?:ku)?|no|hp|via|sms|kontak|contact|whatsapp)\b", re.I)
_FOR_CARD = re.compile(r"\b(?:kartu|card|cc|visa|mastercard|amex|kredit|debit|credit)\b", re.I)
_FOR_ID = re.compile(r"\b(?:nik|ktp|induk|kependudukan|npwp|ssn|social|security|tax|tin|sim|paspor|passport|license|licence|national|identity|sin|niss)\b", re.I)
_AGAINST = re.compile(r"\b(?:resi|order|kode|video|tgl|tanggal|jam|view|views|versi|version|ip|harga(?:nya)?|rp|invoice|tracking|parcel|paket)\b[^\w]*$|https?://\S*$|www\.\S*$", re.I)


@dataclass(frozen=True)
class Detector:
    """A pattern whose group ``span`` (or whole match) is proposed as ``kind`` with ``base`` as its score."""

    kind: str
    pattern: re.Pattern
    base: float
    valid: Callable[[str], bool] | None = None  # on the span's digits, for an account number on the span
    confirmed: float = 0.0  # added where valid
    context: re.Pattern | None = None
    near: float = 0.0  # added where a context word stands before
    against: float = 0.0  # taken off where a speaking-against word stands right before
    cue: str = ""  # a pattern that any match contains


def _p(pattern: str, flags: int = re.I) -> re.Pattern:
    return re.compile(pattern, flags)


_SEP = r"[ .\-/]?"
_HOST = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_LOCAL = r"(?<![\w.+%-])[a-z0-9][\w.+%-]*"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
# A personal name after a cue: capitalised words and initials, or up to three lower-case words before a stop.
_TITLE = r"[A-Z][\w'’-]+(?: [A-Z]\.?(?![\w]))?(?: [A-Z][\w'’-]+){0,2}"
_LOWER = r"[a-z][\w'’-]+(?: [a-z]\.)?(?: [a-z][\w'’-]+(?: [a-z][\w'’-]+(?=\s*(?:[,.!/\n-]|$)))?)?"
_NAME = rf"(?:{_TITLE}|{_LOWER})"
_FREE = r"[A-Za-z][\w'’-]+(?: [A-Za-z]\.?)?(?: [A-Za-z][\w'’-]+){0,2}?"
_FULL = r"[A-Z][a-z'’-]+(?: [A-Z]\.)?(?: [A-Z][a-z'’-]+){1,2}"
# What follows a cue without being a name.
_NO_NAME = r"(?!(?:rt|rw|guru|sopir|supir|dokter|lurah|camat|polisi|satpam|kades|ustad|haji|dosen|bidan|rahasia|saya|tokonya|toko|kamu|aku|kita|the|a|not|my|your|very|so|just)\b)"
_TITLES = r"(?:Pak|Bu|Ibu|Bapak|Mbak|Mas|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|PAK|BU|MBAK|MAS|IBU|BAPAK)"
_ROAD = r"(?:jl|jln|jalan|gg|gang)\b\.?"
_PLACE = r"(?:,?\s+(?:kec|kel|kab)\.?\s+[a-z]+)?"
_NUMBER = r"(?:no(?:mor)?\b\.?\s*\d+[a-z]?|no\.\d+)"
# Cues: what every match of the detectors built on them contains.
_AT, _AT_SPELT, _AT_BARE = r"(?:@|\s@\s)", r"\s?[\[(]\s?at\s?[\])]\s?", r"\s(?:at|et)\s"
_INTRO = r"(?<!\w)(?:nama saya|namaku|nama lengkap|my name is|my name's|atas nama|ttd|ask for|penerima)"
_ON_BEHALF, _AN, _THIS_IS = r"(?<!\w)a\.\s?n\.", r"(?<!\w)an\s", r"(?<!\w)this is\s"
_PERSON = r"(?<!\w)(?:pak|bu|ibu|bapak|mbak|mas|mr\.?|mrs\.?|ms\.?|dr\.?)\s"
_SIGNED = r"(?<!\w)(?:regards|sincerely|yours truly|cheers|hormat saya|salam hangat|salam|tertanda|signed|contact person|contact|narahubung|attn\.?|dear|kepada|yth\.?|i am|i'm|prof\.?|sdr\.?|sdri\.?|kak|bang)"


def _d(kind: str, cue: str, pattern: str, base: float, valid=None, confirmed=0.0, context=None, near=0.0, against=0.0, flags: int = re.I) -> Detector:
    return Detector(kind, _p(pattern, flags), base, valid, confirmed, context, near, against, cue)


_DIGIT, _DIGIT_RE = r"\d", re.compile(r"\d")
DETECTORS = (
    # account numbers and payment cards: the checksum decides
    _d("iban", _DIGIT, r"\b[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?!\w)", 0.0, iban, 1.0),
    _d("card", _DIGIT, r"(?<![\w.-])\d{4}(?:[ \-]?\d{4}){2,3}(?:[ \-]?\d{1,3})?(?![\w]|[.\-]\d)", 0.0, card, 0.8, _FOR_CARD, 0.3, 0.6),
    _d("card", _DIGIT, r"(?<![\w.-])3\d{3}[ \-]?\d{6}[ \-]?\d{4,5}(?![\w]|[.\-]\d)", 0.0, card, 0.8, _FOR_CARD, 0.3, 0.6),
    _d("email", _AT, rf"{_LOCAL}{_AT}(?:{_HOST}\.)+[a-z]{{2,}}", 0.9),
    _d("email", _AT_SPELT, rf"{_LOCAL}{_AT_SPELT}{_HOST}(?:{_DOT}{_HOST})+", 0.9),
    _d("email", _AT_BARE, rf"{_LOCAL}{_AT_BARE}{_HOST}(?:(?:\sdot\s|\.){_HOST})*\s?(?:\sdot\s|\.)[a-z]{{2,}}\b", 0.8),
    # national id: 16 digits in one piece or in groups
    _d("id_number", _DIGIT, r"(?<![\w.-])\d(?:[ .\-]?\d){15}(?![\w]|[.-]\d)", 0.1, resident_id, 0.3, _FOR_ID, 0.4, 0.6),
    # tax id, whose ninth digit is a check digit
    _d("id_number", _DIGIT, r"(?<![\w.])\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}(?!\d)", 0.6, lambda d: luhn(d[:9]), 0.2, _FOR_ID, 0.2),
    _d("id_number", _DIGIT, r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", 0.4, None, 0.0, _FOR_ID, 0.5, 0.4),
    _d("id_number", _DIGIT, r"\b(?:ssn|social security)\b\D{0,12}\d{3}[ .]?\d{2}[ .]?\d{4}\b", 0.8),
    # driving licence, passport, tax and national numbers that are named
    _d("id_number", _DIGIT, r"\b(?:sim|driv\w+ licen[cs]e|licen[cs]e)\b\W{0,3}(?:no(?:mor)?\b\W{0,3}|number\W{0,3}|saya\W|is\W)?(?P<span>[a-z]{0,2}\d[\d \-]{9,16}\d)", 0.8),
    _d("id_number", _DIGIT, r"\b(?:paspor|passport)\b\W{0,3}(?:no(?:mor)?\b\W{0,3}|number\W{0,3}|saya\W|is\W|ku\W)?(?P<span>[a-z]{1,2}\s?\d{6,8})(?!\w)", 0.9),
    _d("id_number", _DIGIT, r"\b(?:sin|niss|tax id|tin|national id)\b\D{0,12}(?P<span>\d[\d .\-]{7,15}\d)", 0.4, lambda d: len(d) in (9, 11) and (luhn(d) or len(d) == 11 and mod97(d)), 0.4, None, 0.0, 0.3),
    # phones: international, mobile, area code, three-three-four (bare only in context), digits apart
    _d("phone", _DIGIT, r"(?<![\w+])(?:\+|00)\d{1,3}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{2,12}){1,5}(?!\w)", 0.6, _phone, 0.2, _FOR_PHONE, 0.2, 0.5),
    _d("phone", _DIGIT, rf"(?<![\w.\-/+])(?:62|0)8\d{{1,2}}{_SEP}\d{{3,4}}{_SEP}\d{{3,5}}(?![\w]|[.\-/]\d)", 0.5, _phone, 0.1, _FOR_PHONE, 0.3, 0.6),
    _d("phone", _DIGIT, r"(?<!\w)\(0\d{2,3}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)", 0.6, None, 0.0, _FOR_PHONE, 0.3, 0.5),
    _d("phone", _DIGIT, r"(?<![\w.\-/+])0\d{2,3}[ \-]\d{3,4}[ \-]\d{3,4}(?![\w]|[.\-/]\d)", 0.3, None, 0.0, _FOR_PHONE, 0.4, 0.5),
    _d("phone", _DIGIT, r"(?<![\w.\-/+])\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}(?![\w]|[.\-/]\d)", 0.5, None, 0.0, _FOR_PHONE, 0.4, 0.6),
    _d("phone", _DIGIT, r"(?<![\w.\-/+])[2-9]\d{2}[2-9]\d{6}(?![\w]|[.\-/]\d)", 0.2, None, 0.0, _FOR_PHONE, 0.4, 0.6),
    _d("phone", _DIGIT, r"(?<![\w])[+]?(?:0|6 2)(?:[ ]\d){8,13}(?![\w])", 0.6, _phone, 0.1, _FOR_PHONE, 0.3, 0.5),
    # addresses: a street or estate with a number
    _d("address", _DIGIT, rf"\b{_ROAD}\s+(?:[a-z]+\s+){{1,3}}?(?:(?:[ivx]+|\d+)\s+)?{_NUMBER}(?:\s+rt\W{{0,2}}\d+\W{{0,3}}rw\W{{0,2}}\d+)?{_PLACE}", 0.9),
    _d("address", _DIGIT, rf"\b{_ROAD}\s+(?:[a-z]+\s+){{1,3}}?\d+\s?/\s?\d+{_PLACE}", 0.9),
    _d("address", _DIGIT, r"\b(?:[Jj]l|[Jj]ln|[Gg]g)\b\.?\s+(?:[A-Z][a-z]+\s+){1,3}?\d{1,4}[a-zA-Z]?(?!\w|[.,]?\d|\s*(?:x|kali|jam|menit|km|meter|hari|orang|ribu|rb|juta|jt|tahun)\b)", 0.7, flags=0),
    _d("address", _DIGIT, rf"\b(?:komplek|kompleks|perum|perumahan)\b\.?\s+(?:[a-z]+\s+){{1,3}}?(?:blok\s+[a-z]\W?\d+(?:\s+{_NUMBER})?|{_NUMBER}){_PLACE}", 0.9),
    _d("address", _DIGIT, r"(?<![\w.,/-])\d{1,4}[a-z]?\s+(?:[a-z]+\s+){1,2}?(?:street|road|rd|lane|avenue|ave|boulevard|blvd)\b\.?(?:,?\s+(?:apt|unit|suite)\.?\s*\d+)?", 0.7, None, 0.0, None, 0.0, 0.3),
    _d("address", _DIGIT, r"(?<![\w.,/-])\d{1,4}[a-zA-Z]?\s+(?:[A-Z][a-zA-Z]+\s+){1,2}?(?:St|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b\.?(?:,?\s+(?:[Aa]pt|[Uu]nit)\.?\s*\d+)?", 0.7, flags=0),
    # names behind a cue
    _d("name", _INTRO, rf"\b(?i:{_INTRO})\b:?\s+(?i:{_NO_NAME})(?P<span>{_NAME})", 0.7, flags=0),
    _d("name", _ON_BEHALF, rf"(?<!\w)(?i:{_ON_BEHALF})\s+(?i:{_NO_NAME})(?P<span>{_NAME})", 0.7, flags=0),
    _d("name", _AN, rf"\b(?i:{_AN})\s*(?i:{_NO_NAME})(?P<span>{_FREE})\s+ya\b", 0.7, flags=0),
    _d("name", _THIS_IS, rf"\b(?i:{_THIS_IS})\s*(?i:{_NO_NAME})(?P<span>{_FREE})\s+(?i:speaking)\b", 0.8, flags=0),
    _d("name", _PERSON, rf"(?<!\w){_TITLES}\s+(?i:{_NO_NAME})(?P<span>{_FREE})\s+(?i:yang jaga)\b", 0.8, flags=0),
    # mbak and mas also open sentences as a mere address, so they need a capitalised name
    _d("name", _PERSON, rf"(?<!\w)(?:Pak|Bu|Ibu|Bapak|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|PAK|BU|IBU|BAPAK)\s+(?i:{_NO_NAME})(?P<span>{_NAME})", 0.6, flags=0),
    _d("name", _PERSON, rf"\b(?:[Mm]bak|[Mm]as|pak|bu|ibu|bapak)\s+(?i:{_NO_NAME})(?P<span>{_TITLE})", 0.5, flags=0),
    # a full name, first and last in capitals, after a greeting, closing or role
    _d("name", _SIGNED, rf"(?<!\w)(?i:{_SIGNED})[:,]?\s+(?i:{_NO_NAME})(?P<span>{_FULL})(?![\w])", 0.6, flags=0),
)
#: A full name that stands alone counts if an e-mail address of the text is made of it.
_ALONE = _p(rf"(?<![\w@.])(?P<span>{_FULL})(?![\w@])", 0)


def _least_digits(nodes) -> int:
    """Digits that any match of a parsed pattern contains, at least."""
    total = 0
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            total += chr(arg).isdigit()
        elif name == "IN":
            total += all(str(o) == "RANGE" and chr(x[0]).isdigit() and chr(x[1]).isdigit() or str(x) == "CATEGORY_DIGIT" for o, x in arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            total += arg[0] * _least_digits(arg[2])
        elif name == "SUBPATTERN":
            total += _least_digits(arg[-1])
        elif name == "BRANCH":
            total += min(map(_least_digits, arg[1]))
    return total


#: Digits that a text needs for a detector, from the detector's own pattern.
_DIGITS = {d: _least_digits(_parser.parse(d.pattern.pattern, d.pattern.flags & ~re.UNICODE)) for d in DETECTORS}
#: What a text needs for any detector of a kind, put together from the detectors' own cues.
_NEEDS = {k: re.compile("|".join(dict.fromkeys(f"(?:{d.cue})" for d in DETECTORS if d.kind == k)), re.I) for k in KINDS}


@lru_cache(maxsize=None)
def _plain(ch: str) -> str:
    return _expand(ch) if ch > "\x7f" else ch


def plain_copy(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters and each one's place in the original; null places if nothing moved."""
    if text.isascii():
        return text, None
    out, at, moved = [], [], False
    for i, ch in enumerate(text):
        to = "" if ch in "‌‍" else _plain(ch)
        # a decomposed letter keeps its base, which is what the patterns know
        for c in to[:1] if len(to) > 1 and ch.isalpha() else to:
            out.append(c)
            at.append(i)
        moved |= len(to) != 1
    return "".join(out), at if moved else None


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in ``text``, in order and apart from each other."""
    if not text:
        return []
    plain, at = plain_copy(text)
    found = []
    needed, digits = {k for k, r in _NEEDS.items() if r.search(plain)}, len(_DIGIT_RE.findall(plain))
    for rank, d in enumerate(DETECTORS):
        if d.kind not in needed or digits < _DIGITS[d]:
            continue
        for m in d.pattern.finditer(plain):
            a, b = m.span("span") if "span" in d.pattern.groupindex else m.span()
            score = d.base
            if d.valid and d.valid(plain[a:b] if d.kind == "iban" else re.sub(r"\D", "", plain[a:b])):
                score += d.confirmed
            if d.context or d.against:
                before = plain[max(0, m.start() - NEAR) : m.start()]
                if d.context and d.context.search(before):
                    score += d.near
                if d.against and _AGAINST.search(before):
                    score -= d.against
            if score >= THRESHOLD:
                found.append((score, -rank, a, b, d.kind))
    if local := "".join(re.split("@|[\\[(]| at | et ", plain[a:b].lower())[0] + " " for _, _, a, b, kind in found if kind == "email"):
        for m in _ALONE.finditer(plain):
            if sum(len(w) > 3 and w.lower()[:4] in local for w in m["span"].split()) > 1:
                found.append((0.6, -len(DETECTORS), *m.span("span"), "name"))
    taken: list[tuple[int, int, str]] = []
    for _, _, a, b, kind in sorted(found, reverse=True):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))
    taken.sort()
    return [(at[a], at[b - 1] + 1, kind) if at else (a, b, kind) for a, b, kind in taken]


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, end = [], 0
    for a, b, kind in found:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, tuple[str, list[str]]] = {}
        keep, new, kinds = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text not in known:
                found = spans(text)
                known[text] = (redacted(text, found) if found else text, list(dict.fromkeys(k for _, _, k in found)))
            to, has = known[text]
            if has:
                keep.append(i)
                new.append(to)
                kinds.append(has)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(new, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["key", "text", "kinds"])


def findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, kinds) of each row with personal information: its text with placeholders such as [EMAIL], and the kinds it has.

    Rows without any, null and empty texts included, do not appear. Rows are taken as they are,
    repeats included, and nothing is shuffled.
    """
    kind = rows.schema[key].dataType.simpleString()
    some = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null and text <> ''")
    return some.mapInArrow(_find, f"key {kind}, text string, kinds array<string>")


def with_placeholders(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of every row, personal information replaced; ``key`` must be unique. Nulls stay null."""
    made = findings(rows, key, text).select("key", F.col("text").alias("made"))
    plain = rows.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return plain.join(made, F.col("k") == F.col("key"), "left").select(F.col("k").alias(key), F.coalesce("made", "t").alias(text))
