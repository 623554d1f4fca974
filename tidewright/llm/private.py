"""Personal information inside free text: mentions, typed placeholders, format-preserving pseudonyms.

Five kinds are found: email, phone, id_number, street_address and person_name.
Rules are tried in that order and a later one never overlaps an earlier one.

A mention comes with its placeholder, which carries a pseudonym. Numbers
(phones, id numbers) and dates are validated and then permuted within their own
format by a keyed Feistel network: digits stay digits, letters stay letters,
marks stay; card numbers (Luhn), IBANs (mod 97), health numbers (mod 11), social
security numbers and North American telephone numbers that are valid map to
valid ones and others to others; a date stays a date, written in its own way.
Equal values get equal pseudonyms in all documents, a telephone number with or
without its country code 1 too; whoever holds the key can invert them. Emails,
addresses and names get a keyed tag of TAG hex digits.

Null texts and null or empty arrays have no mention and come out unchanged. A
null array element comes out null. Rows that occur twice come out twice.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import spread

#: Given names that are recognised without any context.
GIVEN_NAMES = (
    "Anneke Anouk Astrid Beatriz Bruno Callum Chiara Desmond Dmitri Elio Emeka Farah Fiona Gareth Hana Imani Ingrid Inés Jorun Jürgen Kwame Leila Linnea Lorcan "
    "Maren Marisol Mateo Mei Noor Odette Pavel Petra Priya Ravi René Rowan Salome Soren Tariq Tobias Vikram Wanda Yusuf Zofia Zoë "
    "Aisha Alice Amara Ananya Andrea Anna Antonio Carlos Carmen Chen Clara Daniel David Elena Emily Emma Fatima Francesca Hannah Helen Ibrahim Ivan James Jane "
    "Javier John José Julia Karen Katarina Laura Linda Lucas Luis Magnus Maria Marie Martin Mary Michael Mohammed Nadia Nina Olga Oliver Omar Patrick Paul Peter "
    "Rachel Robert Rosa Samuel Sarah Sofia Stefan Susan Thomas Yuki William"
).split()

_LOCAL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
_DOT = r"(?:\.|[ ]?[\[({]\s?dot\s?[\])}][ ]?|[ ]dot[ ])"
_DOMAIN = rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
#: With the sign, then with the word.
EMAIL = [re.compile(_LOCAL + r"[ ]?@[ ]?" + _DOMAIN, re.IGNORECASE), re.compile(_LOCAL + r"(?:[ ]?[\[({]\s?at\s?[\])}][ ]?|[ ]at[ ])" + _DOMAIN, re.IGNORECASE)]
#: What follows a quantity, not a telephone number.
UNIT = r"(?!\s?(?:mg|g|kg|ml|l|mcg|µg|μg|iu|units?|u/l|mmol|ng|pg|cells|vials?|days?|weeks?|years?|times|steps|kcal|%)\b)"
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00)1[-. ]?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}"
    r"|\+\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,6}\)?){2,6}(?<=\d)"
    r"|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}"
    r"|[2-8]\d{2}([-. ])\d{3}\1\d{4}|9[0-8]\d([-. ])\d{3}\2\d{4}|99[0-8]([-. ])\d{3}\3\d{4}"
    r"|[2-9]\d{2}[2-9]\d{2}\d{4}"
    r"|0\d{3}[ ]\d{3}[ ]\d{3}|0\d{4}[ ]\d{6}|0\d(?:[. ]\d{2}){4}|0\d{2,4}/\d{4,8}(?:-\d{1,4})?"
    r"|[2-9]\d{2}-\d{4}"
    r")(?![\w-]|[./]\d)" + UNIT
)
ID_LABEL = (
    r"(?:SSN|social[ ]security(?:[ ](?:no|number))?|MRN|medical[ ]record(?:[ ](?:no|number))?|passport(?:[ ](?:no|number))?|NHS(?:[ ](?:no|number))?|NI[ ]number|national[ ]insurance(?:[ ](?:no|number))?"
    r"|insurance(?:[ ]member)?[ ](?:no|number|id)|member[ ](?:no|number|id)|policy[ ](?:no|number)|driver'?s?[ ]licen[cs]e|id(?:entity)?[ ]card|tax[ ](?:no|number|id)|account[ ](?:no|number))"
)
ID_VALUE = r"(?=[A-Za-z]*[\d-])(?:[A-Z]{2}(?:[ ]\d{2}){3}[ ][A-Z]|\d{3}[ ]\d{3}[ ]\d{4}|\d{3}[ ]\d{2}[ ]\d{4}|[A-Z0-9]+(?:-[A-Z0-9]+)*)"
ID_NUMBER = [
    re.compile(rf"\b{ID_LABEL}\s*[.:#]*\s*(?P<v>{ID_VALUE})(?![\w])", re.IGNORECASE),
    re.compile(rf"(?:Registered with|Chart copied under|form shows)\s+(?P<v>{ID_VALUE})(?![\w])", re.IGNORECASE),
    re.compile(rf"(?<![\w-])(?P<v>{ID_VALUE})(?=,?\s(?:verified|on file)\b)"),
    re.compile(r"(?<![\w.-])(?P<v>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?|(?:\d[ -]?){12,18}\d)(?![\w-])"),
    re.compile(r"(?<![\w.-])(?P<v>(?:\d{3}-\d{2}-\d{4}|[A-Z]{3}\d{9}|[A-Z]{2}\d{7}|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]\d{3}-\d{4}(?:-\d{4})?|[A-Z]{2}(?:[ ]\d{2}){3}[ ][A-Z]|999[ ]\d{3}[ ]\d{4}))(?![\w-])"),
]
#: Card numbers and IBANs, which their check digits must prove.
CHECKED = ID_NUMBER[3]
_WORD = r"[^\W\d_][\w'’-]*"
STREET_ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    rf"\d{{1,5}}[a-z]?[ ](?:{_WORD}[ ]){{1,3}}?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Close|Crescent|Terrace|Way|Boulevard|Blvd|Drive|Place|Square)\b(?:,[ ]Apt[ ]\w+)?"
    rf"|\d{{1,4}}[a-z]?,?[ ](?:rue|avenue|boulevard|place|chemin)[ ](?:de[ ]la[ ]|de[ ]|du[ ]|des[ ]|d['’])?{_WORD}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Via|Rua)[ ]{_WORD}[ ]\d{{1,4}}[a-z]?\b"
    r"|[^\W\d_]+(?:weg|straße|strasse|gasse|platz|allee)[ ]\d{1,4}[a-z]?\b"
    rf")(?:,[ ]\d{{5}}[ ]{_WORD})?",
    re.IGNORECASE,
)

_TITLE = r"(?:(?:Dr|Mrs|Mr|Ms|Miss|Prof|Sr|Fr)\.?[ ])"
_NAME = r"[^\W\d_](?:\.|[\w'’-]*)"
#: What stands before a name, whatever the name.
CUE = re.compile(
    r"(?:\b(?:Emergency contact(?: is|:)|Next of kin(?: is|:)?|Pt\.?|Neighbou?r|[Dd]aughter|[Ss]on|[Ss]ister|[Bb]rother|[Mm]other|[Ff]ather|[Ww]ife|[Hh]usband|[Ss]pouse|(?:ex-)?[Pp]artner|Named|Referred by|Followed by|"
    r"Seen with|Sponsor:|Interpreter|Guardian:?|Caregiver:?|Carer:?|[Cc]ontact(?:ed)?|[Ss]poke (?:with|to)|[Aa]ccompanied by|[Ll]ives with|[Vv]isited by|[Mm]et with|[Dd]iscussed with|[Ss]een by|[Ss]igned by|[Nn]amed|[Nn]iece|[Nn]ephew|[Uu]ncle|[Aa]unt|[Ff]riend)[ ]" + f"{_TITLE}?|{_TITLE}" + r")(?=[^\W\d_])"
)
#: What follows a name at the beginning of a sentence.
TAIL = re.compile(r"(?:^|(?<=[.!?][ ])|(?<=\n))(?P<v>[A-Z][\w.'’-]*(?:,?[ ][A-Z][\w.'’-]*){0,3})(?=[ ](?:signed|helps|manages|reports|was present|called|consented|came|slept|walked|said|says|states|stated|denies|denied|told|asked|lives|visited|felt|feels|complains|complained|phoned|arrived|agreed|declined|refused|brought|drove|cooks|wrote|writes|works)\b)")
#: Words that end a name or can't begin one.
PLAIN = frozenset(
    "a an and are as at by for from had has he helps her his in is was with who reports manages signed since to of on or she the their they will writes pt dr mr mrs ms miss prof neighbour neighbor son daughter "
    "interpreter sponsor followed referred named seen lives custody accompanied emergency next kin contact present community nurse before after works takes married grew ward positive code platelets "
    "attends history dose bp smokes also".split()
)
#: Lower-case words that follow a given name in lower case without being its surname; those in -ed, -ing and -ly don't either.
VERBS = frozenset(
    "slept came went said told took takes gave gives felt feels ate eats drank drinks sat sits stood stands ran runs got gets saw sees knows knew thinks thought wants asks says states denies walks sleeps comes goes drives drove "
    "cooks brought brings left leaves lost loses woke wakes fell falls began begins well today yesterday again here home then now still very also not will would can could may must should did does do be been being have having".split()
)
#: Words after a capitalised phrase that make it a place, a body or a syndrome.
PLACE = frozenset("clinic hospital mill center centre community protocol syndrome sign school library church ward unit street road lane avenue test scale score disease criteria college county university".split())


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


GIVEN = frozenset(map(_fold, GIVEN_NAMES))
TOKEN = re.compile("[^\\W\\d_](?:[\\w'’\u0300-\u036f-]*[\\w\u0300-\u036f])?")


class Taken:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.spans, (start, -1))
        return (i == 0 or self.spans[i - 1][1] <= start) and (i == len(self.spans) or end <= self.spans[i][0])

    def take(self, start: int, end: int) -> bool:
        """Whether the span was free; it is taken then."""
        if not self.free(start, end):
            return False
        bisect.insort(self.spans, (start, end))
        return True


def _name_spans(text: str) -> list[tuple[int, int]]:
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    at = {s: i for i, (s, _, _) in enumerate(tokens)}
    folded = [_fold(w) for _, _, w in tokens]
    gap = lambda i: text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < len(tokens) else "\n"
    initial = lambda i: len(tokens[i][2]) == 1 and tokens[i][2].isupper() and text[tokens[i][1] : tokens[i][1] + 1] == "."

    def surname(i: int, like: str) -> bool:
        """Whether token i can be the surname after a given name written like this one."""
        word = tokens[i][2]
        if word[0].isupper():
            return folded[i] not in PLAIN
        return like.islower() and len(word) > 3 and folded[i] not in PLAIN and folded[i] not in VERBS and not folded[i].endswith(("ed", "ing", "ly"))

    def after(i: int) -> int:
        """The last token of a name whose first token is i."""
        j = i
        while j + 1 < len(tokens) and j - i < 3:
            space = gap(j)
            if not (space in (" ", "  ", " ") or initial(j) and space in (". ", ".")):
                break
            if not (folded[j + 1] in GIVEN or initial(j + 1) or surname(j + 1, tokens[i][2])):
                break
            j += 1
            if tokens[j][2].islower() and folded[j] not in GIVEN:  # one surname in lower case
                break
        return j

    spans = Taken()

    def add(i: int, j: int) -> None:
        nxt = folded[j + 1] if gap(j) == " " and j + 1 < len(tokens) else ""
        if nxt in PLACE or folded[j] in PLACE:
            return
        spans.take(tokens[i][0], tokens[j][1])

    def comma_given(i: int) -> bool:
        """Surname, Given at token i."""
        return i + 1 < len(tokens) and gap(i) == ", " and (folded[i + 1] in GIVEN or initial(i + 1)) and folded[i] not in PLAIN and folded[i] not in GIVEN

    i = 0
    while i < len(tokens):
        if comma_given(i) and tokens[i][2][0].isalpha() and len(tokens[i][2]) > 2 and (tokens[i][2][0].isupper() or tokens[i + 1][2].islower()):
            add(i, i + 1)
            i += 2
        elif folded[i] in GIVEN and not (i and text[tokens[i - 1][1] : tokens[i][0]] in ("", "-", "_")):
            j = after(i)
            add(i, j)
            i = j + 1
        else:
            i += 1
    for m in CUE.finditer(text):
        i = at.get(m.end())
        if i is None or folded[i] in PLAIN and not initial(i) or not tokens[i][2][0].isupper():
            continue
        if comma_given(i) or i + 1 < len(tokens) and gap(i) == ", " and tokens[i + 1][2].istitle() and m[0].strip() in ("Named", "Interpreter"):
            add(i, i + 1)
        else:
            add(i, after(i))
    for m in TAIL.finditer(text):
        i = at.get(m.start())
        if i is not None and (folded[i] not in PLAIN or initial(i)) and (initial(i) or len(m["v"].split()) > 1) and not folded[i].startswith(("caregiver", "neighbo", "portal")):
            add(i, after(i))
    return spans.spans


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the mentions in a text, 0-based, in order; begin is at a letter or digit."""
    found: list[tuple[str, int, int]] = []
    taken = Taken()

    def take(kind: str, start: int, end: int) -> None:
        while start < end and not text[start].isalnum():
            start += 1
        if start < end and taken.take(start, end):
            found.append((kind, start, end))

    for rule in EMAIL:
        for m in rule.finditer(text):
            take("email", m.start(), m.end())
    for rule in ID_NUMBER[:1]:
        for m in rule.finditer(text):
            if any(c.isdigit() for c in m["v"]):
                take("id_number", m.start("v"), m.end("v"))
    for m in STREET_ADDRESS.finditer(text):
        take("street_address", m.start(), m.end())
    for m in PHONE.finditer(text):
        take("phone", m.start(), m.end())
    for m in CHECKED.finditer(text):
        if luhn_valid(plain(m["v"])) or iban_valid(plain(m["v"])):
            take("id_number", m.start("v"), m.end("v"))
    for rule in ID_NUMBER[1:]:
        for m in rule.finditer(text) if rule is not CHECKED else ():
            if sum(c.isdigit() for c in m["v"]) >= 5:
                take("id_number", m.start("v"), m.end("v"))
    for start, end in _name_spans(text):
        take("person_name", start, end)
    return sorted(found, key=lambda x: x[1])


# Feistel pseudonyms -------------------------------------------------------------------------------

ROUNDS = 10


def _mix(key: bytes, tag: str, round_: int, half: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tag}:{round_}:{half}".encode(), key=key[:64], digest_size=16).digest(), "big") % size


def permute(value: int, size: int, key: bytes, tag: str, invert: bool = False) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network, walked until it falls inside."""
    a = max(2, int(size**0.5))
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        for r in reversed(range(ROUNDS)) if invert else range(ROUNDS):
            sign = -1 if invert else 1
            if r % 2:
                right = (right + sign * _mix(key, tag, r, left, b)) % b
            else:
                left = (left + sign * _mix(key, tag, r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _encode(shape: str) -> tuple[int, int]:
    """The rank of an alphanumeric string among those of its shape, and their number."""
    rank, size = 0, 1
    for c in shape:
        base, zero = (10, "0") if c.isdigit() else (26, "A")
        rank, size = rank * base + ord(c.upper()) - ord(zero), size * base
    return rank, size


def _decode(rank: int, shape: str) -> str:
    out = []
    for c in reversed(shape):
        rank, x = divmod(rank, 10 if c.isdigit() else 26)
        out.append(chr(ord("0") + x) if c.isdigit() else chr(ord("A") + x) if c.isupper() else chr(ord("a") + x))
    return "".join(reversed(out))


def plain(value: str) -> str:
    """The ASCII letters and digits of a value."""
    return "".join(c for c in value if c.isascii() and c.isalnum())


def check_digit(nine: str) -> str | None:
    """The modulus-11 check digit of nine digits; null where there is none."""
    check = (11 - sum(int(d) * (10 - i) for i, d in enumerate(nine)) % 11) % 11
    return None if check == 10 else str(check)


def nhs_valid(digits: str) -> bool:
    """Ten digits with a modulus-11 check digit."""
    return len(digits) == 10 and digits.isdigit() and check_digit(digits[:9]) == digits[9]


def luhn_digit(digits: str) -> str:
    """The check digit that makes the digits before it a card number."""
    doubled = (int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(digits)))
    return str(-sum(d - 9 if d > 9 else d for d in doubled) % 10)


def luhn_valid(core: str) -> bool:
    """Thirteen to nineteen digits with a Luhn check digit, not all equal."""
    return 13 <= len(core) <= 19 and core.isdigit() and len(set(core)) > 1 and luhn_digit(core[:-1]) == core[-1]


def _iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in (account + country).upper() + "00")) % 97


def iban_valid(core: str) -> bool:
    """Two letters, two check digits and an account of 11 to 30 characters with rest 1 by 97."""
    return 15 <= len(core) <= 34 and core[:2].isalpha() and core[2:4].isdigit() and 98 - _iban_rest(core[:2], core[4:]) == int(core[2:4])


def ssn_valid(core: str) -> bool:
    """Nine digits whose area, group and serial number can be given out."""
    return len(core) == 9 and core.isdigit() and core[:3] not in ("000", "666") and core[0] != "9" and core[3:5] != "00" and core[5:] != "0000"


def nanp_valid(core: str) -> bool:
    """Ten digits whose area and exchange begin with 2 to 9."""
    return len(core) == 10 and core.isdigit() and core[0] >= "2" and core[3] >= "2"


#: Kinds of numbers: the test, what of the number is permuted, and how the whole follows from it (none when it can't).
FORMATS = {
    "nanp": (nanp_valid, lambda core: core, lambda base, core: base),
    "nhs": (nhs_valid, lambda core: core[:9], lambda base, core: base + d if (d := check_digit(base)) else None),
    "card": (luhn_valid, lambda core: core[:-1], lambda base, core: base + luhn_digit(base)),
    "iban": (iban_valid, lambda core: core[4:], lambda base, core: core[:2] + f"{98 - _iban_rest(core[:2], base):02d}" + base),
    "ssn": (ssn_valid, lambda core: core, lambda base, core: base),
    "any": (lambda core: True, lambda core: core, lambda base, core: base),
}


def format_of(core: str, kind: str) -> str:
    """The first kind of number that the characters are; only telephone numbers follow the telephone plan."""
    return next(n for n, (holds, _, _) in FORMATS.items() if (kind == "phone" or n != "nanp") and (kind != "phone" or n in ("nanp", "any")) and holds(core))


def pseudonym(value: str, key: bytes, kind: str = "number", invert: bool = False) -> str:
    """The value with its letters and digits permuted within its format, one to one among the numbers of its kind.

    A leading country code 1 before a number of the North American plan stays
    as it is, so that the number has one pseudonym with and without it.
    """
    core = plain(value)
    fixed = ""
    if kind == "phone":
        match = re.fullmatch(r"((?:00)?1)(\d{10})", core)
        if match and nanp_valid(match[2]):
            fixed, core = match[1], match[2]
    name = format_of(core, kind)
    _, part, whole = FORMATS[name]
    base = part(core)
    rank, size = _encode(base)
    if size < 2:
        return value
    tag = f"{kind}:{name}:{core[:2] if name == 'iban' else ''}:{''.join('9' if c.isdigit() else 'A' for c in base)}"
    while True:  # a walk inside the cycle of those that are alike
        rank = permute(rank, size, key, tag, invert)
        made = whole(_decode(rank, base), core)
        if made is not None and format_of(made, kind) == name:
            break
    new = iter(fixed + made)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in value)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: English names of months.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?P<name>" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
_YEAR = r"(?P<y>(?:19|20)\d\d)"
#: The ways in which dates are written.
DATES = [
    re.compile(rf"(?<![\w-]){_YEAR}(?P<sep>[-/.])(?P<m>\d\d)(?P=sep)(?P<d>\d\d)(?![\w-])"),
    re.compile(rf"(?<![\w./-])(?P<d>\d{{1,2}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep){_YEAR}(?![\w-])"),
    re.compile(rf"(?<![\w-])(?P<d>\d{{1,2}})(?P<th>st|nd|rd|th)? {_MONTH}(?P<dot>\.?,? ){_YEAR}(?![\w-])"),
    re.compile(rf"(?<![\w-]){_MONTH}(?P<dot>\.?) (?P<d>\d{{1,2}})(?P<th>st|nd|rd|th)?(?P<sep>,? ){_YEAR}(?![\w-])"),
]


def _day(match: re.Match) -> tuple[datetime.date, bool] | None:
    """The day of a written date, and whether its month stands first; of two numbers the first is the day where it can be."""
    found = match.groupdict()
    d, y = int(found["d"]), int(found["y"])
    m = next(i for i, n in enumerate(MONTHS, 1) if n.startswith(found["name"])) if found.get("name") else int(found["m"])
    swapped = not found.get("name") and match.re is DATES[1] and m > 12
    try:
        return datetime.date(y, *((d, m) if swapped else (m, d))), swapped
    except ValueError:
        return None


def is_date(text: str) -> bool:
    return any((m := rule.fullmatch(text)) and _day(m) for rule in DATES)


def pseudonym_date(value: str, key: bytes, invert: bool = False) -> str:
    """A date permuted among the days from 1900 to 2099 and written in the same way; anything else comes out as it is.

    One day has one pseudonym in all ways of writing, but for numbers whose
    month stands first, which are permuted among those that can be told so.
    """
    match = next((m for rule in DATES if (m := rule.fullmatch(value)) and _day(m)), None)
    if match is None:
        return value
    day, swapped = _day(match)
    number = day.toordinal() - _FIRST
    while True:
        number = permute(number, _LAST - _FIRST + 1, key, "date:month first" if swapped else "date", invert)
        day = datetime.date.fromordinal(_FIRST + number)
        if not swapped or day.day > 12:
            break
    new = {"y": str(day.year), "d": str(day.month if swapped else day.day), "m": str(day.day if swapped else day.month)}
    found = match.groupdict()
    if found.get("name"):
        new["name"] = MONTHS[day.month - 1] if found["name"] in MONTHS and found["name"] != "May" else MONTHS[day.month - 1][:3]
    if found.get("th"):
        new["th"] = "th" if day.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10, "th")
    two = match.re is DATES[0] or match.re is DATES[1] and len(found["d"]) == len(found["m"]) == 2
    out, last = [], 0
    for name in sorted((n for n in new if found.get(n)), key=match.start):
        out += [value[last : match.start(name)], new[name].zfill(2) if two and name in "dm" else new[name]]
        last = match.end(name)
    return "".join(out)


TAG = 16


def placeholder(kind: str, value: str, key: bytes) -> str:
    """What stands for a mention: its kind and its pseudonym."""
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()} {pseudonym(value, key, kind)}]"
    same = " ".join(re.findall(r"\w+", _fold(value)))
    return f"[{kind.upper()} {hmac.new(key, f'{kind}:{same}'.encode(), hashlib.sha256).hexdigest()[:TAG]}]"


def replaced(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, placeholder) of the mentions in a text; marks before the first digit belong to a phone number's placeholder."""
    out = []
    for kind, start, end in find(text):
        first = start
        while kind == "phone" and first and text[first - 1] in "+(":
            first -= 1
        out.append((kind, start, end, placeholder(kind, text[first:end], key)))
    return out


def redact(text: str, key: bytes, dates: bool = True) -> str:
    """The text with placeholders such as [PHONE 263-555-0157] in place of mentions, and its dates permuted."""
    spans = []
    taken = Taken()
    for kind, start, end, shown in replaced(text, key):
        while kind == "phone" and start and text[start - 1] in "+(":
            start -= 1
        taken.take(start, end)
        spans.append((start, end, shown))
    for rule in DATES if dates else ():
        spans += [(m.start(), m.end(), pseudonym_date(m[0], key)) for m in rule.finditer(text) if _day(m) and taken.take(m.start(), m.end())]
    out, last = [], 0
    for start, end, shown in sorted(spans):
        out += [text[last:start], shown]
        last = end
    return "".join([*out, text[last:]])


# Operators ----------------------------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("begin_at", "integer").add("end_at", "integer").add("placeholder", "string"))


def mentions(df: DataFrame, id_col: str, text_cols: list[str], array_cols: list[str], key: bytes) -> DataFrame:
    """(id, field_name, elem_no, kind, begin_at, end_at, placeholder): one row per mention, 1-based, elem_no 0 outside arrays."""

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "begin_at": s + 1, "end_at": e, "placeholder": p} for k, s, e, p in replaced(t, key)])

    parts = [F.array(F.struct(F.lit(c).alias("field_name"), F.lit(0).alias("elem_no"), F.col(c).alias("t"))) for c in text_cols]
    parts += [F.expr(f"transform(coalesce(`{c}`, array()), (t, i) -> struct('{c}' as field_name, i + 1 as elem_no, t as t))") for c in array_cols]
    texts = spread(df).select(F.col(id_col).alias(id_col), F.explode(F.concat(*parts)).alias("p")).select(id_col, "p.*").where("t is not null and t <> ''")
    return texts.select(id_col, "field_name", "elem_no", F.inline(spans("t")))


def redacted(df: DataFrame, text_cols: list[str], array_cols: list[str], key: bytes, dates: bool = True) -> DataFrame:
    """df with the given text and array columns redacted; all other columns as they are."""

    @F.pandas_udf(T.StringType())
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t, key, dates))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def many(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [None if t is None else redact(t, key, dates) for t in a])

    return spread(df).withColumns({c: one(c) for c in text_cols} | {c: many(c) for c in array_cols})
