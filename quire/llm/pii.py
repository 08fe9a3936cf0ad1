"""PII replaced by surrogates (operator 5).

Detected entities get keyed replacements of their own kind: the same entity gets the same surrogate
in every document (coreference), different ones different surrogates. E-mail addresses, phone and
card numbers, IBANs, social security numbers, IP and MAC addresses and secrets are permuted within
their format by a keyed Feistel network over each alphabet, walked until the result is valid (card
and IBAN check digits, number plan, address class), which is one-to-one. Names after a title get a
given name of the same gender and script and a made-up surname of that script, in the same case;
so do names of a known given name and a capitalised word, and all mentions of such a name in the same text without a title, whole or by the surname.
Several titles may stand in a row, particles (von, de la) stay, and a name may hold an apostrophe. Dates of birth, known by the words before
them, become other dates between 1900 and 2019.

Collision check: all distinct entities of all documents are grouped by surrogate; where several
meet, all but the least get another draw until none meet. Only documents that hold such an entity
are joined with the new draws.

A name without a title is known by a given name of a list before a capitalised word that isn't a place's (Street, Park). Names of other words
without any title in their text, and phone numbers without a leading +, 0, area code or one of a few country codes, are beyond these patterns.

Cases: a very long text is searched line by line, whole; a null text stays null, an empty one empty; overlapping finds go to the first, then the
longest; repeated rows get the same text; a null doc_id is no matter; an empty table gives an empty
one; other columns are kept."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_objects, dropped, files_for, forget, fresh, table, written

KEY = "quire-surrogates-1"
# Alphabets, titles and name pools.
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE32 = UPPER + "234567"
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Professor")
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Quentin Robert Simon Thomas".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Fiona Greta Helena Irene Julia Karla Laura Maria Nina Olga Paula Renata Sofia Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Ирина Клара Лидия Мария".split(),
}
#: Given names that are known beside those of the pools; particles of surnames; words that make a place of a name before them.
ALSO_GIVEN = {
    "m": """James John Michael William David Richard Joseph Charles Christopher Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian George Edward Ronald Jason Jeffrey
    Hans Peter Klaus Wolfgang Jürgen Dieter Stefan Andreas Jean Pierre Michel François Luc José Juan Carlos Luis Miguel Javier Pedro""".split(),
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Kimberly Emily Michelle Amanda Melissa Deborah Stephanie
    Rebecca Ursula Monika Petra Sabine Claudia Katrin Marie Nathalie Isabelle Sylvie Camille Carmen Pilar Lucía Elena Rosa""".split(),
}
PARTICLES = tuple("von van der den de la di da del zu zur ten ter le".split())
PLACES = "Street St Road Avenue Lane Square Park Bridge Hall Hospital Church School Island Beach Hotel Straße Strasse Platz Weg Allee Kirche Plaza Calle".split()
BORN = "born|born on|born in|date of birth|birth date|dob|geboren|geboren am|geb|née le|né le|nacido el|nacida el"
SYLLABLES = {"latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te".split(), "cyrillic": "ба бе бо да де до фа фе фо га ге го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те".split()}
SURNAME_END = {"latin": ("l", "n", "r", "s"), "cyrillic": ("л", "н", "р", "с")}

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLES = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
KNOWN = "|".join(sorted({n for names in GIVEN.values() for n in names} | {n for names in ALSO_GIVEN.values() for n in names}))
NAME_WORD = r"[^\W\d_a-zа-яß-öø-ÿ](?:[^\W\d_]+(?:['’\-][^\W\d_]+)?|['’][^\W\d_]{2,})"
NEXT_WORD = rf" (?:(?:{'|'.join(PARTICLES)}) )*{NAME_WORD}"
HEX4 = "[0-9A-Fa-f]{1,4}"
#: (kind, pattern with one group: what is replaced). Earlier kinds win where finds begin together.
PATTERNS = (
    ("email", r"(?<![\w.+\-])([A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![A-Za-z0-9])"),
    ("aws", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])([0-9a-f]{32,64})(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])((?:ghp_|gho_|sk_live_|sk-|xox[bp]-)[A-Za-z0-9\-]{16,})(?![A-Za-z0-9])"),
    ("jwt", r"(?<![\w\-])(eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})(?![\w\-])"),
    ("ipv6", rf"(?<![\w:.])((?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\w:]|\.\d)"),
    ("born", rf"(?<!\w)(?i:{BORN})[.:]? (\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}([./])\d{{1,2}}[./]\d{{4}})(?!\d)"),
    ("mac", r"(?<![\w:])((?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2})(?![\w:])"),
    ("ip", rf"(?<![\d.])({OCTET}(?:\.{OCTET}){{3}})(?!\d|\.\d)"),
    ("iban", r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("card", r"(?<![\w.\-])(\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?![\w\-])"),
    ("ssn", r"(?<![\w\-])(\d{3}-\d{2}-\d{4})(?![\w\-])"),
    ("phone", r"(?<![\w.+])(\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<!\d[ \-])0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,4}){0,3}|\(0\d{1,4}\) ?\d{3,8}(?:[ /\-]\d{2,4}){0,3}|(?<!\d[ \-])(?:44|49|33|34|39) \d{2,3} \d{3,4} \d{4})(?![\w\-])"),
    ("name", rf"(?<!\w)(?:{TITLES})\.?(?: (?:{TITLES})\b\.?)* ((?!(?:{TITLES})\b){NAME_WORD}(?:{NEXT_WORD}){{0,2}})"),
    ("untitled", rf"(?<![\w\-])(?=[^\W\d_a-z])((?:{KNOWN})(?! (?:{'|'.join(PLACES)})\b){NEXT_WORD})"),
)
FIND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS))
ONE = {kind: re.compile(p) for kind, p in PATTERNS}
GROUP_OF = {kind: FIND.groupindex[kind] + 1 for kind, _ in PATTERNS}
KINDS = tuple(GROUP_OF)
LINE = re.compile(r"[^\n]+")
HINT = re.compile(r"[0-9@:]|[a-f]{32}")
#: What the entities hold that may lack a digit, @, colon or a run of 32 hexadecimal letters: titles, given names, and what secrets begin with.
MARKS = ("AKIA", "ASIA", "eyJ", "ghp_", "gho_", "sk_live_", "sk-", "xox")
NAMED = re.compile(rf"\b(?=[^\W\d_a-z])(?:{TITLES}|{KNOWN})\b")


def drawn(key: str, *parts: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permuted(key: str, tag: str, text: str, alphabet: str) -> str:
    """One-to-one on the words of this length over the alphabet: a Feistel network on numbers."""
    n, r = len(text), len(alphabet)
    if n == 0:
        return text
    value = 0
    for c in text:
        value = value * r + alphabet.index(c)
    if n == 1:
        return alphabet[(value + drawn(key, tag, "one")) % r]
    low = r ** (n // 2)
    high = r ** (n - n // 2)
    a, b, top = value // low, value % low, True
    for i in range(8):
        if top:
            a = (a + drawn(key, tag, n, i, b)) % high
        else:
            b = (b + drawn(key, tag, n, i, a)) % low
        top = not top
    value, out = a * low + b, []
    for _ in range(n):
        value, d = divmod(value, r)
        out.append(alphabet[d])
    return "".join(reversed(out))


def walked(step: Callable[[str], str], start: str, ok: Callable[[str], bool]) -> str:
    """step again until ok: one-to-one on the values that are ok, if step is on all."""
    x = step(start)
    if not ok(start):
        return x if not ok(x) else walked_outside(step, x, ok)
    while not ok(x):
        x = step(x)
    return x


def walked_outside(step: Callable[[str], str], x: str, ok: Callable[[str], bool]) -> str:
    while ok(x):
        x = step(x)
    return x


def by_class(key: str, tag: str, text: str) -> str:
    """Digits, small and capital letters each permuted among themselves in one word; the rest stays."""
    out = list(text)
    shape = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))
    for alphabet in (DIGITS, LOWER, UPPER):
        at = [i for i, c in enumerate(text) if c in alphabet]
        for i, c in zip(at, permuted(key, f"{tag}|{shape}|{alphabet[0]}", "".join(text[i] for i in at), alphabet), strict=True):
            out[i] = c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def put(text: str, digits: str) -> str:
    """text with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def issued(digits: str) -> bool:
    """By issuer: those of 3 to 6, and 2221 to 2720."""
    return digits[0] in "3456" or 2221 <= int(digits[:4]) <= 2720


def card(key: str, text: str) -> str:
    d = digits_of(text)
    body = d[0] + walked(lambda v: permuted(key, "card" + d[0], v, DIGITS), d[1:-1], lambda v: d[0] != "2" or issued(d[0] + v))
    return put(text, body + str((luhn(body) + int(d[-1]) - luhn(d[:-1])) % 10))


def ip(key: str, text: str) -> str:
    def kind(h: str) -> tuple:
        a, b = int(h[:2], 16), int(h[2:4], 16)
        return (a == 10, a == 172 and 16 <= b < 32, a == 192 and b == 168, a in (0, 127) or a >= 224)

    start = "".join(f"{int(x):02x}" for x in text.split("."))
    mine, step = kind(start), lambda h: permuted(key, "ip", h, HEX)
    if any(mine[:3]):  # private: the fixed part stays
        keep = 2 if mine[0] else 3 if mine[1] else 4
        h = start[:keep] + permuted(key, f"ip{keep}", start[keep:], HEX)
        return ".".join(str(int(h[i : i + 2], 16)) for i in range(0, 8, 2))
    h = step(start)
    while kind(h) != mine:
        h = step(h)
    return ".".join(str(int(h[i : i + 2], 16)) for i in range(0, 8, 2))


def phone(key: str, text: str) -> str:
    lead = re.match(r"\+\d{1,3}(?=[ .\-(])|\+\d|\(?0|(?:44|49|33|34|39)(?= \d{2,3} \d{3,4} \d{4}$)|", text)[0]
    rest = text[len(lead) :]
    d = digits_of(rest)
    if len(d) == 10 and lead in ("", "+1"):  # North American plan: area and exchange don't begin with 0 or 1; 555 stays
        fixed = d[3:6] == "555"
        tag = f"phone|{lead}|{fixed}"
        ok = lambda x: x[0] in "23456789" and (fixed or x[3] in "23456789")
        x = walked(lambda v: permuted(key, tag, v, DIGITS), d[:3] + d[6:] if fixed else d, ok)
        return lead + put(rest, x[:3] + "555" + x[3:] if fixed else x)
    return lead + put(rest, permuted(key, f"phone|{lead}|{len(d)}", d, DIGITS))


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban(key: str, text: str) -> str:
    plain = text.replace(" ", "")
    body = by_class(key, "iban" + plain[:2], plain[4:])
    valid = iban_number(plain[4:] + plain[:4]) % 97 == 1
    check = f"{98 - iban_number(body + plain[:2] + '00') % 97:02d}" if valid else plain[2:4]
    it = iter(plain[:2] + check + body)
    return "".join(c if c == " " else next(it) for c in text)


def email(key: str, text: str) -> str:
    local, host = text.rsplit("@", 1)
    reserved = re.search(r"(?i)(?:^|\.)example\.(?:com|org|net)$", host)
    cut = reserved.start() if reserved else host.rindex(".")
    new_host = by_class(key, "host", host[:cut]) + host[cut:]
    return by_class(key, "local|" + host, local) + "@" + new_host


def ssn(key: str, text: str) -> str:
    ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    return put(text, walked(lambda v: permuted(key, "ssn", v, DIGITS), digits_of(text), ok))


def script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def gender_of(title: str, given: str) -> str:
    titles = {t.rstrip(".") for t in title.split()}
    if titles.intersection(MALE_TITLES):
        return "m"
    if titles.intersection(FEMALE_TITLES):
        return "f"
    for g, names in (*((g, names) for (_, g), names in GIVEN.items()), *ALSO_GIVEN.items()):
        if given.capitalize() in names:
            return g
    return "m" if drawn("", given.casefold()) % 2 else "f"


def name_part(key: str, role: str, word: str, attempt: int) -> str:
    """role: given-m, given-f or surname. Case like the word's."""
    s, x = script(word), drawn(key, role, word.casefold(), attempt)
    if role == "surname" or attempt >= 3:
        parts = SYLLABLES[s]
        new = "".join(parts[(x >> 8 * k) % len(parts)] for k in range(3 + attempt)) + SURNAME_END[s][(x >> 80) % 4]
    else:
        pool = GIVEN[s, role[-1]]
        new = pool[x % len(pool)] if attempt == 0 else pool[x % len(pool)] + "-" + pool[(x >> 16) % len(pool)]
    return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:]


def name_roles(title: str, name: str) -> list[tuple[str, str]]:
    """(role, word) of each word: the last is the surname, those before it given names; particles before it stay, whatever their case."""
    words = name.split(" ")
    g = gender_of(title, words[0])
    return [("surname" if i == len(words) - 1 else "particle" if w.casefold() in PARTICLES else f"given-{g}", w) for i, w in enumerate(words)]


DAYS, FIRST_DAY = 43_829, datetime.date(1900, 1, 1)


def born(key: str, text: str) -> str:
    """Another day in the same form; a day that is none, or out of range, gets other digits."""
    form = "%Y-%m-%d" if "-" in text else "%d.%m.%Y" if "." in text else "%d/%m/%Y"
    try:
        day = (datetime.datetime.strptime(text, form).date() - FIRST_DAY).days
    except ValueError:
        day = -1
    if not 0 <= day < DAYS:
        return by_class(key, "born", text)
    new = FIRST_DAY + datetime.timedelta(int(walked(lambda v: permuted(key, "born", v, DIGITS), f"{day:05d}", lambda v: int(v) < DAYS)))
    return new.strftime(form)


def ipv6(key: str, text: str) -> str:
    """Its hexadecimal digits, in groups of the same length and case."""
    new = iter(permuted(key, "ipv6" + re.sub(r"\w", "x", text), re.sub(":", "", text.lower()), HEX))
    out = "".join(c if c == ":" else next(new) for c in text)
    return out.upper() if text != text.lower() else out


MAKE = {
    "email": email, "born": born, "ipv6": ipv6, "jwt": lambda k, t: "eyJ" + by_class(k, "jwt", t[3:]), "card": card, "ip": ip, "phone": phone, "iban": iban, "ssn": ssn,
    "aws": lambda k, t: t[:4] + (permuted(k, "aws", t[4:], BASE32) if all(c in BASE32 for c in t[4:]) else permuted(k, "aws36", t[4:], UPPER + DIGITS)),
    "hex": lambda k, t: permuted(k, "hex", t, HEX),
    "secret": lambda k, t: (p := re.match(r"ghp_|gho_|sk_live_|sk-|xox[bp]-", t)[0]) + by_class(k, "secret" + p, t[len(p) :]),
    "mac": lambda k, t: by_class(k, "mac", t) if t != t.lower() else ":".join((h := permuted(k, "mac", t.replace(":", ""), HEX))[i : i + 2] for i in range(0, 12, 2)),
}


def accepted(kind: str, text: str) -> bool:
    """Card numbers have 13 to 19 digits and begin like one, those with 2 also a valid check digit; IBANs have 15 to 34 signs."""
    if kind == "card":
        d = digits_of(text)
        return 13 <= len(d) <= 19 and issued(d) and (d[0] != "2" or luhn(d[:-1]) == int(d[-1]))
    if kind == "iban":
        return 15 <= len(text.replace(" ", "")) <= 34 and sum(c.isdigit() for c in text) >= 8
    if kind == "ipv6":
        try:
            return bool(ipaddress.IPv6Address(text)) and sum(c.isdigit() for c in text) >= 3
        except ValueError:
            return False
    if kind == "phone":
        return 7 <= len(digits_of(text)) <= 15
    return True


def finds(text: str, start: int, end: int):
    """(start, end, kind, value, title) of each find in a line; what is not accepted is searched again from its second sign."""
    while m := FIND.search(text, start, end):
        kind = next(k for k in KINDS if m[k] is not None)
        at, to = m.span(GROUP_OF[kind])
        if not accepted(kind, text[at:to]):  # a later kind may begin at the same place
            other = ((k, x.span(1)) for k in KINDS[KINDS.index(kind) + 1 :] if (x := ONE[k].match(text, m.start(), end)) and accepted(k, x[1]))
            kind, (at, to) = next(other, (kind, (at, 0)))
        if not to:
            start = m.start() + 1
            continue
        start = to
        kind = "name" if kind == "untitled" else kind
        if kind == "name" and text[to - 2 : to] in ("'s", "’s"):
            to -= 2
        yield at, to, kind, text[at:to], text[m.start() : at]


def mentions(text: str, found: list[tuple]):
    """Names of found where they stand without a title: whole, else the surname as a word with a capital."""
    titles: dict[str, str] = {}
    for *_, value, title in (x for x in found if x[2] == "name"):
        titles.setdefault(value.casefold(), title)
        titles.setdefault(value.split(" ")[-1].casefold(), title)
    if not titles:
        return
    names = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(titles, key=lambda n: (-len(n), n)))) + r")(?!\w)", re.IGNORECASE)
    at = 0
    for start, end in (*((x[0], x[1]) for x in found), (len(text), len(text))):
        for m in names.finditer(text, at, start):
            if all(w[0].isupper() for w in m[0].split(" ")) and m[0].casefold() in titles:
                yield m.start(), m.end(), "name", m[0], titles[m[0].casefold()]
        at = end


def entities(text: str | None):
    """(start, end, kind, value, title) of each find, whole text, left to right.

    No entity runs over a line's end, and each holds what HINT, MARKS or NAMED looks for, so that other lines are passed
    over loses none; but for mentions of the names found, which are searched everywhere."""
    found = []
    for line in LINE.finditer(text or ""):
        one = line[0]
        if HINT.search(one) or any(mark in one for mark in MARKS) or NAMED.search(one):
            found += finds(text, line.start(), line.end())
    yield from sorted([*found, *mentions(text or "", found)])


def pieces(kind: str, value: str, title: str) -> list[tuple[str, str]]:
    """(kind, value) of what is replaced as one: a name's words each but for particles, anything else whole."""
    return [x for x in name_roles(title, value) if x[0] != "particle"] if kind == "name" else [(kind, value)]


def canonical(kind: str, value: str) -> str:
    return value.casefold() if kind == "surname" or kind.startswith("given") else value


def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    if kind == "surname" or kind.startswith("given"):
        return name_part(key, kind, value, attempt)
    return MAKE[kind](key if not attempt else f"{key}#{attempt}", value)


def rewritten(text: str | None, key: str, again: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """(text with surrogates, number of entities); again: attempts of entities that collided."""
    if text is None:
        return None, 0
    out, at, n = [], 0, 0
    for start, end, kind, value, title in entities(text):
        parts = name_roles(title, value) if kind == "name" else [(kind, value)]
        new = " ".join(v if k == "particle" else surrogate(key, k, v, again.get((k, canonical(k, v)), 0)) for k, v in parts)
        out += [text[at:start], new]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def found_entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(text_hash, kind, value, surrogate), distinct within a text."""

    def run(batches):
        import pandas as pd

        forget()
        for pdf in batches:
            rows = set()
            for h, t in zip(pdf["h"], pdf["t"].array, strict=True):
                if isinstance(t, str):
                    for _, _, kind, value, title in entities(t):
                        rows.update((h, k, canonical(k, v), surrogate(key, k, v).casefold() if k != kind else surrogate(key, k, v)) for k, v in pieces(kind, value, title))
            yield as_objects(pd.DataFrame(list(rows), columns=["text_hash", "kind", "value", "surrogate"]).astype({"text_hash": "int64"}))

    return docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).mapInPandas(run, "text_hash long, kind string, value string, surrogate string")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of entities whose surrogate was another's; drawn anew until all differ."""
    def drawn_anew(kinds, values, attempts):
        import pandas as pd

        new = [surrogate(key, k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
        return pd.Series([x if k in MAKE else x.casefold() for k, x in zip(kinds, new, strict=True)], dtype=object)

    draw = F.pandas_udf(drawn_anew, "string", F.PandasUDFType.SCALAR)
    files = files_for(found.sparkSession, found.count())
    now = written(found.groupBy("kind", "value").agg(F.min("surrogate").alias("surrogate")).withColumn("attempt", F.lit(0)).coalesce(files), "entities")
    while True:
        least = now.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("attempt", "value")).alias("first")).where("c > 1")
        clash = now.join(least, ["kind", "surrogate"], "left")
        lost = F.col("first").isNotNull() & (F.struct("attempt", "value") != F.col("first"))
        nxt = written(clash.select("kind", "value", "surrogate", F.when(F.coalesce(lost, F.lit(False)), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.coalesce(lost, F.lit(False)).alias("lost")).coalesce(files), "entities")
        dropped(now)
        if nxt.where("lost").isEmpty():
            return nxt.where("attempt > 0").select("kind", "value", "attempt")
        now = written(nxt.select("kind", "value", F.when(F.col("lost"), draw("kind", "value", "attempt")).otherwise(F.col("surrogate")).alias("surrogate"), "attempt"), "entities")
        dropped(nxt)


def replace_pii(docs: DataFrame, *, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with text rewritten, and n_entities."""
    (c_n,) = fresh(docs, "n_entities")
    c_hash, c_again, c_out = fresh(docs, "text_hash", "again", "rewritten")
    found = written(found_entities(docs, key, text), "found")
    again = written(collisions(found, key), "again")

    def run(texts, more):
        import pandas as pd

        rows = []
        for t, a in zip(texts.array, more.array, strict=True):
            anew = {(x["kind"], x["value"]): x["attempt"] for x in a} if a is not None else {}
            rows.append(rewritten(t if isinstance(t, str) else None, key, anew))
        return pd.DataFrame({"text": pd.Series([r[0] for r in rows], dtype=object), "n": pd.Series([r[1] for r in rows], dtype="int64")})

    udf = F.pandas_udf(run, "text string, n long", F.PandasUDFType.SCALAR)
    if again.isEmpty():
        out = docs.withColumn(c_out, udf(F.col(text), F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>")))
    else:
        per = found.join(again, ["kind", "value"]).groupBy(F.col("text_hash").alias(c_hash)).agg(F.collect_set(F.struct("kind", "value", "attempt")).alias(c_again))
        out = docs.join(per, F.xxhash64(text) == F.col(c_hash), "left").withColumn(c_out, udf(F.col(text), F.col(c_again)))
    return out.select(*[F.col(f"{c_out}.text").alias(text) if c == text else F.col(c) for c in docs.columns], F.col(f"{c_out}.n").alias(c_n))


def op5_surrogates(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
