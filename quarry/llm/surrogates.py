"""Personal data: detected entities receive keyed surrogates of the same type and format.

An entity's normal form (the digits of a phone number, a lower-cased address, ...) is permuted by a keyed
Feistel network over the strings of its own format: digits stay digits, vowels vowels, upper case upper case,
each in its script; punctuation stays; card numbers keep their check-digit property, addresses and dates stay valid.
Equal entities therefore get equal surrogates everywhere (coreference), and different ones of a format get
different surrogates (distinctness).

Names are found after a title, or where a listed given name is followed by a capitalised word. A name's last word (with
its hyphenated parts) is a surname, the words ahead of it given names, and each is an entity of its own, whatever
title stands before it. So "Dr John Smith", "Mr Smith" and "Smith" keep agreeing with each other, while "Anna Smith"
shares the surname only. The words of a document's names are replaced wherever else they stand in that document,
in capitals too. Listed given names are exchanged along a keyed cycle through the list of their gender and
script; other names letter by letter.

Collision check: the distinct entities of the corpus are gathered with map-side aggregation; a surrogate that
equals an entity of the corpus, or its own original, or another surrogate, is drawn again with the next
attempt number until none is left. A format whose strings run out, or that has no exchangeable character, gets
wider: surrogates of it are one character longer with every further draw, so each entity settles. Each round writes
what it settled; only those few exceptions are joined back to their documents.

Letters of other scripts are exchanged among the letters of their case in their part of the code table. A secret
that is one mark over and over (``********``) is a mask, not a secret, and stays. Passport numbers, birth dates and
unformatted phone numbers are found by the word ahead of them.

Defined results: NULL and empty texts stay as they are. Whole texts are searched. NULL ids, repeated rows and
extra columns are kept unchanged (with ``counts``, columns named like a count are replaced). An empty table gives an
empty result.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name, materialise, prepare

# --- fixed values: titles and given names by gender and script --------------------------------
TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra",
          "Госпожа", "Dr", "Prof")
GIVEN = {
    ("m", "latin"): (
        "James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Andrew",
        "Paul", "Peter", "George", "Edward", "Brian", "Kevin", "Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Pierre", "Jean", "Michel",
        "François", "Antoine", "Carlos", "José", "Luis", "Miguel", "Pedro", "Marco", "Giovanni"),
    ("f", "latin"): (
        "Mary", "Anna", "Linda", "Barbara", "Susan", "Sarah", "Karen", "Laura", "Julia", "Emma", "Elizabeth", "Jennifer", "Patricia", "Nancy",
        "Margaret", "Lisa", "Emily", "Helen", "Ursula", "Monika", "Petra", "Sabine", "Claire", "Marie", "Sophie", "Isabelle", "Camille",
        "Carmen", "María", "Ana", "Lucía", "Elena", "Giulia", "Francesca"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Владимир", "Михаил", "Павел", "Олег", "Юрий"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Екатерина", "Юлия", "Людмила", "Галина"),
}
#: Interchangeable characters; a character outside all classes stays as it is.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áàâäãéèêëíìîïóòôöõúùûü", "ñçß", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "ÑÇ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_CLASS = {ch: c for c in CLASSES for ch in c}
#: Scripts with many letters of one kind: (first, last).
_WIDE_SCRIPTS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
#: Attempts from here on are drawn from wider formats.
WIDER = 1_000_000
#: Days from 1900-01-01 on that birth dates are exchanged in (up to 2029).
DAYS = 47_482


@lru_cache(maxsize=None)
def _part(block: int, category: str) -> str:
    chars = (chr(i) for i in range(block * 128, block * 128 + 128))
    return "".join(ch for ch in chars if unicodedata.category(ch) == category and ch not in _CLASS)


@lru_cache(maxsize=None)
def _script(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


def _class(ch: str) -> str | None:
    """The characters with which ``ch`` may be exchanged; None if it stays."""
    if ch in _CLASS:
        return _CLASS[ch]
    if not (ch.isalpha() or ch.isdecimal()):
        return None
    for first, last in _WIDE_SCRIPTS:
        if first <= ord(ch) <= last:
            return _script(first, last)
    part = _part(ord(ch) // 128, unicodedata.category(ch))
    return part if len(part) > 1 else None

_WORD = r"[^\W\d_]+"
_BIG = r"[^\W\d_a-zа-яα-ω]"
_ANY_WORD = re.compile(_WORD)
_TITLE = "|".join(TITLES)
_NAMED = "|".join(n for names in GIVEN.values() for n in names)
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<key>(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)|(?<![\w.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.\w))"
    r"|(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?P<sep>[:-])(?:[0-9A-Fa-f]{2}(?P=sep)){4}[0-9A-Fa-f]{2}(?![\w:-]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{6,39}(?![\w:.]))"
    r"|(?<![A-Za-z])(?i:passport)(?i:[ ]+(?:no|nr|number)\.?)?[ \t]*[:#]?[ \t]*(?P<passport>(?=[A-Z0-9]*[0-9])[A-Z0-9]{6,9})(?!\w)"
    r"|(?<![A-Za-z])(?i:born(?:[ ]+on)?|date of birth|birthday|birthdate|d\.?o\.?b\.?)[ \t]*[:=]?[ \t]*"
    r"(?P<birth>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<slash>[/.-])[0-9]{1,2}(?P=slash)[0-9]{4})(?!\w)"
    r"|(?<![A-Za-z])(?i:tel|phone|telephone|mobile|fax)\.?[ \t]*[:#]?[ \t]*(?P<told>\+?[0-9][0-9 ]{5,16}[0-9])(?![\w-])"
    r"|(?P<national>(?<![\w.+-])0[0-9]{2,4}[ ][0-9]{3,4}[ ][0-9]{3,4}(?!\w))"
    rf"|(?<!\w)(?:{_TITLE})\.?[ ](?P<name>(?-i:{_BIG}){_WORD}(?:[ -](?-i:{_BIG}){_WORD}){{0,2}})"
    rf"|(?<!\w)(?=[^\W\d_a-zа-я])(?P<plain>(?:{_NAMED})(?:[ -](?-i:{_BIG})[^\W\d_]*[a-zа-яà-ÿ][^\W\d_]*){{1,3}})(?!\w)")
KINDS = ("email", "secret", "key", "iban", "phone", "ssn", "card", "ip", "mac", "passport", "birth", "name")
_GROUPS = ("email", "secret", "key", "iban", "phone", "ssn", "card", "ip", "mac", "ip6", "passport", "birth", "told", "national", "name", "plain")
_AS = {"ip6": "ip", "told": "phone", "national": "phone", "plain": "name"}
_MAY_HOLD = re.compile(rf"[0-9@=:]|(?<!\w)(?:{_TITLE}|(?=[^\W\d_a-zа-я])(?:{_NAMED}))(?!\w)")


def entities(text: str | None) -> Iterator[tuple[str, str, int, int]]:
    """(kind, normal form, begin, end) of every entity, left to right; a name's words are kinds given and surname."""
    if not text or not _MAY_HOLD.search(text):
        return
    found: list[tuple[str, str, int, int]] = []
    words: dict[str, tuple[str, str]] = {}
    for m in PATTERN.finditer(text):
        group = next(g for g in _GROUPS if m[g] is not None)
        kind, (a, b) = _AS.get(group, group), m.span(group)
        if kind == "name":
            for part in _name_parts(text, a, b):
                words[part[1]] = part[:2]
                found.append(part)
        elif (form := normal(kind, m[group])) is not None:
            found.append((kind, form, a, b))
    if words:
        words |= {w.upper(): e for w, e in words.items() if len(w) > 1 and w.upper() not in words}
        taken = [(a, b) for _, _, a, b in found]
        k = 0
        for m in _ANY_WORD.finditer(text):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if m[0] in words and not (k < len(taken) and taken[k][0] < b):
                found.append((*words[m[0]], a, b))
        found.sort(key=lambda e: e[2])
    yield from found


def _name_parts(text: str, a: int, b: int) -> Iterator[tuple[str, str, int, int]]:
    """The words of a name: its last one, with hyphenated parts, are surnames, the others given names."""
    last = a + text[a:b].rfind(" ") + 1
    for m in _ANY_WORD.finditer(text, a, b):
        yield "surname" if m.start() >= last else "given", m[0], *m.span()


def normal(kind: str, s: str) -> str | None:
    """The form in which mentions of one entity agree; None if it is no such entity after all."""
    if kind == "secret":
        return None if len(set(s)) == 1 and not s[0].isalnum() else s
    if kind == "email":
        return s.lower()
    if kind in ("phone", "ssn", "card"):
        return re.sub(r"[^0-9]", "", s)
    if kind == "iban":
        return s.replace(" ", "")
    if kind == "mac":
        return re.sub("[:-]", "", s).lower()
    if kind == "birth":
        return (d := _date(s)) and d[0].isoformat()
    if kind == "ip" and ":" in s:
        try:
            return ipaddress.IPv6Address(s).exploded
        except ValueError:
            return None
    return s


def _date(s: str) -> tuple[datetime.date, str] | None:
    """A date and the order it is written in (ymd; dmy, or mdy where only that is one)."""
    x = [int(n) for n in re.split("[/.-]", s)]
    for order, (y, m, d) in (("ymd", (0, 1, 2)),) if len(s.split("-")[0]) == 4 else (("dmy", (2, 1, 0)), ("mdy", (2, 0, 1))):
        try:
            return datetime.date(x[y], x[m], x[d]), order
        except ValueError:
            continue
    return None


class Permutation:
    """Keyed permutation of [0, n): a Feistel network over the next even power of two, walked until it lands inside."""

    def __init__(self, key: bytes):
        self.key = key

    def apply(self, n: int, x: int, tweak: str) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        mask, tw = (1 << half) - 1, tweak.encode()
        while True:
            left, right = x >> half, x & mask
            for r in range(10):
                h = hashlib.blake2b(right.to_bytes((half + 7) // 8, "big") + tw, key=self.key, digest_size=max(8, (half + 7) // 8), salt=bytes([r]))
                left, right = right, left ^ (int.from_bytes(h.digest(), "big") & mask)
            x = left << half | right
            if x < n:
                return x

    def string(self, s: str, tweak: str) -> str:
        """Permute the characters of ``s`` inside their classes, as one number in mixed radix."""
        classes = [_class(ch) for ch in s]
        n = x = 0
        size = 1
        for ch, c in zip(s, classes):
            if c:
                x, size = x * len(c) + c.index(ch), size * len(c)
        shape = "".join(c[0] if c else ch for ch, c in zip(s, classes))
        n = self.apply(size, x, f"{tweak}|{shape}")
        out = []
        for ch, c in zip(reversed(s), reversed(classes)):
            if c:
                n, i = divmod(n, len(c))
                ch = c[i]
            out.append(ch)
        return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def surrogate_form(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The surrogate of a normal form, in normal form."""
    p, tweak = Permutation(key), f"{kind}|{attempt}"
    more = attempt - WIDER + 1 if attempt >= WIDER else 0
    if kind in ("secret", "given", "surname") and not any(map(_class, form)):
        more = attempt + 1  # nothing to exchange
    if kind == "given" and (listed := _given(key, form)):
        return listed
    if more:
        return _wider(key, kind, form, tweak, more)
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        body, tld = domain.rsplit(".", 1)
        return f"{p.string(local, tweak)}@{p.string(body, f'domain|{attempt}')}.{tld}"
    if kind == "ip" and ":" in form:  # the network's first 32 bits stay
        x = int(ipaddress.IPv6Address(form))
        return ipaddress.IPv6Address(x >> 96 << 96 | p.apply(1 << 96, x & (1 << 96) - 1, f"{tweak}|{x >> 96}")).exploded
    if kind == "ip":
        a = [int(x) for x in form.split(".")]
        x = p.apply(1 << 32, int.from_bytes(bytes(a), "big"), tweak)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        shift = (int(form[-1]) - _luhn(form[:-1])) % 10
        body = form[0] + p.string(form[1:-1], tweak)
        return body + str((_luhn(body) + shift) % 10)
    if kind in ("phone", "iban"):
        keep = len(form) - 10 if kind == "phone" and len(form) > 10 else 2 if kind == "iban" else 0
        return form[:keep] + p.string(form[keep:], f"{tweak}|{form[:keep]}")
    if kind == "key":
        return form[:4] + p.string(form[4:], tweak)
    if kind == "mac":  # the maker's half stays
        return form[:6] + f"{p.apply(1 << 24, int(form[6:], 16), f'{tweak}|{form[:6]}'):06x}"
    if kind == "birth":
        first = datetime.date(1900, 1, 1).toordinal()
        day = datetime.date.fromisoformat(form).toordinal()
        if not 0 <= day - first < DAYS:  # other centuries: among the days of their own
            first = datetime.date(day and datetime.date.fromordinal(day).year // 100 * 100 or 1, 1, 1).toordinal()
            return datetime.date.fromordinal(first + p.apply(36_524, min(day - first, 36_523), f"{tweak}|{first}")).isoformat()
        return datetime.date.fromordinal(first + p.apply(DAYS, day - first, tweak)).isoformat()
    return p.string(form, tweak)


def _wider(key: bytes, kind: str, form: str, tweak: str, more: int) -> str:
    """A surrogate with ``more`` characters than the format of ``form``; again one for each form."""
    p = Permutation(key)
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        body, tld = domain.rsplit(".", 1)
        return f"{p.string(local + 'b' * more, tweak)}@{p.string(body, f'domain|{tweak}')}.{tld}"
    if kind == "card":
        shift = (int(form[-1]) - _luhn(form[:-1])) % 10
        body = form[0] + p.string(form[1:-1] + "0" * more, tweak)
        return body + str((_luhn(body) + shift) % 10)
    if kind in ("given", "surname"):
        last = next((ch for ch in reversed(form) if _class(ch)), "b")
        return p.string(form + (last if last.islower() or last.lower() == last.upper() else "b") * more, tweak)
    if kind in ("iban", "key"):
        keep = 2 if kind == "iban" else 4
        return form[:keep] + p.string(form[keep:] + "0" * more, f"{tweak}|{form[:keep]}")
    return p.string(form + ("b" if kind == "secret" else "0") * more, tweak)


@lru_cache(maxsize=8)
def _cycles(key: bytes) -> dict[str, str]:
    """Each listed given name's successor in the keyed order of its list: never itself, never another name's."""
    out = {}
    for (gender, script), names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.blake2b(f"{gender}|{script}|{n}".encode(), key=key[:64]).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _given(key: bytes, name: str) -> str | None:
    """Another given name of the same gender and script; None for a name in no list."""
    return _cycles(key).get(name)


def render(kind: str, mention: str, form: str) -> str:
    """``form`` written in the format of ``mention``."""
    if kind in ("phone", "ssn", "card", "iban", "mac"):
        rest = iter(form)
        out = "".join(next(rest) if ch.isalnum() else ch for ch in mention) + "".join(rest)
        return out.upper() if kind == "mac" and mention != mention.lower() else out
    if kind in ("given", "surname") and len(mention) > 1 and mention == mention.upper() != mention.lower():
        return form.upper()
    if kind == "ip" and ":" in form:
        out = form if len(mention) == 39 else ipaddress.IPv6Address(form).compressed
        return out.upper() if mention != mention.lower() else out
    if kind == "birth":
        d, (_, order) = datetime.date.fromisoformat(form), _date(mention)
        mark = next(ch for ch in mention if not ch.isdigit())
        width = 2 if mention[0] == "0" or order == "ymd" or mention[1:2].isdigit() else 1
        return mark.join(str(getattr(d, {"y": "year", "m": "month", "d": "day"}[c])).zfill(width) for c in order)
    if kind == "email" and mention != mention.lower():
        return "".join(f.upper() if m.isupper() else f for m, f in zip(mention, form)) + form[len(mention):]
    return form


@lru_cache(maxsize=100_000)
def _known(key: bytes, kind: str, form: str, attempt: int) -> str:
    return surrogate_form(key, kind, form, attempt)


def replace_all(key: bytes, text: str | None, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[int]]:
    """The text with surrogates, and the number of entities per kind (the words of one name count once)."""
    counts = [0] * len(KINDS)
    out, at, named = [], 0, -2
    for kind, form, a, b in entities(text):
        new = _known(key, kind, form, attempts.get((kind, form), 0))
        out += [text[at:a], render(kind, text[a:b], new)]
        at = b
        if kind not in ("given", "surname"):
            counts[KINDS.index(kind)] += 1
            continue
        counts[KINDS.index("name")] += not (a == named + 1 and text[named] in " -")
        named = b
    return ("".join([*out, text[at:]]) if out else text), counts


def resolve(found: DataFrame, key: bytes, most: int = 50) -> DataFrame:
    """(kind, form, attempt): the entities of ``found(kind, form)`` whose first surrogate collides.

    Distinct entities only; each round re-draws the colliding ones against all originals and all surrogates. From
    the ``most``-th draw on formats get wider: every further round has more strings, so the rounds come to an end.
    """
    @F.pandas_udf("string")
    def draw(kind: pd.Series, form: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate_form(key, k, f, a) for k, f, a in zip(kind, form, attempt)])

    listed = [n for names in GIVEN.values() for n in names]
    free = ~((F.col("kind") == "given") & F.col("form").isin(listed))  # exchanged inside their list
    distinct = materialise(found.distinct(), "pii-entities")
    spark = distinct.sparkSession
    taken = distinct.where(free).select("kind", F.col("form").alias("new")).unionByName(
        spark.createDataFrame([("given", n) for n in listed], "kind string, new string"))
    now = distinct.where(free).withColumn("attempt", F.lit(0)).withColumn("new", draw("kind", "form", F.lit(0)))
    settled: list[DataFrame] = []
    for draws in itertools.count(1):
        now = materialise(now, "pii-drawn")
        # the first of equal surrogates keeps it; those that settled earlier come first
        first = now.groupBy("kind", "new").agg(F.min("form").alias("first"))
        judged = now.join(first, ["kind", "new"]).join(taken.select("kind", "new", F.lit(True).alias("taken")).distinct(), ["kind", "new"], "left")
        judged = judged.withColumn("bad", F.col("taken").isNotNull() | (F.col("form") != F.col("first")))
        again = judged.where("bad").select("kind", "form")
        if draws > 1:
            settled.append(materialise(judged.where("NOT bad").select("kind", "form", "attempt"), "pii-settled"))
        if again.isEmpty():
            return functools.reduce(DataFrame.unionByName, settled) if settled else now.where("attempt > 0").select("kind", "form", "attempt")
        taken = taken.unionByName(judged.where("NOT bad").select("kind", "new"))
        attempt = draws if draws < most else WIDER + draws - most
        now = again.withColumn("attempt", F.lit(attempt)).withColumn("new", draw("kind", "form", F.lit(attempt)))


def replace_entities(df: DataFrame, key: bytes, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with surrogates in ``text_col``; with ``counts``, one ``n_<kind>`` column per kind as well."""
    prepare(df.sparkSession)

    @F.pandas_udf("array<struct<kind:string,form:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({(k, f) for k, f, _, _ in entities(t)}) or None for t in texts])

    fields = "text string, " + ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(fields)
    def rewrite(texts: pd.Series, odd: pd.Series) -> pd.DataFrame:
        rows = []
        for t, o in zip(texts, odd):
            known = {} if o is None else {(x["kind"], x["form"]): int(x["attempt"]) for x in o}
            new, n = replace_all(key, t, known)
            rows.append((new, *n))
        return pd.DataFrame(rows, columns=["text", *[f"n_{k}" for k in KINDS]])

    found = df.select(F.explode(find(F.col(text_col))).alias("e")).select("e.kind", "e.form")
    exceptions = materialise(resolve(found, key), "pii-exceptions")
    c, odd = free_name(df, "__new"), free_name(df, "__odd")
    if exceptions.isEmpty():
        res = df.withColumn(odd, F.lit(None).cast("array<struct<kind:string,form:string,attempt:int>>"))
    else:
        # rows are numbered, the exceptions of each row gathered (few per row), and joined back by number
        no = free_name(df, "__no")
        numbered = materialise(df.withColumn(no, F.monotonically_increasing_id()), "pii-numbered")
        mine = numbered.select(no, F.explode(find(F.col(text_col))).alias("e")).select(no, "e.kind", "e.form")
        mine = mine.join(exceptions, ["kind", "form"]).groupBy(no).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(odd))
        res = numbered.join(mine, no, "left").drop(no)
    res = res.withColumn(c, rewrite(F.col(text_col), F.col(odd)))
    named = {f"n_{k}" for k in KINDS} if counts else set()
    keep = [F.col(c)["text"].alias(x) if x == text_col else F.col(f"`{x}`") for x in df.columns if x.lower() not in named]
    return res.select(*keep, *([F.col(c)[f"n_{k}"].alias(f"n_{k}") for k in KINDS] if counts else []))
