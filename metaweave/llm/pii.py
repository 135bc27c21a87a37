"""Personal data replaced by keyed, type-consistent surrogates.

Entities: e-mail addresses in any script, phone numbers, card numbers, IBANs, US social
security numbers, IPv4 and IPv6 addresses, and names. A name starts after a title or with a
known given name and takes all capitalised parts that follow in its line, with particles,
initials and apostrophes; in capitals throughout, or small throughout after a title, it takes
further given names and one part more. Wherever a part of a name found in a document occurs
in that document again, it is replaced too: capitalised, and in small letters if the name was
found so. Names that follow neither a title nor a known given name aren't found.

A surrogate depends on the key, the entity and an attempt number only, so an entity gets the
same surrogate wherever it occurs, in the same format: separators and digit counts stay, a
valid card number or IBAN stays valid, a private address stays private, letters keep their
script and case. Spellings of one number with other separators are one entity. A name is made
of its parts: a known given name becomes another of its gender and script, by a keyed
permutation of the list; every other part becomes an invented word of its script. So "Dr.
Smith" and "John Smith" keep one family name, and mails at one host keep one host. Forms of
one family name for men and women are one entity, and their surrogates have the same endings.

Numbers and addresses are mapped by a keyed permutation of all values of their format. What
can still meet (two words or mails drawing the same, or a surrogate that is itself an entity
of the corpus) is checked over the table of all distinct entities: of those that meet, the
one with the fewest attempts and then the smallest keeps its surrogate, the others and those
that hit a real entity try again. From the third attempt on the format grows by a letter or
digit an attempt, so a format that is full ends too; after ``ROUNDS`` an entity gets a word
from 128 bits of the key's hash. Entities with a later attempt reach their texts by a join on
the place of the row; nothing is collected on the driver.

Defined cases: null text stays null; empty text stays empty; entities repeat freely within
and across rows; repeated rows give repeated rows; offsets count characters of the original
text; overlapping candidates go to the first that starts, then to the order e-mail, IBAN,
card, IPv6, IPv4, SSN, phone, name; extra columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaweave.llm.common import FEW_ROWS, LOCATOR, slices, with_locator
from metaweave.plans.scratch import cut, release

#: Attempts after which a surrogate no longer follows the format.
ROUNDS = 16

# Given names by gender and script, and titles by gender.
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Sophie Emma Clara Elena Lucia Marta Claire Camille Alice Sarah Emily Grace Olivia Nora Ingrid Paula".split(),
    ("m", "latin"): "Peter Thomas Paul Daniel David Martin Lucas Hugo Louis Carlos Diego Pablo James John Robert Oliver Henrik Stefan Felix Marco".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Олег Виктор".split(),
    ("f", "greek"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Γεωργία Ειρήνη Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Ανδρέας Πέτρος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Sra Госпожа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(),
    "": "Dr Prof".split(),
}
# Syllables of invented family names.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то".split(),
    "greek": "βα βε βο δα δε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το".split(),
}

# Particles within names, which stay, and endings of family names (for women, for men; case-folded).
PARTICLES = "von van der den de del della di da dos das du la le ter ten zu zur bin ibn al el y e".split()
ENDINGS = [
    ("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"),
    ("ova", "ov"), ("eva", "ev"), ("ska", "ski"), ("ου", "οσ"), ("η", "ησ"),
]

# Small letters that invented words and mails of other scripts are drawn from.
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "thai": "กขคงจฉชซดตถทธนบปผพฟมยรลวสหอ",
    "hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "hangul": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호",
    "cjk": "一丁七三上下不世中丹主久之九也了二五井人今介仁代以仲任伊休会伯位住佐何作佳依信修倉",
}

_GENDER = {name.casefold(): key for key, names in GIVEN.items() for name in names}
_TITLE_GENDER = {t: g for g, names in TITLES.items() for t in names}

_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?P<gap>[ ]?)[A-Z0-9]{4}(?:(?P=gap)[A-Z0-9]{4}){1,6}(?:(?P=gap)[A-Z0-9]{1,3})?(?!\w)")
_NUMBERS = re.compile(
    r"(?P<card>(?<![\d.+-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\d.]*\d))"
    r"|(?P<ipv6>(?<![\w:.])(?=[a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\w:]))"
    rf"|(?P<ip>(?<![\d.]){_BYTE}(?:\.{_BYTE}){{3}}(?!\.?\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{9,14}(?!\d)"
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?|\(?0\d{1,4}\)?)[ ./-]\d{5,8}(?!\d)"  # area code and number
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]\d|0\d)(?:[ .-]\d{2}){4}(?!\d)"  # pairs
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){3,4}(?!\d))"
)
_EMAIL = re.compile(r"[\w.%+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}")
def _any(words: Iterable[str]) -> str:
    return f"(?:{'|'.join(sorted(words, key=len, reverse=True))})"


_SMALL = "a-zß-öø-ÿа-яёα-ωά-ώ"
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
_CAPITAL = rf"[^\W\d_{_SMALL}]"
_GAP = r"[ \t\u00a0]+"
_MARK = r"(?:[^\W\d_]['’])?"
_TITLE = _any(_TITLE_GENDER)
_PROPER = rf"(?!{_TITLE}\b){_MARK}{_CAPITAL}{_LETTER}+(?:-{_LETTER}+)*"
_LOUD = rf"{_MARK}{_CAPITAL}{{2,}}(?:-{_CAPITAL}+)*(?!{_LETTER})"
_QUIET = rf"{_MARK}{_LETTER}{{2,}}(?:-{_LETTER}+)*"


_NAMES = [n for names in GIVEN.values() for n in names]
_LINK = rf"{_GAP}(?:{_CAPITAL}\.{_GAP})*(?:{_any(PARTICLES)}{_GAP})*"
_RUN = rf"(?:{_any(PARTICLES)}{_GAP})*{_PROPER}(?:{_LINK}{_PROPER})*"
_LOUD_REST = rf"(?:{_any(n.upper() for n in _NAMES)}{_GAP})*(?:{_any(p.upper() for p in PARTICLES)}{_GAP})*{_LOUD}"
_QUIET_NAME = rf"(?:{_any(n.lower() for n in _NAMES)}{_GAP})+(?:{_any(PARTICLES)}{_GAP})*{_QUIET}"
_TITLED = re.compile(rf"\b{_TITLE}\.?{_GAP}(?:{_TITLE}\.?{_GAP})*(?:{_CAPITAL}\.{_GAP})*(?P<name>{_RUN}|{_QUIET_NAME})")
_LOUD_TITLED = re.compile(rf"\b{_any(t.upper() for t in _TITLE_GENDER)}\.{_GAP}(?P<name>{_LOUD_REST})")
_GIVEN = re.compile(rf"\b(?P<name>{_any(_NAMES)}(?:{_LINK}{_PROPER})+)")
_LOUD_GIVEN = re.compile(rf"\b(?P<name>{_any(n.upper() for n in _NAMES)}{_GAP}{_LOUD_REST})")
_CAPITALS = re.compile(rf"{_CAPITAL}\w+")
_STARTS = {form for n in [*_NAMES, *_TITLE_GENDER] for form in (n, n.upper())}
_PART = re.compile(rf"{_LETTER}{{2,}}")
_ORDER = {kind: i for i, kind in enumerate("email iban card ipv6 ip ssn phone name given".split())}


def find(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, mention)`` of what is replaced, in order, not overlapping."""
    found = []
    if "@" in text:
        found += [(*m.span(), "email", m[0]) for m in _EMAIL.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += [(*m.span(), m.lastgroup if m.lastgroup != "sep" else "card", m[0]) for m in _NUMBERS.finditer(text)]
        found += [(*m.span(), "iban", m[0]) for m in _IBAN.finditer(text) if m["gap"] or _iban_valid(m[0])]
    if not _STARTS.isdisjoint(_CAPITALS.findall(text)):
        names = [(*m.span("name"), "name", m["name"]) for p in (_TITLED, _GIVEN, _LOUD_TITLED, _LOUD_GIVEN) for m in p.finditer(text)]
        found += names + (_again(text, names) if names else [])
    found.sort(key=lambda x: (x[0], _ORDER[x[2]], -x[1]))
    out, free = [], 0
    for x in found:
        if x[0] >= free:
            out.append(x)
            free = x[1]
    return out


def _parts(name: str) -> list[tuple[int, int, str]]:
    """``(start, end, role)`` of the words of a name; the role is given, family or particle.

    A known given name is one unless it ends the name.
    """
    spans = [m.span() for m in _PART.finditer(name)]
    out = []
    for i, (a, b) in enumerate(spans):
        word = name[a:b].casefold()
        last = i == len(spans) - 1
        out.append((a, b, "family" if last else "given" if word in _GENDER else "particle" if word in PARTICLES else "family"))
    return out


def _plain(text: str) -> str:
    """Composed small letters without stress marks."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).replace("\u0301", ""))
    return text.casefold()


def _family(word: str) -> str:
    """The id of a family name: plain letters, with the ending for men."""
    word = _plain(word)
    for women, men in ENDINGS:
        if word.endswith(women) and len(word) > len(women) + 2:
            return word[: -len(women)] + men
    return word


def _men(word: str) -> str:
    """The ending for men that the id of a family name has."""
    return next((men for _, men in ENDINGS if word.endswith(men) and len(word) > len(men) + 2), "")


def _again(text: str, names: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Every mention of a single part of the names found in this text."""
    role, quiet = {}, set()
    for *_, name in names:
        for a, b, kind in _parts(name):
            if kind == "particle":
                continue
            word = _family(name[a:b]) if kind == "family" else name[a:b].casefold()
            role[word] = "name" if kind == "family" or role.get(word) == "name" else "given"
            if name[a:b].islower():
                quiet.add(word)
    whole, held = _plain(text), _plain(" ".join(n for *_, n in names))
    stems = [_plain(w.removesuffix(_men(w))) for w in role]
    if all(whole.count(stem) <= held.count(stem) for stem in stems):
        return []
    out = []
    for m in _PART.finditer(text):
        word = m[0].casefold()
        kind = role.get(word)
        if kind is None:
            word = _family(word)
            kind = "name" if role.get(word) == "name" else None
        if kind and (not m[0].islower() or word in quiet):
            out.append((*m.span(), kind, m[0]))
    return out


def identities(kind: str, mention: str) -> list[tuple[str, str]]:
    """``(type, id)`` of the entities that a mention is made of; the same for every spelling."""
    if kind == "name":
        return [("word", _family(mention[a:b])) for a, b, role in _parts(mention) if role == "family"]
    if kind == "given":
        return []
    if kind in ("email", "ipv6"):
        return [(kind, mention.casefold())]
    if kind == "ip":
        return [(kind, mention)]
    return [(kind, re.sub(r"[^\w+]", "", mention))]


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode(), key=key, digest_size=16).digest())


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network, walked until in range."""
    if size < 2:
        return x
    half = (max(size - 1, 3).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(6):
            left, right = right, left ^ (_prf(key, tweak, i, right) & mask)
        x = left << half | right
        if x < size:
            return x


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _iban_valid(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _grown(attempt: int) -> int:
    """By how many letters or digits the format grows."""
    return max(0, attempt - 1)


def _script(c: str) -> str:
    name = unicodedata.name(c, "latin").split()[0].split("-")[0].lower()
    return name if name in LETTERS else "latin"


def _draw(like: str, key: bytes, *parts) -> str:
    """A string with the letters of each script, digits and marks in the places of ``like``."""
    out, seed = [], _prf(key, *parts)
    for c in like:
        pool = LETTERS[_script(c)] if c.isalpha() else "0123456789" if c.isdigit() else c
        seed, i = divmod(seed, len(pool))
        out.append(pool[i])
        seed = seed or _prf(key, "more", *parts, len(out))
    return "".join(out)


def _digits_of(digits: str, key: bytes, tweak: str, attempt: int) -> str:
    more = _grown(attempt)
    n = len(digits) + more
    return f"{permute(int(digits) * 10**more, 10**n, key, f'{tweak}{n}#{attempt}'):0{n}d}"


def _check_digit(body: str) -> int:
    return next(d for d in range(10) if _luhn(f"{body}{d}"))


def _card(digits: str, key: bytes, attempt: int) -> str:
    """A permutation of what precedes the check digit, and of how far that digit is off, if it is."""
    body, off = digits[:-1], (int(digits[-1]) - _check_digit(digits[:-1])) % 10
    more = _grown(attempt)
    n, start = len(body) + more, int(body) * 10**more
    tweak = f"card{n}#{attempt}"
    if off:
        start, step = divmod(permute(start * 9 + off - 1, 9 * 10**n, key, f"{tweak}off"), 9)
        off = step + 1
    else:
        start = permute(start, 10**n, key, tweak)
    body = f"{start:0{n}d}"
    return f"{body}{(_check_digit(body) + off) % 10}"


def _ip_kind(x: int) -> int:
    if x >> 24 == 10 or x >> 20 == 0xAC1 or x >> 16 == 0xC0A8:
        return 1
    return 2 if x >> 24 in (0, 127) or x >> 28 >= 0xE else 0


def _ip(entity: str, key: bytes, attempt: int) -> str:
    x = int.from_bytes(bytes(map(int, entity.split("."))))
    kind = _ip_kind(x)
    while True:
        x = permute(x, 1 << 32, key, f"ip#{attempt}")
        if _ip_kind(x) == kind or attempt > 2:  # a kind may be full
            return ".".join(map(str, x.to_bytes(4)))


def _ipv6(entity: str, key: bytes, attempt: int) -> str:
    """Other hexadecimal digits in the same places; the leading group of special ranges stays."""
    first, _, rest = entity.partition(":")
    keep = first if first[:2] in ("fe", "fc", "fd", "ff") else ""
    x = _prf(key, "ipv6", entity, attempt)
    out = []
    for c in entity[len(keep) :]:
        if c == ":":
            out.append(c)
        else:
            x, i = divmod(x, 15)
            out.append("123456789abcdef"[i])
    return keep + "".join(out)


def _iban(entity: str, key: bytes, attempt: int) -> str:
    like = entity[4:] + "0" * min(_grown(attempt), 34 - len(entity))
    body = _draw(like.replace("A", "a"), key, "iban", entity, attempt).upper()
    check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
    if not _iban_valid(entity):
        check = (check + 1) % 97
    return f"{entity[:2]}{check:02d}{body}"


def _email(entity: str, key: bytes, attempt: int) -> str:
    local, _, host = entity.rpartition("@")
    name, _, top = host.rpartition(".")
    more = LETTERS[_script(next((c for c in local if c.isalpha()), "a"))][0] * _grown(attempt)
    return f"{_draw(local + more, key, 'mail', entity, attempt)}@{_draw(name, key, 'host', host, max(0, attempt - 4))}.{top}"


def _word(entity: str, key: bytes, attempt: int) -> str:
    """An invented word of the script, of four syllables or six letters, and more when it grows."""
    script = _script(entity[0])
    parts = SYLLABLES.get(script) or list(LETTERS[script])
    x, out = _prf(key, "word", entity, attempt), ""
    for _ in range((4 if script in SYLLABLES else 6) + _grown(attempt)):
        x, i = divmod(x, len(parts))
        out += parts[i]
    return out + _men(entity)


def surrogate(kind: str, ident: str, key: bytes, attempt: int = 0) -> str:
    """What stands for an entity, in the form of its id."""
    if attempt >= ROUNDS:
        last = "".join(SYLLABLES["latin"][i % 42] for i in _prf(key, kind, ident, attempt).to_bytes(16))
        return last if kind == "word" else f"{last}@{last}.invalid" if kind == "email" else str(_prf(key, kind, ident, attempt))
    if kind in ("phone", "ssn"):
        code = ident[:2] if ident[0] == "+" else ""  # the zone of the country stays
        return code + _digits_of(ident[len(code) :], key, kind + code, attempt)
    return {"email": _email, "word": _word, "card": _card, "ip": _ip, "ipv6": _ipv6, "iban": _iban}[kind](ident, key, attempt)


@lru_cache(maxsize=64)
def _other_given(gender: str, script: str, key: bytes) -> dict[str, str]:
    """A keyed ring of the given names of a gender and script: nobody keeps their name."""
    names = sorted(GIVEN[gender, script], key=lambda n: _prf(key, "given", n))
    return {n.casefold(): m for n, m in zip(names, names[1:] + names[:1])}


def _given(mention: str, key: bytes) -> str:
    return _cased(_other_given(*_GENDER[mention.casefold()], key)[mention.casefold()], mention)


def _like(out: str, mention: str) -> str:
    """The form for women of ``out`` where the mention has it."""
    word = _plain(mention)
    if _family(word) != word:
        for women, men in ENDINGS:
            if word.endswith(women) and out.endswith(men):
                return out[: -len(men)] + women
    return f"{out[:-1]}ς" if out.endswith("σ") else out


def _shaped(out: str, mention: str) -> str:
    """``out`` with the separators of the mention; digits beyond its length follow."""
    it = iter(out)
    text = "".join(next(it, "") if c.isalnum() or c == "+" else c for c in mention)
    return text + "".join(it)


def _cased(out: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return out.upper()
    return out.capitalize() if like[:1].isupper() else out.lower()


def replacement(kind: str, mention: str, key: bytes, attempts: dict[tuple[str, str], int]) -> str:
    """The text that stands for a mention; ``attempts`` has entities with a later attempt than 0."""
    draw = lambda k, i: surrogate(k, i, key, attempts.get((k, i), 0))
    if kind == "name":
        out, at = "", 0
        for a, b, role in _parts(mention):
            put = mention[a:b]
            if role == "family":
                put = _cased(_like(draw("word", _family(put)), put), put)
            elif role == "given":
                put = _given(put, key)
            out, at = out + mention[at:a] + put, b
        return out + mention[at:]
    if kind == "given":
        return _given(mention, key)
    (k, ident), = identities(kind, mention)
    out = draw(k, ident)
    if kind == "email":
        return "".join(o.upper() if e.isupper() else o for o, e in zip(out, mention)) + out[len(mention) :]
    if kind in ("ip", "ipv6"):
        return out.upper() if mention.upper() == mention and kind == "ipv6" else out
    return _shaped(out, mention)


_MENTIONS = "_dedup_file string, _dedup_row bigint, kind string, id string"


def mentions(docs: DataFrame) -> DataFrame:
    """``LOCATOR, kind, id``: the distinct entities of each row of ``docs`` (with ``LOCATOR``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places = zip(*(batch.column(c).to_pylist() for c in [*LOCATOR, "text"]))
            seen = [(f, r, *x) for f, r, t in places if t for x in {x for _, _, k, m in find(t) for x in identities(k, m)}]
            if seen:
                yield pa.RecordBatch.from_pydict(dict(zip([*LOCATOR, "kind", "id"], map(list, zip(*seen)))))

    return docs.select(*LOCATOR, "text").mapInArrow(run, _MENTIONS)


def resolve(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, id, attempt, surrogate`` with all surrogates distinct and, but where a format is
    full, none real."""
    shape = "kind string, id string, attempt int, surrogate string"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, ident, attempt = (batch.column(c).to_pylist() for c in ("kind", "id", "attempt"))
            made = [surrogate(k, i, key, a) for k, i, a in zip(kind, ident, attempt)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "id", "attempt")), pa.array(made, pa.string())], names=["kind", "id", "attempt", "surrogate"])

    real = entities.select("kind", F.col("id").alias("surrogate"), F.lit(True).alias("real"))
    cur = cut(entities.select("kind", "id", F.lit(0).alias("attempt")).mapInArrow(draw, shape), "surrogates")
    for _ in range(ROUNDS):
        first = cur.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "id")).alias("first"), F.count(F.lit(1)).alias("n"))
        marked = cut(
            cur.join(first.where("n > 1").select("kind", "surrogate", "first"), ["kind", "surrogate"], "left")
            .join(real, ["kind", "surrogate"], "left")
            .withColumn("again", F.col("real").isNotNull() | (F.col("first").isNotNull() & (F.col("first.id") != F.col("id")))),
            "met",
        )
        release(cur)
        if marked.where("again").isEmpty():
            return marked.select("kind", "id", "attempt", "surrogate")
        redo = marked.where("again").select("kind", "id", (F.col("attempt") + 1).alias("attempt"))
        cur = cut(marked.where("not again").select("kind", "id", "attempt", "surrogate").unionByName(redo.mapInArrow(draw, shape)), "surrogates")
        release(marked)
    return cur


OUT = "doc_id bigint, text string, entities array<struct<start:int,end:int,kind:string,surrogate:string>>"


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, entities``: the rewritten text and what was replaced where."""
    located = with_locator(docs)
    held = cut(mentions(located), "mentions")
    later = cut(resolve(cut(held.select("kind", "id").distinct(), "entities"), key).where("attempt > 0").select("kind", "id", "attempt"), "later")
    few = later.count() <= FEW_ROWS
    own = held.join(F.broadcast(later) if few else later, ["kind", "id"]).groupBy(*LOCATOR).agg(F.collect_list(F.struct("kind", "id", "attempt")).alias("later"))
    own = cut(own, "later")  # one row a document, as long as what it holds
    rows = located.select(*LOCATOR, "doc_id", "text").join(F.broadcast(own) if own.count() <= FEW_ROWS else own, LOCATOR, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1 << 14)
        def plain(kind: str, mention: str) -> str:
            return replacement(kind, mention, key, {})

        for batch in slices(batches):
            texts, marks = [], []
            for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist()):
                attempts = {(x["kind"], x["id"]): x["attempt"] for x in later or ()}
                out, at, own = [], 0, []
                for a, b, kind, mention in find(text) if text else ():
                    put = replacement(kind, mention, key, attempts) if attempts else plain(kind, mention)
                    out += [text[at:a], put]
                    own.append({"start": a, "end": b, "kind": kind, "surrogate": put})
                    at = b
                texts.append(text if not own else "".join(out) + text[at:])
                marks.append(own)
            mark = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(marks, pa.list_(mark))], names=["doc_id", "text", "entities"]
            )

    return rows.select("doc_id", "text", "later").mapInArrow(run, OUT)
