"""PII surrogates: keyed, type-consistent replacements, in DataFrame functions only.

E-mail addresses, phone, card and social security numbers, account numbers and IPv4 addresses are
mapped by keyed Feistel networks over their own digits and letters. Such a map is one-to-one on all
values of a format, so equal values get equal surrogates in every document and different values
never collide, at any corpus size, without a shuffle. So are the words of person
names, over vowels and consonants of their scripts; the given names and Cyrillic surnames of the lists
below change places within their list. Every later or earlier mention of a found name's word in its
text is replaced too, in capitals as well. A grouped check over all entities shows that the maps held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize

# Titles and given names that tell a gender, and surnames that do.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "г-жа")
OPEN_TITLES = ("Dr", "Prof")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Daniel", "Peter", "Hans", "Karl", "Jürgen", "Stefan", "Pierre", "Jacques", "Carlos", "Javier", "Miguel")
FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Maria", "Anna", "Ursula", "Sabine", "Sophie", "Camille", "Claire", "Carmen", "Lucía", "Isabel")
MALE_NAMES_CYRILLIC = ("Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Андрей", "Михаил", "Павел", "Олег")
FEMALE_NAMES_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Юлия", "Вера")
MALE_SURNAMES_CYRILLIC = ("Орлов", "Лебедев", "Козлов", "Новиков", "Морозов", "Волков", "Соловьёв", "Зайцев", "Егоров", "Беляев")
FEMALE_SURNAMES_CYRILLIC = ("Орлова", "Лебедева", "Козлова", "Новикова", "Морозова", "Волкова", "Соловьёва", "Зайцева", "Егорова", "Беляева")

#: Words that are names and common words: as bare mentions they stay, within a name they go.
COMMON = (
    "An", "April", "Art", "August", "Bank", "Bell", "Best", "Bill", "Bishop", "Black", "Brown", "Bush", "Case", "Chance", "Church", "Cook", "Day", "Dean", "Du", "Early", "Fair", "Field", "Fields", "Fox", "Frank", "Freeman", "Glass", "Good", "Grace", "Grant", "Gray", "Green", "Hall", "Harmon", "Hill",
    "Hope", "House", "Hunt", "Hunter", "In", "Joy", "Judge", "July", "June", "King", "Knight", "Lake", "Lane", "Law", "Little", "Long", "Love", "Major", "March", "Mark", "Marsh", "May", "Miles", "Mills", "More", "My", "Noble", "North", "Page", "Park", "Parks", "Pat", "Pope", "Power", "Price", "Rich", "Rose", "Rush",
    "Sharp", "Short", "Small", "Snow", "So", "South", "Stone", "Street", "Strong", "Summer", "Sunday", "To", "Violet", "Wall", "Ward", "Waters", "Way", "West", "White", "Will", "Winter", "Wise", "Wood", "Woods", "Young",
    "Blanc", "Grand", "Petit", "Roi", "Rot", "Klein", "Lang", "Sommer", "Stein", "Vogel", "Wolf", "Bueno", "Calle", "Cruz", "Flores", "Mayo", "Rey", "Вера", "Лев", "Любовь", "Надежда", "Роза",
)
#: Small words within names, which stay.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "du", "la", "le", "el", "al", "bin", "ibn", "ben", "ter", "ten", "zu", "zum", "zur", "af", "av", "y")
#: What comes before a person's own name.
CUES = ("my name is", "My name is", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "signed by", "Signed by", "Full name:", "full name:", "Patient:", "اسمي")
#: The same in scripts that are written without spaces.
CLOSE_CUES = ("我叫", "我的名字是", "私の名前は")
#: Country calling codes.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A word of a name: with a capital, or in a script without capitals; an initial, which a further part follows.
_CAPITAL = r"\p{Lu}(?:\p{L}++|(?=['’]\p{Lu}))(?:['’-]\p{L}++)*+"
_CASELESS = r"\p{Lo}[\p{Lo}\p{M}]*+(?:['’-][\p{Lo}\p{M}]++)*+"
_INITIAL = r"\p{Lu}\.(?= ?\p{Lu})|\p{Lu}(?= \p{Lu}\p{L})"
_SMALL_WORD = rf"(?:{'|'.join(PARTICLES)})(?= )"
_PERSON = rf"(?:(?:(?:{_INITIAL}) ?|{_SMALL_WORD} ))*+(?:{_CAPITAL}|{_CASELESS})(?: (?:(?:(?:{_INITIAL}) ?|{_SMALL_WORD} ))*+(?:{_CAPITAL}))*+"
_TITLE = rf"(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES)})\.? "
_GIVEN = "|".join(MALE_NAMES + FEMALE_NAMES + MALE_NAMES_CYRILLIC + FEMALE_NAMES_CYRILLIC)
#: Kinds in the order of preference where matches begin at the same place. Groups that repeat without
#: a bound are possessive: Java runs those as loops, and others by recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?<![\p{{L}}-])(?:(?=[\p{{Lu}}г])(?:{_TITLE}{_PERSON}|(?:{_GIVEN}) (?=\p{{Lu}}|{_SMALL_WORD}){_PERSON})|(?=[{''.join(sorted({c[0] for c in CUES}))}])(?:{'|'.join(CUES)}) {_PERSON})|(?=[{''.join(sorted({c[0] for c in CLOSE_CUES}))}])(?:{'|'.join(CLOSE_CUES)}){_CASELESS}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: With the words that may be mentions of a name found elsewhere in the text.
MENTIONS = rf"{PATTERN}|(?=\p{{Lu}})(?<!\p{{L}}['’])(?<![\p{{L}}\p{{N}}_]){_CAPITAL}"
#: All kinds but names hold an @ or so many digits, close by.
_DIGITS = r"\d[\d .()-]{3}|[A-Z]{2}\d{2}[ A-Z0-9]"
#: Classes of characters that stand for each other, small letters first; others are kept.
_PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SMALL = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çðñþšžčřłćńśź", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
_LETTERS = _SMALL + tuple(c.upper() for c in _SMALL)
#: Endings of Cyrillic surnames, which tell a gender, are kept.
_ENDING = r"^(.{2,}?)(ова|ева|ёва|ина|ская|цкая|ов|ев|ёв|ин|ский|цкий)$"
_POSSESSIVE = r"['’]s$"
#: Letters of scripts without case, by code points: Han, Hangul, Hiragana, Katakana, Arabic, Hebrew, Devanagari, Thai.
BLOCKS = ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x0621, 0x063A), (0x0641, 0x064A), (0x05D0, 0x05EA), (0x0905, 0x0939), (0x0E01, 0x0E2E))
_BLOCKS = ("blocks",)
LONGEST_WORD = 100


def _kind(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(digits == 0, "name")
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(m.rlike(r"^(?:\d{4}[ -]?){3}\d{4}$"), "card")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("phone")
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _constants(kind: str, values: list) -> Column:
    """An array or map of constants, in one expression."""
    return F.expr(f"{kind}({', '.join(map(repr, values))})")


def _turned(text: Column, code: Column, sign: int, classes: tuple[str, ...]) -> Column:
    """Each character moved within its class by the bytes of a hex string, or back (sign -1)."""

    letters = F.lit("".join(classes))
    begins = _constants("array", [sum(map(len, classes[:k])) + 1 for k, some in enumerate(classes) for _ in some])
    sizes = _constants("array", [len(some) for some in classes for _ in some])

    def one(code: Column, c: Column, i: Column) -> Column:
        by = F.conv(F.substr(code, (i % 30) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        moved = lambda at: F.substr(letters, F.element_at(begins, at) + F.pmod(at - F.element_at(begins, at) + by, F.element_at(sizes, at)), F.lit(1))
        return _with(F.position(c, letters), lambda at: F.when(at > 0, moved(at)).otherwise(c))

    turned = _with(code, lambda code: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(code, c, i)), ""))
    return F.when(text == "", text).otherwise(turned)


def _turned_in_blocks(text: Column, code: Column, sign: int) -> Column:
    """Each character moved within its block by 16 bits of a hex string, or back (sign -1)."""

    def one(code: Column, c: Column, i: Column) -> Column:
        by, at = F.conv(F.substr(code, (i % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign, F.ascii(c)
        point = at
        for a, b in BLOCKS:
            point = F.when((at >= a) & (at <= b), a + F.pmod(at - a + by, F.lit(b - a + 1))).otherwise(point)
        return F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 4, "0")), "UTF-16BE")

    turned = _with(code, lambda code: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(code, c, i)), ""))
    return F.when(text == "", text).otherwise(turned)


def permuted(text: Column, kind: str, key: str, classes: tuple[str, ...] = _PLAIN) -> Column:
    """A keyed one-to-one map on the strings with the same places of character classes: four Feistel
    rounds over the two halves, a step of one on each character, and the rounds back. So it leaves no
    string that has a character of the classes as it was."""
    _turn = (lambda t, c, sign, _: _turned_in_blocks(t, c, sign)) if classes is _BLOCKS else _turned
    half = F.floor(F.length(text) / 2).cast("int")
    code = lambda r, b: F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), b), 256)
    halves = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
    ahead = lambda s, r: F.struct(s["b"].alias("a"), _turn(s["a"], code(r, s["b"]), 1, classes).alias("b"))
    back = lambda s, r: F.struct(_turn(s["b"], code(r, s["a"]), -1, classes).alias("a"), s["a"].alias("b"))
    ones = F.lit("01" * 32)
    stepped = F.aggregate(F.sequence(F.lit(1), F.lit(4)), halves, ahead, lambda s: F.struct(_turn(s["a"], ones, 1, classes).alias("a"), _turn(s["b"], ones, 1, classes).alias("b")))
    return F.aggregate(F.sequence(F.lit(4), F.lit(1), F.lit(-1)), stepped, back, lambda s: F.concat(s["a"], s["b"]))


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.substring_index(F.substring_index(m, ".", i), ".", -1).cast("int")
    start = F.struct((octet(1) * 256 + octet(2)).alias("a"), (octet(3) * 256 + octet(4)).alias("b"))
    move = lambda s, r: F.struct(s["b"].alias("a"), ((s["a"] + F.conv(F.substr(F.sha2(F.concat(F.lit(f"{key}|ip|"), r.cast("string"), F.lit("|"), s["b"].cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")) % 65536).alias("b"))
    text = lambda s: F.concat_ws(".", *(F.floor(x).cast("string") for p in ("a", "b") for x in (s[p] / 256, s[p] % 256)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, move, text)


def _luhn(fifteen: Column) -> Column:
    """The check digit of 15 digits."""
    digit = F.transform(F.filter(F.split(fifteen, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return (10 - F.aggregate(digit, F.lit(0), lambda s, d: s + d) % 10) % 10


def _card(m: Column, key: str) -> Column:
    """First digit (the network), separators and the validity of the check digit are kept."""
    digits = F.regexp_replace(m, r"\D", "")
    inner = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted(F.substr(digits, F.lit(2), F.lit(14)), "card", key))
    offset = F.pmod(F.substr(digits, F.lit(16), F.lit(1)).cast("int") - _luhn(F.substr(digits, F.lit(1), F.lit(15))), F.lit(10))
    separator = lambda k: F.regexp_extract(m, r"^\d{4}([ -]?)\d{4}([ -]?)\d{4}([ -]?)", k)
    part = lambda new, k: F.substr(new, F.lit(4 * k + 1), F.lit(4))
    whole = _with(inner, lambda x: F.concat(x, ((_luhn(x) + offset) % 10).cast("string")))
    return _with(whole, lambda new: F.concat(part(new, 0), separator(1), part(new, 1), separator(2), part(new, 2), separator(3), part(new, 3)))


def _in_case_of(old: Column, new: Column) -> Column:
    """``new`` with capitals where ``old`` of the same length has them."""
    return F.array_join(F.zip_with(F.split(old, ""), F.split(new, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")


def _email(m: Column, key: str) -> Column:
    """Letters are mapped without their case, which is put back, so that both ways of writing an address stay one."""
    domain = F.substring_index(m, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    hosts = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    new = lambda part, kind: _in_case_of(part, permuted(F.lower(part), kind, key))
    return F.concat(new(F.substring_index(m, "@", 1), "email"), F.lit("@"), new(hosts, "domain"), top)


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code are mapped, whatever stands between them, and put back into the format."""
    prefix = F.regexp_extract(m, rf"^(\+(?:{CALLING}))?", 0)

    return F.concat(prefix, _with(F.substr(m, F.length(prefix) + 1), lambda rest: _refilled(rest, r"\D", "phone", key)))


def _refilled(value: Column, between: str, kind: str, key: str) -> Column:
    """A value whose characters are mapped without those of the pattern ``between``, which keep their places."""
    before = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), between, ""))
    put = lambda new: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(between), c).otherwise(F.substr(new, before(i) + 1, F.lit(1)))), "")
    return _with(permuted(F.regexp_replace(value, between, ""), kind, key), put)


def _titled(m: Column) -> Column:
    return m.rlike(f"^{_TITLE}")


def _core(word: Column) -> Column:
    return F.regexp_replace(word, _POSSESSIVE, "")


#: What stands before the words of a name in its match, and a word that is an initial.
_BEFORE = rf"^(?:{_TITLE}|(?:{'|'.join(CUES)}) |(?:{'|'.join(CLOSE_CUES)}))"
_ONE = r"^(?:(?:\p{Lu}\.)+\p{Lu}?|\p{Lu})$"


def _shouted(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)


def _name_words(m: Column) -> Column:
    """The words of a name match after its title or cue, without possessive endings, initials and small words, in small letters."""
    words = F.transform(F.split(F.regexp_replace(m, _BEFORE, ""), " "), _core)
    whole = F.filter(words, lambda w: ~w.rlike(_ONE) & ~w.isin(*PARTICLES))
    return F.transform(whole, lambda w: F.lower(F.regexp_replace(w, r"^(?:\p{Lu}\.)+(?=\p{Lu}\p{L})", "")))


def _listed(key: str) -> dict[str, str]:
    """Names of the lists to the next one of their list in a keyed order; surnames of both genders alike."""
    out: dict[str, str] = {}
    for names, *same in ((MALE_NAMES,), (FEMALE_NAMES,), (MALE_NAMES_CYRILLIC,), (FEMALE_NAMES_CYRILLIC,), (MALE_SURNAMES_CYRILLIC, FEMALE_SURNAMES_CYRILLIC)):
        order = sorted(range(len(names)), key=lambda i: hashlib.sha256(f"{key}|name|{names[i]}".encode()).digest())
        for i, j in zip(order, order[1:] + order[:1], strict=True):
            out |= {some[i]: some[j] for some in (names, *same)}
    return out


def _renamed(word: Column, key: str) -> Column:
    """A keyed one-to-one map on the words of names, with one capital, the same in every document.

    A word outside the lists is moved until it is outside them and has its ending again, which keeps the
    map one-to-one. Characters of scripts without case move within their BLOCKS. Words of other or mixed
    scripts, and those of more than LONGEST_WORD characters, get consonants by 64 bits of a keyed hash.
    """
    lists = _listed(key)
    known, pairs = _constants("array", list(lists)), _constants("map", [x for pair in lists.items() for x in pair])
    ending = F.regexp_extract(word, _ENDING, 2)
    stem = F.substr(word, F.lit(1), F.length(word) - F.length(ending))
    fits = lambda s: ~F.array_contains(known, F.concat(s, ending)) & (F.regexp_extract(F.concat(s, ending), _ENDING, 2) == ending)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(8)), stem, lambda s, i: F.when((i > 1) & fits(s), s).otherwise(permuted(s, "name", key, _LETTERS)))
    other = F.concat(F.lit("X"), F.translate(F.substr(F.sha2(F.concat(F.lit(f"{key}|name|"), word), 256), F.lit(1), F.lit(16)), "0123456789abcdef", "bcdfghklmnprstvz"))
    lettered = word.rlike(rf"^[{''.join(_LETTERS)}ß'’-]+$") & (F.length(word) <= LONGEST_WORD)
    blocks = word.rlike(rf"^[{''.join(f'\\x{{{a:X}}}-\\x{{{b:X}}}' for a, b in BLOCKS)}]+$") & (F.length(word) <= LONGEST_WORD)
    return F.coalesce(F.element_at(pairs, word), F.when(lettered, F.concat(walked, ending)).when(blocks, permuted(word, "name", key, _BLOCKS)).otherwise(other))


def _mention(word: Column, names: Column) -> Column:
    """The new word of a mention of one of ``names`` (a map from small letters), in its capitals; null for other words."""

    def cased(core: Column, new: Column) -> Column:
        plain = (core == F.initcap(core)) | (F.length(core) != F.length(new)) | (F.length(F.lower(core)) != F.length(new))
        return F.when(_shouted(core), F.upper(new)).when(plain, new).otherwise(_in_case_of(core, F.lower(new)))

    new = _with(_core(word), lambda core: _with(F.element_at(names, F.lower(core)), lambda new: cased(core, new)))
    return F.concat(new, F.regexp_extract(word, _POSSESSIVE, 0))


def _name_surrogate(m: Column, names: Column, key: str) -> Column:
    """A name's match word by word, or a bare mention, which stays if it is a common word too."""
    initials = lambda w: F.concat(permuted(F.regexp_extract(w, r"^((?:\p{Lu}\.)*\p{Lu}?)", 1), "initial", key, _LETTERS))

    def word(w: Column) -> Column:
        joined = r"^((?:\p{Lu}\.)+)(\p{Lu}\p{L}.*)$"  # J.Smith
        tail = F.regexp_extract(w, joined, 2)
        return F.when(w.rlike(_ONE), initials(w)).when(w.rlike(joined), F.concat(permuted(F.regexp_extract(w, joined, 1), "initial", key, _LETTERS), F.coalesce(_mention(tail, names), tail))).otherwise(F.coalesce(_mention(w, names), w))

    before = F.regexp_extract(m, _BEFORE, 0)
    rest = F.regexp_replace(m, _BEFORE, "")
    bare = (before == "") & ~m.contains(" ")
    common = F.initcap(_core(m)).isin(*COMMON)
    return F.when(bare, F.when(~common, _mention(m, names))).otherwise(F.concat(before, F.array_join(F.transform(F.split(rest, " "), word), " ")))


def _surrogate(kind: Column, m: Column, names: Column, key: str) -> Column:
    """The surrogate of a match; null if it is a capitalised word that no name holds."""
    return (
        F.when(kind == "name", _name_surrogate(m, names, key))
        .when(kind == "email", _email(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "card", _card(m, key))
        .when(kind == "ssn", permuted(m, "ssn", key))
        .when(kind == "iban", F.concat(F.substr(m, F.lit(1), F.lit(2)), _refilled(F.substr(m, F.lit(3)), " ", "iban", key)))
        .otherwise(_phone(m, key))
    )


def _replaced(inner: DataFrame, text: str, key: str) -> DataFrame:
    """``inner`` with columns m_found (array of kind, original, surrogate) and m_text."""
    if not key:
        raise ValueError("surrogates need a key")
    whole = F.col(text)
    some = whole.contains("@") | whole.rlike(_DIGITS) | whole.rlike(PATTERNS["name"])
    none = F.array().cast("array<string>")
    step = inner.withColumn("m_first", F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none))
    step = step.withColumn("m_words", F.array_distinct(F.flatten(F.transform(F.filter("m_first", lambda m: _kind(m) == "name"), _name_words))))
    named, names = F.size("m_words") > 0, F.map_from_arrays("m_words", F.transform("m_words", lambda w: _renamed(F.initcap(w), key)))
    # names without case may stand within other letters, so they are looked for by themselves
    caseless = F.filter("m_words", lambda w: w.rlike(r"^\p{Lo}[\p{Lo}\p{M}]+$"))
    mentions = F.concat(F.lit(MENTIONS + "|"), F.array_join(caseless, "|"))
    other = F.size(caseless) > 0
    pick = lambda use, first: F.when(named & other, use(mentions)).when(named, use(F.lit(MENTIONS))).otherwise(first)
    step = step.withColumns({"m_names": names, "m_all": pick(lambda p: F.regexp_extract_all(text, p, F.lit(0)), F.col("m_first"))})
    kinds = F.transform("m_all", lambda m: F.struct(_kind(m).alias("kind"), m.alias("original")))
    step = step.withColumn("m_each", F.transform(kinds, lambda f: F.struct(f["kind"], f["original"], _surrogate(f["kind"], f["original"], F.col("m_names"), key).alias("surrogate"))))
    gaps = pick(lambda p: F.split(whole, p, -1), F.split(whole, PATTERN, -1))
    news = F.concat(F.transform("m_each", lambda f: F.coalesce(f["surrogate"], f["original"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, news, lambda g, s: F.concat(g, s)), "")
    found = F.filter("m_each", lambda f: f["surrogate"].isNotNull())
    return step.withColumns({"m_found": found, "m_text": F.when(F.size("m_each") > 0, joined).otherwise(whole)})


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, kinds (in order, comma-joined) and text of each row of ``docs(doc_id, text)``.

    Detected entities are replaced in place: same kind, punctuation, letter case and script, gender
    of names where a title or given name tells it, country prefix of phones, network and validity
    of card numbers. Equal entities get equal surrogates in every document, different ones different
    surrogates, which a check over all of them makes sure of: phones are equal by their digits and mails
    without case. Names are found by title, listed given name or a cue before them, with initials, small
    words such as ``van der`` (which stay) and any number of words; their words are then replaced wherever
    they stand in the text, in capitals too, and count as entities of kind name. A word that is COMMON as well goes within a name only. Null
    texts stay null with 0 entities; empty texts and texts without entities stay as they are; repeated
    rows give repeated results; extra columns are left out. ``key`` is secret; an empty one is an error.
    """
    done = _checked(_replaced(docs.select("doc_id", "text"), "text", key).select("doc_id", "m_found", "m_text"), "surrogates")
    kinds = F.array_join(F.transform("m_found", lambda f: f["kind"]), ",")
    return done.select("doc_id", F.greatest(F.size("m_found"), F.lit(0)).cast("bigint").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("kinds"), F.col("m_text").alias("text"))


def mapping(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, kind, original, surrogate), once for each entity of a document: for audits, not for release."""
    done = _replaced(docs.select("doc_id", "text"), "text", key)
    return done.select("doc_id", F.inline("m_found")).distinct()


def _canonical(kind: Column, value: Column) -> Column:
    """What tells two entities apart: the digits of numbers, addresses without case, words without capitals."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"[^\d+]", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(F.lower(value))


def collisions(mapped: DataFrame) -> DataFrame:
    """The collision check over a corpus: surrogates that stand for several originals, and originals with
    several surrogates, in whatever documents, format or case, with one of its forms as ``value``. It is empty if the maps hold
    what they promise. Entities are reduced to distinct ones before they are grouped, so none is hot."""
    same = lambda c: _canonical(F.col("kind"), F.col(c)).alias(f"{c}_key")
    rows = mapped.groupBy("kind", same("original"), same("surrogate")).agg(F.min("original").alias("original"), F.min("surrogate").alias("surrogate"))
    count = lambda by, of: rows.groupBy("kind", f"{by}_key").agg(F.count("*").alias("n"), F.min(by).alias("value")).where("n > 1").select("kind", F.lit(of).alias("several"), "value", "n")
    return reduce(DataFrame.union, [count("surrogate", "originals"), count("original", "surrogates")])


def _checked(done: DataFrame, name: str) -> DataFrame:
    """``done`` written, after the collision check over its entities; a collision is an error."""
    done = materialize(done, name)
    clash = collisions(done.select(F.inline("m_found"))).first()
    if clash is not None:
        raise RuntimeError(f"the surrogates of kind {clash.kind} are not one-to-one: {clash.n} {clash.several}")
    return done


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (all columns, any names) with replaced texts; an n_chars column follows them.

    Null texts stay null, with a null n_chars; empty texts, null ids and repeated rows keep their rows, and an empty table stays
    empty. The collision check runs over all entities first.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    done = _checked(_replaced(inner, f"c{at}", key).select(*(c for i, c in enumerate(inner.columns) if i != at), "m_found", "m_text"), "surrogates")
    columns = [F.col("m_text") if i == at else F.length("m_text").cast(docs.schema[i].dataType) if n == "n_chars" else F.col(f"c{i}") for i, n in enumerate(names)]
    return done.select(*columns).toDF(*names)
