"""Surrogates for personal data: keyed, type-consistent replacements.

Entities (email, secret, IBAN, IP address of either kind, US social security number, card,
phone, person name) are found by one expression. An entity's surrogate is a
function of the key, its kind and its canonical form only, so mentions of one
entity agree in every text (coreference). It keeps type and format: digits stay
digits, letters stay letters of their script and case, separators stay; card
numbers keep their brand digit and Luhn validity, IBANs get right check digits,
phones keep the country code, emails of one domain share a new domain, names
agree with the gender and with the script, surname by surname.

Names are found by their titles. Every word of a titled name is then known in its
text: other mentions of it there, with or without a title, get the same surrogate.
A first name has one identity whatever the title; its ending follows the gender of
a title that it bears anywhere in the text, else of its own ending. A number of a
card's form is a card only if its check digit is right. A phone's country code is
read by the numbering plan, with or without a separator behind it; a number in the
North American form without a code has code 1.

Entities side by side stay apart: a number ends where another entity begins, a
phone number after its country's count of digits, an IBAN after its country's
length. Where a country's phone numbers vary in length, a plain number behind one
that still fits is taken as part of it.

Distinctness is checked over the whole corpus: if two entities of a kind get one
surrogate, or a surrogate is an entity that occurs, the later one (by canonical
form) is drawn again with the next attempt, until none collides. From attempt
``EASY`` on a surrogate may leave its exact format (longer names, numbers, octets of
any length), so that a corpus that has used up a format still ends.

Everything is DataFrame expressions; texts are not shuffled (only the rare texts
with a redrawn entity meet the table of attempts). Defined cases: a null text
stays null and has no entities; rows repeat as they come; null ids are kept;
an empty table gives no rows; columns of the input named ``kinds`` or ``n_entities``
are replaced by the operator's, other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Titles by the gender of the person named.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof", "Mx"],
}
_ALL = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
TITLE = rf"(?<![\p{{L}}])(?:{_ALL})\.? "
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
#: Words that announce a secret, and what keys of well-known services begin with.
SECRET_WORDS = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*"
SERVICE = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|eyJ)"
_KEYS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
#: Of eight characters or more up to white space, a quote, a comma or the like; punctuation that ends a clause is not part of it.
_VALUE = r"[^\s\"'`<>,;]{7,}[^\s\"'`<>,;.:]"
SECRET = rf"(?<![\p{{L}}\p{{N}}])(?:{SECRET_WORDS}[\"']?{_VALUE}[\"']?|(?:{_KEYS})(?![\p{{L}}\p{{N}}_-]))"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around one "::" with a group on each side; with a digit somewhere.
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
#: With spaces only behind its name.
SSN = r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|(?<=(?i:ssn|security number)[:#]{0,1} {0,2})\d{3} \d{2} \d{4})(?![\d-])"
LOCAL = r"\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
_LONG = r"\d{13,19}|\d{4}(?: \d{4}){2,3}+(?! \d{4}(?!\d))|\d{4}(?:-\d{4}){2,3}|\d{4}[ -]\d{6}[ -]\d{5}"
#: What a number does not take in across a separator: the beginning of another entity.
NEXT = rf"(?!{IP}|{SSN}|{LOCAL}|(?:{_LONG})(?!\d)|\d+[\p{{L}}\p{{N}}._%+-]*@)"
CARD = rf"(?<!\d)(?:\d{{13,19}}|\d{{4}}(?: \d{{4}}){{2,3}}(?: {NEXT}\d{{1,3}}(?![.-]?\d))?|\d{{4}}(?:-\d{{4}}){{2,3}}(?:-\d{{1,3}})?|\d{{4}}[ -]\d{{6}}[ -]\d{{5}})(?!\d)"
#: IBAN lengths by country (those of the registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
_IBAN_NEXT = rf"(?!{IP}|{SSN}|{LOCAL}|{EMAIL}|{SECRET}|(?:{_IBANS})(?![\p{{L}}\p{{N}}]))"
#: An IBAN of its country's length, else any of the form.
IBAN = rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}\d)(?:(?:{_IBANS})(?![\p{{L}}\p{{N}}])|[A-Z]{{2}}\d{{2}}(?:(?: {_IBAN_NEXT})?[A-Z0-9]{{4}}){{2,7}}(?:(?: {_IBAN_NEXT})?[A-Z0-9]{{1,3}})?(?![\p{{L}}\p{{N}}]))"
#: Least and most digits of a phone number after the country code.
PHONE_DIGITS = {
    (10, 10): "1 7 30 52 57 90 91 92", (8, 8): "45 47 65 371 372 373 852 853", (9, 9): "33 34 48 51 56 94 213 251 254 255 256 351 380 420 421 966", (8, 9): "32 36 40 41 61 84 353 359 370 385 386 971 972",
    (9, 10): "44 31 46 60 62 63 66 81", (8, 10): "20 27 64 82 98", (10, 11): "54 55 86",
}


#: No IP address begins, but for eight digits in pairs.
_NO_IP = rf"(?!(?!\d\d(?:\.\d\d){{3}}(?!\d)){IP})"


def _digits(least: int, most: int) -> str:
    return rf"\d(?:(?:[ .-]{_NO_IP})?\d){{{least - 1}}}(?:(?:[ .-]{NEXT})?\d){{0,{most - least}}}(?!\d)"


def _national(least: int, most: int) -> str:
    """``least`` to ``most`` digits; those in parentheses count, without a leading 0."""
    area = [rf"\(0?\d{{{k}}}\)[ .-]?{_digits(least - k, most - k)}" for k in (2, 3, 4)]
    return "(?:" + "|".join([_digits(least, most), rf"\(0\)[ .-]?{_digits(least, most)}", *area]) + ")"


_CODE_END = rf"(?:[ .-]{_NO_IP})?"
_KNOWN = "|".join(rf"(?:{c.replace(' ', '|')}){_CODE_END}{_national(*n)}" for n, c in PHONE_DIGITS.items())
#: By the country's count of digits, else 6 to 12 digits.
_ANY = rf"\d{{1,3}}{_CODE_END}(?:\(\d{{1,4}}\)[ .-]?)?{_digits(6, 12)}"
PHONE = rf"(?<![\d+])(?:\+(?:{_KNOWN}|{_ANY})|\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]{NEXT}\d{{3,4}}|{LOCAL})(?!\d)"
#: Words of a name do not begin another entity.
_WORD = rf"(?!{EMAIL}|{SECRET}|{IBAN}|{TITLE}\p{{Lu}})\p{{Lu}}[\p{{L}}'’-]+"
NAME = rf"{TITLE}{_WORD}(?: {_WORD}){{0,2}}"
ENTITY = "|".join([EMAIL, SECRET, IBAN, IP, IP6, SSN, PHONE, CARD, NAME])
#: Texts without any of these hold no entity.
GATE = rf"[0-9@=:]|{TITLE}|{SERVICE}"
#: English words that are names as well. Alone at the beginning of a sentence they are taken for words.
ALSO_WORDS = """art august april baker bell bill bishop black bond brown bush carpenter chase chance church cook dawn day dean drew faith field fields ford fox frank
glass grace grant gray green guy hall hill hope hunt hunter jack joy june king lane lily long love major mark marsh may miles miller moon nelson page park pat
pearl penny pierce pope price ray read reed rice rich rivers rob rose ruby rush sharp short skip stone storm sue summer taylor van walker wall ward wells
white will wise wood woods young""".split()

#: Country codes of the numbering plan; all others have three digits.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöùúûüý"
#: Script -> consonants, vowels, ending of a feminine name.
SYLLABLES = {"latin": ("bdfgklmnprstv", "aeiou", "a"), "cyrillic": ("бвгдклмнпрст", "аеиоу", "а"), "greek": ("βγδκλμνπρστ", "αειοω", "α")}
EASY = 8  # attempts after which a surrogate may grow longer


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """192 hexadecimal digits drawn for an entity."""
    base = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(base, F.lit(f"\x1f{k}")), 256) for k in range(3)])


def drawn(h: Column, i: Column | int, digits: int = 2) -> Column:
    """Number i (from 0) of a stream."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(h.substr((i % (192 // digits)) * digits + 1, F.lit(digits)), 16, 10).cast("int")


def pick(alphabet: str, v: Column) -> Column:
    return F.lit(alphabet).substr(v % len(alphabet) + 1, F.lit(1))


def swapped(c: Column, v: Column) -> Column:
    """A character of the same kind, script and case; others stay."""
    within = lambda a: (c >= a[0]) & (c <= a[-1])
    return (
        F.when(within(DIGITS), pick(DIGITS, v))
        .when(within(LOWER), pick(LOWER, v))
        .when(within(LOWER.upper()), pick(LOWER.upper(), v))
        .when(within(CYRILLIC), pick(CYRILLIC, v))
        .when(within(CYRILLIC.upper()), pick(CYRILLIC.upper(), v))
        .when(within(GREEK), pick(GREEK, v))
        .when(within(GREEK.upper()), pick(GREEK.upper(), v))
        .when(c.rlike(r"\p{Lu}"), pick(ACCENTED.upper(), v))
        .when(c.rlike(r"\p{L}"), pick(ACCENTED, v))
        .otherwise(c)
    )


def places(s: Column) -> Column:
    """1 .. length (nothing for the empty string)."""
    return F.slice(F.sequence(F.lit(1), F.length(s) + 1), 1, F.length(s))


def kept_format(s: Column, h: Column) -> Column:
    return F.array_join(F.transform(places(s), lambda i: swapped(s.substr(i, F.lit(1)), drawn(h, i - 1))), "")


def luhn_sum(digits: Column, first: int) -> Column:
    """Luhn sum; ``first`` 0: the last digit counts once, 1: twice (a check digit follows)."""
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return a + F.when((n - i + first) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places(digits), F.lit(0), add)


def mod97(s: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        c = s.substr(i, F.lit(1))
        return F.when(c <= "9", (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(places(s), F.lit(0), add)


def name_like(canon: Column, kind: Column, h: Column) -> Column:
    """A name of syllables in the script of ``canon``; a first name without the ending of its gender."""

    def made(script: str) -> Column:
        cons, vowels, _ = SYLLABLES[script]
        syllable = lambda k: F.concat(pick(cons, drawn(h, 2 * k)), pick(vowels, drawn(h, 2 * k + 1)))
        stem = F.concat(syllable(0), syllable(1), pick(cons, drawn(h, 10)))
        return F.when(kind == "last", F.concat(syllable(2), stem, pick(vowels, drawn(h, 12)), pick(cons, drawn(h, 13)))).otherwise(stem)

    return by_script(canon, made)


def by_script(canon: Column, made) -> Column:
    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def female(canon: Column) -> Column:
    """The ending of a feminine first name in the script of ``canon``."""
    return by_script(canon, lambda script: F.lit(SYLLABLES[script][2]))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""

    def of(h: Column) -> Column:
        late = attempt >= EASY
        letters = F.when(late, F.array_join(F.transform(F.sequence(F.lit(80), F.lit(85)), lambda i: pick(LOWER, drawn(h, i))), "")).otherwise("")
        numbers = F.when(late, F.array_join(F.transform(F.sequence(F.lit(80), F.lit(83)), lambda i: pick(DIGITS, drawn(h, i))), "")).otherwise("")
        domain = F.substring_index(canon, "@", -1)
        top = F.substring_index(domain, ".", -1)
        core = domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1)
        email = F.concat(kept_format(F.substring_index(canon, "@", 1), h), letters, F.lit("@"), let(stream(key, F.lit("domain"), domain, F.lit(0)), lambda d: kept_format(core, d)), F.lit("."), top)

        def octet(o: Column, i: Column) -> Column:
            v = drawn(h, i, 4)
            return F.when(late, (v % 256).cast("string")).when(F.length(o) == 1, v % 10).when(F.length(o) == 2, 10 + v % 90).otherwise(100 + v % 156).cast("string")

        ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
        grown = F.when(late, numbers.substr(F.lit(1), F.greatest(F.lit(0), 19 - F.length(canon)))).otherwise("")
        body = F.concat(canon.substr(1, 1), kept_format(canon.substr(F.lit(2), F.length(canon) - 2), h), grown)
        card = F.concat(body, ((10 - luhn_sum(body, 1) % 10) % 10).cast("string"))
        country = F.substring_index(canon, "|", 1)  # phone: country code | the other digits
        phone = F.concat(country, F.lit("|"), kept_format(F.substring_index(canon, "|", -1), h), numbers)
        rest = kept_format(canon.substr(F.lit(5), F.length(canon)), h)
        check = F.lpad((98 - mod97(F.concat(rest, canon.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
        groups = F.array_join(F.transform(places(canon), lambda i: F.when(canon.substr(i, F.lit(1)) == ":", ":").otherwise(pick("0123456789abcdef", drawn(h, i - 1)))), "")
        grown6 = F.when(late & (F.length(canon) < 30), F.concat(F.lit(":"), F.array_join(F.transform(F.sequence(F.lit(80), F.lit(83)), lambda i: pick("0123456789abcdef", drawn(h, i))), ""))).otherwise("")
        hexes = F.array_join(F.transform(places(canon), lambda i: pick("0123456789abcdef", drawn(h, i - 1))), "")
        return (
            F.when(kind == "email", email)
            .when(kind == "ip", ip)
            .when(kind == "ip6", F.concat(groups, grown6))
            .when(kind == "card", card)
            .when(kind == "phone", phone)
            .when(kind == "ssn", F.concat(kept_format(canon, h), numbers))
            .when(kind == "iban", F.concat(canon.substr(1, 2), check, rest))
            .when(kind == "secret", F.concat(F.when(canon.rlike("^[0-9a-f]+$"), hexes).otherwise(kept_format(canon, h)), letters))
            .otherwise(F.concat(name_like(canon, kind, h), letters))
        )

    return let(stream(key, kind, canon, attempt), of)


def kind_of(m: Column) -> Column:
    return (
        F.when(m.rlike(rf"^(?:{SECRET_WORDS}|(?:{_KEYS})$)"), "secret")
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ip6")
        .when(m.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}([- ])\d{2}\1\d{4}$"), "ssn")
        .when(m.rlike(r"^(?:[+(]|\d{3}[ .-]\d{3}[ .-]\d{4}$)"), "phone")
        .when(m.rlike(r"^\d"), let(F.regexp_replace(m, r"\D", ""), lambda d: F.when(luhn_sum(d, 0) % 10 == 0, "card").otherwise("number")))
        .otherwise("name")
    )


SECRET_HEAD = rf"^(?:{SECRET_WORDS}[\"']?)?{SERVICE}?"


def canonical(m: Column, kind: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(m, r"\(0\)", ""), r"\D", "")
    code = F.when(m.startswith("+"), F.regexp_extract(digits, f"^({COUNTRY})", 1)).otherwise("")
    phone = F.concat(F.when((code == "") & (F.length(digits) == 10), "1").otherwise(code), F.lit("|"), digits.substr(F.length(code) + 1, F.length(digits)))
    return (
        F.when(kind.isin("email", "ip6"), F.lower(m))
        .when(kind == "secret", F.regexp_replace(F.regexp_replace(m, SECRET_HEAD, ""), r"[\"']$", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "phone", phone)
        .when(kind == "ip", m)
        .otherwise(digits)
    )


def name_parts(m: Column) -> tuple[Column, Column, Column]:
    """(title and space, words, gender) of a name mention."""
    title = F.regexp_extract(m, rf"^(?:{_ALL})\.? ", 0)
    gender = F.when(F.rtrim(F.regexp_replace(title, r"\.", "")).isin(TITLES["f"]), "f").when(F.rtrim(F.regexp_replace(title, r"\.", "")).isin(TITLES["m"]), "m").otherwise("n")
    return title, F.split(m.substr(F.length(title) + 1, F.length(m)), " "), gender


def name_entities(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "last").otherwise("first").alias("kind"), F.lower(w).alias("canon")))


def entities(m: Column) -> Column:
    """The (kind, canon) that a mention names: one, or one for each word of a name; none for a plain number."""
    _, words, _ = name_parts(m)
    none = F.array().cast("array<struct<kind:string,canon:string>>")
    return let(kind_of(m), lambda k: F.when(k == "name", name_entities(words)).when(k == "number", none).otherwise(F.array(F.struct(k.alias("kind"), canonical(m, k).alias("canon")))))


def filled(m: Column, value: Column) -> Column:
    """value's characters in the places of the mention's letters and digits; what is left over comes last."""

    def step(a: Column, i: Column) -> Column:
        c = m.substr(i, F.lit(1))
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(a["s"], F.when(own, value.substr(a["k"], F.lit(1))).otherwise(c)).alias("s"), F.when(own, a["k"] + 1).otherwise(a["k"]).alias("k"))

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    return F.aggregate(places(m), start, step, lambda a: F.concat(a["s"], value.substr(a["k"], F.length(value))))


def known_names(said: Column) -> Column:
    """kind, canon, sex (m, f, or null: no title says it) of the words of the titled names among a text's mentions, each once.

    A word that is both a first and a last name in one text counts as the first of these.
    """

    def of(m: Column) -> Column:
        _, words, gender = name_parts(m)
        return F.when(kind_of(m) == "name", F.transform(name_entities(words), lambda e: F.struct(e["canon"].alias("canon"), e["kind"].alias("kind"), F.when(gender != "n", gender).alias("sex"))))

    every = F.flatten(F.filter(F.transform(said, of), lambda x: x.isNotNull()))
    firsts = F.array_distinct(F.transform(every, lambda e: F.struct(e["canon"].alias("canon"), e["kind"].alias("kind"))))

    def one(e: Column) -> Column:
        said_sex = F.filter(every, lambda x: (x["canon"] == e["canon"]) & (x["kind"] == e["kind"]) & x["sex"].isNotNull())
        return F.struct(e["canon"].alias("canon"), e["kind"].alias("kind"), F.get(said_sex, F.lit(0))["sex"].alias("sex"))

    return F.transform(firsts, one)


def name_word(key: str, kind: Column, canon: Column, sex: Column, tries: Column) -> Column:
    """The surrogate of one word of a name, in lower case, with the ending of its gender."""
    woman = F.coalesce(sex == "f", canon.rlike("[aаяα]$"))
    return F.concat(surrogate(key, kind, canon, tries), F.when((kind == "first") & woman, female(canon)).otherwise(""))


def cased(like: Column, s: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(s)).otherwise(F.concat(F.upper(s.substr(1, 1)), s.substr(F.lit(2), F.length(s))))


def named(key: str, names: Column, attempts: Column) -> Column:
    """known_names() with ``new``, their surrogates."""
    tries = lambda e: F.coalesce(F.element_at(attempts, F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))
    return F.transform(names, lambda e: F.struct(e["canon"].alias("canon"), e["kind"].alias("kind"), name_word(key, e["kind"], e["canon"], e["sex"], tries(e)).alias("new")))


def without_titles(segment: Column, names: Column) -> Column:
    """A piece of text between mentions, with the words of known names (capitalised or in capitals) replaced.

    A name that is an English word as well (ALSO_WORDS) is one only beside another word of a name, or where no sentence begins.
    """
    capital = lambda c: F.concat(F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c)))
    quoted = lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))
    others = F.array_join(F.transform(names, lambda e: quoted(capital(e["canon"]))), "|")
    before, after = F.lit(r"(?<![\p{L}\p{N}@._-])"), F.lit(r"(?![\p{L}\p{N}@_])")

    def step(a: Column, e: Column) -> Column:
        word = quoted(capital(e["canon"]))
        inside = F.lit(r"(?<!^)(?<![.!?:…][\"'”’)»]{0,1}\s{1,2})(?<!\n)(?<![\"“„«(¿¡])")
        beside = F.concat(F.lit("(?: (?:\x00|"), others, F.lit(r"(?![\p{L}\p{N}])))"))
        behind = F.lit(r"(?<=\x00[\p{L}'’-]{1,40} )")
        sure = F.concat(before, word, after)
        careful = F.concat(before, F.lit("(?:"), behind, word, F.lit("|"), inside, word, F.lit("|"), word, F.lit("(?="), beside, F.lit("))"), after)
        pattern = F.when(e["canon"].isin(ALSO_WORDS), careful).otherwise(sure)
        once = F.regexp_replace(a, pattern, F.concat(F.lit("\x00"), cased(capital(e["canon"]), e["new"])))
        return F.regexp_replace(once, F.concat(before, quoted(F.upper(e["canon"])), after), F.concat(F.lit("\x00"), F.upper(e["new"])))

    # A mark (\x00) before what is new keeps it from being replaced again; the text's own \x00 and \x01 are escaped meanwhile.
    escaped = F.regexp_replace(F.regexp_replace(segment, "\x01", "\x01\x03"), "\x00", "\x01\x02")
    marked = F.regexp_replace(F.aggregate(names, escaped, step), "\x00", "")
    return F.regexp_replace(F.regexp_replace(marked, "\x01\x02", "\x00"), "\x01\x03", "\x01")


def replacement(key: str, m: Column, attempts: Column, names: Column) -> Column:
    """The text that stands for a mention. attempts: map from kind|canon; names: named()."""
    tries = lambda kind, canon: F.coalesce(F.element_at(attempts, F.concat_ws("|", kind, canon)), F.lit(0))
    made = lambda kind, canon: surrogate(key, kind, canon, tries(kind, canon))
    title, words, _ = name_parts(m)

    def word(w: Column, e: Column) -> Column:
        own = F.filter(names, lambda n: (n["canon"] == e["canon"]) & (n["kind"] == e["kind"]))
        return cased(w, F.get(own, F.lit(0))["new"])

    name = F.concat(title, F.array_join(F.zip_with(words, name_entities(words), word), " "))

    def other(k: Column) -> Column:
        def shown(s: Column) -> Column:
            secret = F.concat(F.regexp_extract(m, SECRET_HEAD, 0), s, F.regexp_extract(m, r"[\"']?$", 0))
            national = F.substring_index(s, "|", -1)
            phone = F.when(~m.startswith("+"), national).otherwise(F.concat(F.substring_index(s, "|", 1), F.when(m.contains("(0)"), "0").otherwise(""), national))
            return (
                F.when(k == "email", F.when(m == F.upper(m), F.upper(s)).otherwise(s))
                .when(k == "secret", secret)
                .when(k.isin("ip", "ip6"), s)
                .when(k == "phone", filled(m, phone))
                .otherwise(filled(m, s))
            )

        return let(canonical(m, k), lambda c: let(made(k, c), shown))

    return let(kind_of(m), lambda k: F.when(k == "name", name).when(k == "number", m).otherwise(other(k)))


def mentions(text: Column) -> Column:
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def attempts_table(found: DataFrame, key: str, rounds: int = 40) -> DataFrame | None:
    """found(kind, canon), distinct -> the entities that need another attempt (kind, canon, attempt), or None.

    Each round is one shuffle of entities by surrogate and one by canonical form;
    nearly always the first finds no collision and is the only one.
    """
    live = found.withColumn("attempt", F.lit(0))
    for k in range(rounds):
        live = staged(live.withColumn("s", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "surrogates")
        owner = live.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("own"), F.count("*").alias("n")).where("n > 1")
        twice = live.join(owner, ["kind", "s"]).where(F.col("canon") != F.col("own.canon")).select("kind", "canon")
        forms = F.when(F.col("kind") == "first", F.array(F.col("s"), F.concat("s", female(F.col("canon"))))).otherwise(F.array("s"))
        each = live.select("kind", "canon", F.explode(forms).alias("s"))
        names = found.where("kind in ('first', 'last')").select("canon").distinct()  # a name's word is no one's surrogate, as first or last name
        taken = found.where("kind not in ('first', 'last')").select("kind", F.col("canon").alias("s"))
        taken = taken.unionByName(names.select(F.explode(F.array(F.lit("first"), F.lit("last"))).alias("kind"), F.col("canon").alias("s")))
        real = each.join(taken, ["kind", "s"], "left_semi").select("kind", "canon")
        bad = staged(twice.unionByName(real).distinct(), "collisions")
        if bad.isEmpty():
            break
        live = live.drop("s").join(bad.withColumn("bad", F.lit(1)), ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("bad", F.lit(0))).drop("bad")
    else:
        raise RuntimeError("surrogates still collide")
    return live.where("attempt > 0").select("kind", "canon", "attempt") if k else None


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its entities replaced in ``text_col``, and ``n_entities``, ``kinds`` (of the mentions, in order)."""
    text = F.col(text_col)
    said = F.flatten(F.transform(mentions(text), entities))
    found = staged(docs.select(F.explode(said).alias("e")).select("e.*").distinct(), "entities")
    redrawn = attempts_table(found, key)
    none = F.create_map().cast("map<string,int>")
    with_map = docs.withColumn("_pii_attempts", none)
    if redrawn is not None:
        h = F.xxhash64(text)
        each = docs.where(text.rlike(GATE)).select(h.alias("_pii_h"), F.explode(said).alias("e")).select("_pii_h", "e.*").distinct()
        maps = each.join(redrawn, ["kind", "canon"]).groupBy("_pii_h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_pii_attempts"))
        with_map = docs.withColumn("_pii_h", h).join(maps, "_pii_h", "left").drop("_pii_h").withColumn("_pii_attempts", F.coalesce("_pii_attempts", none))
    cut = with_map.withColumn("_pii_m", F.coalesce(mentions(text), F.array().cast("array<string>")))
    cut = cut.withColumn("_pii_n", named(key, known_names(F.col("_pii_m")), F.col("_pii_attempts")))
    new = F.transform("_pii_m", lambda m: replacement(key, m, F.col("_pii_attempts"), F.col("_pii_n")))
    between = F.split(text, ENTITY, -1)
    between = F.when(F.size("_pii_n") > 0, F.transform(between, lambda x: without_titles(x, F.col("_pii_n")))).otherwise(between)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = cut.withColumn(text_col, F.when(F.size("_pii_m") > 0, joined).otherwise(text))
    kinds = F.filter(F.transform("_pii_m", kind_of), lambda k: k != "number")
    return out.withColumn("kinds", kinds).withColumn("n_entities", F.size("kinds").cast("long")).drop("_pii_m", "_pii_n", "_pii_attempts")
