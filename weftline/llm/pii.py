"""Problem 6: personal information inside free text, replaced by typed, linkable placeholders.

Items are found by form: emails, phone numbers, identity numbers, dates of birth, street addresses, and persons'
names (a given name of the list, or one built like them, before a family name). Each is replaced by a placeholder
of its type that holds a pseudonym. Letters and digits of numbers, and the days of dates, are permuted by a keyed
Feistel network within their format; a number that passes the rules of its kind (check digit, ranges, a date in
it) gets a pseudonym that passes them too, and one that fails them gets one that fails. All other items get a
keyed hash of their normal form. So equal values have equal pseudonyms in all documents, the format stays
readable, and the values cannot be recovered without the key.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of streets.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Way|Square|Sq|Court|Ct|Gate|Terrace|Drive|Dr|Place|Pl|Row|Crescent|Boulevard|Blvd|Hill|Park|Alley|Quay|Walk|Mews|Parkway|Highway"
ROMANCE_STREETS = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route|passage|via|viale|piazza|corso|calle|avenida|plaza|paseo|camino|rua|praça|travessa"
GERMAN_STREETS = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer"
PARTICLES = "van|von|de|der|den|del|della|di|da|du|la|le|ten|ter|zu|af|av|bin|al"

#: Capital and small letters of Latin script, for character classes of both engines.
UPPER = "A-ZÀ-ÖØ-Þ" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper())
LOWER = "a-zß-öø-ÿ" + "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower())

EMAIL = r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*(?:@|\s?[(\[]at[)\]]\s?)(?:[A-Za-z0-9-]+(?:\.|\s?[(\[]dot[)\]]\s?))+[A-Za-z]{2,}(?![\w-])"
PHONE = "|".join(
    (
        r"(?<![\w+(./-])\+\d{1,3}(?:[-. ]?\(?\d{1,4}\)?){2,5}(?![\w-])",  # +44 20 7946 0000
        r"(?<![\w+(./-])00\d{1,3}(?:[-. ]\d{2,4}){2,4}(?![\w-])",  # 00999 100 200 300
        r"(?<![\w+./-])(?:1[-. ])?\(\d{3}\)[-. ]?\d{3}[-. ]\d{4}(?![\w-])",  # 1 (200) 555 0100
        r"(?<![\w+(./-])(?:1[-. ])?\d{3}([-. ])\d{3}[-. ]\d{4}(?![\w-])",  # 200-555-0100
        r"(?<![\w+(./-])0\d{2,4}[-. ]\d{3,4}[-. ]\d{3,4}(?![\w-])",  # 020 7946 0000
    )
)
IDENTITY = "|".join(
    (
        r"(?<![\w+./-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])",
        r"(?<![\w+./-])\d{6}-\d{5}(?![\w-])",
        r"(?<![\w+./-])\d{2}/\d{3}/\d{5}(?![\w/-])",
        r"(?<![\w+./-])[A-Z]\d{9}(?![\w-])",
        r"(?<![\w+./-])[A-Z]{2} ?\d{7}(?![\w-])",
    )
)
# \w holds Chinese characters, which may stand next to an item: only ASCII and accented letters bound one.
_ASCII = r"A-Za-z0-9_À-ɏ"
# A date of birth is personal where it is called one; other dates are not.
BIRTH = r"(?i)(?:\b(?:born(?: on)?|date of birth|birth date|birthday|dob|geboren am|geburtsdatum|n[éÉ]e? le|nacid[oa] el)|生日|出生日期|出生)\s?[:：]?\s?(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?!\d)"
_NAMED = rf"(?:(?:de|du|des|del|della|dei|da|do|dos|la|le|les|los|las|el) |[dl]['’])*[{UPPER}][{LOWER}'’-]+(?: [{UPPER}][{LOWER}'’-]+){{0,2}}"
STREET = "|".join(
    (
        rf"(?<![\w./-])\d{{1,4}}[A-Za-z]?,? (?:[{UPPER}][{LOWER}'-]+ ){{1,3}}(?:{STREETS})(?![{_ASCII}])",
        # 12 rue de la Gare, Calle Mayor 5: the kind of street stands before its name
        rf"(?<![\w./-])\d{{1,4}}[A-Za-z]?,? (?i:{ROMANCE_STREETS}) {_NAMED}(?![{_ASCII}])",
        rf"(?<![\w.-])(?:rue|{'|'.join(x.title() for x in ROMANCE_STREETS.split('|'))}) {_NAMED},? \d{{1,4}}[a-zA-Z]?(?![\w/-])",
        rf"(?<![\w.-])[{UPPER}][{LOWER}-]+(?:{GERMAN_STREETS}) \d{{1,4}}[a-zA-Z]?(?![\w/-])",
    )
)


def _bounds(pattern: str) -> str:
    return pattern.replace(r"(?<![\w", f"(?<![{_ASCII}").replace(r"(?![\w", f"(?![{_ASCII}")


_EMAIL, _PHONE, _IDENTITY, _STREET = (re.compile(_bounds(p)) for p in (EMAIL, PHONE, IDENTITY, STREET))

_FAMILY = rf"(?:[{UPPER}]['’])?[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)*"
_BETWEEN = rf"(?: [{UPPER}]\.)*(?: (?:{PARTICLES}))* "
_TITLED = re.compile(
    rf"(?<![{_ASCII}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ([{UPPER}][{LOWER}]+{_BETWEEN}[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)*)(?![{_ASCII}])"
)
_BIRTH = re.compile(BIRTH)


# ---- the filter of the JVM -----------------------------------------------------------------------------

#: A digit, or a sign that the JVM's older Unicode does not know yet.
_D = r"[\p{Nd}\p{Cn}]"
#: Seven digits with at most three separators between neighbours: every phone and identity number has them.
_MANY_DIGITS = rf"{_D}(?:[-. ()/]{{0,3}}{_D}){{6}}"
#: A digit before a capitalised word or a kind of street, or behind a German kind of street or any word.
_NUMBER_FIRST = rf"{_D}[A-Za-z]?,? (?:[{UPPER}]|(?iu:{ROMANCE_STREETS}) )"
_NUMBER_LAST = rf"{_D}(?<=(?:{GERMAN_STREETS}) .)"
_AFTER_WORD = rf"{_D}(?<=[{LOWER}'’-],? .)"
_KINDS = rf"(?:{'|'.join(('rue', *(x.title() for x in ROMANCE_STREETS.split('|'))))}) "
_TITLE = rf"[MDPHFS](?:r|rs|s|iss|rof|err|rau|me|ra)\.? [{UPPER}]"
_ANY_DATE = rf"{_D}[-/.]{_D}{{1,2}}[-/.]{_D}"
_BIRTH_WORDS = r"(?iu:born|birth|dob|geboren|geburts|n[éÉ]|nacid|生日|出生)"


# ---- names ---------------------------------------------------------------------------------------------


def split_names(given: list[str], least: int = 4) -> tuple[list[str], list[str]]:
    """(stems, endings) of a list of given names: endings of two to five letters that at least ``least`` names
    share, longest first, and what stands before them."""
    count: dict[str, set[str]] = defaultdict(set)
    for g in given:
        for k in range(2, 6):
            if len(g) - k >= 2:
                count[g[-k:]].add(g[:-k])
    good = {e: s for e, s in count.items() if len(s) >= least}
    # an ending is worth the names it explains; a shorter one that only repeats a longer one is dropped
    endings = [e for e in good if not any(x != e and x.endswith(e) and len(good[x]) >= 0.8 * len(good[e]) for x in good)]
    endings.sort(key=lambda e: (-len(e), e))
    stems = {s for e in endings for s in good[e]}
    return sorted(stems), endings


def _given_parts(given: list[str], endings: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(names, stems, endings), longest first; a given name is one of the names or a stem with an ending."""
    stems, own = split_names(given)
    longest = lambda words: sorted(words, key=lambda w: (-len(w), w))
    return longest(given), longest(stems), longest({*own, *endings})


def name_pattern(given: list[str], endings: list[str]) -> re.Pattern | None:
    """A given name, initials, particles and a family name; None if no name is known."""
    whole, stems, ends = _given_parts(given, endings)
    alt = [re.escape(g) for g in whole]
    if stems and ends:
        alt.append(f"(?:{'|'.join(map(re.escape, stems))})(?:{'|'.join(map(re.escape, ends))})")
    if not alt:
        return None
    return re.compile(rf"(?<![{_ASCII}.@-])(?:{'|'.join(alt)}){_BETWEEN}(?!(?:{STREETS})(?![{_ASCII}])){_FAMILY}(?![{_ASCII}@])")


def name_filter(given: list[str], endings: list[str]) -> str | None:
    """For the JVM: hits wherever ``name_pattern`` does. A given name is any word of the letters of the known ones
    that begins with the first letter of one."""
    whole, stems, ends = _given_parts(given, endings)
    if not all(whole):  # an empty name stands before every family name
        return _BETWEEN + _FAMILY
    if not whole:
        return None
    letters = lambda words: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set("".join(words)))) + "]"
    longest = max(map(len, (*whole, *(stems[:1] and ends and [stems[0] + ends[0]]))))
    return f"{letters(w[:1] for w in (*whole, *stems))}{letters((*whole, *stems, *ends))}{{0,{longest}}}{_BETWEEN}{_FAMILY}"


def learn_endings(texts: DataFrame, text: str, given: list[str], least_stems: int = 5) -> list[str]:
    """Endings that the list of given names lacks: those which follow at least ``least_stems`` of its stems in
    first words of capitalised pairs, over all texts. Distinct (stem, ending) pairs are counted where they
    lie; what comes to the driver is bounded by the endings of up to five letters that so many stems share."""
    stems, own = split_names(given)
    if not stems:
        return []
    longest = sorted(stems, key=lambda s: (-len(s), s))
    pattern = rf"(?<![A-Za-z])((?:{'|'.join(longest)})[a-z]{{2,5}}) (?:[A-Z]\. )?[A-Z][a-z]"
    first = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("w")).distinct()
    stem = F.regexp_extract("w", rf"^({'|'.join(longest)})", 1)
    pairs = first.select(stem.alias("s"), F.expr("substring(w, length(regexp_extract(w, '^(" + "|".join(longest) + ")', 1)) + 1, 5)").alias("e"))
    found = pairs.where(F.length("e") >= 2).groupBy("e").agg(F.count_distinct("s").alias("n")).where(F.col("n") >= least_stems)
    return [e for e in sorted(r.e for r in found.select("e").collect()) if e not in own]


# ---- finding ---------------------------------------------------------------------------------------------


def _digits(s: str) -> str:
    return "".join(str(int(c)) for c in s if c.isdecimal())


def find_items(text: str, names: re.Pattern | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of all items of a text, in order, without overlaps; earlier rules win."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        k = bisect_left(found, (start,))
        if (not k or found[k - 1][1] <= start) and (k == len(found) or found[k][0] >= end):
            found.insert(k, (start, end, kind))

    if "@" in text or "at)" in text or "at]" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if any(c.isdigit() for c in text):
        for m in _IDENTITY.finditer(text):
            add(m.start(), m.end(), "identity_number")
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                add(m.start(), m.end(), "phone")
        for m in _BIRTH.finditer(text):
            add(m.start(1), m.end(1), "birth_date")
        for m in _STREET.finditer(text):
            add(m.start(), m.end(), "street_address")
    if names is not None:
        for m in names.finditer(text):
            add(m.start(), m.end(), "person_name")
    for m in _TITLED.finditer(text):
        add(m.start(1), m.end(1), "person_name")
    return found


# ---- pseudonyms --------------------------------------------------------------------------------------------


def _shift(key: str, tweak: str, r: int, value: int, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{value}".encode(), key=key.encode()[:64], digest_size=16).digest(), "big") % size


def permute(value: int, left: int, right: int, key: str, tweak: str, back: bool = False, rounds: int = 10) -> int:
    """Keyed permutation of 0..left * right - 1: a Feistel network whose rounds shift the two parts by turns."""
    a, b = divmod(value, right)
    for r in reversed(range(rounds)) if back else range(rounds):
        sign = -1 if back else 1
        if r % 2:
            b = (b + sign * _shift(key, tweak, r, a, right)) % right
        else:
            a = (a + sign * _shift(key, tweak, r, b, left)) % left
    return a * right + b


_CLASSES = (("0", 10), ("A", 26), ("a", 26))


def _places(text: str) -> list[tuple[int, int]]:
    """(index, class) of the signs that a permutation may change: digits and plain letters."""
    kind = lambda c: 0 if c.isdecimal() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else None
    return [(i, kind(c)) for i, c in enumerate(text) if kind(c) is not None]


def feistel(text: str, key: str, back: bool = False) -> str:
    """Keyed permutation of the texts of one format: digits stay digits, letters letters of their case, all other signs
    where they are. Separators do not matter for what a value becomes. Fewer than two such signs stay."""
    at = _places(text)
    if len(at) < 2:
        return text
    sizes = [_CLASSES[k][1] for _, k in at]
    half = len(at) // 2
    value = 0
    for (i, k), size in zip(at, sizes):
        value = value * size + (int(text[i]) if k == 0 else ord(text[i]) - ord(_CLASSES[k][0]))
    value = permute(value, prod(sizes[:half]), prod(sizes[half:]), key, "".join(_CLASSES[k][0] for _, k in at), back)
    out = list(text)
    for (i, k), size in zip(reversed(at), reversed(sizes)):
        value, x = divmod(value, size)
        out[i] = chr(ord(_CLASSES[k][0]) + x)
    return "".join(out)


# The number that a letter stands for in a national identity number, and the weights of its digits.
_LETTER_NUMBER = dict(zip("ABCDEFGHJKLMNPQRSTUVXYWZIO", range(10, 36)))
_LETTER_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)


def is_valid(value: str, kind: str) -> bool:
    """Whether a number keeps the rules of its form: ranges of the parts (3-2-4 digits), a birth date in its first six
    digits (6-5), the check digit (letter and nine digits), ranges of area and exchange (ten-digit phone numbers)."""
    d = _digits(value)
    if kind == "phone":
        return len(d) != 10 or (d[0] > "1" and d[3] > "1")
    if re.fullmatch(r"[A-Z]\d{9}", value):
        n = [int(c) for c in str(_LETTER_NUMBER[value[0]]) + d]
        return d[0] in "1289" and sum(x * w for x, w in zip(n, _LETTER_WEIGHTS)) % 10 == 0
    if re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}", value):
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if re.fullmatch(r"\d{6}-\d{5}", value):
        return 1 <= int(d[:2]) <= 31 and 1 <= int(d[2:4]) <= 12 and _day(int(d[4:6]) + 2000, int(d[2:4]), int(d[:2])) is not None
    return True


def permute_valid(value: str, kind: str, key: str, back: bool = False) -> str:
    """The permutation of a format, walked on until the image keeps the rules exactly if the value does: a permutation
    of the valid values, and one of the others."""
    good, out = is_valid(value, kind), feistel(value, key, back)
    while is_valid(out, kind) != good:
        out = feistel(out, key, back)
    return out


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73_049  # up to the end of 2099


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


def permute_date(value: str, key: str, back: bool = False) -> str:
    """A date of 1900 to 2099 becomes another one in the same form, the same for every form of it; what is no such date
    is permuted as digits."""
    part = re.split(r"([-/.])", value)
    year_first = len(part[0]) == 4
    y, m, d = (int(part[k]) for k in ((0, 2, 4) if year_first else (4, 2, 0)))
    at = _day(y, m, d)
    n = (at - _FIRST_DAY).days if at else -1
    if not 0 <= n < _DAYS:
        return feistel(value, key, back)
    left = 269  # a permutation of 269 x 272 >= _DAYS, walked on into the range
    n = permute(n, left, 272, key, "date", back)
    while n >= _DAYS:
        n = permute(n, left, 272, key, "date", back)
    new = _FIRST_DAY + datetime.timedelta(days=n)
    wide = lambda x, old: f"{x:02d}" if len(old) == 2 else str(x)
    year, month, day = f"{new.year:04d}", wide(new.month, part[2]), wide(new.day, part[4] if year_first else part[0])
    return part[1].join((year, month, day) if year_first else (day, month, year))


def _into(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdecimal() else c for c in shape)


def pseudonym(value: str, kind: str, key: str) -> str:
    """The pseudonym of an item. Of phone numbers the last ten digits are permuted (all but the first three if
    there are fewer than twelve but a foreign prefix), so a number with and without its country code stay
    linked; of identity numbers all letters and digits, of dates of birth the day; all keep their format. Other
    items get a hash of 80 bits of their normal form."""
    if kind == "phone":
        d = _digits(value)
        keep = max(0, len(d) - 10) if not re.match(r"\+|00", value) or d.startswith("1") else min(3 if not value.startswith("00") else 5, len(d) - 4)
        if value.startswith("+44"):
            keep = 2
        return _into(value, d[:keep] + permute_valid(d[keep:], kind, key)) if len(d) - keep >= 2 else _into(value, feistel(d, key))
    if kind == "identity_number":
        return permute_valid(value, kind, key)
    if kind == "birth_date":
        return permute_date(value, key)
    return hashlib.blake2b(f"{kind}|{normal_form(value)}".encode(), key=key.encode()[:64], digest_size=10).hexdigest()


def linked(value: str, kind: str, key: str) -> str:
    """A keyed digest of what an item is, without its spelling: of numbers their letters and digits alone."""
    plain = "".join(value[i] for i, _ in _places(value)) if kind in ("phone", "identity_number") else normal_form(value)
    return hashlib.blake2b(f"linked|{kind}|{plain}".encode(), key=key.encode()[:64], digest_size=10).hexdigest()


def normal_form(value: str) -> str:
    """What spellings of one email, address or name have in common: case, blanks and written-out signs do not count."""
    v = re.sub(r"\s*[(\[]at[)\]]\s*", "@", value.lower())
    return " ".join(re.sub(r"\s*[(\[]dot[)\]]\s*", ".", v).split())


def mask(text: str, names: re.Pattern | None, key: str) -> str:
    out, at = [], 0
    for a, z, kind in find_items(text, names):
        out += [text[at:a], f"<{kind}:{pseudonym(text[a:z], kind, key)}>"]
        at = z
    return "".join(out) + text[at:]


# ---- operators ---------------------------------------------------------------------------------------------

_ITEMS = "table_name string, record_id long, field_name string, item_no int, pii_type string, char_start int, char_end int, pseudonym string, linked string"


def may_hold(text: Column, given: list[str], endings: list[str]) -> Column:
    """Whether ``find_items`` can find anything; true for every text in which it does. Each pattern of the finder has a
    cheaper one here that it implies, so nothing goes to Python but texts that are worth it."""
    hit = lambda p: text.rlike(p)
    numbers = hit(_MANY_DIGITS) | hit(_NUMBER_FIRST) | hit(_NUMBER_LAST) | (hit(_AFTER_WORD) & hit(_KINDS)) | (hit(_ANY_DATE) & hit(_BIRTH_WORDS))
    names = name_filter(given, endings)
    some = text.contains("@") | hit(r"at[)\]]") | (hit(_D) & numbers) | hit(_TITLE)
    return some | hit(names) if names else some


def _secret(key: str) -> str:
    if not key:
        raise ValueError("pseudonyms need a key")
    return key


def find_pii(texts: DataFrame, given: list[str], key: str) -> DataFrame:
    """One row per item of (table_name, record_id, field_name, item_no, text).

    Columns: those four, pii_type, char_start and char_end (code points from 0), pseudonym, and linked, a keyed digest
    of the item's normal form, by which spellings of one value can be joined. ``key`` is the secret. Null and empty
    texts have no items; repeated rows give repeated items; whole texts of any length are searched; further
    columns are ignored; an empty table gives an empty result. ``given`` is the list of given names, a
    vocabulary and not data; the names it lacks are learned from all texts.
    """
    _secret(key)
    endings = learn_endings(texts, "text", given)

    def run(batches):
        names = name_pattern(given, endings)
        for pdf in batches:
            rows = []
            for t, r, f, i, x in pdf.itertuples(index=False, name=None):
                for a, z, kind in find_items(x, names):
                    rows.append((t, r, f, i, kind, a, z, pseudonym(x[a:z], kind, key), linked(x[a:z], kind, key)))
            yield pd.DataFrame(rows, columns=["table_name", "record_id", "field_name", "item_no", "pii_type", "char_start", "char_end", "pseudonym", "linked"])

    some = texts.select("table_name", F.col("record_id").cast("long").alias("record_id"), "field_name", F.col("item_no").cast("int").alias("item_no"), "text")
    return some.where(may_hold(F.col("text"), given, endings)).mapInPandas(run, _ITEMS)


def mask_pii(texts: DataFrame, given: list[str], key: str) -> DataFrame:
    """The same texts, column ``masked``: every item replaced by ``<type:pseudonym>``. Texts that hold no item
    stay as they are, nulls stay null; rows and other columns are kept. ``key`` is the secret."""
    _secret(key)
    endings = learn_endings(texts, "text", given)

    @F.pandas_udf("string")
    def masked(s: pd.Series) -> pd.Series:
        names = name_pattern(given, endings)
        return s.map(lambda x: None if x is None else mask(x, names, key))

    touched = masked(F.when(may_hold(F.col("text"), given, endings), F.col("text")))
    return texts.withColumn("masked", F.coalesce(touched, F.col("text")))
