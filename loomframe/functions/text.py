"""Text and name functions, column to column. Missing text is the empty string throughout."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide what counts as a name, a credential or a particle.
PARTICLES = [
    "van", "von", "de", "del", "della", "der", "den", "da", "dos", "das", "di", "du", "la", "le",
    "bin", "al", "el", "ibn", "ten", "ter", "st", "st.", "y",
]
CREDENTIALS = (
    r"ph\.?\s?d\.?|m\.?d\.?|m\.?s\.?c?\.?|d\.?v\.?m\.?|d\.?d\.?s\.?|j\.?d\.?|mba|m\.?p\.?h\.?|"
    r"p\.?e\.?|r\.?n\.?|dnp|aprn|cpa|faia|fasla|fasce|asla|aia|leed ap|esq\.?|jr\.?|sr\.?|ii|iii|iv"
)
STOP_WORDS = """
faculty staff department departments read more profile profiles contact students student graduate undergraduate
news events research about home people directory office center centre institute college school university
program programs page view all emeriti emeritus visit website email phone apply give login search menu skip main
content publications courses lab laboratory team group members alumni postdoctoral scholars lecturers professors
professor associate assistant adjunct sciences science studies engineering health medicine education florida
gainesville ufl uf ifas academic academics resources information services support careers jobs opportunities
administration administrative leadership board committee committees advisory council chair director dean provost
learn full bio biography cv curriculum vitae click here next previous back top explore welcome overview
mission history facts contacts location locations map directions parking calendar giving donate partners
sponsors funding grants awards honors stories video videos gallery photos
""".split()
SMALL_WORDS = ["and", "of", "in", "for", "the", "to", "on", "a"]
_LETTERS = "A-Za-zÀ-ÿ"


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks: the characters that become one character or none, what the first
    of them become, and those that become several. Hangul syllables are left to arithmetic."""
    one, plain, none, several = [], [], [], {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base == "":
            none.append(chr(code))
        elif len(base) > 1:
            several[chr(code)] = base
        elif base != chr(code):
            one.append(chr(code))
            plain.append(base)
    return "".join(one + none), "".join(plain), several


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it: a lambda over a one-element array.

    Without it, functions that use their argument several times multiply into huge expressions when they are nested.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(col: Column) -> Column:
    """The text, or null where it is empty or null."""
    return F.nullif(col, F.lit(""))


@cache
def _growing() -> str:
    """A pattern of the characters that decompose into several, as ranges: a plan holds it once for each fold, so it is kept short."""
    ranges: list[list[int]] = [[0xAC00, 0xD7A3]]
    for code in sorted(map(ord, _foldings()[2])):
        if ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def fold(col: Column) -> Column:
    """Lower-cased compatibility decomposition without combining marks, in a time linear in the text."""

    def folded(t: Column) -> Column:
        one, plain, _ = _foldings()
        return F.translate(F.when(F.regexp_like(t, F.lit(_growing())), _expanded(t)).otherwise(t), one, plain)

    return let(F.coalesce(col, F.lit("")), lambda t: F.lower(F.when(F.regexp_like(t, F.lit("[^\\x00-\\x7F]")), folded(t)).otherwise(t)))


def fold_each(arr: Column) -> Column:
    """``fold`` of every element (null: empty), all of them at once: joined by a character that they are cleared of, folded, and split again."""
    cleared = F.transform(arr, lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a")))
    parts = F.split(fold(F.array_join(cleared, "\u0001")), "\u0001", -1)
    folded = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002")))
    return F.when(F.size(arr) <= 0, arr.cast("array<string>")).otherwise(folded)


def _expanded(t: Column) -> Column:
    """Every character that decomposes into several, decomposed; the others as they are.

    Each different one is replaced in the whole text; a text with Hangul, which has many, goes character by character.
    """
    several = _foldings()[2]
    # Bound once, as a plan would hold the table wherever it is mentioned.
    every = F.from_json(F.lit(json.dumps(several, ensure_ascii=False)), "map<string,string>")
    leads, vowels, tails = ("".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def letter(c: Column, known: Column) -> Column:
        place = F.ascii(c) - 0xAC00
        at = lambda letters, i: F.substring(F.lit(letters), (i + 1).cast("int"), F.lit(1))
        tail = F.when(place % 28 > 0, at(tails, place % 28 - 1)).otherwise("")
        syllable = F.concat(at(leads, F.floor(place / 588)), at(vowels, F.floor(place % 588 / 28)), tail)
        return F.when(place.between(0, 11171), syllable).otherwise(F.coalesce(known[c], c))

    def expanded(known: Column) -> Column:
        different = F.filter(F.array_distinct(F.split(F.regexp_replace(t, "[\\x00-\\x7F]+", ""), "")), lambda c: known[c].isNotNull())
        each = F.aggregate(different, t, lambda text, c: F.replace(text, c, known[c]))
        return F.when(F.regexp_like(t, F.lit("[\uac00-\ud7a3]")), F.array_join(F.transform(F.split(t, ""), lambda c: letter(c, known)), "")).otherwise(each)

    return let(every, expanded)


def squash(col: Column) -> Column:
    """Runs of white space, no-break spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


def strip(col: Column, chars: str) -> Column:
    """Without any of ``chars`` (a regex class body) at either end."""
    return F.regexp_replace(col, f"^[{chars}]+|[{chars}]+$", "")


def clean_name(col: Column) -> Column:
    t = F.regexp_replace(squash(col), r"\b(?:nbsp|amp);?", " ")
    t = F.regexp_replace(t, "[\"“”][^\"“”]*[\"“”]", " ")
    t = strip(squash(t), r" ,;|\-–—:")
    t = F.regexp_replace(t, r"(?i)^(dr|prof|professor|mr|mrs|ms|mx)\.?\s+", "")
    t = squash(F.regexp_replace(t, r"\s*\([^)]*\)\s*", " "))
    trailing = rf"(?i)(?:,|\s)\s*(?:{CREDENTIALS})(?:\s*,\s*(?:{CREDENTIALS}))*\.?\s*$"
    for _ in range(2):
        t = strip(F.regexp_replace(t, trailing, ""), " ,;")
    return t


def _words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def looks_like_name(col: Column) -> Column:
    return F.coalesce(let(clean_name(col), _is_name), F.lit(False))


def _letters(w: Column) -> Column:
    return F.length(F.regexp_replace(w, f"[^{_LETTERS}]", ""))


def _is_name(t: Column) -> Column:
    comma = F.contains(t, F.lit(","))
    two_sides = F.regexp_like(t, F.lit(r"^\s*[^\s,][^,]*,\s*[^\s,][^,]*$"))
    shape = (t != "") & (F.length(t) <= 60) & ~F.regexp_like(t, F.lit(r"[\d@/:_=#|]")) & (~comma | two_sides)

    def words_fit(words: Column) -> Column:
        edge = F.when(comma, F.get(words, F.lit(0))).otherwise(F.element_at(words, -1))
        long_enough = F.exists(words, lambda w: _letters(w) >= 2) & ((F.size(words) >= 3) | (_letters(edge) >= 2))
        return F.size(words).between(2, 5) & long_enough & F.forall(words, _is_name_word)

    return shape & let(_words(F.regexp_replace(t, ",", " ")), words_fit)


def _is_name_word(word: Column) -> Column:
    def fits(base: Column) -> Column:
        low = F.lower(base)
        cased = F.regexp_like(base, F.lit(r"^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.\-]*$"))
        return ~low.isin(STOP_WORDS) & (low.isin(PARTICLES) | cased)

    return let(strip(word, ".,"), fits)


def display_name(col: Column) -> Column:
    """'Last, First M.' turned round at the first comma; otherwise the cleaned name."""
    return squash(F.regexp_replace(clean_name(col), "^([^,]*),(.*)$", "$2 $1"))


def name_tokens(col: Column) -> Column:
    return tokens_of(fold(display_name(col)))


def tokens_of(folded: Column) -> Column:
    """The tokens of a displayed name that is folded already."""
    parts = F.transform(F.split(folded, r"\s+"), lambda w: strip(w, ".'’"))
    return F.filter(parts, lambda w: w != "")


def last_of(tokens: Column) -> Column:
    """The last token and the particles before it, which may take in the first token."""
    particle = "|".join(p.replace(".", r"\.") for p in PARTICLES)
    return F.regexp_extract(F.array_join(tokens, " "), rf"((?:(?:{particle}) )*\S+)$", 1)


def last_name(col: Column) -> Column:
    return last_of(name_tokens(col))


def first_name(col: Column) -> Column:
    return F.coalesce(F.get(name_tokens(col), F.lit(0)), F.lit(""))


def name_key(col: Column) -> Column:
    return key_of(fold(display_name(col)))


def key_of(folded: Column) -> Column:
    """``name_key`` of a displayed name that is folded already."""
    return let(tokens_of(folded), lambda t: F.trim(F.concat_ws(" ", F.coalesce(F.get(t, F.lit(0)), F.lit("")), last_of(t))))


def initials(col: Column) -> Column:
    first_two = F.slice(_words(F.coalesce(col, F.lit(""))), 1, 2)
    return F.upper(F.array_join(F.transform(first_two, lambda w: F.left(w, F.lit(1))), ""))


def strip_dept(col: Column) -> Column:
    n = F.regexp_replace(squash(unescape(col)), r"\s*&\s*", " and ")
    n = F.regexp_replace(n, r"(?iu)^(the\s+)?department of\s+", "")
    return squash(F.regexp_replace(n, r"(?iu)[\s,]+department$", ""))


def dept_key(col: Column) -> Column:
    return plain_key(strip_dept(col))


def plain_key(plain: Column) -> Column:
    """``dept_key`` of what ``strip_dept`` has made."""
    return F.trim(F.regexp_replace(fold(plain), "[^a-z0-9]+", " "))


def norm_unit(col: Column) -> Column:
    s = F.regexp_replace(fold(col), "&", " and ")
    s = F.regexp_replace(s, r"\b(department|dept|school|college|division|program|of|the)\b", " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


@cache
def _entities() -> tuple[str, str, str]:
    """Named references and their texts as JSON, a pattern of the names that need no semicolon, and what odd code points stand for."""
    from html.entities import html5

    odd = {n: chr(n) for n in range(0x80, 0xA0)}
    for n in odd:
        try:
            odd[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    bare = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    return json.dumps(html5), "^(?:" + "|".join(bare) + ")", json.dumps({0: "\ufffd", 0x0D: "\r", **odd})


def unescape(col: Column) -> Column:
    """All HTML character references resolved, named ones with or without their semicolon, and numeric ones, as browsers do."""
    names, bare, odd = _entities()
    known, odd_points = F.from_json(F.lit(names), "map<string,string>"), F.from_json(F.lit(odd), "map<string,string>")

    def char(code: Column) -> Column:
        outside = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        silent = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        spelled = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(odd_points[code.cast("string")], F.when(outside, "\ufffd").when(silent, "").otherwise(spelled))

    def reference(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^#[xX]?([0-9a-fA-F]+)", 1)
        code = F.when(F.regexp_like(piece, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        number = F.concat(let(code, char), F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))
        after = lambda name: F.concat(known[name], F.substring(piece, F.length(name) + 1, F.lit(1 << 30)))
        named = F.coalesce(
            let(F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0), after), let(F.regexp_extract(piece, bare, 0), after), F.concat(F.lit("&"), piece)
        )
        return F.when(F.regexp_like(piece, F.lit("^#(?:[0-9]|[xX][0-9a-fA-F])")), number).otherwise(named)

    def resolved(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(reference(p)))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return let(F.coalesce(col, F.lit("")), resolved)


def known_references(html: Column, known: str) -> Column:
    """HTML in which only the references that ``known`` names (regex alternatives, after the &) count; all others read as they are written."""
    return F.regexp_replace(html, f"&(?!{known})", "&amp;")


def uid(*parts: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of the parts, joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def program(col: Column) -> Column:
    """Degree programme; any text with 'ph' counts as PhD, and any that begins with b as Undergraduate."""
    return let(
        fold(col),
        lambda t: F.when(F.regexp_like(t, F.lit("ph|doctor")), "PhD")
        .when(F.regexp_like(t, F.lit(r"^m\.?s|master")), "MS")
        .when(F.contains(t, F.lit("postdoc")), "Postdoc")
        .when(F.contains(t, F.lit("undergrad")) | F.startswith(t, F.lit("b")), "Undergraduate")
        .otherwise(""),
    )


def split_advisors(col: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), r"\([^)]*\)", " "), r"\bamp;", "&")
    return F.filter(F.transform(F.split(t, r"\s*(?:&|/|;|\band\b|\+|,)\s*"), squash), lambda p: F.length(p) >= 2)


def slug_to_phrase(col: Column) -> Column:
    words = F.filter(F.split(F.translate(F.coalesce(col, F.lit("")), "_", "-"), "-+"), lambda w: w != "")

    def cased(w: Column, i: Column) -> Column:
        small = (i > 0) & F.array_contains(F.lit(SMALL_WORDS), w)
        return F.when(small, w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20))))

    return F.array_join(F.transform(words, cased), " ")


def ordered_distinct(arr: Column, keys: Column | None = None) -> Column:
    """Elements whose key (of ``keys``, at the same place; the element itself by default) has not come before, in order.

    Sorted by key and place, the first of each key, sorted back by place.
    """

    def once(rows: Column) -> Column:
        first = F.filter(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["k"] != r["k"]))
        return F.transform(F.sort_array(F.transform(first, lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])

    paired = F.zip_with(arr, arr if keys is None else keys, lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    return let(F.sort_array(F.transform(paired, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["x"].alias("x")))), once)


def fold_distinct(arr: Column) -> Column:
    return let(arr, lambda a: ordered_distinct(a, fold_each(a)))


def has_course_code(col: Column) -> Column:
    return F.regexp_like(col, F.lit(r"\b[A-Z]{3,4}\s?\d{4}[A-Z]?\b"))


def to_csv_line(*cells: Column) -> Column:
    """Every cell quoted, quotes doubled, null as empty."""
    quote = F.lit('"')
    return F.concat_ws(",", *[F.concat(quote, F.replace(F.coalesce(c.cast("string"), F.lit("")), quote, F.lit('""')), quote) for c in cells])


def count_text(col: Column) -> Column:
    """A number with thousands separators; null as 0."""
    return F.format_number(F.coalesce(col, F.lit(0)), 0)


def date_text(col: Column) -> Column:
    """A moment as 'Oct 10, 2026, 3:04 PM' in the session's time zone; 'Never' where there is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(col), "MMM d, yyyy, h:mm a"), F.lit("Never"))
