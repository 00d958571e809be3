"""Text normalisation as column expressions (no Python in any of them).

Java's classes are ASCII unless (?U) is set; every pattern that must see Vietnamese letters sets it.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moderata.config import DEFAULT, Settings

# Characters written for letters.
LEET = {"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "|": "i"}
# Digits written as words, in English and Vietnamese.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "khong": "0", "mot": "1", "hai": "2", "ba": "3", "bon": "4", "nam": "5", "sau": "6", "bay": "7", "tam": "8", "chin": "9", "k0": "0",
}
# English words whose "ow" stays.
OW_WORDS = (
    "below", "how", "now", "low", "show", "grow", "slow", "down", "town", "brown", "flower", "power", "allow", "window", "yellow", "shadow", "row", "blow", "snow",
    "throw", "crow", "know", "bow", "cow", "own", "owner", "ownership", "showing", "growing", "knowing", "lower", "lowest",
)
# Profanity by tier, as it is searched.
PROFANE_WORDS = ("cặc", "lồn", "địt", "đéo", "buồi", "chó đẻ", "khốn nạn", "mất dạy", "cức", "cứk")
PROFANE_PATTERNS = (
    r"\bcon\s*cac\b", r"\bcon\s*kac\b", r"\bcon\s*cak\b", r"\bcon\s*cax\b", r"\bkac\b", r"\bcak\b", r"\bcax\b", r"\bcon\s*cko(?:['’`]?s)?\b", r"\bloz\b", r"\blozl\b", r"\bl0n\b", r"\bdjt\b",
    r"\bdit\s*me\b", r"\bdit\s*cu\b", r"\bdit\s*con\b", r"\bde0\b", r"\bcho\s*de\b", r"\bdo\s*con\s*cho\b", r"\bdmm\b", r"\bdcm\b", r"\bclm\b", r"\bclmm\b", r"\ban\s*cuc\b", r"\ban\s*cuk\b", r"\bcuc\s*cut\b", r"\bnhu\s*cuc\b",
)
SPACED_PHRASES = (("con", "cac"), ("con", "kac"), ("con", "cak"), ("con", "cax"), ("cho", "de"))
SPACED_WORDS = ("kac", "cak", "cax", "djt")
# Accents typed as signs after a vowel, tone marks after an apostrophe, and words spelled out letter by letter.
TYPED_ACCENTS = (r"(?<=[eoa])\^", r"(?<=[oua])\+", r"(?<=[oua])\*")
TONE_SUFFIX = r"['`][sfrxj1-589]\b"
TONE_DIGIT = r"(?<=[a-zA-Z])[1-589]\b"
SPELLED_GUN, SPELLED_PHONE = r"\bg\s+un\b", r"\bs\s+d\s+t\b"
SINGLE_LETTERS = r"\b([a-hj-np-z0-9])\s+([a-hj-np-z0-9])\b"


def _ranges(codes: list[int]) -> str:
    """The codes as the inside of a character class."""
    starts = [c for c in codes if c - 1 not in (known := set(codes))] if codes else []
    name = lambda c: chr(c) if c > 0xFF else rf"\x{{{c:X}}}"
    return "".join(f"{name(a)}-{name(b)}" for a, b in ((a, next(c for c in range(a, 0x110001) if c not in known) - 1) for a in starts))


def _longest(codes: list[int], n: int = 6) -> str:
    """The n longest ranges among the codes, as the inside of a character class: a first look that settles nearly every character.

    Java asks the parts of a class one by one, so that a class of many parts is dear for each character of a text.
    """
    runs = [[c for _, c in g] for _, g in itertools.groupby(enumerate(sorted(codes)), key=lambda x: x[1] - x[0])]
    return _ranges(sorted(c for run in sorted(runs, key=len)[-n:] for c in run))


def in_lower(letters: str) -> str:
    """A class of these lower-case letters for a text in lower case, in few ranges: a range may run over capitals, which such a text lacks."""
    wanted = {ord(x) for x in letters}
    passed = {c for c in range(min(wanted), max(wanted) + 1) if chr(c).lower() != chr(c)}
    ends = sorted(wanted)
    codes = set(ends).union(*(range(a, b) for a, b in itertools.pairwise(ends) if passed.issuperset(range(a + 1, b))))
    return rf"(?=[^\x00-\x7F])[{_ranges(sorted(codes))}]"


def _decompositions() -> tuple[str, str, str, str]:
    """From the Unicode database: Latin letters with one base letter each, and these; the characters that need no more than that; the combining marks."""
    single, base, enough = [], [], []
    blocks = (range(0x370), range(0x1E00, 0x1F00), range(0x2010, 0x2060), range(0x2600, 0x27C0), range(0xFE00, 0xFE10), range(0x1F300, 0x1FB00))
    for code in (c for block in blocks for c in block):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain == chr(code) or unicodedata.combining(chr(code)):
            enough.append(code)
        elif len(plain) == 1:
            enough.append(code)
            single.append(chr(code))
            base.append(plain)
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    return "".join(single), "".join(base), f"(?=[^{_longest(enough)}])[^{_ranges(enough)}]", f"[{_ranges(marks)}]"


_SINGLE, _BASE, _FURTHER, _MARKS = _decompositions()
_LATIN_MARKS = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: White space that is more or other than one space: all that has to be replaced.
_UNEVEN_SPACE = r"(?U)(?: \s|[\s&&[^ ]])\s*"


def ascii_only(c: Column) -> Column:
    """Whether each character is one byte; it takes no pattern."""
    return F.octet_length(c) == F.length(c)


def has_any(c: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is anywhere in the text: a search for bytes, many times as fast as a pattern.

    c is asked for each word, so it should be a column or a value bound by `let`.
    """
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def short(c: Column) -> Column:
    """Whether a pattern is as cheap as a look ahead of it."""
    return F.octet_length(c) < 256


def replaced(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Pieces of text replaced one after the other. For single characters that no other one becomes it is `translate`, by bytes."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def unleet(c: Column) -> Column:
    """Letters for the characters that are written for them."""
    return let(c, lambda x: F.when(has_any(x, LEET), F.translate(x, "".join(LEET), "".join(LEET.values()))).otherwise(x))


def stripped(c: Column) -> Column:
    """Without white space at the ends; only a text that has some there is searched."""
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return let(c, lambda x: F.when(ends(x).rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x))


def even(c: Column) -> Column:
    """White space in one space each."""

    def by_bytes(x: Column) -> Column:
        rare = "\t\x0b\f\r"
        lines = F.replace(F.when(has_any(x, rare), F.translate(x, rare, " " * len(rare))).otherwise(x), F.lit("\n"), F.lit(" "))
        return let(lines, lambda y: F.when(y.contains("  "), F.regexp_replace(y, " {2,}", " ")).otherwise(y))

    return let(c, lambda x: F.when(ascii_only(x), by_bytes(x)).otherwise(F.regexp_replace(x, _UNEVEN_SPACE, " ")))


def squeeze(c: Column) -> Column:
    """White space in one space each, none at the ends."""
    return F.trim(even(c))


def _alternatives(words: list[str]) -> str:
    """The words as a pattern that tells them apart letter by letter."""
    heads: dict[str, list[str]] = {}
    for word in sorted(words):
        heads.setdefault(word[:1], []).append(word[1:])
    return "|".join(re.escape(head) + (_group(rest) if any(rest) else "") if head else "" for head, rest in sorted(heads.items(), key=lambda x: x[0] == ""))


def _group(rest: list[str]) -> str:
    return rest[0] if len(rest) == 1 else f"(?:{_alternatives(rest)})"


def unmarked(c: Column) -> Column:
    """Compatibility-decomposed, without combining marks.

    Latin letters, punctuation and emoji go by a table; a text with any other character (mathematical, circled, wide,
    ligatures, signs for whole words) is decomposed by the Unicode library that Spark itself sorts text with.
    """

    def either(text: Column) -> Column:
        whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
        by_table = F.translate(text, _SINGLE + _LATIN_MARKS, _BASE)  # what has no letter in its place goes
        return F.when(ascii_only(text), text).when(text.rlike(_FURTHER), F.regexp_replace(whole, _MARKS, "")).otherwise(by_table)

    return let(c, either)


def normalize(c: Column) -> Column:
    """Lower case, letters for look-alikes, no marks, single spaces; punctuation stays. Null is empty."""
    return even(unmarked(_lettered(F.lower(stripped(F.coalesce(c, F.lit("")))))))


def _lettered(lower: Column) -> Column:
    return F.replace(unleet(lower), F.lit("đ"), F.lit("d"))


def numbers_as_digits(c: Column) -> Column:
    """Number words of a normalised text as digits, and neighbouring digits as one number."""
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    mapped = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")
    named = lambda x: let(F.concat(F.lit(" "), x, F.lit(" ")), lambda y: has_any(y, (f" {w} " for w in NUMBER_WORDS)))
    digits = let(c, lambda x: F.when(named(x), mapped(x)).otherwise(x))
    return let(digits, lambda x: F.when(has_any(x, [f" {d}" for d in "0123456789"]), F.regexp_replace(x, r"(\d)\s+(?=\d)", "$1")).otherwise(x))


def clean(c: Column) -> Column:
    """The deep normal form: typed accents and tone suffixes undone, letters and digits only, spelled-out numbers and letters joined.

    Steps that few texts need are behind a look for the characters that they are about.
    """
    return _joined(unmarked(_typed(F.lower(stripped(F.coalesce(c, F.lit("")))))))


def both_forms(c: Column) -> Column:
    """[normalize(c), clean(c)]; what they share stands in the plan once."""
    lower = F.lower(stripped(F.coalesce(c, F.lit(""))))
    plain = let(lower, lambda x: F.transform(F.array(_lettered(x), _typed(x)), unmarked))
    return let(plain, lambda x: F.array(even(x[0]), _joined(x[1])))


def _where(x: Column, words: Iterable[str], step: Callable[[Column], Column]) -> Column:
    return let(x, lambda y: F.when(has_any(y, words), step(y)).otherwise(y))


def _typed(lower: Column) -> Column:
    """The first half of `clean`, of a text in lower case: what is typed for accents undone."""

    def accents(x: Column) -> Column:
        for accent in TYPED_ACCENTS:
            x = F.regexp_replace(x, accent, "")
        return x

    def quotes(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, TONE_SUFFIX, ""), r"(?U)['`](?=\s|$)", "")
        return F.regexp_replace(x, "(?<=[a-zA-Z])['`](?=[a-zA-Z])", "")

    out = _where(lower, "^+*", accents)
    # Words that keep their "ow" are matched whole and put back; from any other word a "w" after o, u or a goes.
    kept = f"(?:{_alternatives(list(OW_WORDS))})(?!\\S)|(?:{_alternatives([w for w in OW_WORDS if len(w) > 3])})\\S*"
    # A word begins behind white space, so that most places fail by one look.
    other = lambda x: F.substr(F.regexp_replace(F.concat(F.lit(" "), x), rf"(?U)(?=[\sw])(?:(\s(?:{kept}))|w(?<=[oua]w))", "$1"), F.lit(2))
    out = _where(out, ("ow", "uw", "aw"), other)
    return _where(replaced(out, (("đ", "d"), ("dd", "d"), ("^", ""), ("+", ""), ("*", ""), ("\\", ""))), "'`", quotes)


def _joined(unmarked: Column) -> Column:
    """The second half of `clean`: letters and digits only, joined where they were spelled out."""
    out = _where(unmarked, "1234589", lambda x: F.regexp_replace(x, TONE_DIGIT, ""))
    out = numbers_as_digits(squeeze(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}\s]", "")))
    out = _where(out, ("g un", "s d t"), lambda x: F.regexp_replace(F.regexp_replace(x, SPELLED_GUN, "gun"), SPELLED_PHONE, "sdt"))
    return F.regexp_replace(out, SINGLE_LETTERS, "$1$2")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def alnum_from(c: Column, n: int) -> Column:
    """Whether the text has n letters or digits; the search ends where it has them."""
    return c.rlike(r"[\p{L}\p{N}]" + r"[^\p{L}\p{N}]*+[\p{L}\p{N}]" * (n - 1))


def blank(c: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def dominance(c: Column) -> Column:
    """The largest share of one character; 0 for an empty text. The characters are sorted once, whatever their number."""
    same = F.regexp_extract_all(F.array_join(F.array_sort(F.split(c, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.when(F.length(c) > 0, F.array_max(F.transform(same, lambda x: F.length(x))) / F.length(c)).otherwise(0.0)


def dominated(c: Column, s: Settings = DEFAULT) -> Column:
    """Whether one character has more than its share of a text that is long enough.

    A character of more than 0.7 of a text beyond 20 characters stands three times in a row somewhere, so that only such ones are counted.
    """
    size = F.length(c)
    if s.dominance_share < 0.7:
        return (size > s.dominance_from) & (dominance(c) > s.dominance_share)
    share = lambda x: (size - F.length(F.replace(c, x, F.lit("")))) / size
    often = F.exists(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)(.)\1\1"), F.lit(1))), lambda x: share(x) > s.dominance_share)
    return F.when(size > F.lit(max(20, s.dominance_from)), often).otherwise((size > s.dominance_from) & (dominance(c) > s.dominance_share))


# The looks ahead settle most characters by one range; no letter is an emoji or joiner, nor is anything else below their first.
_JOINER = r"(?=[^\x00-\x{2FF}\p{L}])[︀-️\x{1F3FB}-\x{1F3FF}‍⃣\p{Mn}\p{Me}]"
_GRAPHEME = rf".(?:{_JOINER}|(?<=‍).)*+"
_NEXT = rf"\1(?!{_JOINER}|(?<=‍).)"
_EMOJI = r"(?=[^\x00-\x7F\p{L}])[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}☀-➿\x{1F000}-\x{1F2FF}[\p{So}\p{Cn}&&[^\x00-\x7F]]]"
#: Where a grapheme begins: behind no joiner of emoji, and at no mark that belongs to the one before.
_START = rf"(?s)(?<!‍)(?:\A|(?!{_JOINER}))"
_EMOJI_RUN = rf"{_START}(?={_EMOJI})({_GRAPHEME})(?:{_NEXT})*+"


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s){_GRAPHEME}"), F.lit(0))


def is_emoji(g: Column) -> Column:
    return g.rlike(f"^{_EMOJI}")


def shortened(c: Column, kept: int = DEFAULT.kept_run) -> Column:
    """The text with runs of equal graphemes cut to `kept`; only runs that are longer are looked at."""
    long = rf"{_START}({_GRAPHEME})(?:{_NEXT}){{{kept},}}+"
    return F.when(c.rlike(rf"(?s)(.)\1{{{kept}}}|{_JOINER}"), F.regexp_replace(c, long, "$1" * kept)).otherwise(c)


def emoji_total(c: Column, kept: int = DEFAULT.kept_run) -> Column:
    """How many emoji are left when runs are cut to `kept`; only runs of emoji are taken out of the text."""

    def total(text: Column) -> Column:
        whole, one = (F.regexp_extract_all(text, F.lit(_EMOJI_RUN), F.lit(k)) for k in (0, 1))
        n = F.zip_with(whole, one, lambda w, g: F.least((F.length(w) / F.length(g)).cast("long"), F.lit(kept).cast("long")))
        return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(c, lambda text: F.when(text.isNull(), F.lit(None).cast("long")).when(text.rlike(_EMOJI), total(text)).otherwise(F.lit(0).cast("long")))


#: What the long way of `sanitized` is for: four equal characters in a row, or any emoji or joiner.
_UNEVEN = rf"(?s)(.)\1{{3}}|{_JOINER}|{_EMOJI}"


def sanitized(c: Column, s: Settings = DEFAULT) -> Column:
    """struct<text, reason>: runs cut to three; or the text as it was, with the reason why it is refused."""
    both = lambda text, reason: F.struct(text.alias("text"), reason.cast("string").alias("reason"))
    more = lambda n: rf"({_GRAPHEME})(?:{_NEXT}){{{n},}}+"
    # The first run beyond its limit; group 1 is the grapheme, so the two kinds are looked for apart and the earlier one counts.
    of_emoji, of_others = rf"{_START}(?={_EMOJI}){more(s.emoji_run_limit)}", rf"{_START}(?!{_EMOJI}){more(s.run_limit)}"

    def judged(text: Column) -> Column:
        emoji, other = (F.regexp_instr(text, F.lit(x)) for x in (of_emoji, of_others))
        run = let(emoji, lambda e: let(other, lambda o: F.when((e > 0) & ((o == 0) | (e < o)), "emoji_run").when(o > 0, "char_run")))
        reason = F.coalesce(run, F.when(emoji_total(text, s.kept_run) > s.emoji_limit, "emoji_total"))
        return let(reason, lambda r: both(F.when(r.isNull(), shortened(text, s.kept_run)).otherwise(text), r))

    # One look settles most texts: no character three times in a row, so none has its share of a longer text, and no emoji.
    thrice = r"(?s)(.)\1\1"
    smooth = ~c.rlike(thrice) & (ascii_only(c) | ~c.rlike(r"[^\x00-\x7F\p{L}]"))
    return (
        F.when(c.isNull() | (c == ""), both(c, F.lit(None)))
        .when((F.lit(s.dominance_share) >= 0.7) & (F.length(c) > max(20, s.dominance_from)) & smooth, both(c, F.lit(None)))
        .when(dominated(c, s), both(c, F.lit("repeat_share")))
        .when(~c.rlike(_UNEVEN), both(c, F.lit(None)))
        .otherwise(let(c, judged))
    )


def _between(words: tuple[str, ...]) -> str:
    return r"[\W_]+".join(r"[\W_]*".join(word) for word in words)


#: The plain patterns behind one look at the letters that they can begin with, so that each place is asked once for its edge.
_WORDED = r"(?U)(?=[" + "".join(sorted({p.removeprefix(r"\b")[0] for p in PROFANE_PATTERNS})) + r"])\b(?:" + "|".join(p.removeprefix(r"\b") for p in PROFANE_PATTERNS) + ")"
_SPACED = r"(?U)(?=[ckd])(?<![a-z0-9])(?:" + "|".join(_between(p) for p in (*SPACED_PHRASES, *((w,) for w in SPACED_WORDS))) + r")(?![a-z0-9])"


def profane(c: Column, plain: Column | None = None, cleaned: bool = False) -> Column:
    """Severe profanity: marked words anywhere, plain and spaced-out spellings between word edges of the normal form.

    plain: the normal form, where it is known. cleaned: the text is a result of `clean`, which has that form up to
    characters written for letters.
    """
    if plain is None:
        plain = unleet(c) if cleaned else normalize(c)
    marked = ~ascii_only(c) & let(F.lower(c), lambda x: has_any(x, PROFANE_WORDS))
    return F.coalesce(marked | let(F.lower(plain), lambda x: x.rlike(_WORDED) | x.rlike(_SPACED)), F.lit(False))


def plain_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]|_", " "))


def request_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def hash_choice(seed: Column, options: list[str]) -> Column:
    """An option that is always the same for a seed."""
    number = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(x) for x in options]), (number % len(options) + 1).cast("int"))
