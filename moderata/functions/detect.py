"""Detectors over texts, and the two prefilters that are made of them. Reasons are short codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.config import DEFAULT, Settings
from moderata.functions import text as T

# What each detector searches for.
URL = r"(?i)https?://|www\.|bit\.ly|tinyurl\.com"
EMAIL = r"(?iU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
# Of a name in parts joined by dots the last part with a letter or digit is enough, and any number of parts of signs behind it.
# These are read in one way only and never given back: a dot in words or after a space with the sign that follows it; any
# other sign; a dot that a sign follows behind spaces. So the loop does what the nested repetition does, in one pass.
_DOT_WORD = r"(?:dot|\[dot\]|\(dot\))"
_SIGN_PARTS = rf"(?:\s*{_DOT_WORD}\s*[.%+-]|\s+\.\s*[.%+-]|[%+-]|\.(?:\s+(?=[.%+-]))?+)*+"
SPELLED_EMAIL = rf"(?iU)\b[a-z0-9._%+-]+{_SIGN_PARTS}\s*(?:at|@|\[at\]|\(at\))\s*[a-z0-9.-]+\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z]{{2,}}\b"
PHONE = r"(?iU)(?<!\w)(?:0|\+84)[35789](?:\s*[0-9]){8}(?!\w)"
PHONE_CANDIDATE = r"(?iU)(?<!\w)(?:\+?84|0)(?:[\s.\-]?\d){8,10}(?!\w)"
LONG_NUMBER = r"(?<!\d)(?:\d[\s.\-]?){9,14}(?!\d)"
BANK_WORDS = r"stk|tk|tai\s*khoan|ngan\s*hang|bank|chuyen\s*khoan|ck"
BANK = rf"(?iU)\b(?:{BANK_WORDS})\b[\s\w:.-]{{0,20}}?\d{{8,16}}\b"
BANK_CUE = rf"(?iU)\b(?:{BANK_WORDS}|so\s*tk|so\s*tai\s*khoan)\b"
SQL_TEXT = r"(?iU)\b(?:SELECT\s+[\s\S]*?\s+FROM|INSERT\s+INTO|UPDATE\s+[\s\S]*?\s+SET|DELETE\s+FROM|DROP\s+TABLE|UNION\s+SELECT)\b"
SOCIAL = (
    r"(?iU)\b(?:follow\s+(?:us\s+|me\s+|my\s+)?(?:on\s+)?(?:instagram|ig|facebook|fb|tiktok|zalo|twitter|x)"
    r"|(?:lh|lien\s*he)\s*(?:qua\s*)?(?:zalo|sdt|fb|ib|tele|mess|viber)"
    r"|ib\s*(?:qua\s*)?(?:zalo|sdt|fb|tele|mess)|zalo\s*(?:lh|lien\s*he|ib|inbox|sdt)|@\w{3,})\b"
)
PROMOTION = r"(?iU)\b(?:click\s+now|click\s+here|free\s+rewards|get\s+free|free\s+gift|nhan\s+thuong\s+ngay|click\s+vao\s+link|nhan\s+thuong\s+lon)\b"
INJECTION = (
    r"(?iU)\b(?:skip\s+all\s+validation|ignore\s+previous\s+rules|bypass\s+rules|internal\s+test|bo\s+qua\s+quy\s+tac\s+kiem\s+duyet"
    r"|bo\s+qua\s+cac\s+quy\s+tac|bo\s+qua\s+rule|khong\s+duoc\s+approved\s+review|khong\s+duoc\s+duyet\s+review|hay\s+xuat\s+ra\s+ket\s+qua|yeu\s+cau\s+xuat\s+ra)\b"
)
PLATFORM = r"(?:tik\s*tok|tiktok|instagram|insta|discord|twitter|x\s*/\s*twitter|x-twitter|x twitter|facebook|fb|messenger|telegram|whatsapp|wechat|line|snapchat)"
INTENT = r"(?iU)\b(?:lien he|lien lac|ib|inbox|nhan tin|message|dm|contact|reach me|find me|add me|follow me|ping me|text me|connect|chat|talk|discuss|ket ban|add|follow|trao doi)\b"
HANDLE = r"(?iU)(?<![\w.])@[A-Za-z0-9][A-Za-z0-9._]{1,31}\b"
DISCORD_TAG = r"(?iU)\b[a-z0-9._]{2,32}#[0-9]{4}\b"
NAME_AFTER = rf"(?iU)\b{PLATFORM}\b.{{0,24}}\b(?:la|is|as|username|user|nick|acc|account|id|handle)\b.{{0,8}}\b([a-z0-9][a-z0-9._]{{2,31}})\b"
NAME_BEFORE = rf"(?iU)\b([a-z0-9][a-z0-9._]{{4,31}})\b\s+(?:tren|on|in|via)\s+{PLATFORM}\b"
CHANNELS = ("mang xa hoi", "ket noi ben ngoai", "social media", "outside the platform", "off platform")
NO_USERNAMES = ("instagram", "tiktok", "discord", "twitter", "facebook", "messenger", "telegram", "whatsapp", "trend", "video", "shop")
KEYBOARD_WALKS = ("qwerty", "qwertyui", "qwertyuiop", "asdfgh", "zxcvbn", "abcxyz")
SOUND_UNITS = ("ha", "hi", "he", "ho", "ki", "ka", "la", "bip", "pim", "tu", "reng", "ding", "boom", "go", "chu", "beo", "o", "a")
BAD_EMOJI = {"🤤": "adult", "🔞": "adult", "🖕": "offensive", "🤬": "offensive", "🔪": "violent", "🚬": "adult", "🍺": "adult", "🍻": "adult", "🍷": "adult", "🍸": "adult"}


#: An address from its "at" on: where nothing like it stands, the pattern that begins with any word needs not be tried.
_AT_ON = r"(?:at|@|\[at\]|\(at\))\s*[a-z0-9.-]+\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z]{2,}\b"


def folded(c: Column) -> Column:
    """Lower case as (?iU) compares it: words of ASCII letters that such a pattern finds are found here by their bytes."""
    return T.replaced(F.lower(F.replace(c, F.lit("İ"), F.lit("i"))), (("ſ", "s"), ("ı", "i")))


def email(c: Column) -> Column:
    """A plain or spelled-out address ("at" also inside a word); the costlier pattern runs only where its parts occur."""
    low = F.lower(c)
    parts = lambda x: T.has_any(x, ("@", "at")) & T.has_any(x, (".", "dot"))
    spelled = c.rlike("(?iU)" + _AT_ON) & c.rlike(SPELLED_EMAIL)
    return F.when(c.contains("@") & c.rlike(EMAIL), True).otherwise(T.let(low, lambda x: F.when(parts(x), spelled).otherwise(False)))


def phone_like(token: Column) -> Column:
    """Whether a candidate has 9 or 10 digits behind its prefix."""
    rest = F.regexp_replace(F.regexp_replace(token, r"[ .\-]", ""), r"^(?:\+84|84|0)", "")
    return token.rlike(r"^\s*(?:\+?84|0)") & rest.rlike(r"^\d{9,10}$")


def many_digits(c: Column) -> Column:
    """Whether eight digits stand together, up to one sign or space between them: less than any phone or account number."""
    digit = F.when(T.ascii_only(c), T.has_any(c, "0123456789")).otherwise(True)
    return digit & c.rlike(r"(?U)\d(?:[\s.\-]?\d){7}")


def phone_candidate(c: Column) -> Column:
    return F.when(many_digits(c), F.exists(F.regexp_extract_all(c, F.lit(PHONE_CANDIDATE), F.lit(0)), phone_like)).otherwise(F.when(c.isNotNull(), False))


def bank_number(c: Column, plain: Column | None = None) -> Column:
    """A group of 9 to 14 digits that is no phone number, with a cue in the text or a separator in it."""
    cue = (T.normalize(c) if plain is None else plain).rlike(BANK_CUE)

    def suits(token: Column) -> Column:
        digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
        return digits.between(9, 14) & ~phone_like(token) & (cue | F.trim(token).rlike(r"[ .\-]"))

    return F.when(many_digits(c), F.exists(F.regexp_extract_all(c, F.lit(LONG_NUMBER), F.lit(0)), suits)).otherwise(F.when(c.isNotNull(), False))


def address(c: Column) -> Column:
    """Several comma-parted segments with enough letters, words and numbers."""
    segments = F.filter(F.transform(F.split(c, r"[,\n]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def judged(snippet: Column) -> Column:
        numbers = F.regexp_extract_all(snippet, F.lit(r"\d{1,6}"), F.lit(0))
        deep = T.let(numbers, lambda n: (F.size(n) >= 2) | F.exists(n, lambda x: F.length(x) >= 5))
        words = F.size(F.filter(F.split(snippet, r"(?U)\s+"), lambda x: x != ""))
        letters = F.length(F.regexp_replace(snippet, r"\P{L}", ""))
        return (letters >= 12) & (words >= 5) & deep

    def whole(segments: Column) -> Column:
        snippet = F.array_join(F.slice(segments, 1, 4), ", ")
        return (F.size(segments) >= 2) & F.exists(segments, lambda x: x.rlike("[A-Za-z]") & x.rlike(r"\d")) & T.let(snippet, judged)

    given = T.has_any(c, ",\n") & T.has_any(c, "0123456789")
    return F.when(given, T.let(segments, whole)).otherwise(given)


#: Each of these patterns has one of the words.
_URL_HAS = ("://", "www.", "bit.ly", "tinyurl.com")
_SQL_HAS = ("select", "insert", "update", "delete", "drop", "union")
_SOCIAL_HAS = ("follow", "zalo", "@", "sdt", "fb", "tele", "mess", "viber", "lh", "lien")
_PROMOTION_HAS = ("click", "free", "nhan")
_INJECTION_HAS = ("validation", "ignore", "bypass", "internal", "quy", "rule", "duoc", "xuat")
_PLATFORM_HAS = ("tik", "insta", "discord", "twitter", "facebook", "fb", "messenger", "telegram", "whatsapp", "wechat", "line", "snapchat")


def sensitive(c: Column) -> Column:
    """The first sensitive pattern of a review, or null. Patterns are tried where the words or digits are that they can't do without."""

    def worded(low: Column) -> Column:
        words = T.has_any(low, (*_SQL_HAS, *_SOCIAL_HAS, *_PROMOTION_HAS, *_INJECTION_HAS))
        return F.when(words, F.when(c.rlike(SQL_TEXT), "sql").when(c.rlike(SOCIAL), "social").when(c.rlike(PROMOTION), "promotion").when(c.rlike(INJECTION), "injection"))

    digits = c.rlike(r"(?U)\d(?:\s*\d){7}")
    numbered = F.when(digits, F.when(c.rlike(PHONE), "phone").when(c.rlike(BANK), "bank"))
    return T.let(folded(c), lambda low: F.coalesce(F.when(T.has_any(low, _URL_HAS) & c.rlike(URL), "url").when(email(c), "email"), numbered, worded(low)))


def username_like(token: Column) -> Column:
    low = F.lower(F.trim(token))
    return (low != "") & ~low.rlike(r"^\d+$") & ~low.isin(*NO_USERNAMES) & (low.rlike(r"[_.\d]") | (F.length(low) >= 9))


def social_contact(c: Column, plain: Column | None = None) -> Column:
    """How a comment asks for contact elsewhere (a code), or null."""
    def judged(plain: Column) -> Column:
        platform = T.let(folded(plain), lambda x: (T.short(x) | T.has_any(x, _PLATFORM_HAS)) & plain.rlike(rf"(?iU)\b{PLATFORM}\b"))
        channel = T.has_any(plain, CHANNELS)
        named = lambda pattern: F.exists(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), username_like)
        return (
            F.when(c.contains("@") & c.rlike(HANDLE), "social_handle")
            .when(c.contains("#") & plain.contains("discord") & c.rlike(DISCORD_TAG), "discord_tag")
            .otherwise(T.let(platform, lambda on: F.when((on | channel) & plain.rlike(INTENT), "social_intent").when(on & (named(NAME_AFTER) | named(NAME_BEFORE)), "social_username")))
        )

    return T.let(T.normalize(c) if plain is None else plain, judged)


def repeated_unit(token: Column) -> Column:
    """unit x k with a unit of 1 to 4 characters, k >= 3 and 6 characters or more; the shortest unit is no sound word."""
    unit = F.regexp_extract(token, r"^(.{1,4}?)\1{2,}$", 1)
    return (F.length(token) >= 6) & (unit != "") & ~unit.isin(*SOUND_UNITS)


def gibberish_token(token: Column) -> Column:
    cluster = F.array_max(F.transform(F.regexp_extract_all(token, F.lit("[^aeiouy]+"), F.lit(0)), lambda x: F.length(x)))
    vowels = F.length(F.regexp_replace(token, "[^aeiouy]", ""))
    cluster = F.coalesce(cluster, F.lit(0))
    return (F.length(token) >= 6) & ((cluster >= 5) | ((cluster >= 4) & (vowels / F.length(token) <= 0.30)) | (vowels == 0))


#: Words of six letters and more with four consonants in a row, which no other gibberish token lacks; and words of four letters and more.
_CLUSTERED = r"(?=[a-z])(?<![a-z0-9])(?=[a-z]*?[b-df-hj-np-tv-xz]{4})[a-z]{6,}+(?![0-9])"
_MEDIUM = r"[a-z](?<![a-z0-9].)[a-z]{3,}+(?![0-9])"


def meaningless(c: Column, plain: Column | None = None) -> Column:
    """Why a comment says nothing (a code), or null."""

    def judged(plain: Column, tokens: Column, distinct: Column) -> Column:
        compact = F.regexp_replace(plain, r"(?U)\s+", "")
        most = F.array_max(F.transform(distinct, lambda d: F.size(F.filter(tokens, lambda t: t == d))))
        short = F.forall(distinct, lambda d: F.length(d) <= 8)
        phrase = (F.size(tokens) >= 3) & short & ((F.size(distinct) == 1) | ((F.size(tokens) >= 4) & (F.size(distinct) <= 2) & (most / F.size(tokens) >= 0.75)))
        only = F.get(tokens, F.lit(0))
        lone = (F.size(tokens) == 1) & (F.length(only) >= 4) & (only.isin(*KEYBOARD_WALKS) | only.rlike(r"^(.)\1{5,}$") | repeated_unit(only))
        return (
            F.when(compact == "", F.lit(None))
            .when(compact.rlike(r"(?U)^[\W_]{4,}$"), "symbols_only")
            .when(phrase, "repeated_phrase")
            .when(lone, "junk_token")
        )

    def gibberish(plain: Column) -> Column:
        # Two odd words have the twelve letters that are asked for; there are no more of them than clusters.
        odd = F.size(F.filter(F.regexp_extract_all(plain, F.lit(_CLUSTERED), F.lit(0)), gibberish_token))
        enough = lambda n, medium: (n >= 2) & (n / medium >= 0.6)
        judged = lambda n, medium: (medium > 0) & enough(n, medium) & enough(odd, medium)
        clusters = F.regexp_count(plain, F.lit("[b-df-hj-np-tv-xz]{4,}+"))
        return T.let(clusters, lambda n: (n >= 2) & T.let(F.regexp_count(plain, F.lit(_MEDIUM)), lambda medium: judged(n, medium)))

    def either(plain: Column) -> Column:
        """Three different words at its beginning, each with an end in sight, settle that a text is no symbols, phrase or lone token."""
        many = F.size(F.array_distinct(F.regexp_extract_all(F.substring(plain, 1, 200), F.lit("[a-z0-9]++(?=.)"), F.lit(0)))) > 2
        tokens = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
        whole = T.let(tokens, lambda tokens: T.let(F.array_distinct(tokens), lambda distinct: judged(plain, tokens, distinct)))
        return F.coalesce(F.when(~many, whole), F.when(gibberish(plain), "gibberish"))

    return T.let(T.normalize(c) if plain is None else plain, either)


def bad_emoji(c: Column) -> Column:
    """The category of blocked emoji that dominate a comment without other words, or null."""
    anyof = "[" + "".join(BAD_EMOJI) + "]"
    of = lambda kind: c.rlike("[" + "".join(e for e, k in BAD_EMOJI.items() if k == kind) + "]")
    kind = F.when(of("violent"), "violent").when(of("offensive"), "offensive").otherwise("adult")

    def judged(tokens: Column) -> Column:
        hits = F.length(c) - F.length(F.regexp_replace(c, anyof, ""))
        meaning = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.length(t))
        visible = F.length(F.regexp_replace(c, r"(?U)\s", ""))
        dominant = (F.size(tokens) == 0) | (hits >= F.greatest(F.lit(2), F.size(tokens))) | (hits * 3 >= F.greatest(F.lit(1), visible))
        return F.when((F.size(tokens) < 4) & (meaning < 16) & dominant, kind)

    tokens = F.regexp_extract_all(T.normalize(F.regexp_replace(c, anyof, " ")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(T.has_any(c, BAD_EMOJI), T.let(tokens, judged))


#: The columns of the stages; each is used more than once, so the optimizer keeps them apart.
_STAGES = ("_first", "_why", "_body", "_plain", "_clean", "_empty", "_emoji", "_social")


def _staged(df: DataFrame, column: str, s: Settings) -> DataFrame:
    """The row with the sanitised text and why it is refused, each computed once."""
    # Packed in an array: the optimizer would take a struct apart and compute it once for each field.
    df = df.withColumn("_first", F.array(T.sanitized(F.col(column), s)))
    first = F.element_at("_first", 1)
    return df.withColumn("_why", first["reason"]).withColumn("_body", first["text"])


def _without_stages(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in _STAGES])


def with_review_reason(df: DataFrame, column: str, name: str, s: Settings = DEFAULT) -> DataFrame:
    """A column that says why a review text is rejected before any model sees it (a code), or null."""
    body = F.col("_body")

    def both(forms: Column) -> Column:
        """The text and its deep form under the same rules, which stand in the plan once."""
        plain, x = forms[0], forms[1]
        pairs = F.array(F.struct(body.alias("c"), plain.alias("p")), F.struct(x.alias("c"), T.unleet(x).alias("p")))
        first = F.aggregate(F.array(body, x), F.lit(None).cast("string"), lambda found, c: F.coalesce(found, sensitive(c)))
        return F.when(F.exists(pairs, lambda v: T.profane(v["c"], v["p"])), "profanity").otherwise(first)

    df = _staged(df, column, s)
    reason = (
        F.when(F.col("_why").isNotNull(), F.col("_why"))
        .when(T.blank(body), "empty")
        .when(~T.alnum_from(body, 2), "too_short")
        .when((body != F.col(column)) & T.dominated(body, s), "repeat_share")
        .otherwise(T.let(T.both_forms(body), both))
    )
    return _without_stages(df.withColumn(name, reason))


def with_comment_verdict(df: DataFrame, column: str, name: str, s: Settings = DEFAULT) -> DataFrame:
    """A column struct<category, reason> of a rejected comment, or null."""
    body, plain = F.col("_body"), F.col("_plain")
    # The normal form is a stage of its own, which four rules share.
    df = _staged(df, column, s).withColumn("_plain", T.normalize(body))
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    verdict = lambda category, reason: F.struct(as_column(category).alias("category"), as_column(reason).alias("reason"))
    named = lambda category, reason: T.let(reason, lambda x: F.when(x.isNotNull(), verdict(category, x)))
    found = (
        F.when(F.col("_why").isNotNull(), verdict("spam", F.col("_why")))
        .when(T.blank(body), verdict("spam", "empty"))
        .when((body != F.col(column)) & T.dominated(body, s), verdict("spam", "repeat_share"))
        .otherwise(F.coalesce(
            named("spam", meaningless(body, plain)),
            T.let(bad_emoji(body), lambda x: F.when(x.isNotNull(), verdict(x, "bad_emoji"))),
            F.when(T.let(folded(body), lambda x: T.has_any(x, _URL_HAS)) & body.rlike(URL), verdict("spam", "url")),
            named("spam", social_contact(body, plain)),
            F.when(email(body), verdict("privacy", "email"))
            .when(phone_candidate(body), verdict("privacy", "phone"))
            .when(bank_number(body, plain), verdict("privacy", "bank"))
            .when(address(body), verdict("privacy", "address"))
            .when(T.profane(body, plain), verdict("offensive", "profanity")),
        ))
    )
    return _without_stages(df.withColumn(name, found))
