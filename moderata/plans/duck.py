"""The text rules once more, as DuckDB SQL, to check the column expressions by.

DuckDB's regular expressions have neither look-around nor back-references and see ASCII only in `\\w`, `\\b`, `\\s`. So
patterns run on a text whose other letters are one capital and whose other signs are `~` (the patterns are lower case
then), edges are matched with their neighbours, and repetition is found by string functions.
"""

from __future__ import annotations

import re

from moderata.config import DEFAULT
from moderata.functions import detect as D
from moderata.functions import text as T
from moderata.operators import blog as B
from moderata.operators import verdicts as V

SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_EDGES = {r"(?<!\w)": r"(?:^|\W)", r"(?!\w)": r"(?:\W|$)", r"(?<![\w.])": r"(?:^|[^\w.])", r"(?<!\d)": r"(?:^|\D)", r"(?!\d)": r"(?:\D|$)", "(?<![a-z0-9])": "(?:^|[^a-z0-9])", "(?![a-z0-9])": "(?:[^a-z0-9]|$)"}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def inside(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def pattern(java: str) -> str:
    """A pattern for `plain` texts, as a SQL literal."""
    out = re.sub(r"^\(\?[iU]+\)", "", java)
    for look, edge in _EDGES.items():
        out = out.replace(look, edge)
    return quoted(re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), out))


def plain(c: str) -> str:
    """Lower case with ASCII only: other spaces a space, other letters and digits Q, other signs ~."""
    spaced = f"regexp_replace(lower({c}), '[\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({spaced}, '[^\\x00-\\x7F{_WORD}]', '~', 'g'), '[^\\x00-\\x7F]', 'Q', 'g')"


def has(c: str, java: str) -> str:
    return f"regexp_matches({c}, {pattern(java)})"


def squeezed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def stripped(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


def normal(c: str) -> str:
    return f"regexp_replace(replace(strip_accents(replace(translate(lower({stripped(c)}), '{''.join(T.LEET)}', '{''.join(T.LEET.values())}'), 'đ', 'd')), 'đ', 'd'), '{SPACE}+', ' ', 'g')"


def digits(c: str) -> str:
    """Number words as digits, neighbours joined."""
    cases = " ".join(f"when {quoted(w)} then '{d}'" for w, d in T.NUMBER_WORDS.items())
    out = f"array_to_string(list_transform(string_split({c}, ' '), lambda w: case w {cases} else w end), ' ')"
    for _ in range(2):
        out = f"regexp_replace({out}, '([0-9])\\s+([0-9])', '\\1\\2', 'g')"
    return out


def clean(c: str) -> str:
    out = f"lower({stripped(c)})"
    for a, b in (("[eoa]", r"\^"), ("[oua]", r"\+"), ("[oua]", r"\*")):
        out = f"regexp_replace({out}, '({a}){b}', '\\1', 'g')"
    kept = "^(?:" + "|".join(T.OW_WORDS) + ")$|^(?:" + "|".join(w for w in T.OW_WORDS if len(w) > 3) + ")"
    out = f"array_to_string(list_transform(string_split({squeezed(out)}, ' '), lambda w: case when regexp_matches(w, '{kept}') then w else regexp_replace(w, '([oua])w', '\\1', 'g') end), ' ')"
    out = f"regexp_replace(replace(replace({out}, 'đ', 'd'), 'dd', 'd'), '[\\^+*\\\\]', '', 'g')"
    out = f"regexp_replace({out}, '[''`][sfrxj1-589]([^{_WORD}]|$)', '\\1', 'g')"
    out = f"regexp_replace({out}, '[''`]({SPACE}|$)', '\\1', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '([a-zA-Z])[''`]([a-zA-Z])', '\\1\\2', 'g')"
    out = f"regexp_replace(strip_accents({out}), '([a-zA-Z])[1-589]([^{_WORD}]|$)', '\\1\\2', 'g')"
    out = digits(squeezed(f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}{SPACES}]', '', 'g')"))
    out = f"replace({out}, ' ', '  ')"  # every edge has a space of its own
    for java, word in ((r"g\s+un", "gun"), (r"s\s+d\s+t", "sdt")):
        out = f"regexp_replace({out}, '(^|\\s){java}(\\s|$)', '\\1{word}\\2', 'g')"
    one = "[a-hj-np-z0-9]"
    return squeezed(f"regexp_replace({out}, '(^|\\s)({one})\\s+({one})(\\s|$)', '\\1\\2\\3\\4', 'g')")


def profane(c: str, n: str) -> str:
    """c: the text; n: the plain form of its normal form."""
    spaced = r"(?<![a-z0-9])(?:" + "|".join(r"[\W_]+".join(r"[\W_]*".join(w) for w in p) for p in (*T.SPACED_PHRASES, *((w,) for w in T.SPACED_WORDS))) + r")(?![a-z0-9])"
    return f"coalesce(regexp_matches(lower({c}), '{'|'.join(T.PROFANE_WORDS)}') or {has(n, '|'.join(T.PROFANE_PATTERNS))} or {has(n, spaced)}, false)"


# The pattern as surveyed; and the one of the prefilters' SQL, with at most two parts of signs in a name.
_SPELLED_EMAIL = r"(?iU)\b[a-z0-9._%+-]+(?:\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z0-9._%+-]+)*\s*(?:at|@|\[at\]|\(at\))\s*[a-z0-9.-]+\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z]{2,}\b"
_SHORT_EMAIL = r"(?iU)\b[a-z0-9._%+-]+(?:\s*(?:dot|\.|\[dot\]|\(dot\))\s*[.%+-]{1,8}){0,2}\s*(?:at|@|\[at\]|\(at\))\s*[a-z0-9.-]+\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z]{2,}\b"


def email(p: str, spelled: str = _SHORT_EMAIL) -> str:
    parts = f"(contains({p}, '@') or contains({p}, 'at')) and (contains({p}, '.') or contains({p}, 'dot'))"
    return f"(contains({p}, '@') and {has(p, D.EMAIL)} or {parts} and {has(p, spelled)})"


def whole_email(p: str) -> str:
    return email(p, _SPELLED_EMAIL)


def phone_like(t: str) -> str:
    rest = f"regexp_replace(regexp_replace({t}, '[ .-]', '', 'g'), '^(?:\\+84|84|0)', '')"
    return f"(regexp_matches({t}, '^\\s*(?:\\+?84|0)') and regexp_matches({rest}, '^[0-9]{{9,10}}$'))"


def phone_candidate(p: str) -> str:
    found = f"regexp_extract_all({p}, '(?:^|\\W)((?:\\+?84|0)(?:[\\s.\\-]?[0-9]){{8,10}})(?:\\W|$)', 1)"
    return f"len(list_filter({found}, lambda t: {phone_like('t')})) > 0"


def bank_number(p: str, n: str) -> str:
    size = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
    found = f"regexp_extract_all({p}, '(?:^|\\D)((?:[0-9][\\s.\\-]?){{9,14}})(?:\\D|$)', 1)"
    return f"len(list_filter({found}, lambda t: {size} between 9 and 14 and not {phone_like('t')} and ({has(n, D.BANK_CUE)} or regexp_matches(trim(t), '[ .-]')))) > 0"


def address(c: str) -> str:
    """c: the text as it is."""
    segments = f"list_filter(list_transform(string_split(replace({c}, chr(10), ','), ','), lambda x: {stripped('x')}), lambda x: x <> '')"
    snippet = "array_to_string(g[1:4], ', ')"
    numbers = f"regexp_extract_all({snippet}, '[0-9]{{1,6}}')"
    return (
        f"(select len(g) >= 2 and len(list_filter(g, lambda x: regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]'))) > 0 and length(regexp_replace({snippet}, '[^\\p{{L}}]', '', 'g')) >= 12"
        f" and len(list_filter(regexp_split_to_array({snippet}, '{SPACE}+'), lambda x: x <> '')) >= 5 and (len({numbers}) >= 2 or len(list_filter({numbers}, lambda x: length(x) >= 5)) > 0) from (select {segments} as g))"
    )


def sensitive(p: str) -> str:
    """p: the plain text."""
    social = D.SOCIAL.replace(r"|@\w{3,}", "")  # a word edge before an @ is a letter before it
    return (
        f"case when {has(p, D.URL)} then 'url' when {email(p)} then 'email' when {has(p, D.PHONE)} then 'phone' when {has(p, D.BANK)} then 'bank' when {has(p, D.SQL_TEXT)} then 'sql'"
        f" when {has(p, social)} or {has(p, r"\w@\w{3,}")} then 'social' when {has(p, D.PROMOTION)} then 'promotion' when {has(p, D.INJECTION)} then 'injection' end"
    )


def username_like(t: str) -> str:
    low = f"lower(trim({t}))"
    return f"({low} <> '' and not regexp_matches({low}, '^[0-9]+$') and {low} not in {inside(D.NO_USERNAMES)} and (regexp_matches({low}, '[_.0-9]') or length({low}) >= 9))"


def social_contact(p: str, n: str) -> str:
    """p: the plain text; n: the plain form of its normal form."""
    platform = has(n, rf"\b{D.PLATFORM}\b")
    named = " or ".join(f"len(list_filter(regexp_extract_all({n}, {pattern(x)}, 1), lambda t: {username_like('t')})) > 0" for x in (D.NAME_AFTER, D.NAME_BEFORE))
    return (
        f"case when {has(p, D.HANDLE)} then 'social_handle' when {has(p, D.DISCORD_TAG)} and contains({n}, 'discord') then 'discord_tag'"
        f" when ({platform} or {has(n, '|'.join(D.CHANNELS))}) and {has(n, D.INTENT)} then 'social_intent' when {named} then 'social_username' end"
    )


def repeated_unit(t: str) -> str:
    """A unit of 1 to 4 characters three times or more; the shortest one is no sound word."""
    unit = "case " + " ".join(f"when length({t}) % {k} = 0 and length({t}) >= {3 * k} and {t} = repeat(left({t}, {k}), (length({t}) // {k})::int) then left({t}, {k})" for k in range(1, 5)) + " end"
    return f"coalesce(length({t}) >= 6 and ({unit}) not in {inside(D.SOUND_UNITS)}, false)"


def gibberish_token(t: str) -> str:
    cluster = f"coalesce(list_max(list_transform(regexp_extract_all({t}, '[^aeiouy]+'), lambda x: length(x))), 0)"
    vowels = f"length(regexp_replace({t}, '[^aeiouy]', '', 'g'))"
    return f"(length({t}) >= 6 and ({cluster} >= 5 or {cluster} >= 4 and {vowels} / length({t}) <= 0.30 or {vowels} = 0))"


def meaningless(n: str) -> str:
    """n: the normal form."""
    compact = f"regexp_replace({n}, '{SPACE}+', '', 'g')"
    most = "list_max(list_transform(d, lambda x: len(list_filter(k, lambda y: y = x))))"
    short = "len(list_filter(d, lambda x: length(x) > 8)) = 0"
    phrase = f"len(k) >= 3 and {short} and (len(d) = 1 or len(k) >= 4 and len(d) <= 2 and {most} / len(k) >= 0.75)"
    lone = f"len(k) = 1 and length(k[1]) >= 4 and (k[1] in {inside(D.KEYBOARD_WALKS)} or length(k[1]) >= 6 and k[1] = repeat(left(k[1], 1), length(k[1])::int) or {repeated_unit('k[1]')})"
    medium, odd = "len(list_filter(w, lambda x: length(x) >= 4))", f"len(list_filter(w, lambda x: {gibberish_token('x')}))"
    odd_words = f"coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) >= 12 and {odd} >= 2 and {odd} / {medium} >= 0.6"
    return (
        f"(select case when {compact} = '' then null when regexp_matches({compact}, '^[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}]{{4,}}$') then 'symbols_only' when {phrase} then 'repeated_phrase' when {lone} then 'junk_token' when {odd_words} then 'gibberish' end"
        f" from (select k, list_distinct(k) as d, list_filter(k, lambda x: regexp_matches(x, '^[a-z]+$')) as w from (select regexp_extract_all({n}, '[a-z0-9]+') as k)))"
    )


def bad_emoji(c: str) -> str:
    """c: the text as it is."""
    anyof = "[" + "".join(D.BAD_EMOJI) + "]"
    of = lambda kind: "[" + "".join(e for e, k in D.BAD_EMOJI.items() if k == kind) + "]"
    without = f"regexp_replace({c}, '{anyof}', ' ', 'g')"
    return (
        f"(select case when len(k) < 4 and coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) < 16 and (len(k) = 0 or h >= greatest(2, len(k)) or h * 3 >= greatest(1, length(regexp_replace({c}, '{SPACE}', '', 'g'))))"
        f" then case when regexp_matches({c}, '{of('violent')}') then 'violent' when regexp_matches({c}, '{of('offensive')}') then 'offensive' else 'adult' end end"
        f" from (select regexp_extract_all({normal(without)}, '[a-z0-9]+') as k, length({c}) - length(regexp_replace({c}, '{anyof}', '', 'g')) as h) where h > 0)"
    )


_TIED = r"\x{FE00}-\x{FE0F}\x{1F3FB}-\x{1F3FF}\x{20E3}\p{Mn}\p{Me}"
_GRAPHEME = rf"(?s)(?:\x{{200D}}+[^\x{{200D}}]?|.)(?:\x{{200D}}+[^\x{{200D}}]?|[{_TIED}])*"


def graphemes(c: str) -> str:
    return f"regexp_extract_all({c}, '{_GRAPHEME}')"


def is_emoji(g: str) -> str:
    return f"(regexp_matches({g}, '^[\\x{{1F300}}-\\x{{1F9FF}}\\x{{1FA00}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F000}}-\\x{{1F2FF}}]') or regexp_matches({g}, '^\\p{{So}}') and not regexp_matches({g}, '^[\\x00-\\x7F]'))"


def runs(source: str, key: str, c: str) -> str:
    """CTEs runs(key, i, g, n): the runs of equal graphemes of the texts c of a relation."""
    return (
        f"spread as (select {key}, unnest({graphemes(c)}) as g, generate_subscripts({graphemes(c)}, 1) as i from {source}),\n"
        f"runs as (select {key}, min(i) as i, g, count(*) as n from (select *, i - row_number() over (partition by {key}, g order by i) as island from spread) group by {key}, g, island)"
    )


def dominance(c: str) -> str:
    return f"coalesce((select max(n) from (select count(*) as n from (select unnest(string_split({c}, '')) as ch) where ch <> '' group by ch)) / nullif(length({c}), 0)::double, 0.0)"


def dominated(c: str) -> str:
    return f"(length({c}) > {DEFAULT.dominance_from} and {dominance(c)} > {DEFAULT.dominance_share})"


def sanitized(source: str, key: str, c: str) -> str:
    """CTEs up to sane(key, why, body): the sanitised text, or the text as it was and why it is refused."""
    s = DEFAULT
    folded = (
        f"weighed as (select {key}, arg_min(case when {is_emoji('g')} then 'emoji_run' else 'char_run' end, i) filter (n > case when {is_emoji('g')} then {s.emoji_run_limit} else {s.run_limit} end) as long,"
        f" coalesce(sum(least(n, {s.kept_run})) filter ({is_emoji('g')}), 0) as emojis, string_agg(repeat(g, least(n, {s.kept_run})::int), '' order by i) as short from runs group by {key})"
    )
    why = f"case when coalesce({c}, '') = '' then null when {dominated(c)} then 'repeat_share' when long is not null then long when emojis > {s.emoji_limit} then 'emoji_total' end"
    return f"{runs(source, key, c)},\n{folded},\nsane as (select {key}, why, case when why is null and {c} <> '' then short else {c} end as body from (select s.{key}, s.{c}, j.short, {why} as why from {source} s left join weighed j using ({key})))"


def blank(c: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '^{SPACE}*$')"


def alnum_count(c: str) -> str:
    return f"length(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def review_reasons(source: str, key: str, c: str) -> str:
    """CTEs up to reasons(key, found): why a review text is rejected, or null."""
    return (
        f"{sanitized(source, key, c)},\nforms as (select {key}, why, body, {c} as given, {plain('body')} as p, {clean('body')} as cl from sane join {source} using ({key})),\n"
        f"more as (select *, {plain(normal('body'))} as n, {plain('cl')} as pc, {plain(normal('cl'))} as nc from forms),\n"
        f"reasons as (select {key}, case when why is not null then why when {blank('body')} then 'empty' when {alnum_count('body')} < 2 then 'too_short' when body <> given and {dominated('body')} then 'repeat_share'"
        f" when {profane('body', 'n')} or {profane('cl', 'nc')} then 'profanity' else coalesce({sensitive('p')}, {sensitive('pc')}) end as found from more)"
    )


def comment_reasons(source: str, key: str, c: str) -> str:
    """CTEs up to reasons(key, category, reason): what a comment is rejected for, or nulls."""
    return (
        f"{sanitized(source, key, c)},\nforms as (select {key}, why, body, {c} as given, {plain('body')} as p, {normal('body')} as nn, {plain(normal('body'))} as n from sane join {source} using ({key})),\n"
        f"signs as (select *, {meaningless('nn')} as nothing, {bad_emoji('body')} as emoji, {social_contact('p', 'n')} as social from forms),\n"
        f"first_of as (select {key}, emoji, case when why is not null then 'spam ' || why when {blank('body')} then 'spam empty' when body <> given and {dominated('body')} then 'spam repeat_share' when nothing is not null then 'spam ' || nothing when emoji is not null then emoji || ' bad_emoji'"
        f" when {has('p', D.URL)} then 'spam url' when social is not null then 'spam ' || social when {email('p')} then 'privacy email' when {phone_candidate('p')} then 'privacy phone' when {bank_number('p', 'n')} then 'privacy bank' when {address('body')} then 'privacy address' when {profane('body', 'n')} then 'offensive profanity' end as both_ from signs),\n"
        f"reasons as (select {key}, split_part(both_, ' ', 1) as category, split_part(both_, ' ', 2) as reason from first_of)"
    )


def personal(c: str, p: str, n: str) -> str:
    cue = has(n, V.CONTACT_CUE.replace("[h]?", "h?"))
    return f"coalesce(contains({p}, '@') and {has(p, D.EMAIL)} or {cue} and ({has(p, V.DIGIT_BLOCK)} or length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 7), false)"


def forced(category: str, flags: str, reason: str, c: str, n: str) -> str:
    """Whether a verdict or its comment shows a clear violation; flags: comma-joined."""
    return f"(lower(trim({category})) in {V.REJECT_CATEGORIES} or regexp_matches(lower({flags}), '{'|'.join(V.REJECT_FLAGS)}') or regexp_matches(lower(coalesce({reason}, '')), '{'|'.join(V.REJECT_REASONS)}') or {profane(c, n)})"


def reason_category(category: str, flags: str, reason: str, c: str, p: str, n: str) -> str:
    tokens = "|".join(V.PRIVACY_TOKENS)
    private = f"lower(trim(coalesce({category}, ''))) in {V.PRIVACY_CATEGORIES} or regexp_matches(lower({flags}), '{tokens}') or regexp_matches({normal(reason)}, '{tokens}') or {personal(c, p, n)}"
    return f"case when {private} then 'privacy' when lower(trim({category})) in {V.SPAM_CATEGORIES} then 'spam' else 'conduct' end"


# Article requests.
def checked(c: str, strip: bool = True) -> str:
    low = f"lower(coalesce({c}, ''))"
    return squeezed(f"regexp_replace(strip_accents({low}), '[^a-z0-9{SPACES}]', ' ', 'g')" if strip else f"regexp_replace({low}, '[^{_WORD}{SPACES}]', ' ', 'g')")


def hits(c: str, words) -> str:
    return f"list_filter({listed(words)}, lambda w: contains({c}, w))"


def branded(k: str) -> str:
    return f"list_filter({listed(B.BRANDS)}, lambda w: contains(' ' || {k} || ' ', ' ' || w || ' '))[1]"


def themed(k: str) -> str:
    bad, good = hits(k, B.UNSAFE_THEMES), f"len({hits(k, B.EDUCATIONAL)})"
    return f"coalesce(list_filter({bad}, lambda w: w in {inside(B.GRAPHIC)})[1], case when len({bad}) >= 2 and {good} = 0 or len({bad}) >= 3 and {good} <= 1 then ({bad})[1] end)"


def unsafe(c: str, k: str, n: str) -> str:
    """c: the text; k: its checked form; n: the plain form of its normal form."""
    own = f"case when regexp_matches(lower({c}), '{B.VIETNAMESE}') then {checked(c, strip=False)} else {k} end"
    short = ", ".join(f"case when list_contains(string_split({own}, ' '), '{w}') then '{w}' end" for w in B.UNSAFE_TOKENS)
    # The checked form is lower case; letters beyond ASCII in it are no edges.
    matched = ", ".join(f"nullif(regexp_extract(regexp_replace({own}, '[^\\x00-\\x7F]', 'Q', 'g'), {pattern(rf'\b{x}\b')}), '')" for x in B.UNSAFE_PATTERNS)
    return f"case when {profane(c, n)} then 'hard_profanity' else coalesce({short}, {matched}) end"


def article_forms(context: str, source: str = "articles") -> str:
    """CTE forms over the source: c the context, k its checked form, n the plain form of its normal form."""
    return f"forms as (select *, {checked('c')} as k, {plain(normal('c'))} as n from (select *, {context} as c from {source}))"


def aim(k: str) -> tuple[str, str]:
    """(decision, score) of the checked context k; category_id is a column."""
    anchors = f"len({hits(k, B.ANCHORS)})"
    score = f"least(1.0, ({anchors} * {DEFAULT.anchor_weight}::double + case when category_id > 0 then {DEFAULT.category_bonus}::double else 0.0 end) / len(string_split({k}, ' ')))"
    off = f"len({hits(k, B.OFF_TOPIC)}) > 0 and {anchors} = 0"
    return f"case when {k} = '' or {off} then 'block' when {score} >= {DEFAULT.intent_pass} then 'pass' else 'review' end", f"case when {k} = '' then 0.95 when {off} then 0.9 else {score} end"
