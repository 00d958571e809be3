"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from moderata.llm import quality

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _divergence(pairs: list[tuple[str, float]]) -> str:
    """The Jensen-Shannon distance of (share, reference share) pairs."""
    parts = []
    for p, q in pairs:
        m = f"(({p} + {q!r}) / 2)"
        parts.append(f"(case when {p} > 0 then {p} * log2({p} / {m}) else 0 end + {f'{q!r}::double * log2({q!r} / {m})' if q > 0 else '0'}) / 2")
    return f"sqrt(greatest(0.0, {' + '.join(parts)}))"


def _quality() -> str:
    limits = quality.Limits()
    common = sorted({w for shares in quality.WORD_SHARES.values() for w in shares})
    classes = ["p_ascii", "p_other", "p_digit", "p_space", "p_punct", "p_rest"]
    by_class = ", ".join(_divergence(list(zip(classes, q, strict=True))) for q in quality.CLASS_SHARES.values())
    by_word = []
    for shares in quality.WORD_SHARES.values():
        named = [(f"(w_{w} / greatest(n_words, 1))", q) for w, q in shares.items()]
        rest = f"greatest(0.0, 1.0 - ({' + '.join(p for p, _ in named)}))"
        by_word.append(_divergence([*named, (rest, 1 - sum(shares.values()))]))
    return rf"""
with base as (select doc_id, coalesce(text, '') as text from documents),
cut as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') as t0 from base),
cut1 as (select *, regexp_replace(t0, '[A-Za-z]+', '', 'g') as t1 from cut),
cut2 as (select *, regexp_replace(t1, '[^\x00-\x7F]+', '', 'g') as t2 from cut1),
cut3 as (select *, regexp_replace(t2, '[0-9]+', '', 'g') as t3 from cut2),
cut4 as (select *, regexp_replace(t3, '[.,;:!?''"()-]+', '', 'g') as t4 from cut3),
rows as (select *, row_number() over (order by doc_id) as r, len(words) as n_words, greatest(length(text), 1)::double as n from cut4),
windows as (select r, i, list_slice(words, i, i + 7) as g from (select r, words, unnest(range(1, n_words - 6)) as i from rows where n_words >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from windows) where c > 1),
repeated as (select r, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(0, 8)) as k) group by r),
lines as (select r, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as l from rows) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
counts as (select r, {', '.join(f"count(*) filter (where w = '{w}')::double as w_{w}" for w in common)} from (select r, lower(trim(unnest(words), '.,;:!?')) as w from rows) group by r),
shares as (select rows.r, doc_id, n_words, length(t0) as word_chars, length(t4) - length(regexp_replace(t4, '[#*$%&|<>]+', '', 'g')) as n_symbols,
 coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
 (length(t0) - length(t1)) / n as p_ascii, (length(t1) - length(t2)) / n as p_other, (length(t2) - length(t3)) / n as p_digit, (length(text) - length(t0)) / n as p_space, (length(t3) - length(t4)) / n as p_punct, length(t4) / n as p_rest,
 {', '.join(f'coalesce(w_{w}, 0.0) as w_{w}' for w in common)}
 from rows left join lines using (r) left join repeated using (r) left join counts using (r)),
judged as (select *, n_words < {limits.base_words} or 100 * n_repeat_words > {limits.repeat_percent} * n_words as base_failed, least({by_class}) as class_distance, least({', '.join(by_word)}) as word_distance from shares)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (n_words < {limits.min_words} or (class_distance <= {limits.class_distance} and word_distance <= {limits.word_distance})) as kept from judged"""


def _urls() -> str:
    # Spelled out here, not taken from the operator: a wrong list there shows as a difference.
    alone = "adserver|adult|bet|casino|crack|keygen|porn|sex|torrent|warez|xxx"
    rows = ("ad click", "affiliate id", "banner ads", "free spins", "live cams", "full movie download", "buy followers", "payday loan")
    in_a_row = "|".join(x.replace(" ", "[^a-z0-9]+") for x in rows)
    blocked = f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9])({alone}|{in_a_row})([^a-z0-9]|$)')"
    return rf"""
with parts as (select page_id, url, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) as host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered as (select *, row_number() over () as r from parts),
best as (select r, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v from numbered, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by r)
select page_id, host, path, rule, coalesce(v, case when {blocked} then 'block' else 'allow' end) as verdict from numbered left join best using (r)"""


CONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, n, list_slice(w, i, i + n - 1) as g from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, list_slice(w, i, i + n - 1) as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, dw.n as n, i, item from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select doc_id, count(distinct i + k) as n_hit from hits, (select unnest(range(0, 10)) as k) where k < n group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id as doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, list_slice(w, i, i + 3) as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x),
least as (select x, least(x, min(y)) as component_id from reach group by x)
select d.doc_id as doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join least on least.x = d.doc_id"""

#: The 50-byte strings with their smallest document, the last string to be
#: removed that starts before each byte, and the bytes that none of these reaches.
REPEATED_PASSAGES = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
strings as (select doc_id, i, array_slice(b, i + 1, i + 50) as w from (select doc_id, b, unnest(range(0, greatest(n - 49, 0))) as i from d)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as least from strings) where least < doc_id),
marked as (select b.doc_id, b.i, last_value(case when g.i is not null then g.i end ignore nulls) over (partition by b.doc_id order by b.i) >= b.i - 49 as cut from (select doc_id, unnest(range(0, n)) as i from d) b left join gone g on g.doc_id = b.doc_id and g.i = b.i),
bytes as (select m.doc_id, m.i, coalesce(cut, false) as cut, coalesce(lag(cut) over (partition by m.doc_id order by m.i), false) as before, hex(array_slice(b, m.i + 1, m.i + 1)) as x from marked m join d using (doc_id)),
told as (select doc_id, count(*) filter (cut) as n_removed, count(*) filter (cut and not before) as n_spans, string_agg(x, '' order by i) filter (not cut) as kept from bytes group by doc_id)
select d.doc_id as doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join told using (doc_id)"""

_BITS = "array_to_string(list_transform(string_split(sha, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '')"
_FIVE = " + ".join(f"{16 >> k} * (substr(bits, 5 * i + {k + 1}, 1) = '1')::int" for k in range(5))
ARCHIVES = f"""
with p as (select page_id, url, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
b as (select *, {_BITS} as bits, max(page_id) over (partition by sha) as whole from p)
select page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') as payload_digest,
 case when page_id = whole then 'response' else 'revisit' end as record_type, case when page_id <> whole then whole end as refers_to from b"""

#: The CRC-32 of an ASCII string, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split({s}, ''), lambda c: ascii(c)::bigint), lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::bigint), 4294967295)"


def _repair() -> str:
    """The rows one by one, with the least (cost, edits) of each place of the wanted form so far."""

    def plus(place: str, cost: str, letter: str) -> str:
        return f"{{'c': {place}.c + {cost}, 'a': {place}.a || '{letter}'}}"

    def least(*found: str) -> str:
        return f"list_min([{', '.join(found)}])"

    none = "{'c': 1000000000::bigint, 'a': ''}"
    start = [none if p else "{'c': 0::bigint, 'a': ''}" for p in range(4)]

    def moved(places: tuple[str, ...], initial: str) -> list[str]:
        out = []
        for p in places:
            out.append(plus(p, f"case when must then 1000000000 when initial = '{initial}' then extra else 1000000000 end", "K"))
            if initial != "s":
                out.append(plus(p, "case when must then 1000000000 else 3 + extra end", "R"))
        return out

    return rf"""
with recursive kinds as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format(s="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations),
rows as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case kind when 3 then 2 else 1 end)) as copy from kinds where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, substr(role, 1, 1) as initial, regexp_replace(text, '[ 	-
]+$', '') as said from rows),
faults as (select *, said = '' as is_blank, said <> '' and seen > 1 as is_duplicate, said <> '' and seen = 1 and not regexp_matches(said, '[.!?]$') as is_truncated, lag(initial) over (partition by conv_id order by i) as before from placed),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (is_blank) as blank, count(*) filter (is_duplicate) as duplicate, count(*) filter (is_truncated) as truncated,
 count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n from faults group by conv_id),
edits(conv_id, i, p0, p1, p2, p3) as (
 select conv_id, 0::bigint, {start[0]}, {start[1]}, {{'c': 3::bigint, 'a': 'I'}}, {{'c': 6::bigint, 'a': 'II'}} from told
 union all
 select conv_id, i, p0, p1, q2, {least("p3", plus("q2", "3", "I"))} from (select *, {least("p2", plus("p0", "3", "I"), plus("p1", "3", "I"), plus("p3", "3", "I"))} as q2 from (
  select e.conv_id as conv_id, f.i as i, {plus("e.p0", "4", "D")} as p0, {least(plus("e.p1", "4", "D"), *moved(("e.p0",), "s"))} as p1, {least(plus("e.p2", "4", "D"), *moved(("e.p0", "e.p1", "e.p3"), "u"))} as p2, {least(plus("e.p3", "4", "D"), *moved(("e.p2",), "a"))} as p3
  from edits e join (select *, is_blank or is_duplicate as must, case when is_truncated then 3 else 0 end as extra from faults) f on e.conv_id is not distinct from f.conv_id and f.i = e.i + 1))),
best as (select t.*, list_min([p0, p3]) as b from told t join edits e on t.conv_id is not distinct from e.conv_id and t.n = e.i),
letters as (select conv_id, k, substr(b.a, k, 1) as edit, b.a as audit from (select *, unnest(range(1, length(b.a) + 1)) as k from best)),
counted as (select *, count(*) filter (edit <> 'I') over w as i, count(*) filter (edit <> 'D') over w - 1 as place, count(*) filter (edit <> 'D') over (partition by conv_id) % 2 as odd from letters window w as (partition by conv_id order by k)),
turns as (select c.conv_id as conv_id, k, case when edit = 'K' then f.role when (place - odd) % 2 = 0 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else f.text end as turn from counted c left join faults f on c.conv_id is not distinct from f.conv_id and c.i = f.i where edit <> 'D'),
repaired as (select conv_id, sha256(string_agg(turn, chr(10) order by k)) as sha from turns group by conv_id)
select o.conv_id as conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join best on o.conv_id is not distinct from best.conv_id left join repaired r on o.conv_id is not distinct from r.conv_id"""


#: Words that equal the word so many places before, stretch by stretch of one lag.
RUNS = rf"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w, row_number() over () as r, {_CRC.format(s="coalesce(doc_id::varchar, '')")} as h from documents),
p as (select *, len(w) as n, h // 10 as g, (h // 10) % greatest(len(w), 1) as a from d),
changed as (select r, doc_id, case when h % 10 = 0 and doc_id is not null then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from p),
words as (select r, unnest(range(0, len(w))) as i, unnest(w) as x from changed),
pairs as (select r, i, x, x || ' ' || lead(x) over (partition by r order by i) as xx from words),
matches as (select b.r as r, b.i as i, b.i - a.i as q from pairs a join pairs b on a.r = b.r and a.xx = b.xx and a.i < b.i),
stretches as (select r, q, min(i) - q as start, max(i) + 2 as stop from (select r, q, i, i - row_number() over (partition by r, q order by i) as s from matches) group by r, q, s),
runs as (select r, start, stop - start as length, min(q) as period from stretches where stop - start >= greatest(12, 2 * q) group by r, start, stop),
told as (select r, count(*) as n_runs, max_by({{'start': start, 'length': length, 'period': period}}, [length, -start, -period]) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by r),
cut as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (select r, string_agg(x, ' ' order by i) as text from words anti join cut using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period, 1000 * best.length // best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from changed left join told using (r) left join kept using (r)"""


SQL = {
    "op1_suffix_array_dedup": REPEATED_PASSAGES,
    "op2_warc_round_trip": ARCHIVES,
    "op4_benchmark_decontamination": CONTAMINATION,
    "op5_minhash_near_dedup": NEAR_DUPLICATES,
    "op7_url_filters": _urls(),
    "op10_quality_rules": _quality(),
    "op11_turn_repair": _repair(),
    "op13_periodic_runs": RUNS,
}
