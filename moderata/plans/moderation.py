"""Queries over texts, verdicts, image annotations and article requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.config import DEFAULT
from moderata.functions import detect as D
from moderata.functions import text as T
from moderata.operators import blog as B
from moderata.operators import relations as R
from moderata.operators import selection as S
from moderata.operators import verdicts as V
from moderata.operators import vision as I
from moderata.plans import duck as Q
from moderata.plans.define import Registry
from moderata.plans.relational import REVIEWS_AT
from moderata.sources.files import read_files, read_pictures, write_pictures
from moderata.sources.shared import shared_folder, written_once
from moderata.sources.tables import view, with_views

registry = Registry()
query = registry.query
_TEXTS = f"{with_views('texts')}, given as (select doc_id, text, {Q.plain('text')} as p, {Q.normal('text')} as nn from texts), forms as (select *, {Q.plain('nn')} as n from given)\n"


def over_texts(name, column, sql=None):
    """A query with one value for each text; its SQL sees the text, its plain form p, its normal form nn, and the plain form n of that."""

    def run(spark, sf):
        return view(spark, sf, "texts").select("doc_id", column(F.col("text")).alias("value"))

    query(name, sql and f"{_TEXTS}select doc_id, {sql} as value from forms")(run)


def counted(items: str) -> str:
    return f"len({items})"


_TOKENS = "regexp_extract_all(nn, '[a-z0-9]+')"
over_texts("normalize_vi", T.normalize, "nn")
over_texts("clean_normalize", T.clean, Q.clean("text"))
over_texts("number_words_to_digits", lambda c: T.numbers_as_digits(T.normalize(c)), Q.digits("nn"))
over_texts("normalize_check", B.checked, Q.checked("text"))
over_texts("has_vi_diacritic", lambda c: F.lower(c).rlike(B.VIETNAMESE_LETTER), f"regexp_matches(lower(text), '{B.VIETNAMESE}')")
over_texts("split_graphemes", lambda c: F.size(T.graphemes(c)).cast("long"), counted(Q.graphemes("text")))
over_texts("is_emoji", lambda c: F.size(F.filter(T.graphemes(c), T.is_emoji)).cast("long"), counted(f"list_filter({Q.graphemes('text')}, lambda g: {Q.is_emoji('g')})"))
over_texts("has_hard_profanity", T.profane, Q.profane("text", "n"))
over_texts("normalize_title", T.plain_title, r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))")
over_texts("meaningful_char_count", lambda c: T.alnum_count(c).cast("long"), Q.alnum_count("text"))
over_texts("extract_digits", lambda c: F.regexp_replace(c, "[^0-9]", ""), "regexp_replace(text, '[^0-9]', '', 'g')")
over_texts("char_dominance_ratio", lambda c: F.coalesce(T.dominance(c), F.lit(0.0)), Q.dominance("text"))
over_texts("token_repetition_stats", lambda c: F.size(F.array_distinct(F.regexp_extract_all(T.normalize(c), F.lit("[a-z0-9]+"), F.lit(0)))).cast("long"), f"len(list_distinct({_TOKENS}))")
over_texts("request_hash", lambda c: T.request_hash(F.col("doc_id"), c, F.lit("x")), "sha256(cast(doc_id as varchar) || '|' || coalesce(text, '') || '|x')")
over_texts("hash_variant", lambda c: T.hash_choice(F.col("doc_id").cast("string"), ["calm", "bright", "brisk"]), "list_extract(['calm', 'bright', 'brisk'], (('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::bigint % 3 + 1)::int)")
over_texts("detect_url", lambda c: c.rlike(D.URL), Q.has("p", D.URL))
over_texts("detect_email", D.email, f"coalesce({Q.whole_email('p')}, false)")
over_texts("detect_phone_vn", lambda c: c.rlike(D.PHONE), Q.has("p", D.PHONE))
over_texts("detect_phone_candidate", D.phone_candidate, Q.phone_candidate("p"))
over_texts("detect_bank_cue", lambda c: c.rlike(D.BANK), Q.has("p", D.BANK))
over_texts("detect_bank_number", D.bank_number, Q.bank_number("p", "n"))
over_texts("detect_address", D.address, f"case when text is not null then {Q.address('text')} end")
over_texts("detect_sql_text", lambda c: c.rlike(D.SQL_TEXT), Q.has("p", D.SQL_TEXT))
over_texts("detect_social_promo", lambda c: c.rlike(D.SOCIAL), f"({Q.has('p', D.SOCIAL.replace('|@' + chr(92) + 'w{3,}', ''))} or {Q.has('p', r'\w@\w{3,}')})")
over_texts("detect_spam_phrase", lambda c: c.rlike(D.PROMOTION), Q.has("p", D.PROMOTION))
over_texts("detect_injection", lambda c: c.rlike(D.INJECTION), Q.has("p", D.INJECTION))
over_texts("sensitive_pattern_first", D.sensitive, Q.sensitive("p"))
over_texts("detect_social_contact", D.social_contact, Q.social_contact("p", "n"))
over_texts("detect_meaningless", D.meaningless, Q.meaningless("nn"))
over_texts("detect_bad_emoji", D.bad_emoji, Q.bad_emoji("text"))
over_texts("repeated_unit_token", lambda c: F.exists(F.split(T.normalize(c), " "), D.repeated_unit), f"len(list_filter(string_split(nn, ' '), lambda t: {Q.repeated_unit('t')})) > 0")
over_texts("gibberish_tokens", lambda c: F.size(F.filter(F.regexp_extract_all(T.normalize(c), F.lit("[a-z]+"), F.lit(0)), D.gibberish_token)).cast("long"), counted(f"list_filter(regexp_extract_all(nn, '[a-z]+'), lambda t: {Q.gibberish_token('t')})"))
over_texts("looks_like_username", lambda c: D.username_like(F.regexp_extract(c, r"^\S*", 0)), f"(select {Q.username_like('w')} from (select regexp_extract(text, '^[^ \t\n\r\f\v]*') as w))")
over_texts("detect_privacy_signal", V.personal, Q.personal("text", "p", "n"))

_SANE = f"{with_views('texts')},\n{Q.sanitized('texts', 'doc_id', 'text')}\n"


@query("sanitize_text", _SANE + "select doc_id, body, why from sane")
def sanitize_text(spark, sf):
    return view(spark, sf, "texts").select("doc_id", F.array(T.sanitized(F.col("text"))).alias("s")).select("doc_id", F.element_at("s", 1)["text"].alias("body"), F.element_at("s", 1)["reason"].alias("why"))


@query("run_length_compress", f"{with_views('texts')},\n{Q.runs('texts', 'doc_id', 'text')}\nselect doc_id, string_agg(repeat(g, least(n, 3)::int), '' order by i) as value from texts left join runs using (doc_id) group by doc_id, text is null")
def run_length_compress(spark, sf):
    """Runs of equal graphemes cut to three."""
    return view(spark, sf, "texts").select("doc_id", T.shortened(F.col("text")).alias("value"))


@query("emoji_totals", f"{with_views('texts')},\n{Q.runs('texts', 'doc_id', 'text')}\nselect doc_id, case when text is not null then coalesce(sum(least(n, 3)) filter ({Q.is_emoji('g')}), 0)::bigint end as value from texts left join runs using (doc_id) group by doc_id, text")
def emoji_totals(spark, sf):
    """Emoji that are left when runs are cut to three."""
    return view(spark, sf, "texts").select("doc_id", T.emoji_total(F.col("text")).alias("value"))


@query("review_prefilter", f"{with_views('texts')},\n{Q.review_reasons('texts', 'doc_id', 'text')}\nselect doc_id, found as value from reasons")
def review_prefilter(spark, sf):
    return D.with_review_reason(view(spark, sf, "texts"), "text", "value").select("doc_id", "value")


@query("comment_prefilter", f"{with_views('texts')},\n{Q.comment_reasons('texts', 'doc_id', 'text')}\nselect doc_id, category, reason from reasons")
def comment_prefilter(spark, sf):
    return D.with_comment_verdict(view(spark, sf, "texts"), "text", "value").select("doc_id", "value.category", "value.reason")


over_texts("truncate_fields", lambda c: F.substring(c, 1, 500), "substr(text, 1, 500)")
over_texts("has_vi_signals", B.vietnamese, "regexp_matches(' ' || lower(coalesce(text, '')) || ' ', '{}')".format("|".join(B.VIETNAMESE_SIGNALS)))


_PARSED = """, body as (select *, regexp_replace(coalesce(primary_raw, secondary_raw), ',\\s*([\\]}])', '\\1', 'g') as j from review_verdicts),
fields as (select review_id, j, case when upper(j->>'$.decision') in ('APPROVED', 'REJECTED', 'MANUAL_REVIEW') then upper(j->>'$.decision') else 'MANUAL_REVIEW' end as d, try_cast(j->>'$.confidence' as double) as c, j->>'$.confidence' as craw, lower(j->>'$.category') as cat, coalesce(array_to_string(from_json(j->'$.flags', '["VARCHAR"]'), ','), '') as flags, j->>'$.reason' as reason from body),
verdicts as (select review_id, coalesce(case when j is null then null else d end, 'MANUAL_REVIEW') as decision, case when j is null then 0.0 when craw is null then case when d = 'APPROVED' then 1.0 else 0.5 end when c between 0 and 1 then c else 0.5 end as confidence, coalesce(cat, 'ambiguous') as category, case when j is null then 'llm_call_failed' else flags end as flags, coalesce(reason, 'no completion') as reason from fields)
"""


def _flat(df, key="review_id", *more):
    v = F.col("verdict")
    return df.select(key, v["decision"].alias("decision"), v["confidence"].alias("confidence"), v["category"].alias("category"), F.array_join(v["flags"], ",").alias("flags"), *[v[k].alias(k) for k in more])


@query("join_verdict_fallback", with_views("review_verdicts") + _PARSED + "select review_id, decision, confidence, category, flags from verdicts")
def join_verdict_fallback(spark, sf):
    return _flat(V.with_verdicts(view(spark, sf, "reviews").select("review_id"), view(spark, sf, "review_verdicts", True), "review_id"))


_PRIMARY = with_views("review_verdicts") + _PARSED.replace("coalesce(primary_raw, secondary_raw)", "primary_raw")


@query("parse_verdict_json", _PRIMARY + "select v.review_id, case when j is not null then decision end as decision, case when j is not null then confidence end as confidence, case when j is not null then category end as category, case when j is not null then v.flags end as flags from verdicts v join fields using (review_id)")
def parse_verdict_json(spark, sf):
    return _flat(view(spark, sf, "review_verdicts", True).select("review_id", V.parsed(F.col("primary_raw")).alias("verdict")))


@query("scan_model_verdicts", with_views("review_verdicts") + "select review_id, 'primary' as provider, primary_raw as completion from review_verdicts where primary_raw is not null union all select review_id, 'secondary', secondary_raw from review_verdicts where secondary_raw is not null")
def scan_model_verdicts(spark, sf):
    return V.providers_as_rows(view(spark, sf, "review_verdicts", True), "review_id")


_DECIDED_BY = "case when contains(flags, 'llm_call_failed') then 'llm_error' else 'llm' end"


@query("review_verdict", with_views("review_verdicts") + _PARSED + f"select review_id, decision, confidence, category, flags, {_DECIDED_BY} as decided_by from verdicts")
def review_verdict(spark, sf):
    rows = V.reviewed(view(spark, sf, "reviews").select("review_id"), view(spark, sf, "review_verdicts", True), "review_id")
    return rows.select("review_id", *[F.col("verdict")[k].alias(k) for k in ("decision", "confidence", "category")], F.array_join(F.col("verdict")["flags"], ",").alias("flags"), "decided_by")


_SWAPPED = _PARSED.replace("coalesce(primary_raw, secondary_raw)", "coalesce(secondary_raw, primary_raw)")
_OF_COMMENTS = with_views("review_verdicts", "comments") + _SWAPPED
_VERDICT_OF = "coalesce(v.decision, 'MANUAL_REVIEW') as decision, coalesce(v.confidence, 0.0) as confidence, coalesce(v.category, 'ambiguous') as category, coalesce(v.flags, 'llm_call_failed') as flags, coalesce(v.reason, 'no completion') as reason"


@query("comment_verdict", _OF_COMMENTS + f"select target_id, {_VERDICT_OF} from comments c left join verdicts v on v.review_id = c.target_id")
def comment_verdict(spark, sf):
    """The model's verdict of every comment, the second provider asked first."""
    rows = V.reviewed(view(spark, sf, "comments").select("target_id"), _completions(spark, sf), "target_id", "secondary_raw", "primary_raw")
    return _flat(rows, "target_id", "reason")


_RULED = _PARSED + f""", counted as (select r.review_id, coalesce(n, 0) as n from reviews r left join (select account_id, count(*) as n from reviews where not is_deleted and moderation_status = 'Rejected' and updated_at >= timestamp '{REVIEWS_AT}' - interval '30' day group by 1) using (account_id)),
ruled as (select *, decision = 'APPROVED' and confidence < 0.7 as low, decision = 'APPROVED' and confidence >= 0.7 and contains(flags, 'health_concern') as health, decision = 'APPROVED' and n >= 2 as rep from verdicts join counted using (review_id)),
settled as (select review_id, case when low or health or rep then 'MANUAL_REVIEW' else decision end as decision, confidence, category,
 concat_ws(',', nullif(flags, ''), case when low then 'override:low_confidence:' || printf('%.2f', confidence) || '<0.7' end, case when health then 'override:health_concern_flag' end, case when rep then 'override:repeat_offender:' || n || '_rejected_in_30d' end) as flags,
 case when low or health or rep then 'for review: ' || concat_ws('; ', case when low then 'low confidence' end, case when health then 'health concern' end, case when rep then 'rejected before: ' || n end) else reason end as reason from ruled)
"""


@query("apply_business_rules", with_views("review_verdicts", "reviews") + _RULED + "select review_id, decision, confidence, category, flags from settled")
def apply_business_rules(spark, sf):
    rows = R.with_recent_rejects(view(spark, sf, "reviews").select("review_id", "account_id", "is_deleted", "moderation_status", "updated_at"), REVIEWS_AT)
    return _flat(V.with_business_rules(V.with_verdicts(rows, view(spark, sf, "review_verdicts", True), "review_id")))


def _as_verdict(spark, sf):
    flags = F.when(F.col("flag") == "", F.array().cast("array<string>")).otherwise(F.array("flag"))
    return view(spark, sf, "text_verdicts").withColumn("verdict", V.verdict(F.col("decision"), F.col("confidence"), F.col("category"), flags, F.col("reason")))


@query("confidence_guard", with_views("text_verdicts") + "select review_id, case when decision = 'APPROVED' and confidence < 0.7 then 'MANUAL_REVIEW' else decision end as decision, confidence, category, concat_ws(',', nullif(flag, ''), case when decision = 'APPROVED' and confidence < 0.7 then 'override:low_confidence:' || printf('%.2f', confidence) || '<0.7' end) as flags from text_verdicts")
def confidence_guard(spark, sf):
    return _flat(_as_verdict(spark, sf).withColumn("verdict", V.guarded(F.col("verdict"))))


_WITH_COMMENT = f"{with_views('text_verdicts')}, given as (select *, {Q.plain('comment')} as p, {Q.normal('comment')} as nn from text_verdicts), forms as (select *, {Q.plain('nn')} as n from given)\n"
_SHOWN = Q.forced("category", "flag", "reason", "comment", "n")


@query("force_reject_policy", _WITH_COMMENT + f"select review_id, case when {_SHOWN} then 'REJECTED' else decision end as decision, case when decision <> 'REJECTED' and {_SHOWN} then greatest(confidence, 0.95) else confidence end as confidence, category, concat_ws(',', nullif(flag, ''), case when decision <> 'REJECTED' and {_SHOWN} then 'force_reject_violation' end) as flags from forms")
def force_reject_policy(spark, sf):
    return _flat(_as_verdict(spark, sf).withColumn("verdict", V.forced(F.col("verdict"), F.col("comment"))))


@query("flags_append", with_views("text_verdicts") + "select review_id, concat_ws(',', nullif(flag, ''), case when flag <> 'health_concern' then 'health_concern' end) as flags from text_verdicts")
def flags_append(spark, sf):
    return _as_verdict(spark, sf).select("review_id", F.array_join(V.with_flag(F.col("verdict")["flags"], "health_concern"), ",").alias("flags"))


@query("map_reason_category", _WITH_COMMENT + f"select review_id, {Q.reason_category('category', 'flag', 'reason', 'comment', 'p', 'n')} as value from forms")
def map_reason_category(spark, sf):
    v = F.col("verdict")
    return _as_verdict(spark, sf).select("review_id", V.reason_category(v["category"], v["flags"], v["reason"], F.col("comment")).alias("value"))


@query("coerce_decision", with_views("review_verdicts") + "select review_id, case when upper(trim(d)) in ('APPROVED', 'REJECTED') then upper(trim(d)) else 'MANUAL_REVIEW' end as value from (select review_id, primary_raw->>'$.decision' as d from review_verdicts where primary_raw is not null)")
def coerce_decision(spark, sf):
    return view(spark, sf, "review_verdicts", True).where("primary_raw is not null").select("review_id", V.coerced(F.get_json_object("primary_raw", "$.decision")).alias("value"))


@query("project_model_version", with_views("text_verdicts") + "select review_id, case when decided_by like 'llm%' then 'text-1' when decided_by like 'vision%' then 'image-1' end as value from text_verdicts")
def project_model_version(spark, sf):
    return view(spark, sf, "text_verdicts").select("review_id", S.model_version(F.col("decided_by"), "text-1", "image-1").alias("value"))


_PROMPT = f"concat_ws(chr(10), 'Rating: ' || rating || '/5', 'Text:' || chr(10) || '---' || chr(10) || b || chr(10) || '---', case when k <> '' and trim(k) <> trim(b) then 'Decoded text:' || chr(10) || '---' || chr(10) || k || chr(10) || '---' end, 'Answer with one JSON object.')"
_PROMPTS = f"{with_views('reviews')}, prompts as (select review_id, {_PROMPT} as prompt from (select review_id, rating, coalesce(comment, '') as b, {Q.clean('comment')} as k from reviews))\n"


@query("build_model_prompt", _PROMPTS + "select review_id, prompt as value from prompts")
def build_model_prompt(spark, sf):
    return _prompts(spark, sf).withColumnRenamed("prompt", "value")


def _prompts(spark, sf):
    return view(spark, sf, "reviews").select("review_id", V.prompt(F.col("rating"), F.col("comment"), T.clean(F.col("comment"))).alias("prompt"))


@query("score_with", _PROMPTS + """select review_id, case when length(prompt) % 7 <> 0 then '{"decision":"' || case when contains(prompt, 'https') then 'REJECTED' else 'APPROVED' end || '"}' end as completion from prompts""")
def score_with(spark, sf):
    """The batch scorer with a model that needs no network."""

    def model(prompts):
        said = prompts.map(lambda x: '{"decision":"' + ("REJECTED" if "https" in x else "APPROVED") + '"}')
        return said.where(prompts.str.len() % 7 != 0, None)

    return V.score_with(_prompts(spark, sf), model)


def _completions(spark, sf):
    return view(spark, sf, "review_verdicts", True).withColumnRenamed("review_id", "target_id")


def _classified(kept: str) -> str:
    """CTEs up to classified, over the comments that `kept` keeps."""
    low = "v_decision = 'APPROVED' and v_confidence < 0.7"
    shown = Q.forced("v_category", "v_flags", "v_reason", "comment", "n")
    return (
        f"{_OF_COMMENTS}, chosen as (select * from comments where {kept}),\n{Q.comment_reasons('chosen', 'target_id', 'comment')},\n"
        f"asked as (select c.*, {Q.plain('c.comment')} as p, {Q.normal('c.comment')} as nn, f.category as f_category, f.reason as f_reason, {_VERDICT_OF.replace(' as ', ' as v_').replace('as v_confidence', 'as v0_confidence')} from chosen c join reasons f using (target_id) left join verdicts v on v.review_id = c.target_id),\n"
        f"asked2 as (select *, v0_confidence as v_confidence, {Q.plain('nn')} as n from asked),\n"
        f"guarded as (select * replace (case when {low} then 'MANUAL_REVIEW' else v_decision end as v_decision, concat_ws(',', nullif(v_flags, ''), case when {low} then 'override:low_confidence:' || printf('%.2f', v_confidence) || '<0.7' end) as v_flags, case when {low} then trim(v_reason || ' [low_confidence]') else v_reason end as v_reason) from asked2),\n"
        f"classified as (select target_type, target_id, account_id, comment, p, n, case when f_reason <> '' then 'REJECTED' when {shown} then 'REJECTED' else v_decision end as decision,"
        f" case when f_reason <> '' then 1.0 when v_decision <> 'REJECTED' and {shown} then greatest(v_confidence, 0.95) else v_confidence end as confidence, case when f_reason <> '' then f_category else v_category end as category,"
        f" case when f_reason <> '' then 'rule_' || f_reason else concat_ws(',', nullif(v_flags, ''), case when v_decision <> 'REJECTED' and {shown} then 'force_reject_violation' end) end as flags,"
        f" case when f_reason <> '' then f_reason when v_decision <> 'REJECTED' and {shown} and v_reason = '' then 'clear violation' else v_reason end as reason from guarded)\n"
    )


@query("classify_comments", _classified("true") + "select target_id, decision, confidence, category, flags from classified")
def classify_comments(spark, sf):
    return _flat(V.classified_comments(view(spark, sf, "comments", True), _completions(spark, sf)), "target_id")


_JUDGED = (
    f"{with_views('review_verdicts', 'reviews')}{_RULED},\n{Q.review_reasons('reviews', 'review_id', 'comment')},\n"
    f"judged as (select r.review_id, r.is_deleted, case when {Q.blank('r.comment')} then 'APPROVED' when found is not null then 'REJECTED' else s.decision end as decision, case when {Q.blank('r.comment')} or found is not null then 1.0 else s.confidence end as confidence,"
    f" case when {Q.blank('r.comment')} then 'clean' when found is not null then 'rule' else s.category end as category, case when {Q.blank('r.comment')} then 'empty_comment' when found is not null then 'rule_' || found else s.flags end as flags,"
    f" case when {Q.blank('r.comment')} then 'no comment' when found is not null then found else s.reason end as reason from reviews r join reasons using (review_id) join settled s using (review_id))\n"
)


@query("review_text_pipeline", _JUDGED + "select review_id, decision, confidence, category, flags from judged")
def review_text_pipeline(spark, sf):
    reviews = view(spark, sf, "reviews")
    return _flat(V.judged_reviews(view(spark, sf, "reviews", True), view(spark, sf, "review_verdicts", True), R.recent_rejects(reviews, REVIEWS_AT)))


@query("moderate_comments", _classified("not is_deleted") + f", told as (select target_type, target_id, account_id, decision, case decision when 'APPROVED' then 'Approved' when 'REJECTED' then 'Rejected' else 'ManualReview' end as moderation_status, case when decision = 'REJECTED' then {Q.reason_category('category', 'flags', 'reason', 'comment', 'p', 'n')} end as reason_category from classified)\nselect t.*, (select count(*) from told x where x.decision = 'REJECTED' and x.account_id = t.account_id) as violations from told t")
def moderate_comments(spark, sf):
    """Verdict, status and ban reason of every comment, and the violations of its account so far in the batch."""
    done = V.classified_comments(S.active(view(spark, sf, "comments", True)), _completions(spark, sf))
    v = F.col("verdict")
    rows = done.select("target_type", "target_id", "account_id", v["decision"].alias("decision"), S.status_of(v["decision"]).alias("moderation_status"), F.when(v["decision"] == "REJECTED", V.reason_category(v["category"], v["flags"], v["reason"], F.col("comment"))).alias("reason_category"))
    rows = written_once(rows)  # both the rows and their counts read it
    counts = rows.where("decision = 'REJECTED'").groupBy("account_id").agg(F.count("*").alias("violations"))
    return rows.join(counts, "account_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


@query("moderation_receipt", with_views("reviews") + "select w.review_id as review_id, r.review_id is not null as accepted, moderation_status from (select distinct user_id as review_id from events) w left join reviews r using (review_id)")
def moderation_receipt(spark, sf):
    wanted = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("review_id")).distinct()
    rows = view(spark, sf, "reviews").select("review_id", "moderation_status", F.lit(True).alias("accepted"))
    return wanted.join(rows, "review_id", "left").select("review_id", F.coalesce("accepted", F.lit(False)).alias("accepted"), "moderation_status")


def _labels():
    pair = lambda d, x: F.struct(F.col(d).alias("description"), F.col(x).cast("double").alias("score"))
    return F.array(pair("l1", "s1"), pair("l2", "s2"))


def _annotated(spark, sf):
    return I.decided(view(spark, sf, "vision", True).withColumn("labels", _labels()))


_GATE = "case when adult in ('LIKELY', 'VERY_LIKELY') then 'adult' when violence in ('LIKELY', 'VERY_LIKELY') then 'violence' when racy = 'VERY_LIKELY' then 'racy' end"
_TOY = "((s1 >= 0.5 and regexp_matches(l1, '{w}')) or (s2 >= 0.5 and regexp_matches(l2, '{w}')))".format(w="|".join(I.TOY_WEAPONS))
_KIND = "case when {s} < 0.6 then null when regexp_matches({l}, '" + "|".join(I.SUSPICIOUS) + "') then 'suspicious' when " + _TOY + " then null when regexp_matches({l}, '" + "|".join(I.REAL_WEAPONS) + "') then 'real_weapon' when regexp_matches({l}, '" + "|".join(I.UNCLEAR_WEAPONS) + "') then 'unclear_weapon' end"
_WEAPON = f"coalesce({_KIND.format(s='s1', l='l1')}, {_KIND.format(s='s2', l='l2')})"
_FOUND = f"({_TOY} or (s1 >= 0.6 and regexp_matches(l1, '{'|'.join(I.TOY_LABELS)}')) or (s2 >= 0.6 and regexp_matches(l2, '{'|'.join(I.TOY_LABELS)}')))"
_VISION = with_views("vision")


@query("safesearch_gate", f"{_VISION}select image_id, {_GATE} as value from vision")
def safesearch_gate(spark, sf):
    return view(spark, sf, "vision").select("image_id", I.safe_search(F.col("adult"), F.col("violence"), F.col("racy")).alias("value"))


@query("label_weapon_gate", f"{_VISION}select image_id, {_WEAPON} as value from vision")
def label_weapon_gate(spark, sf):
    return view(spark, sf, "vision").withColumn("labels", _labels()).select("image_id", I.label_violation(F.col("labels")).alias("value"))


@query("label_toy_gate", f"{_VISION}select image_id, {_FOUND} as value from vision")
def label_toy_gate(spark, sf):
    return view(spark, sf, "vision").withColumn("labels", _labels()).select("image_id", I.toy_found(F.col("labels")).alias("value"))


@query("top_labels", f"{_VISION}select image_id, l1 || '(' || printf('%.2f', s1) || '), ' || l2 || '(' || printf('%.2f', s2) || ')' as value from vision")
def top_labels(spark, sf):
    return view(spark, sf, "vision").withColumn("labels", _labels()).select("image_id", I.top_labels(F.col("labels"), 5).alias("value"))


@query("vision_decide", f"{_VISION}select image_id, case when coalesce({_GATE}, {_WEAPON}) is not null then 'hard_violation' when ocr = 'Call 0912345678' then 'text_violation' when not {_FOUND} then 'no_toy_label' end as flag, case when coalesce({_GATE}, {_WEAPON}) is null and ocr is distinct from 'Call 0912345678' and {_FOUND} then 'APPROVED' else 'REJECTED' end as decision from vision")
def vision_decide(spark, sf):
    return _annotated(spark, sf).select("image_id", "flag", "decision")


@query("scan_vision_annotations", f"{_VISION}select image_id, adult, violence, racy, 2 as n_labels, l1 as first_label, s1 as first_score, ocr from vision")
def scan_vision_annotations(spark, sf):
    """Annotations with their nested types: a map of likelihoods, an array of labels, the recognised text."""
    nested = view(spark, sf, "vision").select("image_id", F.create_map(*[x for k in ("adult", "violence", "racy") for x in (F.lit(k), F.col(k))]).alias("safe_search"), _labels().alias("labels"), "ocr")
    return nested.select("image_id", *[F.col("safe_search")[k].alias(k) for k in ("adult", "violence", "racy")], F.size("labels").alias("n_labels"), F.get("labels", F.lit(0))["description"].alias("first_label"), F.get("labels", F.lit(0))["score"].alias("first_score"), "ocr")


@query("join_vision_results", with_views("vision", "review_images") + f"select image_id, coalesce(case when v.image_id is null then null when coalesce({_GATE}, {_WEAPON}) is null and ocr is distinct from 'Call 0912345678' and {_FOUND} then 'APPROVED' else 'REJECTED' end, 'MANUAL_REVIEW') as decision from review_images left join vision v using (image_id)")
def join_vision_results(spark, sf):
    return I.with_annotations(view(spark, sf, "review_images").select("image_id"), _annotated(spark, sf)).select("image_id", "decision")


def _image_rows(spark, sf):
    """The pictures as rows of Spark's image source, dealt over tasks: a table of one split holds any number of them."""
    none = F.lit(None).cast("int")
    pictures = view(spark, sf, "pictures")
    return pictures.repartition(4 * spark.sparkContext.defaultParallelism, "file_id").select(F.struct(F.col("file_id").cast("string").alias("origin"), "height", F.col("height").alias("width"), F.when(F.col("height") > 0, F.lit(1)).otherwise(none).alias("nChannels"), F.unhex("pixels").alias("data")).alias("image"))


def _faults(spark, sf):
    return I.screened(_image_rows(spark, sf)).withColumn("file_id", F.col("origin").cast("long"))


_BYTES = "low_ as (select *, ('0x' || low)::int as a, ('0x' || high)::int as b, ('0xc' || substr(md5(cast(file_id as varchar)), 1, 1))::int as tone from pictures)"
_RAMP = "(select {f}(v) from (select unnest(range(64, 191, 2)) as v))"
_STATS = f"{with_views('pictures')}, {_BYTES}, stats as (select file_id, kind, case kind when 0 then 0.0 when 1 then tone::double when 2 then (a + b) / 2 when 3 then {_RAMP.format(f='avg')} end as brightness, case kind when 0 then 0.0 when 1 then 0.0 when 2 then (b - a) / 2 when 3 then {_RAMP.format(f='stddev_pop')} end as deviation from low_),\nfaults as (select file_id, case when brightness is null then 'image_load_failed' when brightness < 20 then 'black_image' when deviation < 10 then 'uniform_image' when kind = 3 then 'blurry_image' end as fault from stats)\n"


@query("image_pixel_stats", _STATS + "select file_id, brightness, deviation, case when kind in (0, 1) then 0.0 end as flat_sharpness from stats")
def image_pixel_stats(spark, sf):
    """Mean and deviation of the gray values; the sharpness of a picture without any edge is 0 (that of others is tested with pictures)."""
    stats = I.pixel_statistics(_image_rows(spark, sf))
    return stats.select(F.col("origin").cast("long").alias("file_id"), F.round("brightness", 9).alias("brightness"), F.round("deviation", 9).alias("deviation"), F.when(F.round("deviation", 9) == 0, F.round("sharpness", 9)).alias("flat_sharpness"))


@query("image_quality_screen", _STATS + "select file_id, fault from faults")
def image_quality_screen(spark, sf):
    return _faults(spark, sf).select("file_id", "fault")


def _stored(spark, sf):
    """A folder of the pictures as files."""
    folder = shared_folder(spark)
    write_pictures(view(spark, sf, "pictures"), folder)
    return folder


@query("image_load_failures", _STATS + "select file_id, 'REJECTED' as decision, 'image_load_failed' as flag from faults where fault = 'image_load_failed'")
def image_load_failures(spark, sf):
    """The files, of those that are there, that decode as no picture."""
    folder = _stored(spark, sf)
    return I.unreadable(read_files(spark, folder).select("file_id"), read_pictures(spark, folder).select("file_id", F.lit(None).cast("string").alias("fault")), "file_id")


_FILES = with_views("image_files")


def _files(spark, sf):
    return view(spark, sf, "image_files").select("file_id", "path", "length", F.unhex("head").alias("content"))


@query("scan_image_files", with_views("pictures") + "select file_id, lpad(file_id::varchar, 20, '0') || '.bmp' as name, (case when kind = 4 then 13 else 54 + 1024 + 4096 end)::bigint as length, case when kind = 4 then '6E6F7420' else '424D3614' end as head from pictures")
def scan_image_files(spark, sf):
    """Size and first bytes of the pictures' files, as they are read back."""
    return read_files(spark, _stored(spark, sf)).select("file_id", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.hex(F.substring("content", 1, 4)).alias("head"))


@query("image_size_gate", f"{_FILES}select file_id, case when length < 10240 then 'too_small' when length > 5242880 then 'too_large' when not (head like 'FFD8FF%' or head in ('89504E47', '52494646')) then 'unknown_format' end as refused from image_files")
def image_size_gate(spark, sf):
    return I.size_gate(_files(spark, sf)).select("file_id", "refused")


_OCR = "case when raw is null then 'APPROVED' when not starts_with(raw, '{') then 'APPROVED' else raw->>'$.decision' end"
_OCR_FLAG = "case when raw is null then 'ocr_llm_skipped_on_error' when not starts_with(raw, '{') then 'ocr_llm_parse_fallback' else coalesce(raw->>'$.flags[0]', '') end"


@query("ocr_verdict", with_views("ocr_completions") + f"select image_id, {_OCR} as decision, case when raw is null or not starts_with(raw, '{{') then 0.85 else (raw->>'$.confidence')::double end as confidence, {_OCR_FLAG} as flag from ocr_completions")
def ocr_verdict(spark, sf):
    said = view(spark, sf, "ocr_completions").select("image_id", F.array(V.read_ocr(F.col("raw"))).alias("v")).withColumn("v", F.element_at("v", 1))
    return said.select("image_id", "v.decision", "v.confidence", F.array_join("v.flags", ",").alias("flag"))


def _judged_images(spark, sf):
    return I.judged_images(S.active(view(spark, sf, "review_images")), _faults(spark, sf), _annotated(spark, sf), view(spark, sf, "ocr_completions"))


_SEEN_FLAG = f"case when coalesce({_GATE}, {_WEAPON}) is not null then 'hard_violation' when ocr = 'Call 0912345678' then 'text_violation' when not {_FOUND} then 'no_toy_label' end"
_TOP = "l1 || '(' || printf('%.2f', s1) || '), ' || l2 || '(' || printf('%.2f', s2) || ')'"
_IMAGE_PIPELINE = (
    _STATS.replace("with pictures", ", pictures")
    + with_views("vision", "review_images", "ocr_completions").replace("with vision", ", vision")
    + f""", seen as (select image_id, {_SEEN_FLAG} as seen_flag, coalesce({_GATE}, {_WEAPON}, case when ocr = 'Call 0912345678' then 'phone' end, {_TOP}) as seen_reason, ocr from vision),
said as (select image_id, {_OCR} as said, case when raw is null or not starts_with(raw, '{{') then '' else raw->>'$.reason' end as said_reason from ocr_completions),
joined as (select i.image_id, i.review_id, case when f.file_id is null then 'image_load_failed' else f.fault end as fault, s.image_id is not null as has, seen_flag, seen_reason, ocr, said, said_reason from review_images i left join faults f using (file_id) left join seen s using (image_id) left join said using (image_id) where not i.is_deleted),
over_ as (select *, has and seen_flag is null and length(regexp_replace(coalesce(ocr, ''), '[^a-zA-Z0-9]', '', 'g')) >= 5 and said <> 'APPROVED' as overruled from joined),
final_images as (select image_id, review_id, case when fault is not null then 'REJECTED' when not has then 'MANUAL_REVIEW' when overruled then said when seen_flag is null then 'APPROVED' else 'REJECTED' end as decision, case when fault is not null then fault when not has then 'vision_api_failed' when overruled then 'vision_ocr_llm' else seen_flag end as flag,
 case when fault is not null then fault when not has then 'no annotation' when overruled then 'text in the image: ' || said_reason else seen_reason end as reason from over_)
"""
)


@query("review_image_pipeline", "with" + _IMAGE_PIPELINE.lstrip(", ").replace("pictures as", " pictures as", 1) + "select image_id, review_id, decision, flag, reason from final_images")
def review_image_pipeline(spark, sf):
    """Every image of a review, not deleted: load and quality, annotations, the verdict on its text."""
    return _judged_images(spark, sf)


@query("moderate_reviews", _JUDGED + _IMAGE_PIPELINE + """, level_of as (select *, case decision when 'REJECTED' then 2 when 'MANUAL_REVIEW' then 1 else 0 end as lv from final_images),
worst as (select review_id, max(lv) as image_level, first(reason order by lv desc, image_id, reason) as image_reason from level_of group by review_id),
both_ as (select j.review_id, case j.decision when 'REJECTED' then 2 when 'MANUAL_REVIEW' then 1 else 0 end as lv, j.reason, image_level, image_reason from judged j left join worst using (review_id) where not j.is_deleted),
final as (select *, greatest(lv, coalesce(image_level, 0)) as level from both_)
select review_id, ['APPROVED', 'MANUAL_REVIEW', 'REJECTED'][level + 1] as decision, case when lv = level then reason else image_reason end as reason, ['Approved', 'ManualReview', 'Rejected'][level + 1] as moderation_status from final""")
def moderate_reviews(spark, sf):
    """Text and image verdicts of all reviews that are not deleted, their status and the reason for it."""
    reviews = S.active(view(spark, sf, "reviews", True))
    every = view(spark, sf, "reviews")
    texts = V.judged_reviews(reviews, view(spark, sf, "review_verdicts"), R.recent_rejects(every, REVIEWS_AT)).select("review_id", "verdict.decision", "verdict.reason")
    images = _judged_images(spark, sf).select("image_id", "review_id", "decision", "reason")
    return R.combined(texts, images).withColumn("moderation_status", S.status_of(F.col("decision")))


def over_articles(name, column, sql=None):
    """A query with one value for each article request."""

    def run(spark, sf):
        return view(spark, sf, "articles").select("doc_id", column().alias("value"))

    query(name, sql and f"{with_views('articles')}select doc_id, {sql} as value from articles")(run)


def _context():
    return B.context(F.col("title"), F.col("structure"))


_DUCK_CTX = "trim(trim(title) || chr(10) || trim(structure))"
over_articles("blog_context", _context, _DUCK_CTX)
_ARTICLES = f"{with_views('articles')},\n{Q.article_forms(_DUCK_CTX)}\n"
_SOURCE = f"{with_views('articles')},\nforms as (select *, {Q.checked('structure')} as k, {Q.plain(Q.normal('structure'))} as n from articles)\n"
over_articles("gate_hard_emoji", lambda: B.first(B.hits(_context(), B.HARD_EMOJI)), f"({Q.hits(_DUCK_CTX, B.HARD_EMOJI)})[1]")


def over_requests(name, columns, sql, source=_ARTICLES):
    """A query with several values for each article request; its SQL sees the context c, its checked form k, and n, the plain form of its normal form."""

    def run(spark, sf):
        # Packed in an array: the optimizer would take a struct apart and compute it once for each field.
        found = view(spark, sf, "articles").select("doc_id", F.array(F.struct(*[c.alias(k) for k, c in columns().items()])).alias("found"))
        return found.select("doc_id", *[F.element_at("found", 1)[k].alias(k) for k in columns()])

    query(name, f"{source}select doc_id, {', '.join(f'{v} as {k}' for k, v in sql.items())} from forms")(run)


def over_found(name, column, fields, sql, source=_ARTICLES):
    """The same for the fields of one struct."""

    def run(spark, sf):
        found = view(spark, sf, "articles").select("doc_id", F.array(column()).alias("found"))
        return found.select("doc_id", *[F.element_at("found", 1)[k].alias(k) for k in fields])

    query(name, f"{source}select doc_id, {', '.join(f'{v} as {k}' for k, v in zip(fields, sql, strict=True))} from forms")(run)


_DECISION, _SCORE = Q.aim("k")
_INJECTED, _UNSAFE = f"({Q.hits('k', B.INJECTIONS)})[1]", Q.unsafe("c", "k", "n")
_KIND_OF = f"case when {_INJECTED} is not null then 'prompt_injection' when {Q.branded('k')} is not null then 'external_brand' when {Q.themed('k')} is not null then 'unsafe_theme' when {_UNSAFE} is not null then 'unsafe_content' end"
_WORD_OF = f"coalesce({_INJECTED}, {Q.branded('k')}, {Q.themed('k')}, {_UNSAFE})"
over_requests("detect_prompt_injection", lambda: {"value": B.first(B.hits(B.checked(_context()), B.INJECTIONS))}, {"value": _INJECTED})
over_requests("detect_external_brand", lambda: {"value": B.brand(_context())}, {"value": Q.branded("k")})
over_requests("detect_unsafe_theme", lambda: {"value": B.unsafe_theme(_context())}, {"value": Q.themed("k")})
over_requests("detect_unsafe_content", lambda: {"value": B.unsafe_content(_context())}, {"value": _UNSAFE})
over_found("classify_intent", lambda: B.intent(F.col("title"), F.col("structure"), F.col("category_id")), ["decision", "score"], [_DECISION, _SCORE])
over_found("safety_check", lambda: B.safety(F.col("title"), F.col("structure")), ["kind", "keyword"], [_KIND_OF, _WORD_OF])
_EMOJI_OF = f"({Q.hits('c', B.HARD_EMOJI)})[1]"
_BLANK = "coalesce(trim(title), '') = '' or coalesce(trim(structure), '') = ''"
_SCREENED = (
    f"{_ARTICLES}, judged as (select *, {_DECISION} as d, {_KIND_OF} as x, {_WORD_OF} as w, {_EMOJI_OF} as e, {_BLANK} as b from forms),\n"
    "screened as (select doc_id, title, case when b or e is not null or d = 'block' or x is not null then 'blocked' else 'accepted' end as status, case when b then 'validation_error' when e is not null then 'emoji' when d = 'block' then 'off_topic' else coalesce(x, d) end as kind, case when b then null when e is not null then e when d = 'block' then null else w end as keyword from judged)\n"
)


# All steps of the service: no field may be blank and none without a category; the source text warns; equal requests share an answer for a time.
_REFUSED = " or ".join(f"not regexp_matches(coalesce({c}, ''), '[^{Q.SPACES}]')" for c in ("title", "structure")) + " or coalesce(category_id, 0) <= 0"
_EQUAL = "sha256(" + " || '|' || ".join(f"coalesce({c}::varchar, '')" for c in B.REQUEST_FIELDS) + ")"
_NEW = f"a.at is null or x.at - a.at > {DEFAULT.reuse_seconds * 1_000_000}"
_ANSWERED = "struct(doc_id bigint, answered_by bigint)[]"
_REQUESTS = (
    f"{with_views('article_requests')},\n{Q.article_forms(_DUCK_CTX, 'article_requests')}, judged as (select *, {_DECISION} as d, {_KIND_OF} as x, {_WORD_OF} as w, {_EMOJI_OF} as e, {_REFUSED} as b from forms),\n"
    f"screened as (select doc_id, asked_at, coalesce(source_content, '') as source, {_EQUAL} as request, case when b or e is not null or d = 'block' or x is not null then 'blocked' else 'accepted' end as status, case when b then 'validation_error' when e is not null then 'emoji' when d = 'block' then 'off_topic' else coalesce(x, d) end as kind, case when b then null when e is not null then e when d = 'block' then null else w end as keyword from judged),\n"
    f"sources as (select *, {Q.checked('source')} as sk, {Q.plain(Q.normal('source'))} as sn from screened),\n"
    f"warned as (select *, case when status = 'accepted' then {Q.unsafe('source', 'sk', 'sn')} end as source_warning from sources),\n"
    f"answers as (select unnest(list_reduce(list(struct_pack(first := doc_id, at := epoch_us(asked_at), doc_id := doc_id, done := []::{_ANSWERED}) order by asked_at, doc_id),\n"
    f" lambda a, x: struct_pack(first := case when {_NEW} then x.doc_id else a.first end, at := case when {_NEW} then x.at else a.at end, doc_id := x.doc_id, done := list_append(a.done, struct_pack(doc_id := x.doc_id, answered_by := case when {_NEW} then x.doc_id else a.first end))),\n"
    f" struct_pack(first := null::bigint, at := null::bigint, doc_id := null::bigint, done := []::{_ANSWERED})).done) as r from screened where status = 'accepted' group by request)\n"
)


@query("screen_blog_requests", _REQUESTS + "select doc_id, status, kind, keyword, source_warning, r.answered_by as answered_by from warned left join answers on doc_id = r.doc_id")
def screen_blog_requests(spark, sf):
    return B.screened_requests(view(spark, sf, "article_requests"), "doc_id")


def _screened(spark, sf):
    """The status for `suggestions_for_blocked`, whose SQL knows neither the category nor other white space."""
    found = view(spark, sf, "articles").withColumn("found", F.array(B.screened(F.col("title"), F.col("structure"), F.col("category_id"), lenient=True))).withColumn("f", F.element_at("found", 1))
    return found.select("doc_id", "title", "structure", "category_id", "f.status", "f.kind", "f.keyword")


over_requests("source_content_warning", lambda: {"value": B.unsafe_content(F.col("structure")).isNotNull()}, {"value": f"{Q.unsafe('structure', 'k', 'n')} is not null"}, _SOURCE)
_BARE = "[" + "".join(B.HARD_EMOJI) + "]"
_OUT = f"{with_views('articles')},\nforms as (select *, {Q.checked('c')} as k, {Q.plain(Q.normal('c'))} as n from (select *, regexp_replace(structure, '{_BARE}', '', 'g') as c from articles))\n"
over_requests("output_validation", lambda: {"value": B.output_fault(F.col("structure"))}, {"value": f"coalesce({_UNSAFE}, case when len({Q.hits('k', B.HATE)}) > 0 then 'hate_content' end)"}, _OUT)


def _page(title, structure):
    """A finished article in HTML, as the gates see it."""
    return F.when(F.col("category_id") == 3, structure).otherwise(F.concat(F.lit("<h2>"), title, F.lit("</h2><p>"), structure, F.lit("</p>")))


_DUCK_PAGE = "case when category_id = 3 then structure else '<h2>' || title || '</h2><p>' || structure || '</p>' end"
over_articles("article_quality_gate", lambda: T.let(_page(F.col("title"), F.col("structure")), lambda x: B.echoed(x) | B.incomplete(x)), f"(select regexp_matches(lower(x), '{'|'.join(B.ECHOES)}') or (contains(lower(x), 'action:') and contains(lower(x), 'promptstructure:')) or (contains(lower(x), '{{\"title\"') and contains(lower(x), '\"content\"')) or length(x) < 3000 or not contains(lower(x), '<h2') or not contains(lower(x), '<p') from (select {_DUCK_PAGE} as x))")
_LINES = "list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(regexp_replace(x, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'))), lambda x: x <> '')"
_BULLET = "coalesce(regexp_matches({x}, '^[-*]\\s+'), false)"
_LINE = (
    f"case when {_BULLET.format(x='x')} then case when i = 1 or not {_BULLET.format(x='a[i - 1]')} then '<ul>' else '' end || '<li>' || regexp_replace(x, '^[-*]\\s+', '') || '</li>' || case when i = len(a) or not {_BULLET.format(x='a[i + 1]')} then '</ul>' else '' end"
    " when regexp_matches(x, '^(#{1,3})\\s+') then '<h' || length(regexp_extract(x, '^(#{1,3})\\s+', 1)) || '>' || regexp_replace(x, '^#{1,3}\\s+', '') || '</h' || length(regexp_extract(x, '^(#{1,3})\\s+', 1)) || '>' else '<p>' || x || '</p>' end"
)


def as_html(m: str) -> str:
    return f"(select case when regexp_matches(m, '(?i)<(?:p|h[1-6]|ul|div)[\\s>]') then m else array_to_string(list_transform(a, lambda x, i: {_LINE}), chr(10)) end from (select m, {_LINES} as a from (select {m} as m)))"


_MARKDOWN = "'## ' || title || chr(10) || '- one' || chr(10) || '- two' || chr(10) || structure"
over_articles("markdown_to_html", lambda: B.as_html(F.concat(F.lit("## "), F.col("title"), F.lit("\n- one\n- two\n"), F.col("structure"))), as_html(_MARKDOWN))


def without_markers(x: str, title: str) -> str:
    headless = f"case when regexp_matches(lower({x}), '^\\s*<h1[^>]*>\\s*') and starts_with(regexp_replace(lower({x}), '^\\s*<h1[^>]*>\\s*', ''), lower(trim({title})) || '</h1>') then substr({x}, length({x}) - length(regexp_replace(lower({x}), '^\\s*<h1[^>]*>\\s*', '')) + length(trim({title})) + 6) else {x} end"
    out = f"regexp_replace({headless}, '(?is)<p>\\s*(?:title|description)\\s*:\\s*.*?</p>', '', 'g')"
    return f"trim(regexp_replace({out}, '(?i)<p>\\s*(?:mở bài|thân bài|kết bài|than bai|ket bai)\\s*:?\\s*</p>', '', 'g'))"


over_articles("strip_markers", lambda: B.without_markers(F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1><p>title: x</p><p>"), F.col("structure"), F.lit("</p>")), F.col("title")), without_markers("'<h1>' || title || '</h1><p>title: x</p><p>' || structure || '</p>'", "title"))


def _regex_quoted(c: str) -> str:
    return f"regexp_replace({c}, '([\\\\.+*?\\[^\\]$(){{}}=!<>|:#-])', '\\\\\\1', 'g')"


def without_prompt_line(x: str, line: str) -> str:
    word = _regex_quoted(line)
    out = f"regexp_replace(regexp_replace({x}, '(?i)<li>\\s*' || {word} || '\\s*</li>', '', 'g'), '(?i)<p>\\s*' || {word} || '\\s*</p>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)(?:^|\\n)\\s*[-*•]\\s*' || {word} || '\\s*(?:$|\\n)', chr(10), 'g')"
    return f"case when {line} = '' then {x} else {out} end"


over_articles("strip_prompt_leakage", lambda: B.without_prompt_lines(F.concat(F.lit("<ul><li>"), F.col("title"), F.lit("</li></ul><p>"), F.col("structure"), F.lit("</p>")), F.col("title")), f"trim(regexp_replace({without_prompt_line("'<ul><li>' || title || '</li></ul><p>' || structure || '</p>'", "regexp_replace(title, '^[ *\\t-]+|[ *\\t-]+$', '', 'g')")}, '(?i)<ul>\\s*</ul>', '', 'g'))")


def _completion():
    """Raw completions of all kinds: plain, fenced, in a sentence, with the other field name, broken, none."""
    said, other = F.to_json(F.struct("title", F.col("structure").alias("content"))), F.to_json(F.struct("title", F.col("structure").alias("blogContent")))
    kind = F.col("doc_id") % 6
    return F.when(kind == 0, said).when(kind == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("here: "), other, F.lit(" ok"))).when(kind == 3, F.col("structure")).when(kind == 4, other)


over_articles("parse_article_json", lambda: B.parsed_article(_completion())["content"], "case when title is not null and doc_id % 6 in (0, 1, 2, 4) then structure end")
_FINAL = (
    f"{with_views('articles')},\ntext_of as (select doc_id, {as_html(chr(39) + '## ' + chr(39) + ' || title || chr(10) || structure')} as h, title from articles),\n"
    f"cleaned as (select doc_id, regexp_replace(trim(regexp_replace({without_prompt_line(without_prompt_line(without_markers('substr(h, 1, 10000)', 'title'), chr(39) + 'one' + chr(39)), chr(39) + 'two' + chr(39))}, '(?i)<ul>\\s*</ul>', '', 'g')), '{_BARE}', '', 'g') as c from text_of),\n"
    f"forms as (select *, {Q.checked('c')} as k, {Q.plain(Q.normal('c'))} as n, lower(c) as low from cleaned)\n"
    f"select doc_id, case when regexp_matches(low, '{'|'.join(B.ECHOES)}') or (contains(low, 'action:') and contains(low, 'promptstructure:')) or (contains(low, '{{\"title\"') and contains(low, '\"content\"')) then 'echo' when length(c) < 3000 or not contains(low, '<h2') or not contains(low, '<p') then 'incomplete'"
    f" when regexp_matches(' ' || low || ' ', '{'|'.join(B.VIETNAMESE_SIGNALS)}') then 'vietnamese' else coalesce({_UNSAFE}, case when len({Q.hits('k', B.HATE)}) > 0 then 'hate_content' end) end as value from forms"
)


@query("finalize_articles", _FINAL)
def finalize_articles(spark, sf):
    done = B.finished(F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("structure")), F.col("title"), F.lit("- one\n- two"))
    return view(spark, sf, "articles").select("doc_id", F.array(done).alias("done")).select("doc_id", F.element_at("done", 1)["fault"].alias("value"))


over_articles("validate_blog_requests", lambda: F.col("title").isNotNull() & F.length(F.trim("title")).between(1, 255) & F.length("structure").between(1, 5000) & (F.col("category_id") > 0), "length(trim(title)) between 1 and 255 and length(structure) between 1 and 5000 and category_id > 0")


@query("scan_blog_requests", with_views("articles") + "select doc_id, title, cast(category_id as bigint) as category_id from articles")
def scan_blog_requests(spark, sf):
    return view(spark, sf, "articles").select("doc_id", "title", F.col("category_id").cast("long").alias("category_id"))


_KINDS = "case when regexp_matches(c, '{}') then '{}' when regexp_matches(c, '{}') then '{}' else '{}' end".format("|".join(B.REVIEW_WORDS), B.SUGGESTIONS["review"][0], "|".join(B.BUYING_WORDS), B.SUGGESTIONS["buying"][0], B.SUGGESTIONS["other"][0])


@query("fallback_suggestions", with_views("articles") + f"select doc_id, {_KINDS} as value from (select doc_id, lower(title) as c from articles)")
def fallback_suggestions(spark, sf):
    return view(spark, sf, "articles").select("doc_id", F.get(B.fallback_suggestions(F.col("title"), F.lit("")), F.lit(0)).alias("value"))


@query("suggestions_fill", with_views("articles") + f"select doc_id, concat_ws('|', nullif(trim(title), ''), 'a', 'b', 'c', case when trim(title) = '' then 'd' end) as value from articles")
def suggestions_fill(spark, sf):
    fallback = F.array(*[F.lit(x) for x in "abcd"])
    return view(spark, sf, "articles").select("doc_id", F.array_join(B.filled(F.array("title", F.lit("  "), F.lit(None).cast("string")), fallback), "|").alias("value"))


@query("join_rules_dim", with_views("texts", "rules") + "select doc_id, (select arg_min(lower(word), rule_id) from rules where word <> '' and contains(lower(coalesce(text, '')), lower(word))) as rule from texts")
def join_rules_dim(spark, sf):
    return B.first_rule(view(spark, sf, "texts").select("doc_id", "text"), view(spark, sf, "rules"), "text").select("doc_id", "rule")


@query("ocr_override", with_views("vision", "ocr_completions") + f"select image_id, case when d = 'APPROVED' and length(regexp_replace(coalesce(ocr, ''), '[^a-zA-Z0-9]', '', 'g')) >= 5 then said else d end as decision from (select *, {_OCR} as said, case when {_SEEN_FLAG} is null then 'APPROVED' else 'REJECTED' end as d from vision join ocr_completions using (image_id))")
def ocr_override(spark, sf):
    rows = _annotated(spark, sf)
    verdicts = ocr_verdict(spark, sf).select("image_id", F.col("decision").alias("text_decision"))
    return I.with_text_verdicts(rows.select("image_id", "decision", "ocr"), verdicts).select("image_id", "decision")


_FALLBACK = "case when regexp_matches(m, '{}') then {} when regexp_matches(m, '{}') then {} else {} end".format("|".join(B.REVIEW_WORDS), Q.listed(B.SUGGESTIONS["review"]), "|".join(B.BUYING_WORDS), Q.listed(B.SUGGESTIONS["buying"]), Q.listed(B.SUGGESTIONS["other"]))


@query("suggestions_for_blocked", _SCREENED + ", " + with_views("suggestion_completions").removeprefix("with ") + f", asked as (select doc_id, raw, {Q.checked(chr(97) + '.title || ' + chr(39) + ' ' + chr(39) + ' || a.structure')} as m from screened s join articles a using (doc_id) join suggestion_completions using (doc_id) where status = 'blocked'),\nsaid as (select *, case doc_id % 5 when 2 then ['one ' || doc_id, 'two'] when 3 then ['a', 'b', 'c', 'd', 'e'] else [] end as own from asked)\nselect doc_id, array_to_string(list_concat(own, {_FALLBACK})[1:4], '|') as suggestions from said")
def suggestions_for_blocked(spark, sf):
    found = B.suggestions_for_blocked(_screened(spark, sf), view(spark, sf, "suggestion_completions"), "doc_id")
    return found.select("doc_id", F.array_join("suggestions", "|").alias("suggestions"))


_TOPIC = "case " + " ".join(f"when regexp_matches(m, '{'|'.join(words)}') then '{name}'" for name, words in B.TOPIC_WORDS.items() if words) + f" else '{list(B.TOPIC_WORDS)[-1]}' end"
_TOPICS = f"{with_views('articles')}, topics as (select *, {_TOPIC} as topic from (select *, lower(coalesce(title, '') || chr(10) || coalesce(structure, '')) as m from articles))\n"


def _per_topic(table) -> str:
    return "case topic " + " ".join(f"when '{k}' then {Q.listed(v) if isinstance(v, tuple) else Q.quoted(v)}" for k, v in table.items()) + " end"


def _picked(seed: str, options: str) -> str:
    return f"({options})[(('0x' || substr(sha256({seed}), 1, 8))::bigint % len({options}) + 1)::int]"


_SEED = "coalesce(title, '') || '||' || coalesce(structure, '')"


@query("topic_profile", _TOPICS + f"select doc_id, topic, {_per_topic(B.TOPIC_ANGLES)} as angle, array_to_string({_per_topic(B.TOPIC_SECTIONS)}, '|') as sections, {_per_topic(B.TOPIC_CALLS)} as call from topics")
def topic_profile(spark, sf):
    rows = view(spark, sf, "articles").select("doc_id", F.array(B.topic_profile(F.col("title"), F.col("structure"))).alias("p")).withColumn("p", F.element_at("p", 1))
    return rows.select("doc_id", "p.topic", "p.angle", F.array_join("p.sections", "|").alias("sections"), "p.call")


@query("writing_strategy", _TOPICS + f"select doc_id, {_picked(_SEED + ' || ' + chr(39) + '|Warm|intro' + chr(39), Q.listed(B.OPENINGS))} as opening, {_picked(_SEED + ' || ' + chr(39) + '|Warm|structure' + chr(39), Q.listed(B.STRUCTURES))} as structure, {_picked(_SEED + ' || ' + chr(39) + '|Warm|cta' + chr(39), Q.listed(B.CALL_STYLES))} as call_style, {_per_topic(B.TOPIC_ANGLES)} as angle from topics")
def writing_strategy(spark, sf):
    rows = view(spark, sf, "articles").select("doc_id", F.array(B.writing_strategy(F.col("title"), F.col("structure"), F.lit("Warm"))).alias("s")).withColumn("s", F.element_at("s", 1))
    return rows.select("doc_id", "s.opening", "s.structure", "s.call_style", F.col("s.profile.angle").alias("angle"))


_PROPOSED = "case doc_id % 4 when 0 then null when 1 then title || '!' when 2 then 'Cho con đồ chơi vui' else ' A new title ' end"
_PLAIN_TITLE = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


@query("rewrite_title", _TOPICS + f", proposed as (select *, case when trim(coalesce(x, '')) = '' or contains(' ' || lower(x) || ' ', ' đồ chơi ') then {Q.quoted(B.DEFAULT_TITLE)} else trim(x) end as own from (select *, {_PROPOSED} as x from topics))\nselect doc_id, case when {_PLAIN_TITLE.format('own')} = {_PLAIN_TITLE.format('title')} then {_picked(_SEED, _per_topic(B.TOPIC_TITLES))} else own end as value from proposed")
def rewrite_title(spark, sf):
    return view(spark, sf, "articles").select("doc_id", B.rewritten_title(F.expr(_PROPOSED), F.col("title"), F.col("structure")).alias("value"))


_INTRO = "This article helps parents to find toys that are safe, fit the age and are worth playing with."
_BUILT = f"{Q.quoted(B.ARTICLE_OPENING.format(intro=_INTRO))} || array_to_string(list_transform(list_concat({_per_topic(B.TOPIC_SECTIONS)}, {Q.listed(B.ARTICLE_POINTS)})[1:8], lambda x: '<li>' || x || '</li>'), '') || {Q.quoted(B.ARTICLE_MIDDLE)} || '<p>With a warm and thoughtful hand, every day''s play can become a memory.</p><p><strong>Next:</strong> ' || {_per_topic(B.TOPIC_CALLS)} || '</p>'"


@query("fallback_article", _TOPICS + f"select doc_id, case when length(x) < 3000 then x || {Q.quoted(B.ARTICLE_FILLING)} else x end as value from (select doc_id, {_BUILT} as x from topics)")
def fallback_article(spark, sf):
    return view(spark, sf, "articles").select("doc_id", B.fallback_article(F.col("title"), F.col("structure"), F.lit("Warm")).alias("value"))
