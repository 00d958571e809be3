"""Model verdicts: parsing raw completions, choosing a provider, overrides and reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.config import DECISIONS, DEFAULT, Settings
from moderata.functions import detect as D
from moderata.functions import text as T

# What makes a comment rejected whatever the model decided.
REJECT_CATEGORIES = ("offensive", "profanity_mild", "abusive", "discriminatory", "harassment", "bullying", "spam", "ads", "link_spam", "competitor_ad", "sexual", "adult", "child_unsafe", "violent", "threat", "privacy", "doxxing")
REJECT_FLAGS = ("offensive", "profanity", "abusive", "discriminatory", "harassment", "bullying", "spam", "link", "url", "sexual", "adult", "child_unsafe", "violent", "threat", "privacy", "doxx", "email", "phone", "bank", "address", "contact")
REJECT_REASONS = ("profanity", "offensive", "abusive", "toxic", "vulgar", "insult", "harass", "hate", "sexual", "violent", "privacy", "personal", "doxx", "email", "phone", "address")
PRIVACY_TOKENS = ("privacy", "personal", "doxx", "email", "phone", "contact", "address", "bank", "pii")
CONTACT_CUE = r"(?iU)\b(?:email|mail|phone|tel|contact|zalo|whatsapp|telegram|address|addr|sdt|sdt[h]?|lien he|dia chi)\b"
DIGIT_BLOCK = r"(?<!\d)(?:\d[\s.\-]?){7,14}(?!\d)"
SPAM_CATEGORIES = ("spam", "ads", "link_spam", "competitor_ad", "unrelated")
PRIVACY_CATEGORIES = ("privacy", "doxxing")

VERDICT = "struct<decision:string,confidence:double,category:string,flags:array<string>,reason:string>"
_RAW = "struct<decision:string,confidence:string,category:string,flags:string,reason:string>"


def verdict(decision: Column, confidence: Column, category: Column, flags: Column, reason: Column) -> Column:
    return F.struct(decision.alias("decision"), confidence.cast("double").alias("confidence"), category.alias("category"), flags.cast("array<string>").alias("flags"), reason.alias("reason"))


def fixed_verdict(decision: str, confidence: float, category: str, flag: str | None, reason: str) -> Column:
    return verdict(F.lit(decision), F.lit(confidence), F.lit(category), F.array(*[F.lit(flag)] * (flag is not None)), F.lit(reason))


def parsed(raw: Column) -> Column:
    """The verdict in a completion: the fenced or outermost object behind any thinking; manual review where none parses.

    A JSON value that is no object counts as a failed call: null. Confidence: 1.0 if approved else 0.5 where it is
    missing; 0.5 where it is no number or outside 0 to 1.
    """
    def outermost(said: Column) -> Column:
        fenced = F.regexp_extract(said, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
        outer = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
        plain = said.startswith("{") & said.endswith("}") & ~said.contains("```")  # the common case needs no search
        return F.when(plain, said).otherwise(T.let(F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(outer, F.lit(""))), lambda x: F.trim(F.coalesce(x, said))))

    def read(body: Column) -> Column:
        good = F.try_parse_json(body).isNotNull()
        failed = fixed_verdict("MANUAL_REVIEW", 0.0, "ambiguous", "llm_parse_error", "unreadable completion")
        return F.when(~good, failed).when(body.startswith("{"), T.let(F.from_json(body, _RAW, {"mode": "PERMISSIVE"}), filled))

    def filled(fields: Column) -> Column:
        named = F.upper(F.coalesce(fields["decision"], F.lit("MANUAL_REVIEW")))
        decision = F.when(named.isin(*DECISIONS), named).otherwise("MANUAL_REVIEW")
        given = fields["confidence"]
        number = F.when(given.isin("true", "false"), (given == "true").cast("double")).otherwise(given.try_cast("double"))
        confidence = F.when(given.isNull(), F.when(decision == "APPROVED", 1.0).otherwise(0.5)).when(number.between(0.0, 1.0), number).otherwise(0.5)
        none = F.array().cast("array<string>")
        flags = F.when(fields["flags"] == "[]", none).otherwise(F.coalesce(F.from_json(F.when(fields["flags"].startswith("["), fields["flags"]), "array<string>"), none))
        return verdict(decision, confidence, F.lower(F.coalesce(fields["category"], F.lit("ambiguous"))), flags, F.coalesce(fields["reason"], F.lit("")))

    said = F.when(raw.contains("<think>"), F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")).otherwise(raw)
    return F.when(raw.isNotNull(), T.let(T.let(said, lambda x: F.regexp_replace(outermost(x), r",\s*([\]}])", "$1")), read))


def with_verdicts(rows: DataFrame, completions: DataFrame, key: str, first: str = "primary_raw", second: str = "secondary_raw", asked: Column | None = None) -> DataFrame:
    """The rows with the verdict of the first provider that answered, else a failed call for a person to review.

    asked: which rows need one; the verdict of the others is null, and their completions are not parsed.
    """
    failed = fixed_verdict("MANUAL_REVIEW", 0.0, "ambiguous", "llm_call_failed", "no completion")
    if asked is not None:
        given = completions.select(key, F.coalesce(first, second).alias("_raw"))
        # Packed in an array: the optimizer would take a struct apart and parse once for each field.
        out = rows.join(given, key, "left").withColumn("verdict", F.array(F.when(asked, F.coalesce(parsed(F.col("_raw")), failed))))
        return out.withColumn("verdict", F.element_at("verdict", 1)).drop("_raw")
    found = completions.select(key, parsed(F.coalesce(first, second)).alias("verdict"))
    return rows.join(found, key, "left").withColumn("verdict", F.coalesce("verdict", failed))


def providers_as_rows(completions: DataFrame, key: str) -> DataFrame:
    """(key, provider, completion): one row for each answer that a provider gave."""
    rows = completions.select(key, F.explode(F.create_map(F.lit("primary"), "primary_raw", F.lit("secondary"), "secondary_raw")).alias("provider", "completion"))
    return rows.where("completion is not null")


def reviewed(rows: DataFrame, completions: DataFrame, key: str, first: str = "primary_raw", second: str = "secondary_raw") -> DataFrame:
    """The rows with the model's verdict and who decided: the model, or its failure."""
    return with_verdicts(rows, completions, key, first, second).withColumn("decided_by", F.when(F.array_contains(F.col("verdict")["flags"], "llm_call_failed"), "llm_error").otherwise("llm"))


def with_flag(flags: Column, flag: str) -> Column:
    """The flags with one more, which is there once."""
    return F.when(F.array_contains(flags, flag), flags).otherwise(F.concat(flags, F.array(F.lit(flag))))


def read_ocr(raw: Column) -> Column:
    """The verdict on recognised text: a call that failed, or an answer that can't be read, approves the image with a mark of its own."""
    passed = lambda flag: fixed_verdict("APPROVED", 0.85, "clean", flag, "passed the local checks")
    # What is no JSON object counts as a failed call.
    return F.when(raw.isNull(), passed("ocr_llm_skipped_on_error")).otherwise(
        T.let(parsed(raw), lambda v: F.when(v.isNull(), passed("ocr_llm_skipped_on_error")).when(F.array_contains(v["flags"], "llm_parse_error"), passed("ocr_llm_parse_fallback")).otherwise(v))
    )


def prompt(rating: Column, content: Column, cleaned: Column) -> Column:
    """What a model is asked about a review: rating, text, the decoded text where it differs, the instruction."""
    block = lambda title, x: F.concat(F.lit(f"{title}\n---\n"), x, F.lit("\n---"))
    body = F.coalesce(content, F.lit(""))
    decoded = F.when((cleaned != "") & (F.trim(cleaned) != F.trim(body)), block("Decoded text:", cleaned))
    return F.concat_ws("\n", F.concat(F.lit("Rating: "), rating.cast("string"), F.lit("/5")), block("Text:", body), decoded, F.lit("Answer with one JSON object."))


def score_with(prompts: DataFrame, model: Callable[[pd.Series], pd.Series], key: str = "review_id", column: str = "prompt") -> DataFrame:
    """(key, completion): what a model answers to the prompts, batch by batch; null where it gives no answer.

    model: prompts to raw completions. It is sent to the tasks, so what it loads should be loaded on its first call.
    """

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "completion": model(frame[column])})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, column).mapInPandas(answer, f"{key} {kind}, completion string")


def with_business_rules(rows: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The verdict after the overrides that lift an approval to manual review; each adds a flag and a part of the reason.

    The repeat-offender rule looks at the decision before the other two.
    """
    v, n = F.col("verdict"), F.col("recent_rejected_count")
    approved = v["decision"] == "APPROVED"
    low = approved & (v["confidence"] < s.confidence_threshold)
    health = approved & ~low & F.array_contains(v["flags"], "health_concern")
    repeat = approved & (n >= s.offender_max)
    flags = F.array_compact(F.array(
        F.when(low, F.format_string(f"override:low_confidence:%.2f<{s.confidence_threshold}", v["confidence"])),
        F.when(health, F.lit("override:health_concern_flag")),
        F.when(repeat, F.format_string(f"override:repeat_offender:%d_rejected_in_{s.offender_window_days}d", n)),
    ))
    reasons = F.array_compact(F.array(F.when(low, F.lit("low confidence")), F.when(health, F.lit("health concern")), F.when(repeat, F.concat(F.lit("rejected before: "), n.cast("string")))))
    lifted = F.size(flags) > 0
    out = verdict(F.lit("MANUAL_REVIEW"), v["confidence"], v["category"], F.concat(v["flags"], flags), F.substring(F.concat(F.lit("for review: "), F.array_join(reasons, "; ")), 1, 500))
    return rows.withColumn("verdict", F.when(lifted, out).otherwise(v)).withColumn("decided_by", F.when(lifted, "rules").otherwise("model"))


def guarded(v: Column, s: Settings = DEFAULT) -> Column:
    """An approval of low confidence goes to a person."""
    low = (v["decision"] == "APPROVED") & (v["confidence"] < s.confidence_threshold)
    flag = F.format_string(f"override:low_confidence:%.2f<{s.confidence_threshold}", v["confidence"])
    return F.when(low, verdict(F.lit("MANUAL_REVIEW"), v["confidence"], v["category"], F.concat(v["flags"], F.array(flag)), F.trim(F.concat(v["reason"], F.lit(" [low_confidence]"))))).otherwise(v)


def _holds(c: Column, tokens: tuple[str, ...]) -> Column:
    return c.rlike("|".join(tokens))


def forced(v: Column, comment: Column) -> Column:
    """A rejection where category, a flag, the reason or the comment itself shows a clear violation."""
    shown = (
        F.lower(F.trim(v["category"])).isin(*REJECT_CATEGORIES)
        | F.exists(v["flags"], lambda f: _holds(F.lower(f), REJECT_FLAGS))
        | T.profane(comment)
        | _holds(F.lower(F.coalesce(v["reason"], F.lit(""))), REJECT_REASONS)
    )
    flags = with_flag(v["flags"], "force_reject_violation")
    reason = F.when(F.coalesce(v["reason"], F.lit("")) == "", "clear violation").otherwise(v["reason"])
    out = verdict(F.lit("REJECTED"), F.greatest(v["confidence"], F.lit(0.95)), v["category"], flags, reason)
    return F.when((v["decision"] != "REJECTED") & shown, out).otherwise(v)


def personal(comment: Column) -> Column:
    """An address, or a contact cue with a block of digits or seven digits in all."""
    cue = T.normalize(comment).rlike(CONTACT_CUE)
    digits = F.length(F.regexp_replace(comment, "[^0-9]", ""))
    return F.coalesce((comment.contains("@") & comment.rlike(D.EMAIL)) | (cue & (comment.rlike(DIGIT_BLOCK) | (digits >= 7))), F.lit(False))


def privacy_signal(flags: Column, reason: Column, comment: Column) -> Column:
    return F.exists(flags, lambda f: _holds(F.lower(f), PRIVACY_TOKENS)) | _holds(T.normalize(reason), PRIVACY_TOKENS) | personal(comment)


def reason_category(category: Column, flags: Column, reason: Column, comment: Column) -> Column:
    """privacy, spam or conduct: what a rejection is explained by; signs of personal data come first."""
    own = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(own.isin(*PRIVACY_CATEGORIES) | privacy_signal(flags, reason, comment), "privacy").when(own.isin(*SPAM_CATEGORIES), "spam").otherwise("conduct")


def coerced(decision: Column) -> Column:
    upper = F.upper(F.trim(decision))
    return F.when(upper.isin("APPROVED", "REJECTED"), upper).otherwise("MANUAL_REVIEW")


def classified_comments(comments: DataFrame, completions: DataFrame, key: str = "target_id") -> DataFrame:
    """Every comment with its verdict: prefilter, else the model's (second provider first) with guard and forced rejections."""
    rows = D.with_comment_verdict(comments, "comment", "found")
    rows = with_verdicts(rows, completions, key, "secondary_raw", "primary_raw")
    by_rule = verdict(F.lit("REJECTED"), F.lit(1.0), F.col("found")["category"], F.array(F.concat(F.lit("rule_"), F.col("found")["reason"])), F.col("found")["reason"])
    rows = rows.withColumn("verdict", F.when(F.col("found").isNotNull(), by_rule).otherwise(guarded(F.col("verdict"))))
    rows = rows.withColumn("verdict", F.when(F.col("found").isNull(), forced(F.col("verdict"), F.col("comment"))).otherwise(F.col("verdict")))
    return rows.drop("found")


def judged_reviews(reviews: DataFrame, completions: DataFrame, counts: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Every review with its text verdict: blank is approved, the prefilter rejects, else the model under the business rules."""
    rows = reviews.join(counts.select("account_id", F.col("n").alias("recent_rejected_count")), "account_id", "left").withColumn("recent_rejected_count", F.coalesce("recent_rejected_count", F.lit(0)))
    rows = D.with_review_reason(rows, "comment", "found", s)
    blank = F.coalesce("comment", F.lit("")).rlike(r"(?U)^\s*$")
    rows = with_business_rules(with_verdicts(rows, completions, "review_id", asked=~blank & F.col("found").isNull()), s)
    by_rule = verdict(F.lit("REJECTED"), F.lit(1.0), F.lit("rule"), F.array(F.concat(F.lit("rule_"), F.col("found"))), F.col("found"))
    empty = fixed_verdict("APPROVED", 1.0, "clean", "empty_comment", "no comment")
    rows = rows.withColumn("decided_by", F.when(blank | F.col("found").isNotNull(), "prefilter").otherwise(F.col("decided_by")))
    return rows.withColumn("verdict", F.when(blank, empty).when(F.col("found").isNotNull(), by_rule).otherwise(F.col("verdict"))).drop("found")
