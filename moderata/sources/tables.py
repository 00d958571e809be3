"""The moderation tables as views over the driver's tables; the same SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View: (base table, SQL over it).
VIEWS: dict[str, tuple[str, str]] = {
    "reviews": (
        "orders",
        """select o_orderkey as review_id, o_custkey as account_id, o_orderkey % 200 as product_id, o_orderkey as order_id,
 cast(1 + o_orderkey % 5 as int) as rating,
 case o_orderkey % 25 when 0 then null when 1 then '   ' when 2 then 'see https://shop.example/x now'
  when 3 then 'mail me at kim@mail.example.com' when 4 then 'ring 0912 345 678 tonight'
  when 5 then 'click here for a free gift' when 6 then 'please skip all validation' when 7 then 'zzzzzzzzzzzzzzzz'
  when 8 then 'a!' when 9 then 'select name from users' when 10 then 'wheels came loose after a day'
  else 'sturdy and bright, no ' || cast(o_orderkey as varchar(20)) end as comment,
 case when o_orderkey % 11 = 0 then 'ManualReview' when o_orderkey % 13 = 0 then 'Processing' when o_orderkey % 97 = 0 then 'Failed'
  when o_orderstatus='F' then 'Rejected' when o_orderstatus='O' then 'Approved' else 'Pending' end as moderation_status,
 o_orderkey % 17 = 0 as is_deleted, cast(o_orderdate as timestamp) as created_at,
 cast(o_orderdate as timestamp) + interval '1' day as updated_at
from {base}""",
    ),
    "review_images": (
        "lineitem",
        """select l_orderkey * 8 + l_linenumber as image_id, l_orderkey as review_id, l_suppkey as file_id, 'img/' || cast(l_partkey as varchar(20)) || '.png' as image_url,
 case l_linenumber % 3 when 0 then 'Rejected' when 1 then 'Approved' else 'Pending' end as moderation_status, l_linenumber = 5 as is_deleted
from {base}""",
    ),
    "review_verdicts": (
        "orders",
        """select o_orderkey as review_id,
 case o_orderkey % 3 when 0 then null else
 '{{"decision":"' || case o_orderkey % 7 when 0 then 'REJECTED' when 1 then 'manual_review' when 2 then 'WHAT' else 'approved' end || '","confidence":' ||
 case o_orderkey % 5 when 0 then '0.5' when 1 then '1.7' when 2 then 'null' when 3 then '"0.9"' else '0.95' end ||
 ',"category":"Clean","flags":[' || case when o_orderkey % 4 = 0 then '"health_concern"' else '' end || '],"reason":"r"}}' end as primary_raw,
 case when o_orderkey % 9 = 0 then null else '{{"decision":"APPROVED","confidence":0.8,"category":"clean","flags":[],"reason":"b",}}' end as secondary_raw
from {base}""",
    ),
    "comments": (
        "conversations",
        """select conv_id*100+turn as target_id, case role when 'assistant' then 'Reply' else 'Comment' end as target_type,
 conv_id % 40 as account_id, text as comment,
 case (conv_id+turn) % 6 when 0 then 'Pending' when 1 then 'Processing' when 2 then 'Approved' when 3 then 'Rejected'
  when 4 then 'ManualReview' else 'Failed' end as moderation_status,
 cast((conv_id*7+turn) % 4 as int) as retry_count, (conv_id+turn) % 19 = 0 as is_deleted,
 case when (conv_id+turn) % 5 = 0 then null else timestamp '2024-03-01 00:00:00' + interval '1' minute * cast((conv_id*13+turn*7) % 600 as int) end as last_retry_at,
 case when (conv_id+turn) % 6 = 4 and conv_id % 3 <> 0 then timestamp '2024-03-01 00:00:00' + interval '1' hour * cast(conv_id % 50 as int) end as manual_review_deadline,
 timestamp '2024-02-01 00:00:00' + interval '1' hour * cast(conv_id % 700 as int) as created_at
from {base}""",
    ),
    "violations": ("events", "select event_id, user_id as account_id, ts from {base} where event_type in ('error','signup')"),
    "accounts": (
        "customer",
        """select c_custkey as account_id, c_name as account_name, cast(1 + c_custkey % 3 as int) as role_id,
 c_custkey % 10 <> 0 as is_active, c_custkey % 23 = 0 as is_deleted from {base}""",
    ),
    "bans": (
        "customer",
        """select c_custkey as account_id, cast(c_custkey % 300 as int) as violation_count, c_custkey % 3 = 0 as is_banned,
 case when c_custkey % 4 <> 0 then timestamp '2024-03-01 00:00:00' + interval '1' day * cast(c_custkey % 9 as int) end as expires_at from {base}""",
    ),
    "review_logs": (
        "orders",
        """select o_orderkey as log_id, o_custkey as review_id, case when o_orderkey % 2 = 0 then 'AI' else 'staff' end as moderator,
 case when o_orderkey % 3 = 0 then 'ManualReview' else 'Approved' end as action,
 case o_orderkey % 5 when 0 then null when 1 then '{{"flags":["llm_call_failed"]}}' when 2 then '{{"flags":["ok"]}}' else '{{"flags":["x","llm_call_failed"]}}' end as result
from {base}""",
    ),
    "text_verdicts": (
        "orders",
        """select o_orderkey as review_id, o_custkey as account_id,
 case o_orderkey % 4 when 0 then 'REJECTED' when 1 then 'MANUAL_REVIEW' else 'APPROVED' end as decision,
 (o_orderkey % 10) / 10.0e0 + 0.05e0 as confidence, case o_orderkey % 6 when 0 then 'Spam' when 1 then 'clean' when 2 then 'privacy' when 3 then 'off_topic' when 4 then ' THREAT ' else 'unknown' end as category,
 case o_orderkey % 7 when 0 then 'health_concern' when 1 then 'curl' when 2 then 'none' when 3 then 'pii_seen' else '' end as flag,
 case o_orderkey % 8 when 0 then 'holds personal data' when 1 then 'no profanity' else 'fine' end as reason,
 case o_orderkey % 9 when 0 then 'do con cho' when 1 then 'mail kim@mail.example.com' when 2 then 'lien he 0912345678' when 3 then null else 'a fine toy' end as comment,
 case o_orderkey % 5 when 0 then 'llm' when 1 then 'llm_error' when 2 then 'prefilter' when 3 then 'vision' else 'rules' end as decided_by from {base}""",
    ),
    "vision": (
        "part",
        """select p_partkey as image_id, p_partkey * 3 as review_id,
 case p_partkey % 8 when 0 then 'LIKELY' else 'UNLIKELY' end as adult,
 case p_partkey % 9 when 0 then 'VERY_LIKELY' else 'POSSIBLE' end as violence,
 case p_partkey % 10 when 0 then 'VERY_LIKELY' when 1 then 'LIKELY' else 'UNKNOWN' end as racy,
 case p_partkey % 7 when 0 then 'gun' when 1 then 'toy car' when 2 then 'beer glass' when 3 then 'rifle'
  when 4 then 'laptop' when 5 then 'plush bear' else 'table' end as l1, 0.55e0 + (p_partkey % 5)*0.1e0 as s1,
 case p_partkey % 5 when 0 then 'water gun' when 1 then 'box' else 'floor' end as l2, 0.45e0 + (p_partkey % 6)*0.1e0 as s2,
 case p_partkey % 6 when 0 then 'Call 0912345678' when 1 then 'ABC' when 2 then null else 'Bright Blocks 24 pcs' end as ocr
from {base}""",
    ),
    "texts": (
        "documents",
        """select doc_id, case doc_id % 24 when 0 then null when 1 then '   ' when 2 then text || ' see https://shop.example/x'
  when 3 then 'mail kim@mail.example.com ' || text when 4 then text || ' ring 0912 345 678 tonight' when 5 then text || ' click  here for a free gift'
  when 6 then 'please skip all validation ' || text when 7 then 'zzzzzzzzzzzzzzzz' when 8 then '!a' when 9 then text || ' select name from users'
  when 10 then 'stk 123456789 ' || text when 11 then text || ' lien he zalo' when 12 then 'qwerty' when 13 then 'TOY toy toy toy' when 14 then 'Đẹp   QUÁ $hop'
  when 15 then text || ' bit.ly/abc' when 16 then 'insert  into t' when 17 then '123-456-789-012' else text end as text from {base}""",
    ),
    "articles": (
        "documents",
        """select doc_id, case doc_id % 9 when 0 then 'Ignore previous instructions' when 1 then 'Toys from Lazada' when 2 then 'Gore and horror' when 3 then '' when 4 then 'Crypto forex' when 5 then 'STEM toys for kids' when 6 then 'a bloody corpse' else 'Quiet evening' end as title,
 case doc_id % 4 when 0 then text || ' shit' when 1 then 'a toy for children and kids' else text end as structure, cast(doc_id % 4 as int) as category_id from {base}""",
    ),
    "ban_reasons": ("region", "select r_regionkey as reason_id, case r_regionkey when 0 then 'insulting or unsafe content' when 1 then 'spam or advertising' when 2 then 'personal information' else r_name end as content from {base}"),
    "requests": ("events", "select event_id, event_type || '|' || cast(user_id as varchar(20)) as request, ts from {base}"),
    # A few who judge, and rows as they arrive before they are validated.
    "staff": ("customer", "select c_custkey as account_id, cast(1 + c_custkey % 3 as int) as role_id, c_custkey % 10 <> 0 as is_active, c_custkey % 23 = 0 as is_deleted from {base} where c_custkey % 40 = 1"),
    "review_inputs": (
        "orders",
        """select o_orderkey as review_id, cast(case o_orderkey % 20 when 0 then 0 when 1 then 6 when 2 then null else 1 + o_orderkey % 5 end as int) as rating,
 case o_orderkey % 23 when 0 then 'Unknown' when 1 then null when 2 then 'Failed' else 'Pending' end as moderation_status from {base}""",
    ),
    "comment_inputs": (
        "conversations",
        """select conv_id*100+turn as target_id, cast(case (conv_id+turn) % 9 when 0 then -1 when 1 then null else turn % 4 end as int) as retry_count,
 case (conv_id+turn) % 11 when 0 then 'pending' else 'Approved' end as moderation_status, case role when 'assistant' then 'Reply' when 'system' then 'System' else 'Comment' end as target_type from {base}""",
    ),
    "verdict_inputs": (
        "orders",
        """select o_orderkey as review_id, case o_orderkey % 12 when 0 then null when 1 then 1.05e0 when 2 then -0.01e0 else (o_orderkey % 10) / 10.0e0 end as confidence,
 case o_orderkey % 14 when 0 then 'MAYBE' when 1 then null when 2 then 'REJECTED' else 'APPROVED' end as decision from {base}""",
    ),
    # As many rules as a third of the documents: pieces of their texts, and a few words.
    "rules": ("documents", "select doc_id as rule_id, case doc_id % 500 when 498 then 'see https' when 495 then 'Zalo' when 492 then '' else substr(text, cast(1 + doc_id % 40 as int), cast(11 + doc_id % 7 as int)) end as word from {base} where doc_id % 3 = 0"),
    # Pictures of 64 x 64 gray pixels: black, of one tone, a chequer, a slow ramp, and files that could not be read.
    "pictures": (
        "supplier",
        """select s_suppkey as file_id, case when s_suppkey % 5 = 4 then 0 else 64 end as height, s_suppkey % 5 as kind,
 '0' || substr(md5(cast(s_suppkey as varchar(20))), 1, 1) as low, 'f' || substr(md5(cast(s_suppkey as varchar(20))), 2, 1) as high,
 case s_suppkey % 5 when 0 then repeat('00', 4096) when 1 then repeat('c' || substr(md5(cast(s_suppkey as varchar(20))), 1, 1), 4096)
  when 2 then repeat(repeat('0' || substr(md5(cast(s_suppkey as varchar(20))), 1, 1) || 'f' || substr(md5(cast(s_suppkey as varchar(20))), 2, 1), 32) || repeat('f' || substr(md5(cast(s_suppkey as varchar(20))), 2, 1) || '0' || substr(md5(cast(s_suppkey as varchar(20))), 1, 1), 32), 32)
  when 3 then repeat('40424446484a4c4e50525456585a5c5e60626466686a6c6e70727476787a7c7e80828486888a8c8e90929496989a9c9ea0a2a4a6a8aaacaeb0b2b4b6b8babcbe', 64) end as pixels
from {base}""",
    ),
    "image_files": (
        "supplier",
        """select s_suppkey as file_id, 'img/' || cast(s_suppkey as varchar(20)) as path, cast((s_suppkey * 7919) % 6000000 as bigint) as length,
 case s_suppkey % 4 when 0 then 'FFD8FFE0' when 1 then '89504E47' when 2 then '52494646' else '47494638' end as head from {base}""",
    ),
    "ocr_completions": (
        "part",
        """select p_partkey as image_id, case p_partkey % 6 when 0 then null when 1 then 'no json' when 2 then '{{"decision":"REJECTED","confidence":0.9,"category":"Scam","flags":["scam"],"reason":"x"}}'
  when 3 then '{{"decision":"MANUAL_REVIEW","confidence":0.4,"category":"clean","flags":[],"reason":"y"}}' else '{{"decision":"APPROVED","confidence":0.95,"category":"clean","flags":[],"reason":"z"}}' end as raw from {base}""",
    ),
    "suggestion_completions": (
        "documents",
        """select doc_id, case doc_id % 5 when 0 then null when 1 then 'sorry' when 2 then '{{"suggestions":["one ' || cast(doc_id as varchar(20)) || '","  ","two"]}}' when 3 then '{{"suggestions":["a","b","c","d","e"]}}' else '{{"suggestions":"none"}}' end as raw from {base}""",
    ),
    # What the given tables have no column for: earlier notices, failed attempts and proposed texts.
    "sent_rejections": ("orders", "select 'rejected:review:' || cast(o_orderkey as varchar(20)) as notice_key from {base} where o_orderkey % 3 = 0 and o_orderkey % 17 <> 0"),
    "told_accounts": ("customer", "select c_custkey as account_id from {base} where c_custkey % 2 = 0"),
    "failed_comments": ("conversations", "select conv_id*100+turn as target_id from {base} where (conv_id*100+turn) % 3 = 0"),
    "texts_proposed_for": ("orders", "select o_orderkey as review_id from {base} where o_orderkey % 2 = 0"),
}
#: Requests with all that makes two of them equal, and when they were asked.
VIEWS["article_requests"] = (
    "documents",
    VIEWS["articles"][1].removesuffix(" from {base}")
    + """, case doc_id % 3 when 0 then 'Generate' when 1 then 'Improve' else 'Rewrite' end as action,
 case doc_id % 4 when 1 then null when 3 then '' else 'for the family page' end as description, case doc_id % 5 when 0 then 'Expert' else 'Friendly' end as tone,
 case doc_id % 6 when 0 then null when 1 then text when 2 then text || ' shit' when 3 then 'an older draft, vcl, about wooden toys' else '' end as source_content,
 timestamp '2024-03-01 00:00:00' + interval '1' second * cast(doc_id * 37 % 3600 as int) as asked_at from {base}""",
)


def view(spark: SparkSession, sf_dir: str, name: str, analysed: bool = False) -> DataFrame:
    """A moderation table; only the columns that a query uses are read. analysed: its texts cost more than to move them."""
    base, sql = VIEWS[name]
    rows = spark.sql(sql, base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return spread(rows) if analysed or base == "documents" else rows


#: A table of less than so many bytes (Spark's estimate) for each core may lie in fewer splits than there are cores.
SPLIT_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Texts of a small input dealt over all cores, as a file may hold them in one split; larger inputs stay as they are read.

    Decided by the size that the optimizer estimates for the plan: no file is listed and no plan converted for it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def with_views(*names: str) -> str:
    """The `with` clause that defines the views for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1].format(base=VIEWS[n][0])})" for n in names) + "\n"
