"""URL filters: pattern rules that are looked up by their rarest literal token.

Every rule is a regular expression with the literal tokens that any URL it matches must contain. One Spark job counts
how many URLs hold each rule token; a rule is filed under its rarest one. A URL's tokens fetch the rules filed under
them, and only those run. Rules are sent to the tasks in blocks of a fixed number, so a long list never grows one
broadcast; the URLs are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile("[a-z0-9]+")
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
#: Rules that are sent to the tasks at once.
BLOCK_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """A host rule (host and its subdomains, path prefix) or, with `pattern`, an expression over the whole URL.

    tokens: lower-case words, whole between characters outside [a-z0-9], that every matching URL holds.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def expression(self) -> str:
        """What is searched in host + path of a host rule, or in the URL."""
        return self.pattern or rf"\A(?:[^/]*\.)?{re.escape(self.host + self.path)}" + ("" if self.path else r"(?=/|\Z)")

    @property
    def literals(self) -> tuple[str, ...]:
        """The tokens; those of a host rule are its own, without a last one that the URL may continue."""
        if self.pattern:
            return self.tokens
        found = TOKEN.findall(self.name.lower())
        return tuple(found[:-1] if self.path and TOKEN.search(self.name.lower()[-1]) else found)


def words(*literals: str) -> Rule:
    """A rule that blocks URLs with these words one after the other, whatever signs stand between them."""
    return Rule("block", pattern=r"(?i)(?<![a-z0-9])" + "[^a-z0-9]+".join(literals) + r"(?![a-z0-9])", tokens=literals)


#: Adverts, gambling, adult and piracy pages: what blocks a URL that no host rule decides. Of several words the rarest one
#: in the given URLs leads to the rule.
PATTERNS = (
    words("adserver"), words("adult"), words("bet"), words("casino"), words("crack"), words("keygen"), words("porn"), words("sex"), words("torrent"), words("warez"), words("xxx"),
    words("ad", "click"), words("affiliate", "id"), words("banner", "ads"), words("free", "spins"), words("live", "cams"), words("full", "movie", "download"), words("buy", "followers"), words("payday", "loan"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): ASCII letters of the host in lower case; both empty without `://`."""
    found = URL.search(url or "")
    return (re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def tokens_of(url: str | None) -> list[str]:
    return TOKEN.findall((url or "").lower())


def _index(rules: Sequence[Rule], frequency: dict[str, int]) -> dict[str, list[tuple[Rule, re.Pattern]]]:
    """Rules by their rarest token; those without a token are under the empty string."""
    index: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules:
        token = min(rule.literals, key=lambda t: (frequency.get(t, 0), -len(t), t), default="")
        index.setdefault(token, []).append((rule, re.compile(rule.expression)))
    return index


def token_counts(urls: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(token, count): how many URLs hold each of the wanted tokens, block by block of the list; only sums are shuffled."""
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    out = None
    for k in range(0, len(wanted), BLOCK_RULES):
        block = urls.sparkSession.createDataFrame([(t,) for t in wanted[k : k + BLOCK_RULES]], "token string")
        counts = found.join(F.broadcast(block), "token", "left_semi").groupBy("token").count()
        out = counts if out is None else out.unionByName(counts)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], patterns: Sequence[Rule] = PATTERNS, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest fitting host rule decides, else any fitting pattern blocks, else allow.

    Of host rules of one length the later one in the list wins. One row for each row, repeated rows and ids too; an
    empty table gives an empty result. A null URL, or one without `://`, has an empty host and path and is allowed unless
    a pattern matches. Other columns are not read.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    every = [*rules, *patterns]
    wanted = sorted({t for r in every for t in r.literals})
    frequency = {r["token"]: r["count"] for r in token_counts(urls, wanted).collect()} if wanted else {}  # at most as many as the rules have tokens
    state = "id {}, url string, host string, path string, rule string, rule_length int, verdict string, blocked boolean".format(kind)

    def judge(batches: Iterator[pa.RecordBatch], index: dict[str, list[tuple[Rule, re.Pattern]]]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            before = batch.to_pydict() if "host" in batch.schema.names else None
            for i, url in enumerate(batch.column("url").to_pylist()):
                host, path = split_url(url)
                name, length, verdict, blocked = (before["rule"][i], before["rule_length"][i], before["verdict"][i], before["blocked"][i]) if before else (None, -1, None, False)
                for token in ["", *dict.fromkeys(tokens_of(url))]:
                    for rule, expression in index.get(token, ()):
                        if rule.pattern:
                            blocked = blocked or bool(expression.search(url or ""))
                        elif len(rule.name) >= length and expression.search(host + path) and len(host) >= len(rule.host):
                            name, length, verdict = rule.name, len(rule.name), rule.verdict
                rows.append((url, host, path, name, length, verdict, blocked))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "url", "host", "path", "rule", "rule_length", "verdict", "blocked"])

    out = urls
    for k in range(0, max(1, len(every)), BLOCK_RULES):
        sent = spark.sparkContext.broadcast(every[k : k + BLOCK_RULES])
        out = out.mapInArrow(lambda batches, sent=sent: judge(batches, _index(sent.value, frequency)), state)
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
