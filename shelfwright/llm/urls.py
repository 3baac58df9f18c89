"""URL verdicts by pattern rules that are looked up by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many rules the index is part of the expression; more are joined by token, with the same result.
INLINE_RULES = 256
SEPARATOR = "[^0-9A-Za-z]+"

# Words that mark unwanted hosts and paths.
UNWANTED = ["bets", "casino", "escort", "gambling", "payday", "pills", "porn", "spam", "viagra", "warez", "xxx"]


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the start of a path, or with ``anywhere`` a run of characters between separators.

    Rules of the first kind go before those of the second; of one kind, the longest wins, then block before
    allow.
    """

    text: str
    verdict: str
    anywhere: bool = False

    @property
    def pattern(self) -> str:
        literal = re.sub(r"([^0-9A-Za-z/_-])", r"\\\1", self.text)
        if self.anywhere:
            return f"(^|[^0-9A-Za-z]){literal}([^0-9A-Za-z]|$)"
        return rf"^([^/]*\.)?{literal}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every matching URL has whole: a path start may go on in the middle of its last one."""
        found = [t for t in re.split(SEPARATOR, self.text) if t]
        if not self.anywhere and re.match("[0-9A-Za-z]", self.text[-1:]):
            found = found[:-1]
        return sorted(set(found))

    @property
    def rank(self) -> int:
        return (not self.anywhere) * 1_000_000 + 2 * len(self.text) + (self.verdict == "block")


DEFAULT_RULES = tuple(Rule(word, "block", anywhere=True) for word in UNWANTED)


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z alone) text after the first ``://`` up to ``/``, ``?`` or ``#``; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, SEPARATOR))


def index_rules(urls: DataFrame, rules: Iterable[Rule]) -> dict[str, list[Rule]]:
    """Rules by the token that the fewest URLs have; those without a token under ''. urls: (host, path).

    Token counts are taken over all URLs; only those of the rules' own tokens come to the driver.
    """
    rules = list(rules)
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        known = F.array(*[F.lit(t) for t in wanted])
        hit = F.array_intersect(_tokens(F.concat("host", "path")), known)
        counts = dict(urls.select(F.explode(hit).alias("t")).groupBy("t").agg(F.count("*")).collect())
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(rule)
    return index


def _literal(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.rank).alias("rank"), F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.anywhere).alias("anywhere"), F.lit(rule.pattern).alias("pattern"),
    )


RULE = "rank int, text string, verdict string, anywhere boolean, pattern string"


def judge(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url",
    inline: int = INLINE_RULES,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``.

    The tokens of a URL's host and path fetch the rules indexed under them, and only these rules' patterns are run.
    The first rule in rank decides; ``rule`` names it if it is a host rule, else it is null. A URL without a rule is
    allowed. Null URLs and URLs without ``://`` have an empty host and path and no tokens. Repeated rows stay.
    Other columns are not read. An empty table gives an empty table.
    """
    rules = list(rules)
    urls = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    index = index_rules(urls, rules)
    none = F.lit(None).cast(f"struct<{RULE.replace(' ', ':').replace(',:', ',')}>")
    target = F.concat("host", "path")
    if len(rules) <= inline:
        keys = sorted(index)
        lists = F.array(*[F.array(*[_literal(r) for r in index[k]]) for k in keys]) if keys else None
        if lists is None:
            judged = urls.withColumn("hit", none)
        else:
            have = F.array_intersect(F.concat(_tokens(target), F.array(F.lit(""))), F.array(*[F.lit(k) for k in keys]))
            places = F.array(*[F.lit(k) for k in keys])
            fetched = F.flatten(F.transform(have, lambda t: F.element_at(lists, F.array_position(places, t).cast("int"))))
            judged = urls.withColumn(
                "hit", F.array_max(F.filter(fetched, lambda r: F.rlike(F.concat("host", "path"), r["pattern"])))
            )
    else:
        table = pages.sparkSession.createDataFrame(
            [(k, r.rank, r.text, r.verdict, r.anywhere, r.pattern) for k, rs in index.items() for r in rs],
            f"token string, {RULE}",
        )
        distinct = urls.select("host", "path").distinct()
        hits = (
            distinct.withColumn("token", F.explode(F.array_distinct(F.concat(_tokens(target), F.array(F.lit(""))))))
            .join(table, "token")
            .where(F.rlike(target, F.col("pattern")))
            .groupBy("host", "path")
            .agg(F.max(F.struct("rank", "text", "verdict", "anywhere", "pattern")).alias("hit"))
        )
        judged = urls.join(hits, ["host", "path"], "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path",
        F.when(~F.col("hit.anywhere"), F.col("hit.text")).alias("rule"),
        F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"),
    )
