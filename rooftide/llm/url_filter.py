"""URL filters: rules indexed by their rarest literal token; only candidate rules run regular expressions. Native only."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, materialize

#: Up to so many rules the index is broadcast; beyond, Spark joins it by token.
BROADCAST_RULES = 20_000
#: Tokens of URLs and literals of rules are whole runs of these; patterns close their words by all others. Both sides cut the
#: text as it stands: 'Xspam' is the run 'spam' after a border.
TOKEN, BORDER = "[a-z0-9]+", "[^a-z0-9]"
RULES = "id long, pattern string, verdict string, label string, weight int, literals array<string>"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path. `literals`: runs of TOKEN that every match contains whole (none: the rule is
    tried on every URL). A rule with a label wins over any without; then the greater weight, then the first."""

    pattern: str
    verdict: str
    label: str | None
    weight: int
    literals: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`. The host is in lower case, as those of URLs."""
    pattern = "^(?:[^/]*[.])?" + re.escape(host) + (re.escape(path) if path else "(?:/|$)")
    # What follows a path's last token may lengthen it, so only a closed token is a literal.
    tokens = tuple(re.findall(f"{TOKEN}(?![a-z0-9]|$)", f"{host}{path}" if path else f"{host}/"))
    return Rule(pattern, verdict, f"{host}{path}", len(host) + len(path), tokens)


def word_rule(verdict: str, word: str) -> Rule:
    """Fits where the word stands whole in host or path."""
    return Rule(f"(?:^|{BORDER}){re.escape(word)}(?:{BORDER}|$)", verdict, None, 0, tuple(re.findall(TOKEN, word)))


#: A small list of our own of words that mark unwanted sites.
UNWANTED = ("casino", "jackpot", "malware", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")
DEFAULT_RULES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
    *(word_rule("block", x) for x in UNWANTED),
)


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(where: Column) -> Column:
    return F.array_distinct(F.concat(F.split(where, f"{BORDER}+"), F.array(F.lit(""))))


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A list of rules as a table (RULES). Longer lists than BROADCAST_RULES are better kept as a table from the start."""
    rows = [{"id": i, "pattern": r.pattern, "verdict": r.verdict, "label": r.label, "weight": r.weight, "literals": r.literals} for i, r in enumerate(rules)]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{RULES.replace(' ', ': ').replace(',: ', ', ')}>>")).alias("x")).select("x.*")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = DEFAULT_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: the id, host, path, rule (label of the labelled rule that wins, else null), verdict.

    Each rule stands in the index under that of its literals which the fewest URLs hold; a URL's tokens fetch
    candidates, and only those run. rules: a list or a table (RULES; unique ids). A null url or one without :// has an
    empty host and path. URLs are judged once each, however often they come. Rows without a fitting rule get the default.
    Other columns are not read; an empty table gives no rows."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col), F.coalesce(url, F.lit("")).alias("__url"))
    urls = base.select("__url").distinct().select("__url", F.concat(url_host(F.col("__url")), url_path(F.col("__url"))).alias("where"))
    tokens = urls.select("__url", "where", F.explode(_tokens(F.col("where"))).alias("token"))

    listed = rules if isinstance(rules, DataFrame) else rules_frame(pages.sparkSession, rules)
    few = (listed.count() if isinstance(rules, DataFrame) else len(rules)) <= BROADCAST_RULES
    small = F.broadcast if few else lambda df: df  # at most BROADCAST_RULES rows
    literals = listed.select("id", F.explode("literals").alias("token"))
    held = tokens.select("token").join(small(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("held"))
    held = materialize(held, "held")  # no more rows than the rules have literals
    rarest = literals.join(small(held), "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("least"))
    rank = F.struct(F.col("label").isNotNull().alias("labelled"), "weight", (-F.col("id")).alias("order"))
    index = listed.join(small(rarest), "id", "left").select(F.coalesce("least.token", F.lit("")).alias("token"), "pattern", "label", "verdict", rank.alias("rank"))
    best = (
        tokens.join(small(index), "token")
        .where("`where` RLIKE pattern")
        .groupBy("__url")
        .agg(F.max_by(F.struct("label", "verdict"), "rank").alias("won"))
    )
    # A table, so that Spark may split the rows of a URL that is everywhere; it grows with the URLs, so it is never broadcast.
    return base.join(materialize(best, "judged").hint("merge"), "__url", "left").select(
        F.col(id_col),
        url_host(F.col("__url")).alias("host"),
        url_path(F.col("__url")).alias("path"),
        F.col("won.label").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )
