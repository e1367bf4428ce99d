"""URL filters: domain rules, and pattern rules fetched by their rarest literal token.

A verdict is a function of the URL, so the work is done once for each distinct
URL and joined back.  A null URL, or one without ``://``, has an empty host and
path, fits no rule and takes the default verdict.  Repeated rows each get their
row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

#: Rules up to this many rows are broadcast; more are joined by shuffles.
BROADCAST_RULES = 100_000

#: Words that a URL to be blocked holds whole, by what they tell of.
BLOCKED_WORDS = {
    "adverts": "ads adserver adservice adsystem adclick adtrack advert adverts advertising banner-ads doubleclick.net googlesyndication.com adnxs.com taboola outbrain popunder clickbank",
    "adult": "porn porno xxx xvideos pornhub escort escorts camgirls hentai milf nsfw",
    "gambling": "casino casinos poker blackjack roulette betting sportsbook bookmaker slot-machines jackpot",
    "medicine spam": "viagra cialis levitra tramadol xanax-online diet-pills",
    "loans and fraud": "payday-loan payday-loans replica-watches get-rich-quick free-iphone lottery-winner bitcoin-doubler",
    "malware and piracy": "warez keygen crackz serialkeys torrents phishing malware",
    "machinery": "wp-login.php wp-admin wp-cron.php xmlrpc.php cgi-bin phpmyadmin .git .env shell.php",
}
#: Longer patterns.
BLOCKED_SHAPES = ("^login^*^return_to=", "^signin^*^continue=", "^cart^*^add-to-cart=", "^calendar^*^action=", "^search^*^sort=", "^share^*^url=", "^action=edit^", "^replytocom=", "^utm_source=spam^")
#: Patterns of the default list: ``*`` is any text, ``^`` a separator or the end.
PATTERNS = tuple((f"^{word}^", "block") for words in BLOCKED_WORDS.values() for word in words.split()) + tuple((shape, "block") for shape in BLOCKED_SHAPES)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def pattern_tokens(pattern: str) -> list[str]:
    """The words that a URL holds whole if the pattern fits it."""
    return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern.lower())


def pattern_regex(pattern: str) -> str:
    """A regular expression for lower-case URLs."""
    parts = {"*": ".*", "^": "(?:^|$|[^a-z0-9_%.-]|(?<![a-z0-9])|(?![a-z0-9]))"}
    return "(?s)" + "".join(parts.get(c, re.escape(c)) for c in pattern.lower())


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def domain_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, rule_verdict`` of the longest fitting rule (host, path, verdict) of each distinct URL that has one.

    A rule fits its host and all subdomains where the URL's path starts with the rule's.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fits = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).where("rule_host <> ''").join(_small(own), "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    return fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "rule_verdict")).alias("best")).select("url", "best.rule", "best.rule_verdict")


def compiled(patterns: DataFrame) -> DataFrame:
    """``pattern, verdict, regex, tokens`` of a frame of patterns, with the same rules as :func:`pattern_regex` and :func:`pattern_tokens`.

    The expression is for lower-case URLs, as Java reads it.  A pattern without a
    whole literal word can't be filed; it has no tokens.
    """
    small = F.lower("pattern")
    quoted = F.regexp_replace(small, r"([\\.+?(){}\[\]|$])", r"\\$1")
    separator = r"(?:^|$|[^a-z0-9_%.-]|(?<![a-z0-9])|(?![a-z0-9]))"
    regex = F.concat(F.lit("(?s)"), F.array_join(F.split(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\^", -1), separator))
    return patterns.select("pattern", "verdict", regex.alias("regex"), F.regexp_extract_all(small, F.lit(r"((?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*]))"), 1).alias("tokens"))


def pattern_verdicts(urls: DataFrame, patterns: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """``url, pattern_verdict`` of each distinct URL that a pattern fits; block wins over allow.

    ``patterns`` are (pattern, verdict), a list or a frame.  Each pattern is filed
    under that of its literal tokens which the fewest URLs hold.  Only URLs with
    this token are tried with its expression.
    """
    spark = urls.sparkSession
    told = patterns if isinstance(patterns, DataFrame) else spark.createDataFrame(list(patterns), "pattern string, verdict string")
    rules = compiled(told.select("pattern", "verdict").where("pattern is not null").distinct())
    if bare := [r.pattern for r in rules.where("size(tokens) = 0").select("pattern").limit(10).collect()]:
        raise ValueError(f"patterns without a whole literal word: {bare}")
    url_tokens = urls.select("url", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1))).alias("token"))
    literals = rules.select("pattern", F.explode("tokens").alias("token"))
    counts = url_tokens.join(_small(literals.select("token").distinct()), "token").groupBy("token").count()
    rarest = literals.join(counts, "token", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    index = rarest.join(rules, "pattern").select(F.col("least.token").alias("token"), "regex", "verdict")  # a pattern no URL can fit has count 0 and meets none
    fits = url_tokens.join(_small(index), "token").where(F.expr("lower(url) rlike regex"))
    return fits.groupBy("url").agg(F.max("verdict").alias("pattern_verdict"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, patterns: Sequence[tuple[str, str]] | DataFrame = PATTERNS, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule (null if none fits) and verdict.

    ``rules`` are (host, path, verdict), a list or a frame, and so are
    ``patterns`` (pattern, verdict).  The verdict is the longest rule's,
    else the patterns', else the default.  Columns of ``pages`` with one of
    those names are replaced.
    """
    spark = pages.sparkSession
    table = rules.select("host", "path", "verdict").distinct() if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    by_rule, by_pattern = domain_verdicts(urls, table), pattern_verdicts(urls, patterns)
    own_url, own_rule, own_verdict = fresh(pages.columns, "_url", "_rule", "_verdict")
    found = by_rule.join(by_pattern, "url", "full").select(F.col("url").alias(own_url), F.col("rule").alias(own_rule), F.coalesce("rule_verdict", "pattern_verdict").alias(own_verdict))
    rows = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url_col])
    joined = rows.join(found, F.col(url_col) == F.col(own_url), "left")
    return joined.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "rule": F.col(own_rule), "verdict": F.coalesce(own_verdict, F.lit(default))}).drop(own_url, own_rule, own_verdict)
