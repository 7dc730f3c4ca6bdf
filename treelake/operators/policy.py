"""Rules over urls: robots groups, interception rules, cookies, cache freshness."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from treelake.functions.urls import cache_url, glob_column

MOST_RULES = 65_536
MOST_LINE_BYTES = 500 * 1024
_AGENT = re.compile(r"[A-Za-z_-]+")
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})|(.)", re.S)


def normal_path(text: str, pattern: bool) -> str:
    """A path or rule with escapes made one: unreserved decoded, others upper-case, all else outside ASCII encoded."""

    def one(m: re.Match) -> bytes:
        if m.group(1):
            byte = int(m.group(1), 16)
            return bytes([byte]) if byte in _UNRESERVED else b"%%%02X" % byte
        byte = m.group(2)[0]
        encode = byte == 0x25 or byte >= 0x80 or not pattern and byte in b"*$"
        return b"%%%02X" % byte if encode else m.group(2)

    return _ESCAPE.sub(one, text.encode("utf-8", "surrogatepass")).decode("ascii")


def specificity(rule: str) -> int:
    """Octets of a normal rule: stars and a last dollar count nothing, an escape one."""
    bare = rule[:-1] if rule.endswith("$") else rule
    return len(re.sub(r"%..", "x", bare.replace("*", "")))


def rule_matches(rule: str, path: str) -> bool:
    """Whether a normal rule matches a normal path from its start.

    Stars take as little as they can; at an end mark a rule that is used up before the path isn't
    tried again further on.
    """
    anchored = rule.endswith("$")
    pieces = (rule[:-1] if anchored else rule).split("*")
    if not path.startswith(pieces[0]):
        return False
    at = len(pieces[0])
    for piece in pieces[1:]:
        found = path.find(piece, at)
        if found < 0:
            return False
        at = found + len(piece)
    return at == len(path) or not anchored or len(pieces) > 1 and not pieces[-1]


def rule_regex(rule: str) -> str:
    """The regular expression of a normal rule for the JVM: ``rule_matches`` said with atomic groups."""
    anchored = rule.endswith("$")
    pieces = [re.escape(p) for p in (rule[:-1] if anchored else rule).split("*")]
    end = r"\z" if anchored and not (len(pieces) > 1 and not pieces[-1]) else ""
    return "(?s)^" + pieces[0] + "".join(f"(?>.*?{p})" for p in pieces[1:]) + end


def robots_rules(text: str | None) -> list[tuple[int, str, str, str, int]]:
    """(group, agent, directive, normal rule, specificity) of a robots file; directive '' tells the agent only.

    A user-agent line begins a new group only after a rule. Empty rules are passed over. Rules over
    the limit (each once, for however many agents) and lines over theirs are left out and reported:
    rows of group -1 with directive rules_omitted or lines_over_limit have their number as specificity.
    """
    out, agents, group, ruled = [], [], -1, True
    rules, left = 0, {"rules_omitted": 0, "lines_over_limit": 0}
    for at, line in enumerate((text or "").split("\n")):
        line = line.lstrip("\ufeff") if at == 0 else line
        if len(line.encode("utf-8", "surrogatepass")) > MOST_LINE_BYTES:
            left["lines_over_limit"] += 1
            continue
        name, colon, value = line.split("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent" and (value == "*" or _AGENT.fullmatch(value)):
            if ruled:
                group, agents, ruled = group + 1, [], False
            agents.append(value.lower())
            out.append((group, value.lower(), "", "", 0))
        elif name in ("allow", "disallow") and agents and value:
            ruled = True
            if rules >= MOST_RULES:
                left["rules_omitted"] += 1
                continue
            rules += 1
            rule = normal_path(value, True)
            out += [(group, a, name, rule, specificity(rule)) for a in agents]
    return out + [(-1, "", kind, "", n) for kind, n in left.items() if n]


_RULE = ArrayType(StructType([StructField(n, IntegerType() if n in ("group", "specificity") else StringType()) for n in ("group", "agent", "directive", "rule", "specificity", "regex")]))


@F.pandas_udf(_RULE)
def _parse_robots(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("group", "agent", "directive", "rule", "specificity"), r)) | {"regex": rule_regex(r[3])} for r in robots_rules(t)])


@F.pandas_udf(StringType())
def _normal_paths(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: normal_path(p, False), na_action="ignore")


def parsed_robots(files: DataFrame, key: str = "host", text: str = "robots_txt") -> DataFrame:
    """One row per host, group, agent and rule; files that many hosts share are parsed once."""
    named = files.select(F.col(key).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("d", F.sha2("t", 256))
    rules = named.groupBy("d").agg(F.first("t").alias("t")).select("d", F.explode(_parse_robots("t")).alias("r")).select("d", "r.*")
    return named.select("host", "d").join(rules, "d").drop("d")


#: Rules that go to the targets; with more both sides are shuffled by host.
MOST_BROADCAST = 50_000


def robots_decisions(targets: DataFrame, rules: DataFrame, token: str) -> DataFrame:
    """(host, path, allowed, reason, rule) of targets (host, path): the best rule of the agent's groups.

    Groups that name the agent count, else those of '*'. The most specific rule wins, allow before
    disallow, then the first group and rule. robots.txt itself is always allowed. A file with a line
    over the limit denies everything. Null hosts and paths are no targets.
    """
    named = F.col("agent") == token.lower()
    chosen = rules.filter(named | (F.col("agent") == "*") | (F.col("group") < 0))
    exact = F.max(named).over(Window.partitionBy("host"))
    own = chosen.withColumn("exact", exact).filter((F.col("group") < 0) | F.when(F.col("exact"), named).otherwise(F.col("agent") == "*")).filter("directive <> '' and directive <> 'rules_omitted'").drop("exact")
    paths = targets.select("host", "path").filter("host is not null and path is not null").distinct().withColumn("n", _normal_paths("path"))
    few = own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # a line over the limit is the best of all rules; the others are matched in the JVM
    hit = paths.join(F.broadcast(own) if few else own, "host").filter((F.col("directive") == "lines_over_limit") | F.regexp_like("n", F.col("regex")))
    order = F.when(F.col("directive") == "lines_over_limit", -1).when(F.col("directive") == "allow", 0).otherwise(1)
    best = hit.groupBy("host", "path").agg(F.min(F.struct(F.when(F.col("group") < 0, -(1 << 30)).otherwise(-F.col("specificity")).alias("s"), order.alias("o"), F.col("group"), F.col("rule"), F.col("directive"))).alias("b"))
    rows = paths.drop("n").join(best, ["host", "path"], "left")
    invalid = F.coalesce(F.col("b.directive") == "lines_over_limit", F.lit(False))
    implicit = ~invalid & (F.col("path") == "/robots.txt")
    allowed = ~invalid & (implicit | F.col("b").isNull() | (F.col("b.directive") == "allow"))
    reason = F.when(invalid, "robots_invalid_line_limit").when(implicit, "robots_txt_implicitly_allowed").when(F.col("b").isNull(), "no_matching_rule").otherwise(F.concat("b.directive", F.lit("_rule")))
    return rows.select("host", "path", allowed.alias("allowed"), reason.alias("reason"), F.when(~implicit & ~invalid, F.col("b.rule")).alias("rule"))


def robots_policies(targets: DataFrame, fetches: DataFrame, token: str) -> DataFrame:
    """(host, path, allowed, reason, rule, classification, checks_completed, checks_failed) of targets by what fetching each robots file gave.

    ``fetches`` has host, robots_txt, http_status and failure (too_large, blocked, timeout, navigation,
    redirects; null where an answer came), each host once. Without a failure and with a status under
    400 the file decides; a status of 4xx allows everything, any other denies it, as a failure does.
    A host that nothing was fetched for is unreachable.
    """
    status = F.col("http_status")
    kind = (
        F.when(F.col("failure") == "too_large", "invalid_too_large").when(F.col("failure") == "blocked", "blocked_redirect_or_destination").when(F.col("failure").isNotNull() | status.isNull(), "unreachable")
        .when(status < 400, "available").when(status < 500, "unavailable").otherwise("unreachable")
    )
    known = fetches.select("host", "robots_txt", kind.alias("classification"), (F.col("failure").isNull() & status.isNotNull()).cast("int").alias("checks_completed"))
    decided = robots_decisions(targets.join(known.filter("classification = 'available'").select("host"), "host", "left_semi"), parsed_robots(known.filter("classification = 'available'")), token)
    rows = targets.select("host", "path").filter("host is not null and path is not null").distinct().join(known.drop("robots_txt"), "host", "left").join(decided, ["host", "path"], "left")
    kind = F.coalesce("classification", F.lit("unreachable"))
    other = F.when(kind == "unavailable", "robots_unavailable").when(kind == "invalid_too_large", "robots_invalid").otherwise("robots_unreachable")
    done = F.coalesce("checks_completed", F.lit(0))
    return rows.select("host", "path", F.coalesce("allowed", kind == "unavailable").alias("allowed"), F.coalesce("reason", other).alias("reason"), "rule", kind.alias("classification"), done.alias("checks_completed"), (1 - done).alias("checks_failed"))


def intercept(requests: DataFrame, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """Requests (request_id, url, resource_type) with the action of the first rule that matches.

    ``rules`` (rule_ord, url_glob, resource_type, action) is a table of settings, read whole; more
    rows than ``most_rules`` are refused. A null glob or type matches all; no rule: continue.
    """
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    regex = F.when(F.col("r.url_glob").isNotNull(), F.regexp_like("q.url", glob_column(F.col("r.url_glob")))).otherwise(True)
    kind = F.col("r.resource_type").isNull() | (F.col("r.resource_type") == F.col("q.resource_type"))
    hit = requests.alias("q").join(F.broadcast(rules.alias("r")), regex & kind, "left")
    first = hit.groupBy("q.request_id").agg(F.min(F.when(F.col("r.rule_ord").isNotNull(), F.struct("r.rule_ord", "r.action"))).alias("x"))
    return first.select("request_id", F.coalesce("x.action", F.lit("continue")).alias("action"), F.col("x.rule_ord").alias("rule_ord"))


def cookie_matches(now: Column) -> Column:
    """Whether a cookie (domain, path, secure, expires) goes with a request (scheme, host, request_path)."""
    domain = F.regexp_replace(F.lower("domain"), r"^\.", "")
    host_only = ~F.startswith("domain", F.lit("."))
    in_domain = (F.col("host") == domain) | (~host_only & F.endswith("host", F.concat(F.lit("."), domain)))
    path = F.col("path")
    in_path = (path == "/") | (F.col("request_path") == path) | (F.startswith("request_path", path) & (F.endswith(path, F.lit("/")) | (F.substr("request_path", F.length(path) + 1, F.lit(1)) == "/")))
    fresh = F.col("expires").isNull() | (F.col("expires") > now)
    return fresh & (~F.col("secure") | (F.col("scheme") == "https")) & in_domain & in_path


def cache_outcomes(fetches: DataFrame, max_age_seconds: int = 300) -> DataFrame:
    """Each fetch (url, content_hash, fetched_at) against the fetch of its key before: hit, stale, expired or miss.

    A hit has the same hash within the maximum age; another hash is stale, a greater age expired.
    """
    by = Window.partitionBy("cache_key").orderBy("fetched_at", "fetch_id")
    rows = fetches.withColumn("cache_key", cache_url(F.col("url"))).withColumn("old_hash", F.lag("content_hash").over(by)).withColumn("old_at", F.lag("fetched_at").over(by))
    age = F.timestamp_diff("MICROSECOND", "old_at", "fetched_at")
    outcome = F.when(F.col("old_at").isNull(), "miss").when(age > max_age_seconds * 1_000_000, "expired").when(F.col("old_hash") == F.col("content_hash"), "hit").otherwise("stale")
    return rows.select("fetch_id", "cache_key", outcome.alias("outcome"))
