"""op13: URL filters.  Pattern rules are indexed by their rarest literal token.

A list of pattern rules is turned into an index token -> rules: each rule stands under that
one of its mandatory tokens which the fewest URLs of the table hold (counted over all rows).
The tokens of a URL fetch its candidate rules, and only those run their regular expression;
rules without a mandatory token are candidates of every URL.

Before the patterns come host rules (host, path, verdict): one fits its host and all
subdomains where the URL's path starts with its own, and the longest that fits decides.

Pattern syntax (matched against the URL with A-Z lower-cased, anywhere in it): ``*`` any run
of characters, ``^`` one separator (neither letter, digit nor one of ``_.%-``) or the end,
``||`` at the start: at the beginning of a host label, ``|`` at either end: the URL's start or end;
``@@`` before a pattern makes it an exception.  A URL is blocked if a pattern matches it and
no exception does.

Work: one pass over the URLs for the token counts, one for the verdicts; no row is shuffled,
so no host can be too hot.  The rules travel with the tasks: a rule list is a parameter of
the caller and already in the driver's memory; it must not exceed ``RULE_BYTES``.

Hard rows: a NULL URL, or one without ``://``, has an empty host and path, fits no host rule,
and is judged by the patterns on its text (NULL: as empty).  Very long URLs are matched whole.
Repeated rows each get a row; ties between tokens go to the alphabetically first, between
patterns to the first of the list.  An empty table gives no rows, extra columns do no harm.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackyard.llm.common import read
from trackyard.session import tell_workers

#: (host, path, verdict), as the contract lists them
HOST_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
              ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: the pattern rules that judge what no host rule covers
PATTERNS = (
    "||spam-farm.", "||cheap-pills.", "||link-exchange.", "||adserver.", "||ads.", "||clicktrack.", "||doorway.",
    "-pills.", "-casino.", "/casino/", "/viagra/", "/replica-watches/", "/payday-loan", "/free-download/*.exe",
    "^affiliate_id=", "^sessionid=", "^phpsessid=", "^replytocom=", "^add-to-cart=", "/wp-login.php", "/cgi-bin/",
    "/tag/*/page/", "/search?*q=", "/calendar/*/day/", ".exe|", ".apk|", "*xxx*", "*porn*",
    "@@/cgi-bin/index^", "@@||docs.", "@@^report-spam^",
)

RULE_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
TOKEN = re.compile("[a-z0-9]+")
LABEL = r"^[^:/?#]*://(?:[^/?#]*\.)?"
SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def expression(pattern: str) -> str:
    """The regular expression of a pattern (without ``@@``), valid for Python and RE2."""
    head, tail = "", ""
    if pattern.startswith("||"):
        head, pattern = LABEL, pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        pattern, tail = pattern[:-1], "$"
    return "(?s)" + head + "".join({"*": ".*", "^": SEPARATOR}.get(c) or re.escape(c) for c in pattern) + tail


def tokens(pattern: str) -> list[str]:
    """Tokens that every URL matched by the pattern holds as whole tokens.

    A run of letters and digits counts if what bounds it on either side is no wildcard and not
    an open end: a literal character that no token contains, a separator or an anchor.
    """
    anchored = pattern.startswith("|")
    pattern = pattern.lstrip("|") if anchored else pattern
    closed = pattern.endswith("|")
    body = pattern[:-1] if closed else pattern
    found = []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] != "*" if m.start() else anchored
        right = body[m.end()] != "*" if m.end() < len(body) else closed
        if left and right:
            found.append(m.group())
    return sorted(set(found))


def url_tokens(url: str) -> set[str]:
    return set(TOKEN.findall(url))


def parts(patterns: Sequence[str]) -> list[tuple[str, bool]]:
    """(pattern, whether it blocks), lower-cased; the list's size is checked."""
    if sum(len(p.encode()) for p in patterns) > RULE_BYTES:
        raise ValueError(f"the pattern rules have over {RULE_BYTES} bytes")
    return [((p[2:] if p.startswith("@@") else p).translate(FOLD), not p.startswith("@@")) for p in patterns]


def token_counts(pages: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Rows whose URL holds each of the wanted tokens, over the whole table; at most one row a token reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen: Counter[str] = Counter()
        for b in batches:
            for url in b.column("url").to_pylist():
                seen.update(url_tokens((url or "").translate(FOLD)) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                         ["token", "n"])

    counted = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "token string, n long")
    return {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index(patterns: Sequence[str], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rarest token -> numbers of its rules, numbers of the rules without a token)."""
    by_token: dict[str, list[int]] = defaultdict(list)
    free = []
    for k, (pattern, _) in enumerate(parts(patterns)):
        own = tokens(pattern)
        if own:
            by_token[min(own, key=lambda t: (counts.get(t, 0), t))].append(k)
        else:
            free.append(k)
    return dict(by_token), free


class Matcher:
    """Judges URLs by the indexed patterns; ``runs`` counts the expressions run."""

    def __init__(self, patterns: Sequence[str], counts: dict[str, int]):
        self.rules = parts(patterns)
        self.by_token, self.free = index(patterns, counts)
        self.compiled: dict[int, re.Pattern[str]] = {}
        self.runs = 0

    def candidates(self, url: str) -> list[int]:
        found = list(self.free)
        for t in url_tokens(url):
            found += self.by_token.get(t, ())
        return sorted(found)

    def matches(self, k: int, url: str) -> bool:
        if k not in self.compiled:
            self.compiled[k] = re.compile(expression(self.rules[k][0]))
        self.runs += 1
        return self.compiled[k].search(url) is not None

    def blocking(self, url: str) -> int | None:
        """Number of the first pattern that blocks a lower-cased URL; None where none does or an exception matches."""
        some = self.candidates(url)
        first = next((k for k in some if self.rules[k][1] and self.matches(k, url)), None)
        if first is None or any(not self.rules[k][1] and self.matches(k, url) for k in some):
            return None
        return first


class HostRules:
    """Host rules by host; a URL's host is looked up label by label."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for host, path, verdict in rules:
            self.by_host[host].append((path, verdict))
        for paths in self.by_host.values():
            paths.sort(key=lambda x: -len(x[0]))

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, host
        while at:
            for p, verdict in self.by_host.get(at, ()):
                if path.startswith(p):
                    if best is None or len(at) + len(p) > len(best[0]):
                        best = (at + p, verdict)
                    break
            at = at.partition(".")[2]
        return best


def split_url(url) -> dict[str, object]:
    """host and path columns of a URL column, both empty where it is NULL or has no ``://``."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def judge(pages: DataFrame, host_rules: Sequence[tuple[str, str, str]] = HOST_RULES,
          patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row.

    rule: the host rule that decided (host and path), else NULL; pattern: the pattern that
    blocked a URL without a host rule, else NULL.
    """
    tell_workers(pages.sparkSession)
    wanted = {t for p, _ in parts(patterns) for t in tokens(p)}
    counts = token_counts(pages, wanted)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url")).withColumns(split_url(F.col("url")))
    host_rules, patterns = tuple(host_rules), tuple(patterns)
    kept = ["page_id", "host", "path"]

    def run(batches: Iterator[pa.RecordBatch]):
        hosts, matcher = HostRules(host_rules), Matcher(patterns, counts)
        for b in batches:
            rule, verdict, why = [], [], []
            for url, host, path in zip(*(b.column(c).to_pylist() for c in ("url", "host", "path"))):
                if found := hosts.fitting(host, path):
                    rule.append(found[0])
                    verdict.append(found[1])
                    why.append(None)
                else:
                    k = matcher.blocking((url or "").translate(FOLD))
                    rule.append(None)
                    verdict.append("allow" if k is None else "block")
                    why.append(None if k is None else matcher.rules[k][0])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept),
                                              *(pa.array(x, pa.string()) for x in (rule, verdict, why))],
                                             [*kept, "rule", "verdict", "pattern"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the verdict on every page's URL."""
    return judge(read(spark, sf_dir, "pages"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(host_rules: Sequence[tuple[str, str, str]] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> str:
    """DuckDB SQL that tries every rule on every URL."""
    hosts = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in host_rules)
    tried = ", ".join(f"({k}, {_quoted(p)}, {_quoted(expression(p))}, {str(b).lower()})"
                      for k, (p, b) in enumerate(parts(patterns)))
    return f"""
WITH rules(h, p, v) AS (VALUES {hosts}),
patterns(k, pattern, expr, blocks) AS (VALUES {tried}),
urls AS (SELECT DISTINCT url FROM pages),
split AS (
  SELECT url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS folded
  FROM urls),
fitting AS (
  SELECT url, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY url),
hits AS (
  SELECT folded, min_by(pattern, k) FILTER (blocks) AS pattern, bool_or(NOT blocks) AS spared
  FROM (SELECT DISTINCT folded FROM split) s JOIN patterns ON regexp_matches(folded, expr)
  GROUP BY folded),
judged AS (
  SELECT split.url, host, path, rule, verdict,
         CASE WHEN rule IS NULL AND NOT coalesce(spared, false) THEN pattern END AS pattern
  FROM split LEFT JOIN fitting ON split.url IS NOT DISTINCT FROM fitting.url LEFT JOIN hits USING (folded))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM pages JOIN judged ON pages.url IS NOT DISTINCT FROM judged.url
"""
