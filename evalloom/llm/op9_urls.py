"""URL filters: weighted vocabulary.

One Aho-Corasick pass over the lower-cased URL finds every term; a hit counts only where no letter or
digit of the same word touches it.  One strict term, or several distinct soft terms, reject.  Rules
for hosts and path prefixes go before the vocabulary: a rule holds for its host and all subdomains
and the longest that fits wins.

Null, or a URL without ``://``: host and path are empty, no rule fits, and the vocabulary judges what
text there is.  Rows stand alone, so repeated rows, empty tables and long URLs need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import table

# The vocabulary and how many distinct soft terms reject.
STRICT = ["adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "porn", "poker", "sex", "viagra", "warez", "xxx"]
SOFT = ["ads", "bets", "betting", "bonus", "cheap", "click", "crack", "deals", "farm", "free", "keygen", "loan", "lottery", "pills", "promo", "spam", "torrent", "track", "win"]
SEVERAL = 2
# Verdict, host and path prefix of each rule.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


class UrlJudge:
    def __init__(self, strict: list[str], soft: list[str], several: int, rules: list[tuple[str, str, str]]):
        import ahocorasick

        self.several = several
        self.auto = ahocorasick.Automaton()
        for hard, terms in ((False, soft), (True, strict)):
            for term in terms:
                self.auto.add_word(term.lower(), (hard, term.lower()))
        if strict or soft:
            self.auto.make_automaton()
        self.any = bool(strict or soft)
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.dots = max((host.count(".") for host in self.rules), default=0)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        at = len(host)
        for _ in range(self.dots + 1 if host else 0):  # no rule has more labels
            at = host.rfind(".", 0, at)
            suffix = host[at + 1 :]
            for prefix, verdict in self.rules.get(suffix, ()):
                if path.startswith(prefix) and (best is None or len(suffix) + len(prefix) > len(best[0])):
                    best = (suffix + prefix, verdict)
            if at < 0:
                break
        return best

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand as whole words."""
        found: tuple[set[str], set[str]] = (set(), set())
        if not self.any:
            return found
        low = ascii_lower(url)
        for last, (hard, term) in self.auto.iter(low):
            first = last - len(term) + 1
            if (first == 0 or not word(low[first - 1])) and (last + 1 == len(low) or not word(low[last + 1])):
                found[0 if hard else 1].add(term)
        return found

    def rejects(self, url: str) -> tuple[int, int, bool]:
        strict, soft = self.hits(url)
        return len(strict), len(soft), bool(strict) or len(soft) >= self.several


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


def word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the three marks ``/ ? #``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return ascii_lower(rest[:end]), path[:stop]


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: list[str] = STRICT, soft: list[str] = SOFT, several: int = SEVERAL, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, n_strict, n_soft, verdict of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_ = UrlJudge(strict, soft, several, rules)
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                rule = judge_.rule(host, path)
                n_strict, n_soft, bad = judge_.rejects(url or "")
                rows.append((host, path, rule and rule[0], n_strict, n_soft, rule[1] if rule else "block" if bad else "allow"))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "host", "path", "rule", "n_strict", "n_soft", "verdict"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    return src.mapInArrow(run, "id long, host string, path string, rule string, n_strict long, n_soft long, verdict string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fit = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fit(h, p)} then '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"when '{h}{p}' then '{v}'" for v, h, p in ranked)
    count = lambda terms: " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::bigint" for t in terms)
    return f"""
    with a as (select page_id, coalesce(url, '') u, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from pages),
    b as (select *, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end rest from a),
    c as (select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from b),
    d as (select *, case {rule} end rule, ({count(STRICT)}) n_strict, ({count(SOFT)}) n_soft from c)
    select page_id, host, path, rule, n_strict, n_soft,
      case when rule is not null then case rule {verdict} end when n_strict > 0 or n_soft >= {SEVERAL} then 'block' else 'allow' end verdict
    from d"""


ORACLE_SQL = _sql()
