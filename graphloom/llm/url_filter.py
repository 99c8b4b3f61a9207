"""URL filters: pattern rules found by their rarest literal token [native].

Patterns: ``||`` host anchor (the host itself or any subdomain), ``|`` start or end,
``*`` anything, ``^`` a separator or the end, everything else literal. They are matched
against ``//host/path`` with the host lower-cased (A-Z only). A rule's *literal tokens*
are alphanumeric runs that must stand in a matching URL as whole tokens; the one that
the corpus has least often is the rule's key. A URL's own tokens fetch the rules with
these keys, and only those run their regular expression. Rules without such a token are
candidates of every URL.

Defined results: a null URL or one without ``://`` has an empty host and path, which no
rule fits, so the default verdict holds. Repeated rows are judged alike, one row each.
An empty table gives an empty table. Columns besides the URL are passed through unless
they bear the name of a result column (in any case of letters), which then replaces them.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, other_columns

#: Up to so many bytes of rules the index is a constant of the plan and no row is shuffled.
INLINE_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``tier`` decides between rules that fit, then the length of ``name``."""

    name: str
    pattern: str
    verdict: str
    tier: int = 0

    def regex(self) -> str:
        out, p = "", self.pattern
        if p.startswith("||"):
            out, p = r"^//(?:[^/]*\.)?", p[2:]
        elif p.startswith("|"):
            out, p = "^", p[1:]
        end = p.endswith("|")
        for c in p[:-1] if end else p:
            out += {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", c)
        return out + "$" * end

    def tokens(self) -> list[str]:
        p = self.pattern
        marked = "\0" + p[2:] if p.startswith("||") else "\0" + p[1:] if p.startswith("|") else "*" + p
        marked = marked[:-1] + "\0" if p.endswith("|") else marked + "*"
        found = re.finditer(r"[A-Za-z0-9]+", marked)
        return [m[0] for m in found if marked[m.start() - 1] != "*" and marked[m.end()] != "*"]


def host_rule(name: str, verdict: str, tier: int = 2) -> Rule:
    """A rule such as ``example.net/en/``: host or subdomain, and the path's beginning."""
    return Rule(name, "||" + name, verdict, tier)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def _table(entries: dict[str, list], kind: str) -> tuple[Column, int]:
    """A literal hash table: an array of buckets, each with the (token, values) that hash to it; and how many buckets it has."""
    n = 1 << max(4, (2 * len(entries)).bit_length())
    buckets: list[list] = [[] for _ in range(n)]
    for token, values in sorted(entries.items()):
        buckets[zlib.crc32(token.encode()) % n].append({"token": token, "values": values})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<token:string,values:array<{kind}>>>>"), n


def _fetch(tokens: Column, entries: dict[str, list], kind: str) -> Column:
    """The values of all the tokens that the table has: a bucket is reached by its number, so a token costs the same at any size."""
    table, n = _table(entries, kind)
    bucket = lambda t: F.get(table, (F.crc32(t.cast("binary")) % n).cast("int"))
    return F.flatten(F.transform(tokens, lambda t: F.flatten(F.transform(F.filter(bucket(t), lambda e: e["token"] == t), lambda e: e["values"]))))


def rarest_tokens(urls: DataFrame, subject: Column, rules: Sequence[Rule]) -> list[str]:
    """Each rule's key: of its tokens the one in the fewest URLs of the whole corpus ('' if it has none).

    Only the rules' own tokens leave a URL's row, counted in its task; one count for each reaches the driver.
    """
    own = sorted({t for r in rules for t in r.tokens()})
    if not own:
        return [""] * len(rules)
    seen = urls.select(F.explode(_fetch(_tokens(subject), {t: [t] for t in own}, "string")).alias("token")).groupBy("token").count()
    n = {r["token"]: r["count"] for r in seen.collect()}
    return [min(r.tokens(), key=lambda t: (n.get(t, 0), -len(t), t), default="") for r in rules]


_RULE = "struct<tier:int,size:int,id:int,name:string,verdict:string,regex:string>"
RESULT = ("host", "path", "rule_name", "rule_tier", "verdict")


def url_filter(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule_name`` and ``rule_tier`` of the deciding rule (or null), ``verdict``.

    Up to ``inline_bytes`` of rules the index is a literal hash table and each row is judged where it is read.
    Beyond, the distinct URLs' tokens are joined with the index; rules without a token are tried on every URL in its row.
    """
    spark = pages.sparkSession
    raw, subject, best = F.col(f"`{url}`"), fresh(pages, "subject_of_rules"), fresh(pages, "best_of_rules")
    kept = [F.col(f"`{c}`") for c in other_columns(pages, RESULT)]
    df = pages.select(*kept, host_of(raw).alias("host"), path_of(raw).alias("path")).withColumn(subject, F.concat(F.lit("//"), "host", "path"))
    text = F.col(subject)
    keys = rarest_tokens(df, text, rules)
    entries = [dict(tier=r.tier, size=len(r.name), id=i, name=r.name, verdict=r.verdict, regex=r.regex()) for i, r in enumerate(rules)]
    anywhere = F.from_json(F.lit(json.dumps([e for k, e in zip(keys, entries, strict=True) if not k])), f"array<{_RULE}>")
    index: dict[str, list] = {}
    for key, e in zip(keys, entries, strict=True):
        if key:
            index.setdefault(key, []).append(e)
    fitting = lambda rules_: F.array_max(F.filter(rules_, lambda c: F.rlike(text, c["regex"])))
    if len(json.dumps(entries)) <= inline_bytes:
        df = df.withColumn(best, fitting(F.concat(anywhere, _fetch(_tokens(text), index, _RULE))))
    else:
        table = spark.createDataFrame([(k, *e.values()) for k, es in index.items() for e in es], "token string, tier int, size int, id int, name string, verdict string, regex string")
        urls = df.select(text.alias("subject")).distinct().select("subject", F.explode(_tokens(F.col("subject"))).alias("token"))
        fits = urls.join(table, "token").where(F.expr("subject rlike regex"))
        found = fits.groupBy("subject").agg(F.max(F.struct("tier", "size", "id", "name", "verdict", "regex")).alias("found")).select(F.col("subject").alias(subject), F.col("found").alias(best))
        df = df.join(found, subject, "left").withColumn(best, F.array_max(F.filter(F.array(F.col(best), fitting(anywhere)), lambda x: x.isNotNull())))
    chosen = F.col(best)
    return df.select(*kept, "host", "path", chosen["name"].alias("rule_name"), chosen["tier"].alias("rule_tier"), F.coalesce(chosen["verdict"], F.lit(default)).alias("verdict"))
