"""URL filters: a trie over reversed host labels and path segments.

A rule is a host and a path prefix. It fits its host and all subdomains where
the URL's path starts with the rule's path. Of several rules that fit, the
longest (host and path together) wins; of equally long ones a block, then the
one with the longer host.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A rule list beyond this many bytes is joined as a table and not sent to each task.
TRIE_BYTES = 16 << 20


def weight(rule: str, verdict: str) -> tuple[int, bool, int]:
    return len(rule), verdict == "block", len(rule.partition("/")[0])


class Trie:
    """Nodes are dicts: by host label from the last one, then (key "/") by path segment; "=" has what ends in that segment, by its last part."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.longest = 0
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("h", label), {})
            *segments, last = (slash + path).split("/")
            for segment in segments:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("=", {})
            self.longest = max(self.longest, len(last))
            if ends.get(last, ("", "allow"))[1] == "allow":
                ends[last] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            at = node
            for segment in segments:
                ends = at.get("=")
                for n in range(min(len(segment), self.longest) + 1) if ends else ():
                    found = ends.get(segment[:n])
                    if found and (best[0] is None or weight(*found) > weight(*best)):
                        best = found
                at = at.get(("p", segment))
                if at is None:
                    break
        return best


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Else both empty."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.locate("://", url) + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


@common.guarded("_found")
def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (null where none fits) and verdict (the rule's, else ``default``).

    A null URL or one without :// has an empty host and path, and the default
    verdict. Rows are kept as they are, equal ones too; columns of ``df`` with
    these names are replaced. Rules of at most TRIE_BYTES go to each task as a
    trie; more of them are joined as a table by host.
    """
    rules = list(rules)
    host, path = host_and_path(F.col(f"`{url}`"))
    df = common.without(df, "host", "path", "rule", "verdict").select("*", host.alias("host"), path.alias("path"))
    if sum(len(r.encode()) for r, _ in rules) > TRIE_BYTES:
        return _judge_by_join(df, rules, default)
    held = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        find = held.value.find
        return pd.DataFrame([find(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    found = df.withColumn("_found", judge("host", "path"))
    return found.select(*df.columns, F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))


def _judge_by_join(df: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same for rule lists of any size: distinct (host, path) pairs meet the rules of each host suffix."""
    table = df.sparkSession.createDataFrame(rules, "rule string, verdict string").select(
        "rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("if(instr(rule, '/') > 0, substr(rule, instr(rule, '/')), '')").alias("rule_path")
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = df.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    best = (
        places.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.col("verdict") == "block", F.length("rule_host"), "verdict", "rule")).alias("_found"))
    )
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
OP8_SQL = rf"""
with given(rule, rule_host, rule_path, verdict) as (values {_VALUES}),
rules as (select *, length(rule) * 10000 + (verdict = 'block')::int * 5000 + length(rule_host) as weight from given),
rests as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
places as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path, row_number() over () as n
  from rests),
found as (
  select p.n, max_by(r.rule, weight) as rule, max_by(r.verdict, weight) as verdict
  from places p join rules r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
  group by p.n)
select page_id, host, path, f.rule, coalesce(f.verdict, 'allow') as verdict from places p left join found f using (n)
"""
