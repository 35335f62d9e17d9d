"""URL filter rules by a sort-merge range join.

A rule is a host with a path prefix and holds for the host and its subdomains. With the labels of
the host reversed (``www.example.com`` -> ``com.example.www.``), a host and its subdomains are one
interval of sorted keys, and intervals are nested or disjoint. URLs and rules are cut into the
same ranges of keys; a rule goes to every range its interval touches. Within a range both are
sorted and swept together: a stack holds the rules of the hosts around the current one, and the
path decides among them. The longest rule wins, of equal ones the longer host.

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no rule; URLs
that repeat are judged each; of rules with the same host and path the first by verdict counts;
without rules every URL gets the default verdict; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actorlens.llm.arrow import arrow_schema, key_type
from actorlens.llm.ranges import borders, range_of, ranges_wanted

#: Equal keys are dealt over so many places in the order, so that borders can part them.
SALTS = 64
#: Ranges are dealt by hash; several for each partition even out.
RANGES_PER_PARTITION = 4
#: Sorts after every salt.
_END = 1 << 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL as they stand in it, empty where there is none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(known, pattern, 1), upper, upper.lower())
    return host, F.regexp_extract(known, pattern, 2)


def reversed_host(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def judge(
    urls: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", ranges: int = 0
) -> DataFrame:
    """(key, host, path, rule, verdict) of every URL; ``rules`` are rows (host, path, verdict)."""
    host, path = host_and_path(F.col(url).cast("string"))
    pages = urls.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path")).select(
        "*",
        reversed_host(F.col("host")).alias("_at"),
        F.pmod(F.xxhash64(F.col("_key").cast("string"), "path"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    mark = F.concat_ws("|", F.col("_key").cast("string"), "host", "path")
    cuts = borders(pages, [F.col("_at"), F.col("path"), F.col("_salt")], mark, ranges or RANGES_PER_PARTITION * ranges_wanted(urls))

    # The borders are bounded by the number of ranges, so they travel with the tasks.
    @F.pandas_udf("int")
    def range_of_page(at, path, salt):
        return at.__class__([range_of(cuts, k) for k in zip(at, path, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of_rule(at):
        # "." is followed by "/", so every subdomain lies between "com.example." and "com.example/".
        spans = ((range_of(cuts, (a, "", -1)), range_of(cuts, (a[:-1] + "/", "", _END))) for a in at)
        return at.__class__([list(range(first, last + 1)) for first, last in spans])

    pages = pages.withColumn("_range", range_of_page("_at", "path", "_salt"))
    listed = rules.select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict"
    ).filter("host <> '' and path is not null and verdict is not null")
    dealt = listed.withColumn("_at", reversed_host(F.col("host"))).withColumn(
        "_range", F.explode(ranges_of_rule("_at"))
    )
    kind = key_type(urls, key)
    both = pages.select("_range", "_at", F.lit(None).cast("string").alias("verdict"), "host", "path", "_key").unionByName(
        dealt.select("_range", "_at", "verdict", "host", "path", F.lit(None).cast(kind).alias("_key"))
    )
    ordered = both.repartition(ranges_wanted(urls), "_range").sortWithinPartitions("_range", "_at", F.col("verdict").isNull(), "verdict")
    schema = f"`{key}` {kind}, host string, path string, rule string, verdict string"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = _Around()
        for batch in batches:
            keys, hosts, paths, found, verdicts = [], [], [], [], []
            for number, at, verdict, host, path, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                around.move(number, at)
                if verdict is not None:
                    around.add(at, host, path, verdict)
                    continue
                rule, said = around.best(path) if host else (None, None)
                keys.append(page)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(default if said is None else said)
            columns = (keys, hosts, paths, found, verdicts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target
            )

    return ordered.mapInArrow(run, schema)


class _Around:
    """The hosts with rules around the current place of a sweep, outermost first."""

    def __init__(self):
        self.range, self.stack = None, []

    def move(self, number: int, at: str) -> None:
        if number != self.range:
            self.range, self.stack = number, []
        while self.stack and not at.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, at: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != at:
            self.stack.append((at, {}, {}))
        _, by_path, lengths = self.stack[-1]
        by_path.setdefault(path, (host + path, verdict))
        lengths[len(path)] = None

    def best(self, path: str) -> tuple[str | None, str | None]:
        rule, verdict = None, None
        for _, by_path, lengths in reversed(self.stack):  # inner hosts first: they win ties
            for length in sorted(lengths, reverse=True):
                hit = by_path.get(path[:length]) if length <= len(path) else None
                if hit:
                    if rule is None or len(hit[0]) > len(rule):
                        rule, verdict = hit
                    break
        return rule, verdict
