"""URL filters as a sort-merge range join.

Hosts are written with their labels reversed, each followed by a dot (``com.example.www.``), so that a rule's host and
all its subdomains are one interval of keys: those that begin with the rule's key. Urls are range-partitioned and
sorted by (key, path, id), which splits a host of any size. Each rule is repeated in the range parts that its interval
meets: whole inside one, or nested across a border. A sweep over a part in key order keeps a stack of the rules whose
interval is open; hosts nest, so the rules of a url are all on the stack, innermost on top. Among them the paths
decide: the rule must be a prefix of the url's path, the longest rule (host and path) wins, then the longest host.

Nulls: a null url, or one without ``://``, has an empty host and path. Null ids are kept. Repeated rows are judged
each. Rules with a null host or path are left out. A rule given twice with both verdicts blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host (lower case) and path."""
    url = F.col(f"`{url_col}`")
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot after it; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit(".")))


def _sweep(default: str):
    def run(frames):
        part, stack = None, []
        for df in frames:
            rules, verdicts = [], []
            for p, is_url, key, path, rule, verdict in zip(df["part"], df["is_url"], df["key"], df["path"], df["rule"], df["verdict"]):
                if p != part:
                    part, stack = p, []
                if not is_url:
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    stack[-1][1][path] = (rule, "block" if stack[-1][1].get(path, ("", ""))[1] == "block" else verdict)
                    stack[-1][2].add(len(path))
                    rules.append(None)
                    verdicts.append(None)
                    continue
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                best = None
                for host, paths, lengths in reversed(stack):
                    for n in sorted(lengths, reverse=True):
                        if n <= len(path) and path[:n] in paths:
                            if best is None or len(host) + n > best[0]:
                                best = (len(host) + n, paths[path[:n]])
                            break
                rules.append(best[1][0] if best else None)
                verdicts.append(best[1][1] if best else default)
            out = df[["_id", "host", "path"]].assign(rule=pd.Series(rules, dtype=object, index=df.index), verdict=pd.Series(verdicts, dtype=object, index=df.index))
            yield out[df["is_url"]]

    return run


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page row: id, host, path, rule (null if none fits), verdict.

    ``rules`` has host, path and verdict (allow or block); a rule reads as host and path joined."""
    urls = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url")), "_url")
    kind = dict(urls.dtypes)["_id"]
    width = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    keyed = urls.select(F.col("_id").cast("string").alias("_id"), "host", "path", host_key(F.col("host")).alias("key"))
    keyed = stored(keyed.repartitionByRange(width, "key", "path", "_id").withColumn("part", F.spark_partition_id()), "urls")
    ends = keyed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))  # one row a range part
    table = rules.filter("host is not null and path is not null and verdict is not null")
    table = table.select(F.concat("host", "path").alias("rule"), "path", "verdict", host_key(F.translate("host", _UPPER, _LOWER)).alias("key"))
    meets = (F.col("low") <= F.concat("key", F.lit("\U0010ffff"))) & (F.col("high") >= F.col("key"))
    placed = table.join(F.broadcast(ends), meets)  # as many rows as range parts, whatever the input
    events = keyed.select("part", F.lit(True).alias("is_url"), "key", "path", "_id", "host", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    opened = placed.select("part", F.lit(False).alias("is_url"), "key", "path", F.lit(None).cast("string").alias("_id"), F.lit(None).cast("string").alias("host"), "rule", "verdict")
    # A rule stands before all urls that it may judge: its key is a prefix of theirs.
    ordered = events.unionByName(opened).repartition(width, "part").sortWithinPartitions("part", "key", "is_url", "path")
    judged = ordered.mapInPandas(_sweep(default), "_id string, host string, path string, rule string, verdict string")
    return judged.select(F.col("_id").cast(kind).alias(id_col), "host", "path", "rule", "verdict")
