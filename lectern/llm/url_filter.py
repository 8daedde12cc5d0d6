"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse order, each ended by a dot, so a rule's host and all its subdomains are
one interval of keys, and rules of a host's parents are intervals around it. URLs and rule intervals are cut into ranges
at sampled keys (a rule goes to every range it overlaps), and each range is swept in key order: rules are pushed when
their interval begins and popped when it ends, so the stack holds exactly the active, nested rules. Within a host the
paths are swept likewise: the active rules' path prefixes are intervals of paths, nested on a second stack. The longest
active rule (host and path together, then host) decides.

Ranges are bounded by (host key, path, id), not by host alone, so one host with most of the pages spans many ranges.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; urls without a rule get the
default verdict; equal rules are applied once, and if they differ in verdict, block wins; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
#: Keys sampled for the cuts between ranges, at most, and ranges a shuffle partition.
SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_replace(_rest(url), r"(?s)[/?#].*", ""), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_replace(F.regexp_replace(_rest(url), r"(?s)[?#].*", ""), r"(?s)^[^/]*", "")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNotNull() & (at > 0), F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each ended by a dot: ``a.example.net`` is ``net.example.a.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class _Sweep:
    """Rules of one range in key order, entered and left as the sweep moves on."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        # (host key, path, name, verdict), parents before their subdomains
        self.rules = sorted(rules)
        self.at = 0
        self.hosts: list[tuple[str, list]] = []
        self.key: str | None = None

    def enter(self, key: str) -> None:
        """Moves on to a host: pops the hosts that aren't around it, pushes those that are."""
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()
        while self.at < len(self.rules) and self.rules[self.at][0] <= key:
            start = self.rules[self.at][0]
            same = []
            while self.at < len(self.rules) and self.rules[self.at][0] == start:
                same.append(self.rules[self.at])
                self.at += 1
            while self.hosts and not start.startswith(self.hosts[-1][0]):
                self.hosts.pop()
            self.hosts.append((start, same))
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()
        # the paths of the active hosts, swept in order beside the urls' paths
        self.paths = sorted(((r[1], len(r[0]), r) for _, rules in self.hosts for r in rules), key=lambda x: x[:2])
        self.next, self.open, self.key = 0, [], key

    def judge(self, key: str, path: str):
        if key != self.key:
            self.enter(key)
        while self.open and not path.startswith(self.open[-1][0]):
            self.open.pop()
        while self.next < len(self.paths) and self.paths[self.next][0] <= path:
            one = self.paths[self.next]
            self.next += 1
            if path.startswith(one[0]):
                self.open.append(one)
        # nested prefixes lie on the stack from short to long; a longer host may outweigh a longer path
        return max(self.open, key=lambda x: (len(x[0]) + x[1], x[1]))[2] if self.open else None


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict; ``rules`` has verdict, host and path."""
    spark = pages.sparkSession
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # cuts: quantiles of a bounded sample of keys, at most a few a partition
    total = urls.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = urls.where(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "path", "page_id").limit(4 * SAMPLE)
    keys = sorted((r["key"], r["path"], r["page_id"] or 0) for r in drawn.collect())
    n = max(1, min(len(keys), 2 * parts))
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)  # at most two a partition

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for b in batches:
            where = [bisect.bisect_right(shared.value, (k, p, i or 0)) for k, p, i in zip(b["key"].to_pylist(), b["path"].to_pylist(), b["page_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where, pa.int64()), *[pa.nulls(b.num_rows, pa.string())] * 2], [*b.schema.names, "part", "name", "verdict"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for b in batches:
            out: list[tuple] = []
            for verdict, host, path in zip(b["verdict"].to_pylist(), b["host"].to_pylist(), b["path"].to_pylist()):
                key = _key(host)
                first, last = bisect.bisect_right(shared.value, (key, "", -(1 << 63))), bisect.bisect_right(shared.value, (key[:-1] + "/", "", 0))
                out += [(key, path, part, host + path, verdict) for part in range(first, last + 1)]
            columns = list(zip(*out)) if out else [()] * 5
            none = pa.nulls(len(out), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(out), pa.int64()), none, none, pa.array(columns[1], pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                ["page_id", "url", "host", "path", "key", "part", "name", "verdict"],
            )

    schema = "page_id long, url string, host string, path string, key string, part long, name string, verdict string"
    usable = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").where("host is not null and path is not null and verdict is not null")
    usable = usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is greater than "allow"
    mixed = urls.select("page_id", "url", "host", "path", "key").mapInArrow(number, schema).unionByName(usable.mapInArrow(spread, schema))
    sorted_ = mixed.repartitionByRange(2 * parts, "part").sortWithinPartitions("part", F.col("name").isNull(), "key", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rules_here, running = None, [], None
        for b in batches:
            rows: list[tuple] = []
            for page, host, path, key, p, name, verdict in zip(*(b[c].to_pylist() for c in ("page_id", "host", "path", "key", "part", "name", "verdict"))):
                if p != part:
                    part, rules_here, running = p, [], None
                if name is not None:
                    rules_here.append((key, path, name, verdict))
                    continue
                if running is None:
                    running = _Sweep(rules_here)
                best = running.judge(key, path)
                rows.append((page, host, path, best[2] if best else None, best[3] if best else default))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 4)], ["page_id", "host", "path", "rule", "verdict"]
            )

    return sorted_.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
