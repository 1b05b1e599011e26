"""URL rules in a sorted digest array (operator 8).

A rule is ``host/path`` with a verdict. Rules are kept in one file: their 64-bit xxhash keys, sorted, then verdicts, then the
rules' full strings. Workers map the file, so all of them on a machine share its pages, and only pages that probes touch are
read. A batch of URLs is probed at once: for each number of host labels and each length of path that some rule has, the keys of
all candidates are looked up by one vectorised binary search; a key that is found counts only if the
stored string equals the candidate, so hash collisions cannot decide anything. The longest rule that fits wins, of equally long ones
the one with the longer host. URLs that no rule fits get the default verdict.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default; hosts
are compared with A-Z lower-cased, paths as they are; repeated rows are judged one by one; no rules
are legal; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, map_file, write_file

VERDICTS = ("allow", "block")
DEFAULT = "allow"
RESULT = "page_id long, host string, path string, rule string, verdict string"
_MAGIC = 0x3152_4C52_554C
#: Rules are given by the driver, so their number is bounded: above it, ``build`` refuses.
MAX_RULES = 20_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL by the rules above, as column expressions."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class DigestArray:
    """The mapped file of rules."""

    def __init__(self, buf):
        head = np.frombuffer(buf, np.uint64, 5)
        if head[0] != _MAGIC:
            raise ValueError("not a file of rules")
        n, n_labels, n_paths = (int(x) for x in head[1:4])
        at = 40
        self.labels = np.frombuffer(buf, np.uint64, n_labels, at)
        at += 8 * n_labels
        self.paths = np.frombuffer(buf, np.uint64, n_paths, at)
        at += 8 * n_paths
        self.keys = np.frombuffer(buf, np.uint64, n, at)
        at += 8 * n
        self.ends = np.frombuffer(buf, np.uint64, n + 1, at)
        at += 8 * (n + 1)
        self.verdicts = np.frombuffer(buf, np.uint8, n, at)
        self.strings = memoryview(buf)[at + n :]

    @classmethod
    def to_bytes(cls, rules: list[tuple[str, str]]) -> bytes:
        """``rules``: ("host/path", verdict); the last one given for a string counts."""
        known = {}
        for rule, verdict in rules:
            if "/" not in rule:
                raise ValueError(f"a rule needs a path: {rule!r}")
            known[rule.encode()] = VERDICTS.index(verdict)
        items = sorted(known, key=lambda b: (xxhash.xxh64_intdigest(b), b))
        keys = np.array([xxhash.xxh64_intdigest(b) for b in items], np.uint64)
        hosts = [b.split(b"/", 1) for b in items]
        labels = np.unique(np.array([h.count(b".") + 1 for h, _ in hosts], np.uint64))
        paths = np.unique(np.array([len(p.decode()) + 1 for _, p in hosts], np.uint64))
        ends = np.concatenate([[0], np.cumsum([len(b) for b in items])]).astype(np.uint64)
        head = np.array([_MAGIC, len(items), len(labels), len(paths), 0], np.uint64)
        verdicts = np.array([known[b] for b in items], np.uint8)
        return b"".join([head.tobytes(), labels.tobytes(), paths.tobytes(), keys.tobytes(), ends.tobytes(), verdicts.tobytes(), *items])

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The number of the rule equal to each candidate, else -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        live = np.flatnonzero(at < len(self.keys))
        while len(live):
            live = live[self.keys[at[live]] == keys[live]]
            wrong = []
            for i in live.tolist():  # few: only where a key is in the array
                j = int(at[i])
                if self.strings[int(self.ends[j]) : int(self.ends[j + 1])] == candidates[i]:
                    out[i] = j
                else:
                    wrong.append(i)
            at[wrong] += 1
            live = np.array([i for i in wrong if at[i] < len(self.keys)], np.int64)
        return out

    def longest(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The rule of each URL, or -1."""
        best = np.full(len(hosts), -1, np.int64)
        best_size = np.full(len(hosts), -1, np.int64)
        split = [h.split(".") for h in hosts]
        for n in self.labels.tolist():
            for size in self.paths.tolist():
                rows = [i for i, (h, p) in enumerate(zip(split, paths, strict=True)) if len(h) >= n and len(p) >= size]
                if not rows:
                    continue
                texts = [f"{'.'.join(split[i][-n:])}{paths[i][:size]}" for i in rows]
                found = self.find([t.encode() for t in texts])
                at = np.array(rows)
                length = np.array([len(t) for t in texts])
                # labels rise, so of equally long rules the one with the longer host comes last
                better = (found >= 0) & (length >= best_size[at])
                best[at[better]], best_size[at[better]] = found[better], length[better]
        return best


def build(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Write the rules' file into the shared folder; returns its address."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    uri = f"{fresh_path(spark, 'rules')}/rules.bin"
    write_file(uri, [DigestArray.to_bytes(rules)])
    return uri


def judge(pages: DataFrame, rules_uri: str, default: str = DEFAULT) -> DataFrame:
    """Host, path, rule and verdict of every page: see ``RESULT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = DigestArray(map_file(rules_uri))
        for batch in batches:
            hit = rules.longest(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            name = [None if j < 0 else bytes(rules.strings[int(rules.ends[j]) : int(rules.ends[j + 1])]).decode() for j in hit.tolist()]
            verdict = [default if j < 0 else VERDICTS[rules.verdicts[j]] for j in hit.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    return url.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, RESULT)
