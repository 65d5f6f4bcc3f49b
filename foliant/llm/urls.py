"""URL rules through Bloom filter cascades.

The keys of a url are pairs of a host suffix (at label borders) and a path prefix (at slashes),
as 128-bit hashes that run along the url, so a key costs the same wherever it ends. A cascade of
the rules' hosts leaves the suffixes that some rule has; those are paired with the prefixes. A cascade holds a set of listed keys exactly for a known universe: level one is a Bloom
filter of the listed keys, level two one of the other keys of the universe that pass level one,
level three one of the listed keys that pass level two, and so on until nothing passes. A key is
listed if the first level that does not contain it is even. The universe is every key of the
table that is judged, so answers are exact and judging needs no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bounded_batches, lower_ascii, text_blocks

BITS_PER_KEY = 12
PROBES = 6
# a cascade beyond this is refused: it is broadcast to every task
LARGEST = 64 << 20
LEVELS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_states(host: str) -> Iterator[tuple[xxhash.xxh3_128, int]]:
    """Running hash of the host's labels from the last one on, with where the suffix starts.

    The state goes on changing; copy it to keep it.
    """
    state, at = xxhash.xxh3_128(), len(host) + 1
    for label in reversed(host.split(".")):
        at -= len(label) + 1
        state.update(label.encode() + b".")
        yield state, at


def path_digests(state: xxhash.xxh3_128, path: str) -> Iterator[tuple[bytes, int]]:
    """Keys of a host suffix with every path prefix that ends in a slash, with where it ends."""
    state, at = state.copy(), 0
    while end := path.find("/", at) + 1:
        state.update(path[at:end].encode())
        at = end
        yield state.digest(), end


def table_of(keys: list[bytes]) -> pd.DataFrame:
    """Keys and their 64-bit hashes, the keys' first halves."""
    h = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2)[:, 0].astype(np.int64)
    return pd.DataFrame({"key": pd.Series(keys, dtype=object), "h": h})


class UrlKeys:
    """The keys of urls whose host suffix is a listed one, found in blocks of bounded size."""

    def __init__(self, hosts: Cascade):
        self.hosts = hosts

    def blocks(self, hosts: list[str], paths: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, int]], list[bytes]]]:
        """Per block: its first url, the number of its urls, (url, start in host, end in path) and key of each."""
        for first, block in text_blocks([h + p for h, p in zip(hosts, paths, strict=True)]):
            urls = range(first, first + len(block))
            digests = [s.digest() for u in urls for s, _ in host_states(hosts[u])]
            known = iter(self.hosts.contains(table_of(digests)["h"].to_numpy()).tolist())
            places, keys = [], []
            for u in urls:
                for state, start in host_states(hosts[u]):
                    if next(known):
                        for key, end in path_digests(state, paths[u]):
                            places.append((u, start, end))
                            keys.append(key)
            yield first, len(block), places, keys


def probes(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions (keys x probes) of 64-bit hashes at one level, by double hashing."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """The levels, each the words of a bit array."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def passes(self, h: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level]
        at = probes(h, level, 64 * len(words))
        return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(1)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        left, out = np.arange(len(h)), np.zeros(len(h), dtype=bool)
        for level in range(len(self.levels)):
            stays = self.passes(h[left], level)
            out[left[~stays]] = level % 2 == 1
            left = left[stays]
        out[left] = len(self.levels) % 2 == 1
        return out


def _fill(keys: DataFrame, level: int, count: int) -> np.ndarray:
    """The level's bits: tasks set theirs in words, and words of the same place are joined."""
    words = -(-max(64, BITS_PER_KEY * count) // 64)
    if 8 * words > LARGEST:
        raise ValueError(f"{count} keys are too many for a cascade of {LARGEST} bytes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(probes(b["h"].to_numpy(), level, 64 * words))
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pd.DataFrame({"word": word, "bits": bits.view(np.int64)})

    found = keys.select("h").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found, out = found.toPandas(), np.zeros(words, dtype=np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(cascade.levels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[Cascade(shared.value).passes(b["h"].to_numpy(), level)]

    return keys.mapInPandas(run, keys.schema)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` for ``universe`` (both: key, h), whose size follows the listed keys.

    Other keys are told from listed ones by an anti join of the few that pass the first level.
    """
    cascade, level = Cascade([]), 0
    inside, outside = listed, universe
    while level < LEVELS:
        count = inside.count()
        if not count:
            break
        cascade.levels = [*cascade.levels, _fill(inside, level, count)]
        passed = _passing(outside, cascade, level)
        if level == 0:
            passed = passed.join(listed, "key", "left_anti")
        inside, outside = materialise(passed, "cascade"), inside
        level += 1
    else:
        raise ValueError("two keys have one hash")
    return cascade


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Judges every url of ``pages`` (page_id, url) by ``rules`` (host, path, verdict).

    Columns page_id, host, path, rule, verdict. A rule fits its host and all subdomains if the
    url's path starts with its path, which must end in a slash; the longest fitting rule (its text
    host and path together, then the longer host) decides. A url that no listed key fits is
    allowed. A null url or one without ``://`` has empty host and path and fits none. Repeated
    pages each get their row; repeated rules are one, and of rules that differ only in the verdict
    ``block`` wins. Other columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    if rules.where("path not like '%/'").limit(1).count():
        raise ValueError("a rule's path must end in a slash")
    bounded_batches(spark)

    def rule_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of_host, keys = [], []
            for host, path in zip(b["host"], b["path"], strict=True):
                state = [s.copy() for s, start in host_states(host) if start == 0][0]
                of_host.append(state.digest())
                state.update(path.encode())
                keys.append(state.digest())
            hosts = table_of(of_host).rename(columns={"key": "host_key", "h": "host_h"})
            yield pd.concat([table_of(keys), hosts, b[["block"]].reset_index(drop=True)], axis=1)

    plain = rules.select(lower_ascii(F.col("host")).alias("host"), "path", (F.col("verdict") == "block").alias("block"))
    each = plain.mapInPandas(rule_keys, "key binary, h long, host_key binary, host_h long, block boolean")
    each = materialise(each, "rule-keys")
    listed = materialise(each.groupBy("key", "h").agg(F.max("block").alias("block")), "rules")
    listed_hosts = materialise(each.select(F.col("host_key").alias("key"), F.col("host_h").alias("h")).distinct(), "hosts")
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))

    def host_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, block in text_blocks(b["host"].tolist()):
                yield table_of(list({s.digest() for h in block for s, _ in host_states(h)}))

    universe = split.select("host").mapInPandas(host_keys, "key binary, h long").distinct()
    known_hosts = spark.sparkContext.broadcast(build(listed_hosts, materialise(universe, "host-keys")).levels)

    def url_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = UrlKeys(Cascade(known_hosts.value))
        for b in batches:
            for _, _, _, keys in own.blocks(b["host"].tolist(), b["path"].tolist()):
                yield table_of(list(set(keys)))

    universe = split.select("host", "path").mapInPandas(url_keys, "key binary, h long").distinct()
    any_rule = build(listed.select("key", "h"), materialise(universe, "universe")).levels
    blocking = build(listed.where("block").select("key", "h"), listed.select("key", "h")).levels
    shared = spark.sparkContext.broadcast((any_rule, blocking))

    @F.pandas_udf("rule string, verdict string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = UrlKeys(Cascade(known_hosts.value))
        in_any, in_block = map(Cascade, shared.value)
        for hosts, paths in batches:
            hosts, paths = hosts.tolist(), paths.tolist()
            found, verdicts = [None] * len(hosts), ["allow"] * len(hosts)
            for _, _, places, keys in own.blocks(hosts, paths):
                hashes = table_of(keys)["h"].to_numpy()
                hit, block = in_any.contains(hashes), in_block.contains(hashes)
                best: dict[int, tuple[int, int, int, bool]] = {}
                for i in np.nonzero(hit)[0].tolist():
                    u, start, end = places[i]
                    size = len(hosts[u]) - start
                    # between equal lengths the longer host decides
                    best[u] = max(best.get(u, (0, 0, 0, False)), (size + end, size, end, bool(block[i])))
                for u, (_, size, end, blocks) in best.items():
                    found[u] = hosts[u][len(hosts[u]) - size :] + paths[u][:end]
                    verdicts[u] = "block" if blocks else "allow"
            yield pd.DataFrame({"rule": found, "verdict": verdicts}, dtype=object)

    rows = split.select("page_id", "host", "path", verdict("host", "path").alias("v"))
    return rows.select("page_id", "host", "path", "v.*")
