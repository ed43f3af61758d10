"""URL filters by a Bloom filter cascade; DataFrame and SQL functions only.

Keys are a host and its parent domains. The key universe is every key of the corpus. Level 1 is a Bloom filter of the
listed keys; what of the universe passes it is compared with the list. Level 2 is a filter of the unlisted keys that passed,
level 3 one of the listed keys that level 2 takes for those, and so on until no key is mistaken; the first level that lacks
a key then decides exactly. Filters are built by partially aggregated bit_or over 64-bit words; only the words of a level,
whose number follows from the number of its keys, come to the driver, and they enter the plan as a folded constant:
membership needs no join. A list of more than ``SHARD`` keys (about 1.3 MB of words) is dealt to so many cascades by the
keys' hashes, each over its share of the universe; every one of them makes its own pass over the pages.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. Rules come first: one fits its host and all subdomains if the path starts with the rule's, the longest wins.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; an empty list
allows what no rule blocks, null keys in it are ignored. Urls of any length; an empty table gives an empty table; repeated
rows get equal answers; clashing columns are replaced.
"""

from __future__ import annotations

import json
import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, with_columns

#: The rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names of sites to block; each stands under every one of the public suffixes below.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SUFFIXES = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{n}.{s}" for n in NAMES for s in SUFFIXES)
SHARD, DEPTH = 1_000_000, 40

ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, '.' || host AS dotted FROM h),
v AS (SELECT *, CASE {" ".join(f"WHEN ends_with(dotted, '.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule FROM f)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in RULES)}
  WHEN {" OR ".join(f"ends_with(dotted, '.{k}')" for k in LISTED)} THEN 'block' ELSE 'allow' END AS verdict FROM v
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + j)), F.lit(bits)) for j in range(hashes)]


class Level:
    """One Bloom filter: words of 64 bits as a constant."""

    def __init__(self, keys: DataFrame, n: int, number: int):
        self.number, self.hashes = number, 7 if number == 1 else 3
        self.bits = 64 * math.ceil(max(64, n * self.hashes / math.log(2)) / 64)
        at = F.explode(F.array(*places(F.col("key"), number, self.bits, self.hashes))).alias("at")
        words = keys.select(at).groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
        held = [0] * (self.bits // 64)
        for w, b in words.toLocalIterator():
            held[w] = b
        self.words = F.from_json(F.lit(json.dumps(held)), "array<bigint>")

    def has(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.getbit(F.get(self.words, (p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places(key, self.number, self.bits, self.hashes)])


class Cascade:
    def __init__(self, universe: DataFrame, listed: DataFrame):
        """universe: distinct keys of the corpus; listed: distinct listed keys (both a column key)."""
        self.levels = []
        if not (n := listed.count()):
            return
        self.levels.append(Level(listed, n, 1))
        passed = cut(universe.where(self.levels[0].has(F.col("key"))))  # the listed keys of the corpus, and few others
        ours, others = cut(passed.join(listed, "key", "left_anti")), cut(passed.join(listed, "key", "left_semi"))
        while (n := ours.count()) and len(self.levels) < DEPTH:
            level = Level(ours, n, len(self.levels) + 1)
            self.levels.append(level)
            ours, others = cut(others.where(level.has(F.col("key")))), ours
        if len(self.levels) == DEPTH:
            raise RuntimeError("the cascade does not end")

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the number of levels in a row that have it is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(self.levels[depth - 1].has(key), out).otherwise(F.lit(depth % 2 == 0))
        return out


def _listed(universe: DataFrame, keys: DataFrame, i: int, shards: int) -> Column:
    """Whether a key of the host is in the list, for keys of one share."""
    mine = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)) == i if shards > 1 else F.lit(True)
    cascade = Cascade(universe.where(mine(F.col("key"))), keys.where(mine(F.col("key"))))
    return F.exists(keys_of(F.col("host")), lambda k: mine(k) & cascade.has(k))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, shard: int = SHARD) -> DataFrame:
    """pages (column url) with host, path, rule and verdict. listed: a column key."""
    host, path = host_and_path(F.col("url"))
    base = with_columns(pages, {"host": host, "path": path})
    keys = listed.select("key").where(F.col("key").isNotNull()).distinct()
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = F.concat(F.lit("."), F.col("host")).endswith(f".{h}") & F.col("path").startswith(p)
        rule, action = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, verdict).otherwise(action)
    universe = base.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    shards = max(1, math.ceil(keys.count() / shard))
    if shards > 1:
        keys, universe = cut(keys), cut(universe)
    blocked = F.lit(False)
    for i in range(shards):
        if i:
            base, blocked = cut(with_columns(base, {"__ld_hit": blocked})), F.col("__ld_hit")
        blocked = blocked | _listed(universe, keys, i, shards)
    return with_columns(base, {"rule": rule, "verdict": F.coalesce(action, F.when(blocked, "block").otherwise("allow"))}).drop("__ld_hit")


def digest(pages: DataFrame) -> DataFrame:
    listed = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")
