"""URL filter: host and path rules first; urls that no rule fits are looked up in a block list.

The list's canonical urls build a blocked Bloom filter: a url sets eight bits within one 256-bit block
(four 64-bit words), and a block is one row.  A page whose bits are all set in its block may be listed;
only these pages go to the exact join with the list, which removes the false positives.

Defined results: a null url or one without ``://`` has empty host and path; no rule with a path fits an
empty path; verdict is the rule's, else block if the canonical url is listed, else allow.  List entries may stand with
or without a scheme; one without a host lists nothing, so that pages without a host are never listed.  Repeated rows
are judged alike; an empty table gives an empty result; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import pick, pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the contract (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Words in host names of betting, drug and tracking sites.
SPAM_HOST_WORDS = ("casino", "bets", "pills", "ads-track")
#: The registered query also lists the canonical urls whose md5 comes before this text (an eighth of them, on every host).
LISTED_BELOW = "2"
BITS_PER_URL = 16
#: Filters up to this many blocks (32 bytes of bits each) are broadcast: 8 MB.  Larger ones are joined by shuffle.
BROADCAST_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a trailing slash, query without tracking parameters; no scheme, no fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[a-z]*|ref)(=|$)") & (p != ""))), "&")
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), "/+$", ""),
                    F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def canonical_entry(url: Column) -> Column:
    """``canonical`` of a list entry, which may stand without a scheme; empty without a host."""
    whole = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("http://"), url))
    return F.when(host_of(whole) != "", canonical(whole)).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    name = verdict = None
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"),) * 2


def _bits(url: Column) -> list[Column]:
    """Two of the bits of each of a block's four words."""
    h = F.xxhash64(url, F.lit(1))
    six = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), six(i))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """block, b0..b3 from ``listed`` (canon)."""
    keyed = listed.select(_block(F.col("canon"), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canon")))))
    return keyed.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url); ``listed`` (url) is the block list."""
    host, path, url = host_of(F.col("url")), path_of(F.col("url")), F.coalesce(F.col("url"), F.lit(""))
    names = pin(pick(listed, "url").where("url is not null").select(canonical_entry(F.col("url")).alias("canon")).where("canon <> ''").distinct(), "listed")
    blocks = max(1, -(-names.count() * BITS_PER_URL // 256))
    bloom = pin(bloom_filter(names, blocks), "bloom")
    rows = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"), canonical(url).alias("canon"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "block": _block(F.col("canon"), blocks)})
    probed = rows.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block", "left")
    maybe = F.lit(True)
    for i, b in enumerate(_bits(F.col("canon"))):
        maybe = maybe & (F.coalesce(F.col(f"b{i}"), F.lit(0)).bitwiseAND(b) == b)
    probed = pin(probed.select("page_id", "host", "path", "rule", "said", "canon", (maybe & F.col("said").isNull()).alias("maybe")), "probed")
    hits = probed.where("maybe").join(names.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canon", "left")
    verdict = lambda listed_: F.coalesce("said", F.when(listed_, "block").otherwise("allow"))
    out = ["page_id", "host", "path", "rule"]
    return hits.select(*out, verdict(F.col("listed")).alias("verdict")).unionByName(
        probed.where("not maybe").select(*out, verdict(F.lit(False)).alias("verdict")))


def spam_list(pages: DataFrame) -> DataFrame:
    """The block list of the registered query: urls whose host name holds one of the words, and those picked by hash."""
    url = F.col("url")
    picked = (host_of(url) != "") & (F.md5(canonical(url)) < LISTED_BELOW)
    return pick(pages, "url").where(host_of(url).rlike("|".join(SPAM_HOST_WORDS)) | picked)


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_QUERY = r"regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's')"
SQL = rf"""
WITH parts AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path,
         array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)(=|$)'))), '&') AS query
  FROM pages),
named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canon,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts),
listed AS (SELECT DISTINCT canon FROM named WHERE host <> '' AND (regexp_matches(host, '{"|".join(SPAM_HOST_WORDS)}') OR md5(canon) < '{LISTED_BELOW}'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""
