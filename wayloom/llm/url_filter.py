"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join. DataFrame functions only.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule wins, at equal length the one that allows. Listed keys are
(host, path); a page is probed with every suffix of its host and every prefix of its path whose length
some rule's path has. The filter is an array of longs, a few hundred KB at most, that every task holds
as a scalar; possible hits go to an exact join against the rules, which is broadcast only up to
`broadcast_rules` rules.

Null, empty or odd urls (no "://"): host and path are empty, no rule fits, verdict is the default.
Repeated rows are all kept and judged alike; very long urls are judged whole; no pages give no rows, no rules the
default for all. Of rules for the same host and path one counts. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import lowered, table

#: The contract's list.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
WORDS, PROBES = 8, 6  # longs in a block of 512 bits; bits set for a key


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path as the contract defines them."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(cast(url as string), ''), instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise("")
    raw = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substr(rest, F.length(raw) + 1)
    return pages.withColumn("host", lowered(raw)).withColumn("path", F.substring_index(F.substring_index(tail, "?", 1), "#", 1))


def key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def bits(h: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its PROBES bit positions in the block: double hashing on the key's two halves."""
    g = F.xxhash64(h)
    lo, hi = g.bitwiseAND(F.lit(0x1FF)), F.shiftrightunsigned(g, 20).bitwiseAND(F.lit(0x1FF)).bitwiseOR(F.lit(1))
    return F.pmod(h, F.lit(blocks)), [(lo + hi * i).bitwiseAND(F.lit(0x1FF)) for i in range(PROBES)]


def one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """One row: an array of blocks * WORDS longs, the filter of the rules' keys."""
    block, where = bits(key(F.col("rule_host"), F.col("rule_path")), blocks)
    set_bits = rules.select(F.explode(F.transform(F.array(*where), lambda b: F.struct((block * WORDS + F.shiftright(b, 6)).alias("w"), one(b.bitwiseAND(F.lit(63))).alias("v")))).alias("x"))
    words = set_bits.groupBy(F.col("x.w").alias("w")).agg(F.bit_or("x.v").alias("v"))
    got = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return got.select(F.transform(F.sequence(F.lit(0), F.lit(blocks * WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("f"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", bits_a_rule: int = 16, max_blocks: int = 1 << 14, broadcast_rules: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages. The filter has bits_a_rule bits a rule, 1 MB at most."""
    rules = rules.filter("rule_host is not null and rule_path is not null").dropDuplicates(["rule_host", "rule_path"])
    n, lengths = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path"))).first()
    blocks = max(1, min(max_blocks, n * bits_a_rule // 512 + 1))
    urls = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    plane = bloom(rules, blocks).scalar()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>"), lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    probes = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))

    def possible(x: Column) -> Column:
        block, where = bits(key(x["host"], x["path"]), blocks)
        hit = F.lit(True)
        for b in where:
            word = F.get("plane", (block * WORDS + F.shiftright(b, 6)).cast("int"))
            hit = hit & (word.bitwiseAND(one(b.bitwiseAND(F.lit(63)))) != 0)
        return hit

    distinct = urls.select("host", "path").distinct()
    maybe = distinct.withColumn("plane", plane).select("host", "path", F.explode(F.filter(probes, possible)).alias("x")).select("host", "path", F.col("x.host").alias("rule_host"), F.col("x.path").alias("rule_path"))
    exact = maybe.join(F.broadcast(rules) if n <= broadcast_rules else rules, ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = exact.groupBy("host", "path").agg(F.min_by(F.struct(name.alias("rule"), F.col("rule_verdict").alias("v")), F.struct(-F.length(name), F.col("rule_verdict"), name)).alias("b"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


OP10_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (SELECT c.*, r.h || r.p AS rule, v FROM c LEFT JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""
