"""URL lists: a blocked Bloom filter of listed canonical URLs, an exact hash join of its hits, and host rules above both.

Defined results: host and path of a null URL, or of one without "://", are empty; such a URL is not listed and
no rule fits it; each row is judged, repeated or not; null entries of the list count for nothing; very long URLs are judged
whole; of several rules that fit, the longest decides; an empty table gives an empty one, an empty list blocks nothing;
only the id and the URL are read by `judge`, and other columns of any name pass `is_listed`.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut, fits, fresh, join_small

#: Bits of a block that an entry sets, entries per 64-bit block, rules beyond which hosts are joined to them instead of an expression for each.
BITS, PER_BLOCK, MAX_RULES = 6, 4, 500


def host_of(url: Column) -> Column:
    """From the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without closing slashes; null for an empty host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, word): one 64-bit word for each block that has an entry. `keys` has one column, key."""
    return keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("m")).groupBy("block").agg(F.bit_or("m").alias("word"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def is_listed(rows: DataFrame, key: str, listed: DataFrame, flag: str = "listed") -> DataFrame:
    """`rows` with a boolean column `flag`: whether `key` is in the one column of `listed`.

    The filter is broadcast while it is small, else joined by block. Rows that it turns away never take part
    in the exact join. Null keys are not listed.
    """
    entries = cut(listed.toDF("key").filter("key is not null").distinct())
    blocks = max(1, entries.count() // PER_BLOCK)
    words = blocked_bloom(entries, blocks)
    words = F.broadcast(words) if blocks * 16 <= (16 << 20) else words
    block, word, hit, own = (fresh(rows, x) for x in ("__block", "__word", "__hit", "__key"))
    probed = (
        rows.withColumn(block, F.when(F.col(key).isNotNull(), _block(F.col(key), blocks)))
        .join(words.toDF(block, word), block, "left")
        .withColumn(hit, F.coalesce(F.col(word).bitwiseAND(_mask(F.col(key))) == _mask(F.col(key)), F.lit(False)))
        .drop(block, word)
    )
    exact = entries.select(F.col("key").alias(own), F.lit(True).alias(flag))
    exact = F.broadcast(exact) if fits(entries, F.length("key") * 4) else exact
    hits = probed.filter(hit).drop(hit).join(exact, F.col(key) == F.col(own), "left").drop(own).withColumn(flag, F.coalesce(flag, F.lit(False)))
    return hits.unionByName(probed.filter(~F.col(hit)).drop(hit).withColumn(flag, F.lit(False)))


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """Whether the rule's host is `host` or above it, and `path` starts with the rule's path."""
    at = rule.index("/")
    own, start = rule[:at], rule[at:]
    return ((host == own) | host.endswith("." + own)) & path.startswith(start)


def _ruled(d: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`d` (with host and path) with the longest fitting rule and its verdict, null where none fits."""
    if len(rules) <= MAX_RULES:
        rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
        for text in sorted(rules, key=lambda r: (len(r), r)):
            fit = rule_fits(text, F.col("host"), F.col("path"))
            rule, says = F.when(fit, F.lit(text)).otherwise(rule), F.when(fit, F.lit(rules[text])).otherwise(says)
        return d.withColumn("rule", rule).withColumn("says", says)
    known = d.sparkSession.createDataFrame([(r[: r.index("/")], r[r.index("/") :], r, v) for r, v in rules.items()], "of string, start string, rule string, says string")
    pairs = d.select("host", "path").distinct()
    # every host above the page's, itself included
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = join_small(pairs.withColumn("of", F.explode(above)), known, ["of"], "inner", F.length("rule") * 8).filter(F.col("path").startswith(F.col("start")))
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "says")).alias("m")).select("host", "path", "m.rule", "m.says")
    return d.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict): the longest fitting rule's verdict, else block for listed URLs and allow for others."""
    d = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    d = _ruled(d, rules).withColumn("canon", canonical(F.col("host"), F.col("path")))
    out = is_listed(d, "canon", listed)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
