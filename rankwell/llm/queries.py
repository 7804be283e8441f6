"""The training-data queries by name, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import bpe, decontam, langid, licenses, linededup, quality, sharding, simhash, tokenfiles, urlfilter

#: Host rules of the URL filter and the sites whose pages make up the list of URLs; fixed values.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LISTED_SITES = "(^|[.])(cheap-pills|spam-farm|casino-win|free-bets|adult-x|ads-track)[.]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight equal shards, and in one of nine."""
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 8)


def _op2_sql() -> str:
    """Rendezvous shards by the same MD5; CRC-32 byte by byte over the table of its polynomial."""
    crcs = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        crcs.append(c)
    near = "-ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT row, s, {near} AS d FROM t, (SELECT unnest(range(0, 9))::INTEGER AS s)),
p AS (SELECT row, arg_min(s, (d, s)) FILTER (s < 8) AS shard, arg_min(s, (d, s)) AS grown_shard FROM d GROUP BY 1),
c AS (SELECT row, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
   lambda a, b: xor(a >> 8, list_extract(CAST({crcs} AS BIGINT[]), (xor(a, b) & 255) + 1)), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM t)
SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard
FROM t JOIN p USING (row) JOIN c USING (row)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    """Containment in the same windows, of shingle texts and without signatures."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    clean = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
    shingles = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"""
    return f"""
WITH t0 AS (SELECT license, CASE WHEN c = '' THEN [] ELSE string_split(c, ' ') END AS w FROM (SELECT license, {clean} AS c FROM (VALUES {values}) AS v(license, text))),
t AS (SELECT license, len(hs) AS n, CAST(pow(2, ceil(log2(len(hs)))) AS BIGINT) AS stride, hs FROM (SELECT license, list_distinct({shingles}) AS hs FROM t0) WHERE len(hs) > 0),
ts AS (SELECT license, n, stride, unnest(hs) AS s FROM t),
d0 AS (SELECT doc_id, text, CASE WHEN c = '' THEN [] ELSE string_split(c, ' ') END AS w FROM (SELECT doc_id, text, {clean} AS c FROM documents)),
d1 AS (SELECT doc_id, text, {shingles} AS hs FROM d0),
d AS (SELECT doc_id, text, unnest(hs) AS s, generate_subscripts(hs, 1) - 1 AS pos FROM d1),
hits AS (SELECT doc_id, text, license, n, stride, s, pos FROM d JOIN ts USING (s)),
wins AS (SELECT *, pos // stride * stride AS start FROM hits UNION ALL SELECT *, (pos // stride - 1) * stride AS start FROM hits WHERE pos >= stride),
share AS (SELECT doc_id, text, license, start, count(DISTINCT s)::DOUBLE / any_value(n) AS containment FROM wins GROUP BY 1, 2, 3, 4)
SELECT doc_id, license, containment, start::INTEGER AS first_word FROM share WHERE containment >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, text, license ORDER BY containment DESC, start) = 1
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: rules first, then the list of canonical URLs of listed sites."""
    pages = table(spark, sf_dir, "pages")
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    listed = pages.filter(host.rlike(LISTED_SITES)).select(urlfilter.canonical(host, path).alias("key"))
    return urlfilter.judge(pages, listed, RULES)


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|[.])(cheap-pills|spam-farm|casino-win|free-bets|adult-x|ads-track)[.]')),
r AS (SELECT c.*, l.canon IS NOT NULL AS listed,
        CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM r
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on over 10 % (and at least 3) of its source's documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(d, counts=True)


def vocabulary_path() -> str:
    """The public vocabulary file that the production queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, its level and the certified one; strata by its language."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op5_sql() -> str:
    """The same counts, levels and bounds. The binomial tail is summed over all terms."""
    over = " ".join(f"WHEN {' OR '.join(f'{r} > {c!r}' for r, c in zip(quality.RULES, cs))} THEN {k}" for k, cs in enumerate(quality.LEVELS))
    risk = f"{quality.RISK!r}::DOUBLE"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, stratum, text, regexp_extract_all(text, '[^\x09-\x0D\x20]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines FROM t),
g AS (SELECT row, i, array_to_string(w[i:i + 7], chr(1)) AS g FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
m AS (SELECT row, doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover USING (row)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS per,
  n_symbols / per AS symbol_ratio, word_chars / per AS word_length, n_words / greatest(word_chars, 1)::DOUBLE AS short_words, n_dup_lines / per AS dup_line_ratio, n_repeat_words / per AS repeat_ratio FROM m),
b AS (SELECT *, CASE {over} ELSE {len(quality.LEVELS)} END::INTEGER AS level FROM r),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) >= 1),
c AS (SELECT stratum, lv, count(*) AS n, count(*) FILTER (level <= lv) AS k FROM b SEMI JOIN good USING (doc_id), (SELECT unnest(range(0, {len(quality.LEVELS)})) AS lv) WHERE NOT base_failed GROUP BY 1, 2),
s AS (SELECT greatest(1, count(DISTINCT stratum)) AS strata FROM c),
failed AS (SELECT stratum, min(lv) AS lv FROM c, s WHERE NOT (k < n * {risk} AND
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) <= {quality.ERROR!r} / strata) GROUP BY 1),
cut AS (SELECT DISTINCT c.stratum, coalesce(failed.lv, {len(quality.LEVELS)}) - 1 AS certified FROM c LEFT JOIN failed ON failed.stratum = c.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND level > coalesce(certified, -1) AS kept,
  level, coalesce(certified, -1)::INTEGER AS certified
FROM b LEFT JOIN cut USING (stratum)
"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document's text and of what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


#: The id that ends each document in the token files.
END_ID = 1


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the token files."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), END_ID)


def piece_path() -> str:
    """The public vocabulary whose pieces language identification uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on(docs, piece_path())
    out = docs.select("doc_id", langid.held_out().alias("held_out"), langid.predict(model, docs).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a benchmark item, whose last sentence is taken as its answer."""
    question, answer = decontam.split_answer(F.col("text"))
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), question, answer)


#: Items i (item_id, q, a: word lists; w: both; c: class size; hs: shingles) and their matches in {docs} with columns row, text.
DECONTAM_SQL = r"""
 i0 AS (SELECT item_id, text, regexp_extract(text, '(?s)^.*[.?!]\s+(.+)$', 1) AS ans FROM benchmark),
 i1 AS (SELECT item_id, CASE WHEN ans = '' THEN text ELSE left(text, length(text) - length(ans)) END AS question, ans FROM i0),
 i2 AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(question), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS q,
   list_filter(string_split(regexp_replace(lower(ans), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS a FROM i1),
 i3 AS (SELECT *, list_concat(q, a) AS w FROM i2),
 i AS (SELECT *, CAST(greatest(8, pow(2, ceil(log2(len(w))))) AS BIGINT) AS c,
   list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS hs FROM i3 WHERE len(w) >= 5),
 ish AS (SELECT item_id, c, unnest(hs) AS s FROM i),
 dw AS (SELECT row, list_filter(string_split(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM ({docs})),
 dsh AS (SELECT row, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s, unnest(range(0, len(w) - 4)) AS pos FROM dw),
 hit AS (SELECT row, item_id, c, s, pos FROM dsh JOIN ish USING (s)),
 win AS (SELECT row, item_id, c, s, (pos // c - k) * c AS start FROM hit, (SELECT unnest(range(0, 3)) AS k) WHERE pos // c >= k AND pos + 5 <= (pos // c - k + 3) * c),
 cand AS (SELECT row, item_id, c, start, count(DISTINCT s) AS n FROM win GROUP BY ALL),
 part AS (SELECT row, item_id, n / len(hs) AS overlap,
   len(list_intersect(list_distinct(q), dw.w[start + 1:start + 3 * i.c])) / greatest(1, len(list_distinct(q))) AS question_overlap,
   CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), dw.w[start + 1:start + 3 * i.c])) / len(list_distinct(a)) END::DOUBLE AS answer_overlap
   FROM cand JOIN i USING (item_id) JOIN dw USING (row) WHERE n / len(hs) >= 0.8),
 held AS (SELECT * FROM part WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5
   QUALIFY row_number() OVER (PARTITION BY row, item_id ORDER BY overlap DESC, question_overlap DESC, answer_overlap DESC) = 1)"""

OP10_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS row, * FROM documents),"
    + DECONTAM_SQL.format(docs="SELECT row, text FROM d")
    + " SELECT doc_id, item_id, overlap, question_overlap, answer_overlap FROM held JOIN d USING (row)"
)


LINE_DEDUP_SQL = r"""
 page_lines AS (
  SELECT source AS host, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')))) AS line
  FROM {docs} WHERE source IS NOT NULL),
 host_pages AS (SELECT source AS host, count(*) AS host_pages FROM {docs} WHERE source IS NOT NULL GROUP BY 1),
 boiler AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS pages FROM page_lines GROUP BY 1, 2) JOIN host_pages USING (host)
  WHERE pages >= 3 AND pages * 100 > host_pages * 10),
 per_host AS (SELECT host, list(line) AS lines FROM boiler GROUP BY 1)"""

OP9_SQL = (
    "WITH"
    + LINE_DEDUP_SQL.format(docs="documents")
    + r"""
SELECT doc_id, source,
       CASE WHEN text IS NULL THEN NULL WHEN lines IS NULL THEN text
            ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, x)), chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       CASE WHEN text IS NULL OR lines IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(lines, x))) END::BIGINT AS n_dropped
FROM documents LEFT JOIN per_host ON source = host
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_sharding": op2_sharding,
        "op3_license_scan": op3_license_scan,
        "op4_url_filter": op4_url_filter,
        "op5_quality": op5_quality,
        "op6_bpe": op6_bpe,
        "op7_token_files": op7_token_files,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _op2_sql(), "op3_license_scan": _op3_sql(), "op4_url_filter": OP4_SQL, "op5_quality": _op5_sql(), "op9_line_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL}
