"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Five ratios that are large where text is poor have cutoffs at each of seven levels, from lax to strict, all fixed before a
label is seen; a level rejects a document if any ratio is over the level's cutoff, so a stricter level rejects whatever
a laxer one does. For each stratum the labelled good documents say how many of them a level would reject. With k of
n rejected, a level is certified if P(Bin(n, RISK) <= k) is at most the error; that is, if the exact (Clopper-Pearson) upper
bound of its false rejection rate lies below RISK. Multiple tests: ERROR is divided by the number of strata (Bonferroni);
within a stratum the levels are tested from the laxest on, up to the first that fails, which costs no error (fixed
sequence). The strictest certified level applies; a stratum too small to certify any rejects nothing by these rules. So
with probability 1 - ERROR no stratum loses over RISK of the good documents that pass the base rules.

Defined results: null and wordless texts have all counts zero and fail the base rules; documents without a stratum
form one of their own; a document with several labels is good if all say so; labels without a document count for
nothing, without labels nothing is rejected beyond the base rules; repeated documents are rows of their own, and count
as often; a very long text is measured whole; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.common import cut

#: Share of a stratum's good documents that may be lost, and probability that it is more in any stratum.
RISK, ERROR = 0.03, 0.05
#: Base rules.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Rules, and their cutoffs at each level.
RULES = ("symbol_ratio", "word_length", "short_words", "dup_line_ratio", "repeat_ratio")
LEVELS = (
    (1.00, 20.0, 0.50, 0.30, 0.28),
    (0.50, 15.0, 0.40, 0.20, 0.25),
    (0.30, 12.0, 0.37, 0.10, 0.22),
    (0.20, 10.0, 0.35, 0.08, 0.20),
    (0.10, 9.0, 0.33, 0.05, 0.18),
    (0.05, 8.5, 0.30, 0.04, 0.16),
    (0.02, 8.0, 0.28, 0.03, 0.14),
)
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    lines = [x for x in raw.split(b"\n") if x.translate(None, _SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which stands twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    # exact: windows of 1, 2, 4, 8 words are numbered by pairs of the numbers before
    size = 1
    while size < width:
        pair = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        ids, size = np.unique(pair, return_inverse=True)[1], 2 * size
    often = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[:n] += often
    cover[width : width + n] -= often
    return int((np.cumsum(cover)[:-1] > 0).sum())


_MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])


@F.pandas_udf(_MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=list(_COUNTS), dtype="int64")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def ratio(rule: str) -> Column:
    """The rule's ratio, 0 for wordless texts; large is bad."""
    words = F.col("n_words")
    value = {
        "symbol_ratio": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "short_words": words / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
    }[rule]
    return F.when(words > 0, value).otherwise(F.lit(0.0))


def level() -> Column:
    """The laxest level that rejects the document, from 0; the number of levels if none does."""
    out = F.lit(len(LEVELS))
    for at in reversed(range(len(LEVELS))):
        over = reduce(Column.__or__, [ratio(r) > F.lit(c) for r, c in zip(RULES, LEVELS[at])])
        out = F.when(over, F.lit(at)).otherwise(out)
    return out


def certified(n: int, k: int, limit: float, error: float) -> bool:
    """Whether P(Bin(n, limit) <= k) <= error: the terms from the largest, the k-th, down to where they no longer count."""
    if n == 0 or k >= n * limit:
        return False
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(limit) + (n - k) * math.log1p(-limit)
    total = share = 1.0
    for i in range(k, 0, -1):
        share *= i * (1 - limit) / ((n - i + 1) * limit)
        total += share
        if share < 1e-17 * total:
            break
    return term + math.log(total) <= math.log(error)


def strictest(n: int, rejected: list[int], strata: int) -> int:
    """The strictest certified level, -1 if there is none; `rejected` are the good documents that each level rejects."""
    at = -1
    while at + 1 < len(rejected) and certified(n, rejected[at + 1], RISK, ERROR / strata):
        at += 1
    return at


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "stratum", quality: str = "quality") -> DataFrame:
    """Rows (stratum, certified): the strictest certified level of each stratum with a good document. `measured` has the id, the stratum, the counts and the level."""
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(quality).alias("q")).filter("q >= 1").select("id")
    held = measured.filter(~base_failed()).join(good, F.col(id_col) == F.col("id"), "left_semi")
    sums = [F.sum((F.col("level") <= k).cast("long")).alias(f"k{k}") for k in range(len(LEVELS))]
    counts = cut(held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *sums))
    strata = max(1, counts.count())

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rejected = b[[f"k{k}" for k in range(len(LEVELS))]].fillna(0).astype("int64").to_numpy().tolist()
            yield pd.DataFrame({"stratum": b[stratum], "certified": [strictest(int(n), k, strata) for n, k in zip(b["n"], rejected)]})

    return counts.mapInPandas(choose, "stratum string, certified int")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Rows (id, the five counts, base_failed, kept, level, certified): `level` is the laxest that rejects the document (7: none), `certified` its stratum's (-1: none)."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), measures(F.col(text_col)).alias("m"))
    m = cut(d.select(id_col, "stratum", "m.*").withColumn("level", level()))
    # one narrow row a stratum; Spark broadcasts it by its size, else shuffles and splits hot strata
    out = m.join(cut(cutoffs(m, labels, id_col)), "stratum", "left").withColumn("certified", F.coalesce("certified", F.lit(-1)))
    rejected = F.col("level") <= F.col("certified")
    return out.select(id_col, *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), "level", "certified")
