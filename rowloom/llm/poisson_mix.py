"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

For each source the mean repetition rate is weight * total / size, with sizes in code points of text.
A document's copies are the Poisson quantile of a uniform number taken from the MD5 of its identity and
a seed: the same document always gets the same copies, on any partitioning and after any retry. Copies
are exploded and dealt over all partitions by a second hash, in whose order each partition is sorted.

Scale: one aggregate over source buckets (never more rows than there are targets, plus one for all
others) comes to the driver; its rates are literals of the plan. A hot source is combined on the map
side for the sizes and needs no join for the rates. The deal is by a hash of the copy, not of the
source, so sizes of sources do not matter to it.

Defined results: a null source belongs to the bucket of all others, as does a source without a target;
a null text has size 0 and is replicated at its bucket's rate; a null key is replaced by the MD5 of the
text; repeated rows of one key get equal counts and equal shuffle keys; a bucket of size 0 keeps every
row once (rate 0 over 0 text says nothing); an empty table gives no rows; columns of the input named
copy, n_copies or shuffle_key are replaced.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import own_columns

OTHERS = "*"
OWN = ["copy", "n_copies", "shuffle_key"]
#: The production weights: the first source makes up a tenth of the text, nineteen others and the rest an equal share each.
WEIGHTS = {"src0": 0.1, **{f"src{i}": 0.045 for i in range(1, 20)}, OTHERS: 0.045}
#: From this mean rate on, counts are tabulated around the mean only.
DIRECT = 500


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until no uniform number of 52 bits lies above."""
    if rate <= 0:
        return [1.0]
    if rate > DIRECT:
        raise ValueError(f"a mean repetition rate of {rate:.0f} is beyond direct summation; see poisson_steps")
    term = total = math.exp(-rate)
    out, k = [total], 0
    while total < 1 - 2.0**-52 and term > 0:
        k += 1
        term *= rate / k
        total += term
        out.append(total)
    return out


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """(first, P(X <= first), P(X <= first + 1), ...), so that the quantile of u is first + how many are at most u.

    For high rates the terms are computed from the logarithm of the one at the mean; nine standard deviations on
    both sides leave out less than the 52 bits of a uniform number can tell. A table grows with the rate's root.
    """
    if rate <= DIRECT:
        return 0, poisson_cdf(rate)
    mean, width = int(rate), int(9 * math.sqrt(rate)) + 9
    first = max(0, mean - width)
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in (first,)]
    for k in range(first + 1, mean + width):
        logs.append(logs[-1] + math.log(rate / k))
    terms = [math.exp(x) for x in logs]
    whole = math.fsum(terms)
    return first, [min(1.0, x / whole) for x in accumulate(terms)]


def uniform(identity: Column, seed: str) -> Column:
    """52 bits of an MD5 as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), identity)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float], source: str, text: str) -> dict[str, float]:
    """Mean repetition rate of each bucket that the documents have."""
    sizes = docs.groupBy(bucket(weights, source).alias("b")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("n"))
    found = {r["b"]: r["n"] for r in sizes.collect()}  # at most one row for each target and one for the others
    total, wanted = sum(found.values()), sum(weights.get(b, 0.0) for b, n in found.items() if n)
    return {b: (weights.get(b, 0.0) / wanted * total / n if n else 1.0) if wanted else 0.0 for b, n in found.items()}


def bucket(weights: dict[str, float], source: str) -> Column:
    named = [w for w in weights if w != OTHERS]
    return F.when(F.col(source).isin(named), F.col(source)).otherwise(F.lit(OTHERS)) if named else F.lit(OTHERS)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix-1", key: str = "doc_id", source: str = "source", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The replicated documents, globally shuffled: the columns of docs, then copy, n_copies, shuffle_key."""
    weights = weights or WEIGHTS
    docs = own_columns(docs, OWN)
    tables = {b: poisson_steps(r) for b, r in rates(docs, weights, source, text).items()}
    identity = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    u = uniform(identity, seed)
    count = F.lit(0)
    for name, (first, cdf) in tables.items():
        steps = F.lit(first) + F.size(F.filter(F.from_json(F.lit("[" + ",".join(map(repr, cdf)) + "]"), "array<double>"), lambda c: c <= u))
        count = F.when(bucket(weights, source) == F.lit(name), steps).otherwise(count)
    counted = docs.withColumn("n_copies", count.cast("int")).where(F.col("n_copies") > 0)
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat(F.lit(seed + ":deal|"), identity, F.lit("|"), F.col("copy").cast("string"))), 1, 16))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key").select(*docs.columns, *OWN)


def op2_poisson_mix(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "source", "text"))


#: u below 1 has 52 bits; the quantile is the number of k with P(X <= k) <= u.
OP2_SQL = """
WITH d AS (SELECT doc_id, source, text, CASE WHEN regexp_full_match(source, 'src(1?[0-9])') THEN source ELSE '*' END AS b,
                  coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS ident FROM documents),
 s AS (SELECT b, coalesce(sum(length(text)), 0)::DOUBLE AS n FROM d GROUP BY b),
 w AS (SELECT b, n, CASE b WHEN 'src0' THEN 0.1::DOUBLE ELSE 0.045::DOUBLE END AS w FROM s),
 t AS (SELECT sum(n) AS total, sum(CASE WHEN n > 0 THEN w END) AS wanted FROM w),
 r AS (SELECT b, CASE WHEN n > 0 THEN w / wanted * total / n ELSE 1.0::DOUBLE END AS rate FROM w, t),
 c AS (SELECT b, k, sum(exp(-rate) * pow(rate, k) / factorial(k::INTEGER)::DOUBLE) OVER (PARTITION BY b ORDER BY k) AS cdf
       FROM r, range(0, 30) AS g(k)),
 u AS (SELECT *, ('0x' || substr(md5('mix-1|' || ident), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d),
 n AS (SELECT u.doc_id, u.source, u.text, u.ident, (SELECT count(*) FROM c WHERE c.b = u.b AND c.cdf <= u.u) AS n_copies FROM u)
SELECT doc_id, source, text, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies,
       substr(md5('mix-1:deal|' || ident || '|' || copy::VARCHAR), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n)
"""
