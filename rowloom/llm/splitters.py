"""Sharding by sampled splitters (DataFrame functions only).

The law is `bytes`: shard sizes near equal. Records are ordered by a 64-bit hash of their text, so equal
texts are neighbours and form a group. A size-weighted sample of these keys gives quantile splitters;
the splitters cut the key line into many more ranges than there are shards. Exact sizes of the ranges
are then counted, overfull ranges (a hot group, or a bad draw) are subdivided by a second hash, of all that a
record has, and what is overfull still (records that are equal in all) by the place of the record in the table
that this operator writes. Consecutive pieces fill the shards in order up to equal sizes.

Scale: the texts are read once and reduced to (row columns, size, CRC, key) rows in the shared folder. The
driver sees splitters and sizes of pieces: some hundred bytes for each range, and a range for every
rows_per_range rows (200,000 ranges for 100 billion rows). A piece is numbered by a window of its own, and the
slots of a shard continue from piece to piece, so no task holds a shard, nor a group of equal records.

Defined results: null text has size 8 and the CRC 0; repeated rows are records of their own, and which of
equal rows goes to which shard may differ from run to run; a null key is like any other; an empty table gives
no rows; columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import own_columns, written

OVERHEAD = 8
OWN = ["size", "text_crc32", "shard", "slot"]


def longs(values: list[int]) -> Column:
    """A literal array; the JSON text is folded into one literal by the optimizer."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def interval(cuts: Column, n: int, key: Column) -> Column:
    """How many of the n sorted cuts are at most key, by binary search."""
    steps, step = [], 1
    while step <= n:
        steps.insert(0, step)
        step *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(cuts, at + s - 1) <= key), at + s).otherwise(at))


def splitters(keys: DataFrame, total: int, n: int, draws_per_range: int = 32) -> list[int]:
    """Up to n - 1 quantiles of a sample in which a record's chance follows its size."""
    if n < 2 or not total:
        return []
    expected = F.col("size") * F.lit(float(draws_per_range) * n / total)
    drawn = keys.where(F.pmod(F.xxhash64("__key", "__sub", F.lit("draw")), F.lit(1 << 30)) < expected * float(1 << 30))
    # A record of more than one expected draw counts as often as it is expected.
    weighted = drawn.select(F.explode(F.array_repeat("__key", F.greatest(F.lit(1), F.round(expected)).cast("int"))).alias("__key"))
    parts = F.from_json(F.lit("[" + ",".join(repr(i / n) for i in range(1, n)) + "]"), "array<double>")
    row = weighted.agg(F.percentile_approx("__key", parts, F.lit(20 * n)).alias("c")).first()
    return sorted(set(row["c"] or []))


def sharded(
    docs: DataFrame,
    shards: int = 24,
    key: str = "doc_id",
    text: str = "text",
    ranges_per_shard: int = 128,
    rows_per_range: int = 500_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns in keep (all but text, if None) with size, text_crc32, shard and slot."""
    keep = [c for c in (keep or docs.columns) if c != text and c.lower() not in OWN]
    body = F.coalesce(F.col(text), F.lit(""))
    base = written(
        docs.select(
            *keep,
            (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.xxhash64(body).alias("__key"),
            F.xxhash64(*[F.col(c).cast("string") for c in dict.fromkeys([key, *keep])], F.lit("sub")).alias("__sub"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "keys",
    )
    whole = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    total, rows = int(whole["b"]), int(whole["n"])
    n = max(shards * ranges_per_shard, -(-rows // rows_per_range))
    cuts = splitters(base, total, n)
    at = interval(longs(cuts), len(cuts), F.col("__key")) if cuts else F.lit(0)
    ranged = base.withColumn("__range", at)

    # Exact sizes; what has more than twice the mean is dealt into pieces by the second hash, then by the row.
    fair = max(1.0, total / n)
    pieces = divided(ranged, ["__range"], "__piece", F.col("__sub"), fair)
    pieces = divided(pieces, ["__range", "__piece"], "__part", F.xxhash64("__row", F.lit("part")), fair)
    at = ["__range", "__piece", "__part"]
    found = sorted((*(r[c] for c in at), int(r["b"]), int(r["n"])) for r in pieces.groupBy(*at).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())

    # Consecutive pieces fill the shards: a piece goes where its middle falls on the line of all bytes.
    place, before, slots = [], 0, [0] * shards
    for *p, b, k in found:
        shard = min(shards - 1, int((before + b / 2) * shards // max(total, 1)))
        place.append((*p, shard, slots[shard]))
        slots[shard] += k
        before += b
    table = small_table(docs.sparkSession, place, "__range int, __piece int, __part int, shard int, __first bigint")
    joined = pieces.join(F.broadcast(table), at)  # as many rows as pieces
    w = Window.partitionBy(*at).orderBy("__key", "__sub", "__row")
    return joined.select(*keep, "size", "text_crc32", "shard", (F.col("__first") + F.row_number().over(w) - 1).cast("long").alias("slot"))


def small_table(spark: SparkSession, rows: list[tuple[int, ...]], schema: str) -> DataFrame:
    """Rows of numbers as a literal of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ': ') for c in schema.split(', '))}>>")))


def divided(rows: DataFrame, at: list[str], name: str, by: Column, fair: float) -> DataFrame:
    """rows with the column name: a number by the hash `by` where rows of one `at` have more than 2 * fair bytes, else 0."""
    sizes = rows.groupBy(*at).agg(F.sum("size").alias("b")).where(F.col("b") > 2 * fair)
    large = [(*(r[c] for c in at), -(-int(r["b"]) // int(fair + 1))) for r in sizes.collect()]  # fewer than half the ranges
    if not large:
        return rows.withColumn(name, F.lit(0))
    table = small_table(rows.sparkSession, large, ", ".join(f"{c} int" for c in at) + ", __n bigint")
    return rows.join(F.broadcast(table), at, "left").withColumn(name, F.pmod(by, F.coalesce("__n", F.lit(1))).cast("int")).drop("__n")


def op10_sampled_splitters(docs: DataFrame) -> DataFrame:
    out = sharded(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
