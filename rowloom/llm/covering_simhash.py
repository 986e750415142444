"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at `radius` or fewer differing bits. Every bit position gets a vector of
radius + 1 bits, and every nonzero vector v of radius + 1 bits a mask: the positions whose vector has
an odd product with v. Up to radius positions span at most radius dimensions, so some v is orthogonal
to all of them and its mask hides all of them: any two fingerprints within the radius agree under one
of the 2 ** (radius + 1) - 1 masks. Nothing is missed, and with vectors dealt evenly each mask keeps
about half of the bits.

Equal fingerprints collapse first, on the map side. Buckets of two or more are compared inside the
bucket, and of the links found only a spanning forest leaves the task. A bucket of more than `limit`
fingerprints is not gathered: each of its members meets the others at the values within one and two
flips of the bits that the mask hides (x and y lie within 3 bits if and only if some value lies within
one flip of x and two of y), which is a grouped minimum and grows in proportion to the bucket. For other
radii one flip and radius - 1 flips are taken. Components come from alternating large and small stars,
each round written to the shared folder.

Near duplicates in the sense of word shingles (similar()) are the components of texts whose sets of shingles
have a Jaccard coefficient of at least `similarity`. Fingerprints alone cannot give them: at 0.8 some ten of 64
bits differ. So the covering masks find the close ones, each confirmed on the sets, and an exact prefix join
finds the rest. In an order that is the same for all, similar sets share one of their first elements. The order
goes by the hash, but shingles that COMMON documents have come late; they are counted over all documents among
those of the lowest LOW of the hashes, where the first elements are. Texts of different components that share a
first element are compared, through hubs where they are many: each round the next few of those that share it are
compared with all others, linked, and leave; what has become one component leaves as well. So a crowd of copies
costs a few comparisons each, and no group is gathered anywhere. The parity of the hashes in each of PARITY classes bounds
from below in how many elements two sets differ; sets are compared only where that leaves them similar.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; a null
id takes part, but never names a component (component_id is null only if no member has an id); repeated
rows get a row each; an empty table gives no rows; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import Scratch, arrow_map, with_fields, written

BITS = 64
CHUNK = 1 << 17
LIMIT = 4096
#: Rows of a join's side up to which it is broadcast, after they were counted.
BROADCAST_ROWS = 100_000
#: The share of the hashes whose shingles are counted, and from how many documents on they are common.
LOW, COMMON = 0.4, 32
#: Of more than COMMON documents that share a shingle, how many are compared with the others in the first round, and times
#: how many in each one after that. Of fewer, all are compared at once.
HUBS, MORE = 1, 4
PARITY = 1024


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space parts


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the shingles, repeats included, in chunks; fewer words are one shingle."""
    if not words:
        return
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[-n:]
    for at in range(0, n, CHUNK):
        cut = map(line.__getitem__, map(slice, starts[at : min(n, at + CHUNK)].tolist(), stops[at : min(n, at + CHUNK)].tolist()))
        yield np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), ">u8")


def majority(chunks: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half the hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text's word shingles, repeats included."""
    return majority(shingle_hashes(words_of(text), width))


def simhash_of_set(words: list[bytes], seed: int = 42) -> int:
    """The fingerprint of the set of words: each counts once."""
    return majority(iter([np.fromiter(map(xxhash.xxh64_intdigest, set(words), repeat(seed)), ">u8")] if words else ()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): fp holds the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64), pa.int64())], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), each, f"`{key}` {kind}, fp bigint")


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The sorted different hashes of the shingles."""
    return np.unique(np.concatenate([c.astype(np.uint64) for c in shingle_hashes(words, width)] or [np.zeros(0, np.uint64)])).view(np.int64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of a set's first elements are enough: of two similar sets one is among both of these."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def shingled(docs: DataFrame, key: str, text: str, width: int, similarity: float) -> DataFrame:
    """(key, one, two, n, fp, bits, low, high) of each text's set of shingles.

    Two hashes of the set, its size, fingerprint and parities, its lowest hashes, and as many others as the first
    elements need.
    """
    bar = np.uint64(int(LOW * 2**64))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, bits, low, high = [], [], [], []
            for t in b.column(1):
                own = shingle_set(words_of(t.as_py()), width).view(np.uint64)
                cut, data = int(np.searchsorted(own, bar)), own.tobytes()
                parts = (own[i : i + CHUNK].astype(">u8") for i in range(0, len(own), CHUNK))
                heads.append((xxhash.xxh64_intdigest(data, 42), xxhash.xxh64_intdigest(data, 7), len(own), majority(parts)))
                odd = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                low.append(own[:cut].view(np.int64))
                high.append(own[cut : max(cut, prefix_length(len(own), similarity))].view(np.int64))
            one, two, n, fp = (pa.array(x.view(np.int64)) for x in np.array(heads, np.uint64).reshape(-1, 4).T.copy())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), one, two, n, fp, *(pa.array(x, longs) for x in (bits, low, high))], [key, "one", "two", "n", "fp", "bits", "low", "high"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), each, f"`{key}` {kind}, one bigint, two bigint, n bigint, fp bigint, bits array<bigint>, low array<bigint>, high array<bigint>")


def shingle_sets(docs: DataFrame, keys: list[str], text: str, width: int) -> DataFrame:
    """keys and `set`: the sorted different hashes of a text's shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(words_of(t.as_py()), width) for t in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(sets, pa.list_(pa.int64()))], [*keys, "set"])

    return arrow_map(docs.select(*keys, text), each, with_fields(docs.select(*keys).schema, set=T.ArrayType(T.LongType())))


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks, one of which hides any choice of up to radius positions."""
    vectors = range(1, 1 << (radius + 1))
    of = [1 + i % len(vectors) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (of[i] & v).bit_count() % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest of its component, member) for the members of components of two or more."""
    if len(prints) == 2:
        a, b = sorted(prints.tolist())
        return [(a, b)] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius else []
    rest, out = np.sort(prints), []
    while len(rest):
        member, front, rest = [rest[:1]], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count((rest ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                member.append(rest[near])
                front.extend(rest[near])
                rest = rest[~near]
        whole = np.concatenate(member)
        out += [(int(whole[0]), int(x)) for x in whole[1:]]
    return out


def links(prints: DataFrame, radius: int = 3, limit: int = LIMIT, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(a, b): edges whose components are those of all links between the different fingerprints in prints(fp)."""
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(keyed.join(sizes, ["t", "k"]), "buckets")
    gathered = shared.where(F.col("n") <= limit).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat, offsets = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            pairs = [p for i in range(len(lists)) for p in forest(flat[offsets[i] : offsets[i + 1]], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    found = arrow_map(gathered, each, "a bigint, b bigint")
    hot = shared.where(F.col("n") > limit)
    if not hot.isEmpty():
        found = found.union(met(hot, masks, radius))
    return found.distinct()


def flips(hidden: int, most: int) -> list[int]:
    """XOR patterns of up to most of the hidden bits, fewest first."""
    at = [1 << i for i in range(BITS) if hidden >> i & 1]
    return [signed(sum(c)) for n in range(most + 1) for c in combinations(at, n)]


def met(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges inside overfull buckets, by values that members reach with few flips."""
    far = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(masks):
        hidden = ~m & (2**64 - 1)
        far = F.when(F.col("t") == t, F.from_json(F.lit(str(flips(hidden, radius - 1))), "array<bigint>")).otherwise(far)
    reach = hot.select("t", "k", "fp", F.explode(far).alias("x")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"), (F.bit_count("x") <= 1).alias("near"))
    hubs = reach.groupBy("t", "v").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null").select("t", "v", "a")
    return reach.join(hubs, ["t", "v"]).where(F.col("a") != F.col("fp")).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))


def components(edges: DataFrame, rounds: int = 60, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, root): the smallest node of its component, for each node of an edge (a, b) but the smallest ones."""
    now = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    for _ in range(rounds):
        # done, if each larger end has one edge and is nowhere the smaller end
        ends = now.select(F.col("b").alias("u"), F.lit(1).alias("large"), F.lit(0).alias("small")).union(now.select("a", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("large").alias("n"), F.max("small").alias("s")).where("n + s > 1 and n > 0").isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points to a smaller node
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(lowest, "u").select(F.col("v").alias("u"), "m").union(lowest.select("u", "m")).where(F.col("u") != F.col("m")).distinct()
        now = keep(stars.select(F.col("m").alias("a"), F.col("u").alias("b")), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key in the document's component."""
    base = written(fingerprints(docs, key, text, width), "prints")
    nodes = written(base.groupBy("fp").agg(F.min(key).alias("__least")), "nodes")
    with Scratch(docs.sparkSession) as keep:
        roots = written(components(links(nodes.select("fp"), radius, limit, keep), keep=keep), "roots")
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "__least", F.coalesce("root", "fp").alias("__root"))
    least = joined.where(F.col("__root").isNotNull()).groupBy("__root").agg(F.min("__least").alias("component_id"))
    named = joined.join(least, "__root").select("fp", "component_id")
    return base.join(named, "fp").select(key, "fp", "component_id")


def _without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """docs without the ids of which ids(key, stays) says so; of repeated rows of one id one stays.

    Rows without an id stay, as nothing can name them.
    """
    gone = ids.where(~F.col("stays")).select(F.col(key).alias("__gone"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    out = docs.join(gone, F.col(key) == F.col("__gone"), "left_anti")
    if ids.where(F.col("n") > 1).limit(1).count():
        out = out.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(out.where(F.col(key).isNull()))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that name their components: one of each group; the columns of docs."""
    found = classes(docs, key, text, **how).where(F.col(key).isNotNull())
    ids = found.groupBy(key).agg((F.min("component_id") == F.col(key)).alias("stays"), F.count("*").alias("n"))
    return _without(docs, key, written(ids, "ids"))


def small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, similarity: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles are similar; the sets of these documents only are made again."""
    pairs = keep(pairs, "pairs")
    ids = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "compared")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("__text")).join(small(ids), "id", "left_semi")
    sets = keep(shingle_sets(texts, ["id"], "__text", width), "sets")
    a, b = (sets.select(F.col("id").alias(n), F.col("set").alias(f"set_{n}")) for n in ("a", "b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = both >= similarity * (F.size("set_a") + F.size("set_b") - both) - 1e-9
    return keep(pairs.join(b, "b").join(a, "a").where(alike).select("a", "b").distinct(), "links")


def first_elements(sets: DataFrame, similarity: float, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, n, bits, first) of sets (id, n, bits, low, high): the first elements in the order that is the same for all."""
    lows = sets.select("id", F.explode("low").alias("x"))
    common = keep(lows.groupBy("x").agg(F.count("*").alias("docs")).where(F.col("docs") >= COMMON).select("x"), "common")
    own = lows.join(small(common), "x", "left_semi").groupBy("id").agg(F.collect_set("x").alias("late"))
    found = sets.join(own, "id", "left").withColumn("late", F.coalesce("late", F.array().cast("array<bigint>")))
    # unsigned order of the hashes, as in low
    late = F.array_intersect("low", "late")
    order = F.when(F.size("late") == 0, F.concat("low", "high")).otherwise(F.concat(F.array_except("low", "late"), late, "high"))
    length = F.when(F.col("n") > 0, F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).otherwise(0).cast("int")
    return found.select("id", "n", "bits", F.slice(order, F.lit(1), length).alias("first"))


def crossing(rows: DataFrame) -> DataFrame:
    """Rows (x, c, ...) of those x that rows of different components c have, with m, how many rows have the x."""
    shared = rows.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("x", "m")
    return rows.join(shared, "x")


def near_parities(a: str, b: str, similarity: float) -> Column:
    """Whether rows a and b have parities that differ in no more places than similar sets of these sizes do in elements."""
    differ = sum(F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(PARITY // 64))
    return differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-9


def met_at(rows: DataFrame, hubs: DataFrame, similarity: float) -> tuple[DataFrame, Column]:
    """rows r and hubs h to be joined, and when such a pair shares an x, is of different components, and may be similar.

    Sizes must be near enough, and what stands after the shared element in both must be enough; that is tested as if
    it were the first one that they share, since another row pair has that one.
    """
    sizes = F.least("r.n", "h.n") >= F.lit(similarity) * F.greatest("r.n", "h.n") - 1e-9
    rest = F.least(F.col("r.n") - F.col("r.pos"), F.col("h.n") - F.col("h.pos"))
    enough = rest >= F.lit(similarity / (1 + similarity)) * (F.col("r.n") + F.col("h.n")) - 1e-9
    return rows.alias("r"), (F.col("r.x") == F.col("h.x")) & (F.col("h.id") < F.col("r.id")) & (F.col("r.c") != F.col("h.c")) & sizes & enough


def candidates(few: DataFrame, crowd: DataFrame, hubs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of `few` rows, and of a row of the crowd and a hub, that share an x and may be similar.

    Sets may only be as far apart as their parities. In the crowd that is tested where rows meet, so that what cannot be
    similar is not written anywhere.
    """
    r, when = met_at(few, few, similarity)
    pairs = r.join(few.alias("h"), when).select(F.col("h.id").alias("a"), F.col("r.id").alias("b")).distinct()
    a, b = (bits.select(F.col("id").alias(n), "n", "bits").alias(f"x{n}") for n in ("a", "b"))
    near = pairs.join(a, "a").join(b, "b").where(near_parities("xa", "xb", similarity)).select("a", "b")
    r, when = met_at(crowd.join(bits.select("id", "bits"), "id"), hubs, similarity)
    others = r.join(hubs.alias("h"), when & near_parities("r", "h", similarity)).select(F.col("h.id").alias("a"), F.col("r.id").alias("b"))
    return near.union(others).distinct()


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """(key, stays, n): which documents stay if one of each group of near duplicates does; n is how many rows have the key.

    Groups are the components of documents whose sets of width-word shingles have a Jaccard coefficient of at least
    `similarity`; the smallest key stays. A key that different texts share stands for all of them.
    """
    named = docs.where(F.col(key).isNotNull())
    with Scratch(docs.sparkSession) as keep:
        base = keep(shingled(named, key, text, width, similarity), "shingles")
        nodes = keep(base.groupBy("one", "two").agg(F.min(key).alias("id"), F.min("fp").alias("fp")), "nodes")
        follow = base.select(key).join(nodes.select(F.col("id").alias(key)), key, "left_anti").distinct()
        sets = base.join(small(follow), key, "left_anti").select(F.col(key).alias("id"), "n", "bits", "low", "high")
        counted = keep(base.groupBy(key).agg(F.count("*").alias("n")), "counted")

        # what the covering masks find
        least = keep(nodes.groupBy("fp").agg(F.min("id").alias("h")), "least")
        near = links(least.select("fp"), radius, limit, keep)
        ends = [least.select(F.col("fp").alias(n), F.col("h").alias(f"h{n}")) for n in ("a", "b")]
        close = near.join(ends[0], "a").join(ends[1], "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
        same = nodes.join(least, "fp").where(F.col("id") != F.col("h")).select(F.col("h").alias("a"), F.col("id").alias("b"))
        edges = confirmed(close.union(same).distinct(), named, key, text, width, similarity, keep)
        comps = components(edges, keep=keep)

        # and what remains
        first = keep(first_elements(sets, similarity, keep), "first")
        bits = first.select("id", "n", "bits")
        keep.drop(base)

        def labelled(rows: DataFrame) -> DataFrame:
            """rows with c, the component of their id."""
            return rows.join(small(comps).withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("root", "id")).drop("root")

        rows = labelled(first).select("id", "n", "c", F.posexplode("first").alias("pos", "x"))
        rows, hubs = keep(crossing(rows), "rows"), HUBS
        while not rows.isEmpty():
            few, crowd = rows.where(F.col("m") <= COMMON), rows.where(F.col("m") > COMMON)
            least_ids = crowd.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("k") <= hubs).drop("k")
            some = keep(least_ids.join(bits.select("id", "bits"), "id"), "hubs")
            found = confirmed(candidates(few, crowd, some, bits, similarity), named, key, text, width, similarity, keep)
            if not found.isEmpty():
                edges = comps.select(F.col("root").alias("a"), F.col("node").alias("b")).union(found)
                comps = components(edges, keep=keep)
            rest = crowd.join(some.select("x", "id"), ["x", "id"], "left_anti").select("id", "n", "pos", "x")
            rows, hubs = keep(crossing(labelled(rest)), "rows"), hubs * MORE
        stays = nodes.select("id").distinct().join(comps, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("__stays"))
        return written(counted.join(stays, F.col(key) == F.col("__stays"), "left").select(key, F.col("__stays").isNotNull().alias("stays"), "n"), "ids")


def without_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that stay if near duplicates go; the columns of docs."""
    return _without(docs, key, similar(docs, key, text, **how))


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_covering_simhash(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", shown(F.col("fp")).alias("fingerprint"), "component_id")
