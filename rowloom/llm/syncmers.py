"""Document fingerprints from closed syncmers over words (DataFrame functions only).

Words are hashed; five consecutive words are a k-mer and two consecutive words inside it an s-mer. A
k-mer is an anchor if its smallest s-mer hash is that of its first or last s-mer. Whether a k-mer is an
anchor depends on its own words alone, so an edit disturbs only anchors that overlap it, and anchors of
two documents can be matched by position. A fingerprint is the sorted set of the 32-bit anchor hashes;
likeness is the Jaccard coefficient of two sets.

A text of one to four words has one anchor, the hash of all its words; a text without words has none.
Two empty sets are alike (1.0).

The next document in ascending key is found without a global window: keys are grouped by their upper
bits, first keys of the groups are linked by a short ladder of ever wider groups (each rung sees at most
4,096 children a group), and each group gets the first document of the group after it as a guest. So
one window a group, over at most 4,096 different keys, sees every neighbour; the texts move once, and
guests once more where a group is a handful of documents (sparse keys).

A key that more than CROWD rows share (the null key, say) is not left to one window: of its rows only the first
and the last take part above, and the rows between are linked among themselves, in the same way, by the hash of
their text; of rows that are equal in all, one takes part and the others follow one another.

Defined results: null text counts as empty; null keys come before all others; rows that share a key are ordered
by a hash of their text, so equal rows are each other's neighbours; a table of one row is its own neighbour; an empty table gives no rows; columns with the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import written
from .line_frequency import let, words_of

K, S = 5, 2
RUNG = 12


def anchor_positions(words: Column, k: int = K, s: int = S) -> Column:
    """array<struct<pos, hash>> of the closed syncmers of an array of words, in text order."""
    inner = k - s + 1

    def pick(h: Column, m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            rest = [F.get(m, i + j) for j in range(1, inner - 1)]
            edge = F.least(x, F.get(m, i + (inner - 1)))
            closed = edge <= F.least(*rest) if len(rest) > 1 else edge <= rest[0]
            return F.when(closed, F.struct(i.alias("pos"), F.hash(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

        return F.filter(F.transform(F.slice(m, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), at), lambda a: a.isNotNull())

    def of(h: Column) -> Column:
        minis = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))
        short = F.when(F.size(h) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.hash(h).alias("hash")))).otherwise(F.array().cast("array<struct<pos:int,hash:int>>"))
        return F.when(F.size(h) >= k, let(minis, lambda m: pick(h, m))).otherwise(short)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def anchors(docs: DataFrame, text: str = "text", **kind) -> DataFrame:
    """docs with a column `anchors`: where each anchor starts (in words) and its hash."""
    return docs.withColumn("anchors", anchor_positions(words_of(F.coalesce(F.col(text), F.lit(""))), **kind))


def fingerprint(text: Column, **kind) -> Column:
    """Sorted set of anchor hashes of a text that is not null."""
    return F.sort_array(F.array_distinct(F.transform(anchor_positions(words_of(text), **kind), lambda a: a["hash"])))


def likeness(a: Column, b: Column) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def shown(marks: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def group_of(key: Column, rung: int = RUNG) -> Column:
    return F.coalesce(F.shiftright(key, rung), F.lit(-(1 << 62)))


def next_groups(level: DataFrame) -> DataFrame:
    """(g, after): for each of the different groups g the next one; the last has null."""
    # Rung r links children that share their upper bits; what it cannot see is the last child's successor,
    # which is the first child under the next parent, known one rung up.
    rungs = []
    for r in range(4):
        up = F.shiftright("g", RUNG)
        w = Window.partitionBy("p").orderBy("g")
        firsts = level.groupBy(up.alias("p")).agg(F.min("g").alias("first"))
        rungs.append((level.withColumn("p", up).withColumn("after", F.lead("g").over(w)), firsts))
        level = firsts.select(F.col("p").alias("g"))
    top = level.withColumn("after", F.lead("g").over(Window.partitionBy(F.lit(0)).orderBy("g")))  # at most 2 ** 4 rows
    known = top
    for rung, firsts in reversed(rungs):
        up = known.where(F.col("after").isNotNull()).select(F.col("g").alias("__p"), F.col("after").alias("__q"))
        nexts = up.join(firsts.select(F.col("p").alias("__q"), F.col("first").alias("__f")), "__q").select("__p", "__f")
        known = rung.join(nexts, F.col("p") == F.col("__p"), "left").select("g", F.coalesce("after", "__f").alias("after"))
    return known


#: Guests of more bytes than this are joined by a shuffle, not by a broadcast.
BROADCAST_BYTES = 8 << 20


#: Rows of one key from which on they are linked by the hash of their text.
CROWD = 10_000


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None, crowd: int = CROWD) -> DataFrame:
    """docs with next_<c> for each of columns, from the next row in ascending key, then their hash; last: the first.

    derived columns are computed once a row, before the rows are dealt, and get their next_ as well.
    """
    rows = docs.withColumn("__h", F.xxhash64(*columns))
    crowds = rows.groupBy(key).agg(F.count("*").alias("__n"), F.min("__h").alias("__lo"), F.max("__h").alias("__hi")).where(F.col("__n") > crowd)
    crowds = written(crowds.select(F.col(key).alias("__k"), "__lo", "__hi"), "crowds")  # at most a row for each `crowd` rows
    if crowds.isEmpty():
        return linked(rows, [], key, columns, derived).drop("__h")
    r, c = rows.alias("r"), crowds.alias("c")
    each = r.join(c, F.col(f"r.{key}").eqNullSafe(F.col("c.__k")), "left").select("r.*", "__lo", "__hi")
    # equal rows of a crowd: one stands for all, and the others have themselves as the next
    same = [*[x for x in docs.columns], "__h", "__lo", "__hi"]
    inside = written(each.where(F.col("__lo").isNotNull()).groupBy(*same).agg(F.count("*").alias("__copies")), "crowded")
    copies = inside.where(F.col("__copies") > 1).withColumns(derived or {})
    copies = copies.withColumn("__i", F.explode(F.sequence(F.lit(2).cast("long"), F.col("__copies"))))
    copies = copies.withColumns({f"next_{x}": F.col(x) for x in (*columns, *(derived or {}))})
    apart = [F.col(key)]
    within = linked(inside.withColumn("__by", F.col("__h")), apart, "__by", columns, derived).where(F.col("__h") < F.col("__hi")).drop("__by")
    ends = inside.where(F.col("__h").isin(F.col("__lo"), F.col("__hi")))
    outside = each.where(F.col("__lo").isNull()).unionByName(ends, allowMissingColumns=True)
    around = linked(outside, [], key, columns, derived).where(F.col("__lo").isNull() | (F.col("__h") == F.col("__hi")))
    names = [*docs.columns, *(derived or {}), *(f"next_{x}" for x in (*columns, *(derived or {})))]
    return around.select(*names).unionByName(within.select(*names)).unionByName(copies.select(*names))


def linked(docs: DataFrame, apart: list[Column], key: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """with_next for rows whose keys are not crowded, each set of rows that agree in `apart` for itself."""
    order = [F.col(key).asc_nulls_first(), F.col("__h")]
    docs = docs.withColumn("__apart", F.xxhash64(F.lit(0), *apart)) if apart else docs.withColumn("__apart", F.lit(0).cast("long"))
    rung = 52 if apart else RUNG  # hashes fill all 64 bits: 4,096 groups
    group = group_of(F.col(key), rung)
    heads = written(docs.groupBy("__apart", group.alias("__g")).agg(F.min(key).alias("__head")), "heads")
    if apart:
        each = Window.partitionBy("__apart")
        after = F.coalesce(F.lead("__g").over(each.orderBy("__g")), F.min("__g").over(each))
        links = heads.select("__apart", F.col("__g").alias("__host"), after.alias("__g"))
        n = heads.count()
    else:
        ends = heads.agg(F.min("__g").alias("lo"), F.count("*").alias("n")).first()
        chain = next_groups(heads.select(F.col("__g").alias("g")))
        links, n = chain.select(F.lit(0).cast("long").alias("__apart"), F.col("g").alias("__host"), F.coalesce("after", F.lit(ends["lo"]).cast("long")).alias("__g")), ends["n"]
    guests = heads.join(links, ["__apart", "__g"]).select("__apart", "__head", "__host")
    if n * 32 <= BROADCAST_BYTES:
        guests = F.broadcast(guests)
    d, g = docs.alias("d"), guests.alias("g")
    first = Window.partitionBy("__apart", "__host").orderBy(*order)
    visiting = (
        d.join(g, (F.col("d.__apart") == F.col("g.__apart")) & F.col(f"d.{key}").eqNullSafe(F.col("g.__head"))).select("d.*", "g.__host")
        .withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")
    )
    own = docs.withColumn("__host", group).withColumn("__guest", F.lit(0))
    both = own.unionByName(visiting.withColumn("__guest", F.lit(1))).withColumns(derived or {})
    w = Window.partitionBy("__apart", "__host").orderBy(F.col("__guest"), *order)
    for c in [*columns, *(derived or {})]:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(F.col("__guest") == 0).drop("__host", "__guest", "__apart")


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op4_closed_syncmers(docs: DataFrame) -> DataFrame:
    """The contract's columns; n_anchors besides."""
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    near = with_next(body, "doc_id", ["text"], {"marks": fingerprint(F.col("text"))})
    texts = near.select("doc_id", "text", "marks", "next_marks", edited(F.col("text"), F.col("next_text")).alias("__edited"))
    marks = texts.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("__edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("marks").alias("__a"),
        fingerprint(F.col("__edited")).alias("__e"),
        F.col("next_marks").alias("__x"),
    )
    return marks.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("__a")).alias("fingerprint"),
        shown(F.col("__e")).alias("edited_fingerprint"),
        likeness(F.col("__a"), F.col("__e")).alias("near_edited"),
        likeness(F.col("__a"), F.col("__x")).alias("near_next"),
        F.size("__a").cast("long").alias("n_anchors"),
    )
