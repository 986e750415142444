"""Token ids as compressed binary shards: Re-Pair grammars with random access.

Texts are dealt by ranges of their key, sorted, encoded, and packed into blocks of about a million ids
(a longer document is a block of its own). In each block the most frequent pairs of neighbouring ids are
replaced by new symbols, level by level of frequency, until no pair occurs four times. A block stores its rules, the
expansion length of every rule, the sequence, checkpoints of the id position at every 256th symbol, and
the key and id range of each document; so any range of ids is decoded from the checkpoint before it.

Block layout, little-endian: b"RPG2"; u32 base, rules, symbols, documents; u64 ids; pairs[rules][2] and, after
u32 lengths[rules], symbols, both in as few bits as base + rules need and padded to a byte; u64 checkpoints[ceil(symbols / 256)];
i64 keys[documents]; u8 has_key[documents]; u64 starts[documents + 1], ids before each document.

Blocks are rows of a Parquet table, so that the writer's commit protocol holds: an attempt that dies, or
runs twice, leaves nothing behind, on any store that Spark writes to.

Scale: one shuffle of the texts by key range; a task holds one block. Positions over the whole corpus come
from the totals of shards, as many as there are partitions.

Defined results: null text is empty, and a document always has at least its end id; null keys come first;
rows that share a key are ordered by a hash of their text, so that many of them are split over tasks, equal ones
too (which of equal rows comes first makes no difference); an empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import arrow_map, new_path

MAGIC = b"RPG2"
BLOCK = 1 << 20
EVERY = 256
END = 2
#: A pair is replaced as long as it occurs so often in its block: a rule takes about 8 bytes, an occurrence 2.
LEAST = 4
#: A level takes the pairs that occur at least one STEP-th as often as those of the level before.
STEP = 8
BUCKETS = 20
#: Parts of texts whose ids a worker remembers in a generation; the one before it is kept as well.
GENERATION = 690_000

#: The tokenizer's pattern over letters below U+0180, for which its normalizer is str.lower.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
WORDS = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+"
#: Of these, a word of letters and what follows it are always apart.
MARKS = string.punctuation
#: A text with any other character goes through the library as a whole. Those that split() takes for white
#: space are looked for in the text, others in its parts.
OTHER = "[^!-~¡-ſ]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r")
#: Characters that become others in lower case which would pass.
RAISED = "\u0130\u1e9e\u212a\u212b"


class Foreign(Exception):
    """A text that goes through the library as a whole."""


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """Ids, as u32 bytes, of what stands between white space, made on first use.

    The tokenizer drops white space and encodes words one by one, so the ids of a text are those of its
    parts in a row; each word goes through the library's model.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.path, own = path, Tokenizer.from_file(path)
        self.model = own.model
        if hasattr(self.model, "_resize_cache"):  # words are remembered here, so the model need not
            self.model._resize_cache(0)
        self.words, self.other = re.compile(WORDS).findall, re.compile(OTHER).search
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in c.encode()) for c in map(chr, range(0x180))}.__getitem__
        #: Texts that quote an added token, in any case, go through the library as a whole as well.
        self.added = [t.content.lower() for t in own.get_added_tokens_decoder().values()]
        self.begins = {t[0] for t in self.added}
        self.old: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The library's own way, for whole texts; made when the first of them comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, part: str) -> bytes:
        data = self.old.get(part)
        if data is None:
            word = part.rstrip(MARKS)
            if len(word) < len(part) and word.isalpha():  # a word, then one run of marks
                data = self[word] + self[part[len(word) :]]
            elif part.isascii() and part.isalpha():
                data = self.encoded(part)
            elif self.other(part):
                raise Foreign
            elif part.isalpha():
                data = self.encoded("".join(map(self.letters, part)))
            else:
                words = self.words(part)
                if len(words) != 1 or words[0] != part:
                    data = b"".join(map(self.__getitem__, words))
                else:
                    data = self.encoded("".join(map(self.letters, part)))
        if len(part) <= 64:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[part] = data
        return data

    def encoded(self, letters: str) -> bytes:
        """The ids of one word, given as the letters of its bytes."""
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, then END."""
        text = text or ""
        lower = text.lower()
        try:
            if any(c in lower for c in self.begins) and any(t in lower for t in self.added) or any(c in lower for c in SPACES) or not text.isascii() and any(c in text for c in RAISED):
                raise Foreign
            return np.frombuffer(b"".join(map(self.__getitem__, lower.split())) + struct.pack("<I", END), "<u4")
        except Foreign:
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], np.uint32)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def overlapping(at: np.ndarray, after: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Which of the places `at` are every second pair in a run of one symbol, and so overlap the pair before.

    after: the place after each of them; alike: whether both have the same symbol.
    """
    out = np.zeros(len(at), bool)
    some = np.flatnonzero(alike)
    if len(some):
        order = np.arange(len(some))
        first = np.ones(len(some), bool)
        first[1:] = after[some[:-1]] != at[some[1:]]
        out[some[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 1]] = True
    return out


def grammar(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """(base, rules as pairs, sequence): symbols from base on stand for their rule's pair.

    Levels of frequency go down by STEP to least. Pairs of a level are replaced round by round, also those that
    come up on the way, until none is as frequent. Counts of pairs only fall, but for pairs with a new symbol; so a
    round looks at the places that were as frequent before and at the neighbours of new symbols alone. Within a
    level, places that are gone are stepped over; what remains moves together at its end.
    """
    base, n_rules = int(ids.max(initial=0)) + 1, 0
    seq, rules = ids.astype(np.uint32), []
    level = None
    while len(seq) > 1 and level != least:
        n = len(seq)
        bucket = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS)
        full = np.bincount(bucket, minlength=1 << BUCKETS)
        level = max(least, (int(full.max()) if level is None else level) // STEP)
        at = np.flatnonzero((full >= level)[bucket]).astype(np.int32)
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        stay, again = np.ones(n, bool), np.zeros(n + 1, bool)
        counted = True  # the first round's places have just been picked by their buckets
        while len(at):
            after = following[at]
            left, right = seq[at], seq[after]
            second = overlapping(at, after, left == right)
            later = at[second]
            keep = ~second
            if len(at) > 1 << 14 and not counted:  # most new pairs are rare; those in buckets that are not full need no sorting
                bucket = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS)
                bucket[second] = 0
                keep &= (np.bincount(bucket, minlength=1 << BUCKETS) >= level)[bucket]
            counted = False
            at, after, left, right = (x[keep] for x in (at, after, left, right))
            pairs, symbol, count = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_inverse=True, return_counts=True)
            often = (count >= level)[symbol]
            at, after, symbol = at[often], after[often], symbol[often]
            # of places that overlap the more frequent pair's is free, so all of the most frequent pair's are
            mine, touch = count[symbol] << 32 | symbol, after[:-1] == at[1:]
            free = np.ones(len(at), bool)
            free[1:] &= ~touch | (mine[1:] > mine[:-1])
            free[:-1] &= ~touch | (mine[:-1] > mine[1:])
            worth = np.bincount(symbol[free], minlength=len(pairs)) >= least
            free &= worth[symbol]
            places, gone = at[free], after[free]
            if not len(places):
                break
            names = np.zeros(len(pairs), np.uint32)
            used = np.flatnonzero(worth)
            names[used] = base + n_rules + np.arange(len(used))
            rules.append(np.stack((pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32))
            n_rules += len(used)
            seq[places] = names[symbol[free]]
            stay[gone] = False
            following[places] = following[gone]
            before[following[places]] = places
            # before[n] and again[n] belong to the place after the last one; so does index -1
            again[at] = again[later] = again[places] = again[before[places]] = True
            again[gone] = again[n] = False
            at = np.flatnonzero(again).astype(np.int32)
            again[at] = False
            at = at[following[at] < n]
        seq = seq[stay]
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq


def rule_lengths(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every rule: how many ids it stands for, and how deep it is."""
    lengths = np.ones(base + len(rules), np.int64)
    depths = np.where(np.arange(base + len(rules)) < base, 0, -1)  # -1: not known yet
    todo, depth = np.arange(len(rules)), 0
    while len(todo):
        depth += 1
        parts = rules[todo]
        ready = (depths[parts] >= 0).all(axis=1)
        if not ready.any():
            raise ValueError("a rule of the block stands for itself")
        now = base + todo[ready]
        lengths[now] = lengths[parts[ready]].sum(axis=1)
        depths[now] = depth
        todo = todo[~ready]
    return lengths[base:], depths[base:]


def expansions(base: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol: its length, where its ids start in a table, and the table."""
    own, depths = rule_lengths(base, rules)
    lengths = np.concatenate((np.ones(base, np.int64), own))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    table = np.zeros(int(lengths.sum()), np.uint32)
    table[:base] = np.arange(base, dtype=np.uint32)
    for depth in range(1, int(depths.max(initial=0)) + 1):
        some = np.flatnonzero(depths == depth)
        to = starts[base + some]
        for child in rules[some].T:
            n = lengths[child]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            table[np.repeat(to, n) + step] = table[np.repeat(starts[child], n) + step]
            to = to + n
    return lengths, starts, table


def _cells(width: int) -> Iterator[tuple[int, int, int]]:
    """Eight symbols of width bits fill width bytes: (symbol, byte, bits of the symbol that lie below the byte)."""
    for i in range(8):
        for byte in range(i * width // 8, (i * width + width + 7) // 8):
            yield i, byte, byte * 8 - i * width


def to_bits(seq: np.ndarray, width: int) -> bytes:
    """Symbols in width bits each, the lowest first."""
    n = seq.size
    rows = np.zeros(-(-n // 8) * 8, np.uint32)
    rows[:n] = seq.ravel()
    rows = np.ascontiguousarray(rows.reshape(-1, 8).T)
    out = np.zeros((width, rows.shape[1]), np.uint8)
    for i, byte, below in _cells(width):
        out[byte] |= (rows[i] >> np.uint32(below) if below >= 0 else rows[i] << np.uint32(-below)).astype(np.uint8)
    return np.ascontiguousarray(out.T).tobytes()[: -(-n * width // 8)]


def from_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = np.zeros(-(-n // 8) * width, np.uint8)
    rows[: len(data)] = data
    rows = np.ascontiguousarray(rows.reshape(-1, width).T) if width else np.zeros((0, -(-n // 8)), np.uint8)
    out = np.zeros((8, -(-n // 8)), np.uint32)
    for i, byte, below in _cells(width):
        part = rows[byte].astype(np.uint32)
        out[i] |= part << np.uint32(below) if below >= 0 else part >> np.uint32(-below)
    out &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(out.T).ravel()[:n]


def expand(seq: np.ndarray, lengths: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = lengths[seq]
    ends = np.cumsum(n)
    return table[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[seq] - (ends - n), n)]


def pack(keys: list[int | None], docs: list[np.ndarray], least: int = LEAST) -> bytes:
    """A block of documents."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    base, rules, seq = grammar(ids, least)
    lengths = np.concatenate((np.ones(base, np.int64), rule_lengths(base, rules)[0]))
    before = np.cumsum(lengths[seq]) - lengths[seq]
    width = (base + len(rules) - 1).bit_length()
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype("<u8")
    return b"".join(
        (
            MAGIC,
            struct.pack("<IIIIQ", base, len(rules), len(seq), len(docs), len(ids)),
            to_bits(rules, width),
            lengths[base:].astype("<u4").tobytes(),
            to_bits(seq, width),
            before[::EVERY].astype("<u8").tobytes(),
            np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
            np.array([k is not None for k in keys], "u1").tobytes(),
            starts.tobytes(),
        )
    )


class Block:
    """A packed block; `ids(start, stop)` decodes a range without what lies before its checkpoint."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.base, n_rules, n, docs, self.n_ids = struct.unpack_from("<IIIIQ", data, 4)
        at = 4 + struct.calcsize("<IIIIQ")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        width = (self.base + n_rules - 1).bit_length()
        self.rules = from_bits(take("u1", -(-2 * n_rules * width // 8)), width, 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        self.seq = from_bits(take("u1", -(-n * width // 8)), width, n)
        self.marks = take("<u8", -(-n // EVERY))
        keys, has = take("<i8", docs).tolist(), take("u1", docs)
        self.keys = [k if h else None for k, h in zip(keys, has, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.lengths, self.first, self.table = expansions(self.base, self.rules)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        mark = int(np.searchsorted(self.marks, start, "right")) - 1
        end = int(np.searchsorted(self.marks, stop, "left")) * EVERY
        offset = int(self.marks[mark])
        return expand(self.seq[mark * EVERY : end], self.lengths, self.first, self.table)[start - offset : stop - offset]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, shards: int | None = None, block: int = BLOCK) -> None:
    """Write the ids of docs, in ascending key, as a table of blocks: shard, block, start (in the shard), n_ids, data."""
    where = tokenizer or default_tokenizer()
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = word_ids(where), TaskContext.get().partitionId()
        keys, held, size, start, number = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (number, pa.int32()), (start, pa.int64()), (size, pa.int64()), (pack(keys, held), pa.binary()))], ["shard", "block", "start", "n_ids", "data"])

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), map(words.ids, b.column(1).to_pylist()), strict=True):
                if held and size + len(ids) > block:
                    yield row()
                    keys, held, size, start, number = [], [], 0, start + size, number + 1
                keys.append(k)
                held.append(ids)
                size += len(ids)
        if held:
            yield row()

    # rows of one key are dealt and ordered by a hash of their text; rows that are equal, by chance
    rows = docs.select(F.col(key).cast("long").alias("__k"), F.col(text).alias("__t"), F.xxhash64(text).alias("__h"), F.rand(1).alias("__r"))
    order = [F.col("__k").asc_nulls_first(), F.col("__h"), F.col("__r")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("__k", "__t")
    arrow_map(dealt, each, "shard int, block int, start bigint, n_ids bigint, data binary").write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the table; start counts from the first shard on."""
    table = spark.read.parquet(path)
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    bases = totals.select(F.col("shard").alias("__shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = Block(data)
                ids, at = x.ids().astype("<u4"), x.starts
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                columns = [pa.array([shard] * len(crcs), pa.int32()), pa.array(x.keys, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["__s", key, "__at", "n_tokens", "ids_crc32"])

    rows = arrow_map(table.select("shard", "start", "data"), each, f"__s int, `{key}` bigint, __at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(bases), F.col("__s") == F.col("__shard")).select(key, (F.col("__base") + F.col("__at")).alias("start"), "n_tokens", "ids_crc32")


def op7_repair_codec(docs: DataFrame) -> DataFrame:
    path = new_path(docs.sparkSession, "ids")
    write(docs, path)
    return read(docs.sparkSession, path)
