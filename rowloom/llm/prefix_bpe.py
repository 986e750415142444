"""Byte-level BPE by dynamic programming over prefixes.

A token sequence is what BPE makes of its bytes if and only if each two neighbours are: two tokens are
compatible if no merge across their border comes due before the merges that built them. Hence every
prefix of a byte string has exactly one valid last token, and its encoding is that token after the
encoding of what remains. A table holds the last token of each prefix; appending bytes extends the
table, and an edit recomputes it only until the old entries hold again for as long as a token can be.

Texts are cut by the vocabulary's pattern and each match is encoded on its own, as public libraries do;
a match that is a token as a whole is that token.

Each Python worker remembers encoded matches in two generations and the borders of tokens in one table, all
of bounded size, some 60 MB beside the vocabulary, and gives them back when a task ends. A task streams over its rows, and over the matches of a text.

Defined results: null text is the empty text, which has no ids; ids of any text decode to its bytes
exactly, whatever its length; repeated rows get equal results; an empty table gives no rows; columns
with the names of result columns are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._store import arrow_map, own_columns, with_fields

#: Encoded matches in a generation. When it is full it becomes the old one, from which matches that occur again
#: are taken over, and the old one goes.
GENERATION = 80_000
#: Borders of tokens that one worker remembers; beyond it the table starts anew.
BORDERS = 200_000
#: Characters of texts that are encoded together, and matches of a longer text that are encoded at a time.
AT_ONCE = 1 << 20
MATCHES = 1 << 16


class Vocabulary:
    """Ranks of byte strings; a rank is the token's id and the order of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: the two tokens that a token is merged from; none for single bytes and for tokens that merging never makes
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: set[int] = set()
        self._fits: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.reachable.add(rank)
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if a < rank and b < rank and a in self.reachable and b in self.reachable and self._border(a, b, rank):
                    self.parts[rank] = (a, b)
                    self.reachable.add(rank)
                    break
        self.usable = {b: i for b, i in ranks.items() if i in self.reachable}
        #: every ending of a usable token, with the token's id or -1
        self.tails = {b[n:]: -1 for b in self.usable for n in range(1, len(b))} | self.usable
        self._fits.clear()

    def _border(self, a: int, b: int, below: int) -> bool:
        """Whether tokens a, b stay apart under merges of rank less than below.

        Undo the latest merge on either side again and again; between undoing steps the two pieces at the
        border stand next to each other until the earlier of the merges that take them up. Of equal merges
        the left one goes first.
        """
        a_until, b_until = below, below  # a is taken up by merge a_until, b by b_until
        while True:
            across = self.ranks.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < a_until and (across <= b_until if b_until < below else across < below):
                return False
            a_parts, b_parts = self.parts.get(a), self.parts.get(b)
            if a_parts and (a > b or not b_parts):
                a, a_until = a_parts[1], a
                b_until = min(b_until, a_until)
            elif b_parts:
                b, b_until = b_parts[0], b
                a_until = min(a_until, b_until + 1)
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding."""
        at = a << 32 | b
        found = self._fits.get(at)
        if found is None:
            if len(self._fits) >= BORDERS:
                self._fits.clear()
            found = self._fits[at] = self._border(a, b, 1 << 31)
        return found


class Prefixes:
    """The valid last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self) -> None:
        """The last tokens of prefixes that have none yet; of each, tokens are tried from short to long."""
        data, last = self.data, self.last
        tails, fits, known = self.vocabulary.tails.get, self.vocabulary.fits, self.vocabulary._fits.get
        for end in range(len(last), len(data) + 1):
            found = -1
            for start in range(end - 1, -1, -1):
                token = tails(data[start:end], -2)
                if token < 0:
                    if token == -2:
                        break
                elif not start:
                    found = token
                else:
                    fit = known(last[start] << 32 | token)
                    if fits(last[start], token) if fit is None else fit:
                        found = token
                        break
            if found < 0:
                raise ValueError(f"byte {data[end - 1]:#x} is not in the vocabulary")
            last.append(found)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend()

    def change_to(self, data: bytes) -> None:
        """Other bytes; what holds of the table for a common beginning stays."""
        same, old = 0, self.data
        for x, y in zip(old, data, strict=False):
            if x != y:
                break
            same += 1
        self.data = data
        del self.last[same + 1 :]
        self._extend()

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new in the place of bytes start to stop; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        whole, self.last, same = self.data, old[: start + 1], 0
        for end in range(start + 1, len(whole) + 1):
            self.data = whole[:end]
            self._extend()
            before = end - shift
            same = same + 1 if before > stop and old[before] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.data = whole
                self.last += old[before + 1 :]
                return end - start
        self.data = whole
        return len(whole) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Ids of matches of the pattern. New matches are encoded in sorted order, so that each takes over what
    the table of the one before holds for their common beginning."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.own = {i: i for i in self.vocabulary.bytes}  # one object for each id
        self.old: dict[str, tuple[int, ...]] = {}

    def know(self, matches: set[str]) -> None:
        """See to it that the ids of all matches are here."""
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for match in matches.difference(self):
            found = old.get(match)
            if found is None:
                new.append(match)
            else:
                self[match] = found
        table, own, ranks = Prefixes(self.vocabulary), self.own, self.vocabulary.ranks
        for match in sorted(new):
            data = match.encode()
            whole = ranks.get(data)
            if whole is None:
                table.change_to(data)
                self[match] = tuple(own[i] for i in table.ids())
            else:
                self[match] = (own[whole],)

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pattern.findall(t or "") for t in texts]
        self.know(set().union(*split))
        get = self.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of a long text, MATCHES matches at a time."""
        found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, MATCHES)):
            self.know(set(some))
            yield list(chain.from_iterable(map(self.__getitem__, some)))

    def each(self, texts: list[str | None]) -> Iterator[Iterator[list[int]]]:
        """Of each text its ids, in pieces."""
        for run in runs(texts):
            if len(run) == 1:
                yield self.pieces(run[0] or "")
            else:
                yield from ([ids] for ids in self.encode_all(run))

    def forget(self) -> None:
        """Give back what was remembered; the vocabulary stays."""
        self.clear()
        self.old = {}
        self.vocabulary._fits.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text or "")))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about AT_ONCE characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > AT_ONCE:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of docs with `ids`, array<int>, instead of the text."""
    where, cut = default_vocabulary() if path is None else (path, pattern)
    docs = own_columns(docs, ["ids"])
    rest = [c for c in docs.columns if c != text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where, cut)
        for b in batches:
            ids = pa.array([list(chain.from_iterable(x)) for x in e.each(b.column(len(rest)).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], ids], [*rest, "ids"])
        e.forget()

    schema = with_fields(docs.select(*rest).schema, ids=T.ArrayType(T.IntegerType()))
    return arrow_map(docs.select(*rest, text), each, schema)


def decoded(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of rows with the decoded text instead of the ids; bytes that are no UTF-8 are replaced."""
    where, cut = default_vocabulary() if path is None else (path, pattern)
    rows = own_columns(rows, [text]) if text != ids else rows
    rest = [c for c in rows.columns if c != ids]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where, cut)
        for b in batches:
            texts = pa.array([e.decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column(len(rest))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], texts], [*rest, text])

    schema = with_fields(rows.select(*rest).schema, **{text: T.StringType()})
    return arrow_map(rows.select(*rest, ids), each, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): texts are encoded, the ids decoded again."""
    where, cut = default_vocabulary() if path is None else (path, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where, cut)
        shown = {i: str(i) for i in e.vocabulary.bytes}.__getitem__
        for b in batches:
            n, made, back = [], [], []
            for pieces in e.each(b.column(1).to_pylist()):
                size, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()
                for ids in pieces:
                    ids_sum.update((" " * bool(size and ids) + " ".join(map(shown, ids))).encode())
                    text_sum.update(e.decode(ids))
                    size += len(ids)
                n.append(size)
                made.append(ids_sum.hexdigest())
                back.append(text_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), each, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_prefix_bpe(docs: DataFrame) -> DataFrame:
    return digests(docs)
