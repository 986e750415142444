"""URL filters by association rules.

Given rules (a host, a path and a verdict) judge the URLs that they fit and thereby label them. Spark's
FP-growth mines the sets of URL tokens that occur often together with a label; a set becomes a rule if
its support is high enough, its confidence over the labelled URLs that hold it is high enough, and at
least half of all URLs that hold it are labelled, so that rules are not drawn from an odd corner. URLs that no given rule
fits are judged by the mined rules, found through an inverted index from a token to the rules that hold
it; of those that fit, the one with the highest confidence, then support, then the smallest tokens
wins. Where none fits, the URL is allowed.

Scale: FP-growth enumerates frequent sets of every size, and a path of 30 tokens that a tenth of all URLs share
has a billion of them. So tokens below the support are left out first, and a URL of more than LONG tokens that
remain is mined as several transactions: its tokens are cut into groups, and each `width` of the groups are a
transaction, so that any set of up to `width` tokens is whole in one. The sets found are candidates, none is
missing, and all are counted over the URLs themselves. A URL of m frequent tokens makes (m / LONG * width) **
width / 6 transactions. Frequent tokens number at most (tokens of a URL / support), frequent sets of up to
`width` tokens that ** width, whatever the rows; that bounds what comes to the driver and goes out again.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is
allowed; a URL that several given rules fit takes the longest; repeated rows count as often as they
occur and get a row each; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import arrow_map, with_fields, written

BLOCK, ALLOW = "block", "allow"
#: The given rules and their verdicts.
RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}
LABEL = "verdict:"
SUPPORT, CONFIDENCE, WIDTH, KNOWN = 0.005, 0.9, 3, 0.5
#: Tokens of a transaction.
LONG = 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Host labels, words of the path, and names of the query; numbers are one token each kind."""

    def of(kind: str, text: Column) -> Column:
        parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}-]+", -1), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(kind), F.when(x.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(x)))

    query = F.transform(F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&", -1), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.split(x, "=", -1)[0]))
    return F.array_distinct(F.concat(of("host:", host), of("path:", path), query))


class Given:
    """Given rules by host."""

    def __init__(self, rules: dict[str, str]):
        self.verdicts = rules
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host[host].append((slash + path, rule))

        self.lengths = sorted({len(h) for h in self.by_host})

    def fit(self, host: str, path: str) -> str | None:
        found = None
        for n in self.lengths:
            if n > len(host):
                break
            if n == len(host) or n and host[-n - 1] == ".":
                for start, rule in self.by_host.get(host[len(host) - n :], ()):
                    if path.startswith(start) and (found is None or (len(rule), rule) > (len(found), found)):
                        found = rule
        return found


@dataclass(frozen=True, order=True)
class Mined:
    """Ordered best first."""

    less_confidence: float
    less_support: float
    tokens: tuple[str, ...]
    verdict: str


class Index:
    """Mined rules by token."""

    def __init__(self, rules: list[Mined]):
        self.rules = sorted(rules)
        self.at: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            for t in r.tokens:
                self.at[t].append(i)

    def fitting(self, found: list[str]) -> list[int]:
        """The rules that a URL of these tokens fits."""
        hits: dict[int, int] = defaultdict(int)
        for t in found:
            for i in self.at.get(t, ()):
                hits[i] += 1
        return [i for i, n in hits.items() if n == len(self.rules[i].tokens)]

    def best(self, found: list[str]) -> Mined | None:
        full = self.fitting(found)
        return self.rules[min(full)] if full else None


def prepared(pages: DataFrame, keys: list[str], url: str, rules: dict[str, str]) -> DataFrame:
    """keys, host, path, tokens, and the given rule that fits."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(*keys, F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rows = rows.select(*keys, "host", "path", tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Given(rules)
        for b in batches:
            found = [given.fit(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "rule"])

    return arrow_map(rows, each, with_fields(rows.schema, rule=T.StringType()))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, width: int = WIDTH, known: float = KNOWN) -> list[Mined]:
    """Rules from rows of tokens and a verdict (null: not labelled): sets of two tokens or more."""
    total = labelled.count()
    if not total:
        return []
    least = max(1, math.ceil(support * total - 1e-9))
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    often = [r["t"] for r in counts.collect()]  # at most (tokens of a URL / support)
    kept = F.sort_array(F.array_intersect("tokens", F.from_json(F.lit(json.dumps(often)), "array<string>")))
    rows = labelled.select(kept.alias("tokens"), "verdict").where(F.size("tokens") >= 2)
    parts = written(arrow_map(rows, lambda batches: transactions(batches, width), "items array<string>"), "transactions")
    n = parts.count()
    if not n:
        return []
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(parts).freqItemsets
    sign = F.get(F.filter("items", lambda x: x.startswith(LABEL)), F.lit(0))
    sets = frequent.select(F.sort_array(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("set"), sign.alias("sign"))
    found = sets.where(F.col("sign").isNotNull() & F.size("set").between(2, width)).select("set").distinct().collect()
    candidates = Index([Mined(0.0, 0.0, tuple(r["set"]), "") for r in found])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, str | None]] = Counter()
        for b in batches:
            for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((i, v) for i in candidates.fitting(t))
        columns = [[i for i, _ in held], [v for _, v in held], list(held.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["i", "v", "n"])

    by: dict[int, dict[str | None, int]] = defaultdict(dict)
    for r in arrow_map(rows, counted, "i int, v string, n bigint").groupBy("i", "v").agg(F.sum("n").alias("n")).collect():
        by[r["i"]][r["v"]] = r["n"]
    out = []
    for i, held in by.items():
        labels = {v: k for v, k in held.items() if v is not None}
        for v, k in labels.items():
            if k >= least and k >= confidence * sum(labels.values()) and sum(labels.values()) >= known * sum(held.values()):
                out.append(Mined(-k / sum(labels.values()), -k / total, candidates.rules[i].tokens, v))
    return sorted(out)


def transactions(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of rows (tokens, verdict), the tokens and marks of the verdict as transactions of at most LONG tokens, or width."""
    size = max(1, LONG // width)
    for b in batches:
        out = []
        for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            marks = [LABEL + v] if v is not None else []
            groups = [t[i : i + size] for i in range(0, len(t), size)]
            cut = [groups] if len(t) <= LONG else combinations(groups, width)
            out += [[*chain.from_iterable(some), *marks] for some in cut]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["items"])


def judged(pages: DataFrame, keys: list[str], url: str = "url", rules: dict[str, str] | None = None, labels: DataFrame | None = None, **mining) -> DataFrame:
    """keys, host, path, rule, verdict, and the tokens and confidence of the mined rule that decided.

    labels (tokens, verdict) replaces the labels that the given rules make.
    """
    given = RULES if rules is None else rules
    rows = written(prepared(pages, keys, url, given), "urls")
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in given.items()]) if given else F.lit(None).cast("string")
    found = mined(rows.select("tokens", verdict.alias("verdict")) if labels is None else labels, **mining)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(found)
        for b in batches:
            best = [None if r else index.best(t) for r, t in zip(b.column("rule").to_pylist(), b.column("tokens").to_pylist(), strict=True)]
            verdicts = [given[r] if r else m.verdict if m else ALLOW for r, m in zip(b.column("rule").to_pylist(), best, strict=True)]
            extra = [pa.array(verdicts, pa.string()), pa.array([m and ",".join(m.tokens) for m in best], pa.string()), pa.array([m and -m.less_confidence for m in best], pa.float64())]
            names = [*keys, "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *extra], [*names, "verdict", "mined_rule", "confidence"])

    schema = with_fields(rows.select(*keys, "host", "path", "rule").schema, verdict=T.StringType(), mined_rule=T.StringType(), confidence=T.DoubleType())
    return arrow_map(rows, each, schema)


def op6_url_rules(pages: DataFrame) -> DataFrame:
    return judged(pages, ["page_id"]).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
