"""Each operator against a plain version of its definition, on awkward rows and on a driver table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from rowloom.llm import block_distribution, covering_simhash, license_templates, line_frequency, poisson_mix, prefix_bpe, repair_codec, splitters, syncmers, url_rules
from rowloom.llm.queries import queries

from .common import SENTENCE, awkward, by_id, empty, texts

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(params=["awkward", "table"])
def docs(request, spark):
    return awkward(spark) if request.param == "awkward" else documents(spark)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# 1


def test_main_text_of_pages(spark):
    from html import unescape

    def plain(h):
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|br)>", inner)
        return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if b)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = block_distribution.op1_block_distribution(pages.withColumn("text", F.lit("clash"))).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}


PAGES = [
    (None, ""),
    ("", ""),
    ("plain words only", "plain words only"),
    ("<p>Hi</p>", "Hi"),
    ("<article><h1>A</h1><p>B <b>c</b>\n d&amp;e&nbsp;f</p></article>", "A\nB c d&e f"),
    ("<body><div class='menu'><a href=x>One</a></div><div class=content><p>Some text of a page that goes on and on.</p><div class='ad'>Buy things</div><p>End.</p></div><div id=sidebar>Side text</div></body>", "Some text of a page that goes on and on.\nEnd."),
    ("<header><h1>Site</h1><nav>m</nav></header><main><p>One<p>Two<br>three</main><footer>f</footer>", "One\nTwo\nthree"),
    ("<article><p>A</p><form><input><label>Name</label></form><aside>Pull</aside><div class='comments'><p>Nice!</p></div></article>", "A"),
    ("<div class='cookie-notice'>We use cookies</div><article><p>A<script>if (a < b) { x = '</p>' }</script>B</p><style>p{}</style></article>", "AB"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<nav><a>x</a><article><p>Body</p></article>", "Body"),
    ("<div class=top>Welcome to the site, which has a long line of greetings for all of its readers here</div><div class='post-content'><h2>T</h2><p>x</p></div><div>more of the site, and a long line about nothing that is of any use to the readers of it</div>", "T\nx"),
    ("<p title='a > b'>quoted</p><!-- <p>no</p> -->", "quoted"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
]


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert block_distribution.main_text(page[0]) == page[1]


def test_surge_and_dive():
    page = block_distribution.Lines()
    page.text, page.weight, page.marked = ["menu", "", "", "", "a" * 60, "b" * 60, "short", "", "", "", "foot"], [4, 0, 0, 0, 60, 60, 5, 0, 0, 0, 4], [False] * 11
    assert block_distribution.main_lines(page) == ["a" * 60, "b" * 60, "short"]


def test_main_text_without_marks(spark):
    """Surge and dive points alone find the same text where no element marks the article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        plain = re.sub(r"<(/?)article\b", r"<\1div", r.html)
        assert "<article" in r.html and block_distribution.main_text(plain) == block_distribution.main_text(r.html)


LARGE = {
    "tags that do not end": "<a " * 350_000,
    "names that do not end": "<a" * 500_000,
    "nesting": "<div>x" * 170_000,
    "closing tags of nothing": "<div>" * 60_000 + "</b>x" * 140_000,
    "quotes that do not end": "<a b=\"x>' " * 90_000,
    "quoted ends": "<p title='a>b'>x" * 60_000 + "'",
    "comments that do not end": "<!-- x " * 140_000 + "<",
    "headings": "<header><h1>x" * 70_000,
    "menus": "<nav><nav></ul>" * 60_000,
    "one line": "word " * 200_000,
    "lines": "<p>word" * 140_000,
    "links": "<a href=x>y</a>" * 66_000,
}


@pytest.mark.parametrize("name", LARGE)
def test_large_pages_take_time_in_proportion(name):
    import time

    began = time.process_time()
    block_distribution.main_text(LARGE[name])
    assert time.process_time() - began < 8  # a megabyte; a quadratic pass takes minutes


def test_a_marked_teaser_does_not_hide_the_text():
    body = [f"Paragraph {i} of the text that readers came for, which goes on for more than one hundred characters, as main text does." for i in range(5)]
    teaser = "<article><h3>Another story</h3><p>Short.</p></article>"
    page = "<div>" + "".join(f"<p>{p}</p>" for p in body) + "</div>" + teaser
    assert block_distribution.main_text(page).split("\n") == [*body, "Another story", "Short."]
    long = "".join(f"<p>{p}</p>" for p in body * 2)
    assert block_distribution.main_text(f"<article>{long}</article><div>" + "".join(f"<p>{p}</p>" for p in body) + "</div>").split("\n") == body * 2


# 2


def test_poisson_counts(spark):
    rows = documents(spark)
    got = poisson_mix.mixed(rows).collect()
    sizes = Counter()
    bucket = lambda r: r.source if r.source in poisson_mix.WEIGHTS else "*"
    for r in rows.collect():
        sizes[bucket(r)] += len(r.text)
    total, wanted = sum(sizes.values()), sum(poisson_mix.WEIGHTS[b] for b in sizes)
    want = Counter()
    for r in rows.collect():
        rate = poisson_mix.WEIGHTS[bucket(r)] / wanted * total / sizes[bucket(r)]
        u = int(hashlib.md5(f"mix-1|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, term = 0, math.exp(-rate)
        below = term
        while below <= u:
            k += 1
            term *= rate / k
            below += term
        if k:
            want[r.doc_id] = k
    assert Counter(r.doc_id for r in got) == want
    assert all(r.n_copies == want[r.doc_id] for r in got)
    again = poisson_mix.mixed(rows.repartition(7)).collect()
    assert sorted((r.doc_id, r.copy, r.shuffle_key) for r in again) == sorted((r.doc_id, r.copy, r.shuffle_key) for r in got)


def test_mixture_meets_its_weights(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "src0").otherwise("b").alias("source"), F.lit("some text").alias("text"))
    share = poisson_mix.mixed(rows, {"src0": 0.25, "b": 0.75}).groupBy("source").count().collect()
    found = {r["source"]: r["count"] for r in share}
    assert abs(found["src0"] / sum(found.values()) - 0.25) < 0.01
    assert abs(sum(found.values()) / 40_000 - 1) < 0.02


def test_mixture_of_awkward_rows(spark):
    rows = awkward(spark)
    got = poisson_mix.mixed(rows, {"src0": 1.0, "*": 3.0})
    assert got.columns[: len(rows.columns) - 1] == [c for c in rows.columns if c != "copy"]
    counts = Counter(r.doc_id for r in got.collect() if r.doc_id == 0)
    assert counts[0] % 3 == 0  # three equal rows get equal counts
    with pytest.raises(ValueError, match="repetition rate"):
        poisson_mix.poisson_cdf(1000)


def test_high_rates(spark):
    """A source of three documents that is to make up half of the text."""
    for rate in (501.0, 40_000.0):
        first, cdf = poisson_mix.poisson_steps(rate)
        assert all(a <= b for a, b in zip(cdf, cdf[1:])) and cdf[-1] > 1 - 1e-12 and cdf[0] < 1e-15
        mean = first + sum(1 - c for c in cdf)
        assert abs(mean - rate) < 1e-3
    assert poisson_mix.poisson_steps(499.0) == (0, poisson_mix.poisson_cdf(499.0))
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "rare").otherwise("usual").alias("source"), F.lit("some text").alias("text"))
    found = {r["source"]: r["count"] for r in poisson_mix.mixed(rows, {"rare": 0.5, "usual": 0.5}).groupBy("source").count().collect()}
    assert 2800 < found["rare"] < 3200 and 2800 < found["usual"] < 3200


# 3


def test_base_phrases(docs):
    got = by_id(license_templates.op3_license_templates(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "score")
    for i, t in texts(docs).items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        places = [(k, label) for phrase, label in license_templates.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert got[i][:5] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert 0 <= got[i][5] <= 1


def test_templates():
    scan = license_templates.Scanner({"a b": "ab"}, {"T": ["one <<beginOptional>>two <<beginOptional>>deep <<endOptional>><<endOptional>>three <<var;name=x;match=1-3>> end"]})

    def found(t):
        base, own = scan.spans(license_templates.words_of(t))
        return [s[:2] for s in base], [s[:2] for s in own]

    assert found("a b a b") == ([(0, 2), (2, 4)], [])
    assert found("One, three x END") == ([], [(0, 4)])
    assert found("one two deep three x y z end.") == ([], [(0, 8)])
    assert found("one deep three x end") == ([], [])
    assert found("one three end") == ([], [])
    assert found("one three w x y z end") == ([], [])
    assert found("") == ([], [])
    for bad in ("<<beginOptional>>x", "x<<endOptional>>", "<<beginOptional>>x<<endOptional>>"):
        with pytest.raises(ValueError):
            license_templates.Scanner({}, {"T": [bad]})
    assert all(found is not None for found in license_templates.Scanner().notices)
    mit = license_templates.NOTICES["MIT"][2]
    filled = re.sub(r"<<var[^>]*>>", "this software and files", re.sub(r"<<(begin|end)Optional>>", "", mit))
    assert [s[2] for s in license_templates.Scanner().spans(license_templates.words_of("# " + filled.upper()))[1]] == ["MIT"]
    assert not license_templates.Scanner().spans(license_templates.words_of(filled.replace("merge", "fuse")))[1]


# 4


def syncmer_set(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return words, h


def test_edits_and_neighbours(docs):
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = by_id(syncmers.op4_closed_syncmers(docs), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    all_ = texts(docs)
    ids = sorted(all_)

    def marks(fp):
        return {fp[k : k + 8] for k in range(0, len(fp), 8)}

    def like(a, b):
        a, b = marks(a), marks(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for n, i in enumerate(ids):
        t, after = all_[i], ids[(n + 1) % len(ids)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + all_[after][:cut]
        assert got[i][:2] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i][4] == pytest.approx(like(got[i][2], got[i][3])) and got[i][5] == pytest.approx(like(got[i][2], got[after][2]))
        if edited == t:
            assert got[i][2] == got[i][3]
    same = Counter(all_.values())
    for t, n in same.items():
        assert len({got[i][2] for i in ids if all_[i] == t}) == 1


def test_closed_syncmers_are_context_free(spark):
    words = [f"w{i % 37}{'ab'[i % 2]}" for i in range(200)]
    whole = spark.createDataFrame([(" ".join(words),), (" ".join(words[50:150]),)], "text string")
    a, b = (r.anchors for r in syncmers.anchors(whole).collect())
    assert {(p - 50, h) for p, h in a if 50 <= p <= 145} == {(p, h) for p, h in b}
    assert 0.3 < len(a) / 196 < 0.75  # about two in four windows

    # one window by hand: an anchor if the smallest pair hash is at an edge
    row = spark.createDataFrame([(words[:5],)], "w array<string>").select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"), syncmers.anchor_positions(F.col("w")).alias("a"))
    pairs = row.select(F.transform(F.slice("h", 1, 4), lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + 1))).alias("m"), "a").first()
    assert (len(pairs.a) == 1) == (min(pairs.m[0], pairs.m[3]) <= min(pairs.m[1], pairs.m[2]))


def test_next_over_sparse_keys(spark):
    ids = [0, 1, 4095, 4096, 1 << 24, (1 << 24) + 1, 1 << 36, 1 << 50, (1 << 62) + 5, -7, -(1 << 40)]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "k long, t string")
    got = {r.k: r.next_t for r in syncmers.with_next(rows, "k", ["t"]).collect()}
    order = sorted(ids)
    assert got == {i: str(order[(n + 1) % len(order)]) for n, i in enumerate(order)}
    one = spark.createDataFrame([(5, "x")], "k long, t string")
    assert syncmers.with_next(one, "k", ["t"]).first().next_t == "x"
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, "c")], "k long, t string")
    x, y = [r.t for r in ties.where("k = 1").orderBy(F.xxhash64("t")).collect()]
    assert {(r.k, r.t): r.next_t for r in syncmers.with_next(ties, "k", ["t"]).collect()} == {(None, "n"): x, (1, x): y, (1, y): "c", (2, "c"): "n"}


@pytest.mark.parametrize("crowd", [3, 10_000])
def test_next_in_a_crowd(spark, crowd):
    """Many rows without a key, some of them equal, and a crowded key in the middle: one ring of all rows."""
    rows = [(None, f"n{i}") for i in range(40)] + [(None, "equal")] * 30 + [(k, f"k{k}") for k in range(0, 90_000, 4000)] + [(8000, f"m{i % 20}") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    order = [(r.k, r.t) for r in df.orderBy(F.col("k").asc_nulls_first(), F.xxhash64("t")).collect()]
    want = Counter((*order[i], order[(i + 1) % len(order)][1]) for i in range(len(order)))
    assert Counter((r.k, r.t, r.next_t) for r in syncmers.with_next(df, "k", ["t"], crowd=crowd).collect()) == want


# 5


def test_rule_statistics(docs):
    got = by_id(line_frequency.op5_line_frequency(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in texts(docs).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        assert got[i][:6] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and got[i][6])


def boilerplate(spark):
    """A host with a footer on every page, a group of near copies, a page of footers only, and another host."""
    foot, legal = "All  rights reserved by the Host company of the world", "see our terms and our policies for more about all of this"
    rows = [(i, f"page {i} has words of its own such as a{i} b{i} c{i} d{i} e{i} f{i} g{i}\n{foot}\nand {i} goes on with h{i} i{i} j{i} k{i}", "h") for i in range(60)]
    rows += [(100 + i, "\n".join([" ".join(f"copied{k}x{j}" for j in range(9)) for k in range(8)] + [f"edit {i}"]), "h") for i in range(30)]
    rows += [(200, f"{foot.upper()}\n{legal}\n tail of four words", "h"), (201, f"{foot}\n{foot.lower()}", "h")]
    rows += [(300 + i, f"other {i} host with the line as well a{i} b{i} c{i} d{i}\n{foot}", "g") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), foot


def test_boilerplate_goes_and_copies_stay(spark):
    rows, foot = boilerplate(spark)
    out = {r.doc_id: r for r in line_frequency.op5_line_frequency(rows).collect()}
    assert all(out[i].n_removed_lines == 1 and out[i].kept for i in range(60))
    assert all(out[100 + i].n_removed_lines == 0 and out[100 + i].kept for i in range(30))
    assert not out[201].kept and not out[201].base_failed and out[201].n_words_left == 0
    assert all(out[300 + i].n_removed_lines == 0 for i in range(5))
    left = {r.doc_id: r.text for r in line_frequency.filtered(rows, length=None).collect()}
    assert 201 not in left and foot not in left[7] and left[7].startswith("page 7") and left[7].count("\n") == 1
    assert foot in left[300] and left[100] == rows.where("doc_id = 100").first().text


def test_shared_lines_do_not_hide_each_other(spark):
    """Documents count, whatever else they share; exact and near copies of a text count as one."""
    nav, legal = "home news sport weather culture travel", " ".join(f"legal{k}" for k in range(28))
    rows = [(i, f"{nav}\nthe body of page {i} with words such as a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i}\n{legal}", "h") for i in range(200)]
    rows += [(1000 + i, "one text many times " * 8 + "\nand its second line which is here as well", "h") for i in range(100)]
    got = {r.doc_id: r for r in line_frequency.op5_line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed_lines == 2 and got[i].kept and got[i].n_words_left == 20 for i in range(200))
    assert all(got[1000 + i].n_removed_lines == 0 for i in range(100))


def plain_lines(rows, min_docs=20, share=0.1, own=0.2):
    """The lines that go from each text, by counting in plain Python."""
    norm = lambda x: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w)
    by_host = {}
    for t, host in {(t or "", host) for t, host in rows}:
        by_host.setdefault(host, []).append((t, [norm(x) for x in t.split("\n") if norm(x)]))
    gone = {}
    for host, docs in by_host.items():
        limit = max(min_docs, share * len(docs))
        over = {x for x, n in Counter(x for _, ls in docs for x in set(ls)).items() if n >= limit}
        seen = set()
        for t, ls in docs:
            often, n = [x for x in ls if x in over], sum(len(x.split(" ")) for x in ls)
            mine = n - sum(len(x.split(" ")) for x in often)
            seen |= {(x, frozenset(often) if mine < own * n else t) for x in often}
        gone[host] = {x for x, n in Counter(x for x, _ in seen).items() if n >= limit}
    return {(t, host): len(gone[host] & set(ls)) for host, docs in by_host.items() for t, ls in docs}


def test_removed_lines_match_counting(spark):
    rows = boilerplate(spark)[0].union(documents(spark).select("doc_id", "text", "source"))
    want = plain_lines([(r.text, r.source) for r in rows.collect()], 5, 0.02)
    out = line_frequency.judged(rows, min_docs=5, share=0.02).select("doc_id", F.size(F.coalesce("removed", F.array())).alias("n")).collect()
    assert Counter((r.doc_id, r.n) for r in out) == Counter((r.doc_id, want[r.text or "", r.source]) for r in rows.collect())
    assert any(r.n for r in out)


# 6


def given(url):
    head, sep, rest = (url or "").partition("://")
    host = fold(re.split(r"[/?#]", rest)[0]) if sep else ""
    path = re.split(r"[?#]", rest)[0][len(re.split(r"[/?#]", rest)[0]) :] if sep else ""
    fits = []
    for rule in url_rules.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


URLS = ["http://a.b.example.net/en/x?q#f", "https://EXAMPLE.net/EN/", "http://net", "http://net/", "ftp://example.com/de/1", "http://notexample.com/de/1", "http://x.org/fr/", "http://x.org/frx", "nothing", "", None, "http://h?x=/net/", "http://h:80/p#a?b", "://net/x", "http://évil.NET/ü"]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").union(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000", "url"))
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_rules.op6_url_rules(pages).collect():
        host, path, rule = given(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict in ("block", "allow") and (rule is None or r.verdict == url_rules.RULES[rule])


def test_mining_matches_counting(spark):
    rows = [(["a", "b", "c"], "block")] * 30 + [(["a", "b"], "block")] * 10 + [(["a", "d"], "allow")] * 30 + [(["b", "d"], None)] * 5 + [(["c", "d"], None)] * 40 + [(["c", "d"], "block")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    found = {(m.tokens, m.verdict): (-m.less_support, -m.less_confidence) for m in url_rules.mined(df, 0.05, 0.9)}
    assert found == {(("a", "b"), "block"): (40 / 120, 1.0), (("a", "b", "c"), "block"): (0.25, 1.0), (("a", "c"), "block"): (0.25, 1.0), (("b", "c"), "block"): (0.25, 1.0), (("a", "d"), "allow"): (0.25, 1.0)}
    index = url_rules.Index([url_rules.Mined(-1.0, -0.2, ("a", "b"), "block"), url_rules.Mined(-1.0, -0.5, ("b",), "allow")])
    assert index.best(["a", "b"]).verdict == "allow" and index.best(["a"]) is None


def plain_tokens(url, host, path):
    """Host labels, words of the path, and names of the query."""

    def of(kind, text):
        parts = [x for x in re.split(r"[^\w-]+|_", text.lower()) if x]
        return [kind + ("#" if re.fullmatch("[0-9]+", x) else x) for x in parts]

    query = re.search(r"\?([^#]*)", url or "")
    names = [x.split("=")[0] for x in query[1].split("&") if x] if query else []
    return list(dict.fromkeys([*of("host:", host), *of("path:", path), *("query:" + x for x in names)]))


def plain_rules(rows, support=0.005, confidence=0.9, width=3, known=0.5):
    """Rules by counting every set of two tokens up to width."""
    from itertools import combinations

    by = {}
    for t, v in rows:
        for n in range(2, width + 1):
            for x in combinations(sorted(t), n):
                by.setdefault(x, Counter())[v] += 1
    out = []
    for x, held in by.items():
        labelled = sum(n for v, n in held.items() if v)
        out += [(-n / labelled, -n / len(rows), x, v) for v, n in held.items() if v and n >= math.ceil(support * len(rows) - 1e-9) and n >= confidence * labelled and labelled >= known * held.total()]
    return sorted(out)


def test_verdicts_match_counting(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in rows] + [(9000 + i, f"https://ads{i % 3}.promo.shop/buy/now?ref={i}&deal=1") for i in range(60)] + [(9500 + i, f"http://x{i}.promo.net/buy/{i}?deal=2") for i in range(60)]
    judged = [(i, *given(u)) for i, u in rows]
    told = [(plain_tokens(u, h, p), url_rules.RULES[r] if r else None) for (_, u), (_, h, p, r) in zip(rows, judged, strict=True)]
    rules = plain_rules(told)
    want = {i: url_rules.RULES[r] if r else next((v for _, _, x, v in rules if set(x) <= set(t)), "allow") for (i, _, _, r), (t, _) in zip(judged, told, strict=True)}
    got = url_rules.op6_url_rules(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in got} == want
    assert any(r is None and want[i] == "block" for i, _, _, r in judged)


def test_long_common_paths_are_mined(spark):
    """A path of 30 tokens in a tenth of the URLs, and rules of three of its tokens among them."""
    path = [f"t{i:02d}" for i in range(30)]
    rows = [([*path, f"own{i}"], "block" if i % 10 else None) for i in range(40)] + [([f"a{i % 7}", f"b{i % 5}", f"c{i}"], "allow") for i in range(360)]
    found = url_rules.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05)
    want = plain_rules([([x for x in t if not x.startswith(("own", "c"))], v) for t, v in rows], 0.05)
    assert [(m.less_confidence, m.less_support, m.tokens, m.verdict) for m in found] == want and len(want) == 4495


def test_long_hosts():
    import time

    began = time.process_time()
    assert url_rules.Given(url_rules.RULES).fit("a." * 400_000 + "net", "/") == "net/"
    assert url_rules.Given(url_rules.RULES).fit("a." * 400_000 + "net.x", "/") is None
    assert time.process_time() - began < 1


# 7


def test_shards_of_ids(docs):
    tokenizer = repair_codec.word_ids(repair_codec.default_tokenizer()).tokenizer
    docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = by_id(repair_codec.op7_repair_codec(docs), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, t in sorted(texts(docs).items()):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_grammar_and_random_access():
    rng = np.random.default_rng(1)
    for n, high in ((0, 3), (1, 3), (2, 3), (5000, 4), (20_000, 300), (3000, 70_000)):
        ids = rng.integers(0, high, n).astype(np.uint32)
        base, rules, seq = repair_codec.grammar(ids)
        assert (repair_codec.expand(seq, *repair_codec.expansions(base, rules)) == ids).all()
        assert len(seq) <= len(ids)
    runs = np.zeros(999, np.uint32)
    base, rules, seq = repair_codec.grammar(runs)
    assert len(seq) < 20 and (repair_codec.expand(seq, *repair_codec.expansions(base, rules)) == runs).all()
    parts = [rng.integers(0, 9, k).astype(np.uint32) for k in (1, 700, 30, 1, 4000)]
    block = repair_codec.Block(repair_codec.pack([5, None, 7, 8, 9], parts))
    assert block.keys == [5, None, 7, 8, 9] and all((block.document(i) == p).all() for i, p in enumerate(parts))
    whole = np.concatenate(parts)
    for a, b in ((0, 1), (255, 257), (256, 512), (4000, 4732), (10, 10), (4731, 9999)):
        assert (block.ids(a, b) == whole[a:b]).all()


def test_pairs_are_replaced_until_none_occurs_four_times():
    """Passages that occur 5 to 40 times among ids that do not repeat."""
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 300, 200) for _ in range(12)]
    order = np.repeat(np.arange(12), rng.integers(5, 40, 12))
    rng.shuffle(order)
    ids = np.concatenate([np.concatenate((parts[i], [1000 + k])) for k, i in enumerate(order)] + [np.arange(2000, 60_000)]).astype(np.uint32)
    base, rules, seq = repair_codec.grammar(ids)
    assert (repair_codec.expand(seq, *repair_codec.expansions(base, rules)) == ids).all()
    pairs, n = np.unique(np.stack((seq[:-1], seq[1:])), axis=1, return_counts=True)
    assert n[pairs[0] != pairs[1]].max() < 4
    assert len(seq) + len(rules) < 58_000 + 12 * 200 + 3 * len(order)
    block = repair_codec.Block(repair_codec.pack([1], [ids]))
    assert (block.document(0) == ids).all() and (block.ids(700, 70_000) == ids[700:70_000]).all()


def test_words_are_encoded_as_in_texts():
    import random

    words = repair_codec.word_ids(repair_codec.default_tokenizer())
    rng = random.Random(4)
    letters = "abcÀÉßÿĀƀǅɏ'st'll ²½3 45 \t\n\r.!?-ªµº×÷ĳŉǆ«»İ好́"
    for _ in range(800):
        t = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 9, 30])))
        assert words.ids(t)[:-1].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_before_marks_are_encoded_as_in_texts():
    words = repair_codec.word_ids(repair_codec.default_tokenizer())
    marks = ["", ".", "...", "'", "''", "'s", "'s.", "!?***", "$$$", "-", "_", "\\", "<|", ".a", "1.", "²"]
    for word in ("a", "the", "it", "ünïté", "straße", "œuvre", "ª", "7", "", "x" * 70, "é" * 70):
        for m in marks:
            for t in (word + m, m + word, f"{word}{m} {word}{m}{word}"):
                assert words.ids(t)[:-1].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_lengths_of_rules():
    lengths, depths = repair_codec.rule_lengths(3, np.array([[0, 1], [3, 3], [2, 4], [3, 5]], np.uint32))
    assert lengths.tolist() == [2, 4, 5, 7] and depths.tolist() == [1, 2, 3, 4]
    assert [x.tolist() for x in repair_codec.rule_lengths(3, np.zeros((0, 2), np.uint32))] == [[], []]
    for wrong in ([[3, 0]], [[4, 0], [3, 0]]):
        with pytest.raises(ValueError, match="stands for itself"):
            repair_codec.rule_lengths(3, np.array(wrong, np.uint32))


def test_added_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    words = repair_codec.word_ids(repair_codec.default_tokenizer())
    library = Tokenizer.from_file(repair_codec.default_tokenizer())
    for t in ("hello <|endoftext|> world", "<|startoftext|>a", "a<|endoftext|>b c", "<|EndOfText|> x", "<| endoftext |>", "plain words"):
        assert words.ids(t)[:-1].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert words.ids("hello <|endoftext|> world").tolist() == [3306, 49407, 1002, 2]


def test_every_character_is_encoded_as_by_the_library():
    import random

    from tokenizers import Tokenizer

    words = repair_codec.word_ids(repair_codec.default_tokenizer())
    library = Tokenizer.from_file(repair_codec.default_tokenizer())
    rng = random.Random(8)
    found = [f"a{chr(c)}b" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    found += ["".join(chr(rng.randrange(9, 0x250)) for _ in range(rng.choice([1, 3, 9]))) for _ in range(4000)]
    for t in found:
        assert words.ids(t)[:-1].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_rows_without_keys_are_dealt_over_tasks(spark, tmp_path):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    rows = hot.union(spark.range(500).select("id", F.concat(F.lit("text "), F.col("id").cast("string")))).repartition(6)
    path = str(tmp_path / "ids")
    repair_codec.write(rows, path, shards=8)
    sizes = [r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    got = repair_codec.read(spark, path).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(500)) and len(got) == 3500
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None) == (at < 3000 * r.n_tokens and r.n_tokens == 7)
        at += r.n_tokens


# 8


def components(prints, ids, radius=3):
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(prints))}


def plain_simhash(t, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs):
    got = by_id(covering_simhash.op8_covering_simhash(docs), "fingerprint", "component_id")
    all_ = texts(docs)
    ids = sorted(all_)
    prints = [plain_simhash(all_[i]) for i in ids]
    assert {i: got[i][0] for i in ids} == {i: f"{p:016x}" for i, p in zip(ids, prints, strict=True)}
    assert {i: got[i][1] for i in ids} == components(prints, ids)


def test_masks_cover_every_choice():
    from itertools import combinations

    masks = covering_simhash.covering_masks(2, 16)
    assert len(masks) == 7
    for n in (1, 2):
        for places in combinations(range(16), n):
            assert any(not any(m >> p & 1 for p in places) for m in masks)
    assert all(28 <= m.bit_count() <= 36 for m in covering_simhash.covering_masks(3))


@pytest.mark.parametrize("limit", [1, 6, 4096])
def test_links_in_crowded_buckets(spark, limit):
    rng = np.random.default_rng(3)
    prints = set()
    for center in rng.integers(0, 1 << 63, 4).tolist():
        for _ in range(30):
            x = center
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(covering_simhash.signed(x),) for x in prints], "fp long")
    rows = covering_simhash.components(covering_simhash.links(df, 3, limit)).collect()
    want = components(prints, [covering_simhash.signed(x) for x in prints])
    got = {covering_simhash.signed(x): covering_simhash.signed(x) for x in prints} | {r.node: r.root for r in rows}

    def groups(found):
        out = {}
        for k, v in found.items():
            out.setdefault(v, set()).add(k)
        return sorted(map(sorted, out.values()))

    assert groups(got) == groups(want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 99)]
    got = {r.node: r.root for r in covering_simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99, 101: 99}


def test_one_of_each_group_stays(spark):
    rows = awkward(spark)
    kept = covering_simhash.deduplicated(rows)
    assert kept.columns == rows.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 1 not in ids and ids[3] == 1 and 4 not in ids and ids[None] == 2


def shingles(t, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def survivors(found):
    """The smallest ids of the components of texts that are similar to 0.8 or more, by comparing all pairs."""
    ids = sorted(found)
    sets = {i: shingles(found[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for k in ids[:n]:
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]):
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return [i for i in ids if find(i) == i]


@pytest.mark.parametrize("limit", [1, 4096])
def test_similar_texts_go(spark, limit):
    import random

    rng = random.Random(7)
    found, n = {}, 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = f"e{n}"
            found[n], n = " ".join(copy), n + 1
    found |= {n: "", n + 1: "  ", n + 2: None}
    docs = spark.createDataFrame([*found.items(), (0, found[0]), (None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.stays for r in covering_simhash.similar(docs, limit=limit).collect()}
    assert sorted(i for i, stays in got.items() if stays) == survivors({i: t or "" for i, t in found.items()})
    assert len([1 for r in covering_simhash.without_similar(docs).collect() if r.doc_id == 0]) == 1


@pytest.mark.parametrize("common", [4, 32])
def test_every_similar_pair_meets(spark, common, monkeypatch):
    """Copies that are cut, extended or edited in places, against plain all-pairs Jaccard."""
    import random

    monkeypatch.setattr(covering_simhash, "COMMON", common)
    rng = random.Random(11)
    found, n = {}, 0
    passage = [f"c{i}" for i in range(30)]
    for _ in range(40):
        words = [f"v{rng.randrange(20_000)}" for _ in range(rng.choice([60, 150, 300]))] + passage
        copies = [words, words[: len(words) * 83 // 100], words[len(words) // 8 :], words + [f"n{n}x{i}" for i in range(len(words) // 6)]]
        for copy in copies + [[w if rng.random() > 0.02 else f"e{n}y{i}" for i, w in enumerate(words)] for _ in range(3)]:
            found[n], n = " ".join(copy), n + 1
    docs = spark.createDataFrame([*found.items()], "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in covering_simhash.similar(docs).collect() if r.stays)
    want = survivors(found)
    assert got == want and len(want) < len(found)


@pytest.mark.parametrize("hubs", [1, 100])
def test_pairs_beyond_the_hubs(spark, hubs, monkeypatch):
    """A chain in which only neighbours are similar is one group; texts that share much but not enough are none."""
    monkeypatch.setattr(covering_simhash, "HUBS", hubs)
    words = [f"w{i}" for i in range(420)]
    found = {i: " ".join(words[10 * i : 10 * i + 150]) for i in range(25)}
    half = [f"h{i}" for i in range(100)]
    found |= {100 + i: " ".join(half + [f"o{i}x{k}" for k in range(40)]) for i in range(12)}
    found |= {200 + i: found[111 - i] + f" and more {i}" for i in range(3)}
    docs = spark.createDataFrame([*found.items()], "doc_id long, text string")
    got = sorted(r.doc_id for r in covering_simhash.similar(docs).collect() if r.stays)
    assert got == survivors(found) == [0, *range(100, 112)]


def test_groups_of_a_table(spark):
    rows = documents(spark)
    got = sorted(r.doc_id for r in covering_simhash.without_similar(rows).collect())
    assert got == survivors(texts(rows))


# 9


def test_bpe_matches_the_library(docs):
    path, pattern = prefix_bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(path), special_tokens={})
    got = by_id(prefix_bpe.op9_prefix_bpe(docs), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in texts(docs).items():
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = prefix_bpe.decoded(prefix_bpe.encoded(docs.select("doc_id", "text", "lang")))
    assert by_id(back, "text") == {i: (t,) for i, t in texts(docs).items()}


def test_prefix_tables_take_edits():
    import random

    vocabulary = prefix_bpe.encoder(*prefix_bpe.default_vocabulary()).vocabulary
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"aabcde  .,xyz\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        table = prefix_bpe.Prefixes(vocabulary, data)
        assert b"".join(vocabulary.bytes[i] for i in table.ids()) == data
        table.append(b"the end")
        assert table.last == prefix_bpe.Prefixes(vocabulary, data + b"the end").last
        data += b"the end"
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.randrange(4))
        new = bytes(rng.choice(b"ab ") for _ in range(rng.randrange(4)))
        table.replace(a, b, new)
        assert table.last == prefix_bpe.Prefixes(vocabulary, data[:a] + new + data[b:]).last
        other = bytes(rng.choice(b"abc ") for _ in range(9))
        table.change_to(other)
        assert table.last == prefix_bpe.Prefixes(vocabulary, other).last
    table = prefix_bpe.Prefixes(vocabulary, b"some words here and there " * 400)
    assert table.replace(10, 12, b"zz") < 600  # only near the edit
    small = prefix_bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2})
    with pytest.raises(ValueError):
        prefix_bpe.Prefixes(small, b"abc")


# 10


def test_shards(docs):
    got = splitters.op10_sampled_splitters(docs).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 24 for r in got)
    for shard in range(24):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_shards_are_even_and_groups_stay_together(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 10)).otherwise(F.concat(F.lit("text of pair "), F.floor(F.col("id") / 6).cast("string"), F.pmod(F.col("id"), F.lit(3)).cast("string"), F.lit(" x" * 20))).alias("text"))
    got = splitters.op10_sampled_splitters(rows)
    sizes = [r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.05 * min(sizes)
    split = got.join(rows, "doc_id").where("text not like 'hot%'").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split < 100  # of 10,000 pairs; those in ranges beside the hot one


def test_equal_rows_are_split(spark):
    """20,000 equal rows without an id and as many others fill all shards alike."""
    hot = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words " * 3).alias("text"))
    rows = hot.union(spark.range(20_000).select("id", F.concat(F.lit("text of its own, number "), F.col("id").cast("string"), F.lit(" and so on"))))
    got = splitters.op10_sampled_splitters(rows)
    sizes = {r.shard: (r.b, r.n, r.s, r.t) for r in got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("s"), F.max("slot").alias("t")).collect()}
    assert len(sizes) == 24 and max(x[0] for x in sizes.values()) < 1.1 * min(x[0] for x in sizes.values())
    assert all(s == 0 and t == n - 1 for _, n, s, t in sizes.values()) and sum(x[1] for x in sizes.values()) == 40_000


def test_shards_by_hand(spark, monkeypatch):
    """The shard of every row from the splitters, with plain bisection and summing."""
    from bisect import bisect_right

    cuts = []
    draw = splitters.splitters
    monkeypatch.setattr(splitters, "splitters", lambda *a, **k: cuts.append(draw(*a, **k)) or cuts[0])
    rows = documents(spark).select("doc_id", "text").withColumn("text", F.when(F.col("doc_id") % 3 == 0, "hot text of a third").otherwise(F.col("text")))
    got = {r.doc_id: r.shard for r in splitters.op10_sampled_splitters(rows).collect()}
    hashed = rows.select("doc_id", (F.octet_length("text") + 8).alias("size"), F.xxhash64("text").alias("key"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("sub")).alias("sub")).collect()
    total, n = sum(r.size for r in hashed), 24 * 128
    fair, ranges, pieces = total / n, Counter(), Counter()
    for r in hashed:
        ranges[bisect_right(cuts[0], r.key)] += r.size
    parts = {k: -(-b // int(fair + 1)) if b > 2 * fair else 1 for k, b in ranges.items()}
    place = {r.doc_id: (k := bisect_right(cuts[0], r.key), r["sub"] % parts[k]) for r in hashed}
    for r in hashed:
        pieces[place[r.doc_id]] += r.size
    assert max(parts.values()) > 1
    at, before = {}, 0
    for p in sorted(pieces):
        at[p] = min(23, int((before + pieces[p] / 2) * 24 // total))
        before += pieces[p]
    assert got == {i: at[p] for i, p in place.items()}


def test_binary_search(spark):
    cuts = [3, 5, 5, 9]
    got = spark.range(12).select("id", splitters.interval(splitters.longs(cuts), 4, F.col("id")).alias("n")).collect()
    assert all(r.n == sum(c <= r.id for c in cuts) for r in got)


# all


@pytest.mark.parametrize("name", [n for n in queries() if n not in ("op1_block_distribution", "op6_url_rules")])
def test_empty_and_awkward_tables(spark, tmp_path, name):
    for make in (empty, awkward):
        rows = make(spark)
        rows.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        n = queries()[name](spark, str(tmp_path)).count()
        assert n == rows.count() or name.startswith("op2")


@pytest.mark.parametrize("name", ["op1_block_distribution", "op6_url_rules"])
def test_empty_and_awkward_pages(spark, tmp_path, name):
    rows = [(1, "http://a.net/x", "<p>x</p>"), (1, "http://a.net/x", "<p>x</p>"), (None, None, None), (2, "", "")]
    for data in ([], rows):
        spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("h"), "rule": F.lit(2), "verdict": F.lit("v")}).write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        assert queries()[name](spark, str(tmp_path)).count() == len(data)


def test_sentence_is_plain():
    assert len(SENTENCE.split()) > 10
