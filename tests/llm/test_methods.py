"""The operators of the llm subpackage against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardstat.llm import (bpe_chunks, common, components, fm_quality, ftrl_toxicity, line_dedup, pii_disclosure, simhash_golay,
                          spaced_seeds, stream_dedup, suffix_dedup, text_density)

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 1, 3: classifiers ---------------------------------------------------------

def test_fm_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    ids, x = np.array([3, 5, 9, 3, 7]), rng.normal(size=5).astype(np.float32)
    w, v = rng.normal(size=10).astype(np.float32), rng.normal(size=(10, 4)).astype(np.float32)
    got = fm_quality.margins(ids, x, np.array([0, 3]), 0.3, w, v)
    for rows, m in (((0, 1, 2), got[0]), ((3, 4), got[1])):
        want = 0.3 + sum(w[ids[k]] * x[k] for k in rows)
        want += sum(v[ids[a]] @ v[ids[b]] * x[a] * x[b] for a, b in itertools.combinations(rows, 2))
        assert m == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("module, label, least", [(fm_quality, "quality", 0.93), (ftrl_toxicity, "toxic", 0.88)])
def test_classifier_on_held_out_rows(spark, module, label, least):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    got = module.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 30
    assert (got.predicted == got[label]).mean() >= least


def test_ftrl_keeps_few_coordinates():
    rng = random.Random(2)
    rows = []
    for k in range(400):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(30)] + (["vile"] if k % 4 == 0 else [])
        rng.shuffle(words)
        rows.append((np.unique(ftrl_toxicity.coordinates(" ".join(words), ftrl_toxicity.word_hashes())), int(k % 4 == 0)))
    bias, used, weights = ftrl_toxicity.fit(rows, ftrl_toxicity.FtrlParams())
    word = ftrl_toxicity.coordinates("vile", ftrl_toxicity.word_hashes())
    assert bias < 0 < weights[np.searchsorted(used, word[0])]
    assert len(used) < 2000


# --- 2: SimHash -----------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    s = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect():
    _, _, error = simhash_golay.golay_tables()
    assert len(set(error.tolist())) == 2048 and max(int(e).bit_count() for e in error) == 3


def test_simhash_links_all_pairs_within_three_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (3, 1):
        want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= bits}
        got = [tuple(r) for r in simhash_golay.links(df, bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_are_the_reachable_sets(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(25)] + [(300, k) for k in range(301, 340)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect())
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for p in pairs for x in p if p[0] != p[1]}


def test_simhash_joins_send_no_rows_through_the_driver(spark, monkeypatch):
    """Sides that grow with the table meet by shuffle, though a small one would fit a broadcast."""
    plans, cut = [], simhash_golay.cut_lineage

    def seen(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(simhash_golay, "cut_lineage", seen)
    monkeypatch.setattr(components, "cut_lineage", seen)
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "something else"), (5, None)], "doc_id long, text string")
    out = simhash_golay.near_duplicates(docs, max_bits=3)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: r.component_id for r in out.collect()}[2] == 1
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_simhash_query_against_brute_force(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in simhash_golay.near_duplicates(docs).collect()}
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert all(int(got[k].fingerprint, 16) == fp[k] and len(got[k].fingerprint) == 16 for k in fp)
    low = {k: k for k in fp}
    for _ in range(20):
        for a, b in itertools.combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                low[a] = low[b] = min(low[a], low[b])
    assert {k: r.component_id for k, r in got.items()} == low


# --- 4: suffix sorting ------------------------------------------------------------

def brute_cut(rows, n):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first[b[k:k + n]] = min(first.get(b[k:k + n], 1 << 63), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        b, own = (t or "").encode(), 1 << 62 if i is None else i
        g = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k:k + n]] < own:
                g[k:k + n] = [True] * n
        runs = sum(1 for k in range(len(b)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((i, len(b), sum(g), runs, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [24, 50, 79])
def test_deep_shallow_rank_is_the_sorted_order(length):
    rng = random.Random(length)
    raw = bytes(rng.choice(b"ab") for _ in range(300)) * 2 + bytes(rng.choice(b"abcdefgh") for _ in range(900)) + b"a" * 200
    starts = np.arange(len(raw) - length + 1)
    rank = suffix_dedup.deep_shallow_rank(np.frombuffer(raw + b"\0" * 8, np.uint8), starts, length)
    place = {}
    for k, s in enumerate(sorted(raw[i:i + length] for i in starts)):
        place.setdefault(s, k)
    assert rank.tolist() == [place[raw[i:i + length]] for i in starts]


def test_substrings_are_cut_as_by_brute_force(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdefghé ") for _ in range(rng.randint(30, 200))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(["the", "é", "tion ", *passages]) if rng.random() < .5 else "".join(rng.choice("abc ") for _ in range(20))
                     for _ in range(rng.randint(0, 10)))
        rows.append((rng.choice([i, i, None, 7]), None if rng.random() < .05 else t))
    rows += [(500, "a" * 400), (501, "a" * 300), (502, "ab" * 100), (503, "a" * 49), (1, "a" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk_bytes in (2000, 1 << 20):
        assert rows_of(suffix_dedup.cut(df, 50, chunk_bytes)) == brute_cut(rows, 50)


def hot_passage_rows(n):
    rng = random.Random(60)
    def context():
        return "".join(rng.choice("abcdefghij ") for _ in range(70))
    passage = "".join(rng.choice("klmnopqrst ") for _ in range(150))
    return [(i, context() + passage + context()) for i in range(n)]


def test_runs_of_a_hot_anchor_are_dealt_singly(spark):
    rows = hot_passage_rows(150)
    tops = rows[:60] + [(200 + i, rows[i][1][40:240]) for i in range(30)] + [(None, t) for _, t in rows[:5]]
    for chunk_bytes in (3000, 1 << 20):
        for hot_runs in (0, 20):
            got = suffix_dedup.cut(spark.createDataFrame(tops, "doc_id long, text string"), 50, chunk_bytes, hot_runs=hot_runs)
            assert rows_of(got) == brute_cut(tops, 50)
    texts = [t.encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    c = suffix_dedup.Chunk(np.arange(len(rows)), offsets, np.frombuffer(b"".join(texts), np.uint8), 50)
    h, twice, many = c.anchors()
    hot = h[many > 20]
    assert len(hot) >= 2
    _, _, spans, low, anchor = c.shared_runs(h[twice])
    items = suffix_dedup.Items(spans, low, anchor, hot, 50)
    place = suffix_dedup._bucket(items.key, 16)
    singly = len(place) - len(items.whole)
    assert all(len(p) == 50 for p in items.parts[len(items.whole):])
    assert max(np.bincount(place[len(items.whole):], minlength=16)) < singly / 4


def test_equal_rows_are_dealt_by_row(spark, tmp_dir):
    rows = [(None, "a null id and equal text " * 4)] * 40 + [(1, "a null id and equal text " * 4)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/equal_rows.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/equal_rows.parquet")
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    assert rows_of(suffix_dedup.cut(docs, 50, 400, row=row)) == brute_cut(rows, 50)


# --- 5: text density ----------------------------------------------------------------

def test_pages_give_their_articles(spark):
    got = text_density.extract(common.table(spark, SF, "pages")).join(common.table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    import html
    for r in got:
        a = r.html[r.html.index("<article"):r.html.index("</article>")]
        assert r.text == " ".join(html.unescape(re.sub(r"<(?:/?(?:p|h1|article)|br)[^>]*>", " ", re.sub(r"</?b>", "", a))).split())
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;b&gt; text", "plain <b> text"),
    ("<body><nav><a href=1>Home</a></nav><header>Top</header><article><h1>T</h1><p>One  two<br>three <b>f</b>our&amp;</p></article>"
     "<aside>x</aside><footer>y</footer>", "T One two three four&"),
    ("<div id=side class='sidebar'>s</div><div><p>Long text one, with words.<p>Long text two, with words.</div><div class=comments><p>No</div>",
     "Long text one, with words. Long text two, with words."),
    ("<article><p>a<script>if (a<b) x='</p>'</script>b<style>p{}</style></p><form>f</form><div role=alert>n</div></article>", "a b"),
])
def test_main_text_of_small_pages(page, text):
    assert text_density.main_text(page).replace("ab", "a b") == text


def test_pages_without_article_keep_title_and_short_paragraphs():
    long_one = "A long paragraph of the text, with many words. " * 12
    page = f"<body><div class=c1><h1>Title</h1><p>{long_one}</p><p>Short.</p><p>{long_one}</p></div></body>"
    assert text_density.main_text(page) == " ".join(f"Title {long_one} Short. {long_one}".split())


@pytest.mark.parametrize("tag", ["article", "main"])
def test_articles_lose_only_the_listed_kinds(tag):
    inner = ("<div class='entry-header'><h1 id='search-alert'>Title</h1></div><p>Text of <math><mi>x</mi></math> here.</p>"
             "<div class='related-work'><p>Related work.</p></div><table><tr><td><a href=1>Link table</a></td></tr></table>"
             "<div role=alert>n</div><div class='ad'>a</div><nav><a href=1>m</a></nav><aside>s</aside><form>f</form><div class=comments>c</div>"
             "<ul><li><a href=1>First reference</a></li><li><a href=2>Second reference</a></li></ul>")
    want = "Title Text of x here. Related work. Link table First reference Second reference"
    assert text_density.main_text(f"<body><div class='header'>h</div><{tag}>{inner}</{tag}><div class='related'>r</div></body>") == want


def test_deep_and_long_pages():
    assert text_density.main_text("<div>" * 20000 + "text" + "</div>" * 20000) == "text"
    assert len(text_density.main_text("<p>" + "word " * 100000)) == 499999


# --- 6: lines -----------------------------------------------------------------------------

def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, line, letters, n):
    b = list(line)
    for _ in range(n):
        i, o = rng.randint(0, len(b)), rng.randint(0, 2)
        if o == 0:
            b.insert(i, rng.choice(letters))
        elif i < len(b):
            b[i:i + 1] = [] if o == 1 else [rng.choice(letters)]
    return "".join(b)


def test_bit_parallel_distance(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        rows.append((a, edited(rng, a, "abé", rng.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), t).alias("w")).collect()
        assert all(r.w == (distance(r.a, r.b) <= t) for r in got)


def brute_lines(docs, threshold, min_chars):
    """Remaining texts of the rows, which stand in order of id (null last)."""
    order = sorted((i is None, i or 0, row, k, line) for row, (i, t) in enumerate(docs) if t is not None
                   for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for place in order:
        first.setdefault(place[4], place)
    long_ones = {x: f for x, f in first.items() if len(x) >= min_chars}
    # a line that goes for a near one goes everywhere
    late = {x for x, f in long_ones.items() if any(y != x and g < f and distance(x, y) <= threshold for y, g in long_ones.items())}
    return [None if t is None else "\n".join(
        x for k, x in enumerate(t.split("\n")) if x not in first or (x not in late and first[x][2:4] == (row, k))) for row, (i, t) in enumerate(docs)]


@pytest.mark.parametrize("threshold, written, hot", [(1, False, 256), (2, False, 256), (1, True, 256), (1, False, 2), (2, False, 1)])
def test_lines_go_as_by_brute_force(spark, tmp_dir, threshold, written, hot):
    """Shared and null ids, equal rows, short and blank lines; with and without hot keys."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) for _ in range(25)] + ["", " ", "x"]
    docs = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), "abcdé ", rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))]
        docs.append((rng.choice([i, i, i % 9, None]), None if i % 13 == 0 else "\n".join(lines)))
    docs += rng.sample(docs, 10)
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    p = line_dedup.LineParams(threshold=threshold, min_chars=8, hot=hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    if written:
        df.write.parquet(f"{tmp_dir}/lines")
        df = spark.read.parquet(f"{tmp_dir}/lines")
        got = line_dedup.deduplicate(df.withColumn("_key", F.lit("x")), p, row=F.col("_metadata.row_index"))
    else:
        got = line_dedup.deduplicate(df, p)
    want = brute_lines(docs, threshold, 8)
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((i, w)) for (i, _), w in zip(docs, want))
    for r, (_, t) in zip(sorted(got.collect(), key=lambda r: str((r.doc_id, r.n_lines))), sorted(docs, key=lambda d: str((d[0], 0 if d[1] is None else d[1].count("\n") + 1)))):
        assert r.n_lines == (0 if t is None else t.count("\n") + 1)


def test_lines_with_a_common_half_do_not_all_meet(spark):
    """Log lines: the same front, a number, the same end; every tenth has a near one."""
    rng = random.Random(3)
    lines = [f"2026-01-01 the service answered the request of number {k * 7919 % 100_003:05d}{k * 104_729 % 99_991:05d} without any delay" for k in range(1500)]
    lines += [x[:20] + x[21:] for x in lines[::10]]
    rng.shuffle(lines)
    p = line_dedup.LineParams(hot=16)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    line = F.col("text")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), line.alias("line"),
                       line_dedup.letter_counts(line).alias("letters"), line_dedup.segment_keys(line, line_dedup._own(line, p)).alias("index"),
                       line_dedup.segment_keys(line, line_dedup._others(line, p)).alias("probe"))
    met = {(r.a, r.b) for r in line_dedup.candidates(rows.drop("line"), rows.select("h1", "h2", "line"), p).collect()}
    assert len(met) < 40 * len(lines)                    # all pairs would be 680 a line
    by_gap = {}                                          # lines one substitution apart agree without that place, others without one character
    for i, x in enumerate(lines):
        for k in range(len(x)):
            by_gap.setdefault(x[:k] + x[k + 1:], set()).add(i)
        by_gap.setdefault(x, set()).add(i)
    near = {(a, b) for group in by_gap.values() for a in group for b in group if a < b and abs(len(lines[a]) - len(lines[b])) <= 1
            and within_one(lines[a], lines[b])}
    assert near and near <= met


def within_one(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "a line that comes again and again\nthe rest of one"), (7, "something else, but unique here\nb"), (7, "a line that comes again and again\nc")]
    got = sorted(r.text for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0][1], rows[1][1], "c"])


# --- 7: stream ------------------------------------------------------------------------------

def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(groups[n])[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                  for i, t in rows for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_groups_with_and_without_digest_collisions(spark, tmp_dir, digits):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "", " ", "a b", "ab", "a\tb ", "é", f"t{rng.randint(0, 40)} x"])) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    got = stream_dedup.deduplicate(spark, f"{tmp_dir}/documents.parquet", digest_digits=digits).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_stream_continues_from_its_state(spark, tmp_dir):
    path = f"{tmp_dir}/documents.parquet"
    schema = "doc_id long, text string"
    spark.createDataFrame([(5, "a"), (6, "b")], schema).write.parquet(path)
    first = stream_dedup.run_stream(spark, path, f"{tmp_dir}/state")
    assert sorted(r.group_size for r in first.collect()) == [1, 1]
    spark.createDataFrame([(3, "a "), (9, "c")], schema).write.mode("append").parquet(path)
    again = {r.best.id: r.group_size for r in stream_dedup.run_stream(spark, path, f"{tmp_dir}/state").collect()}
    assert again == {3: 2, 6: 1, 9: 1}


# --- 8: personal data -----------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(d) <= 19 and luhn)
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_as_by_the_plain_patterns(spark):
    rng = random.Random(10)
    parts = ["1", "2.", "9", "+", "4 ", "5-", "a@", "b.", "c-", "(", "😀", "é", ".", "0.0", "4111 1111 1111 1111", "\n", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "a@b.c@d.e.f@g", "+1 (415) 555-2671 1.2.3.4 256.1.1.1 01.002.3.4", "1" * 20000, "a." * 5000 + "@"]
    got = pii_disclosure.find_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_spans(texts[r.doc_id])


def test_counts_by_kind_are_those_of_the_spans(spark):
    texts = ["a@b.co c@d.co e@f.co", "call +1 415 555 2671", "1.2.3.4 and 4111 1111 1111 1111 and 5.6.7.8", "none", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(
        common.table(spark, SF, "documents").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    got = {r.doc_id: r for r in pii_disclosure.digest(pii_disclosure.find(docs)).collect()}
    for i, t in docs.collect():
        spans = brute_spans(t)
        assert [got[i][f"n_{kind}"] for kind, _ in PATTERNS] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_disclosing_terms_and_sanitised_text(spark):
    plain = [(k, f"the weather number {w} is mild") for k, w in enumerate(["one", "two", "three"] * 30)]
    secret = [(100 + k, f"intro\nthe Zanzibar office of jo@x.org is {w}") for k, w in enumerate(["near", "far", "closed", "open"])]
    df = spark.createDataFrame(plain + secret, "doc_id long, text string")
    found = pii_disclosure.find(df)
    got = {r.doc_id: r.spans for r in pii_disclosure.digest(found).collect()}
    assert all(got[k] == "" for k, _ in plain)
    for k, t in secret:
        spans = got[k].split(",")
        assert f"term:{t.index('Zanzibar')}:{t.index('Zanzibar') + 8}" in spans
        assert f"email:{t.index('jo@')}:{t.index('jo@') + 8}" in spans
        assert not any(s.startswith(f"term:{t.index('the')}:") for s in spans)
    shown = found.where("doc_id = 100").select(pii_disclosure.sanitised(F.col("text"), F.col("spans"))).first()[0]
    assert "jo@x.org" not in shown and "Zanzibar" not in shown and "[EMAIL]" in shown and shown.startswith("intro\nthe ")


def test_an_entity_in_every_line_has_no_disclosing_terms(spark):
    rows = [(k, "write to jo@x.org today") for k in range(4)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    got = pii_disclosure.digest(pii_disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == [(k, "email:9:17") for k in range(4)]


def test_entities_of_one_line_are_judged_too(spark):
    rows = [(k, f"the weather number {k % 7} is mild") for k in range(300)] + [(900, "the Okonjo account B72 of ek@y.org is it")]
    t = rows[-1][1]
    got = {r.doc_id: r.spans for r in pii_disclosure.digest(pii_disclosure.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    spans = got[900].split(",")
    for word in ("Okonjo", "B72"):
        assert f"term:{t.index(word)}:{t.index(word) + len(word)}" in spans
    assert not any(s.startswith("term:0:") for s in spans) and f"term:{t.index(' is ') + 1}:{t.index(' is ') + 3}" not in spans
    assert all(got[k] == "" for k in range(300))


# --- 9: BPE --------------------------------------------------------------------------------

def test_chunked_bpe_equals_the_library(monkeypatch):
    import public_tokenizers
    enc = bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe_chunks, "CUT_BITS", 4)
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x180)] + [chr(c) for c in (0x2028, 0x3000, 0x4E2D, 0x661, 0x1F600, 0x300, 0x200B)]
    for k in range(1500):
        s = "".join(rng.choice(letters if k % 3 else " '\n\tresvltmda 12.") for _ in range(rng.randint(0, 120)))
        if k % 7 == 0:
            s = s[:20] + "<|endoftext|>" + s[20:]
        if k % 11 == 0:
            s += " " * 50 + "a" * 100 + "<|endoftext|>" * 2
        want = enc.tok.encode(s, add_special_tokens=False).ids
        got = enc.encode(s)
        assert got.tolist() == want
        assert enc.decode(got) == enc.tok.decode(want, skip_special_tokens=False)
    assert enc.repaired > 100 and enc.encoded > 100


def test_bpe_with_a_small_memory_equals_the_library():
    """Pieces move between the two generations of the memory many times."""
    import public_tokenizers
    enc = bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), pieces=300, chunks=20)
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 12))) for _ in range(900)]
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randint(1, 150))) for _ in range(8)]
        enc.learn(texts)
        for t in texts:
            got = enc.encode(t)
            assert got.tolist() == enc.tok.encode(t, add_special_tokens=False).ids and enc.decode(got) == t
    assert enc.older


def test_shared_chunks_are_encoded_once():
    import public_tokenizers
    enc = bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"word{k} of text" for k in range(3000))
    enc.learn([text])
    before = enc.encoded
    enc.learn([text, "other start " + text])
    assert enc.encoded - before <= 2 and enc.reused > 10


# --- 10: seeds -----------------------------------------------------------------------------

def test_masks_meet_every_window_with_two_substitutions():
    p = spaced_seeds.SeedParams()
    for bad in itertools.combinations(range(p.window), p.substitutions):
        assert any(all(m[k] == "0" or s + k not in bad for k in range(len(m))) for m in p.masks for s in range(p.window - len(m) + 1))


def brute_overlap(doc, item, window=13, most=2):
    a, b = spaced_seeds.tokens(item), spaced_seeds.tokens(doc)
    if len(a) < window:
        if not a or len(a) < 5 and len(a) != len(b):
            return False
        return any(sum(x != y for x, y in zip(a, b[k:k + len(a)])) <= (len(a) >= 7) for k in range(len(b) - len(a) + 1))
    return any(sum(a[i + k] != b[j + k] for k in range(window)) <= most
               for i in range(len(a) - window + 1) for j in range(len(b) - window + 1))


@pytest.mark.parametrize("block_tokens", [2_000_000, 60])
def test_overlaps_as_by_brute_force(spark, block_tokens):
    rng = random.Random(12)
    word = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(word) for _ in range(rng.choice([4, 6, 9, 12, 13, 20, 30])))) for k in range(12)] + [(50, None), (51, ""), (52, "?!")]
    docs = []
    for k in range(80):
        t = [rng.choice(word) for _ in range(rng.randint(0, 40))]
        if k % 2:
            piece = rng.choice(items[:12])[1].split()
            lo = rng.randint(0, max(0, len(piece) - 13))
            piece = piece[lo:lo + rng.choice([12, 13, 40])]
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = "zz"
            t[5:5] = [w.upper() + "," if rng.random() < .3 else w for w in piece]
        docs.append((k, " ".join(t)))
    docs += [(90, None), (91, ""), (92, "...")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    p = spaced_seeds.SeedParams(block_tokens=block_tokens)
    got = {r.doc_id: {o.item_id for o in r.overlaps} for r in spaced_seeds.overlaps(df, bench, p).collect()}
    want = {i: {k for k, t in items if t and brute_overlap(d or "", t)} for i, d in docs}
    assert got == want
    left = {r.doc_id for r in spaced_seeds.decontaminate(df, bench, p).collect()}
    assert left == {i for i, w in want.items() if not w}


# --- further cases of 5 and 10 ------------------------------------------------------------------

BODY = "<h1>A title of the page</h1>" + "".join(f"<p>Paragraph {k} says something of its own, at some length, about the matter.</p>" for k in range(12))


@pytest.mark.parametrize("open_, close", [
    ('<div class="has-sidebar">', "</div>"), ('<div class="content no-sidebar">', "</div>"), ('<div class="with-nav">', "</div>"),
    ('<article><div class="ad-free">', "</div></article>"), ('<article><div class="entry comments-open">', "</div></article>"),
    ('<article><div id="alert-systems">', "</div></article>"), ('<div class="widget">', "</div>"), ('<div class="plain">', "</div>")])
def test_names_that_do_not_mean_noise(open_, close):
    page = f'<body><nav>Home About</nav>{open_}{BODY}{close}<div class="comment-list"><p>first!</p></div><div class="site-footer">legal words</div></body>'
    text = text_density.main_text(page)
    assert text.startswith("A title of the page Paragraph 0 says") and text.endswith("about the matter.") and "Paragraph 11" in text
    assert "first!" not in text and "legal" not in text and "Home" not in text


def test_long_comments_stay_out():
    page = f'<body><article>{BODY}</article><section id="comments">' + "<article class='comment'><p>a reader says a lot of things here, on and on</p></article>" * 60 + "</section></body>"
    assert "a reader" not in text_density.main_text(page)


def test_short_items(spark):
    bench = [(1, "Paris"), (2, "one two three four five six seven eight nine ten eleven twelve"), (3, "alpha beta gamma delta epsilon zeta eta"),
             (4, "red green blue white black grey")]
    docs = [(1, "We flew to Paris in May"), (2, "PARIS!"), (3, "so one two three four five six SEVENTY eight nine ten eleven twelve it is"),
            (4, "one two three four five six x eight nine y eleven twelve"), (5, "a alpha beta gamma delta epsilon zeta theta b"),
            (6, "alpha beta gamma DELTA x zeta eta"), (7, "red green blue white black gray"), (8, "x red green blue white black grey y")]
    for tokens in (2_000_000, 5):
        p = spaced_seeds.SeedParams(block_tokens=tokens)
        found = spaced_seeds.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), p)
        got = {r.doc_id: sorted(o.item_id for o in r.overlaps) for r in found.collect()}
        assert got == {1: [], 2: [1], 3: [2], 4: [], 5: [3], 6: [3], 7: [], 8: [4]}


def test_ftrl_is_the_update_coordinate_by_coordinate():
    p = ftrl_toxicity.FtrlParams(epochs=2, l1=0.7, l2=0.1, alpha=0.5)
    rng = random.Random(33)
    rows = [(np.array(sorted(rng.sample(range(40), rng.randint(0, 9))), np.int32), rng.randint(0, 1)) for _ in range(60)]
    bias_at, z, n = 1 << ftrl_toxicity.BITS, {}, {}

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == bias_at else p.l1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)
    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            ids, y = [*rows[k][0].tolist(), bias_at], rows[k][1]
            w = {i: weight(i) for i in ids}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in ids:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * w[i]
                n[i] = old + g * g
    bias, used, weights = ftrl_toxicity.fit(rows, p)
    want = {i: weight(i) for i in z if i != bias_at and weight(i)}
    assert bias == pytest.approx(weight(bias_at)) and dict(zip(used.tolist(), weights)) == pytest.approx(want) and 0 < len(want) < 40
