"""Operator 6: line deduplication with a segment-partition edit join.

A line goes when an earlier line of the corpus, in the order of document id
(null last), row and line number, equals it, or where both have ``min_chars``
characters or more, is at most ``threshold`` edits away.  Blank lines (white
space only) stay: they are layout.  Equal lines are found by digest.
For near ones a line of length l is cut into threshold + 1 segments: of any
two lines within the threshold, one segment of the shorter stands unchanged
in the longer one, at a place that its own length and the difference in
length bound closely.  The segments of every distinct line form an index
keyed on (length, segment number, content); every line probes it with its
few fitting substrings.  Where many lines share a segment (a common prefix
or suffix), what is left of each of them is cut and probed in the same way,
again and again, so no key holds a large group of lines that are not near.
Pairs whose letter counts differ by more than the
threshold allows are not let through the join; the others are verified by a
banded bit-parallel edit distance: one word of 2 * threshold + 1 bits per
error count, moved along the diagonal with three shifts and masks a
character.

Scale: all joins run over distinct lines, so a line that a third of all rows
share is one row after a partial aggregate.  What is shuffled for a line is
its digests and keys; texts move only where they are needed: a bitmap of
fixed size, built from the ids in question, sieves the lines to verify and
the documents to rebuild before the shuffle.  DataFrame and SQL functions
only.

Defined results: null texts stay null and count no lines; empty texts have
one empty line; rows that share an id, or have none, are documents of their
own, so of two equal rows the later one loses its lines; a document may lose
all its lines and then has the empty text; an empty table gives an empty
result; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import sieve


@dataclass(frozen=True)
class LineParams:
    threshold: int = 1      # edits
    min_chars: int = 20     # shorter lines go for equal ones only
    hot: int = 256          # lines under one key from which on their rests are cut too; routing only


def _keyed(docs: DataFrame) -> DataFrame:
    """The lines that are compared: all but blank ones.  ``docs``: _doc (id), _key
    (row), text."""
    lines = docs.select("_doc", "_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return (lines.where(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))
            .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "_doc", "_key", "pos", "line"))


COUNTED = "etanoirs"        # letters whose counts (a byte each) go with a line's keys


def letter_counts(line: Column) -> Column:
    counts = [F.shiftleft(((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))) % 256).cast("long"), 8 * i)
              for i, c in enumerate(COUNTED)]
    return sum(counts[1:], counts[0])


def counts_differ(a: Column, b: Column) -> Column:
    """A lower bound of how much the letter counts differ in all; an edit
    changes it by 2 at most."""
    total = F.lit(0)
    for i in range(len(COUNTED)):
        d = F.abs(F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(b, 8 * i).bitwiseAND(F.lit(255)))
        total = total + F.least(d, F.lit(256) - d)
    return total


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """First position (from 1) and length of segment ``i`` of a line of
    length ``n``; the last n % parts segments are one longer."""
    base, more = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    late = F.lit(i) - (F.lit(parts) - more)
    return F.lit(1) + base * i + F.greatest(F.lit(0), late), base + F.when(late >= 0, 1).otherwise(0)


def _own(line: Column, p: LineParams) -> list[tuple]:
    """(length, segment number, first position, size) of the segments of a line."""
    n, parts = F.length(line), p.threshold + 1
    return [(n, i, *_segment(n, i, parts)) for i in range(parts)]


def _others(line: Column, p: LineParams) -> list[tuple]:
    """The substrings that can equal a segment of a line at most ``threshold``
    shorter (or as long), besides the line's own segments."""
    parts, found = p.threshold + 1, []
    for delta in range(p.threshold + 1):
        n = F.length(line) - delta
        for i in range(parts):
            at, size = _segment(n, i, parts)
            right = p.threshold - i              # errors that may stand right of segment i
            for move in range(max(-i, delta - right), min(i, delta + right) + 1):
                if delta or move:
                    found.append((n, i, at + move, size))
    return found


def segment_keys(line: Column, segments: list[tuple]) -> Column:
    return F.array(*[F.xxhash64(n, F.lit(i), F.substring(line, at, size)) for n, i, at, size in segments])


def _cut(line: Column, segments: list[tuple], *parent: Column) -> Column:
    """(key, rest) for each segment: its key, below that of a parent, and the
    line without it."""
    return F.array(*[F.struct(
        F.xxhash64(*parent, n, F.lit(i), F.substring(line, at, size)).alias("key"),
        F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + size, F.length(line))).alias("rest")) for n, i, at, size in segments])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common_prefix(a: Column, b: Column, n: Column) -> Column:
    """Length of the common prefix of two texts, at most ``n``, by halving."""
    def step(at, size):
        fits = (at + size <= n) & (F.substring(a, at + 1, size) == F.substring(b, at + 1, size))
        return F.when(fits, at + size).otherwise(at)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0), step)


def within(a: Column, b: Column, threshold: int) -> Column:
    """True where the edit distance of two lines is at most ``threshold``:
    common prefix and suffix are taken off, which does not change it, and the
    rest is verified by bits."""
    def middle(s, cut):
        n = F.least(F.length(s["a"]), F.length(s["b"]))
        return _let(_common_prefix(s["a"], s["b"], n), lambda k: F.struct(
            cut(F.substring(s["a"], k + 1, F.length(s["a"]))).alias("a"), cut(F.substring(s["b"], k + 1, F.length(s["b"]))).alias("b")))

    def rest(s):
        return _let(middle(s, F.reverse), lambda r: _let(middle(r, F.reverse), lambda m: _within_bits(m["a"], m["b"], threshold)))

    return _let(F.struct(a.alias("a"), b.alias("b")), rest)


def _within_bits(a: Column, b: Column, threshold: int) -> Column:
    """The banded bit-parallel test.

    Bit d + threshold of word e says: the characters of b read so far match a
    prefix of a that is d longer, with e errors.  Reading a character keeps
    matching bits, takes bits of word e - 1 as they are (substitution) or one
    down (insertion), and spreads them one up (deletion).  Once no bit is left
    the rest is passed over.
    """
    t = threshold
    band = (1 << (2 * t + 1)) - 1

    def spread(words):
        out = [words[0]]
        for w in words[1:]:
            out.append(w.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(band)))
        return out

    names = [f"w{e}" for e in range(t + 1)]
    start = spread([F.lit(1 << t)] + [F.lit(0)] * t)

    def any_bit(state):
        any_word = state[names[0]]
        for k in names[1:]:
            any_word = any_word.bitwiseOR(state[k])
        return any_word

    def step(state, j, chars):
        same = F.lit(0)
        for d in range(-t, t + 1):
            ok = (j + d >= 0) & F.get(chars["a"], j + d).eqNullSafe(F.get(chars["b"], j))
            same = same + F.when(ok, F.lit(1 << (d + t))).otherwise(0)

        def words_of(bits):
            words = []
            for e in range(t + 1):
                w = state[names[e]].bitwiseAND(bits)
                if e:
                    before = state[names[e - 1]]
                    w = w.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1))
                words.append(w)
            return F.struct(*[w.alias(k) for w, k in zip(spread(words), names)])

        return F.when(any_bit(state) == 0, state).otherwise(_let(same, words_of))

    n = F.length(b)
    goal = F.length(a) - n + t
    first = F.struct(*[w.cast("int").alias(k) for w, k in zip(start, names)])
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def run(chars):
        return F.aggregate(steps, first, lambda state, j: step(state, j, chars),
                           lambda state: F.call_function("shiftright", any_bit(state), goal).bitwiseAND(F.lit(1)) == 1)

    return (goal >= 0) & (goal <= 2 * t) & _let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def _texts(ids: DataFrame, distinct: DataFrame, keyed: DataFrame, name: str) -> DataFrame:
    """id, letters, line of some of the distinct lines."""
    asked = cut_lineage(ids.distinct().join(distinct.select("id", "h1", "h2", "letters"), "id"), f"{name}_ids")
    return cut_lineage(sieve.sift(keyed.select("h1", "h2", "line"), "h1", cut_lineage(sieve.build(asked, "h1"), f"{name}_sieve"))
                       .groupBy("h1", "h2").agg(F.first("line").alias("line")).join(asked, ["h1", "h2"]).select("id", "letters", "line"), name)


def _hot(index: DataFrame, p: LineParams) -> DataFrame | None:
    """Sieve of the keys that more than ``hot`` lines have and that can be cut
    further, None if there are none."""
    divisible = F.max(F.length("rest")) > p.threshold if "rest" in index.columns else F.lit(True)
    keys = index.groupBy("key").agg(F.count("*").alias("n"), divisible.alias("divisible")).where((F.col("n") > p.hot) & F.col("divisible"))
    found = cut_lineage(sieve.build(keys, "key"), "hot_segments")
    return None if found.isEmpty() else found


def _meet(index: DataFrame, probe: DataFrame, hot: DataFrame | None, p: LineParams) -> DataFrame:
    """Pairs of ids that share a key which is not hot and may be near."""
    sides = [x if hot is None else sieve.sift(x, "key", hot, inside=False) for x in (index, probe)]
    a, b = (x.select("key", F.col("id").alias(k), F.col("letters").alias(f"letters_{k}")) for x, k in zip(sides, "ab"))
    alike = counts_differ(F.col("letters_a"), F.col("letters_b")) <= 2 * p.threshold
    return cut_lineage(a.join(b, "key").where((F.col("a") != F.col("b")) & alike)
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line_pairs")


def candidates(distinct: DataFrame, keyed: DataFrame, p: LineParams) -> DataFrame:
    """Pairs ``a, b`` that share a segment.  Lines under a hot key have the
    threshold left for their rests, so there the rests are cut in the same way
    and meet by a segment of the rest too, until no key is hot."""
    index = distinct.select("id", "letters", F.explode("index").alias("key"))
    probe = distinct.select("id", "letters", F.explode(F.concat("index", "probe")).alias("key"))
    hot = _hot(index, p)
    pairs = _meet(index, probe, hot, p)
    if hot is None:
        return pairs
    ids = [sieve.sift(x, "key", hot).select("id") for x in (index, probe)]
    lines, line = _texts(ids[0].union(ids[1]), distinct, keyed, "hot_lines"), F.col("line")
    index = lines.select("id", "letters", F.inline(_cut(line, _own(line, p))))
    probe = lines.select("id", "letters", F.inline(_cut(line, _own(line, p) + _others(line, p))))
    rest, key = F.col("rest"), F.col("key")
    while hot is not None:
        index = cut_lineage(sieve.sift(index, "key", hot).select("id", "letters", F.inline(_cut(rest, _own(rest, p), key))), "rest_index")
        probe = cut_lineage(sieve.sift(probe, "key", hot).select("id", "letters", F.inline(_cut(rest, _own(rest, p) + _others(rest, p), key))), "rest_probe")
        hot = _hot(index, p)
        pairs = pairs.union(_meet(index, probe, hot, p))
    return pairs.distinct()


def near_lines(distinct: DataFrame, keyed: DataFrame, p: LineParams) -> DataFrame:
    """Pairs ``a, b`` of ids of distinct lines within the threshold.
    ``distinct``: id, digests h1 and h2, letters, index, probe; ``keyed``: h1, h2 and
    line of every line."""
    pairs = candidates(distinct, keyed, p)
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), distinct, keyed, "line_texts").drop("letters")
    return (pairs.join(texts.withColumnsRenamed({"id": "a", "line": "line_a"}), "a")
            .join(texts.withColumnsRenamed({"id": "b", "line": "line_b"}), "b")
            .where(within(F.col("line_a"), F.col("line_b"), p.threshold)).select("a", "b"))


def dropped_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """_key and the line numbers (from 0) that go, for rows that lose any.
    ``docs``: _doc (id), _key (row), text."""
    keyed = _keyed(docs)
    long_one = F.length("line") >= p.min_chars
    none = F.array().cast("array<long>")
    distinct = cut_lineage(
        keyed.select("h1", "h2", "_doc", "_key", "pos", F.when(long_one, letter_counts(F.col("line"))).alias("letters"),
                     F.when(long_one, segment_keys(F.col("line"), _own(F.col("line"), p))).otherwise(none).alias("index"),
                     F.when(long_one, segment_keys(F.col("line"), _others(F.col("line"), p))).otherwise(none).alias("probe"))
        .groupBy("h1", "h2").agg(F.min(F.struct(F.col("_doc").isNull().alias("no_id"), "_doc", "_key", "pos")).alias("first"), F.first("letters").alias("letters"),
                                 F.first("index").alias("index"), F.first("probe").alias("probe"), F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id()), "distinct_lines")
    near = near_lines(distinct, keyed.where(long_one), p)
    order = distinct.select("id", "first")
    late = (near.join(order.withColumnsRenamed({"id": "a", "first": "first_a"}), "a")
            .join(order.withColumnsRenamed({"id": "b", "first": "first_b"}), "b")
            .select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    verdict = cut_lineage(distinct.select("h1", "h2", F.struct("first._key", "first.pos").alias("first"), "id", "n")
                          .join(late.withColumn("late", F.lit(True)), "id", "left")
                          .where("late OR n > 1").select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late")), "line_verdict")
    goes = (keyed.select("h1", "h2", "_key", "pos").join(verdict, ["h1", "h2"])
            .where(F.col("late") | ~F.col("first").eqNullSafe(F.struct("_key", "pos"))))
    return goes.groupBy("_key").agg(F.collect_set("pos").alias("dropped"))


def deduplicate(docs: DataFrame, p: LineParams = LineParams(), row: Column | None = None) -> DataFrame:
    """``docs`` with the remaining text, ``n_lines`` and ``n_dropped``.  ``row``: a
    number that tells rows apart and is the same each time they are read;
    without it the rows are numbered and written once."""
    new = ["n_lines", "n_dropped"]
    inner = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").alias("_doc"), "text", F.struct(*inner).alias("_row"),
                       (F.monotonically_increasing_id() if row is None else row).alias("_key"))
    rows = cut_lineage(rows, "line_rows") if row is None else rows
    gone = cut_lineage(dropped_lines(rows.select("_doc", "_key", "text"), p).withColumnRenamed("_key", "_gone"), "dropped_lines")
    some = cut_lineage(sieve.build(gone, "_gone"), "dropped_sieve")
    lines = F.split("text", "\n", -1)
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    left = F.filter(lines, lambda x, i: ~F.array_contains("dropped", i))
    touched = (sieve.sift(rows, "_key", some).join(gone, F.col("_key") == F.col("_gone"), "left")
               .select("_row", n_lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")))
    untouched = sieve.sift(rows, "_key", some, inside=False).select("_row", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    return (touched.unionByName(untouched)
            .select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in new], *new))
