"""Operator 8: personal data by information-theoretic sanitisation.

Protected entities are what the base patterns find (e-mail addresses, IP
addresses, card and phone numbers).  How strongly another term reveals an
entity is estimated from co-occurrence in the lines of the whole corpus:

    PMI(e, t) = ln(n_et * N / (n_e * n_t)),   IC(e) = ln(N / n_e),

with N lines in all, n_t of them with term t, n_e with entity e and n_et with
both.  PMI / IC is 1 where the term never stands without the entity.  Whether
a term is a span is judged on an estimate smoothed by ``prior`` lines that
hold the entity as often as any line does,

    p(e | t) = (n_et + prior * n_e / N) / (n_t + prior),

so that few lines count for less, and entities of a single line are judged
too.  Terms that reach ``threshold`` of the entity's information by it are
spans: generalised to their shape where PMI / IC is below ``remove_at``,
removed from there on.  Terms are runs of letters and digits.

Scale: the patterns run map-only.  Co-occurrences are counted on lines that
hold an entity, with partial aggregates, so an entity or word that a third
of all lines share is one row a task.  The corpus counts of the terms in
question are taken over all lines, sieved by a bitmap of fixed size before
the shuffle.  DataFrame and SQL functions only.

Defined results: null and empty texts have no spans; repeated rows are found
each and count each; null ids pass through; an entity that stands in every line carries no
information, so no term reveals it (risk 0); an empty table gives an empty
result; extra columns are ignored.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import sieve

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
# The contract's patterns.  Where what follows a repeat can never match inside
# it, the repeat is possessive, and a match can only begin where a run of its
# characters begins: the matches are the same, without backtracking.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class PiiParams:
    prior: float = 0.5         # lines without evidence that each term is counted with
    threshold: float = 0.9     # share of the entity's information that a term may not reach
    remove_at: float = 1.0     # from here on a term is removed, below it is generalised
    min_chars: int = 1         # of a term


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, k: s + F.when((n - k) % 2 == 0, F.substring(digits, k, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, k, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False))


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind as (start, kind number, end, found).  The
    texts between the matches and the matches alternate, so the starts are
    running sums of their lengths."""
    pattern, k = PATTERNS[kind], KINDS.index(kind)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    state = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["found"]), F.lit(0))).alias("at"),
            F.when(p["found"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(p["gap"])).alias("start"), F.lit(k).alias("kind"),
                (s["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("end"), p["found"].alias("found"))))).alias("spans")))
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(state["spans"], lambda x: _valid(kind, x["found"]))).otherwise(none)


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``base``: spans of the patterns by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in PATTERNS])).alias("base"))


def _words(line: Column) -> Column:
    """Runs of letters and digits, with an empty word for every separator that follows
    another, so that a word's place follows from the lengths before it."""
    return F.split(line, r"[^\p{L}\p{Nd}]", -1)


def _start(parts: Column, k: Column) -> Column:
    """Offset of part ``k`` (from 0) of a text split at single characters."""
    return F.when(k > 0, F.length(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "-")) + 1).otherwise(0)


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["found"]))


def disclosing_terms(scanned: DataFrame, docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """(row, start, end, risk) of the terms that reveal an entity of their
    line.  ``scanned``: row, text, base of the rows with base spans."""
    split = F.split("text", "\n", -1)
    lines = (scanned.where(F.size("base") > 0).select("row", "text", "base", F.posexplode(split).alias("li", "line"))
             .withColumn("at", _start(split, F.col("li")))
             .withColumn("own", F.filter("base", lambda b: (b["start"] >= F.col("at")) & (b["start"] < F.col("at") + F.length("line"))))
             .where(F.size("own") > 0)
             .select("row", "li", "line", "at", F.array_distinct(F.transform("own", _entity)).alias("ents")))
    lines = cut_lineage(lines, "entity_lines")
    long_enough = F.length("term") >= p.min_chars
    terms = F.array_distinct(F.split(F.lower("line"), r"[^\p{L}\p{Nd}]+"))
    n_et = (lines.select("ents", F.explode(terms).alias("term")).where(long_enough)
            .select(F.explode("ents").alias("ent"), "term").groupBy("ent", "term").agg(F.count("*").alias("n_et")))
    n_et = cut_lineage(n_et, "term_pairs")
    n_e = lines.select(F.explode("ents").alias("ent")).groupBy("ent").agg(F.count("*").alias("n_e"))
    asked = cut_lineage(sieve.build(n_et, "term"), "term_sieve")
    corpus = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    n = corpus.agg(F.count("*").alias("n"))
    n_t = (sieve.sift(corpus.select(F.explode(terms).alias("term")).where(long_enough), "term", asked)
           .groupBy("term").agg(F.count("*").alias("n_t")))
    ln = F.log
    share = F.col("n_e") / F.col("n")
    smooth = (F.col("n_et") + p.prior * share) / (F.col("n_t") + p.prior)
    def of_information(x):
        return F.coalesce(F.try_divide(ln(x / share), -ln(share)), F.lit(0.0))
    risky = (n_et.join(n_e, "ent").join(n_t, "term").crossJoin(F.broadcast(n))          # n is one row
             .where(of_information(smooth) >= p.threshold)
             .select("ent", "term", of_information(F.col("n_et") / F.col("n_t")).alias("risk")))
    risky = cut_lineage(risky, "risky_terms")
    places = (lines.select("row", "li", "ents", F.posexplode(_words(F.col("line"))).alias("wi", "word"))
              .withColumn("term", F.lower("word")).where(long_enough)
              .select("row", "li", "wi", "term", F.explode("ents").alias("ent"))
              .join(risky, ["ent", "term"]).groupBy("row", "li", "wi").agg(F.max("risk").alias("risk")))
    words = _words(F.col("line"))
    return (places.join(lines.select("row", "li", "line", "at"), ["row", "li"])
            .select("row", (F.col("at") + _start(words, F.col("wi"))).alias("start"),
                    F.length(F.element_at(words, F.col("wi") + 1)).alias("n"), "risk")
            .select("row", "start", (F.col("start") + F.col("n")).alias("end"), "risk"))


def find(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, text (of rows with spans), ``base`` and ``spans`` (base ones and
    the disclosing terms that overlap none of them)."""
    scanned = cut_lineage(find_base(docs).withColumn("row", F.monotonically_increasing_id())
                          .withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii_scan")
    added = (disclosing_terms(scanned, docs, p).groupBy("row")
             .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end",
                                          F.when(F.col("risk") >= p.remove_at, "remove").otherwise("generalise").alias("found"))).alias("added")))
    free = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return (scanned.join(added, "row", "left")
            .select("doc_id", "text", "base", F.array_sort(F.concat("base", F.coalesce(
                free, F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")))).alias("spans")))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, terms generalised to
    their shape or removed; of overlapping spans the first one counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(s, x):
        shown = F.when(x["found"] == "generalise", F.regexp_replace(F.regexp_replace(
            F.substring(text, x["start"] + 1, x["end"] - x["start"]), r"\p{Lu}", "X"), r"\p{Ll}", "x")).when(
            (x["kind"] == KINDS.index("term")), F.lit("")).otherwise(F.element_at(names, x["kind"] + 1))
        free = x["start"] >= s["at"]
        return F.struct(F.when(free, x["end"]).otherwise(s["at"]).alias("at"),
                        F.when(free, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), shown)).otherwise(s["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _count(kind: int) -> Column:
    """Base spans of one kind (a lambda of one argument: a second one would be the index)."""
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    counts = [_count(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
