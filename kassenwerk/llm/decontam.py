"""Benchmark decontamination by a positional inverted index over the training documents.

Benchmark items are cut into words; a window is ``size`` consecutive words of an item, an item of
fewer words is one window. The terms of the index are the benchmark's neighbouring word pairs
(single words for items of one word). One pass over the documents stores a posting, (term,
row, position), for every place where a test term stands. A window's pairs chain up to the whole window,
so a window occurs where the postings of all its terms, each set back by its offset, meet.

The lists are intersected from the rarest term: for each window only the term with the fewest
postings proposes places; a window with a term that has none is dropped at once. Neighbouring windows mostly share
their rarest term, so an item needs few such anchors. At the proposed places the postings of the terms
around the anchor are looked up by an equi-join on row, position and term. Runs of terms
found without a gap that are as long as a window are exact matches; ``near`` counts terms that stand
within ``slop`` words of their place.

The documents' words are written once, as the forward table that gives every row its number. The
benchmark is handled in blocks of at most about ``BLOCK_TERMS`` terms, so that what is broadcast
has a bound however large the benchmark is; items of equal words are looked up once, and
long items as overlapping segments.

Null and empty texts have no words: no document word is hit, no window asked for. Repeated rows,
rows without id and rows that share one are documents of their own. Items that share an id count as one, those
without id as one named by the empty string. Of equally rare terms the first in the window is
the anchor. An empty document table gives an empty result, an empty benchmark no hits. Further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.llm.texts import LOWER, UPPER
from kassenwerk.session import written

SIZE = 10
SEGMENT = 1000  # words of an item that are looked up together
BLOCK_TERMS = 250_000  # of the benchmark, broadcast at once
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, WORD_BREAK, -1), lambda w: w != "")


def forward_table(docs: DataFrame) -> DataFrame:
    """Every row's number, id and words, written once so that all passes see the same numbers."""
    words = docs.select(F.col("doc_id"), words_of(F.col("text")).alias("words"))
    numbered = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", F.size("words").cast("long").alias("n_words"))
    return written(numbered, "forward")


class Phrases:
    """The benchmark as distinct word sequences with their terms.

    ``terms``: phrase, n_words, k, first, second, term, block. ``items``: phrase, item_id.
    """

    def __init__(self, benchmark: DataFrame, size: int = SIZE, segment: int = SEGMENT, block_terms: int = BLOCK_TERMS):
        self.size = size
        name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
        items = benchmark.select(name.alias("item_id"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
        # Overlapping by size - 1 words, segments have the item's windows and no others.
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(segment - size + 1))
        cut = items.select("item_id", "words", F.explode(starts).alias("at")).select(
            "item_id", F.array_join(F.slice("words", F.col("at") + 1, segment), " ").alias("spelt")
        )
        cut = written(cut.distinct(), "segments")
        ids = written(cut.select("spelt").distinct().select("spelt", F.monotonically_increasing_id().alias("phrase")), "phrases")
        self.items = written(cut.join(ids, "spelt").select("phrase", "item_id"), "items")
        split = ids.select("phrase", F.split("spelt", " ").alias("words"))
        pairs = split.select("phrase", F.size("words").alias("n_words"), "words", F.posexplode("words").alias("k", "first"))
        pairs = pairs.withColumn("second", F.get("words", F.col("k") + 1)).filter("second IS NOT NULL OR n_words = 1").drop("words")
        pairs = written(pairs, "pairs")
        self.blocks = max(1, math.ceil(pairs.count() / block_terms))
        same = F.col("p.first").eqNullSafe(F.col("t.first")) & F.col("p.second").eqNullSafe(F.col("t.second"))
        known = written(pairs.select("first", "second").distinct().select("*", F.monotonically_increasing_id().alias("term")), "terms")
        block = F.pmod(F.xxhash64("phrase"), F.lit(self.blocks)).alias("block")
        self.terms = written(pairs.alias("p").join(known.alias("t"), same).select("phrase", "n_words", "k", "p.first", "p.second", "term", block), "terms")

    def in_block(self, block: int) -> DataFrame:
        return self.terms.filter(F.col("block") == block)


class Index:
    """Postings of one block's terms in the documents, and the places their windows ask for."""

    def __init__(self, forward: DataFrame, phrases: Phrases, block: int = 0):
        self.size = phrases.size
        self.terms = phrases.in_block(block)
        known = self.terms.select("first", "second", "term").distinct()
        at = forward.select("row", "words", F.posexplode("words").alias("pos", "first"))
        at = at.select("row", "pos", "first", F.get("words", F.col("pos") + 1).alias("second"))
        # At most BLOCK_TERMS terms and what chance adds to a block.
        postings = at.join(F.broadcast(known.filter("second IS NOT NULL")), ["first", "second"]).select("term", "row", "pos")
        alone = known.filter("second IS NULL").drop("second")
        if not alone.isEmpty():
            postings = postings.unionByName(at.join(F.broadcast(alone), "first").select("term", "row", "pos"))
        self.postings = written(postings, "postings")

    def anchors(self, missing: int = 0) -> DataFrame:
        """Of each window the rarest terms, with the terms that stand with them in a window.

        One term if all of a window's must occur; where ``missing`` may be absent, so many more that
        one of them has to be there. Columns: phrase, n_terms (of a window), k, term, around
        (array of k and term).
        """
        often = self.postings.groupBy("term").agg(F.count("*").alias("n"))
        rated = self.terms.join(often, "term", "left").fillna(0, ["n"])
        lined = rated.groupBy("phrase", "n_words").agg(F.sort_array(F.collect_list(F.struct("k", "n", "term"))).alias("terms"))
        lined = lined.withColumn("n_terms", F.greatest(F.least("n_words", F.lit(self.size)) - 1, F.lit(1)))
        by_rarity = lambda s: F.sort_array(
            F.transform(F.slice("terms", s + 1, F.col("n_terms")), lambda t: F.struct(t["n"], t["k"], t["term"]))
        )
        windows = F.transform(F.sequence(F.lit(0), F.size("terms") - F.col("n_terms")), by_rarity)
        # Terms without postings come first and use up what may be missing.
        chosen = F.transform(windows, lambda w: F.filter(F.slice(w, 1, missing + 1), lambda t: t["n"] > 0))
        live = F.array_distinct(F.flatten(chosen))
        found = lined.select("phrase", "n_terms", "terms", F.explode(live).alias("rare"))
        first = F.greatest(F.col("rare.k") - F.col("n_terms") + 1, F.lit(0))
        around = F.slice("terms", first + 1, F.col("rare.k") - first + F.col("n_terms"))
        return found.select("phrase", "n_terms", "rare.k", "rare.term", F.transform(around, lambda t: F.struct(t["k"], t["term"])).alias("around"))

    def wanted(self, missing: int = 0) -> DataFrame:
        """The terms to be looked up: row, phrase, shift (where the phrase would begin), k, term, n_terms."""
        placed = self.postings.join(F.broadcast(self.anchors(missing)), "term")
        placed = placed.select("row", "phrase", "n_terms", (F.col("pos") - F.col("k")).alias("shift"), F.explode("around").alias("other"))
        return placed.select("row", "phrase", "n_terms", "shift", "other.k", "other.term").filter("shift + k >= 0").distinct()

    def exact(self) -> DataFrame:
        """Occurrences of windows, joined where they overlap: row, phrase, start and end (word positions)."""
        there = self.postings.withColumnRenamed("pos", "at")
        met = self.wanted().withColumn("at", F.col("shift") + F.col("k")).join(there, ["row", "at", "term"])
        line = Window.partitionBy("row", "phrase", "shift").orderBy("k")
        runs = met.withColumn("run", F.col("k") - F.row_number().over(line)).groupBy("row", "phrase", "shift", "run", "n_terms").agg(
            F.min("k").alias("low"), F.max("k").alias("high"), F.min(F.col("n_terms")).alias("least")
        )
        # A pair reaches one word further than it begins; phrases of one word have no pairs.
        spelt = self.terms.filter("second IS NULL").select("phrase", F.lit(0).alias("reach")).distinct()
        reach = F.coalesce("reach", F.lit(1))
        return (
            runs.filter("high - low + 1 >= least")
            .join(spelt, "phrase", "left")
            .select("row", "phrase", (F.col("shift") + F.col("low")).alias("start"), (F.col("shift") + F.col("high") + reach).alias("end"))
        )

    def near(self, slop: int = 3, share: float = 0.7) -> DataFrame:
        """Proximity matches: row, phrase, start, n_found, n_terms.

        A window of whose terms at least ``share`` stand within ``slop`` words of where the phrase puts
        them, seen from one of its rarest terms. Exact matches are among them.
        """
        width = 2 * slop + 1
        expected = F.col("shift") + F.col("k")
        first = F.floor((expected - slop) / width)
        ask = self.wanted(math.floor((1 - share) * max(self.size - 1, 1))).withColumn("place", F.explode(F.array_distinct(F.array(first, first + 1))))
        there = self.postings.withColumn("place", F.floor(F.col("pos") / width))
        met = ask.join(there, ["row", "term", "place"]).filter(F.abs(F.col("pos") - expected) <= slop)
        met = met.select("row", "phrase", "n_terms", "shift", "k").distinct()
        found = Window.partitionBy("row", "phrase", "shift").orderBy("k")
        counted = met.select(
            "row", "phrase", "n_terms", (F.col("shift") + F.col("k")).alias("start"), "k",
            F.max("n_terms").over(found.rowsBetween(0, 0)).alias("own"), "shift",
        )
        sizes = [r["n_terms"] for r in counted.select("n_terms").distinct().collect()]  # at most ``size`` values
        n_found: Column = F.lit(0)
        for n in sizes:
            n_found = F.when(F.col("own") == n, F.count("*").over(found.rangeBetween(0, n - 1))).otherwise(n_found)
        return counted.withColumn("n_found", n_found).filter(F.col("n_found") >= share * F.col("n_terms")).select(
            "row", "phrase", "start", "n_found", "n_terms"
        )


def _covered(hits: DataFrame) -> DataFrame:
    """Words of each row that lie in at least one hit."""
    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", "end").distinct()
    known = F.greatest(F.coalesce(F.max("end").over(earlier), F.lit(-1)), F.col("start") - 1)
    new = spans.withColumn("new", F.greatest(F.col("end") - known, F.lit(0)))
    return new.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))


def _items(found: DataFrame, phrases: Phrases) -> DataFrame:
    """The distinct items of each row's phrases."""
    return found.select("row", "phrase").distinct().join(phrases.items, "phrase").select("row", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, **settings: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    forward, phrases = forward_table(docs), Phrases(benchmark, size, **settings)
    hits = None
    for block in range(phrases.blocks):
        found = written(Index(forward, phrases, block).exact(), "hits")
        hits = found if hits is None else hits.unionByName(found)
    named = _items(hits, phrases).groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    told = _covered(hits).join(named, "row")
    return forward.select("row", "doc_id", "n_words").join(told, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, slop: int = 3, share: float = 0.7, **settings: int) -> DataFrame:
    """``doc_id``, ``item_id`` and the most terms found of a window, for every document and item with a proximity match."""
    forward, phrases = forward_table(docs), Phrases(benchmark, size, **settings)
    every = None
    for block in range(phrases.blocks):
        found = written(Index(forward, phrases, block).near(slop, share), "near")
        every = found if every is None else every.unionByName(found)
    best = every.groupBy("row", "phrase", "n_terms").agg(F.max("n_found").alias("n_found"))
    named = best.join(phrases.items, "phrase").groupBy("row", "item_id").agg(F.max(F.struct("n_found", "n_terms")).alias("best"))
    return named.join(forward.select("row", "doc_id"), "row").select("doc_id", "item_id", "best.n_found", "best.n_terms")
