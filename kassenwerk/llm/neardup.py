"""Near-duplicate documents by HyperMinHash.

A document is its set of word shingles. The shingles' hashes fall into ``REGISTERS`` bins, and a register
keeps its bin's smallest hash as a count of leading zeros and ten mantissa bits; empty bins take
no space. Equal sets become one class first, so a group of exact copies counts once. Bands of
``ROWS`` registers put classes into buckets; there empty registers borrow from filled ones.
Candidates pass an estimate from their registers, corrected for registers that agree by
chance, and are then confirmed on their full sets.

In a first round every class of a bucket meets the bucket's smallest one, which joins most of a group of
near copies. Only buckets that then still hold several components go on: their members are dealt into
blocks of ``BLOCK``, and the registers of a block, or of two blocks, are compared inside one task. What leaves
it are only pairs of different components that are likely links, each from the first
bucket that the two share. So no pair is put out for being in one bucket, and no link between
components is left out.

A class pair of the least similarity 0.8 shares no band with a probability of 3e-6. How far an
estimate may fall short of it is ``SPREAD`` standard deviations of what the registers sample: a
pair is missed with a probability of less than one in a million.

Null texts and texts without words have an empty set: linked with nothing, kept. Rows with
the same id are one document. Rows without id have no component; they are kept. Ties
are settled by the smallest id. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from kassenwerk.llm.texts import WordHashes, mix, pair_hash, runs, utf8
from kassenwerk.session import written

REGISTERS, ROWS, MANTISSA = 1024, 6, 10
BANDS = 42
SPREAD = 5
SHARE = 80  # of 100
BLOCK = 2048  # classes of a bucket that one task compares with as many others
FEW_IDS = 1_000_000  # that are broadcast to pick texts; a long each
SLICE = 4 << 20
_PROFILE = "doc_id long, n_shingles long, high long, low long, registers binary"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than ``size`` are one shingle."""
    hashes, out = WordHashes(), []
    for text in texts:
        words = hashes.of(text.lower().split())
        n = min(size, len(words))
        if not n:
            out.append(words)
            continue
        found = mix(words[: len(words) - n + 1])
        for i in range(1, n):
            found = pair_hash(found, words[i : len(words) - n + 1 + i])
        out.append(np.unique(found))
    return out


def registers(found: np.ndarray) -> np.ndarray:
    """Compressed minima: 0 for an empty bin, else leading zeros plus one, then the mantissa bits."""
    out = np.zeros(REGISTERS, np.uint16)
    bits = REGISTERS.bit_length() - 1
    place = (found >> np.uint64(64 - bits)).astype(np.int64)
    # The set is sorted and bins are its leading bits: a bin's first value is its smallest.
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(found) else []
    rest = (found[first] << np.uint64(bits)) | np.uint64(1)
    filled = rest.copy()
    for step in (1, 2, 4, 8, 16, 32):
        filled |= filled >> np.uint64(step)
    zeros = np.uint64(64) - np.bitwise_count(filled).astype(np.uint64)
    after = (rest << zeros) << np.uint64(1)
    out[place[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from rows of registers.

    Two different minima agree in their zeros with probability 1/3 (the sum of 4**-k) and in
    all mantissa bits with 2**-MANTISSA; that share of agreements is taken off.
    """
    used = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    return _corrected(((a == b) & (a > 0)).sum(-1), used)


def _corrected(same: np.ndarray, used: np.ndarray) -> np.ndarray:
    chance = 2.0**-MANTISSA / 3
    return np.clip((same / used - chance) / (1 - chance), 0, 1)


def likely(same: np.ndarray, used: np.ndarray, sizes: np.ndarray, share: int) -> np.ndarray:
    """Whether pairs with so many equal and used registers, of sets of ``sizes`` in all, may be links.

    The registers are a sample of the union, without replacement: those of a union smaller than the number
    of bins are nearly all of it.
    """
    least = share / 100
    union = np.maximum(sizes / (1 + least), 1)
    unseen = np.clip(1 - used / union, 0.02, 1)
    return _corrected(same, used) >= least - SPREAD * np.sqrt(least * (1 - least) / used * unseen)


def packed(row: np.ndarray) -> bytes:
    """A map of the filled registers, and their values."""
    return np.packbits(row > 0).tobytes() + row[row > 0].tobytes()


def _profiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            counts, high, low, kept = [], [], [], []
            for a, b in runs([len(t) for t in texts], SLICE):
                for found in shingle_sets(texts[a:b], size):
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    counts.append(len(found))
                    high.append(int.from_bytes(digest[:8], "big", signed=True))
                    low.append(int.from_bytes(digest[8:], "big", signed=True))
                    kept.append(packed(registers(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "registers"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), REGISTERS), np.uint16)
    for row, value in zip(out, column.to_pylist(), strict=True):
        filled = np.unpackbits(np.frombuffer(value, np.uint8, REGISTERS // 8)).view(bool)
        row[filled] = np.frombuffer(value, np.uint16, offset=REGISTERS // 8)
    return out


def _orders() -> np.ndarray:
    """For each bin that bands use, all bins in an order of its own: column i is where bin i looks."""
    bins = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(pair_hash(bins[:, None], bins[None, : BANDS * ROWS]), axis=0)


_ORDERS = _orders()


def _filled(m: np.ndarray) -> np.ndarray:
    """The bands' registers with the empty ones filled: an empty bin takes the value of the first filled bin of its order.

    Without this a short text's band would hold one or two values and lie in a bucket with every
    text that has the same frequent words. So registers of two texts agree as often as their
    sets are similar, however short they are. Texts without any shingle stay empty.
    """
    out = m[:, : BANDS * ROWS].copy()
    row, at = np.nonzero((out == 0) & m.any(1)[:, None])
    for turn in range(REGISTERS):
        if not len(row):
            break
        value = m[row, _ORDERS[turn, at]]
        hit = value > 0
        out[row[hit], at[hit]] = value[hit]
        row, at = row[~hit], at[~hit]
    return out


def _band_keys(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per row and band, and whether the band has a register that is not empty."""
    x = _filled(m).reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        key = pair_hash(key, x[:, :, i])
    return key.view(np.int64), x.any(2)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            keys, live = _band_keys(_matrix(part.column("registers")))
            ids = np.repeat(part.column("rep").to_numpy(), BANDS).reshape(keys.shape)
            yield pa.RecordBatch.from_arrays([pa.array(keys[live]), pa.array(ids[live])], ["bucket", "rep"])


def _likely(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                a, b = _matrix(part.column("ra")), _matrix(part.column("rb"))
                same, used = ((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
                sizes = part.column("na").to_numpy() + part.column("nb").to_numpy()
                yield part.select(["a", "b"]).filter(pa.array(likely(same, np.maximum(used, 1), sizes, share)))

    return run


def _compared(share: int):
    """Likely links between the components of one block of a bucket, or of two blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        bucket, first, second = (k.as_py() for k in key)
        rep, component, size, block = (column(n) for n in ("rep", "component", "n", "own"))
        m = _matrix(table.column("registers").combine_chunks())
        keys, _ = _band_keys(m)
        filled, found = (m > 0).sum(1), ([], [])
        order = np.argsort(rep, kind="stable")
        for x in np.flatnonzero(block == first):
            # Within one block each pair once, between two blocks all.
            others = order[np.searchsorted(rep[order], rep[x], "right") :] if first == second else np.flatnonzero(block == second)
            others = others[component[others] != component[x]]
            if not len(others):
                continue
            there = m[x] > 0
            mine = m[np.ix_(others, np.flatnonzero(there))]
            same = (mine == m[x][there]).sum(1)
            used = filled[x] + filled[others] - (mine > 0).sum(1)
            others = others[likely(same, np.maximum(used, 1), size[x] + size[others], share)]
            shared = keys[others] == keys[x]
            own = shared & (np.cumsum(shared, 1) == 1) & (keys[others] == bucket)
            for y in others[own.any(1)]:
                found[0].append(min(rep[x], rep[y]))
                found[1].append(max(rep[x], rep[y]))
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in runs([len(t) for t in texts], SLICE):
                found = [s.tobytes() for s in shingle_sets(texts[a:b], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found, pa.binary())], ["rep", "shingles"])

    return run


def _confirmed(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def counted(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, Row]:
    """``df`` written, with its row count ``n`` and further totals seen while it was written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *more), label)
    return table, Row(**seen.get)


def components(links: DataFrame) -> DataFrame:
    """``rep`` and ``component`` (smallest member) of all that is linked by rows (a, b).

    Alternating star contraction: every node is hung below the smallest of its larger, then of its
    smaller neighbours, until nothing changes. Each round is written, so that a lost executor
    costs one round, and says by its own count and hash whether it changed anything.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges, now = counted(small, "edges", F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("hash"))
        if before == now:
            break
        before = now
    stars = edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("rep"), F.col("v").alias("component"))).distinct()


def _as_links(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("rep").alias("a"), F.col("component").alias("b"))


class _Search:
    """The rounds over one table; written tables hold what later rounds read again."""

    def __init__(self, df: DataFrame, size: int, share: int):
        self.spark, self.size, self.share = df.sparkSession, size, share
        self.texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.profiles = written(self.texts.mapInArrow(_profiles(size), _PROFILE), "profiles")
        some = self.profiles.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = written(some.groupBy("high", "low").agg(F.min("doc_id").alias("rep")), "classes")
        reps = some.join(self.classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "high", "low"], "left_semi")
        reps = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "registers")
        banded = reps.mapInArrow(_bands, "bucket long, rep long")
        shared = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).filter("pivot != top")
        self.members = written(banded.join(shared.drop("top"), "bucket").distinct(), "members")
        # Rows of one id whose texts differ are linked by the id itself.
        ids = some.groupBy("doc_id").agg(F.countDistinct("high", "low").alias("n")).filter("n > 1")
        several = some.join(ids, "doc_id", "left_semi").join(self.classes, ["high", "low"])
        self.same_id = several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
        self.registers = written(reps.join(self.members.select("rep").distinct(), "rep", "left_semi"), "registers")

    def _shingles(self, pairs: DataFrame) -> DataFrame:
        """The sets of all that ``pairs`` names."""
        ids, total = counted(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        # Few ids go to the texts; more have the texts sent to them once.
        ids = F.broadcast(ids) if total.n <= FEW_IDS else ids
        wanted = self.texts.join(ids, "doc_id", "left_semi").mapInArrow(_sets(self.size), "rep long, shingles binary")
        return written(wanted, "shingles")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""
        found = self._shingles(pairs)
        a = found.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        b = found.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        links = pairs.join(a, "a").join(b, "b").mapInArrow(_confirmed(self.share), "a long, b long")
        return written(links.distinct(), "links")

    def _open(self, linked: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the bucket's number of members."""
        placed = self.members.select("bucket", "rep").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("all"))
        return placed.join(apart.filter("x != y").select("bucket", "all"), "bucket")

    def _across(self, members: DataFrame) -> DataFrame:
        """Likely links between different components that share a bucket."""
        blocks = F.ceil(F.col("all") / BLOCK)
        own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        dealt = members.select("bucket", "rep", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("with"))
        dealt = dealt.select("bucket", "rep", "component", "own", F.least("own", "with").alias("first"), F.greatest("own", "with").alias("second"))
        return dealt.join(self.registers, "rep").groupBy("bucket", "first", "second").applyInArrow(_compared(self.share), "a long, b long")

    def linked(self) -> DataFrame:
        """``rep`` and ``component`` of every class that has links."""
        pairs = self.members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        side = lambda x: self.registers.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        stars = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(self.share), "a long, b long")
        stars, total = counted(stars, "stars")
        found = self.confirmed(stars).unionByName(self.same_id) if total.n else self.same_id
        linked = components(found)
        rest, total = counted(self._across(self._open(linked)).join(stars, ["a", "b"], "left_anti"), "rest")
        return components(_as_links(linked).unionByName(self.confirmed(rest))) if total.n else linked

    def result(self) -> DataFrame:
        linked = self.linked()
        labelled = self.classes.join(linked, "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("component_id"))
        return self.profiles.join(labelled, ["high", "low"], "left").select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )


def near_duplicates(df: DataFrame, size: int = 5, share: int = SHARE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``df``.

    Links need at least ``share`` of 100 in common; a component's smallest id is kept.
    """
    found = _Search(df, size, share).result()
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.withColumn("component_id", own).withColumn(
        "kept", F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
