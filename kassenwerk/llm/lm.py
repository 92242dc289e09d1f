"""Language-model scoring with a log-frequency Bloom filter of bigram counts.

A filter holds each n-gram once per level of its count's logarithm, so a count is read by asking for
level after level until one is missing. Its size grows with the corpus, and so would a
broadcast of it, without bound. Here it is cut by key range into segments of bounded size, each built and asked by
one task: documents are dealt into blocks, a block sends each segment the distinct keys
it holds with their training counts, the segment sums them, fills its filter, and answers the block's keys in the
order asked. Counting and asking thus share one exchange, of distinct keys per block.
Unigrams take the same way, but their exact sums are sent back.

Unigram probabilities are smoothed by adding 0.1. A bigram's is mixed with its word's:
``MIX * count(v w) / count(v) + (1 - MIX) * p(w)``, or ``p(w)`` after an unseen ``v``.
The end mark stands before a text's first word. The filter can only overstate a count, for
a few per cent of absent bigrams; counts are cut at that of their first word.

Null texts count as empty: they have the end mark only. Rows without id are in the training
part. Repeated rows count as often as they stand there. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassenwerk.llm.texts import WordHashes, mix, pair_hash, runs, utf8
from kassenwerk.session import written

ADD, MIX = 0.1, 0.4
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word is a space
BLOCK_BYTES, SEGMENT_TOKENS = 16 << 20, 1_500_000
BITS_PER_ITEM, HASHES, BASE = 10, 4, 2.0
SLICE = 4 << 20
_ASKED = "segment long, kind string, block long, keys binary, counts binary"
_ANSWERED = "segment long, kind string, block long, found binary, types long, tokens long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"


class LogBloom:
    """Counts by membership of (key, level); a level is the count's logarithm plus one."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(int)
        levels[counts < 1] = 0
        self.top = int(levels.max(initial=0))
        self.bits = np.zeros(max(64, BITS_PER_ITEM * int(levels.sum())), bool)
        for level in range(1, self.top + 1):
            for places in self._places(keys[levels >= level], level):
                self.bits[places] = True

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((first + np.uint64(i) * step) % np.uint64(len(self.bits))).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Asks for level 1, and for the next one as long as all bits are set."""
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, self.top + 1):
            there = np.ones(len(live), bool)
            for places in self._places(keys[live], level):
                there &= self.bits[places]
            live = live[there]
            out[live] = level
        return out


def level_counts() -> np.ndarray:
    """The expected count of each level: the mean of the whole numbers that fall in it."""
    low = BASE ** np.arange(63)
    return np.append(0.0, (low + BASE * low - 1) / 2)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Key ranges of equal width, so that sorted keys lie by segment."""
    return ((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


class _Block:
    """The tokens of a block's documents, as places in its sorted distinct keys."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        hashes, parts, sizes = WordHashes(), [], []
        for a, b in runs([len(t) for t in texts], SLICE):
            for text in texts[a:b]:
                found = hashes.of(text.lower().split())
                parts += [found, [END]]
                sizes.append(len(found) + 1)
        tokens = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = END
        self.words, self.word = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair = np.unique(pair_hash(before, tokens), return_inverse=True)
        self.before = np.searchsorted(self.words, before)
        weight = np.repeat(train, self.sizes).astype(float)
        self.word_counts = np.bincount(self.word, weight, len(self.words))
        self.pair_counts = np.bincount(self.pair, weight, len(self.pairs))


def _ask(segments: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        held = np.array(table.column("held_out").to_pylist(), bool)
        block = _Block(utf8(table.column("text").combine_chunks()), ~held)
        rows = []
        for kind, keys, counts in (("word", block.words, block.word_counts), ("pair", block.pairs, block.pair_counts)):
            segment = _segment(keys, segments)
            bounds = np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(keys)) if len(keys) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                # Within a segment's narrow range the low half of a pair's key tells it apart well enough.
                sent = keys[a:b] if kind == "word" else keys[a:b].astype(np.uint32)
                rows.append((int(segment[a]), kind, key[0].as_py(), sent.tobytes(), counts[a:b].astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _ASKED.split(", ")])

    return run


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """One segment of one kind: sums the counts of all blocks, then answers each block's keys."""
    segment, kind = key[0].as_py(), key[1].as_py()
    width = np.uint64 if kind == "word" else np.uint32
    asked = [np.frombuffer(x.as_py(), width) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.bincount(place, counts, len(keys))
    if kind == "word":
        found = sums.astype(np.int64)[place]
    else:
        found = LogBloom(keys.astype(np.uint64), sums).levels(keys.astype(np.uint64))[place]
    ends = np.cumsum([len(x) for x in asked])
    answers = [found[e - len(x) : e].tobytes() for x, e in zip(asked, ends, strict=True)]
    n = len(answers)
    types = [int((sums > 0).sum())] + [0] * (n - 1)
    tokens = [int(sums.sum())] + [0] * (n - 1)
    return pa.table(
        [
            pa.array([segment] * n, pa.int64()), pa.array([kind] * n, pa.string()), table.column("block").combine_chunks(),
            pa.array(answers, pa.binary()), pa.array(types, pa.int64()), pa.array(tokens, pa.int64()),
        ],
        [c.split()[0] for c in _ANSWERED.split(", ")],
    )


def _score(total: int, types: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        held = np.array(docs.column("held_out").to_pylist(), bool)
        block = _Block(utf8(docs.column("text").combine_chunks()), ~held)
        told = sorted(zip(answers.column("kind").to_pylist(), answers.column("segment").to_pylist(), answers.column("found").to_pylist(), strict=True))
        joined = lambda kind, width: np.frombuffer(b"".join(x for k, _, x in told if k == kind), width)
        counts = joined("word", np.int64)
        pairs = level_counts()[joined("pair", np.uint8)]
        seen = counts[block.word]
        alone = (seen + ADD) / (total + ADD * (types + 1))
        first = counts[block.before]
        both = np.minimum(pairs[block.pair], first)
        mixed = np.where(first > 0, MIX * both / np.maximum(first, 1) + (1 - MIX) * alone, alone)
        per_doc = lambda x: np.add.reduceat(x, block.starts) if len(x) else np.zeros(0)
        n = docs.num_rows
        return pa.table(
            [
                docs.column("doc_id").combine_chunks(), pa.array(held, pa.bool_()), pa.array(block.sizes, pa.int64()),
                pa.array(per_doc((seen > 0).astype(np.int64)), pa.int64()), pa.array(per_doc(np.log10(alone)), pa.float64()),
                pa.array(per_doc(np.log10(mixed)), pa.float64()), pa.array([total] * n, pa.int64()),
            ],
            [c.split()[0] for c in RESULT.split(", ")],
        )

    return run


def score(df: DataFrame, held_out: Column) -> DataFrame:
    """Scores every text under the model of the texts for which ``held_out`` is false."""
    narrow = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        held_out.alias("held_out"),
    )
    size = narrow.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks, segments = 1 + size // BLOCK_BYTES, 1 + size // (6 * SEGMENT_TOKENS)
    # By id and text: rows without id, or with the same one, do not meet in one block.
    dealt = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_ask(segments), _ASKED)
    answers = written(asked.groupBy("segment", "kind").applyInArrow(_answer, _ANSWERED), "answers")
    sums = answers.filter("kind = 'word'").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(sums["n"] or 0, sums["v"] or 0), RESULT)
