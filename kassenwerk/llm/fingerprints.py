"""Document fingerprints by locally consistent parsing.

A text's code points are cut into short phrases whose ends depend on a few neighbours only:
runs of one symbol are joined, deterministic coin tossing turns neighbouring symbols into
small labels that differ, and phrases begin at labels larger than both their
neighbours. A phrase's name is a hash of its symbols; the names are the next level's
symbols. Equal substrings therefore get equal names inside, wherever they stand. The names of
two levels, about ten and thirty characters long, are the document's set, of which a fingerprint keeps the
smallest hash per bin.

Null texts count as empty; the empty fingerprint is like itself (1) and unlike others (0).
Documents follow each other by id, nulls first, equal ids by a hash of their text; the last is
followed by the first, a single one by itself. So rows that share an id, or have none, are spread over all tasks too. An empty table gives an empty result. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.llm.texts import mix, runs
from kassenwerk.session import written

LEVELS = (2, 3)
BINS = 128
EMPTY = 0xFFFF
SLICE = 1_000_000  # characters worked on at once
RESULT = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
_EDGE = ", part int, edge string, text string"


def _coins() -> np.ndarray:
    """The label of symbol a after symbol b: twice the lowest bit in which they differ, plus a's bit."""
    a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    low = (a ^ b) & -(a ^ b)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)), 0).astype(int)
    return (2 * place + ((a >> place) & 1)).astype(np.uint8).ravel()


_COINS = _coins()


def _phrases(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names, and whose they are."""
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names)))
    symbols, doc = names[at], doc[at]
    several = length > 1
    symbols[several] = mix(symbols[several] + length[several].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    first = np.empty(len(symbols), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]

    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = symbols ^ before
    place = np.bitwise_count((differ & -differ) - np.uint64(1))
    labels = (2 * place + ((symbols >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        previous = np.empty_like(labels)
        previous[1:] = labels[:-1]
        previous[first] = ~labels[first]
        labels = _COINS[labels.astype(np.uint16) * np.uint16(256) + previous]

    begins = first.copy()
    begins[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(symbols)))
    inside = (np.arange(len(symbols)) - np.repeat(starts, sizes)).astype(np.uint64)
    mixed = mix(symbols + (inside + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    return mix(np.add.reduceat(mixed, starts)), doc[starts]


def sketches(texts: list[str]) -> np.ndarray:
    """A row of bins for each text; empty bins hold ``EMPTY``."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    sizes = [len(t) for t in texts]
    for a, b in runs(sizes, SLICE):
        if not sum(sizes[a:b]):
            continue
        names = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        doc = np.repeat(np.arange(a, b), sizes[a:b])
        keys = []
        for level in range(1, max(LEVELS) + 1):
            names, doc = _phrases(names, doc)
            if level in LEVELS:
                h = mix(names + np.uint64(level))
                value = np.minimum((h >> np.uint64(40)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1))
                keys.append((doc.astype(np.uint64) << np.uint64(23)) | ((h >> np.uint64(57)) << np.uint64(16)) | value)
        key = np.sort(np.concatenate(keys))
        place = key >> np.uint64(16)
        least = np.append(True, place[1:] != place[:-1])
        out.reshape(-1)[place[least].astype(np.int64)] = (key[least] & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins that agree among those that either has; 1 for two empty ones."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def bytes_of(sketch: np.ndarray) -> list[bytes]:
    return [row.astype(">u2").tobytes() for row in sketch]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _results(ids: list, texts: list[str], own: np.ndarray, following: list[str], next_own: np.ndarray) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = sketches(changed)
    digests = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in changed]
    none = [None] * len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.binary()),
            pa.array(bytes_of(own), pa.binary()), pa.array(bytes_of(other), pa.binary()),
            pa.array(likeness(own, other)), pa.array(likeness(own, next_own)),
            pa.array(none, pa.int32()), pa.array(none, pa.string()), pa.array(none, pa.string()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"],
    )


def _edge(part: int, edge: str, doc_id: int | None, text: str) -> pa.RecordBatch:
    columns = dict(doc_id=doc_id, n_chars=None, edited_sha256=None, fingerprint=None, edited_fingerprint=None)
    row = columns | dict(near_edited=None, near_next=None, part=part, edge=edge, text=text)
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: every row but its last with the next one; its first and last row as edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None  # the row whose successor has not come yet
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in runs([len(t) for t in texts], SLICE):
            these, own = texts[a:b], sketches(texts[a:b])
            if held is None:
                yield _edge(part, "first", ids[a], these[0])
                row_ids, row_texts, row_own = ids[a:b], these, own
            else:
                row_ids, row_texts, row_own = [held[0], *ids[a:b]], [held[1], *these], np.vstack([held[2], own])
            if len(row_ids) > 1:
                yield _results(row_ids[:-1], row_texts[:-1], row_own[:-1], row_texts[1:], row_own[1:])
            held = (row_ids[-1], row_texts[-1], row_own[-1:])
    if held is not None:
        yield _edge(part, "last", held[0], held[1])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
        if ids:
            done = _results(ids, texts, sketches(texts), following, sketches(following))
            yield done.select([c.split()[0] for c in RESULT.split(", ")])


def fingerprints(df: DataFrame) -> DataFrame:
    """Each text's fingerprint, its edited text's, and its likeness to that and to the next text.

    The texts move once, into ranges of ids. A task reads its range in order and keeps one row
    back; the rows at the ranges' edges, two for each task, are written and meet afterwards.
    """
    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Repeated rows are told apart, so that a range can end among them.
    order = ["doc_id", F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id())]
    lined = narrow.withColumns({f"_{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)})
    sorted_ = lined.repartitionByRange("_0", "_1", "_2").sortWithinPartitions("_0", "_1", "_2").select("doc_id", "text")
    swept = written(sorted_.mapInArrow(_sweep, RESULT + _EDGE), "swept")
    inner = swept.filter("edge IS NULL").drop("part", "edge", "text")
    edges = swept.filter("edge IS NOT NULL")
    # As many rows as the sort had tasks with rows.
    parts = edges.filter("edge = 'last'").select("part", F.row_number().over(Window.orderBy("part")).alias("nr"))
    turn = parts.select("part", "nr", F.coalesce(F.lead("nr").over(Window.orderBy("nr")), F.lit(1)).alias("_next"))
    last = edges.filter("edge = 'last'").join(turn, "part").select("doc_id", "text", F.col("_next").alias("nr"))
    first = edges.filter("edge = 'first'").join(parts, "part").select("nr", F.col("text").alias("following"))
    closed = last.join(first, "nr").select("doc_id", "text", "following").mapInArrow(_close, RESULT)
    every = inner.unionByName(closed)
    # Kept as bytes up to here, which take half the space.
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
