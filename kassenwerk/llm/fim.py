"""Fill-in-middle transformation by secondary sort.

A text is cut into units (a run of ASCII letters, or one other character). Two cuts drawn from its id
divide it into prefix, middle and suffix, which are put out in another order behind the
sentinels ``<P>``, ``<S>`` and ``<M>``; some texts stay plain.

No task builds an output. Each row emits its sections as pieces of at most ``CHUNK`` units, keyed by
row and position in the output. ``repartitionAndSortWithinPartitions`` brings the pieces of a row together in
that order, and they stream through an incremental digest. For the way back, the pieces' sentinels alone
tell which section they are; keyed anew by their place in the text they are sorted once more (the
partitioner is the same, so nothing moves) and streamed through a second digest. The
sorts spill to disk; a task holds a row's text while it cuts it, and then single pieces.

Rows, not ids, are the key: repeated rows and rows that share an id are documents of their own, and a
source or a group of copies cannot gather in one task. A row is known by its place in its input
partition, which a repeated task finds unchanged if the input is a table, as
in the query; write other inputs first. Null texts are empty and stay plain. A null id draws as an
empty one. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # of the sections in the text
END = 3
SALT = "1"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
CHUNK = 16_384
TASK_BYTES = 64 << 20  # of text, which the sort holds in part compressed
_ROW_BITS = 40
RESULT = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


def unit_starts(text: str) -> np.ndarray:
    """Where units begin, in code points, followed by the text's length."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    begins = ~letter
    begins[:1] = True
    begins[1:] |= ~letter[:-1]
    return np.append(np.flatnonzero(begins), len(points))


def draw(doc_id: int | None, n: int, text: str, salt: str = SALT) -> tuple[str, int, int]:
    """Form, and the units that end the prefix and the middle."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in SENTINELS):
        return "plain", a, b
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def _emit(salt: str, chunk: int):
    def run(part: int, rows: Iterator[Any]) -> Iterator[tuple]:
        packed = zstandard.ZstdCompressor(level=1)
        for ordinal, (doc_id, text) in enumerate(rows):
            text = text or ""
            starts = unit_starts(text)
            n = len(starts) - 1
            form, a, b = draw(doc_id, n, text, salt)
            spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
            row, position = part << _ROW_BITS | ordinal, 0
            yield (row, -1), (doc_id, n, form)
            for section in ORDERS.get(form, ("",)):
                low, high = spans.get(section, (0, n))
                for at in range(low, max(high, low + 1), chunk):
                    piece = text[starts[at] : starts[min(at + chunk, high)]]
                    lead = section if at == low else ""
                    yield (row, position), packed.compress((lead + piece).encode("utf-8", "surrogatepass"))
                    position += 1

    return run


def _by_row(key: tuple) -> int:
    """A scrambled row number, so that no run of rows shares a task."""
    return (key[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 20


def _pieces(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    unpacked = zstandard.ZstdDecompressor()
    for (row, position), value in sorted_pieces:
        yield row, position, (value if position < 0 else unpacked.decompress(value).decode("utf-8", "surrogatepass"))


def _first_digest(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of the outputs; the pieces go on, keyed by their place in the text.

    The sections are found by their sentinels, which no other part of a transformed text holds.
    """
    packed = zstandard.ZstdCompressor(level=1)
    current, head, digest = None, (), hashlib.sha256()
    place, chars = 0, {}

    def closed() -> tuple:
        counts = (None, None) if head[2] == "plain" else (chars.get(0, 0), chars.get(1, 0))
        return (current, END, 0), (*head, *counts, digest.hexdigest())

    for row, position, value in _pieces(sorted_pieces):
        if position < 0:
            if current is not None:
                yield closed()
            current, head, digest, place, chars = row, value, hashlib.sha256(), 0, {}
            continue
        digest.update(value.encode("utf-8", "surrogatepass"))
        if head[2] != "plain" and value.startswith(SENTINELS):
            place, value = PLACES[value[:3]], value[3:]
        chars[place] = chars.get(place, 0) + len(value)
        if value:
            yield (row, place, position), packed.compress(value.encode("utf-8", "surrogatepass"))
    if current is not None:
        yield closed()


def _second_digest(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    unpacked, digest = zstandard.ZstdDecompressor(), hashlib.sha256()
    for (_, place, _), value in sorted_pieces:
        if place == END:
            yield (*value, digest.hexdigest())
            digest = hashlib.sha256()
        else:
            digest.update(unpacked.decompress(value))


def _texts(sorted_pieces: Iterator[tuple]) -> Iterator[tuple]:
    head, parts = None, []
    for _, position, value in _pieces(sorted_pieces):
        if position < 0:
            if head is not None:
                yield head[0], head[2], "".join(parts)
            head, parts = value, []
        else:
            parts.append(value)
    if head is not None:
        yield head[0], head[2], "".join(parts)


def _tasks(df: DataFrame) -> int:
    """Shuffle partitions that follow the texts' size; nothing re-plans them at run time as it would a DataFrame's."""
    size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def assemble(df: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> RDD:
    """The outputs' pieces, those of one row together and in order.

    Keys are (row, position), values compressed UTF-8; position -1 holds (doc_id, n, form).
    """
    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).rdd
    return rows.mapPartitionsWithIndex(_emit(salt, chunk)).repartitionAndSortWithinPartitions(_tasks(df), _by_row)


def outputs(df: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``form`` and the transformed text as ``output``."""
    found = assemble(df, salt, chunk).mapPartitions(_texts)
    return df.sparkSession.createDataFrame(found, "doc_id long, form string, output string", verifySchema=False)


def digests(df: DataFrame, salt: str = SALT, chunk: int = CHUNK) -> DataFrame:
    """Per row the form, the sections' sizes and the digests of output and restored text."""
    put_out = assemble(df, salt, chunk)
    again = put_out.mapPartitions(_first_digest, preservesPartitioning=True)
    restored = again.repartitionAndSortWithinPartitions(put_out.getNumPartitions(), _by_row).mapPartitions(_second_digest)
    return df.sparkSession.createDataFrame(restored, RESULT, verifySchema=False)
