"""Best-fit packing of token sequences.

Documents are cut into pieces of at most ``capacity`` tokens, and the pieces are
range-sorted by size over many tasks, which gives each one its rank among the pieces of its
size. Sizes and gaps are whole numbers up to ``capacity``, and pieces of one size, like gaps
of one width, are interchangeable. A round therefore matches a whole size class: its
successor sweep takes the narrowest gaps that are wide enough, the r-th piece of the class
gets the r-th of them (which settles conflicts), and the narrowed gaps go back for the next
round. The rounds only need the counts per size, at most ``capacity`` numbers however many
documents there are, so they run in one loop; Spark counts and ranks the pieces, and each task
then finds its pieces' places by size and rank.

Null and empty texts are one piece with the end id alone. Repeated rows are packed each;
ties in size are ordered by id and piece, nulls first. An empty table gives no rows. Columns other
than id and text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassenwerk.operators.numbering import number_within
from kassenwerk.session import written

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# The rules of tokenizers whose words can be encoded one by one.
WORD_RULES = {
    "normalizer": '{"type":"Sequence","normalizers":[{"type":"NFC"},{"type":"Replace","pattern":{"Regex":"\\\\s+"},"content":" "},{"type":"Lowercase"}]}',
    "pre_tokenizer": (
        '{"type":"Sequence","pretokenizers":[{"type":"Split","pattern":{"Regex":'
        '"\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"},"behavior":"Removed","invert":true},'
        '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":false}]}'
    ),
}
# Those rules for words of printable ASCII and the letters of Latin-1, which have no marks to compose.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _byte_signs() -> dict[int, int]:
    """The signs by which a byte-level model writes bytes: their own if printable, else those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


class WordIds(dict):
    """Token ids of words between spaces, as little-endian bytes, kept for the words seen last.

    A tokenizer with ``WORD_RULES`` works on each word alone, because it drops white space and
    nothing that it does reaches across it. Its model is asked once per word instead of once
    per occurrence. Other tokenizers encode whole texts.
    """

    MOST = 800_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        self.by_word = all(told.get(name) == json.loads(rule) for name, rule in WORD_RULES.items()) and not told.get("post_processor")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        if _LATIN(word):
            # Normal form, lower case and letters are Python's here, and each byte has its own sign.
            parts = _LATIN_PARTS(word.lower())
            if not word.isascii():
                parts = [p.encode().decode("latin-1").translate(_BYTE_SIGNS) for p in parts]
        else:
            normal = self.tokenizer.normalizer.normalize_str(word)
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        value = self[word] = b"".join([self.parts.get(p) or self._part(p) for p in parts])
        return value

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= self.MOST:
            self.parts.clear()
        ids = self.parts[part] = struct.pack("<%dI" % len(found := self.model.tokenize(part)), *[t.id for t in found])
        return ids

    def encoded(self, text: str) -> bytes:
        """As the tokenizer encodes a text: one that spells out an added token has its single id there."""
        if self.by_word and not any(token in text for token in self.added):
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_WORDS: dict[str, WordIds] = {}  # one for each worker process, for all its tasks


def _tokenized(path: str | None, capacity: int, with_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = path
        if here is None:
            import public_tokenizers

            here = public_tokenizers.path(TOKENIZER)
        if here not in _WORDS:
            _WORDS[here] = WordIds(here)
        step = 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _WORDS[here].encoded(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    row = (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return run


def pieces(df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is a path that all workers reach; unset, each takes its own copy of the default one.
    """
    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_tokenized(tokenizer, capacity, with_ids), PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (size, first rank, pieces, first sequence, offset): runs of ranks in runs of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    widths: list[int] = []
    opened = 0

    def leave(width: int, first: int, n: int) -> None:
        if width:
            if width not in gaps:
                gaps[width] = []
                insort(widths, width)
            gaps[width].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(widths, size)
            if at == len(widths):
                break
            width = widths[at]
            first, n = gaps[width].pop()
            take = min(n, left)
            if take < n:
                gaps[width].append((first + take, n - take))
            if not gaps[width]:
                del gaps[width], widths[at]
            runs.append((size, rank, take, first, capacity - width))
            leave(width - size, first, take)
            rank, left = rank + take, left - take
        fit = capacity // size
        for each, n in ((fit, left // fit), (left % fit, 1)):
            if each and n:
                runs += [(size, rank + i * n, n, opened, i * size) for i in range(each)]
                leave(capacity - each * size, opened, n)
                rank, opened = rank + each * n, opened + n
    return np.array(runs, np.int64).reshape(-1, 5)


def _placed(runs: np.ndarray):
    """Finds each piece's run by size and rank; ``runs`` has few rows for any number of pieces."""
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else np.zeros(0, np.int64)
    runs = runs[order]
    keys = (runs[:, 0].astype(np.uint64) << np.uint64(48)) + runs[:, 1].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.uint64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64) - 1
            found = runs[np.searchsorted(keys, (size << np.uint64(48)) + rank.astype(np.uint64), "right") - 1]
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                [n for n in batch.schema.names if n != "_rank"] + ["sequence_id", "offset"],
            )

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with their sequence and their place in it."""
    cut = written(pieces(df, capacity, tokenizer, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = number_within(cut, ["length"], ["doc_id", "piece"], "_rank")
    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(counts, capacity)), schema)
