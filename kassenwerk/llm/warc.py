"""WARC archives: writing pages, and reading records by a verified boundary chain.

Writing is a plain text sink: a row holds a record's header and block, and the sink's line
separator is the blank lines that end a record.

Reading cuts the archives at every line that looks like the start of a record, wherever it
stands. Each task names, for every such candidate, the offset at which its successor has to
start by its content length. Only candidates that a chain from the file's first byte reaches
are records; magic inside a payload is never reached and belongs to the record before it.
The chain is followed inside a split by its task, and from split to split by pointer
jumping, in as many rounds as the logarithm of a file's splits.

Null payloads are written as empty ones. Repeated pages give a record each; of equal
payloads the one with the smallest id is kept in full, rows that share that id too. A page
without id is written and read back with a null id and is never referred to while another
page has that payload. An empty table gives an empty archive and an empty result. Columns beyond id,
url and payload are not written.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kassenwerk.session import written

CRLF = "\r\n"
MAGIC = "WARC/1.1"
RECORD_END = CRLF + CRLF
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"

_CHUNK = (
    "file string, block long, at long, size long, next long, leaves long, record_type string, uri string, "
    "record_id string, refers_to_id string, digest string, length long, whole boolean, body_bytes long, body_digest string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with digest, size and the page that holds their payload, if it is another.

    The first page of a payload is found by a partial aggregate on the digest, so that a
    payload that a third of the pages share moves as one row per task.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("body"),
        base32_sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    firsts = told.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_first"))
    again = (F.col("bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    # Only narrow rows meet on the digest. The revisits among them are written, so that
    # Catalyst knows their size when it joins them to the pages: payloads move only if it has to.
    revisits = (
        told.select("page_id", "digest", "bytes")
        .join(firsts, F.col("digest") == F.col("_digest"))
        .filter(again)
        .select(F.col("page_id").alias("_page"), F.xxhash64("digest").alias("_key"), F.col("_first").alias("refers_to"))
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.xxhash64("digest") == F.col("_key"))
    return told.join(written(revisits, "revisits"), same, "left").drop("_page", "_key")


def _record() -> Column:
    """Header and block of one record."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    # A header value must not end its line.
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(RECORD_END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(MAGIC + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One archive per task, uncompressed so that readers can split it."""
    records_of(pages, min_bytes).select(_record().alias("value")).write.option("lineSep", RECORD_END).text(path)


def _fields(header: bytes) -> dict[bytes, bytes]:
    fields = {}
    for line in header.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def _body_at(block: bytes, fields: dict[bytes, bytes]) -> int:
    """Where the payload begins in a record's block: behind the HTTP header, if it holds one."""
    if b"http" not in fields.get(b"content-type", b""):
        return 0
    return block.find(b"\r\n\r\n") + 4 if b"\r\n\r\n" in block else 0


def _digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


class _Split:
    """Cuts one split into candidates; the split's first byte is offset 0 here."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.at, self.rows = file, block, 0, []

    def add(self, chunk: bytes, head: int) -> None:
        """A chunk runs from behind one magic line to the line break before the next one.

        ``head`` is the length of the separator before it, 0 at the start of a file.
        """
        row = dict.fromkeys([c.split()[0] for c in _CHUNK.split(", ")])
        # A record starts at its magic line, the line break before it is the last record's.
        at = self.at + head - len(MAGIC + CRLF) if head else self.at
        row.update(file=self.file, block=self.block, at=at, size=len(chunk) + head, whole=False)
        # The line break that begins the next magic line may be the last byte of a blank line.
        end = (chunk + b"\n").find(b"\r\n\r\n")
        if head and end >= 0:
            fields = _fields(chunk[:end])
            length = fields.get(b"content-length", b"")
            if length.isdigit() and len(length) < 19 and b"warc-type" in fields:
                said = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
                block_at, length = end + 4, int(length)
                block = chunk[block_at : block_at + length]
                # A block that magic lines cut is measured when its pieces are together.
                whole = len(block) == length
                body = block[_body_at(block, fields) :] if whole else b""
                row.update(
                    next=self.at + head + block_at + length + len(RECORD_END),
                    record_type=said(b"warc-type"), uri=said(b"warc-target-uri"), record_id=said(b"warc-record-id"),
                    refers_to_id=said(b"warc-refers-to"), digest=said(b"warc-payload-digest"), length=length, whole=whole,
                    body_bytes=len(body) if whole else None,
                    body_digest=_digest(body) if whole else None,
                )
        self.at += len(chunk) + head
        self.rows.append(row)

    def done(self) -> list[dict]:
        """Follows each candidate's chain to the first offset at or behind the split's end."""
        leaves: dict[int, int | None] = {}
        for row in reversed(self.rows):
            step = row["next"]
            # A step into the split that hits no candidate ends the chain.
            row["leaves"] = leaves[row["at"]] = step if step is None or step >= self.at else leaves.get(step)
        return self.rows


def _separator() -> str:
    # No proper prefix of it is also a suffix of one, so a reader that gives up a partial
    # match at a buffer's edge cannot miss the next one.
    return "\n" + MAGIC + CRLF


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at each magic line, with the split each piece was read from."""
    return (
        spark.read.option("lineSep", _separator())
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("chunk"),
        )
    )


def _walk_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _CHUNK.split(", ")])
    sep, split = len(_separator()), None

    def out(done: _Split) -> Iterator[pa.RecordBatch]:
        rows = done.done()
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema)

    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for file, block, chunk in zip(files, blocks, batch.column(2), strict=True):
            if split is None or (split.file, split.block) != (file, block):
                if split is not None:
                    yield from out(split)
                split = _Split(file, block)
                first = block == 0
            chunk = chunk.as_py()
            if first:
                # The file starts with the magic line itself, without a line break before it.
                magic = (MAGIC + CRLF).encode()
                head = len(magic) if chunk.startswith(magic) else 0
                split.add(chunk[head:], head)
                first = False
            else:
                split.add(chunk, sep)
    if split is not None:
        yield from out(split)


def _placed(chunks: DataFrame) -> DataFrame:
    """Offsets from the file's start: a split begins where the bytes before it end."""
    sums = chunks.groupBy("file", "block").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).drop("_bytes")
    return chunks.join(bases, ["file", "block"])


def _entries(placed: DataFrame) -> DataFrame:
    """The candidate at which the chain from the file's start enters each split, if it does.

    Pointer jumping over the chains' exits: each round doubles how many splits a pointer
    spans. Only candidates that some chain can enter at take part.
    """
    start = F.col("_base") + F.col("at")
    exit_ = F.col("_base") + F.col("leaves")
    exits = placed.filter("leaves IS NOT NULL").select("file", exit_.alias("off")).distinct()
    hops = placed.select("file", "block", "at", start.alias("off"), exit_.alias("to"))
    hops = written(hops.join(exits.unionByName(hops.filter("off = 0").select("file", "off")).distinct(), ["file", "off"], "left_semi"), "hops")
    splits = placed.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    reached = hops.filter("off = 0").select("file", "off")
    jump = hops.filter("to IS NOT NULL").select("file", "off", "to")
    for _ in range(math.ceil(math.log2(splits)) if splits > 1 else 0):
        further = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        reached = written(reached.unionByName(further).distinct(), "reached")
        then = jump.select("file", F.col("off").alias("to"), F.col("to").alias("_to"))
        jump = written(jump.join(then, ["file", "to"]).select("file", "off", F.col("_to").alias("to")), "jump")
    return hops.join(reached, ["file", "off"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("_entry"))


def _mark(key: tuple, table: pa.Table) -> pa.Table:
    """Follows the chain through one split from its entry."""
    at, step = table.column("at").to_pylist(), table.column("next").to_pylist()
    follow = dict(zip(at, step, strict=True))
    entry = next((e for e in table.column("_entry").to_pylist() if e is not None), None)
    seen = set()
    while entry is not None and entry in follow and entry not in seen:
        seen.add(entry)
        entry = follow[entry]
    return table.append_column("record", pa.array([a in seen for a in at], pa.bool_()))


def index_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, header fields, and size and SHA-1 of the payload it holds.

    ``pieces`` tells into how many pieces magic lines in its payload cut a record;
    ``stored_bytes`` and ``stored_digest`` are of the payload as read.
    """
    placed = _placed(written(_chunks(spark, path).mapInArrow(_walk_splits, _CHUNK), "chunks"))
    with_entry = placed.join(_entries(placed), ["file", "block"], "left")
    names = [*with_entry.columns, "record"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_entry.schema) + ", record boolean"
    # Records' own pieces and those of their payloads; a window over one file's narrow rows.
    marked = with_entry.groupBy("file", "block").applyInArrow(_mark, schema).select(*names)
    place = F.col("_base") + F.col("at")
    along = Window.partitionBy("file").orderBy(place)
    owned = marked.withColumn("_place", place).withColumn(
        "_owner", F.last(F.when(F.col("record"), F.col("_place")), ignorenulls=True).over(along)
    )
    index = written(owned.filter("_owner IS NOT NULL").drop("_entry", "next", "leaves"), "index")
    cut = index.filter("record AND NOT whole")
    records = index.filter("record").withColumn("pieces", F.lit(1).cast("long"))
    if not cut.isEmpty():
        records = records.filter("whole").unionByName(_joined(spark, path, index, cut))
    return records.select(
        "file", F.col("_place").alias("offset"), "record_type", "uri", "record_id", "refers_to_id", "digest", "length",
        F.col("body_bytes").alias("stored_bytes"), F.col("body_digest").alias("stored_digest"), "pieces",
    )


def _joined(spark: SparkSession, path: str, index: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from their pieces.

    The archives are read again for the pieces of these records only. A group is one record.
    """
    pieces = index.join(cut.select("file", F.col("_place").alias("_owner")), ["file", "_owner"], "left_semi")
    bytes_ = _chunks(spark, path).mapInArrow(_bodies, "file string, block long, at long, chunk binary")
    told = "file string, _place long, pieces long, body_bytes long, body_digest string"
    chunks = pieces.select("file", "block", "at", "_place", "_owner").join(bytes_, ["file", "block", "at"])
    whole = chunks.groupBy("file", "_owner").applyInArrow(_put_together, told)
    return cut.drop("pieces", "body_bytes", "body_digest").join(whole, ["file", "_place"])


def _put_together(key: tuple, table: pa.Table) -> pa.Table:
    """Payload of one record from its pieces; both headers end where they do in the whole record."""
    table = table.sort_by("_place")
    record = _separator().encode().join(table.column("chunk").to_pylist())
    end = record.find(b"\r\n\r\n")
    fields = _fields(record[:end])
    block = record[end + 4 : end + 4 + int(fields[b"content-length"])]
    body = block[_body_at(block, fields) :]
    columns = [key[0].as_py(), key[1].as_py(), table.num_rows, len(body), _digest(body)]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["file", "_place", "pieces", "body_bytes", "body_digest"]
    return pa.table([pa.array([c], t) for c, t in zip(columns, types, strict=True)], names=names)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their places in their splits, as ``_walk_splits`` counts them."""
    sep, now, at = len(_separator()), None, 0
    for batch in batches:
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places, chunks = [], []
        for file, block, chunk in zip(files, blocks, batch.column(2), strict=True):
            chunk = chunk.as_py()
            head = sep
            if (file, block) != now:
                now, at = (file, block), 0
                if block == 0:
                    magic = (MAGIC + CRLF).encode()
                    head = len(magic) if chunk.startswith(magic) else 0
                    chunk = chunk[head:]
            places.append(at + head - len(MAGIC + CRLF) if head else at)
            chunks.append(chunk)
            at += len(chunk) + head
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.int64()), pa.array(chunks, pa.binary())],
            ["file", "block", "at", "chunk"],
        )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive of pages, revisits with the payload of what they refer to.

    ``payload_digest`` is that of the payload read, ``stated_digest`` the header's; ``verified`` tells whether
    they agree. A revisit whose payload is not there has neither size nor digest.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([0-9-]+)>$', 1) AS BIGINT)")
    told = index_warc(spark, path).select(
        page("record_id").alias("page_id"),
        "record_type",
        page("refers_to_id").alias("refers_to"),
        "stored_bytes",
        "stored_digest",
        F.regexp_replace("digest", "^sha1:", "").alias("stated_digest"),
        "file",
        "offset",
    )
    held = (
        told.filter("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("stated_digest").alias("_stated"))
        .agg(F.max("stored_bytes").alias("_bytes"), F.max_by("stored_digest", "stored_bytes").alias("_digest"))
    )
    revisit = F.col("record_type") == "revisit"
    own = lambda there, here: F.when(revisit, F.col(there)).otherwise(F.col(here))
    return told.join(held, revisit & (F.col("stated_digest") == F.col("_stated")), "left").select(
        "page_id",
        own("_bytes", "stored_bytes").alias("payload_bytes"),
        own("_digest", "stored_digest").alias("payload_digest"),
        "record_type", "refers_to", "stated_digest",
        F.when(~revisit, F.col("stored_digest") == F.col("stated_digest")).alias("verified"),
        "file", "offset",
    )
