"""Merkle manifest of a table of documents, with proofs that fold back to the root.

A row's leaf is the hash of its columns. Per source the leaves ascend by id; ``FAN`` consecutive
nodes (a last run has fewer) become one node of the next level, until one is left: the source's
subroot. The subroots, ordered by source, are the leaves of one more tree, whose last node is the root.

A level is a sibling-shift self-join: every node names the numbers of its run's slots, its own number
shifted by slot offsets, and meets the nodes of those numbers by an equi-join. What it
gathers is its step of the proof: the digests left and right of it. Rows of slot zero then hash
their run into the parent. The trees of all sources climb together, one written table a level, as
many levels as the largest source needs; a tree that is down to one node waits. Proofs are put together
from the top: a node's path is its own step followed by its parent's path, so that each level
meets only the one above.

Leaves are numbered by a range sort with offsets, and nodes are joined on their tree and number, so a source
with most of the rows is spread over all tasks. Rows that share source and id are ordered by
their leaf; rows without id come first, as does the source null. Null and empty values differ ("-"
and "0:"). The only row of a table has an empty proof. An empty table gives an empty result.
Further columns are neither hashed nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kassenwerk.llm.texts import LOWER, UPPER
from kassenwerk.operators.numbering import number_within
from kassenwerk.session import written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:binary,right:binary>"
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above them


def leaf_of(columns: list[Column]) -> Column:
    """Hash of the values, each told apart from its neighbours by its length in bytes."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def _text(digests: Column) -> Column:
    """Digests kept as bytes, as lower-case hex text."""
    return F.lower(F.hex(digests))


def _up(number: str) -> Column:
    return F.floor(F.col(number) / FAN).cast("long")


def _numbered(hashed: DataFrame) -> DataFrame:
    """``hashed`` with tree (number of the source), nr (0, 1, ... in it) and last (the highest nr in it)."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"]
    placed = written(hashed.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()), "ordered").withColumn(
        "part", F.shiftright("seq", _ROW_BITS)
    )
    # One row for each source and sorted partition that it touches.
    pieces = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    whole = Window.partitionBy("source")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "source",
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"),
        (F.sum("n").over(whole) - 1).alias("last"),
    )
    sources = pieces.select("source", F.lit(0).alias("all")).distinct()
    trees = number_within(sources, ["all"], [F.col("source").asc_nulls_first()], "tree")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    pieces = pieces.alias("p").join(trees.alias("t"), same("p", "t")).select("p.*", (F.col("tree") - 1).alias("tree"))
    return placed.alias("r").join(pieces.alias("p"), same("r", "p") & (F.col("r.part") == F.col("p.part"))).select(
        *[F.col(f"r.{c}") for c in hashed.columns], "tree", (F.col("seq") + F.col("offset")).alias("nr"), "last"
    )


def _steps(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Each node with the digests of its run that stand left and right of it, and its columns ``keep``."""
    slot = lambda nr: F.pmod(F.col(nr), F.lit(FAN))
    asked = nodes.select("tree", "last", F.col("nr").alias("own"), *keep, F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("at"))
    # What a node keeps goes with one of its questions, digests come with the answers.
    kept = F.when(F.col("at") == slot("own"), F.struct(F.lit(0).alias("_"), *keep)).alias("kept")
    asked = asked.select("tree", "last", "own", "at", kept, (F.col("own") - slot("own") + F.col("at")).alias("nr")).filter("nr <= last")
    met = asked.join(nodes.select("tree", "nr", "digest"), ["tree", "nr"])
    runs = met.groupBy("tree", "last", "own").agg(
        F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"), F.first("kept", ignorenulls=True).alias("kept")
    )
    joined = lambda keep: F.aggregate(
        F.filter("run", keep), F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["digest"])
    )
    return runs.select(
        "tree",
        F.col("own").alias("nr"),
        "last",
        F.element_at(F.filter("run", lambda s: s["at"] == slot("own")), 1)["digest"].alias("digest"),
        joined(lambda s: s["at"] < slot("own")).alias("left"),
        joined(lambda s: s["at"] > slot("own")).alias("right"),
        *[F.col(f"kept.{c}").alias(c) for c in keep],
    )


def climb(leaves: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The levels' tables (tree, nr, last, digest, left, right), lowest first, and the roots (tree, digest, height).

    ``leaves``: tree, nr (0, 1, ... in each tree), last (its tree's highest nr), digest (bytes) and columns
    ``keep`` that stay with the lowest level. A tree of one leaf is in no level.
    """
    levels: list[DataFrame] = []
    nodes = leaves.select("tree", "nr", "last", "digest", *keep)
    highest = nodes.agg(F.max("last")).first()[0] or 0
    told = lambda: nodes.filter("last = 0").select("tree", "digest", F.lit(len(levels)).alias("height"))
    roots = told()
    while highest:
        level = written(_steps(nodes.filter("last > 0"), [] if levels else keep), "merkle")
        levels.append(level)
        run = F.concat(_text(F.col("digest")), _text(F.col("right"))).cast("binary")
        parents = level.filter(F.pmod("nr", F.lit(FAN)) == 0)
        nodes = parents.select("tree", _up("nr").alias("nr"), _up("last").alias("last"), F.unhex(F.sha2(run, 256)).alias("digest"))
        roots = roots.unionByName(told())
        highest //= FAN
    return levels, roots


def with_paths(leaves: DataFrame, keep: list[str], levels: list[DataFrame], roots: DataFrame, more: list[str]) -> DataFrame:
    """Each leaf's way up: tree, nr, digest, ``keep``, path (array of steps) and the columns ``more`` of its tree's root.

    ``roots``: tree, height, path (the way on from the root, empty for the topmost tree) and ``more``.
    """
    # Trees that end on a height have one node there, which no level holds.
    ends = lambda height: roots.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("nr"), "path", *more)
    here = F.concat(F.array(F.struct("left", "right").cast(STEP)), "path").alias("path")
    found = ends(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        above = found.withColumnRenamed("nr", "up")
        joined = levels[depth].withColumn("up", _up("nr")).join(above, ["tree", "up"])
        if depth:
            found = written(joined.select("tree", "nr", here, *more).unionByName(ends(depth)), "paths")
    alone = leaves.filter("last = 0").join(ends(0), ["tree", "nr"]).select("tree", "nr", "digest", *keep, "path", *more)
    return joined.select("tree", "nr", "digest", *keep, here, *more).unionByName(alone) if levels else alone


def fold(digest: Column, path: Column) -> Column:
    """The root, as hex text, that a digest in hex text and the siblings on its path give."""
    return F.aggregate(
        path, digest, lambda d, s: F.sha2(F.concat(_text(s["left"]), d, _text(s["right"])).cast("binary"), 256)
    )


def proof_text(path: Column) -> Column:
    """All siblings on a path, from the lowest level up and from left to right."""
    return F.array_join(F.transform(path, lambda s: _text(F.concat(s["left"], s["right"]))), "")


def manifest(df: DataFrame) -> DataFrame:
    """Per row: doc_id, source, leaf, tampered_leaf, subroot, root, path (array of steps).

    ``tampered_leaf`` is the leaf of the row with its text's A-Z lower-cased.
    """
    typed = df.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    columns = {c: F.col(c).cast("string") for c in FIELDS}
    lowered = columns | {"text": F.translate("text", UPPER, LOWER)}
    hashes = [leaf_of(list(c.values())) for c in (columns, lowered)]
    hashed = typed.select("doc_id", "source", F.unhex(hashes[0]).alias("leaf"), F.unhex(hashes[1]).alias("tampered_leaf"))
    leaves = written(_numbered(hashed), "leaves").withColumnRenamed("leaf", "digest")
    keep = ["doc_id", "source", "tampered_leaf"]
    levels, roots = climb(leaves, keep)
    subroots = written(roots, "subroots")
    trees = subroots.agg(F.max("tree")).first()[0]  # null for an empty table
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("nr"), F.lit(trees).cast("long").alias("last"), "digest")
    top_levels, top_root = climb(top, [])
    root = top_root.first()
    nothing = F.array().cast(f"array<{STEP}>").alias("path")
    ways = with_paths(top, [], top_levels, top_root.select("tree", "height", nothing), [])
    ways = ways.select(F.col("nr").alias("tree"), "path")
    subroots = written(subroots.withColumnRenamed("digest", "subroot").join(ways, "tree"), "paths")
    return with_paths(leaves, keep, levels, subroots, ["subroot"]).select(
        "doc_id",
        "source",
        _text(F.col("digest")).alias("leaf"),
        _text(F.col("tampered_leaf")).alias("tampered_leaf"),
        _text(F.col("subroot")).alias("subroot"),
        F.lit(bytes(root["digest"]).hex() if root else None).cast("string").alias("root"),
        "path",
    )
