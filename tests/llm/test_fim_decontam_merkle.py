"""Fill-in-middle, decontamination and the Merkle manifest against plain versions, with odd tables."""

import ast
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kassenwerk.llm import decontam, fim, merkle, registry
from kassenwerk.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, path string, tree long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i, f"Text {i} with SOME words, ünï ṁore & 漢字 {i * 7}\n", "en", f"s{i % 3}") for i in range(60)]
    rows += [(70, None, None, None), (71, "", "", ""), (72, "a <P> b", "de", "s1"), (72, "a <P> b", "de", "s1"), (72, "other", "de", "s1")]
    rows += [(None, "no id", "en", "s2"), (None, None, None, None), (73, "w" * 50_000 + " " + "é" * 40_000, "fr", "alone"), (-4, "<", None, "s0")]
    rows = [(*r, len(r[1] or "") if r[0] != 5 else None, 1, "clash", 2) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """The test tables as the registered queries read them."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [("7", "Text 7 with some words"), ("b", "SOME"), ("c", None), ("d", ".,"), ("e", "words, ünï ṁore 漢字"), (None, "no id"), ("f", "no ID")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fim_against_a_plain_version(spark, docs, tables):
    want = sorted(map(repr, (plain_fim(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())))
    assert sorted(repr(tuple(r)) for r in registry.queries()["op11_fim"](spark, tables).collect()) == want
    assert {r.split(", ")[2] for r in want} == {"'plain'", "'psm'", "'spm'"}
    # Pieces of any size give the same outputs, as digests and as texts.
    assert sorted(repr(tuple(r)) for r in fim.digests(docs, chunk=3).collect()) == want
    told = sorted((r.doc_id or 0, r.form, sha(r.output)) for r in fim.outputs(docs, chunk=7).collect())
    assert told == sorted((r.doc_id or 0, r.form, r.output_sha256) for r in fim.digests(docs).collect())


def test_fim_moves_its_pieces_once(docs):
    """The sort for the restoration reuses the first one's partitioning."""
    put_out = fim.assemble(docs)
    again = put_out.mapPartitions(fim._first_digest, preservesPartitioning=True)
    assert again.partitionBy(put_out.getNumPartitions(), fim._by_row) is again


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_decontamination(docs, items, size):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for name, item in items:
            w = plain_words(item)
            n = min(size, len(w))
            asked = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for at in range(len(words) - n + 1 if n else 0):
                if tuple(words[at : at + n]) in asked:
                    hit |= set(range(at, at + n))
                    found.add(name or "")
        out.append((doc_id, len(words), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(map(repr, out))


def told(df):
    rows = df.select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ",").alias("items"), "contaminated").collect()
    return sorted(repr(tuple(r)) for r in rows)


def test_decontamination_against_a_plain_version(spark):
    """Few different words, so that windows overlap, repeat and share their rare terms."""
    import random

    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("Ab c d E f-g h, i j Ünd ÜND 9".split()) for _ in range(n))
    docs = [(i, line(rng.randrange(0, 60))) for i in range(40)] + [(1, None), (2, ""), (None, line(30)), (3, "ab " * 50), (3, "ab " * 50)]
    items = [(f"i{i}", line(rng.randrange(0, 9))) for i in range(25)] + [("i3", line(4)), ("x", None), (None, line(3)), ("y", "ab"), ("z", "AB ab ab ab")]
    long = line(80)
    items += [("long", long), ("again", long)]
    docs += [(50, "start " + long[:90] + " . " + long[100:])]
    table = spark.createDataFrame([(*d, 1, 2, ["x"]) for d in docs], "doc_id long, text string, row long, pos long, words array<string>")
    asked = spark.createDataFrame([(*i, 3, "k") for i in items], "item_id string, text string, phrase long, k string")
    for size, settings in ((4, {}), (3, dict(segment=7)), (4, dict(block_terms=60)), (10, {})):
        assert told(decontam.decontaminate(table, asked, size, **settings)) == plain_decontamination(docs, items, size)
    assert told(decontam.decontaminate(table, asked.limit(0))) == plain_decontamination(docs, [], 10)
    assert decontam.decontaminate(table.limit(0), asked).count() == 0


def test_decontamination_query(spark, docs, tables):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = plain_decontamination([(r.doc_id, r.text) for r in docs.collect()], items, 10)
    rows = registry.queries()["op12_decontamination"](spark, tables).collect()
    hashed = sorted(repr((*x[:4], sha(x[4]), x[5])) for x in map(ast.literal_eval, want))
    assert sorted(repr(tuple(r)) for r in rows) == hashed
    assert {x[4] for x in map(ast.literal_eval, want)} >= {"", "7,b,e", ",f"}


def test_proximity_finds_what_exact_windows_miss(spark):
    words = [f"w{i}" for i in range(12)]
    texts = {1: words, 2: [*words[:5], "extra", *words[5:]], 3: [*words[:5], "other", *words[6:]], 4: words[::-1], 5: words[:6] + ["gap"] * 9 + words[6:]}
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    asked = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    exact = {r.doc_id for r in decontam.decontaminate(table, asked).filter("contaminated").collect()}
    near = {r.doc_id: (r.n_found, r.n_terms) for r in decontam.proximity_matches(table, asked).collect()}
    assert exact == {1} and set(near) == {1, 2, 3} and near[1] == (9, 9) and near[2] == (8, 9)


def plain_manifest(rows):
    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, lower=False):
        text = r.text if r.text is None or not lower else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        return sha("".join(map(told, (r.doc_id, r.source, r.lang, r.n_chars, text))))

    def tree(nodes):
        """Root, and each leaf's siblings as (left, right), lowest level first."""
        ways = [[] for _ in nodes]
        owners = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
            for run in runs:
                for i in run:
                    for o in owners[i]:
                        ways[o].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
            owners = [[o for i in run for o in owners[i]] for run in runs]
            nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
        return nodes[0], ways

    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), leaf(r, True), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    root, top = tree([p[0] for p in parts])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, other, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = parts[k][1][i] + top[k]
            shown = other if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else own
            for left, right in way:
                shown = sha(left + shown + right)
            out.append((r.doc_id, own, parts[k][0], root, sha("".join(a + b for a, b in way)), shown, shown == root))
    return sorted(map(repr, out))


def of_query(spark, folder):
    return sorted(repr(tuple(r)) for r in registry.queries()["op13_merkle"](spark, folder).collect())


def test_manifest_against_a_plain_version(spark, docs, tables):
    found = of_query(spark, tables)
    assert found == plain_manifest(docs.collect())
    assert any(r.endswith("False)") for r in found) and any(r.endswith("True)") for r in found)


@pytest.mark.parametrize("count", [0, 1, 17, 300])
def test_manifest_of_one_hot_source(spark, tmp_path, count):
    """Most rows share a source, others have one each: trees of several heights, a run of one node, no rows at all."""
    rows = [(i, f"Row {i}", "en", "hot" if i % 10 or count < 20 else f"s{i}", i) for i in range(count)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert of_query(spark, tmp_path) == (plain_manifest(table.collect()) if count else [])


def test_sql_of_the_new_queries(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    for name in ("op11_fim", "op12_decontamination"):
        found = con.execute(registry.oracle_sql()[name])
        names = [c[0] for c in found.description]
        ours = registry.queries()[name](spark, tables).select(*names).collect()
        assert sorted(repr(tuple(r)) for r in ours) == sorted(map(repr, found.fetchall()))


def test_empty_tables_give_empty_results(spark, docs):
    none = docs.limit(0)
    assert fim.digests(none).count() == 0 and fim.outputs(none).count() == 0 and merkle.manifest(none).count() == 0
