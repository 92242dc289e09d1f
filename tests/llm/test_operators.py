"""Each operator on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import base64
import hashlib
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kassenwerk.llm import fingerprints, langid, lm, mixing, neardup, packing, pii, quality, toxicity, warc
from kassenwerk.llm.texts import in_fold
from kassenwerk.session import scratch_path, ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _tokens string, score string"
WORDS = "the of and to in that green river stone walks under bridge lamp seven quiet harbour over field".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + f" tail{seed}."


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(i, prose(i, 120), "en", "a") for i in range(8)]
    rows += [(20, prose(1, 120), "en", "a"), (21, None, None, None), (22, "", "en", "b"), (23, " \n\t ", "de", "b")]
    rows += [(None, prose(30, 90), "en", "c"), (24, "x" * 30_000 + " 12 34", None, "c"), (7, prose(7, 120), "en", "a")]
    rows += [(25, "Mail ab.c@d-e.org, 1.2.3.4 or 300.1.1.1; 4111 1111 1111 1111; +41 44 555 01 02 GB82WEST12345698765432", "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), True, "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    assert quality.judge(empty).count() == 0 and pii.find(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0 and packing.pack(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0 and lm.score(empty, in_fold("doc_id", 10, 0)).count() == 0
    assert langid.predict(empty, langid.train(empty, in_fold("doc_id", 4, 1))).count() == 0
    assert toxicity.score(empty, toxicity.NEUTRAL).count() == 0


def test_quality_counts_by_hand(spark):
    text = "a b c a b c\nx # y\n\nx # y\nsame same"
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (14, 20, 2, 1)
    words = text.split()
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert row.n_repeat_words == len(hit) and row.base_failed and not row.kept


def test_quality_keeps_clean_texts_of_any_length(spark):
    long = " ".join(f"the word{i}" for i in range(500_010))
    row = quality.judge(spark.createDataFrame([(1, long)], "doc_id long, text string")).drop("text").first()
    assert row.n_words == 1_000_020 and row.kept and row.broken_rules == []


def test_pii_spans_and_redaction(docs):
    found = {r.doc_id: r for r in pii.find(docs.select("doc_id", "text")).collect()}
    row = found[25]
    assert [(s.kind, row.text[s.start : s.end]) for s in row.pii_spans] == [
        ("email", "ab.c@d-e.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"),
        ("phone", "+41 44 555 01 02"), ("iban", "GB82WEST12345698765432"),
    ]
    assert found[21].pii_spans == [] and found[24].pii_spans == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[25] == "Mail <EMAIL>, <IP> or 300.1.1.1; <CARD>; <PHONE> <IBAN>" and clean[21] is None


def test_toxicity_learns_gapped_words(spark):
    rng = np.random.default_rng(3)
    texts = [prose(100 + i, 40) + (" " + rng.choice(["blockhead", "nincompoop"])) * (i % 2) for i in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(table, labels, ~in_fold("doc_id", 3, 1))
    scored = toxicity.score(table, model).collect()
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) == bool(r.predicted) for r in scored)
    plain, gapped, other = model.words(["blockhead", "blo.ckh.ead", "bridge"])
    assert plain >= gapped > other
    assert toxicity.train(table, labels.limit(0), in_fold("doc_id", 3, 1)) is toxicity.NEUTRAL


def test_toxicity_learns_from_texts_without_a_sure_word(spark):
    """No single word stands in more than one toxic text, so none is surely raised."""
    forms = ["blockhead", "blockheads", "blockheaded", "blockheadish", "blo.ckhead", "bl.ockhead", "blockhe.ad", "b.lockhead", "bloc.khead", "xblockhead"]
    texts = [prose(300 + i, 40) for i in range(80)] + [prose(500 + i, 40) + " " + w for i, w in enumerate(forms)]
    model = toxicity._learn(texts, np.arange(len(texts)) >= 80, 0.1)
    held_out = model.words(["blockheadz", "blockhead!", "bridge", "harbour"])
    assert [model.probability(v) >= 0.7 for v in held_out] == [True, True, False, False]


def test_lm_against_plain_counts(docs):
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").collect()
    tokens = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in rows]
    counts = Counter(t for i, ts in tokens if zlib.crc32(str(i).encode()) % 10 for t in ts)
    total, types = sum(counts.values()), len(counts)
    want = {i: sum(log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in ts) for i, ts in tokens}
    for r in lm.score(docs.filter("doc_id IS NOT NULL"), in_fold("doc_id", 10, 0)).collect():
        assert r.base_score == pytest.approx(want[r.doc_id]) and r.train_tokens == total and r.score <= 0


def test_log_bloom_never_understates():
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(977)
    counts = np.arange(4000) % 40
    levels = lm.LogBloom(keys, counts).levels(keys)
    exact = np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0)
    assert (levels >= exact).all() and (levels != exact).mean() < 0.05


def brute_components(sets, share):
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_near_duplicates_against_all_pairs(spark):
    ship_package(spark)
    base = [prose(i, 150).split() for i in range(3)]
    rows = []
    for i in range(40):
        words = list(base[i % 3])
        for k in range(i // 3):
            words[(k * 37 + i) % 150] = f"w{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(50, ""), (51, None), (52, "one"), (53, "ONE"), (54, prose(0, 150)), (54, prose(0, 150)), (None, "one")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets[i] = set(zip(w, w[1:], strict=False)) or ({tuple(w)} if w else set())
    want = brute_components(sets, 80)
    found = neardup.near_duplicates(table, size=2).collect()
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in found if r.doc_id is not None)
    assert [r.kept for r in found if r.doc_id is None] == [True] and len(found) == len(rows)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    odd = ["It's 1st ÉCOLE été İ ΣΑΣ a\x1cb", "", "naïve—co-op  \t x<|endoftext|>y", "漢字 kana", " \n", "e\u0301 \u0301e a'S 12'll"]
    odd += ["'t <|endoftext|>", "Ünï÷x ßÀÖØ×öøÿÞ ª²¾\xa0\x85\xad !~'Ré", *(f"x{chr(i)}É{chr(i)}9" for i in range(1, 0x250))]
    words = packing.WordIds(path)
    assert words.by_word
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in odd]
    assert [np.frombuffer(words.encoded(x), "<u4").tolist() for x in odd] == want
    words.by_word = False
    assert [np.frombuffer(words.encoded(x), "<u4").tolist() for x in odd] == want
    rows = packing.pack(docs, with_ids=True).collect()
    for r in rows:
        assert r.length == len(r.ids) // 4 <= 2048 and zlib.crc32(r.ids) == r.ids_crc32
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    text = docs.filter("doc_id = 24").first().text
    whole = b"".join(r.ids for r in sorted(rows, key=lambda r: r.piece) if r.doc_id == 24)
    assert np.frombuffer(whole, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_packing_of_spelt_out_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["x<|endoftext|>y", "<|startoftext|> a  b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> c", "plain"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack(table, with_ids=True).collect():
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == [*want, 0] and r.length == len(want) + 1


def test_plan_is_best_fit():
    runs = packing.plan({7: 3, 3: 5, 2: 2, 10: 1}, 10)
    assert sorted(runs[:, 2].tolist()) and runs[:, 2].sum() == 11
    assert 1 + max(s + n - 1 for _, _, n, s, _ in runs.tolist()) == 5  # 10 | 7 3 | 7 3 | 7 3 | 3 3 2 2


def test_fingerprints(docs):
    rows = docs.orderBy(docs.doc_id.asc_nulls_first(), "text").collect()
    found = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(found) == len(rows)
    for i, (row, got) in enumerate(zip(rows, found, strict=True)):
        changed = fingerprints.edited(row.text or "", rows[(i + 1) % len(rows)].text or "")
        assert got.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got.n_chars == len(row.text or "")
    same = {r.doc_id: r.fingerprint for r in found}
    assert same[1] == same[20] != same[2] and same[21] == same[22]
    a, b, c = fingerprints.sketches([prose(1, 400), "zz " + prose(1, 400), prose(2, 400)])[:, None]
    assert fingerprints.likeness(a, b)[0] > 0.8 > 0.4 > fingerprints.likeness(a, c)[0]


def test_fingerprints_of_rows_without_id_or_repeated(spark):
    """Neither gathers in one task, and each row has one successor."""
    ship_package(spark)
    rows = [(None if i % 3 else 5, prose(i % 40, 30) if i % 2 else "same") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    lined = []
    written, fingerprints.written = fingerprints.written, lambda df, label: lined.append(written(df, label)) or lined[-1]
    found = fingerprints.fingerprints(table).collect()
    fingerprints.written = written
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert lined[0].filter("edge = 'last'").count() == 6
    assert Counter((r.doc_id, r.n_chars) for r in found) == Counter((i, len(t)) for i, t in rows)
    follows = sum(r.near_next == 1 for r in found)
    assert follows >= len(rows) - len(set(rows))  # all but the last of each group of equal rows


def test_languages(spark, docs):
    texts = [("the harbour of the town", "en"), ("der hafen und die stadt", "de")]
    rows = [(i, (texts[i % 2][0] + " ") * 5, texts[i % 2][1]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, ~in_fold("doc_id", 4, 2))
    assert all(r.lang_pred == texts[r.doc_id % 2][1] and 0 <= r.score <= 1 for r in langid.predict(table, model).collect())
    und = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred == "und"}
    assert und == {21, 22, 23}


def test_mixing_meets_its_margins(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.p_keep <= 1 for r in rows)
    cells = spark.createDataFrame([("a", "x", "p", 60), ("a", "y", "p", 20), ("b", "x", "p", 5), ("b", "y", "p", 15)], "_source string, _lang string, _topic string, _tokens long")
    share = lambda m, d: spark.createDataFrame(list(d.items()), f"_{m} string, _{m}_share double")
    wanted = {"source": share("source", {"a": 0.5, "b": 0.5}), "lang": share("lang", {"x": 0.7, "y": 0.3}), "topic": share("topic", {"p": 1.0})}
    raked = mixing.rake(cells, wanted).collect()
    for key, value, want in (("_source", "a", 0.5), ("_lang", "x", 0.7)):
        assert sum(r._weight for r in raked if r[key] == value) == pytest.approx(want, abs=1e-3)


def test_mixing_draws_reach_the_wanted_shares(spark):
    """Short notes are too few for their tempered share of 80 % of the tokens."""
    sizes = [(s, g, t, n * m * k) for s, n in (("a", 4), ("b", 2)) for g, m in (("en", 4), ("de", 1)) for t, k in (("article", 40), ("list", 5), ("note", 1))]
    rows = [(i * 1000 + k, "w " * 10, s, g, t) for i, (s, g, t, n) in enumerate(sizes) for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string").coalesce(2)
    mixed = mixing.mix(table)
    told = {(r.margin, r.value): r for r in mixing.report(mixed).collect()}
    whole = sum(n for *_, n in sizes)
    for k, m in enumerate(mixing.MARGINS):
        own = Counter()
        for size in sizes:
            own[size[k]] += size[3]
        power = {v: n**0.7 for v, n in own.items()}
        for v, n in own.items():
            r = told[m, v]
            assert r.table_share == pytest.approx(n / whole) and r.wanted_share == pytest.approx(power[v] / sum(power.values()))
            assert r.expected_share == pytest.approx(r.wanted_share, abs=2e-3) and abs(r.drawn_share - r.wanted_share) < 0.05
    most = min(r.most_keep for r in told.values())
    assert most < mixing.KEEP_TOKENS and 0.9 * most <= told["topic", "note"].kept_share <= most
    # Targets that the table has tokens for leave the wished share as it is.
    own = {m: mixing.targets(table.groupBy(F.col(m).alias(f"_{m}")).agg((F.count("*") * 10).alias("_tokens")), m, 1.0) for m in mixing.MARGINS}
    assert mixing.report(mixing.mix(table, own), own).first().kept_share == pytest.approx(0.8, abs=1e-3)


def test_warc_round_trip(spark, monkeypatch):
    ship_package(spark)
    trap = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(1, "u1", "é one"), (2, "u\r\n2", trap), (3, None, None), (4, "u4", "é one"), (5, "u5", trap), (6, "u6", ""), (7, "u7", "x" * 5000)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for split in ("128m", "900b"):
        monkeypatch.setattr(warc, "DATE", "2026-01-01T00:00:00Z")
        path = scratch_path(spark, "test-warc")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        warc.write_warc(table.coalesce(1), path)
        rows = sorted(warc.read_pages(spark, path).collect(), key=lambda r: r.page_id)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        first = {}
        for (i, _, html), r in zip(pages, rows, strict=True):
            body = (html or "").encode()
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            origin = first.setdefault(digest, i)
            want = (i, len(body), digest, "response" if origin == i else "revisit", None if origin == i else origin)
            assert (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
            assert r.verified in (True, None)


@pytest.mark.parametrize("split", ["128m", "900b"])
def test_warc_payloads_of_magic_lines(spark, split):
    """Payloads that begin, end with and consist of what starts a record, also as copies and without id."""
    ship_package(spark)
    magic = "WARC/1.1\r\n"
    texts = [magic, "\n" + magic, "\r\n\r\n" + magic, magic * 3, "x\r\n" + magic, magic + "\r\n\r\n" + magic + "\n", "\r\n\r", "\n" + magic * 2 + "é"]
    pages = [(i, f"u{i}", t) for i, t in enumerate([*texts, *texts, None, ""])] + [(None, "u", magic)]
    path = scratch_path(spark, "test-warc")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    rows = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(pages)
    for i, _, html in pages:
        body = (html or "").encode()
        assert rows[i].payload_bytes == len(body) and rows[i].verified in (True, None)
        assert rows[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() == rows[i].stated_digest
    assert rows[len(texts)].refers_to == 0 and rows[None].refers_to == 0 and rows[0].refers_to is None


def test_warc_digest_is_that_of_the_bytes_read(spark):
    ship_package(spark)
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "whole text"), (2, "v", "whole text"), (3, "w", "other")], "page_id long, url string, html string").coalesce(1), path)
    harmed = scratch_path(spark, "test-warc")
    text = "\r\n\r\n".join(r.value for r in spark.read.option("lineSep", "\r\n\r\n").text(path).collect()).replace("whole text", "whole tent")
    spark.createDataFrame([(text,)], "value string").write.option("lineSep", "\r\n\r\n").text(harmed)
    rows = {r.page_id: r for r in warc.read_pages(spark, harmed).collect()}
    digest = base64.b32encode(hashlib.sha1(b"whole tent").digest()).decode()
    assert [rows[i].payload_digest == digest for i in (1, 2, 3)] == [True, True, False]
    assert [rows[i].verified for i in (1, 2, 3)] == [False, None, True] and rows[1].stated_digest != digest


def test_warc_header_longer_than_any_prefix(spark):
    ship_package(spark)
    trap = "<p>\nWARC/1.1\r\n</p>"
    pages = [(1, "u" * 70_000, trap), (2, "u2", trap)]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    rows = warc.read_pages(spark, path).collect()
    assert len(rows) == 2 and all(r.payload_bytes == len(trap) and r.verified in (True, None) for r in rows)


def test_pipeline_stages_keep_the_columns_of_documents(spark, docs):
    table, names = docs, ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, "")
        assert table.columns == names
    assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, table, "").columns
    good = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert good == {*range(8), 20, None}


def test_pipeline_keeps_different_texts_of_one_id(spark):
    a, b, c = prose(901, 120), prose(902, 120), prose(903, 120)
    rows = [(1, a, "en", "y", 9), (1, a, "en", "x", 9), (1, b, "en", "x", 9), (2, b + " end", "en", "x", 9), (3, c, "en", "x", 9), (None, c, "en", "x", 9), (None, c, "en", "x", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, table, "").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in kept) == Counter([(1, a, "x"), (1, b, "x"), (3, c, "x"), (None, c, "x"), (None, c, "x")])


def test_columns_named_like_helpers_stay(spark):
    """Whatever an input column is called, it comes back as it was."""
    text = "Write to a@b.ch: " + prose(3, 90)
    names = ["_made", "_w", "_l", "_s", "w", "_pii_spans", "__pii_spans", "_row", "_text", "PII_SPANS"]
    table = spark.createDataFrame([(1, text, *names)], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    judged = quality.judge(table).first()
    assert [judged[n] for n in names] == names and judged.n_words > 50
    assert [quality.keep_good(table).first()[n] for n in names] == names
    clean = pii.redact(table)
    assert clean.columns == table.columns and [clean.first()[n] for n in names] == names and "<EMAIL>" in clean.first().text


def test_rows_without_id_draw_each_for_themselves(spark):
    rows = [(None, f"w{i} " * 10, "en", s, "p") for i in range(400) for s in ("a", "b")] + [(None, "same " * 10, "en", "a", "p")] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    kept = Counter(r.kept for r in mixing.mix(table, keep=0.5).collect())
    assert 0.3 * len(rows) < kept[True] < 0.7 * len(rows)
