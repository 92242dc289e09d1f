"""The columns that contracts fix, of the queries as registered, against plain versions on generated texts."""

import hashlib
import random
import re
from collections import Counter

import pytest

from kassenwerk.llm import registry
from kassenwerk.session import ship_package

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
BITS = (
    "a.b@c-d.org;x@y;z@q.w.;1.2.3.4;255.256.1.1;10.0.0.255.;4111 1111 1111 1111;4111-1111-1111-1111;4111-1111-1111-1112;"
    "12345678901234567890;5500 0000 0000 0004;+41 44 555 01 02;+1(2)3;+49.30-123456789;mail;GB82WEST12345698765432;"
    "É;ß;#;*;$;%;&;<;>;|;!;ü@ä.de;0.0.0.0.0;++41791234567"
).split(";")


def texts():
    rng = random.Random(8)
    made = [rng.choice(["", " ", "\n", "-", ",", "\t"]).join(rng.choice(BITS) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    lines = [f"line {i % 4} of {i % 3} words" + " \x0b" * (i % 2) for i in range(40)]
    made += ["\n".join(rng.choice(lines) for _ in range(n)) for n in range(25)]
    made += [" ".join(rng.choice("a b c d e f g h".split()) for _ in range(n)) for n in range(40, 70)]
    return [None, "", " \n\t\x0b ", " ", "x" * 70_000, "7 " * 30_000, "\r\n\r\n", *made]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ship_package(spark)
    path = str(tmp_path_factory.mktemp("base"))
    rows = [(i if i % 9 else None, t, "en", "s", 0) for i, t in enumerate(texts())]
    rows += rows[3:6]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def luhn(digits):
    odd = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(odd)) % 10 == 0


def digits(text):
    return re.sub(r"[^0-9]", "", text)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def test_base_spans_of_personal_data(spark, folder):
    want, every = Counter(), Counter()
    for doc_id, text in rows_of(spark, folder):
        spans = [[(k, m.start(), m.end()) for m in re.finditer(p, text) if good(m.group())] for k, p, good in KINDS]
        told = ",".join(f"{k}:{a}:{b}" for kind in spans for k, a, b in kind)
        want[(doc_id, *map(len, spans), hashlib.sha256(told.encode()).hexdigest())] += 1
        every.update(k for kind in spans for k, _, _ in kind)
    found = registry.queries()["op2_pii"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    assert all(every[k] > 5 for k, _, _ in KINDS)
    for r in found:
        # The method's own spans come on top, the base ones stay.
        base = [s for s in r.spans.split(",") if s and not s.startswith("iban")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_base_counts_of_quality(spark, folder):
    want = Counter()
    for doc_id, text in rows_of(spark, folder):
        words = re.findall(f"[^{SPACE}]+", text)
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        want[(doc_id, len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed)] += 1
    found = registry.queries()["op3_quality"](spark, folder).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == want and not any(r.kept for r in found if r.base_failed)
    assert {k[-1] for k in want} == {True, False}
