"""DuckDB SQL of the training-data queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# crc32 of the id's digits: each byte is followed by its eight shifts, marked -1.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

OP11 = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n,
        ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
    FROM cut
), parts AS (
    SELECT doc_id, t, n,
        array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1:], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
            WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
    CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
asked AS (
    SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS words
    FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
), there AS (
    SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS words
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM asked) WHERE len(w) >= size)
), hits AS (SELECT r, k, size, item_id FROM there JOIN asked USING (size, words)),
covered AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, leaves: str, heights: int) -> list[str]:
    """Tables ``name``0, 1, ...: tree, nr, last, digest, and the digests of its run as left and right."""
    whole = "PARTITION BY tree, nr // 16 ORDER BY nr ROWS BETWEEN"
    joined = lambda frame: f"coalesce(string_agg(digest, '') OVER ({whole} {frame}), '')"
    steps = f"""SELECT tree, nr, last, digest, {joined("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS lft,
        {joined("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS rgt FROM"""
    tables = [f"{name}0 AS ({steps} {leaves})"]
    for h in range(1, heights + 1):
        tables.append(
            f"""{name}{h} AS ({steps} (
                SELECT tree, nr // 16 AS nr, last // 16 AS last, sha256(digest || rgt) AS digest
                FROM {name}{h - 1} WHERE nr % 16 = 0 AND last > 0 UNION ALL
                SELECT tree, nr, last, digest FROM {name}{h - 1} WHERE last = 0))"""
        )
    return tables


def _op13(heights: int = 6, top_heights: int = 4) -> str:
    """Enough for 16 ** 6 rows of a source and 16 ** 4 sources."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        f"hashed AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(lowered)} AS other, {_CRC32} AS crc FROM documents)",
        """leaves AS (SELECT doc_id, leaf AS digest, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS shown,
            dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nr,
            count(*) OVER (PARTITION BY source) - 1 AS last FROM hashed)""",
        *_tree("s", "leaves", heights),
        f"tops AS (SELECT 0 AS tree, tree AS nr, (SELECT max(tree) FROM leaves) AS last, digest FROM s{heights})",
        *_tree("t", "tops", top_heights),
    ]
    steps = [(f"s{h}", f"x.tree = s{h}.tree AND x.nr // {16**h} = s{h}.nr") for h in range(heights)]
    steps += [(f"t{h}", f"x.tree // {16**h} = t{h}.nr") for h in range(top_heights)]
    # Each step is a table, so that the text of the fold does not double with every level.
    chain = ["f0 AS (SELECT x.*, x.shown AS folded, '' AS proof FROM leaves x)"]
    for k, (name, on) in enumerate(steps):
        chain.append(
            f"""f{k + 1} AS (SELECT x.doc_id, x.digest, x.tree, x.nr, x.proof || {name}.lft || {name}.rgt AS proof,
            CASE WHEN {name}.last > 0 THEN sha256({name}.lft || x.folded || {name}.rgt) ELSE x.folded END AS folded
            FROM f{k} x JOIN {name} ON {on})"""
        )
    return (
        "WITH " + ",\n".join(tables + chain) + f"""
SELECT x.doc_id, x.digest AS leaf, s{heights}.digest AS subroot, t{top_heights}.digest AS root, sha256(x.proof) AS proof_sha256,
    x.folded AS folded_root, x.folded = t{top_heights}.digest AS verified
FROM f{len(steps)} x JOIN s{heights} USING (tree), t{top_heights}
"""
    )


# Five hexadecimal digits are four of base 32.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31), 1)), '')), '')"""

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
told AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
    CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN true END AS verified
FROM told
"""

# Shingles of all pairs of documents that share one: for small tables.
OP6 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""

ORACLE = {
    "op1_warc": OP1,
    "op6_neardup": OP6,
    "op11_fim": OP11,
    "op12_decontamination": OP12,
    "op13_merkle": _op13(),
}
