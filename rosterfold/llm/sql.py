"""SQL for DuckDB of the queries that plain SQL can express."""

from __future__ import annotations

#: What each byte alone leaves of a CRC-32 register, as a list.
CRC_TABLE = """(SELECT list(list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b)
        FROM range(256) AS bytes(b))"""


def crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; ``crcs`` is the list of ``CRC_TABLE``."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen({text})),
        lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))),
        lambda c, x: xor(c >> 8, crcs[xor(c, x) % 256 + 1])), 4294967295)"""


RESAMPLING = rf"""
    WITH tables AS (SELECT {CRC_TABLE} AS crcs),
    texts AS (SELECT row_number() OVER () AS row, doc_id, true AS own, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, false, text FROM benchmark),
    cut AS (SELECT row, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
    places AS (SELECT row, own, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
    runs AS (SELECT row, own, array_to_string(w[i : i + n - 1], ' ') AS f FROM places, range(1, 4) AS sizes(n) WHERE i + n - 1 <= len(w)),
    counted AS (SELECT row, own, f, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT f, {crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), tables),
    features AS (SELECT row, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
    sums AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM features GROUP BY bucket),
    gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE)
        / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS gain FROM sums),
    weighed AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN gains USING (bucket) WHERE own GROUP BY row),
    scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score,
        CAST(len(w) AS BIGINT) AS n_words FROM cut LEFT JOIN weighed USING (row) WHERE own),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
        count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS many FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= many THEN place END AS rank, n_words FROM drawn"""


def encoded(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(map(encoded, ("doc_id", "source", "lang", "n_chars", text))) + "))"


MANIFEST = f"""
    WITH RECURSIVE tables AS (SELECT {CRC_TABLE} AS crcs),
    leaves AS (SELECT row_number() OVER () AS row, doc_id, source, {leaf('text')} AS leaf,
        CASE WHEN {crc("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS tampered FROM documents, tables),
    placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n FROM leaves),
    nodes AS (SELECT 0 AS lev, src, i, n, leaf AS d FROM placed
        UNION ALL SELECT lev + 1, src, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lev, src, i // 3, n),
    subroots AS (SELECT src, lev AS height, d AS subroot FROM nodes WHERE n = 1),
    upper_nodes AS (SELECT 0 AS lev, src AS i, count(*) OVER () AS n, subroot AS d FROM subroots
        UNION ALL SELECT lev + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY lev, i // 3, n),
    steps AS (SELECT row, lev AS step, string_agg(d, '' ORDER BY s.i) FILTER (s.i < p.i // 3 ** lev) AS l, string_agg(d, '' ORDER BY s.i) FILTER (s.i > p.i // 3 ** lev) AS r
        FROM placed p JOIN nodes s ON s.src = p.src AND s.n > 1 AND s.i // 3 = p.i // 3 ** (lev + 1) GROUP BY row, lev
        UNION ALL SELECT row, height + lev, string_agg(d, '' ORDER BY s.i) FILTER (s.i < p.src // 3 ** lev), string_agg(d, '' ORDER BY s.i) FILTER (s.i > p.src // 3 ** lev)
        FROM placed p JOIN subroots USING (src) JOIN upper_nodes s ON s.n > 1 AND s.i // 3 = p.src // 3 ** (lev + 1) GROUP BY row, height, lev),
    folds AS (SELECT row, 0 AS step, tampered AS d FROM placed
        UNION ALL SELECT row, step + 1, sha256(concat(l, d, r)) FROM folds JOIN steps USING (row, step)),
    proofs AS (SELECT row, sha256(string_agg(concat(l, r), '' ORDER BY step)) AS proof FROM steps GROUP BY row),
    last_folds AS (SELECT row, arg_max(d, step) AS folded_root FROM folds GROUP BY row)
    SELECT doc_id, leaf, subroot, d AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = d AS verified
    FROM placed JOIN subroots USING (src) JOIN last_folds USING (row) LEFT JOIN proofs USING (row), upper_nodes WHERE upper_nodes.n = 1"""
MANIFEST = MANIFEST.replace("3 ** (lev + 1)", "CAST(pow(3, lev + 1) AS BIGINT)").replace("3 ** lev", "CAST(pow(3, lev) AS BIGINT)")

VECTORS = """
    WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    usable AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors WHERE label IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.row AS a, b.row AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.row <> b.row
        WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
    reach AS (SELECT row AS a, row AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS row, min(vec_id) AS component_id FROM reach JOIN vectors ON vectors.row = b GROUP BY a),
    counted AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM vectors JOIN least USING (row) LEFT JOIN counted USING (row)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SHINGLES = rf"""
    WITH RECURSIVE texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (SELECT DISTINCT row, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
        UNION ALL SELECT row, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
    sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
    met AS (SELECT x.row AS a, y.row AS b, count(*) AS o FROM shingles x JOIN shingles y USING (s) WHERE x.row <> y.row GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
    reach AS (SELECT row AS a, row AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS row, min(doc_id) AS component_id FROM reach JOIN texts ON texts.row = b GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM texts JOIN least USING (row) LEFT JOIN sizes USING (row)"""
