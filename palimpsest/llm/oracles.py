"""DuckDB SQL of the queries that SQL can express."""

#: Every query against every other vector; ties to the smaller id.
OP5 = """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
whole AS (SELECT vec_id, min(vec) AS vec FROM fine GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Levels of eight that the statement below can climb: groups of up to 8 ** 8 rows.
_CLIMB = 8


def _tree(prefix: str, leaves: str) -> str:
    """Levels `{prefix}0..` over a table (grp, pos, n, digest), and siblings `{prefix}s0..` of their nodes."""
    parts = [f"{prefix}0 AS ({leaves})"]
    for k in range(_CLIMB):
        parts.append(
            f"{prefix}s{k} AS (SELECT grp, pos, n, coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(digest, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r "
            f"FROM {prefix}{k} WINDOW r AS (PARTITION BY grp, pos // 8 ORDER BY pos))"
        )
        parts.append(
            f"{prefix}{k + 1} AS (SELECT grp, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) "
            f"ELSE max(digest) END AS digest FROM {prefix}{k} GROUP BY grp, pos // 8, n)"
        )
    return ",\n".join(parts)


def _climb(prefix: str, start: str, last: str) -> str:
    """Carries `proof` and `folded` of the rows of `start` (id, grp, pos) up the levels of a tree."""
    parts, at = [], start
    for k in range(_CLIMB):
        name = last if k == _CLIMB - 1 else f"{prefix}c{k}"
        parts.append(
            f"{name} AS (SELECT c.* REPLACE (c.proof || CASE WHEN s.n > 1 THEN s.l || s.r ELSE '' END AS proof, "
            f"CASE WHEN s.n > 1 THEN sha256(s.l || c.folded || s.r) ELSE c.folded END AS folded) "
            f"FROM {at} c JOIN {prefix}s{k} s ON c.grp = s.grp AND c.pos // {8**k} = s.pos)"
        )
        at = name
    return ",\n".join(parts)


def _framed(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


_FIELDS = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees of eight, the witness of every leaf, and the root that a tampered leaf leads to.
OP11 = f"""
WITH rest AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v
        FROM range(256) r(i))
),
checked AS (
    SELECT d.*, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
    FROM documents d, rest
),
leaves AS (
    SELECT doc_id, '+' || lang AS name, sha256({_FIELDS} || {_framed('text')}) AS leaf,
           CASE WHEN crc % 3 = 0 THEN sha256({_FIELDS} || {_framed(_LOW)}) ELSE sha256({_FIELDS} || {_framed('text')}) END AS tampered
    FROM checked
),
rows_ AS (
    SELECT doc_id, coalesce(name, '') AS grp, leaf, tampered,
           row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY name) AS n
    FROM leaves
),
{_tree('a', 'SELECT grp, pos, n, leaf AS digest FROM rows_')},
subroots AS (SELECT grp AS name, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM a{_CLIMB}),
{_tree('b', "SELECT '' AS grp, pos, n, subroot AS digest FROM subroots")},
low AS (SELECT doc_id, leaf, grp, pos, '' AS proof, tampered AS folded FROM rows_),
{_climb('a', 'low', 'risen')},
mid AS (SELECT r.doc_id, r.leaf, s.subroot, '' AS grp, s.pos, r.proof, r.folded FROM risen r JOIN subroots s ON r.grp = s.name),
{_climb('b', 'mid', 'top')}
SELECT t.doc_id, t.leaf, t.subroot, b.digest AS root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root, t.folded = b.digest AS verified
FROM top t, b{_CLIMB} b
"""

#: Every term of every group in full, then pairs of sources and the terms over their language's share.
OP13 = """
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
own AS (
    SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p FROM grid WINDOW g AS (PARTITION BY lang, source)
),
every AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS q FROM every WINDOW g AS (PARTITION BY lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN own x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN own y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
