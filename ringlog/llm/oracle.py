"""DuckDB's SQL for those registered queries that it can express."""

#: CRC-32 of a text of ASCII characters, bit by bit, by the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(*names: str) -> str:
    return f"sha256({' || '.join(_field(name) for name in names)})"


OP12 = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, source,
           {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
           CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 2 = 0
                THEN {_leaf("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")}
           END AS altered
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS size,
           row_number() OVER () AS row
    FROM hashed
), lower_tree AS (
    SELECT source, 0 AS height, place, size, leaf AS hash FROM leaves
    UNION ALL
    SELECT source, height + 1, place // 3, (any_value(size) + 2) // 3,
           sha256(string_agg(hash, '' ORDER BY place))
    FROM lower_tree WHERE size > 1 GROUP BY source, height, place // 3
), tops AS (
    SELECT source, height, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place,
           count(*) OVER () AS size
    FROM lower_tree WHERE size = 1
), upper_tree AS (
    SELECT 0 AS height, place, size, hash FROM tops
    UNION ALL
    SELECT height + 1, place // 3, (any_value(size) + 2) // 3,
           sha256(string_agg(hash, '' ORDER BY place))
    FROM upper_tree WHERE size > 1 GROUP BY height, place // 3
), root AS (
    SELECT hash AS root FROM upper_tree WHERE size = 1
), steps AS (
    SELECT l.row, n.height,
           coalesce(string_agg(n.hash, '' ORDER BY n.place)
                    FILTER (n.place < l.place // (3 ** n.height)::BIGINT), '') AS before,
           coalesce(string_agg(n.hash, '' ORDER BY n.place)
                    FILTER (n.place > l.place // (3 ** n.height)::BIGINT), '') AS behind
    FROM leaves l JOIN lower_tree n
      ON n.source IS NOT DISTINCT FROM l.source AND n.size > 1
     AND n.place // 3 = l.place // (3 ** (n.height + 1))::BIGINT
    GROUP BY l.row, n.height
    UNION ALL
    SELECT l.row, t.height + n.height,
           coalesce(string_agg(n.hash, '' ORDER BY n.place)
                    FILTER (n.place < t.place // (3 ** n.height)::BIGINT), ''),
           coalesce(string_agg(n.hash, '' ORDER BY n.place)
                    FILTER (n.place > t.place // (3 ** n.height)::BIGINT), '')
    FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source
    JOIN upper_tree n
      ON n.size > 1 AND n.place // 3 = t.place // (3 ** (n.height + 1))::BIGINT
    GROUP BY l.row, t.height, n.height
), folds AS (
    SELECT row, 0 AS height, coalesce(altered, leaf) AS node FROM leaves
    UNION ALL
    SELECT f.row, f.height + 1, sha256(s.before || f.node || s.behind)
    FROM folds f JOIN steps s ON s.row = f.row AND s.height = f.height
), proofs AS (
    SELECT row, sha256(string_agg(before || behind, '' ORDER BY height)) AS proof
    FROM steps GROUP BY row
), ends AS (
    SELECT row, arg_max(node, height) AS folded FROM folds GROUP BY row
)
SELECT l.doc_id, l.leaf, t.hash AS subroot, root.root,
       coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root,
       e.folded = root.root AS verified
FROM leaves l JOIN tops t ON t.source IS NOT DISTINCT FROM l.source
JOIN ends e ON e.row = l.row LEFT JOIN proofs p ON p.row = l.row CROSS JOIN root
"""

OP11 = """
WITH part AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), rows AS (
    SELECT *, row_number() OVER () AS row FROM part
), scores AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, r.row, r.vec_id, a.label = r.label AS same,
           coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * r.v[k])), 0)
               ::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.row <> r.row AND len(a.v) = len(r.v)
), positives AS (
    SELECT * FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), pairs AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
           p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scores n
      ON n.anchor = p.anchor AND NOT n.same
     AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM pairs WHERE rank <= 5
"""

SQL = {"op11_negatives": OP11, "op12_merkle": OP12}
