"""DuckDB statements of the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NGRAMS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\f\r]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END)) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT n.doc_id, n.n AS n_shingles, min(reach.seen) AS component_id
FROM n JOIN reach ON reach.node = n.doc_id GROUP BY ALL
"""

_CONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m,
    unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0
), h AS (
  SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p))
), f AS (
  SELECT h.doc_id, h.k, h.m, p.item_id FROM h JOIN p ON p.g = h.g AND p.m = h.m
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM f) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM f GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_PASSAGES = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), h AS (
  SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)
), early AS (
  SELECT g, min(doc_id) AS least FROM h GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM h JOIN early USING (g) WHERE least < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_TAKEN = "len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _clustering(clusters: int = 16, dims: int = 64, rounds: int = 3, seed: int = 1) -> str:
    """Rounds written out: assignment, then sums of each component."""
    near = f"""
  SELECT p.*, c.k, list_sum(list_transform(range(1, {dims} + 1), lambda d: (p.v[d] - c.v[d]) * (p.v[d] - c.v[d]))) AS dist
  FROM p JOIN c{{0}} c ON true QUALIFY row_number() OVER (PARTITION BY p.place ORDER BY dist, c.k) = 1"""
    steps = [
        f"""p AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_TAKEN.format(dims=dims)}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (
    SELECT sha256('{seed}:' || vec_id) AS h, v FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters})
)"""
    ]
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({near.format(k)}
), m{k} AS (
  SELECT k, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{k}) GROUP BY k, d
), c{k + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT k, list(x ORDER BY d) AS v FROM m{k} GROUP BY k) n ON n.k = c.k
)""")
    return f"""
WITH {", ".join(steps)}, a AS MATERIALIZED ({near.format(rounds)}
)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance,
  CAST(sum(dist) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON c.k = a.k
"""


_NEGATIVES = f"""
WITH p AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_TAKEN.format(dims=64)}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, 65), lambda d: a.v[d] * b.v[d])) AS BIGINT) AS score
  FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), near AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

def sharding(limit: int = 64 << 20, bits: int = 60) -> str:
    """Bytes of every prefix of every length; a row's shard is its first that fits."""
    return f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {bits // 4}) AS BIGINT) AS hash
  FROM documents
), n AS MATERIALIZED (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY doc_id, bytes, hash) - 1 AS copy FROM r
), s AS (
  SELECT depth, hash >> ({bits} - depth) AS prefix, sum(bytes) AS held
  FROM n, (SELECT unnest(range({bits} + 1)) AS depth) GROUP BY ALL
), f AS (
  SELECT k, min(depth) AS depth FROM n, s WHERE s.held <= {limit} AND s.prefix = n.hash >> ({bits} - s.depth) GROUP BY k
), a AS (
  SELECT n.doc_id, bytes AS size_bytes, CAST(coalesce(depth, {bits}) AS INTEGER) AS shard_depth,
    CAST(hash >> ({bits} - coalesce(depth, {bits})) AS BIGINT) AS shard_prefix,
    CASE WHEN depth IS NULL THEN CAST(copy // greatest(1, {limit} // greatest(bytes, 1)) AS BIGINT) ELSE 0 END AS page
  FROM n LEFT JOIN f ON f.k = n.k
)
SELECT *, CAST(sum(size_bytes) OVER (PARTITION BY shard_depth, shard_prefix, page) AS BIGINT) AS shard_bytes FROM a
"""


_MIX = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT key, CAST(sum(size) AS HUGEINT) AS words, [5, 2, 1][CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY key
), o AS (
  SELECT *, row_number() OVER (ORDER BY words * (10 // weight), key) AS place FROM s
), l AS (
  SELECT *, sum(words) OVER () - 3 * coalesce(sum(words) OVER before, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS among
  FROM o WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT place, held, among FROM l WHERE weight * held <= 3 * words * among ORDER BY place LIMIT 1
), t AS (
  SELECT key, CAST(words AS BIGINT) AS words,
    CASE WHEN l.place < e.place THEN CAST(3 * words AS DOUBLE) ELSE CAST(weight * e.held AS DOUBLE) / CAST(e.among AS DOUBLE) END AS target
  FROM l, e
), g AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // words ELSE 0 END AS whole FROM t
), p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * words AS rest FROM g
), q AS (
  SELECT key, u, drawn, n, sum(drawn) OVER (PARTITION BY key ORDER BY u) AS upto
  FROM (SELECT key, u, sum(size) AS drawn, count(*) AS n FROM d GROUP BY key, u)
), c AS (
  SELECT key, u AS cut, (rest - upto + drawn) // n AS part FROM q JOIN p USING (key) WHERE upto > rest AND upto - drawn <= rest
)
SELECT doc_id, size, words AS source_size, target,
  CAST(whole * size + CASE WHEN u < coalesce(cut, -1) THEN size WHEN u = cut THEN least(part, size) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN p USING (key) LEFT JOIN c USING (key)
"""

_LINES = r"""
WITH x AS (
  SELECT DISTINCT doc_id, text FROM documents
), y AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM x
), l AS MATERIALIZED (
  SELECT doc_id, text, place, CAST(coalesce(doc_id, 9223372036854775807) AS HUGEINT) * 4294967296 + place AS spot,
    list_sort(list_distinct(regexp_extract_all(lower(line), '[^ \t\n\x0B\f\r]+'))) AS words
  FROM y WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), c AS MATERIALIZED (
  SELECT array_to_string(words, ' ') AS class, words, len(words) AS n, min(spot) AS spot FROM l GROUP BY words
), w AS MATERIALIZED (
  SELECT class, n, unnest(words) AS word FROM c
), f AS (
  SELECT word, count(*) AS n FROM w GROUP BY word
), o AS (
  SELECT class, w.n, word, row_number() OVER (PARTITION BY class ORDER BY f.n, word) AS pos FROM w JOIN f USING (word)
), p AS MATERIALIZED (
  SELECT class, n, word FROM o WHERE pos <= n - (80 * n + 99) // 100 + 1
), m AS (
  SELECT DISTINCT a.class AS a, b.class AS b FROM p a JOIN p b USING (word) WHERE a.class <> b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), s AS (
  SELECT m.a AS class, min(y.spot) AS other
  FROM m JOIN c x ON x.class = m.a JOIN c y ON y.class = m.b
  WHERE 180 * len(list_intersect(x.words, y.words)) >= 80 * (x.n + y.n) GROUP BY m.a
), e AS (
  SELECT c.words, least(spot, coalesce(other, spot)) AS earliest FROM c LEFT JOIN s USING (class)
), g AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (spot > earliest) AS n_removed,
    string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (spot > earliest) AS removed
  FROM l JOIN e USING (words) GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.text = d.text
"""

STATEMENTS: dict[str, str] = {
    "op2_sharding": sharding(),
    "op3_mixing": _MIX,
    "op4_ngram_join": _NGRAMS,
    "op6_decontaminate": _CONTAMINATION,
    "op7_substring_dedup": _PASSAGES,
    "op8_line_dedup": _LINES,
    "op11_clustering": _clustering(),
    "op13_negatives": _NEGATIVES,
}
