"""SQL twins of the queries that SQL can express over whole tables.

SQL for op5 takes minutes at a few megabytes of text; tests hold it against brute force instead.
"""

ORACLES: dict[str, str] = {}

ORACLES["op9_curriculum_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS hash
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([5.0, 2.0, 1.0])[(place % 3) + 1]::DOUBLE AS weight, ([0.5, 0.0, -0.5])[(place % 3) + 1]::DOUBLE AS tilt,
         2.0::DOUBLE * source_size AS cap
  FROM sources
), loaded AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS demand, sum(weight) OVER () AS whole,
         coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighted
  WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, (demand - cap_before) * weight > cap * (whole - weight_before) AS is_full FROM loaded
), shared AS (
  SELECT *, demand - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest,
         whole - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS open
  FROM filled
), targets AS (
  SELECT source, source_size, tilt, CASE WHEN is_full THEN cap ELSE rest * weight / open END AS target FROM shared
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.tilt, floor(t.target + 0.5)::BIGINT AS words,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT
           AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, greatest(0, least(size, words - start))::BIGINT AS once,
         greatest(0, least(size, words - source_size - start))::BIGINT AS again
  FROM placed
), shares AS (
  SELECT *, (start + once / 2.0::DOUBLE) / words AS share FROM copies
)
SELECT doc_id, size, source_size, target, once + again AS taken,
  CASE WHEN once > 0 THEN CASE WHEN tilt = 0 THEN share
    ELSE (1 + tilt - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)) / (2 * tilt) END END AS position
FROM shares
"""

ORACLES["op10_block_anchor_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)
), firsts AS (
  SELECT content, min(doc_id) AS first_doc FROM windows GROUP BY content
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM windows JOIN firsts USING (content) WHERE first_doc < doc_id
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

_REACH = """edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, root) AS (
  SELECT id, id FROM nodes UNION SELECT b, root FROM reach JOIN edges ON a = node WHERE root < b
), roots AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)"""

ORACLES["op6_bottom_k_near_dedup"] = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), nodes AS (
  SELECT doc_id AS id FROM documents
), {_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots JOIN texts ON doc_id = node LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op7_tiled_vector_dedup"] = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), nodes AS (
  SELECT vec_id AS id FROM embeddings
), {_REACH}, degree AS (
  SELECT a, count(*) AS n FROM edges GROUP BY a
)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept
FROM roots LEFT JOIN degree ON a = node
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''),
  lambda c: list_transform(range(8), lambda i: ((ascii(c) >> i::INTEGER) & 1)::BIGINT)))),
  lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)), 4294967295::BIGINT)"""

ORACLES["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first, count(*) AS n, {_CRC32.format(text="conv_id::VARCHAR")} % 6 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, t.p, role, text FROM convs c JOIN turns t ON t.conv_id = c.first AND t.p < c.h
  UNION ALL
  SELECT t.conv_id, t.p - c.h + least(c.h, coalesce(f.n, 0)), role, text
  FROM turns t JOIN convs c ON t.conv_id = c.conv_id LEFT JOIN convs f ON f.conv_id = c.first WHERE t.p >= c.h
), paths AS (
  SELECT c.conv_id, coalesce(list(strlen(role) || ':' || strlen(text) || ':' || role || text ORDER BY p) FILTER (p IS NOT NULL), []) AS path,
    coalesce(list(length(text) ORDER BY p) FILTER (p IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path, chars FROM paths
), members AS (
  SELECT conv_id, n, depth, array_to_string(path[1 : depth], '') AS node, array_to_string(path[1 : depth - 1], '') AS parent,
    coalesce(chars[depth], 0) AS chars
  FROM prefixes
), nodes AS (
  SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
    (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, node
), subtrees AS (
  SELECT above.depth, above.node, count(*) FILTER (below.longest = below.depth) AS n_leaves, sum(below.saved)::BIGINT AS saved_tokens
  FROM nodes below JOIN members above ON above.conv_id = below.conv_id AND above.depth <= below.depth
  GROUP BY above.depth, above.node
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
)
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, x.ends_sha256
FROM nodes x JOIN subtrees s ON s.depth = x.depth AND s.node = x.node
LEFT JOIN children c ON c.depth = x.depth AND c.node = x.node
LEFT JOIN nodes up ON up.depth = x.depth - 1 AND up.node = x.parent
"""


def _merkle_level(i: int) -> str:
    """Nodes of level i + 1 of each tree from those of level i; a node that is alone stays."""
    return f"""runs{i} AS (
  SELECT tree, place // 16 AS up, list(hash ORDER BY place) AS run FROM level{i} WHERE width > 1 GROUP BY ALL
), level{i + 1} AS (
  SELECT tree, up AS place, sha256(array_to_string(run, '')) AS hash, count(*) OVER (PARTITION BY tree) AS width FROM runs{i}
  UNION ALL SELECT tree, place, hash, width FROM level{i} WHERE width = 1
)"""


def _merkle(levels: int) -> str:
    """All proofs, of trees of up to 16 ** levels leaves over as many groups."""
    parts = [_merkle_level(i) for i in range(levels)]
    top = f"""level{levels + 1} AS (
  SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, hash, count(*) OVER () AS width FROM level{levels}
)"""
    above = [_merkle_level(i) for i in range(levels + 1, 2 * levels + 1)]
    way = ["climb0 AS (SELECT *, '' AS proof, coalesce(claimed, hash) AS folded, hash AS node FROM level0)"]
    for i in range(2 * levels + 1):
        if i == levels:
            # From the group roots to the leaves of the tree above.
            way.append(f"""climb{i + 1} AS (
  SELECT c.* REPLACE ('top' AS tree, t.place AS place, t.width AS width), t.hash AS subroot
  FROM climb{i} c JOIN (SELECT g.tree AS key, t.* FROM (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS at FROM level{levels}) g
    JOIN level{levels + 1} t ON t.place = g.at) t ON t.key = c.tree
)""")
            continue
        way.append(f"""climb{i + 1} AS (
  SELECT c.* REPLACE (
    CASE WHEN r.run IS NULL THEN place ELSE place // 16 END AS place,
    CASE WHEN r.run IS NULL THEN width ELSE (width + 15) // 16 END AS width,
    CASE WHEN r.run IS NULL THEN proof ELSE proof || array_to_string(run[1 : place % 16], '') || array_to_string(run[place % 16 + 2 :], '') END AS proof,
    CASE WHEN r.run IS NULL THEN folded
      ELSE sha256(array_to_string(run[1 : place % 16], '') || folded || array_to_string(run[place % 16 + 2 :], '')) END AS folded)
  FROM climb{i} c LEFT JOIN runs{i} r ON r.tree = c.tree AND r.up = c.place // 16 AND c.width > 1
)""")
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    rest = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _CRC32.format(text="coalesce(doc_id::VARCHAR, '')")
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce('+' || source, '') AS tree, sha256({rest} || {field("text")}) AS hash,
    CASE WHEN {crc} % 5 = 0 THEN sha256({rest} || {field(lower)}) END AS claimed
  FROM documents
), level0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS width FROM hashed
), {", ".join([*parts, top, *above, *way])}
SELECT doc_id, c.node AS leaf, subroot, r.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = r.hash AS verified
FROM climb{2 * levels + 1} c, level{2 * levels + 1} r
"""


ORACLES["op12_merkle_manifest"] = _merkle(5)
