"""DuckDB SQL of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

import string

# crc32 of a list of bytes, by the table of its reversed polynomial
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i)) x)"""


def _crc(data: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)")


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"


# code points up to U+00FF as UTF-8 bytes
_LATIN = """flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128
            THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))"""

VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, COUNT(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS r FROM documents) x GROUP BY 1, 2),
hashed AS (
  SELECT run, c, {_crc(f"list_concat({_ascii('doc_id || chr(58)')}, {_LATIN})")} AS h
  FROM runs, crc_table),
words AS (
  SELECT word, CAST(SUM(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word, c FROM hashed) x
  WHERE length(word) >= 7 GROUP BY word HAVING SUM(c) >= 2),
holes AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words) x),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
near AS (SELECT word, COUNT(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, other, m FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS rn FROM pairs) x WHERE rn = 1),
forms AS (
  SELECT w.word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


def _field(value: str) -> str:
    return f"COALESCE(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# levels of all trees, then what stands beside each node's ancestors
_TREE = """{p}nodes AS (
  SELECT 0 AS lev, tree, i, h, n FROM {p}leaves
  UNION ALL
  SELECT lev + 1, tree, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM {p}nodes WHERE n > 1 GROUP BY lev, tree, i // 3),
{p}steps AS (
  SELECT tree, place, lev, COALESCE(string_agg(h, '' ORDER BY i) FILTER (WHERE i < here), '') AS l,
         COALESCE(string_agg(h, '' ORDER BY i) FILTER (WHERE i > here), '') AS r
  FROM (SELECT x.tree, x.i AS place, y.lev, y.i, y.h, x.i // CAST(power(3, y.lev) AS BIGINT) AS here
        FROM {p}leaves x JOIN {p}nodes y ON y.tree = x.tree AND y.n > 1
         AND y.i // 3 = x.i // CAST(power(3, y.lev + 1) AS BIGINT)) z
  GROUP BY tree, place, lev)"""

MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf('text')} AS leaf,
         CASE WHEN {_crc(_ascii('CAST(doc_id AS VARCHAR)'))} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS checked
  FROM documents, crc_table),
leaves AS (
  SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, leaf AS h,
         COUNT(*) OVER (PARTITION BY tree) AS n, doc_id, checked FROM docs),
{_TREE.format(p="")},
top_leaves AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, COUNT(*) OVER () AS n, tree AS name
  FROM nodes WHERE n = 1),
{_TREE.format(p="top_")},
paths AS (
  SELECT x.doc_id, s.lev, s.l, s.r FROM leaves x JOIN steps s ON s.tree = x.tree AND s.place = x.i
  UNION ALL
  SELECT x.doc_id, 1000 + s.lev, s.l, s.r FROM leaves x JOIN top_leaves t ON t.name = x.tree
  JOIN top_steps s ON s.place = t.i),
proofs AS (
  SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY lev)) AS proof_sha256, list(l || '|' || r ORDER BY lev) AS way
  FROM paths GROUP BY doc_id),
folded AS (
  SELECT x.doc_id, x.h AS leaf, t.h AS subroot, (SELECT h FROM top_nodes WHERE n = 1) AS root,
         COALESCE(p.proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(x.checked, COALESCE(p.way, [])),
                     lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM leaves x JOIN top_leaves t ON t.name = x.tree LEFT JOIN proofs p ON p.doc_id = x.doc_id)
SELECT *, folded_root = root AS verified FROM folded"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, COALESCE({_WORDS.format(text='text')}, []) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
windows AS (
  SELECT doc_id, k, array_to_string(ws[k + 1:k + 50], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS k FROM docs WHERE len(ws) >= 50) x),
repeats AS (
  SELECT doc_id, k, MIN(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM windows),
judged AS (
  SELECT w.doc_id, w.i, w.w, COALESCE(MAX(CAST(r.again AS INTEGER)) OVER (
           PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM words w LEFT JOIN repeats r ON r.doc_id = w.doc_id AND r.k = w.i)
SELECT d.doc_id, COUNT(j.i) AS n_words, CAST(COALESCE(SUM(CAST(j.gone AS INTEGER)), 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(string_agg(j.w, ' ' ORDER BY j.i) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id"""

# smallest id that is reached by links, from links (a, b) both ways
_REACH = """reach AS (
  SELECT id, id AS r FROM ids
  UNION
  SELECT reach.id, l.b FROM reach JOIN links l ON l.a = reach.r),
classes AS (SELECT id, MIN(r) AS component_id FROM reach GROUP BY id)"""

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, COALESCE({_WORDS.format(
      text=f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")}, []) AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[k + 1:k + 5], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS k FROM docs WHERE len(ws) > 0) x),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents),
{_REACH}
SELECT d.doc_id, COALESCE(z.n, 0) AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN classes c ON c.id = d.doc_id"""

NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
          ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings),
{_REACH},
counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT c.id AS vec_id, COALESCE(n, 0) AS n_links, component_id, c.id = component_id AS kept
FROM classes c LEFT JOIN counts ON counts.a = c.id"""

BYTE_STRINGS = """
WITH docs AS (SELECT doc_id, encode(COALESCE(text, '')) AS b, strlen(COALESCE(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, k, array_slice(b, k + 1, k + 200) AS win
  FROM (SELECT doc_id, b, unnest(range(n - 199)) AS k FROM docs WHERE n >= 200) x),
repeats AS (SELECT doc_id, k, COUNT(*) OVER (PARTITION BY win) > 1 AS again FROM windows),
bytes AS (SELECT doc_id, i, hex(array_slice(b, i + 1, i + 1)) AS x
          FROM (SELECT doc_id, b, unnest(range(n)) AS i FROM docs) y),
judged AS (
  SELECT w.doc_id, w.i, w.x, COALESCE(MAX(CAST(r.again AS INTEGER)) OVER (
           PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM bytes w LEFT JOIN repeats r ON r.doc_id = w.doc_id AND r.k = w.i),
edges AS (SELECT *, gone AND NOT COALESCE(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM judged)
SELECT d.doc_id, COUNT(e.i) AS n_bytes, CAST(COALESCE(SUM(CAST(e.gone AS INTEGER)), 0) AS BIGINT) AS n_removed,
       CAST(COALESCE(SUM(CAST(e.begins AS INTEGER)), 0) AS BIGINT) AS n_spans,
       sha256(unhex(COALESCE(string_agg(e.x, '' ORDER BY e.i) FILTER (WHERE NOT e.gone), ''))) AS kept_sha256
FROM docs d LEFT JOIN edges e ON e.doc_id = d.doc_id GROUP BY d.doc_id"""

SQL = {"op2_super_kmer_dedup": SUBSTRINGS, "op3_subspace_near_dedup": NEAR_VECTORS, "op8_difference_cover_dedup": BYTE_STRINGS,
       "op10_partitioned_jaccard": JACCARD, "op11_pivotal_variants": VARIANTS, "op13_butterfly_manifest": MANIFEST}
