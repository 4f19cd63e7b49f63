"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sitesift.llm import chat, negatives, secrets

_BLANK = "[\\x20\\x09-\\x0D]+"

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(
    range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT d.doc_id, COUNT(g) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, MIN(b) AS b FROM reach GROUP BY 1),
named AS (SELECT n.doc_id, n.n, LEAST(n.doc_id, COALESCE(r.b, n.doc_id)) AS root FROM n LEFT JOIN roots r ON r.a = n.doc_id)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM named
"""


def _escaped(text: str) -> str:
    doubled = f"replace(coalesce({text}, ''), '\\', '\\\\')"
    angled = f"regexp_replace({doubled}, '<(\\||/?s>)', '<\\\\\\1', 'g')"
    return f"regexp_replace({angled}, '\\[(/?INST\\])', '[\\\\\\1', 'g')"


CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(COALESCE(SUM(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(length({_escaped('r')}) + length({_escaped('t')}) + {len(chat.START + chat.SEP + chat.END)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(number: int, pattern: str, shortest: int, group: int = 0) -> str:
    p = _quoted(pattern)
    return f"""SELECT row, {number} AS kind, s, s + length(f) AS e, f FROM (
  SELECT row, f, j, SUM(length(gap) + length(f)) OVER (PARTITION BY row ORDER BY i) - length(f) AS s FROM (
    SELECT row, generate_subscripts(f, 1) AS i, unnest(f) AS f, unnest(regexp_extract_all(text, {p}, {group})) AS j,
      unnest(regexp_split_to_array(text, {p})[1:len(f)]) AS gap FROM (
      SELECT row, text, regexp_extract_all(text, {p}) AS f FROM d))) WHERE length(j) >= {shortest}"""


_LIMIT = "CASE " + " ".join(
    f"WHEN regexp_matches(f, {_quoted(p)}) THEN {secrets.most_sum(b)}" for p, b in secrets.CLASSES) + " END"

SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_found(0, secrets.ASSIGN, 6, 2)} UNION ALL {_found(1, secrets.ACCESS, 20)} UNION ALL {_found(2, secrets.HEX, 24)}),
runs AS (SELECT * FROM ({_found(3, secrets.RUN, secrets.WINDOW)}) WHERE NOT regexp_matches(f, {_quoted(secrets.ALLOWED)})),
windows AS (SELECT row, s, f, unnest(range(0, length(f) - {secrets.WINDOW - 1})) AS k FROM runs),
hot AS (SELECT row, s AS run, s + k AS s FROM windows WHERE list_sum(list_transform(list_distinct(string_split(substr(f, CAST(k + 1 AS BIGINT), {secrets.WINDOW}), '')),
  lambda c: CAST(round(({secrets.WINDOW} - length(replace(substr(f, CAST(k + 1 AS BIGINT), {secrets.WINDOW}), c, '')))
    * log2({secrets.WINDOW} - length(replace(substr(f, CAST(k + 1 AS BIGINT), {secrets.WINDOW}), c, ''))) * 1000000) AS BIGINT))) <= {_LIMIT}),
opened AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY row, run ORDER BY s) + {secrets.WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot),
islands AS (SELECT *, SUM(fresh) OVER (PARTITION BY row, run ORDER BY s) AS island FROM opened),
every AS (SELECT row, kind, s, e FROM base UNION ALL
  SELECT row, 3, MIN(s), MAX(s) + {secrets.WINDOW} FROM islands GROUP BY row, run, island),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS text FROM every)
SELECT d.doc_id, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex,
  COUNT(*) FILTER (kind = 3) AS n_entropy, sha256(COALESCE(string_agg(n.text, ',' ORDER BY s, kind, e) FILTER (kind < 3), '')) AS base_sha256,
  COALESCE(string_agg(n.text, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN named n ON n.row = d.row GROUP BY d.row, d.doc_id
"""


_C = negatives.DEFAULT

NEGATIVES = f"""
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % {_C.moved_step} = 0 THEN (label + 1) % {_C.labels} ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor({negatives.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {_C.anchor_step} = 0),
best AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {_C.positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER g AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM best JOIN pairs USING (anchor_id) WHERE NOT alike
  AND {_C.low} * positive_score <= 100 * score AND 100 * score <= {_C.high} * positive_score
WINDOW g AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER g <= {_C.negatives}
"""


def _terms(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM {table}"


LEXICAL = f"""
WITH tf AS (SELECT doc_id, t, COUNT(*) AS tf FROM ({_terms("documents", "doc_id")}) GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(SUM(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
total AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS len FROM sizes),
df AS (SELECT t, COUNT(*) AS df FROM tf GROUP BY 1),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
long AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // len) AS m FROM sizes, total),
asked AS (SELECT DISTINCT item_id, t FROM ({_terms("benchmark", "item_id")})),
scored AS (SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN long USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER g AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW g AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER g <= 50
"""
