"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS t FROM (SELECT *, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM again, (SELECT unnest(range(20)) AS i)),
word AS (SELECT doc_id, p, w[p + 1] AS x FROM (SELECT *, unnest(range(len(w))) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS r FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS t FROM (SELECT *, unnest(range(len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
again AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY t) > 1),
edge AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM again),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edge),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS e FROM run GROUP BY doc_id, k)
SELECT doc_id, count(*) AS n_spans, CAST(sum(e - a) AS BIGINT) AS n_repeated, string_agg(a || '-' || e, ' ' ORDER BY a) AS spans FROM span GROUP BY doc_id
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS t FROM (SELECT *, unnest(range(len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS t FROM (SELECT *, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
h AS (SELECT doc_id, count(DISTINCT s + j) AS n_hit FROM (SELECT doc_id, s, unnest(range(n)) AS j FROM m) GROUP BY 1),
g AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""

_OP8 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars,
regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS in_order
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM t) GROUP BY conv_id, alone
"""

#: The exact neighbours: equal to what the graphs find where these miss none.
_OP10 = """
WITH v AS (SELECT vec_id, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(v.e, q.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near) WHERE rank <= 10
"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_LEAF = "sha256(" + " || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = "list_transform(range(CAST((len(nodes) + 1) // 2 AS BIGINT)), lambda j: sha256(array_to_string(nodes[2 * j + 1:2 * j + 2], '')))"

#: A tree's levels are rows with lists; crc32 is worked out bit by bit, as there is no function for it.
_OP11 = f"""
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, {_LEAF.replace("{n}", "n_chars")} AS leaf, {_LEAF.replace("{n}", "(n_chars + 1)")} AS other,
    xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(8 * len(CAST(doc_id AS VARCHAR))), lambda i: (CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) ELSE 0 END)::UBIGINT),
      lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1::UBIGINT) * 3988292384::UBIGINT))) AS crc FROM documents),
  d AS (SELECT doc_id, lang, leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS start, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f),
  low AS (SELECT lang, 0 AS l, list(leaf ORDER BY pos) AS nodes FROM d GROUP BY lang UNION ALL SELECT lang, l + 1, {_UP} FROM low WHERE len(nodes) > 1),
  sub AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM low WHERE len(nodes) = 1),
  high AS (SELECT 0 AS l, list(subroot ORDER BY pos) AS nodes FROM sub UNION ALL SELECT l + 1, {_UP} FROM high WHERE len(nodes) > 1),
  steps AS (SELECT id, l, (pos >> l) & 1 AS odd, nodes[xor(pos >> l, 1) + 1] AS sibling FROM d JOIN low ON d.lang IS NOT DISTINCT FROM low.lang WHERE len(nodes) > 1
    UNION ALL SELECT id, 1000 + l, (sub.pos >> l) & 1, nodes[xor(sub.pos >> l, 1) + 1] FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang, high WHERE len(nodes) > 1),
  way AS (SELECT id, string_agg(sibling, '' ORDER BY l) AS proof, list((CASE WHEN sibling IS NULL THEN 'N' WHEN odd = 1 THEN 'L' ELSE 'R' END) || coalesce(sibling, '') ORDER BY l) AS steps FROM steps GROUP BY id),
  done AS (SELECT d.doc_id, d.leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([start] || coalesce(steps, []), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
    FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN way ON way.id = d.id)
SELECT *, folded_root = root AS verified FROM done
"""

_OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
  g AS (SELECT DISTINCT id, array_to_string(w[s + 1:s + least(5, len(w))], ' ') AS t FROM (SELECT *, unnest(range(greatest(1, len(w) - 4))) AS s FROM d WHERE len(w) > 0)),
  n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
  m AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g AS x JOIN g AS y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2),
  e AS (SELECT a, b FROM m JOIN n AS p ON p.id = a JOIN n AS q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
  both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  reach AS (SELECT id AS a, id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
  least_id AS (SELECT a AS id, min(doc_id) AS component_id FROM reach JOIN d ON d.id = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least_id USING (id) LEFT JOIN n USING (id)
"""

_OP13 = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
  least_id AS (SELECT text, min(doc_id) AS least FROM w GROUP BY 1),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
  m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 3 * length(w.text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask FROM w JOIN least_id ON least_id.text = w.text LEFT JOIN l ON l.doc_id = w.doc_id),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
  f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, bit)),
  o AS (SELECT a.x || b.x || p.x || q.x || r.x AS filter_order, [a.bit, b.bit, p.bit, q.bit, r.bit] AS bits FROM f AS a, f AS b, f AS p, f AS q, f AS r WHERE (a.bit | b.bit | p.bit | q.bit | r.bit) = 31),
  s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
  x AS (SELECT part, filter_order, step, bit, n, good, toxic, mask & bit <> 0 AS fails, mask & before <> 0 AS gone, mask = bit AS alone FROM c, s),
  z AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM z
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_suffix_array_dedup": _OP3, "op5_decontamination": _OP5, "op8_chat_formatting": _OP8, "op10_hnsw": _OP10, "op11_merkle_manifest": _OP11, "op12_odd_sketch_near_dedup": _OP12, "op13_filter_audit": _OP13}
