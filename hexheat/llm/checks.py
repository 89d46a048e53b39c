"""SQL with the same answers as the queries, for those that SQL can express on whole tables.

Written from the definitions: every window, gram, pair and match is listed and compared.
"""

from __future__ import annotations

from hexheat.llm.collocations import COVERED, LEAST, TOP
from hexheat.llm.licences import DRIFT, GRAM, NOTICES, PHRASES, SHARE, WORD
from hexheat.llm.secrets import KINDS, LIVE_OWNERS, LIVE_REPOSITORIES

CHECKS: dict[str, str] = {}

CHECKS["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i, h FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM w),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM s) WHERE owner < doc_id),
marked AS (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50)::INT, 1) AS new FROM gone),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n, count(*) AS runs, max(b) AS upto,
                string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * upto + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def grouped(nodes: str, links: str, id_name: str, root_name: str) -> str:
    """Links and least reachable id of each node, from CTEs of ids and of both directions of links."""
    return f"""
reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a)
SELECT i AS {id_name}, (SELECT count(*) FROM {links} WHERE a = i) AS n_links,
       coalesce(least(i, (SELECT min(b) FROM reach WHERE a = i)), i) AS {root_name},
       coalesce(least(i, (SELECT min(b) FROM reach WHERE a = i)), i) = i AS kept
FROM {nodes}"""


CHECKS["op2_ngram_join"] = r"""
WITH RECURSIVE nodes AS (SELECT doc_id AS i FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 10 * c >= 8 * (s.n + t.n - c)),""" + grouped(
    "nodes", "links", "doc_id", "class_id"
)

CHECKS["op6_lattice_join"] = """
WITH RECURSIVE nodes AS (SELECT vec_id AS i FROM embeddings),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 93e-2),""" + grouped("nodes", "links", "vec_id", "component_id")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences() -> str:
    rows = []
    for n, (text, label, base) in enumerate([(t, x, True) for t, x in PHRASES.items()] + [(t, x, False) for t, x in NOTICES.items()]):
        w = text.split(" ")
        rows += [f"({n}, {i}, {len(w) - GRAM + 1}, '{label}', {base}, '{' '.join(w[i:i + GRAM])}')" for i in range(len(w) - GRAM + 1)]
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(template, tpos, n_grams, label, base, gram) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all({low}, {quoted(WORD)}) AS w FROM documents),
g AS (SELECT doc_id, k - 1 AS pos, w[k] || ' ' || w[k + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS k FROM w)),
hits AS (SELECT doc_id, template, n_grams, label, base, pos - tpos AS d, pos, tpos FROM g JOIN t USING (gram)),
exact AS (SELECT doc_id, label, true AS is_base, min(pos) AS first, 1e0 AS score FROM hits WHERE base
          GROUP BY doc_id, template, n_grams, label, d HAVING count(DISTINCT tpos) = n_grams),
diagonals AS (SELECT DISTINCT doc_id, template, d FROM hits WHERE NOT base),
cut AS (SELECT *, coalesce((d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) > {DRIFT})::INT, 1) AS new FROM diagonals),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY d) AS run FROM cut),
near AS (SELECT doc_id, label, false AS is_base, min(pos) AS first, count(DISTINCT tpos) / n_grams AS score
         FROM hits JOIN runs USING (doc_id, template, d) GROUP BY doc_id, template, n_grams, label, run
         HAVING count(DISTINCT tpos) >= {SHARE} * n_grams),
found AS (SELECT * FROM exact UNION ALL SELECT * FROM near),
by_doc AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(first) FILTER (is_base) AS first_word, max(first) FILTER (is_base) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
                  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN by_doc USING (doc_id)
"""


CHECKS["op5_licence_scan"] = _licences()


def _secrets() -> str:
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        found.append(f"""
    SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(g[1:k], lambda x: length(x)))::BIGINT
           + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)::BIGINT AS a, length(m[k]) AS n, v[k] AS value
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k
          FROM (SELECT doc_id, source, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_extract_all(t, {quoted(pattern)}, {group}) AS v,
                       string_split_regex(t, {quoted(pattern)}) AS g FROM d))
    WHERE length(v[k]) >= {least}""")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
owned AS (SELECT value, count(DISTINCT coalesce(source, '<null>')) <= {LIVE_OWNERS} AND count(DISTINCT doc_id) <= {LIVE_REPOSITORIES} AS live
          FROM f GROUP BY value),
s AS (SELECT doc_id, rank, kind, a, kind || ':' || a || ':' || (a + n) AS span, live FROM f JOIN owned USING (value)),
by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
                  string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3 OR live) AS spans, count(*) FILTER (live) AS n_live,
                  count(*) FILTER (NOT live) AS n_copied FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live,
       coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN by_doc USING (doc_id)
"""


CHECKS["op8_secret_scan"] = _secrets()

CHECKS["op9_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = min(doc_id) OVER g, false) AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, a bit at a time: after each byte eight steps, marked by -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295)"


CHECKS["op11_periodic_runs"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({crc32("doc_id::VARCHAR")}, 1) AS h,
                  list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, h // 10 % greatest(len(w), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END)
             ELSE w END AS w FROM p),
words AS (SELECT k, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
pairs AS (SELECT x.k, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.k = y.k AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
islands AS (SELECT k, p, i, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM pairs),
stretches AS (SELECT k, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY k, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT k, start, length, min(p) AS period FROM stretches GROUP BY k, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length / period DESC, start, period) = 1),
lines AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS rest FROM words ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM t LEFT JOIN lines USING (k) LEFT JOIN best USING (k) LEFT JOIN rest USING (k)
"""

CHECKS["op12_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(x, '[^ \t]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a
      FROM (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM pieces, (VALUES (1), (2), (3)) AS v(k)) GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
parts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM parts)),
scored AS (SELECT u.lang, u.phrase, u.a, s.a AS l, t.a AS r, u.c, (1000000::HUGEINT * u.a * u.a // (s.a::HUGEINT * t.a))::BIGINT AS score
           FROM cuts u JOIN f s ON s.lang = u.lang AND s.phrase = u.x JOIN f t ON t.lang = u.lang AND t.phrase = u.y
           QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.c) = 1),
longer AS (SELECT lang, inner_phrase AS phrase, max(a) AS longest
           FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase FROM parts WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer o USING (lang, phrase) WHERE o.longest IS NULL OR 100 * o.longest < {COVERED} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
