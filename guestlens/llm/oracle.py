"""DuckDB SQL of the operators that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(FOLD)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""

_BENCH = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
WITH d AS (SELECT doc_id, {_BENCH} AS ws FROM documents),
b AS (SELECT item_id, {_BENCH} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + 9], ' ') AS s
       FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k)),
h AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP3 = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.conv_id, perspective, turn, speaker, text, speaker = perspective AS is_target,
             '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                    ELSE 'user name=' || speaker END || chr(10) AS head FROM m JOIN p USING (conv_id)),
x AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM r),
y AS (SELECT *, row_number() OVER w - 1 AS seq, sum(length(piece)) OVER (w ROWS UNBOUNDED PRECEDING) - length(piece) AS start
      FROM x WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, seq::BIGINT AS seq, speaker, piece, start::BIGINT AS start,
       CASE WHEN is_target THEN start + length(head) END::BIGINT AS mask_start,
       CASE WHEN is_target THEN start + length(piece) - 1 END::BIGINT AS mask_end, is_target FROM y
"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, 3.0 * source_size AS most, sum(source_size) OVER () AS total,
             coalesce(sum(3.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
             row_number() OVER o AS place
      FROM s WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)),
v AS (SELECT coalesce(min_by((total - capped) / open_, place) FILTER (WHERE (total - capped) / open_ < most / weight), max(most / weight)) AS level FROM c),
t AS (SELECT source, source_size, least(most, level * weight)::DOUBLE AS target FROM c, v),
u AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN budget // source_size * size + least(greatest(budget % source_size - start, 0), size) ELSE 0 END::BIGINT AS taken
FROM u
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM x JOIN f USING (s) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT a.doc_id, count(g.pos) AS gone, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY a.pos) AS kept
      FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def _op11() -> str:
    """Positions from matches and the text split at the same pattern, as window sums over the matches."""
    from guestlens.llm import pii
    # This engine's expressions know no possessive repeats and no look-behind; both only save time.
    plain = lambda p: p.split("]))", 1)[-1].replace("++", "+") if p.startswith(r"(?:\G") else p.replace("++", "+")
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    says = lambda words: f"(regexp_matches(lo, '(?:^|[^a-z])(?:{words})(?:$|[^a-z])') OR regexp_matches(hi, '(?:^|[^a-z])(?:{words})(?:$|[^a-z])'))"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    alone = f"(NOT regexp_matches(right(lgap, 1), '{pii.NOT_ALONE}') AND NOT regexp_matches(left(rgap, 1), '{pii.NOT_ALONE}'))"
    digit = "CAST(substr(dg, CAST(len(dg) - j AS INTEGER), 1) AS INTEGER)"
    luhn = f"(list_sum(list_transform(range(len(dg)), lambda j: CASE WHEN j % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"
    card = lambda a, b: f"CASE WHEN len(dg) BETWEEN {a} AND {b} THEN {luhn} ELSE false END"
    mod = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(value, ' ', ''), 5) || left(replace(value, ' ', ''), 4), ''),
        lambda c: CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END::BIGINT)),
        lambda m, d: CASE WHEN d < 10 THEN (m * 10 + d) % 97 ELSE (m * 100 + d) % 97 END) = 1"""
    valid = {"email": "true", "ip": f"regexp_matches(value, '{pii.IP_PARTS}')", "card": card(16, 19), "phone": "len(dg) BETWEEN 8 AND 15",
             "iban": f"CASE WHEN {alone} THEN {mod} ELSE false END", "short_card": card(13, 15), "local_phone": alone, "ssn": alone}
    ctes = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for name, rule in pii.RULES.items():
        pattern = plain(rule.pattern)
        ctes.append(f"""{name}_m AS (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d),
{name}_p AS (SELECT r, value, lgap, rgap, dg, {fold.format(f"right(lgap, {pii.BEFORE})")} AS lo, {fold.format(f"left(rgap, {pii.AFTER})")} AS hi,
    CAST(sum(len(lgap) + len(value)) OVER (PARTITION BY r ORDER BY i) - len(value) AS BIGINT) AS s FROM
  (SELECT *, {digits} AS dg FROM (SELECT r, unnest(m) AS value, unnest(g[1:len(m)]) AS lgap, unnest(g[2:len(m) + 1]) AS rgap, unnest(range(len(m))) AS i FROM {name}_m WHERE len(m) > 0) a) b),
{name} AS (SELECT r, {pii.KINDS.index(rule.kind)} AS no, '{rule.kind}' AS kind, s, s + len(value) AS e, {str(rule.base).lower()} AS base,
    {rule.score} + CASE WHEN {says(pii.CONTEXT[rule.kind])} THEN {pii.NEAR} ELSE 0 END - CASE WHEN {says(pii.AGAINST)} THEN {pii.NEAR} ELSE 0 END AS score
  FROM {name}_p WHERE {valid[name]})""")
    both = lambda base: " UNION ALL ".join(f"SELECT * FROM {n}" for n, r in pii.RULES.items() if r.base == base)
    ctes.append(f"bases AS ({both(True)}), added AS (SELECT * FROM ({both(False)}) a WHERE score >= {pii.LEAST} "
                "AND NOT EXISTS (SELECT 1 FROM bases b WHERE b.r = a.r AND b.s < a.e AND a.s < b.e)), spans AS (SELECT * FROM bases UNION ALL SELECT * FROM added)")
    piece = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE base AND kind = '{k}') AS n_{k}" for k in pii.BASE)
    ctes.append(f"""x AS (SELECT r, {counts}, string_agg({piece}, ',' ORDER BY no, s, e) FILTER (WHERE base) AS b, string_agg({piece}, ',' ORDER BY no, s, e) AS a
  FROM spans GROUP BY r)""")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in pii.BASE) + \
        ", sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN x USING (r)"


def _op13() -> str:
    ctes = ["""v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT max(len(embedding)) // 16 AS width FROM v),
c AS (SELECT r, i // width AS p, i % width AS j, floor(256 * x)::BIGINT AS x
      FROM (SELECT r, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM v) e, w),
o AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS k FROM v),
b0 AS (SELECT p, k, j, x FROM c JOIN o USING (r) WHERE k < 64)"""]
    for n in range(3):
        ctes.append(f"""d{n} AS (SELECT r, p, k, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far FROM c JOIN b{n} b USING (p, j) GROUP BY r, p, k),
a{n} AS (SELECT r, p, k, far FROM d{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY far, k) = 1)""")
        if n < 2:
            ctes.append(f"""m{n} AS (SELECT p, k, j, sum(x)::BIGINT AS s, count(*) AS n FROM c JOIN a{n} USING (r, p) GROUP BY p, k, j),
b{n + 1} AS (SELECT b.p, b.k, b.j, CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM b{n} b LEFT JOIN m{n} USING (p, k, j))""")
    return "WITH " + ",\n".join(ctes) + """,
z AS (SELECT r, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, k, j)) FROM b2) AS codebooks_sha256 FROM v JOIN z USING (r)"""


_TERMS = rf"regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark) b),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0)::BIGINT AS docs, sum(len(ws))::BIGINT AS total FROM d),
it AS (SELECT q, term, count(*)::BIGINT AS times FROM (SELECT q, unnest(ws) AS term FROM i) u GROUP BY q, term),
dt AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM d) u WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM dt, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * docs) // total AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT q, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM it JOIN dt USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 20
"""


ORACLE = {"op1_ngram_join": OP1, "op2_decontaminate": OP2, "op3_chat_perspectives": OP3, "op5_mix_sources": OP5, "op10_substring_dedup": OP10, "op11_pii": _op11(), "op12_ranked_search": OP12, "op13_vector_codes": _op13()}
