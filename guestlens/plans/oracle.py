"""Oracle SQL (DuckDB dialect) for every registered query.

The stand-in views are written as CTEs over the driver's pre-registered tables
so each oracle string is self-contained.  Numbers are kept exact: integer
sums, one division in double, one final ``round``.
"""

from __future__ import annotations

# --- stand-in views --------------------------------------------------------

REVIEWS = """reviews AS (
  SELECT *, CAST(floor((fetch_pos - 1) / 10) AS BIGINT) AS page_no FROM (
    SELECT e.user_id AS data_id, e.event_id, e.ts, s.s_name AS reviewer,
      CAST(CASE e.event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3
           WHEN 'click' THEN 4 ELSE 5 END AS BIGINT) AS rating,
      CASE WHEN e.event_id % 10 = 0 THEN '' WHEN e.event_id % 10 = 3 THEN concat('Not ', p1.p_name, ', but ', p2.p_name, '!')
           WHEN e.event_id % 10 = 4 THEN concat(p1.p_name, ' but never ', p2.p_name)
           WHEN e.event_id % 10 = 6 THEN concat('The ', p1.p_name, '; it wasn''t ', p2.p_name, '?')
           ELSE concat(p1.p_name, '. ', p2.p_name) END AS review_text,
      CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.value DESC, e.event_id) AS BIGINT) AS fetch_pos
    FROM events e
    JOIN supplier s ON s.s_suppkey = e.event_id % (SELECT count(*) FROM supplier)
    JOIN part p1 ON p1.p_partkey = e.event_id % (SELECT count(*) FROM part)
    JOIN part p2 ON p2.p_partkey = (e.event_id * 7 + 3) % (SELECT count(*) FROM part)) r0)"""

NREVIEWS = """nreviews AS (
  SELECT data_id, fetch_pos, page_no, reviewer AS "user", CAST(rating AS DOUBLE) AS rating, ts,
         strftime(ts, '%B %d, %Y at %I:%M %p UTC') AS date, review_text, event_id,
         date_trunc('minute', ts) AS minute
  FROM reviews)"""

PLACES = """places AS (
  SELECT CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey END AS data_id, c_custkey AS place_key,
    c_name AS title, c_mktsegment AS type, n_name AS address,
    9.0::DOUBLE + CAST(c_custkey % 200 AS DOUBLE) / 100.0::DOUBLE AS latitude,
    76.0::DOUBLE + CAST(c_custkey % 150 AS DOUBLE) / 100.0::DOUBLE AS longitude,
    round(least(5.0::DOUBLE, greatest(1.0::DOUBLE, c_acctbal / 2000.0::DOUBLE)), 1) AS rating
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""

SEARCH_QUERIES = """search_queries AS (
  SELECT CAST(n_nationkey AS BIGINT) AS query_id,
    concat('000', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS q,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 10.0::DOUBLE END AS latitude,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 76.5::DOUBLE END AS longitude
  FROM nation)"""

STORE_WRITES = """store_writes AS (
  SELECT user_id AS data_id, CASE WHEN event_id % 2 = 0 THEN 'instant' ELSE 'full' END AS type,
    props AS analysis, ts AS written_at, event_id AS seq
  FROM events)"""

STATUS_EVENTS = """status_events AS (
  SELECT user_id AS token,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status,
    ts AS created_at, event_id AS seq,
    CASE WHEN event_type = 'error' THEN concat('analysis failed: ', props) END AS error
  FROM events)"""

LEXICON = """lexicon AS (SELECT * FROM (VALUES ('anvil','accommodation'),('bolt','service'),
  ('gear','amenities'),('gizmo','food_and_dining'),('plate','location_and_accessibility'),
  ('ring','value_for_money'),('rod','online_presence')) AS v(term, aspect))"""

POLARITY = """polarity AS (SELECT * FROM (VALUES ('new',1),('large',1),('hot',1),('old',-1),
  ('small',-1),('cold',-1),('red',0),('blue',0)) AS v(term, polarity))"""

DISPLAY = "strftime({0}, '%B %d, %Y at %I:%M %p UTC')"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- oracle per query ------------------------------------------------------

def _scores(n_rated="n_rated", s="sum_rating", p="n_positive", u="n_neutral", g="n_negative"):
    return f"""CASE WHEN {n_rated} > 0 THEN round({s} / {n_rated}, 1) END AS average_score,
  CASE WHEN {n_rated} > 0 THEN round(CAST({p} AS DOUBLE) * 100 / {n_rated}, 1) END AS positive_percentage,
  CASE WHEN {n_rated} > 0 THEN round(CAST({u} AS DOUBLE) * 100 / {n_rated}, 1) END AS neutral_percentage,
  CASE WHEN {n_rated} > 0 THEN round(CAST({g} AS DOUBLE) * 100 / {n_rated}, 1) END AS negative_percentage"""


STATE_AGGS = """CAST(count(*) AS BIGINT) AS n_reviews,
  CAST(count(*) FILTER (WHERE rating > 0) AS BIGINT) AS n_rated,
  CAST(coalesce(sum(rating) FILTER (WHERE rating > 0), 0) AS DOUBLE) AS sum_rating,
  CAST(count(*) FILTER (WHERE rating >= 4) AS BIGINT) AS n_positive,
  CAST(count(*) FILTER (WHERE rating >= 3 AND rating < 4) AS BIGINT) AS n_neutral,
  CAST(count(*) FILTER (WHERE rating > 0 AND rating < 3) AS BIGINT) AS n_negative"""

BATCHED = """batched AS (
  SELECT *, CAST(floor((date_pos - 1) / {bs}) AS BIGINT) AS batch_id,
         CAST((date_pos - 1) % {bs} + 1 AS BIGINT) AS batch_pos
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY data_id ORDER BY minute, fetch_pos) AS BIGINT) AS date_pos
        FROM nreviews) b0)"""

BATCH_STATE = """batch_state AS (
  SELECT data_id, batch_id, """ + STATE_AGGS + """, min(ts) AS first_ts, max(ts) AS last_ts
  FROM batched GROUP BY data_id, batch_id)"""

ORACLE: dict[str, str] = {}

ORACLE["sentiment_overview"] = with_(REVIEWS, NREVIEWS, BATCHED.format(bs=15), BATCH_STATE, body=f"""
SELECT data_id, n_reviews, n_batches, {_scores()},
  {DISPLAY.format('first_ts')} AS first_date, {DISPLAY.format('last_ts')} AS last_date
FROM (SELECT data_id, CAST(sum(n_reviews) AS BIGINT) AS n_reviews, CAST(sum(n_rated) AS BIGINT) AS n_rated,
        CAST(sum(sum_rating) AS DOUBLE) AS sum_rating, CAST(sum(n_positive) AS BIGINT) AS n_positive,
        CAST(sum(n_neutral) AS BIGINT) AS n_neutral, CAST(sum(n_negative) AS BIGINT) AS n_negative,
        CAST(count(*) AS BIGINT) AS n_batches, min(first_ts) AS first_ts, max(last_ts) AS last_ts
      FROM batch_state GROUP BY data_id) t""")

ORACLE["overall_sentiment"] = with_(REVIEWS, NREVIEWS, body=f"""
SELECT data_id, n_reviews, n_reviews - n_rated AS n_unrated, {_scores()}
FROM (SELECT data_id, {STATE_AGGS} FROM nreviews GROUP BY data_id) t""")

PAGES = """pg AS (SELECT data_id, page_no, CAST(count(*) AS BIGINT) AS n_reviews, max(ts) AS last_ts
  FROM reviews GROUP BY data_id, page_no),
pgx AS (SELECT *, page_no < max(page_no) OVER (PARTITION BY data_id) AS has_next FROM pg)"""

ORACLE["review_pages_scan"] = with_(REVIEWS, PLACES, PAGES, body="""
SELECT x.data_id, x.page_no, x.n_reviews, x.has_next,
  CASE WHEN x.page_no = 0 AND p.type = 'BUILDING' THEN NULL ELSE p.title END AS title,
  false AS is_corrupt
FROM pgx x LEFT JOIN places p ON p.place_key = x.data_id""")

ORACLE["review_normalize"] = with_(REVIEWS, NREVIEWS, body="""
SELECT data_id, fetch_pos, page_no, "user", rating, date, review_text,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso_date
FROM nreviews""")

ORACLE["place_header"] = with_(REVIEWS, PLACES, PAGES, body="""
SELECT a.data_id,
  CASE WHEN ok THEN p.type ELSE '' END AS type,
  CASE WHEN ok THEN p.title ELSE '' END AS title,
  CASE WHEN ok THEN p.rating ELSE 0.0::DOUBLE END AS rating,
  CASE WHEN ok THEN p.address ELSE '' END AS address,
  'Success' AS status,
  CASE WHEN ok THEN a.n ELSE 0 END AS total_reviews,
  strftime(a.first_last_ts, '%Y-%m-%d %H:%M:%S UTC') AS created_at,
  CAST(a.data_id AS VARCHAR) AS param_data_id
FROM (SELECT data_id, CAST(sum(n_reviews) AS BIGINT) AS n, max(page_no) AS mp,
        max(last_ts) FILTER (WHERE page_no = 0) AS first_last_ts FROM pg GROUP BY data_id) a
JOIN places p ON p.place_key = a.data_id,
LATERAL (SELECT (p.type <> 'BUILDING' OR a.mp >= 1) AS ok) o""")

ORACLE["review_quarantine"] = with_(REVIEWS, PLACES, body="""
SELECT p.place_key AS data_id, coalesce(r.n_good, 0) AS n_good, coalesce(r.n_quarantined, 0) AS n_quarantined,
  coalesce(r.n_bad_pages, 0) AS n_bad_pages,
  CASE WHEN coalesce(r.n_good, 0) = 0 THEN 'Error' WHEN r.n_quarantined > 0 OR r.n_bad_pages > 0 THEN 'Partial' ELSE 'Success' END AS status
FROM places p LEFT JOIN (
  SELECT data_id, CAST(count(*) FILTER (WHERE NOT broken AND NOT bad) AS BIGINT) AS n_good,
    CAST(count(*) FILTER (WHERE NOT broken AND bad) AS BIGINT) AS n_quarantined,
    CAST(count(DISTINCT page_no) FILTER (WHERE broken) AS BIGINT) AS n_bad_pages
  FROM (SELECT data_id, page_no, (data_id + page_no) % 41 = 3 AS broken,
          event_id % 97 = 5 OR event_id % 83 = 11 OR event_id % 89 = 7 AS bad FROM reviews) x
  GROUP BY data_id) r ON r.data_id = p.place_key""")

ORACLE["no_reviews_places"] = with_(REVIEWS, PLACES, body="""
SELECT place_key AS data_id, 'no_reviews' AS instant_status, 'failed' AS full_status,
  'no_reviews' AS full_error
FROM places p WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.data_id = p.place_key)""")

ORACLE["instant_select"] = with_(REVIEWS, NREVIEWS, body="""
SELECT data_id, fetch_pos,
  CAST(row_number() OVER (PARTITION BY data_id ORDER BY minute, fetch_pos) AS BIGINT) AS date_rank, date
FROM (SELECT * FROM nreviews QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY fetch_pos) <= 20) t""")

ORACLE["full_page_cap"] = with_(REVIEWS, PAGES, body="""
SELECT data_id, page_no, n_reviews, has_next FROM (
  SELECT *, coalesce(sum(n_reviews) OVER (PARTITION BY data_id ORDER BY page_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            coalesce(bool_or(NOT has_next) OVER (PARTITION BY data_id ORDER BY page_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped
  FROM pgx) t
WHERE before < 40 AND NOT stopped""")

ORACLE["chronological_batches"] = with_(REVIEWS, NREVIEWS, BATCHED.format(bs=15), body="""
SELECT data_id, fetch_pos, date_pos, batch_id, batch_pos FROM batched""")

ORACLE["reviews_by_date"] = with_(REVIEWS, NREVIEWS, body="""
SELECT data_id, fetch_pos, date,
  CAST(row_number() OVER (PARTITION BY data_id ORDER BY minute ASC, fetch_pos ASC) AS BIGINT) AS rank_asc,
  CAST(row_number() OVER (PARTITION BY data_id ORDER BY minute DESC, fetch_pos ASC) AS BIGINT) AS rank_desc
FROM nreviews""")

ORACLE["review_display_split"] = with_(REVIEWS, NREVIEWS, body="""
SELECT data_id, fetch_pos, CASE WHEN r <= 10 THEN r END AS display_rank, r <= 10 AS shown
FROM (SELECT data_id, fetch_pos,
        CAST(row_number() OVER (PARTITION BY data_id ORDER BY minute DESC, fetch_pos ASC) AS BIGINT) AS r
      FROM nreviews) t""")

ORACLE["place_review_bundle"] = with_(REVIEWS, NREVIEWS, PLACES, body="""
SELECT p.place_key, p.title, p.address, r.fetch_pos, r."user", r.rating
FROM places p LEFT JOIN nreviews r ON r.data_id = p.place_key""")

ORACLE["batch_analysis"] = with_(REVIEWS, NREVIEWS, BATCHED.format(bs=15), BATCH_STATE, body=f"""
SELECT data_id, batch_id, n_reviews, {_scores()},
  {DISPLAY.format('first_ts')} AS first_date, {DISPLAY.format('last_ts')} AS last_date
FROM batch_state""")

ORACLE["recency_weighted_sentiment"] = with_(REVIEWS, NREVIEWS, BATCHED.format(bs=15), BATCH_STATE, body=f"""
SELECT data_id, n_batches, {_scores()}
FROM (SELECT data_id, CAST(count(*) AS BIGINT) AS n_batches,
        CAST(sum(n_rated * (batch_id + 1)) AS BIGINT) AS n_rated,
        CAST(sum(sum_rating * (batch_id + 1)) AS DOUBLE) AS sum_rating,
        CAST(sum(n_positive * (batch_id + 1)) AS BIGINT) AS n_positive,
        CAST(sum(n_neutral * (batch_id + 1)) AS BIGINT) AS n_neutral,
        CAST(sum(n_negative * (batch_id + 1)) AS BIGINT) AS n_negative
      FROM batch_state GROUP BY data_id) t""")


# --- aspects -----------------------------------------------------------------

def _values(rows, names):
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    body = ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"


def _aspect_tables():
    from guestlens.operators.aspects import ASPECTS, PLAYBOOK
    rows = [(a, i, name, PLAYBOOK[a][0], PLAYBOOK[a][1]) for i, (a, name) in enumerate(ASPECTS)]
    return "aspect_info AS " + _values(rows, ["aspect", "ord", "category", "template", "impact"])


MENTIONS = r"""sents AS (
  SELECT data_id, fetch_pos, rating, ts, {extra} unnest(ss) AS sentence, unnest(range(0, len(ss))) AS sent_no
  FROM (SELECT *, list_filter(list_transform(string_split_regex(lower(coalesce(review_text, '')), '[.!?;,\n]+|\s+but\s+'),
                                             lambda x: trim(x)), lambda x: x <> '') AS ss FROM {src}) s0),
wlists AS (
  SELECT data_id, fetch_pos, sent_no,
    list_filter(regexp_split_to_array(sentence, '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> '') AS ww FROM sents),
wrds AS (
  SELECT data_id, fetch_pos, sent_no, w,
    (wi > 0 AND list_contains({negators}, ww[wi])) AS negated
  FROM (SELECT *, unnest(ww) AS w, unnest(range(0, len(ww))) AS wi FROM wlists) u),
sent_pol AS (
  SELECT data_id, fetch_pos, sent_no, coalesce(sum(sp), 0) AS pol,
    string_agg(DISTINCT m, ' ' ORDER BY m) FILTER (WHERE m IS NOT NULL) AS mods
  FROM (SELECT w0.data_id, w0.fetch_pos, w0.sent_no,
          p.polarity * CASE WHEN w0.negated THEN -1 ELSE 1 END AS sp,
          CASE WHEN p.term IS NOT NULL THEN concat(CASE WHEN w0.negated THEN 'not ' ELSE '' END, w0.w) END AS m
        FROM wrds w0 LEFT JOIN polarity p ON p.term = w0.w) q
  GROUP BY data_id, fetch_pos, sent_no),
sent_terms AS (
  SELECT DISTINCT w0.data_id, w0.fetch_pos, w0.sent_no, w0.w AS term, l.aspect
  FROM wrds w0 JOIN lexicon l ON l.term = w0.w),
mentions AS (
  SELECT s.data_id, s.fetch_pos, s.rating, s.ts, {extra_s} t.sent_no, t.term, t.aspect,
    CAST(sign(sp.pol) AS INTEGER) AS pol,
    CASE WHEN sp.pol > 0 THEN 'praise' WHEN sp.pol < 0 THEN 'criticism' ELSE 'neutral' END AS polarity,
    trim(concat_ws(' ', coalesce(sp.mods, ''), t.term)) AS phrase
  FROM sent_terms t JOIN sent_pol sp USING (data_id, fetch_pos, sent_no)
  JOIN (SELECT DISTINCT data_id, fetch_pos, rating, ts {extra_c} FROM sents) s USING (data_id, fetch_pos))"""


def mentions_cte(src="nreviews", extra=()):
    from guestlens.operators.aspects import NEGATORS
    negators = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in NEGATORS) + "]"
    return MENTIONS.format(src=src, negators=negators, extra="".join(f"{e}, " for e in extra),
                           extra_s="".join(f"s.{e}, " for e in extra),
                           extra_c="".join(f", {e}" for e in extra))


BASE_M = (REVIEWS, NREVIEWS, LEXICON, POLARITY)

FEEDBACK = """
SELECT c.data_id, c.aspect, c.polarity, c.n_reviews, c.n_mentions, t.top_phrases
FROM (SELECT data_id, aspect, polarity, CAST(count(DISTINCT fetch_pos) AS BIGINT) AS n_reviews,
        CAST(count(*) AS BIGINT) AS n_mentions FROM mentions GROUP BY ALL) c
JOIN (SELECT data_id, aspect, polarity, string_agg(phrase, '; ' ORDER BY r) AS top_phrases FROM (
        SELECT *, row_number() OVER (PARTITION BY data_id, aspect, polarity ORDER BY n DESC, phrase) AS r
        FROM (SELECT data_id, aspect, polarity, phrase, count(DISTINCT fetch_pos) AS n
              FROM mentions GROUP BY ALL) p0) p1
      GROUP BY ALL) t USING (data_id, aspect, polarity)"""

ORACLE["aspect_feedback"] = with_(*BASE_M, mentions_cte(), body=FEEDBACK)

def _prose():
    from guestlens.sources.standins import PROSE_LEXICON, PROSE_POLARITY
    return with_("""prose AS (SELECT TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS data_id, doc_id AS fetch_pos,
    CAST(n_chars % 5 + 1 AS DOUBLE) AS rating, CAST(NULL AS TIMESTAMP) AS ts, text AS review_text FROM documents)""",
                 "lexicon AS " + _values(PROSE_LEXICON, ["term", "aspect"]), "polarity AS " + _values(PROSE_POLARITY, ["term", "polarity"]),
                 mentions_cte("prose"), body=FEEDBACK)


ORACLE["prose_feedback"] = _prose()

ORACLE["recurring_themes"] = with_(*BASE_M, mentions_cte(), body="""
SELECT data_id, aspect, term, polarity, CAST(count(DISTINCT fetch_pos) AS BIGINT) AS n_reviews
FROM mentions GROUP BY ALL HAVING count(DISTINCT fetch_pos) >= 2""")

ORACLE["persistent_themes"] = with_(*BASE_M, BATCHED.format(bs=5), mentions_cte("batched", ["batch_id"]), body="""
SELECT t.data_id, aspect, term, polarity, n_batches, first_batch, last_batch,
  round(CAST(n_batches AS DOUBLE) / nb, 3) AS share,
  (n_batches >= 2 AND CAST(n_batches AS DOUBLE) >= 0.5 * nb) AS persistent,
  (last_batch = nb - 1) AS recent
FROM (SELECT data_id, aspect, term, polarity, CAST(count(DISTINCT batch_id) AS BIGINT) AS n_batches,
        min(batch_id) AS first_batch, max(batch_id) AS last_batch FROM mentions GROUP BY ALL) t
JOIN (SELECT data_id, CAST(max(batch_id) + 1 AS BIGINT) AS nb FROM batched GROUP BY data_id) b
  ON b.data_id = t.data_id""")

ORACLE["improvement_priorities"] = with_(*BASE_M, mentions_cte(), _aspect_tables(), body="""
SELECT a.data_id, a.priority, i.category, a.issue, replace(i.template, '%s', a.issue) AS suggestion,
  i.impact AS potential_impact, a.score, a.n_reviews
FROM (SELECT s.*, iss.issue,
        CAST(row_number() OVER (PARTITION BY s.data_id ORDER BY s.score DESC, ai.ord) AS BIGINT) AS priority
      FROM (SELECT data_id, aspect, CAST(count(*) AS BIGINT) AS n_reviews,
              CAST(sum(CASE WHEN rating > 0 THEN 5 - rating ELSE 0 END) AS DOUBLE) AS score
            FROM (SELECT DISTINCT data_id, fetch_pos, rating, aspect FROM mentions WHERE pol < 0) d
            GROUP BY ALL) s
      JOIN aspect_info ai ON ai.aspect = s.aspect
      JOIN (SELECT data_id, aspect, first(phrase ORDER BY n DESC, phrase) AS issue
            FROM (SELECT data_id, aspect, phrase, count(DISTINCT fetch_pos) AS n
                  FROM mentions WHERE pol < 0 GROUP BY ALL) q GROUP BY ALL) iss
        ON iss.data_id = s.data_id AND iss.aspect = s.aspect) a
JOIN aspect_info i ON i.aspect = a.aspect
WHERE a.priority <= 5""")

ORACLE["aspect_suggestions"] = with_(*BASE_M, mentions_cte(), _aspect_tables(), body="""
SELECT c.data_id, c.aspect, c.rank, c.term, c.n_reviews, replace(i.template, '%s', c.term) AS suggestion
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY data_id, aspect ORDER BY n_reviews DESC, term) AS BIGINT) AS rank
      FROM (SELECT data_id, aspect, term, CAST(count(DISTINCT fetch_pos) AS BIGINT) AS n_reviews
            FROM mentions WHERE pol < 0 GROUP BY ALL) c0) c
JOIN aspect_info i ON i.aspect = c.aspect""")


def _verdict_sql(p, c, none_text, pos, neg, mixed):
    det = (f"concat(' (', CAST(coalesce({p},0) AS VARCHAR), ' praising / ', "
           f"CAST(coalesce({c},0) AS VARCHAR), ' criticising reviews)')")
    return (f"CASE WHEN coalesce({p},0) + coalesce({c},0) = 0 THEN '{none_text}' "
            f"WHEN coalesce({p},0) > coalesce({c},0) THEN concat('{pos}', {det}) "
            f"WHEN coalesce({p},0) < coalesce({c},0) THEN concat('{neg}', {det}) "
            f"ELSE concat('{mixed}', {det}) END")


def summary_ctes(src="nreviews"):
    """CTEs fb, sen, per, bf, summ (data_id, hotel_name, summary, verdicts, scores)
    over the review source ``src`` and its ``mentions``; needs places, aspect_info."""
    return [f"""fb AS (
  SELECT data_id, aspect, polarity, count(DISTINCT fetch_pos) AS n FROM mentions GROUP BY ALL)""", f"""sen AS (
  SELECT data_id, n_reviews, {_scores()} FROM (SELECT data_id, {STATE_AGGS} FROM {src} GROUP BY data_id) t)""",
            """per AS (
  SELECT fb.data_id,
    first(fb.aspect ORDER BY fb.n DESC, ai.ord) FILTER (WHERE polarity = 'praise') AS best,
    first(fb.aspect ORDER BY fb.n DESC, ai.ord) FILTER (WHERE polarity = 'criticism') AS worst,
    sum(n) FILTER (WHERE fb.aspect = 'food_and_dining' AND polarity = 'praise') AS fp,
    sum(n) FILTER (WHERE fb.aspect = 'food_and_dining' AND polarity = 'criticism') AS fc,
    sum(n) FILTER (WHERE fb.aspect = 'value_for_money' AND polarity = 'praise') AS vp,
    sum(n) FILTER (WHERE fb.aspect = 'value_for_money' AND polarity = 'criticism') AS vc
  FROM fb JOIN aspect_info ai ON ai.aspect = fb.aspect GROUP BY fb.data_id)""",
            rf"""bf AS (
  SELECT data_id, count(*) AS nb FROM {src}
  WHERE list_contains(regexp_split_to_array(lower(review_text), '[^\p{{L}}\p{{N}}'']+'), 'breakfast')
  GROUP BY data_id)""", f"""summ AS (
SELECT s.data_id, coalesce(p.title, '') AS hotel_name,
  concat(coalesce(p.title, 'This place'), ': ', CAST(s.n_reviews AS VARCHAR), ' reviews, average score ',
    coalesce(CAST(s.average_score AS VARCHAR), 'n/a'), '/5 (',
    coalesce(CAST(s.positive_percentage AS VARCHAR), 'n/a'), '% positive, ',
    coalesce(CAST(s.negative_percentage AS VARCHAR), 'n/a'), '% negative). Most praised: ',
    coalesce(b.category, 'none'), '. Most criticised: ', coalesce(w.category, 'none'), '.') AS summary,
  {_verdict_sql('per.fp', 'per.fc', 'No dining feedback', 'Mostly positive', 'Mostly negative', 'Mixed')} AS restaurant_quality,
  CASE WHEN coalesce(bf.nb, 0) = 0 THEN 'No breakfast feedback'
       ELSE concat('Breakfast mentioned in ', CAST(bf.nb AS VARCHAR), ' reviews') END AS breakfast_feedback,
  {_verdict_sql('per.vp', 'per.vc', 'No value feedback', 'Good value', 'Poor value', 'Mixed value')} AS perceived_value,
  s.average_score, s.positive_percentage, s.neutral_percentage, s.negative_percentage
FROM sen s LEFT JOIN per ON per.data_id = s.data_id LEFT JOIN bf ON bf.data_id = s.data_id
LEFT JOIN places p ON p.place_key = s.data_id
LEFT JOIN aspect_info b ON b.aspect = per.best LEFT JOIN aspect_info w ON w.aspect = per.worst)"""]


ORACLE["analysis_summary"] = with_(*BASE_M, mentions_cte(), PLACES, _aspect_tables(), *summary_ctes("nreviews"),
                                   body="SELECT * FROM summ")


# --- combine / trend -----------------------------------------------------------

def _spans(f1, n=19):
    return "[" + ",".join(str(f1 * 10 ** j) for j in range(n)) + "]"


def tree_cte(f1):
    return f"""lv AS (
  SELECT b.*, n.levels, unnest(generate_series(1, n.levels)) AS level
  FROM batch_state b JOIN (
    SELECT data_id, CASE WHEN count(*) > 1 THEN 1 + len(list_filter({_spans(f1, 18)}, lambda s: count(*) > s)) ELSE 0 END AS levels
    FROM batch_state GROUP BY data_id) n USING (data_id)
  WHERE n.levels > 0),
nodes AS (
  SELECT *, CAST(floor(batch_id / list_extract({_spans(f1)}, CAST(level AS INTEGER))) AS BIGINT) AS node,
    CAST(floor(batch_id / CASE WHEN level = 1 THEN 1 ELSE list_extract({_spans(f1)}, CAST(level - 1 AS INTEGER)) END) AS BIGINT) AS child
  FROM lv),
tree AS (
SELECT data_id, CAST(level AS BIGINT) AS level, node, n_children, n_batches, n_reviews, {_scores()},
  {DISPLAY.format('first_ts')} AS first_date, {DISPLAY.format('last_ts')} AS last_date,
  level = levels AS is_root, n_children > 1 AS combined
FROM (SELECT data_id, level, node, max(levels) AS levels, CAST(count(DISTINCT child) AS BIGINT) AS n_children,
        CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(n_reviews) AS BIGINT) AS n_reviews,
        CAST(sum(n_rated) AS BIGINT) AS n_rated, CAST(sum(sum_rating) AS DOUBLE) AS sum_rating,
        CAST(sum(n_positive) AS BIGINT) AS n_positive, CAST(sum(n_neutral) AS BIGINT) AS n_neutral,
        CAST(sum(n_negative) AS BIGINT) AS n_negative, min(first_ts) AS first_ts, max(last_ts) AS last_ts
      FROM nodes GROUP BY data_id, level, node) g)"""


# Mentions of every node: those of its batches (level 0: the batches themselves).
NODE_MENTIONS = """nm AS (
  SELECT n.data_id, n.level, n.node, m.fetch_pos, m.rating, m.aspect, m.term, m.pol, m.polarity, m.phrase
  FROM (SELECT data_id, batch_id, CAST(level AS BIGINT) AS level, node FROM nodes
        UNION ALL SELECT data_id, batch_id, 0, batch_id FROM batch_state) n JOIN mentions m USING (data_id, batch_id)),
nt AS (SELECT data_id, level, node, CAST(count(DISTINCT (term, pol)) AS BIGINT) AS n_themes, CAST(count(*) AS BIGINT) AS n_mentions FROM nm GROUP BY ALL),
ni AS (
  SELECT s.data_id, s.level, s.node, i.issue AS top_issue
  FROM (SELECT data_id, level, node, aspect, sum(CASE WHEN rating > 0 THEN 5 - rating ELSE 0 END) AS score
        FROM (SELECT DISTINCT data_id, level, node, fetch_pos, rating, aspect FROM nm WHERE pol < 0) d GROUP BY ALL) s
  JOIN (SELECT data_id, level, node, aspect, first(phrase ORDER BY n DESC, phrase) AS issue
        FROM (SELECT data_id, level, node, aspect, phrase, count(DISTINCT fetch_pos) AS n FROM nm WHERE pol < 0 GROUP BY ALL) q GROUP BY ALL) i
    USING (data_id, level, node, aspect)
  JOIN aspect_info ai ON ai.aspect = s.aspect
  QUALIFY row_number() OVER (PARTITION BY s.data_id, s.level, s.node ORDER BY s.score DESC, ai.ord) = 1)"""


def _tree_parts():
    return (REVIEWS, NREVIEWS, LEXICON, POLARITY, BATCHED.format(bs=5), BATCH_STATE, tree_cte(2), mentions_cte("batched", ["batch_id"]),
            _aspect_tables(), NODE_MENTIONS)


ORACLE["tree_combine"] = with_(*_tree_parts(), body="""
SELECT tree.*, coalesce(nt.n_themes, 0) AS n_themes, coalesce(nt.n_mentions, 0) AS n_mentions, ni.top_issue
FROM tree LEFT JOIN nt USING (data_id, level, node) LEFT JOIN ni USING (data_id, level, node)""")

ORACLE["period_trend"] = with_(REVIEWS, NREVIEWS, BATCHED.format(bs=5), BATCH_STATE, """cur AS (
  SELECT data_id, batch_id, CASE WHEN n_rated > 0 THEN sum_rating / n_rated END AS a FROM batch_state)""", body="""
SELECT c.data_id, c.batch_id, round(c.a, 2) AS average_score, round(p.a, 2) AS previous_score,
  round(c.a - p.a, 2) AS delta,
  CASE WHEN p.data_id IS NULL THEN 'first' WHEN c.a - p.a >= 0.5 THEN 'improving'
       WHEN c.a - p.a <= -0.5 THEN 'declining' ELSE 'stable' END AS trend
FROM cur c LEFT JOIN cur p ON p.data_id = c.data_id AND p.batch_id = c.batch_id - 1""")


# --- store, cache, status, search ------------------------------------------------

TS_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
LAST_WRITE = """stored AS (
  SELECT * FROM store_writes
  QUALIFY row_number() OVER (PARTITION BY data_id, type ORDER BY written_at DESC, seq DESC) = 1)"""

ORACLE["analysis_upsert"] = with_(STORE_WRITES, LAST_WRITE, body=f"""
SELECT data_id, type, analysis, {TS_TEXT.format('written_at')} AS written_at, seq FROM stored""")

ORACLE["analysis_lookup"] = with_(STORE_WRITES, LAST_WRITE, PLACES, body=f"""
SELECT r.data_id, r.type AS requested_type, s.type, CASE WHEN s.type = 'instant' THEN 0 ELSE 1 END AS type_order,
  s.analysis, {TS_TEXT.format('s.written_at')} AS written_at
FROM (SELECT data_id, CASE place_key % 3 WHEN 0 THEN 'instant' WHEN 1 THEN 'full' END AS type
      FROM places WHERE data_id IS NOT NULL) r
JOIN stored s ON s.data_id = r.data_id AND (r.type IS NULL OR r.type = s.type)""")

ORACLE["stored_union"] = ORACLE["analysis_upsert"]

LATEST_STATUS = """latest AS (
  SELECT token, status, created_at, error FROM status_events
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY created_at DESC, seq DESC) = 1)"""

ORACLE["cache_split"] = with_(STORE_WRITES, LAST_WRITE, PLACES, STATUS_EVENTS, LATEST_STATUS, body="""
SELECT r.data_id, r.type,
  CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.data_id = r.data_id AND s.type = r.type) THEN 'hit'
       WHEN r.type = 'full' AND EXISTS (SELECT 1 FROM latest l WHERE l.token = r.data_id AND l.status = 'in_progress')
         THEN 'running'
       ELSE 'miss' END AS decision
FROM (SELECT data_id, unnest(['instant', 'full']) AS type FROM places WHERE data_id IS NOT NULL) r""")

ORACLE["job_status_latest"] = with_(STATUS_EVENTS, LATEST_STATUS, body=f"""
SELECT token, status, {TS_TEXT.format('created_at')} AS created_at, error,
  CASE status WHEN 'completed' THEN 'data' WHEN 'in_progress' THEN 'in_progress' ELSE 'failed' END AS reply,
  CASE WHEN status = 'failed' THEN coalesce(error, 'unknown error') END AS reply_error
FROM latest""")

ORACLE["status_ttl_expire"] = with_(STATUS_EVENTS, LATEST_STATUS, body=f"""
SELECT token, status, {TS_TEXT.format('created_at')} AS created_at FROM latest
WHERE created_at >= (SELECT max(created_at) FROM status_events) - INTERVAL 24 HOURS""")

ORACLE["place_search"] = with_(PLACES, SEARCH_QUERIES, """cand AS (
  SELECT q.query_id, p.data_id, p.title, p.type, p.address, p.latitude, p.longitude,
    CASE WHEN starts_with(lower(p.title), lower(q.q)) THEN 'prefix' ELSE 'contains' END AS match,
    round(2 * 6371.0 * asin(sqrt(pow(sin(radians(p.latitude - coalesce(q.latitude, 9.9185)) / 2), 2)
      + cos(radians(coalesce(q.latitude, 9.9185))) * cos(radians(p.latitude))
      * pow(sin(radians(p.longitude - coalesce(q.longitude, 76.2558)) / 2), 2))), 3) AS distance_km
  FROM search_queries q JOIN places p ON contains(lower(p.title), lower(q.q))
  WHERE length(q.q) > 2 AND p.data_id IS NOT NULL)""", body="""
SELECT query_id, rank, data_id, title AS value, type, address AS subtext, latitude, longitude, match, distance_km
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY CASE WHEN match = 'prefix' THEN 0 ELSE 1 END, distance_km, data_id) AS BIGINT) AS rank FROM cand) t
WHERE rank <= 5""")


# --- model-call path, report -------------------------------------------------------

def _sq(text):
    return "'" + text.replace("'", "''") + "'"


HEADER = """hdr AS (
  SELECT p.place_key AS data_id, p.title, p.address, p.rating, c.total_reviews
  FROM places p JOIN (SELECT data_id, CAST(count(*) AS BIGINT) AS total_reviews FROM reviews GROUP BY data_id) c
    ON c.data_id = p.place_key),
as_of_day AS (SELECT strftime(max(ts), '%Y-%m-%d') AS d FROM events)"""


def _system_sql(template):
    return (f"printf({_sq(template)}, h.title, h.address, CAST(h.rating AS VARCHAR), h.total_reviews, "
            f"(SELECT d FROM as_of_day))")


def _l1():
    from guestlens.operators.model_calls import SYSTEM_TEMPLATE
    return with_(REVIEWS, NREVIEWS, BATCHED.format(bs=15), PLACES, HEADER, body=f"""
SELECT b.data_id, b.batch_id, b.n_reviews, {_system_sql(SYSTEM_TEMPLATE)} AS system_prompt, b.user_prompt
FROM (SELECT data_id, batch_id, CAST(count(*) AS BIGINT) AS n_reviews,
        concat('Reviews:', chr(10), string_agg(concat('* ', CAST(rating AS VARCHAR), ' of 5 | ', date,
          ' | ', "user", ': ', review_text), chr(10) ORDER BY date_pos)) AS user_prompt
      FROM batched GROUP BY data_id, batch_id) b
LEFT JOIN hdr h ON h.data_id = b.data_id""")


def _l2():
    from guestlens.operators.model_calls import COMBINE_TEMPLATE
    return with_(*_tree_parts(), PLACES, HEADER, f"""allnodes AS (
  SELECT data_id, CAST(0 AS BIGINT) AS level, batch_id AS node, CAST(1 AS BIGINT) AS n_children, average_score, first_date, last_date
  FROM (SELECT data_id, batch_id, {_scores()}, {DISPLAY.format('first_ts')} AS first_date, {DISPLAY.format('last_ts')} AS last_date FROM batch_state)
  UNION ALL SELECT data_id, level, node, n_children, average_score, first_date, last_date FROM tree)""", """child AS (
  SELECT a.data_id, a.level + 1 AS p_level, CAST(floor(a.node / CASE WHEN a.level = 0 THEN 2 ELSE 10 END) AS BIGINT) AS p_node, a.node AS c_node,
    concat('[', first_date, ' to ', last_date, ']') AS period, coalesce(CAST(average_score AS VARCHAR), '-') AS score,
    coalesce(ni.top_issue, '-') AS issue, CAST(coalesce(pr.n, 0) AS VARCHAR) AS praises
  FROM allnodes a LEFT JOIN ni USING (data_id, level, node)
  LEFT JOIN (SELECT data_id, level, node, count(DISTINCT phrase) AS n FROM nm WHERE pol > 0 AND aspect = 'accommodation' GROUP BY ALL) pr
    USING (data_id, level, node))""", body=f"""
SELECT g.data_id, g.level, g.node, g.n_children, {_system_sql(COMBINE_TEMPLATE)} AS system_prompt, g.periods, g.child_scores, g.child_issues, g.child_praises
FROM (SELECT p.data_id, p.level, p.node, p.n_children, string_agg(c.period, ' ' ORDER BY c.c_node) AS periods,
        string_agg(c.score, ' | ' ORDER BY c.c_node) AS child_scores, string_agg(c.issue, ' | ' ORDER BY c.c_node) AS child_issues,
        string_agg(c.praises, ' | ' ORDER BY c.c_node) AS child_praises
      FROM allnodes p JOIN child c ON c.data_id = p.data_id AND c.p_level = p.level AND c.p_node = p.node
      WHERE p.level >= 1 AND p.n_children > 1
      GROUP BY p.data_id, p.level, p.node, p.n_children) g
LEFT JOIN hdr h ON h.data_id = g.data_id""")


ORACLE["analysis_requests"] = _l1()
ORACLE["combine_requests"] = _l2()

SEL20 = """sel20 AS (
  SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY minute DESC, fetch_pos ASC) AS rank_desc
  FROM (SELECT * FROM nreviews QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY fetch_pos) <= 20) s0)"""

ORACLE["report_export"] = with_(REVIEWS, NREVIEWS, SEL20, LEXICON, POLARITY, mentions_cte("sel20"), PLACES, body=f"""
SELECT s.data_id, p.title, s.n_reviews, s.newest_date, s.oldest_date, {_scores()},
  CAST(least(5, coalesce(c.n, 0)) AS BIGINT) AS n_priorities
FROM (SELECT data_id, {STATE_AGGS},
        arg_min(date, rank_desc) AS newest_date, arg_max(date, rank_desc) AS oldest_date
      FROM sel20 GROUP BY data_id) s
JOIN places p ON p.place_key = s.data_id
LEFT JOIN (SELECT data_id, count(DISTINCT aspect) AS n FROM mentions WHERE pol < 0 GROUP BY data_id) c
  ON c.data_id = s.data_id""")

ORACLE["response_validate"] = with_(REVIEWS, NREVIEWS, SEL20, PLACES, body=f"""
SELECT data_id, CAST(0 AS BIGINT) AS batch_id, reason IS NULL AS valid, reason FROM (
  SELECT s.data_id, CASE s.data_id % 11 WHEN 7 THEN 'call failed: TimeoutError: no answer' WHEN 1 THEN 'no reply' WHEN 2 THEN 'not JSON'
      WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'missing: summary' WHEN 5 THEN 'average_score out of range'
      WHEN 6 THEN 'percentages do not sum to 100'
      ELSE CASE WHEN abs(positive_percentage + neutral_percentage + negative_percentage - 100) > 0.2
                THEN 'percentages do not sum to 100' END END AS reason
  FROM (SELECT data_id, {_scores()} FROM (SELECT data_id, {STATE_AGGS} FROM sel20 GROUP BY data_id) t) s
  JOIN places p ON p.place_key = s.data_id) u""")

ORACLE["stream_page_ingest"] = ORACLE["review_normalize"]
ORACLE["incremental_integration"] = ORACLE["overall_sentiment"]


# --- R1: the flattened instant report ------------------------------------------------

# Report list fields and the mention polarity that fills them ('suggest' = A9 list).
REPORT_LISTS = {
    "accommodation": [("Room Quality", "neutral"), ("Common Praises", "praise"),
                      ("Common Criticisms", "criticism"), ("Suggestions for Improvement", "suggest")],
    "service": [("Strengths", "praise"), ("Weaknesses", "criticism"), ("Suggestions for Improvement", "suggest")],
    "amenities": [("Praised Features", "praise"), ("Criticized Features", "criticism"),
                  ("Suggestions for Improvement", "suggest")],
    "food_and_dining": [("Praised Items", "praise"), ("Criticized Items", "criticism"),
                        ("Suggestions for Improvement", "suggest")],
    "location_and_accessibility": [("Positive Aspects", "praise"), ("Negative Aspects", "criticism"),
                                   ("Suggestions for Improvement", "suggest")],
    "value_for_money": [("Positive Factors", "praise"), ("Negative Factors", "criticism"),
                        ("Suggestions for Improvement", "suggest")],
    "online_presence": [("Website Feedback", "praise"), ("Website Feedback", "criticism"),
                        ("Social Media Feedback", "neutral"), ("Suggestions for Improvement", "suggest")],
}


def _star_sql(r):
    c = f"least(greatest(coalesce(CAST({r} AS DOUBLE), 0.0), 0.0), 5.0)"
    return (f"concat(repeat('★', CAST(floor({c}) AS INTEGER)), CASE WHEN {c} - floor({c}) >= 0.5 THEN '½' ELSE '' END, "
            f"repeat('☆', CAST(greatest(0, 5 - ceil({c})) AS INTEGER)))")


def _r1():
    from guestlens.operators.report import SECTIONS
    sec_no = {sec: i for i, (_, sec, _) in enumerate(SECTIONS, start=3)}
    sec_title = {sec: t for t, sec, _ in SECTIONS}
    rows = [(sec_no[a], sec_title[a], a, f, pol) for a, fl in REPORT_LISTS.items() for f, pol in fl]
    layout = "layout AS " + _values(rows, ["section_no", "section", "aspect", "field", "pol"])
    return with_(REVIEWS, NREVIEWS, SEL20, LEXICON, POLARITY, mentions_cte("sel20"), PLACES, _aspect_tables(),
                 *summary_ctes("sel20"), HEADER, layout, """tp AS (
  SELECT data_id, aspect, polarity AS pol, phrase AS text,
    row_number() OVER (PARTITION BY data_id, aspect, polarity ORDER BY n DESC, phrase) - 1 AS ord
  FROM (SELECT data_id, aspect, polarity, phrase, count(DISTINCT fetch_pos) AS n FROM mentions GROUP BY ALL) t)""", """sg AS (
  SELECT c.data_id, c.aspect, 'suggest' AS pol, replace(i.template, '%s', c.term) AS text, c.r - 1 AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY data_id, aspect ORDER BY n DESC, term) AS r
        FROM (SELECT data_id, aspect, term, count(DISTINCT fetch_pos) AS n FROM mentions WHERE pol < 0
              GROUP BY ALL) c0) c
  JOIN aspect_info i ON i.aspect = c.aspect)""", """lists AS (
  SELECT l.section_no, l.section, l.field, x.data_id,
    x.ord + CASE WHEN l.field = 'Website Feedback' AND x.pol = 'criticism'
                 THEN (SELECT count(*) FROM tp t2 WHERE t2.data_id = x.data_id AND t2.aspect = x.aspect
                       AND t2.pol = 'praise') ELSE 0 END AS ordinal, x.text
  FROM (SELECT * FROM tp UNION ALL SELECT * FROM sg) x JOIN layout l ON l.aspect = x.aspect AND l.pol = x.pol)""",
                 """pri AS (
  SELECT s.data_id, s.aspect, s.issue, row_number() OVER (PARTITION BY s.data_id ORDER BY s.score DESC, ai.ord) AS p
  FROM (SELECT a.data_id, a.aspect, a.score, iss.issue
        FROM (SELECT data_id, aspect, sum(CASE WHEN rating > 0 THEN 5 - rating ELSE 0 END) AS score
              FROM (SELECT DISTINCT data_id, fetch_pos, rating, aspect FROM mentions WHERE pol < 0) d GROUP BY ALL) a
        JOIN (SELECT data_id, aspect, first(phrase ORDER BY n DESC, phrase) AS issue
              FROM (SELECT data_id, aspect, phrase, count(DISTINCT fetch_pos) AS n FROM mentions WHERE pol < 0
                    GROUP BY ALL) q GROUP BY ALL) iss USING (data_id, aspect)) s
  JOIN aspect_info ai ON ai.aspect = s.aspect
  QUALIFY p <= 5)""", body=f"""
SELECT data_id, CAST(section_no AS BIGINT) AS section_no, section, field, CAST(ordinal AS BIGINT) AS ordinal, text,
  field <> 'Reviews' OR ordinal < 10 AS shown FROM (
  SELECT h.data_id, 0 AS section_no, 'Header' AS section, 'Title' AS field, 0 AS ordinal, coalesce(h.title, '') AS text
  FROM hdr h JOIN summ USING (data_id)
  UNION ALL
  SELECT h.data_id, 0, 'Header', 'Rating', 0,
    concat({_star_sql('h.rating')}, ' ', coalesce(CAST(h.rating AS VARCHAR), 'n/a'))
  FROM hdr h JOIN summ USING (data_id)
  UNION ALL SELECT h.data_id, 0, 'Header', 'Address', 0, coalesce(h.address, '') FROM hdr h JOIN summ USING (data_id)
  UNION ALL SELECT h.data_id, 0, 'Header', 'Total Reviews', 0, CAST(h.total_reviews AS VARCHAR) FROM hdr h JOIN summ USING (data_id)
  UNION ALL SELECT data_id, 1, 'Summary', 'Summary', 0, coalesce(summary, '') FROM summ
  UNION ALL SELECT data_id, 2, 'Overall Sentiment', 'Average Score', 0,
    concat(coalesce(CAST(average_score AS VARCHAR), 'n/a'), '/5') FROM summ
  UNION ALL SELECT data_id, 2, 'Overall Sentiment', 'Sentiment Distribution', 0,
    concat('Positive: ', coalesce(CAST(positive_percentage AS VARCHAR), 'n/a'), '%') FROM summ
  UNION ALL SELECT data_id, 2, 'Overall Sentiment', 'Sentiment Distribution', 1,
    concat('Neutral: ', coalesce(CAST(neutral_percentage AS VARCHAR), 'n/a'), '%') FROM summ
  UNION ALL SELECT data_id, 2, 'Overall Sentiment', 'Sentiment Distribution', 2,
    concat('Negative: ', coalesce(CAST(negative_percentage AS VARCHAR), 'n/a'), '%') FROM summ
  UNION ALL SELECT data_id, section_no, section, field, ordinal, text FROM lists
  UNION ALL SELECT p.data_id, 10, 'Top Improvement Priorities', 'Priorities', (p.p - 1) * 4 + k.j,
    CASE k.j WHEN 0 THEN concat('Priority ', CAST(p.p AS VARCHAR), ': ', ai.category)
             WHEN 1 THEN concat('Issue: ', p.issue)
             WHEN 2 THEN concat('Suggestion: ', replace(ai.template, '%s', p.issue))
             ELSE concat('Potential Impact: ', ai.impact) END
  FROM pri p JOIN aspect_info ai ON ai.aspect = p.aspect, (SELECT unnest([0, 1, 2, 3]) AS j) k
  UNION ALL SELECT data_id, 11, 'Reviews', 'Reviews', rank_desc - 1,
    concat("user", ' | ', {_star_sql('rating')}, ' | ', date, ' | ', review_text)
  FROM sel20) u""")


ORACLE["report_flatten"] = _r1()

ORACLE["full_analysis"] = with_(REVIEWS, NREVIEWS, PAGES, """kept AS (
  SELECT data_id, page_no FROM (
    SELECT *, coalesce(sum(n_reviews) OVER (PARTITION BY data_id ORDER BY page_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              coalesce(bool_or(NOT has_next) OVER (PARTITION BY data_id ORDER BY page_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped
    FROM pgx) t WHERE before < 150 AND NOT stopped)""", """chosen AS (
  SELECT n.* FROM nreviews n JOIN kept USING (data_id, page_no))""",
                                BATCHED.replace("FROM nreviews", "FROM chosen").format(bs=15), BATCH_STATE,
                                LEXICON, POLARITY, mentions_cte("batched", ["batch_id"]), PLACES, _aspect_tables(), *summary_ctes("chosen"), """pt AS (
  SELECT t.data_id, CAST(count(*) FILTER (WHERE nb2 >= 2 AND CAST(nb2 AS DOUBLE) >= 0.5 * nb) AS BIGINT) AS n_persistent
  FROM (SELECT data_id, aspect, term, polarity, count(DISTINCT batch_id) AS nb2 FROM mentions GROUP BY ALL) t
  JOIN (SELECT data_id, max(batch_id) + 1 AS nb FROM batch_state GROUP BY data_id) b USING (data_id) GROUP BY t.data_id)""", """lt AS (
  SELECT c.data_id, CASE WHEN p.data_id IS NULL THEN 'first' WHEN c.a - p.a >= 0.5 THEN 'improving' WHEN c.a - p.a <= -0.5 THEN 'declining' ELSE 'stable' END AS trend
  FROM (SELECT data_id, batch_id, CASE WHEN n_rated > 0 THEN sum_rating / n_rated END AS a FROM batch_state
        QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY batch_id DESC) = 1) c
  LEFT JOIN (SELECT data_id, batch_id, CASE WHEN n_rated > 0 THEN sum_rating / n_rated END AS a FROM batch_state) p
    ON p.data_id = c.data_id AND p.batch_id = c.batch_id - 1)""", """ti AS (
  SELECT s.data_id, i.issue AS top_issue
  FROM (SELECT data_id, aspect, sum(CASE WHEN rating > 0 THEN 5 - rating ELSE 0 END * (batch_id + 1)) AS score
        FROM (SELECT DISTINCT data_id, batch_id, fetch_pos, rating, aspect FROM mentions WHERE pol < 0) d GROUP BY ALL) s
  JOIN (SELECT data_id, aspect, first(phrase ORDER BY n DESC, phrase) AS issue
        FROM (SELECT data_id, aspect, phrase, sum(batch_id + 1) AS n
              FROM (SELECT DISTINCT data_id, batch_id, fetch_pos, aspect, phrase FROM mentions WHERE pol < 0) e GROUP BY ALL) q GROUP BY ALL) i
    USING (data_id, aspect)
  JOIN aspect_info ai ON ai.aspect = s.aspect
  QUALIFY row_number() OVER (PARTITION BY s.data_id ORDER BY s.score DESC, ai.ord) = 1)""", body=f"""
SELECT w.data_id, c.n_reviews, w.n_batches,
  CAST(CASE WHEN w.n_batches > 1 THEN 1 + len(list_filter({_spans(7, 18)}, lambda s: w.n_batches > s)) ELSE 0 END
       AS BIGINT) AS n_levels, {_scores()},
  CAST(least(5, coalesce(m.n, 0)) AS BIGINT) AS n_priorities, ti.top_issue, lt.trend, coalesce(pt.n_persistent, 0) AS n_persistent,
  concat(summ.summary, ' Latest period: ', lt.trend, '. Persistent themes: ', CAST(coalesce(pt.n_persistent, 0) AS VARCHAR), '.') AS summary
FROM (SELECT data_id, CAST(count(*) AS BIGINT) AS n_batches,
        CAST(sum(n_rated * (batch_id + 1)) AS BIGINT) AS n_rated,
        CAST(sum(sum_rating * (batch_id + 1)) AS DOUBLE) AS sum_rating,
        CAST(sum(n_positive * (batch_id + 1)) AS BIGINT) AS n_positive,
        CAST(sum(n_neutral * (batch_id + 1)) AS BIGINT) AS n_neutral,
        CAST(sum(n_negative * (batch_id + 1)) AS BIGINT) AS n_negative
      FROM batch_state GROUP BY data_id) w
JOIN (SELECT data_id, CAST(count(*) AS BIGINT) AS n_reviews FROM chosen GROUP BY data_id) c USING (data_id)
JOIN (SELECT data_id, summary FROM summ) summ USING (data_id)
LEFT JOIN (SELECT data_id, count(DISTINCT aspect) AS n FROM mentions WHERE pol < 0 GROUP BY data_id) m USING (data_id)
LEFT JOIN pt USING (data_id) LEFT JOIN lt USING (data_id) LEFT JOIN ti USING (data_id)""")

ORACLE["incremental_priorities"] = ORACLE["improvement_priorities"]

ORACLE["incremental_changes"] = with_(REVIEWS, body="""
SELECT c.data_id, round(p.a, 1) AS previous_score, round(c.a, 1) AS current_score, p.a IS NULL OR abs(c.a - p.a) >= 0.3 AS significant
FROM (SELECT data_id, CAST(sum(rating) AS DOUBLE) / count(*) AS a FROM reviews GROUP BY data_id) c
LEFT JOIN (SELECT data_id, CAST(sum(rating) AS DOUBLE) / count(*) AS a FROM reviews WHERE ts < TIMESTAMP '2024-01-21 00:00:00' GROUP BY data_id) p USING (data_id)""")

ORACLE["aspect_period_trend"] = with_(*BASE_M, BATCHED.format(bs=5), mentions_cte("batched", ["batch_id"]), """per AS (
  SELECT data_id, aspect, batch_id, CAST(sum(pol) AS BIGINT) AS net
  FROM (SELECT DISTINCT data_id, batch_id, aspect, fetch_pos, pol FROM mentions WHERE pol <> 0) d
  GROUP BY ALL)""", body="""
SELECT c.data_id, c.aspect, c.batch_id, c.net, p.net AS previous_net,
  CASE WHEN p.net IS NULL THEN 'first' WHEN c.net - p.net >= 1 THEN 'improving'
       WHEN c.net - p.net <= -1 THEN 'declining' ELSE 'stable' END AS trend
FROM per c LEFT JOIN per p ON p.data_id = c.data_id AND p.aspect = c.aspect AND p.batch_id = c.batch_id - 1""")

ORACLE["incremental_recency"] = ORACLE["recency_weighted_sentiment"]

ORACLE["issue_history"] = with_(*BASE_M, BATCHED.format(bs=5), mentions_cte("batched", ["batch_id"]), """said AS (
  SELECT data_id, aspect, term, batch_id, CAST(count(DISTINCT fetch_pos) AS BIGINT) AS n FROM mentions WHERE pol < 0 GROUP BY ALL),
spells AS (SELECT *, CAST(sum(start) OVER (PARTITION BY data_id, aspect, term ORDER BY batch_id) AS BIGINT) AS spell FROM (
  SELECT *, CASE WHEN batch_id - lag(batch_id) OVER (PARTITION BY data_id, aspect, term ORDER BY batch_id) <= 2 THEN 0 ELSE 1 END AS start FROM said) x)""",
                                body="""
SELECT data_id, aspect, term, spell, CASE WHEN spell = 1 THEN 'opened' ELSE 'reopened' END AS event, first_batch, last_batch,
  last_batch - first_batch + 1 AS n_batches, n_saying, n_reviews, CASE WHEN nb - 1 - last_batch < 2 THEN 'open' ELSE 'resolved' END AS state,
  CASE WHEN nb - 1 - last_batch >= 2 THEN last_batch + 1 END AS resolved_batch
FROM (SELECT data_id, aspect, term, spell, min(batch_id) AS first_batch, max(batch_id) AS last_batch, CAST(count(*) AS BIGINT) AS n_saying,
        CAST(sum(n) AS BIGINT) AS n_reviews FROM spells GROUP BY ALL) s
JOIN (SELECT data_id, CAST(max(batch_id) + 1 AS BIGINT) AS nb FROM batched GROUP BY data_id) b USING (data_id)""")

# Every pair of batches of a theme, silent ones included.
ORACLE["theme_trend"] = with_(*BASE_M, BATCHED.format(bs=5), mentions_cte("batched", ["batch_id"]), """sizes AS (
  SELECT data_id, batch_id, count(*) AS n FROM batched GROUP BY ALL),
said AS (SELECT data_id, aspect, term, polarity, batch_id, count(DISTINCT fetch_pos) AS k FROM mentions GROUP BY ALL),
series AS (SELECT t.data_id, t.aspect, t.term, t.polarity, z.batch_id, z.n, coalesce(s.k, 0) AS k
  FROM (SELECT DISTINCT data_id, aspect, term, polarity FROM said) t JOIN sizes z USING (data_id)
  LEFT JOIN said s ON s.data_id = t.data_id AND s.aspect = t.aspect AND s.term = t.term AND s.polarity = t.polarity AND s.batch_id = z.batch_id),
pairs AS (SELECT data_id, aspect, term, polarity, CAST(sum(sign(b.k * a.n - a.k * b.n)) AS BIGINT) AS s
  FROM series a JOIN series b USING (data_id, aspect, term, polarity) WHERE a.batch_id < b.batch_id GROUP BY ALL),
ties AS (SELECT data_id, aspect, term, polarity, sum(t::DOUBLE * (t - 1) * (2 * t + 5)) AS tied, CAST(sum(t) AS BIGINT) AS nb,
    CAST(sum(t) FILTER (WHERE share > 0) AS BIGINT) AS n_saying
  FROM (SELECT data_id, aspect, term, polarity, k / n AS share, count(*) AS t FROM series GROUP BY ALL) q GROUP BY ALL),
test AS (SELECT *, coalesce(s, 0) AS s0, (nb::DOUBLE * (nb - 1) * (2 * nb + 5) - tied) / 18.0::DOUBLE AS var
  FROM ties LEFT JOIN pairs USING (data_id, aspect, term, polarity)),
scored AS (SELECT *, CASE WHEN var > 0 THEN (s0 - sign(s0)) / sqrt(var) END AS z0 FROM test)""", body="""
SELECT data_id, aspect, term, polarity, n_saying, nb AS n_place_batches, s0 AS s, round(z0, 3) AS z, CAST(sign(s0) AS INTEGER) AS sign,
  CASE WHEN z0 >= 1.96 THEN 'rising' WHEN z0 <= -1.96 THEN 'falling' ELSE 'steady' END AS label FROM scored""")

PROSE = r"""prose AS (SELECT TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS data_id, doc_id AS fetch_pos, text AS review_text FROM documents)"""


def pair_ctes(src: str) -> str:
    def part(k, row, column):
        return f"CASE WHEN {k} > 0 THEN {k} * ln({k} * t / (({row}) * ({column}))) ELSE 0.0::DOUBLE END"
    llr = f"2 * ({part('x', 'a', 'b')} + {part('(a - x)', 'a', 't - b')} + {part('(b - x)', 't - a', 'b')} + {part('(t - a - b + x)', 't - a', 't - b')})"
    return rf"""clauses AS (SELECT data_id, fetch_pos, list_filter(regexp_split_to_array(c, '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> '') AS ww
  FROM (SELECT data_id, fetch_pos, unnest(string_split_regex(lower(coalesce(review_text, '')), '[.!?;,\n]+|\s+but\s+')) AS c FROM {src}) c0),
said AS (SELECT data_id, fetch_pos, ww[i] AS first, ww[i + 1] AS second FROM (SELECT *, unnest(range(1, len(ww))) AS i FROM clauses WHERE len(ww) > 1) p0),
pairs AS (SELECT first, second, CAST(count(*) AS BIGINT) AS n FROM said GROUP BY ALL),
rated AS (SELECT first, second, p.n, n_first, n_second, round({llr}, 3) AS llr, x * t > a * b AS more
  FROM (SELECT *, n::DOUBLE AS x, n_first::DOUBLE AS a, n_second::DOUBLE AS b, (SELECT sum(n) FROM pairs)::DOUBLE AS t FROM pairs
        JOIN (SELECT first, CAST(sum(n) AS BIGINT) AS n_first FROM pairs GROUP BY first) f USING (first)
        JOIN (SELECT second, CAST(sum(n) AS BIGINT) AS n_second FROM pairs GROUP BY second) s USING (second)) p WHERE p.n >= 5),
found AS (SELECT first, second, n, n_first, n_second, llr FROM rated WHERE more AND llr >= 10.83)"""


def _mined(known) -> str:
    listed = "(" + ", ".join(f"'{t}'" for t, _ in known) + ")"
    return f"""SELECT data_id, first || ' ' || second AS theme, n_reviews, llr
FROM (SELECT data_id, first, second, CAST(count(*) AS BIGINT) AS n_reviews FROM (SELECT DISTINCT data_id, fetch_pos, first, second FROM said) d GROUP BY ALL) r
JOIN found USING (first, second) WHERE n_reviews >= 2 AND first NOT IN {listed} AND second NOT IN {listed}"""


def _mined_oracles() -> dict[str, str]:
    from guestlens.sources.standins import PROSE_LEXICON, TEST_LEXICON
    return {"document_collocations": with_(PROSE, pair_ctes("prose"), body="SELECT * FROM found"),
            "mined_themes": with_(REVIEWS, pair_ctes("reviews"), body=_mined(TEST_LEXICON)),
            "mined_prose_themes": with_(PROSE, pair_ctes("prose"), body=_mined(PROSE_LEXICON))}


ORACLE.update(_mined_oracles())


def _phrases() -> str:
    from guestlens.operators.aspects import ASPECTS, NEGATORS
    names = "[" + ", ".join(f"'{a}'" for a, _ in ASPECTS) + "]"
    negators = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in NEGATORS) + "]"

    def clauses(name, columns, source):
        return rf"""{name} AS (SELECT {columns}, cno, list_filter(regexp_split_to_array(c, '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> '') AS ww
  FROM (SELECT {columns}, unnest(cs) AS c, unnest(range(len(cs))) AS cno
        FROM (SELECT {columns}, string_split_regex(lower(coalesce(review_text, '')), '[.!?;,\n]+|\s+but\s+') AS cs FROM {source}) s0) s1)"""

    def grams(name, columns, source):
        return f"""{name} AS (SELECT {columns}, cno, i, n, array_to_string(ww[i:i + n - 1], ' ') AS phrase, i > 1 AND list_contains({negators}, ww[i - 1]) AS negated
  FROM (SELECT {columns}, cno, ww, n, unnest(range(1, len(ww) - n + 2)) AS i FROM {source}, (SELECT unnest([1, 2, 3, 4]) AS n) k) g)"""
    return "WITH RECURSIVE " + ",\n".join([
        PROSE, "bench AS (SELECT item_id, text AS review_text FROM benchmark)", clauses("bc", "item_id", "bench"), grams("bg", "item_id", "bc"),
        f"vocab AS (SELECT DISTINCT phrase, {names}[len(phrase) % 8 + 1] AS aspect, unicode(phrase) % 3 - 1 AS sign FROM bg)",
        clauses("pc", "data_id, fetch_pos", "prose"), grams("pg", "data_id, fetch_pos", "pc"),
        """longest AS (SELECT data_id, fetch_pos, cno, i, max_by(phrase, n) AS phrase, max(n) AS n, any_value(negated) AS negated
  FROM pg WHERE phrase IN (SELECT phrase FROM vocab) GROUP BY data_id, fetch_pos, cno, i),
nxt AS (SELECT l.*, (SELECT min(m.i) FROM longest m WHERE m.fetch_pos = l.fetch_pos AND m.cno = l.cno AND m.i >= l.i + l.n) AS follow FROM longest l),
chain AS (SELECT fetch_pos, cno, min(i) AS i FROM longest GROUP BY fetch_pos, cno
  UNION ALL SELECT c.fetch_pos, c.cno, x.follow FROM chain c JOIN nxt x ON x.fetch_pos = c.fetch_pos AND x.cno = c.cno AND x.i = c.i WHERE x.follow IS NOT NULL),
chosen AS (SELECT l.data_id, l.fetch_pos, l.cno, v.phrase, v.aspect, CASE WHEN l.negated THEN -v.sign ELSE v.sign END AS sign
  FROM chain JOIN longest l USING (fetch_pos, cno, i) JOIN vocab v USING (phrase)),
signed AS (SELECT *, sum(sign) OVER (PARTITION BY fetch_pos, cno) AS pol FROM chosen)"""]) + """
SELECT data_id, aspect, CASE WHEN pol > 0 THEN 'praise' WHEN pol < 0 THEN 'criticism' ELSE 'neutral' END AS polarity, phrase,
  CAST(count(DISTINCT fetch_pos) AS BIGINT) AS n_reviews, CAST(count(*) AS BIGINT) AS n_mentions
FROM signed WHERE aspect IS NOT NULL GROUP BY ALL"""


ORACLE["phrase_feedback"] = _phrases()

ORACLE["bucket_store_upsert"] = ORACLE["analysis_upsert"]
ORACLE["bucket_store_lookup"] = ORACLE["analysis_lookup"]

ORACLE["stream_pages_landed_twice"] = ORACLE["review_normalize"]

PAGE_LINKS = PAGES + """,
links AS (SELECT data_id, CASE WHEN page_no = 0 THEN '' ELSE concat(data_id, '-', page_no) END AS token,
    CASE WHEN has_next THEN concat(data_id, '-', page_no + 1) WHEN data_id % 11 = 3 THEN concat(data_id, '-2') END AS next_token
  FROM pgx WHERE (data_id * 7 + page_no) % 29 <> 4),
size AS (SELECT data_id, count(*) AS n FROM links GROUP BY data_id),
walk AS (SELECT data_id, token, CAST(0 AS BIGINT) AS page_no FROM links WHERE token = ''
  UNION ALL SELECT w.data_id, t.token, w.page_no + 1 FROM walk w JOIN links l ON l.data_id = w.data_id AND l.token = w.token
  JOIN links t ON t.data_id = l.data_id AND t.token = l.next_token JOIN size s ON s.data_id = w.data_id WHERE w.page_no < s.n),
numbered AS (SELECT l.*, w.page_no FROM links l LEFT JOIN (SELECT data_id, token, min(page_no) AS page_no FROM walk GROUP BY ALL) w USING (data_id, token)),
ordered AS (SELECT a.data_id, a.token, a.next_token, a.page_no,
    CASE WHEN a.page_no IS NULL THEN 'unreached' WHEN a.next_token IS NULL THEN 'last' WHEN b.token IS NULL THEN 'next missing'
         WHEN b.page_no <= a.page_no THEN 'cycle' ELSE 'ok' END AS state
  FROM numbered a LEFT JOIN numbered b ON b.data_id = a.data_id AND b.token = a.next_token)"""

ORACLE["page_order"] = with_(REVIEWS, PAGE_LINKS, body="SELECT * FROM ordered").replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["page_chains"] = with_(REVIEWS, PAGE_LINKS, body="""
SELECT data_id, count(page_no) AS n_pages, count(*) FILTER (WHERE state = 'unreached') AS n_unreached,
  coalesce(arg_max(state, page_no), 'no first page') AS ends FROM ordered GROUP BY data_id""").replace("WITH ", "WITH RECURSIVE ", 1)

CUT_PAGES = PAGES + """,
kept AS (SELECT data_id, page_no FROM (
    SELECT *, coalesce(sum(n_reviews) OVER (PARTITION BY data_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      coalesce(bool_or(NOT has_next OR (data_id + page_no) % 7 = 2) OVER (PARTITION BY data_id ORDER BY page_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM pgx) t WHERE before < 60 AND NOT stopped),
chosen AS (SELECT n.* FROM nreviews n JOIN kept USING (data_id, page_no))"""

ORACLE["full_selection_landed"] = with_(REVIEWS, NREVIEWS, CUT_PAGES, body='SELECT data_id, page_no, fetch_pos, "user", rating FROM chosen')
ORACLE["full_analysis_landed"] = with_(REVIEWS, NREVIEWS, CUT_PAGES, BATCHED.replace("FROM nreviews", "FROM chosen").format(bs=15), BATCH_STATE, body=f"""
SELECT data_id, n_all AS n_reviews, n_batches, {_scores()}
FROM (SELECT data_id, CAST(sum(n_reviews) AS BIGINT) AS n_all, CAST(count(*) AS BIGINT) AS n_batches,
        CAST(sum(n_rated * (batch_id + 1)) AS BIGINT) AS n_rated, CAST(sum(sum_rating * (batch_id + 1)) AS DOUBLE) AS sum_rating,
        CAST(sum(n_positive * (batch_id + 1)) AS BIGINT) AS n_positive, CAST(sum(n_neutral * (batch_id + 1)) AS BIGINT) AS n_neutral,
        CAST(sum(n_negative * (batch_id + 1)) AS BIGINT) AS n_negative FROM batch_state GROUP BY data_id) w""")


def _representative() -> str:
    g = "data_id, aspect, polarity"
    steps = ["t1 AS (SELECT data_id, aspect, polarity, 1 AS pick, 1 AS rank FROM cand WHERE rank = 1)"]
    for pick in (2, 3):
        steps.append(f"""t{pick} AS (SELECT * FROM t{pick - 1} UNION ALL SELECT {g}, {pick} AS pick, rank FROM (
  SELECT c.data_id, c.aspect, c.polarity, c.rank, round(0.7::DOUBLE * c.relevance - (1 - 0.7::DOUBLE) * max(alike), 6) AS score
  FROM cand c JOIN likeness k ON k.data_id = c.data_id AND k.aspect = c.aspect AND k.polarity = c.polarity AND k.a = c.rank
  JOIN t{pick - 1} t ON t.data_id = c.data_id AND t.aspect = c.aspect AND t.polarity = c.polarity AND t.rank = k.b
  WHERE NOT EXISTS (SELECT 1 FROM t{pick - 1} o WHERE o.data_id = c.data_id AND o.aspect = c.aspect AND o.polarity = c.polarity AND o.rank = c.rank)
  GROUP BY c.data_id, c.aspect, c.polarity, c.rank, c.relevance) s QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY score DESC, rank) = 1)""")
    return with_(REVIEWS, """srows AS (SELECT data_id, event_id * 1000 + sno AS fetch_pos, event_id, CAST(rating AS DOUBLE) AS rating, ts, trim(s) AS review_text
  FROM (SELECT *, unnest(ss) AS s, unnest(range(len(ss))) AS sno FROM (SELECT *, string_split_regex(coalesce(review_text, ''), '[.!?\\n]+') AS ss FROM reviews) q0) q1
  WHERE trim(s) <> '')""", LEXICON, POLARITY, mentions_cte("srows"), rf"""grouped AS (
  SELECT {g}, key, min(sentence) AS sentence, count(DISTINCT event_id)::BIGINT AS support
  FROM (SELECT m.data_id, m.aspect, m.polarity, s.event_id, s.review_text AS sentence,
          array_to_string(list_filter(regexp_split_to_array(lower(s.review_text), '[^\p{{L}}\p{{N}}'']+'), lambda x: x <> ''), ' ') AS key
        FROM mentions m JOIN srows s ON s.fetch_pos = m.fetch_pos) x GROUP BY ALL),
tf AS (SELECT {g}, key, sentence, support, word, count(*) AS tf FROM (SELECT *, unnest(string_split(key, ' ')) AS word FROM grouped) u GROUP BY ALL),
num AS (SELECT {g}, count(*) AS n FROM grouped GROUP BY ALL),
wrd AS (SELECT {g}, word, ln(1 + n::DOUBLE / df) AS idf, mass * ln(1 + n::DOUBLE / df) AS centre
  FROM (SELECT {g}, word, count(*) AS df, sum(support * tf)::DOUBLE AS mass FROM tf GROUP BY ALL) q JOIN num USING ({g})),
vec AS (SELECT t.*, t.tf * w.idf AS weight, w.centre FROM tf t JOIN wrd w USING ({g}, word)),
len AS (SELECT {g}, sqrt(sum(centre * centre)) AS length FROM wrd GROUP BY ALL),
rel AS (SELECT {g}, key, sentence, support, norm, round(dot / (norm * length), 6) AS relevance
  FROM (SELECT {g}, key, sentence, support, sqrt(sum(weight * weight)) AS norm, sum(weight * centre) AS dot FROM vec GROUP BY ALL) q JOIN len USING ({g})),
cand AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY relevance DESC, support DESC, key) AS rank FROM rel
  QUALIFY row_number() OVER (PARTITION BY {g} ORDER BY relevance DESC, support DESC, key) <= 10),
cv AS (SELECT c.data_id, c.aspect, c.polarity, c.rank, c.norm, v.word, v.weight FROM cand c JOIN vec v USING ({g}, key)),
dots AS (SELECT a.data_id, a.aspect, a.polarity, a.rank AS a, b.rank AS b, sum(a.weight * b.weight) AS dot
  FROM cv a JOIN cv b ON a.data_id = b.data_id AND a.aspect = b.aspect AND a.polarity = b.polarity AND a.word = b.word GROUP BY ALL),
likeness AS (SELECT x.data_id, x.aspect, x.polarity, x.rank AS a, y.rank AS b, round(coalesce(dot, 0.0::DOUBLE) / (x.norm * y.norm), 6) AS alike
  FROM cand x JOIN cand y USING ({g}) LEFT JOIN dots d ON d.data_id = x.data_id AND d.aspect = x.aspect AND d.polarity = x.polarity AND d.a = x.rank AND d.b = y.rank)""",
                 *steps, body=f"""
SELECT data_id, aspect, polarity, CAST(pick AS BIGINT) AS pick, sentence, support, relevance FROM t3 JOIN cand USING ({g}, rank)""")


ORACLE["representative_sentences"] = _representative()

ORACLE["status_expire_stream"] = ORACLE["status_ttl_expire"]
ORACLE["status_sessions_expired"] = with_(STATUS_EVENTS, """flagged AS (
  SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY token ORDER BY created_at, seq) <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS start FROM status_events),
numbered AS (SELECT *, sum(start) OVER (PARTITION BY token ORDER BY created_at, seq) AS session FROM flagged)""", body=f"""
SELECT token, {TS_TEXT.format('started_at')} AS started_at, {TS_TEXT.format('last_at')} AS last_at, n_events, status, error
FROM (SELECT token, session, min(created_at) AS started_at, max(created_at) AS last_at, CAST(count(*) AS BIGINT) AS n_events,
        last(status ORDER BY created_at, seq) AS status, last(error ORDER BY created_at, seq) AS error FROM numbered GROUP BY ALL) s
WHERE last_at < (SELECT max(created_at) FROM status_events) - INTERVAL 24 HOURS""")
