-- name: o_gate_hints
SELECT doc_id, '/' || lang || CASE WHEN length(body) > 1500 THEN '/legal/privacy' ELSE '/about' END AS path, lower(split_part(body, chr(10), 1)) AS title, lower(trim(body, ' ' || chr(10) || chr(9))) AS txt,
  list_filter(string_split(body, chr(10)), lambda h: length(h) < 40) AS headings FROM fx_policies

-- name: o_gate_counts
SELECT doc_id, length(txt) AS n, len(list_filter($PATH_PAGE_HINTS, lambda h: contains(lower(path), h))) AS p, len(list_filter($STRONG_PAGE_HINTS, lambda h: contains(substring(title, 1, 512), h))) AS t,
  len(list_filter($STRONG_PAGE_HINTS, lambda h: contains(substring(txt, 1, 800), h))) AS l, len(list_filter($STRONG_PAGE_HINTS, lambda h: contains(txt, h))) AS s, len(list_filter($SUPPORTING_PAGE_HINTS, lambda h: contains(txt, h))) AS u,
  len(list_filter(headings, lambda x: regexp_matches(lower(x), 'privacy policy|privacy notice|terms of service|terms and conditions|개인정보처리방침|개인정보 처리방침|이용약관'))) AS h FROM o_gate_hints

-- name: pol_1_page_gate
SELECT doc_id, round(score, 4) AS gate_score, floor(least(0.99, score / 10) * 100 + 0.5) / 100 AS confidence, n >= 600 AND score >= 4 AND (t > 0 OR l > 0 OR u >= 2 OR h > 0) AS policy_like
FROM (SELECT *, CAST(least(p, 1) * 4 + least(t, 1) * 3 + least(l, 1) * 4 + least(s, 3) * 1.5 + least(u, 4) * 0.75 + least(h, 2) * 1.5 + CASE WHEN n >= 1200 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM o_gate_counts)

-- name: o_labels
SELECT * FROM (VALUES $LABEL_ROWS) AS l(path, en, ko)

-- name: pol_30_summaries
SELECT v.doc_id, array_to_string(list_filter(['Risk level appears to be ''' || lv.en || '''.',
  CASE WHEN d.txt IS NULL THEN (SELECT en FROM o_labels WHERE path = 'summary.no_data') ELSE 'The document suggests possible collection of: ' || d.txt || '.' END,
  CASE WHEN r.txt IS NOT NULL THEN 'Check ''' || r.txt || ''' first.' END, CASE WHEN g.txt IS NOT NULL THEN 'Positives found: ' || g.txt || '.' END], lambda x: x IS NOT NULL), ' ') AS summary
FROM o_levels v JOIN o_labels lv ON lv.path = 'level.' || v.level
LEFT JOIN (SELECT w.doc_id, string_agg(l.en, ', ' ORDER BY w.cat_ord) AS txt FROM (SELECT DISTINCT doc_id, cat_ord, category FROM o_words) w JOIN o_labels l ON l.path = 'data.' || w.category GROUP BY w.doc_id) d USING (doc_id)
LEFT JOIN (SELECT x.doc_id, min_by(l.en, x.sev_ord * 100 + x.rule_ord) AS txt FROM o_risks x JOIN o_labels l ON l.path = 'risk.' || x.risk_id GROUP BY x.doc_id) r USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(en, ', ' ORDER BY ord) AS txt FROM (SELECT p.doc_id, l.en, o.ord, row_number() OVER (PARTITION BY p.doc_id ORDER BY o.ord) AS rn FROM o_positives p JOIN (VALUES ('delete_right', 1), ('security_controls', 2), ('retention_policy', 3)) AS o(positive, ord) USING (positive)
  JOIN o_labels l ON l.path = 'positive.' || p.positive) WHERE rn <= 2 GROUP BY doc_id) g USING (doc_id)
WHERE v.status = 'analyzed'

-- name: pol_31_labelled_risks
SELECT r.doc_id, r.risk_id, l.ko AS label FROM o_risks r JOIN o_policy p USING (doc_id) JOIN o_labels l ON l.path = 'risk.' || r.risk_id WHERE p.status = 'analyzed'

-- name: o_rotated
SELECT *, CAST(sum(CASE WHEN resource_type = 'main_frame' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no FROM o_requests

-- name: str_1_session_rotation
SELECT request_id, tab_id, session_no FROM o_rotated

-- name: str_1_sessions
SELECT tab_id, session_no, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) AS events, min_by(host, struct_pack(ts := ts, id := request_id)) AS first_host FROM o_rotated GROUP BY tab_id, session_no

-- name: o_visits
SELECT *, CAST(sum(starts) OVER (PARTITION BY tab_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS visit_no
FROM (SELECT request_id, tab_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tab_id ORDER BY ts, request_id)) < 3600000000 THEN 0 ELSE 1 END AS starts FROM o_requests)

-- name: str_2_visits
SELECT tab_id, min(ts) AS started_at, count(*) AS events FROM o_visits GROUP BY tab_id, visit_no

-- name: str_2_visit_numbers
SELECT request_id, tab_id, visit_no FROM o_visits

-- name: o_current
SELECT r.request_id, r.tab_id, r.session_no FROM o_rotated r JOIN (SELECT tab_id, max(session_no) AS session_no FROM o_rotated GROUP BY tab_id) USING (tab_id, session_no)

-- name: str_3_session_members
SELECT request_id, tab_id FROM o_current

-- name: str_4_stale_rejection
SELECT request_id, tab_id, session_no FROM o_current

-- name: o_bucket
SELECT tab_id, list_reduce(list_concat([{'id': 0::BIGINT, 'main': true, 'us': 0::BIGINT, 'tokens': 2::DOUBLE, 'last': -1::BIGINT, 'kept': []::BIGINT[]}],
   list({'id': request_id, 'main': resource_type = 'main_frame', 'us': epoch_us(ts), 'tokens': 0::DOUBLE, 'last': 0::BIGINT, 'kept': []::BIGINT[]} ORDER BY ts, request_id)),
   lambda a, x: CASE WHEN x.main THEN {'id': x.id, 'main': true, 'us': x.us, 'tokens': 2::DOUBLE, 'last': -1::BIGINT, 'kept': list_append(a.kept, x.id)}
     WHEN CASE WHEN a.last < 0 THEN a.tokens ELSE least(2::DOUBLE, a.tokens + (x.us - a.last) * (1.0::DOUBLE / 43200) / 1e6::DOUBLE) END >= 1
       THEN {'id': x.id, 'main': false, 'us': x.us, 'tokens': CASE WHEN a.last < 0 THEN a.tokens ELSE least(2::DOUBLE, a.tokens + (x.us - a.last) * (1.0::DOUBLE / 43200) / 1e6::DOUBLE) END - 1, 'last': x.us, 'kept': list_append(a.kept, x.id)}
     ELSE {'id': x.id, 'main': false, 'us': x.us, 'tokens': CASE WHEN a.last < 0 THEN a.tokens ELSE least(2::DOUBLE, a.tokens + (x.us - a.last) * (1.0::DOUBLE / 43200) / 1e6::DOUBLE) END, 'last': x.us, 'kept': a.kept} END).kept AS kept FROM fx_requests GROUP BY tab_id

-- name: o_sampled
SELECT r.request_id, r.tab_id, list_contains(b.kept, r.request_id) AS allowed FROM fx_requests r JOIN o_bucket b USING (tab_id)

-- name: str_5_rate_sampling
SELECT request_id, tab_id, allowed FROM o_sampled

-- name: str_5_rate_sampling_stream
SELECT request_id, tab_id, allowed FROM o_sampled

-- name: src_7_minimised_requests_stream
SELECT request_id, tab_id, host, path, method FROM o_requests

-- name: str_6_last_requests
SELECT request_id, tab_id, place FROM (SELECT request_id, tab_id, row_number() OVER (PARTITION BY tab_id ORDER BY ts DESC, request_id DESC) AS place FROM o_requests) WHERE place <= 30

-- name: str_7_cookie_batches
SELECT tab_id, identity, time_bucket(INTERVAL 1 DAY, ts) AS batch_start, count(*) AS changes, max_by(name, struct_pack(a := ts, b := change_id)) AS name, max_by(removed, struct_pack(a := ts, b := change_id)) AS removed,
  min(ts) FILTER (WHERE NOT removed) AS first_set_at, max(ts) FILTER (WHERE NOT removed) AS last_set_at, max(ts) FILTER (WHERE removed) AS deleted_at FROM o_changes GROUP BY tab_id, identity, time_bucket(INTERVAL 1 DAY, ts)

-- name: str_8_fair_queue
SELECT change_id, batch_start, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_start ORDER BY turn, ts DESC, change_id DESC) AS place FROM (
  SELECT change_id, ts, date_trunc('day', ts) AS batch_start, row_number() OVER (PARTITION BY date_trunc('day', ts), ltrim(lower(domain), '.') ORDER BY ts DESC, change_id DESC) AS turn FROM o_changes) WHERE turn <= 10) WHERE place <= 50

-- name: str_12_exclusion_after_attribution
SELECT m.change_id, m.tab_id FROM (SELECT *, count(*) OVER (PARTITION BY change_id) AS n FROM o_cookie_tabs) m JOIN fx_sites s USING (tab_id) WHERE (m.removed OR m.n = 1) AND s.page_host NOT IN (SELECT page_host FROM fx_sites WHERE language = 'fr-FR')

-- name: str_11_attribution_stream
SELECT change_id, CASE WHEN NOT removed THEN min(tab_id) END AS tab_id, CASE WHEN removed THEN site END AS site
FROM o_cookie_tabs WHERE tab_id IN (SELECT tab_id FROM o_requests WHERE resource_type = 'main_frame') GROUP BY change_id, removed, site HAVING removed OR count(*) = 1

-- name: o_updates
SELECT tab_id, ts, request_id, method <> 'GET' AS explicit, CASE WHEN scheme = 'http' THEN 'high' ELSE 'low' END AS level, max(CASE WHEN method <> 'GET' THEN ts END) OVER (PARTITION BY tab_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM o_requests

-- name: str_13_effective_updates
SELECT request_id, tab_id, explicit FROM o_updates WHERE explicit OR held IS NULL OR epoch_us(ts) - epoch_us(held) >= 43200000000

-- name: str_13_indicators
SELECT tab_id, max(ts) AS ts, max_by(level, struct_pack(a := ts, b := request_id)) AS level, max_by(explicit, struct_pack(a := ts, b := request_id)) AS explicit FROM o_updates WHERE explicit OR held IS NULL OR epoch_us(ts) - epoch_us(held) >= 300000000 GROUP BY tab_id

-- name: str_14_recent_tabs
SELECT tab_id, max(ts) AS last_seen_at FROM o_requests GROUP BY tab_id ORDER BY max(ts) DESC, tab_id DESC LIMIT 50

-- name: str_16_changed_scans
SELECT request_id, tab_id FROM (SELECT *, lag(scheme) OVER (PARTITION BY tab_id ORDER BY ts, request_id) AS before FROM o_requests) WHERE before IS NULL OR before <> scheme

-- name: str_1_session_rotation_stream
SELECT request_id, tab_id, session_no FROM o_rotated

-- name: str_13_effective_updates_stream
SELECT request_id, tab_id, explicit FROM o_updates WHERE explicit OR held IS NULL OR epoch_us(ts) - epoch_us(held) >= 43200000000

-- name: str_16_changed_scans_stream
SELECT request_id, tab_id FROM (SELECT *, lag(scheme) OVER (PARTITION BY tab_id ORDER BY ts, request_id) AS before FROM o_requests) WHERE before IS NULL OR before <> scheme

-- name: str_2_visit_numbers_stream
SELECT request_id, tab_id, visit_no FROM o_visits

-- name: o_starts
SELECT tab_id, max(struct_pack(ts := ts, id := request_id)) AS start FROM o_requests WHERE resource_type = 'main_frame' GROUP BY tab_id

-- name: str_3_session_members_stream
SELECT r.request_id, r.tab_id FROM o_requests r JOIN o_starts s USING (tab_id) WHERE struct_pack(ts := r.ts, id := r.request_id) >= s.start

-- name: str_4_stale_rejection_stream
SELECT request_id, tab_id, session_no FROM o_current

-- name: o_closed_days
SELECT *, date_trunc('day', ts) AS batch_start FROM o_changes WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM o_changes) - INTERVAL 1 HOUR

-- name: str_8_fair_queue_stream
SELECT change_id, batch_start, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_start ORDER BY turn, ts DESC, change_id DESC) AS place FROM (
  SELECT change_id, ts, batch_start, row_number() OVER (PARTITION BY batch_start, ltrim(lower(domain), '.') ORDER BY ts DESC, change_id DESC) AS turn FROM o_closed_days) WHERE turn <= 10) WHERE place <= 50

-- name: str_10_cookie_state_stream
SELECT tab_id, identity, name, domain, removed, observed, first_set_at, last_set_at, deleted_at FROM o_cookies
