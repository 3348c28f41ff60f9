-- name: o_banner
SELECT *, banner_text <> '' OR buttons <> '' OR toggle_label <> '' AS detected FROM fx_consents

-- name: src_9_consent_records
SELECT tab_id, detected, choice_kind, CASE WHEN buttons = '' THEN 0 ELSE len(string_split(buttons, '|')) END AS buttons, CASE WHEN toggle_label = '' THEN 0 ELSE 1 END::BIGINT AS toggles FROM o_banner

-- name: o_buttons
SELECT tab_id, choice_kind, pos - 1 AS pos, button, CASE WHEN regexp_matches(lower(button), $CHOICE_necessary_only) THEN 'necessary_only' WHEN regexp_matches(lower(button), $CHOICE_save_choices) THEN 'save_choices'
  WHEN regexp_matches(lower(button), $CHOICE_preferences) THEN 'preferences' WHEN regexp_matches(lower(button), $CHOICE_accept_all) THEN 'accept_all' ELSE 'unknown' END AS type
FROM (SELECT tab_id, choice_kind, unnest(string_split(buttons, '|')) AS button, generate_subscripts(string_split(buttons, '|'), 1) AS pos FROM fx_consents) WHERE button <> ''

-- name: con_1_button_types
SELECT tab_id, pos, button, type FROM o_buttons

-- name: con_2_recorded_choices
SELECT tab_id, pos, CASE WHEN regexp_matches(lower(button), $RECORDED_reject_all) THEN 'reject_all' WHEN regexp_matches(lower(button), $RECORDED_accept_all) THEN 'accept_all' WHEN regexp_matches(lower(button), $RECORDED_save_preferences) THEN 'save_preferences' ELSE '' END AS clicked,
  choice_kind AS recorded FROM o_buttons

-- name: o_banner_texts
SELECT tab_id, 0 AS pos, banner_text AS txt, false AS on_ FROM o_banner WHERE detected
UNION ALL SELECT tab_id, pos + 1, button, false FROM o_buttons
UNION ALL SELECT b.tab_id, 1000, b.toggle_label, b.toggle_checked FROM o_banner b WHERE b.toggle_label <> ''

-- name: o_consent_rules
SELECT * FROM (VALUES (1,'necessary','low',1),(2,'functional','low',1),(3,'personalization','medium',2),(4,'analytics','medium',2),(5,'advertising','high',3),(6,'social','medium',2),(7,'third_party','high',3)) AS r(rule, category, risk, rank)

-- name: o_consent_cats
SELECT h.tab_id, h.category, r.risk, r.rank, bool_or(h.on_) AS enabled, row_number() OVER (PARTITION BY h.tab_id ORDER BY r.rank DESC, min(h.pos), r.rule) - 1 AS place
FROM (SELECT tab_id, pos, on_, unnest(list_filter([CASE WHEN regexp_matches(txt, $CONSENT_necessary) THEN 'necessary' END, CASE WHEN regexp_matches(txt, $CONSENT_functional) THEN 'functional' END,
  CASE WHEN regexp_matches(txt, $CONSENT_personalization) THEN 'personalization' END, CASE WHEN regexp_matches(txt, $CONSENT_analytics) THEN 'analytics' END, CASE WHEN regexp_matches(txt, $CONSENT_advertising) THEN 'advertising' END,
  CASE WHEN regexp_matches(txt, $CONSENT_social) THEN 'social' END, CASE WHEN regexp_matches(txt, $CONSENT_third_party) THEN 'third_party' END], lambda c: c IS NOT NULL)) AS category FROM o_banner_texts) h JOIN o_consent_rules r USING (category)
GROUP BY h.tab_id, h.category, r.risk, r.rank, r.rule

-- name: con_4_consent_categories
SELECT tab_id, place, category, risk, enabled FROM o_consent_cats

-- name: o_choices
SELECT tab_id, pos, type, button AS label, false AS synthetic FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, type, lower(button) ORDER BY pos) AS rn FROM o_buttons) WHERE rn = 1 AND type <> 'unknown'
UNION ALL SELECT b.tab_id, 1000, 'preferences', '', true FROM o_banner b WHERE b.toggle_label <> '' AND NOT EXISTS (SELECT 1 FROM o_buttons x WHERE x.tab_id = b.tab_id AND x.type = 'preferences')

-- name: con_8_distinct_choices
SELECT tab_id, pos, type, label, synthetic FROM o_choices

-- name: o_allowed
SELECT c.tab_id, c.pos, c.type, c.label, k.category, k.risk, k.rank, k.enabled, k.place FROM o_choices c JOIN o_consent_cats k ON k.tab_id = c.tab_id AND (c.type IN ('accept_all', 'preferences') OR k.category = 'necessary' OR (c.type = 'save_choices' AND k.enabled))

-- name: o_allowed_full
SELECT tab_id, pos, type, label, category, risk, rank, enabled, place FROM o_allowed
UNION ALL SELECT c.tab_id, c.pos, c.type, c.label, f.category, f.risk, f.rank, false, f.rule FROM o_choices c JOIN o_consent_rules f ON f.category = 'necessary' OR (c.type = 'accept_all' AND f.category IN ('functional', 'analytics', 'advertising'))
  WHERE NOT EXISTS (SELECT 1 FROM o_allowed a WHERE a.tab_id = c.tab_id AND a.pos = c.pos)

-- name: con_5_allowed_categories
SELECT tab_id, type, label, string_agg(category, '|' ORDER BY place) AS allowed FROM o_allowed_full GROUP BY tab_id, pos, type, label

-- name: o_times
SELECT tab_id, observed_from, choice_at, choice_kind FROM fx_consents

-- name: con_9_timeline
SELECT tab_id, date_trunc('millisecond', observed_from) AS observed_from, choice_at AS boundary_at, CASE WHEN choice_at IS NULL THEN 'none' ELSE 'choice' END AS boundary_type, choice_kind, CASE WHEN choice_at IS NULL THEN 'low' ELSE 'high' END AS confidence FROM o_times

-- name: o_request_buckets
SELECT r.tab_id, CASE WHEN r.ts < t.observed_from THEN 'outside' WHEN t.choice_at IS NULL OR abs(epoch_us(r.ts) - epoch_us(t.choice_at)) <= 1000000 THEN 'unknown' WHEN r.ts < t.choice_at THEN 'before' ELSE 'after' END AS bucket FROM o_requests r JOIN o_times t USING (tab_id) WHERE r.tracks

-- name: con_10_request_buckets
SELECT tab_id, count(*) FILTER (WHERE bucket = 'before') AS requests_before, count(*) FILTER (WHERE bucket = 'after') AS requests_after, count(*) FILTER (WHERE bucket = 'unknown') AS requests_unknown, count(*) FILTER (WHERE bucket = 'outside') AS requests_outside FROM o_request_buckets GROUP BY tab_id

-- name: o_evidence_rows
SELECT tab_id, identity, CASE WHEN observed THEN first_set_at END AS first_at, CASE WHEN observed THEN greatest(first_set_at, last_set_at) END AS last_at FROM o_cookies WHERE tracking AND (NOT removed OR observed)

-- name: con_11_cookie_evidence
SELECT tab_id, identity, first_at, last_at FROM o_evidence_rows

-- name: o_cookie_buckets
SELECT DISTINCT e.tab_id, e.identity, CASE WHEN e.at IS NULL THEN 'unknown' WHEN e.at < t.observed_from THEN 'outside' WHEN t.choice_at IS NULL OR abs(epoch_us(e.at) - epoch_us(t.choice_at)) <= 1000000 THEN 'unknown' WHEN e.at < t.choice_at THEN 'before' ELSE 'after' END AS bucket
FROM (SELECT tab_id, identity, first_at AS at FROM o_evidence_rows UNION SELECT tab_id, identity, last_at FROM o_evidence_rows) e JOIN o_times t USING (tab_id)

-- name: con_12_cookie_buckets
SELECT tab_id, count(*) FILTER (WHERE bucket = 'before') AS cookies_before, count(*) FILTER (WHERE bucket = 'after') AS cookies_after, count(*) FILTER (WHERE bucket = 'unknown') AS cookies_unknown, count(*) FILTER (WHERE bucket = 'outside') AS cookies_outside,
  count(DISTINCT CASE WHEN bucket <> 'outside' THEN identity END) AS cookies_observed FROM o_cookie_buckets GROUP BY tab_id

-- name: con_13_disabled_toggles
SELECT tab_id, lower(toggle_label) || '::' AS toggle FROM fx_consents WHERE toggle_label <> '' AND NOT toggle_checked AND regexp_matches(lower(toggle_label), $DISABLED_TOGGLE)

-- name: o_consent
SELECT b.tab_id, b.detected, b.observed_from, b.choice_at, b.choice_kind, coalesce(r.b, 0) + coalesce(c.b, 0) AS n_before, coalesce(r.a, 0) + coalesce(c.a, 0) AS n_after, coalesce(r.u, 0) + coalesce(c.u, 0) AS n_unknown,
  coalesce(r.o, 0) AS r_observed, coalesce(c.o, 0) AS c_observed, coalesce(k.reject, false) AS reject, coalesce(k.accept, false) AS accept, coalesce(k.pref, false) AS pref, coalesce(d.n, 0) AS off_toggles
FROM o_banner b
LEFT JOIN (SELECT tab_id, count(*) FILTER (WHERE bucket = 'before') AS b, count(*) FILTER (WHERE bucket = 'after') AS a, count(*) FILTER (WHERE bucket = 'unknown') AS u, count(*) FILTER (WHERE bucket <> 'outside') AS o FROM o_request_buckets GROUP BY tab_id) r USING (tab_id)
LEFT JOIN (SELECT tab_id, count(*) FILTER (WHERE bucket = 'before') AS b, count(*) FILTER (WHERE bucket = 'after') AS a, count(*) FILTER (WHERE bucket = 'unknown') AS u, count(DISTINCT CASE WHEN bucket <> 'outside' THEN identity END) AS o FROM o_cookie_buckets GROUP BY tab_id) c USING (tab_id)
LEFT JOIN (SELECT tab_id, bool_or(type = 'necessary_only') AS reject, bool_or(type = 'accept_all') AS accept, bool_or(type IN ('preferences', 'save_choices')) AS pref FROM o_buttons GROUP BY tab_id) k USING (tab_id)
LEFT JOIN (SELECT tab_id, count(*) AS n FROM fx_consents WHERE toggle_label <> '' AND NOT toggle_checked AND regexp_matches(lower(toggle_label), $DISABLED_TOGGLE) GROUP BY tab_id) d USING (tab_id)

-- name: o_consent_findings
SELECT tab_id, 'tracking_without_visible_consent' AS finding, CASE WHEN observed_from IS NULL THEN 'medium' ELSE 'high' END AS severity, CASE WHEN observed_from IS NULL THEN 'low' ELSE 'medium' END AS confidence FROM o_consent WHERE r_observed + c_observed > 0 AND NOT detected
UNION ALL SELECT tab_id, 'tracking_before_clear_choice', CASE WHEN choice_at IS NOT NULL AND n_before > 0 THEN 'high' ELSE 'medium' END, CASE WHEN choice_at IS NOT NULL AND n_before > 0 THEN '' ELSE 'low' END FROM o_consent
  WHERE detected AND ((choice_at IS NOT NULL AND n_before > 0) OR (r_observed + c_observed > 0 AND (choice_at IS NULL OR n_unknown > 0)))
UNION ALL SELECT tab_id, CASE WHEN pref THEN 'reject_hidden_in_preferences' ELSE 'consent_no_reject_option' END, 'medium', '' FROM o_consent WHERE detected AND accept AND NOT reject
UNION ALL SELECT tab_id, 'tracking_after_rejection', CASE WHEN choice_at IS NOT NULL AND n_after > 0 THEN 'high' ELSE 'medium' END, CASE WHEN choice_at IS NOT NULL AND n_after > 0 THEN 'high' ELSE 'low' END FROM o_consent
  WHERE choice_kind = 'reject_all' AND ((choice_at IS NOT NULL AND n_after > 0) OR (r_observed + c_observed > 0 AND n_unknown > 0))
UNION ALL SELECT tab_id, 'tracking_despite_disabled_toggle', CASE WHEN choice_at IS NOT NULL AND n_after > 0 THEN 'high' ELSE 'medium' END, CASE WHEN choice_at IS NOT NULL AND n_after > 0 THEN '' ELSE 'low' END FROM o_consent
  WHERE coalesce(choice_kind NOT IN ('reject_all', 'accept_all'), true) AND off_toggles > 0 AND ((choice_at IS NOT NULL AND n_after > 0) OR (r_observed + c_observed > 0 AND (choice_at IS NULL OR n_unknown > 0)))

-- name: con_14_tracking_without_visible_consent
SELECT * FROM o_consent_findings WHERE finding = 'tracking_without_visible_consent'

-- name: con_15_tracking_before_clear_choice
SELECT * FROM o_consent_findings WHERE finding = 'tracking_before_clear_choice'

-- name: con_16_missing_reject_options
SELECT * FROM o_consent_findings WHERE finding IN ('consent_no_reject_option', 'reject_hidden_in_preferences')

-- name: con_17_tracking_after_rejection
SELECT * FROM o_consent_findings WHERE finding = 'tracking_after_rejection'

-- name: con_18_tracking_despite_disabled_toggle
SELECT * FROM o_consent_findings WHERE finding = 'tracking_despite_disabled_toggle'

-- name: o_choice_facts
SELECT c.tab_id, c.pos, c.type, c.label, CASE WHEN x.choice_at IS NOT NULL THEN x.n_before > 0 ELSE x.r_observed + x.c_observed > 0 END AS pre, c.type = 'accept_all' AND NOT EXISTS (SELECT 1 FROM o_consent_cats k WHERE k.tab_id = c.tab_id) AS inferred,
  a.top_enabled, a.top_all, a.risky, a.middling
FROM o_choices c JOIN o_consent x USING (tab_id) JOIN (SELECT tab_id, pos, coalesce(max(rank) FILTER (WHERE enabled), 0) AS top_enabled, max(rank) AS top_all, bool_or(risk = 'high') AS risky, bool_or(risk = 'medium') AS middling FROM o_allowed_full GROUP BY tab_id, pos) a USING (tab_id, pos)

-- name: o_choice_risks
SELECT *, CASE WHEN pre AND type = 'necessary_only' THEN 'medium' WHEN pre AND type = 'accept_all' THEN 'high' WHEN type IN ('preferences', 'save_choices') AND top_enabled = 3 THEN 'high' WHEN type IN ('preferences', 'save_choices') AND top_enabled = 2 THEN 'medium'
  WHEN type = 'preferences' THEN CASE WHEN top_all = 3 THEN 'medium' ELSE 'low' END WHEN top_all = 3 THEN 'high' WHEN top_all = 2 OR inferred THEN 'medium' ELSE 'low' END AS risk_level FROM o_choice_facts

-- name: con_6_choice_risk
SELECT tab_id, type, label, risk_level FROM o_choice_risks

-- name: con_7_choice_concerns
SELECT tab_id, type, label, array_to_string(list_filter([CASE WHEN risky THEN 'high_category' END, CASE WHEN middling AND type <> 'accept_all' THEN 'medium_category' END, CASE WHEN pre THEN 'tracking' END, CASE WHEN inferred THEN 'inferred' END,
  CASE WHEN type = 'necessary_only' AND NOT risky AND NOT middling AND NOT pre AND NOT inferred THEN 'necessary_only_default' END], lambda c: c IS NOT NULL), '|') AS concerns FROM o_choice_risks

-- name: o_cut
SELECT tab_id, make_timestamp((min(epoch_us(ts)) + max(epoch_us(ts))) // 2) AS created_at FROM o_requests GROUP BY tab_id

-- name: o_cut_cookies
SELECT c.tab_id, c.identity, max_by(c.removed, struct_pack(ts := c.ts, id := c.change_id)) AS removed FROM o_changes c JOIN o_cut t USING (tab_id) WHERE c.ts <= t.created_at GROUP BY c.tab_id, c.identity

-- name: o_baselines
SELECT t.tab_id, t.created_at, (SELECT count(*) FROM o_requests r WHERE r.tab_id = t.tab_id AND r.ts <= t.created_at) AS request_count, coalesce(k.n, 0) AS cookie_count FROM o_cut t LEFT JOIN (SELECT tab_id, count(*) AS n FROM o_cut_cookies WHERE NOT removed GROUP BY tab_id) k USING (tab_id)

-- name: str_15_baseline_counts
SELECT tab_id, created_at, request_count, cookie_count FROM o_baselines

-- name: o_delta
SELECT b.tab_id, greatest(0, r.n - b.request_count) AS request_delta, greatest(0, coalesce(c.live, 0) - b.cookie_count) AS cookie_delta, r.tracking AS tracking_requests, coalesce(c.tracking, 0) AS tracking_cookies, r.writes
FROM o_baselines b JOIN (SELECT r.tab_id, count(*) AS n, count(*) FILTER (WHERE r.tracks AND r.ts > t.created_at) AS tracking, count(*) FILTER (WHERE r.method IN ('POST', 'PUT', 'PATCH') AND r.ts > t.created_at) AS writes FROM o_requests r JOIN o_cut t USING (tab_id) GROUP BY r.tab_id) r USING (tab_id)
LEFT JOIN (SELECT c.tab_id, count(*) FILTER (WHERE NOT c.removed) AS live, count(*) FILTER (WHERE c.tracking AND c.observed AND c.last_set_at > t.created_at) AS tracking FROM o_cookies c JOIN o_cut t USING (tab_id) GROUP BY c.tab_id) c USING (tab_id)

-- name: dlt_1_after_baseline
SELECT tab_id, request_delta, cookie_delta, tracking_requests, tracking_cookies, array_to_string(list_filter([CASE WHEN tracking_requests + tracking_cookies > 0 THEN 'tracking_after_snapshot:high' END, CASE WHEN writes > 0 THEN 'write_request_after_snapshot:medium' END], lambda f: f IS NOT NULL), '|') AS findings FROM o_delta

-- name: o_votes
SELECT tab_id, coalesce(country_code, '') AS country,
  3 * (page_host LIKE '%.kr')::INT + (lower(language) = 'ko' OR lower(language) LIKE 'ko-%')::INT + (time_zone = 'Asia/Seoul')::INT AS kr,
  3 * list_contains($EU_TLDS, list_last(string_split(page_host, '.')))::INT + list_contains($EU_LANGUAGES, split_part(lower(language), '-', 1))::INT + list_contains($EU_TIME_ZONES, lower(time_zone))::INT AS eu,
  3 * (page_host LIKE '%.us')::INT + (lower(language) = 'en-us')::INT + list_contains($US_TIME_ZONES, lower(time_zone))::INT AS us FROM fx_sites

-- name: o_jurisdiction
SELECT tab_id, country, code, CASE WHEN code <> 'GENERAL' AND (country <> '' OR greatest(kr, eu, us) >= 3) THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN code = 'GENERAL' THEN 'uncertain' WHEN country <> '' THEN 'country' ELSE lower(code) || '_signal' END AS basis
FROM (SELECT *, CASE WHEN list_contains($EU_COUNTRIES, country) THEN 'GDPR' WHEN country IN ('KR', 'US') THEN country WHEN country <> '' THEN 'GENERAL' WHEN kr > eu AND kr > us THEN 'KR' WHEN eu > kr AND eu > us THEN 'GDPR' WHEN us > kr AND us > eu THEN 'US' ELSE 'GENERAL' END AS code FROM o_votes)

-- name: jur_1_jurisdictions
SELECT tab_id, code, confidence, basis FROM o_jurisdiction

-- name: o_overseas
SELECT s.tab_id, coalesce(s.country_code, c.code, '') AS source, CASE WHEN coalesce(s.country_code, c.code) IS NULL OR coalesce(h.known, 0) = 0 THEN 'unknown' WHEN h.other > 0 THEN 'detected' WHEN h.known <> h.n THEN 'unknown' ELSE 'not_detected' END AS overseas_status
FROM fx_sites s LEFT JOIN o_countries c ON c.tld = list_last(string_split(s.page_host, '.'))
LEFT JOIN (SELECT r.tab_id, count(*) AS n, count(k.code) AS known, count(*) FILTER (WHERE k.code <> coalesce(s.country_code, c.code)) AS other FROM o_host_rows r JOIN fx_sites s USING (tab_id) LEFT JOIN o_countries c ON c.tld = list_last(string_split(s.page_host, '.'))
  LEFT JOIN o_countries k ON k.tld = list_last(string_split(r.host, '.')) WHERE r.third_party GROUP BY r.tab_id) h USING (tab_id)

-- name: obs_2_overseas_transfer
SELECT tab_id, source, overseas_status FROM o_overseas

-- name: o_observed
SELECT s.tab_id, n.third_party_hosts > 0 OR coalesce(k.third, 0) > 0 AS has_third_party, n.tracker_hosts > 0 OR coalesce(x.r_observed, 0) > 0 OR coalesce(x.c_observed, 0) > 0 AS has_tracking,
  EXISTS (SELECT 1 FROM o_form_rows f WHERE f.tab_id = s.tab_id AND f.category IN ('payment', 'location')) OR EXISTS (SELECT 1 FROM o_storage_rows f WHERE f.tab_id = s.tab_id AND f.category IN ('payment', 'location')) AS has_sensitive,
  o.overseas_status = 'detected' AS has_overseas, o.overseas_status, EXISTS (SELECT 1 FROM o_form_rows f WHERE f.tab_id = s.tab_id) AS has_form_data,
  EXISTS (SELECT 1 FROM fx_storage_keys f WHERE f.tab_id = s.tab_id) OR coalesce(k.n, 0) > 0 AS has_storage, EXISTS (SELECT 1 FROM o_storage_rows f WHERE f.tab_id = s.tab_id AND f.category = 'account') AS has_auth_storage, n.tracker_hosts > 0 OR coalesce(x.r_observed, 0) > 0 AS has_profiling
FROM fx_sites s JOIN o_network n USING (tab_id) LEFT JOIN o_consent x USING (tab_id) JOIN o_overseas o USING (tab_id) LEFT JOIN (SELECT tab_id, count(*) AS n, count(*) FILTER (WHERE third_party) AS third FROM o_cookie_flags GROUP BY tab_id) k USING (tab_id)

-- name: obs_1_observed_signals
SELECT * FROM o_observed

-- name: o_page_sections
SELECT s.tab_id, s.doc_id, coalesce(f.found, []) AS found FROM fx_sites s LEFT JOIN (SELECT doc_id, list(section_id) AS found FROM o_found GROUP BY doc_id) f USING (doc_id)

-- name: o_core_missing
SELECT p.tab_id, array_to_string(list_filter(['collected_data', 'purpose', 'legal_basis', 'retention', 'user_rights', 'security'], lambda s: NOT list_contains(p.found, s)), '|') AS gdpr,
  array_to_string(list_filter(['collected_data', 'purpose', 'retention', 'user_rights', 'security'], lambda s: NOT list_contains(p.found, s)), '|') AS kr,
  array_to_string(list_filter(['collected_data', 'purpose', 'third_party', 'user_rights'], lambda s: NOT list_contains(p.found, s)), '|') AS us FROM o_page_sections p

-- name: o_regimes
SELECT 'GDPR' AS code, tab_id, 'gdpr_missing_core_information' AS finding, 'high' AS severity, gdpr AS detail, 1 AS pos FROM o_core_missing WHERE gdpr <> ''
UNION ALL SELECT 'GDPR', o.tab_id, 'gdpr_tracking_without_specific_consent_notice', 'high', '', 2 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_tracking AND NOT list_contains(p.found, 'cookies_tracking')
UNION ALL SELECT 'GDPR', o.tab_id, 'gdpr_transfer_without_safeguards_notice', 'high', '', 3 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_overseas AND NOT list_contains(p.found, 'overseas_transfer')
UNION ALL SELECT 'GDPR', o.tab_id, 'gdpr_special_category_without_notice', 'high', '', 4 FROM o_observed o JOIN o_tab_policy p USING (tab_id) WHERE o.has_sensitive AND NOT p.special
UNION ALL SELECT 'GDPR', o.tab_id, 'gdpr_profiling_without_notice', 'medium', '', 5 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_profiling AND NOT list_contains(p.found, 'automated_decision')
UNION ALL SELECT 'KR', tab_id, 'kr_missing_core_policy_sections', 'high', kr, 1 FROM o_core_missing WHERE kr <> ''
UNION ALL SELECT 'KR', o.tab_id, 'kr_third_party_without_disclosure', 'high', '', 2 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_third_party AND NOT list_contains(p.found, 'third_party') AND NOT list_contains(p.found, 'processors')
UNION ALL SELECT 'KR', o.tab_id, 'kr_tracking_without_cookie_section', 'medium', '', 3 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_tracking AND NOT list_contains(p.found, 'cookies_tracking')
UNION ALL SELECT 'KR', o.tab_id, 'kr_overseas_transfer_without_disclosure', 'medium', '', 4 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_overseas AND NOT list_contains(p.found, 'overseas_transfer')
UNION ALL SELECT 'US', tab_id, 'us_missing_transparency_sections', 'medium', us, 1 FROM o_core_missing WHERE us <> ''
UNION ALL SELECT 'US', o.tab_id, 'us_tracking_without_optout_notice', 'high', '', 2 FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_tracking AND NOT list_contains(p.found, 'cookies_tracking')
UNION ALL SELECT 'US', o.tab_id, 'us_sensitive_data_without_notice', 'high', '', 3 FROM o_observed o JOIN o_tab_policy p USING (tab_id) WHERE o.has_sensitive AND NOT p.sensitive_us
UNION ALL SELECT 'US', o.tab_id, 'us_children_without_parental_consent', 'high', '', 4 FROM o_tab_policy o JOIN o_page_sections p USING (tab_id) WHERE list_contains(p.found, 'children') AND NOT o.parental

-- name: jur_2_gdpr_checks
SELECT tab_id, finding, severity, detail FROM o_regimes WHERE code = 'GDPR'

-- name: jur_3_korea_checks
SELECT tab_id, finding, severity, detail FROM o_regimes WHERE code = 'KR'

-- name: jur_4_us_checks
SELECT tab_id, finding, severity, detail FROM o_regimes WHERE code = 'US'

-- name: jur_5_applicable_findings
SELECT j.tab_id, j.code, CASE WHEN j.code = 'GENERAL' THEN 'jurisdiction_uncertain:low' ELSE coalesce(string_agg(r.finding || ':' || r.severity, '|' ORDER BY CASE r.severity WHEN 'high' THEN 1 ELSE 2 END, r.pos), '') END AS findings
FROM o_jurisdiction j LEFT JOIN o_regimes r ON r.tab_id = j.tab_id AND r.code = j.code GROUP BY j.tab_id, j.code

-- name: o_checks
SELECT o.tab_id, 'collected_data' AS check_id, list_contains(p.found, 'collected_data') AS aligned FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_form_data OR o.has_sensitive
UNION ALL SELECT o.tab_id, 'tracking', list_contains(p.found, 'cookies_tracking') FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_tracking
UNION ALL SELECT o.tab_id, 'third_party', list_contains(p.found, 'third_party') OR list_contains(p.found, 'processors') FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_third_party
UNION ALL SELECT o.tab_id, 'retention', list_contains(p.found, 'retention') FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_form_data OR o.has_storage
UNION ALL SELECT o.tab_id, 'security', list_contains(p.found, 'security') FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_sensitive OR o.has_auth_storage
UNION ALL SELECT o.tab_id, 'overseas_transfer', list_contains(p.found, 'overseas_transfer') FROM o_observed o JOIN o_page_sections p USING (tab_id) WHERE o.has_overseas
UNION ALL SELECT tab_id, 'vendor_' || category || '_' || host, len(missing) = 0 FROM o_vendor_rows WHERE category <> 'cdn_security'

-- name: aln_1_alignment_checks
SELECT tab_id, check_id, aligned FROM o_checks

-- name: o_alignment
SELECT tab_id, applicable, aligned, CASE WHEN applicable = 0 THEN 100 ELSE CAST(floor(100.0 * aligned / applicable + 0.5) AS BIGINT) END AS score FROM (SELECT s.tab_id, count(c.check_id) AS applicable, count(*) FILTER (WHERE c.aligned) AS aligned FROM fx_sites s LEFT JOIN o_checks c USING (tab_id) GROUP BY s.tab_id)

-- name: aln_2_alignment_score
SELECT tab_id, applicable, aligned, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS level, applicable - aligned AS findings FROM o_alignment

-- name: ckr_1_cookie_risk
SELECT s.tab_id, CASE m.worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS level, CAST(CASE m.worst WHEN 3 THEN 82 WHEN 2 THEN 52 ELSE 18 END AS BIGINT) AS score
FROM fx_sites s LEFT JOIN (SELECT tab_id, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst FROM (SELECT tab_id, severity FROM o_net_findings UNION ALL SELECT tab_id, severity FROM o_storage_findings UNION ALL SELECT tab_id, severity FROM o_consent_findings UNION ALL SELECT tab_id, risk_level FROM o_choice_risks) GROUP BY tab_id) m USING (tab_id)

-- name: o_report
SELECT s.tab_id, s.page_url AS url, l.level AS policy_level, n.request_count AS requests, (SELECT count(*) FROM o_fields f WHERE f.tab_id = s.tab_id) AS fields, (SELECT count(*) FROM o_cookies c WHERE c.tab_id = s.tab_id AND NOT c.removed) AS cookies,
  b.detected::INT::BIGINT AS banners, d.request_delta, j.code AS jurisdiction, a.score AS alignment
FROM fx_sites s LEFT JOIN o_levels l USING (doc_id) JOIN o_network n USING (tab_id) LEFT JOIN o_banner b USING (tab_id) LEFT JOIN o_delta d USING (tab_id) JOIN o_jurisdiction j USING (tab_id) JOIN o_alignment a USING (tab_id)

-- name: rep_1_site_reports
SELECT * FROM o_report

-- name: snk_1_report_fields
SELECT * FROM o_report
