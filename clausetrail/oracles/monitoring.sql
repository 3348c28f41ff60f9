-- name: o_vtext
SELECT url_key, version, captured_at, body, trim(regexp_replace(body, '\s+', ' ', 'g')) AS folded, row_number() OVER (ORDER BY url_key, version) AS vid FROM fx_policy_versions

-- name: ver_2_text_hashes
SELECT url_key, version, sha256(folded) AS text_hash FROM o_vtext

-- name: o_vparts
SELECT v.vid, v.url_key, v.version, u.b AS blk, u.i AS i, split_part(u.b, chr(10), 1) AS heading, split_part(u.b, chr(10), 2) AS sentence
FROM o_vtext v, LATERAL (SELECT unnest(string_split(v.body, chr(10) || chr(10))) AS b, generate_subscripts(string_split(v.body, chr(10) || chr(10)), 1) AS i) u

-- name: o_vlive
SELECT url_key, max(version) AS version FROM fx_policy_versions GROUP BY url_key

-- name: snk_2_version_upsert
SELECT v.url_key, v.version, v.captured_at, sha256(v.folded) AS text_hash FROM o_vtext v JOIN o_vlive USING (url_key, version)

-- name: o_vchecks
SELECT c.check_id, c.url_key, c.checked_at, c.ok, $ERROR_CATEGORY AS category
FROM fx_checks c JOIN o_vlive l USING (url_key) WHERE c.checked_at >= TIMESTAMP '2024-01-10 00:00:00' OR l.version = 0

-- name: o_vhealth
SELECT c.url_key, max(c.checked_at) AS last_attempt_at, max(s.at) AS last_success_at, count(*) FILTER (WHERE NOT c.ok AND (s.at IS NULL OR c.checked_at > s.at OR (c.checked_at = s.at AND c.check_id > s.id))) AS consecutive_failures,
  max_by(CASE WHEN c.ok THEN '' ELSE c.category END, struct_pack(a := c.checked_at, b := c.check_id)) AS error_category
FROM o_vchecks c LEFT JOIN (SELECT url_key, max(checked_at) AS at, max_by(check_id, checked_at) AS id FROM o_vchecks WHERE ok GROUP BY url_key) s USING (url_key) GROUP BY c.url_key

-- name: ver_11_check_health
SELECT url_key, last_attempt_at, last_success_at, consecutive_failures, error_category FROM o_vhealth

-- name: ver_10_due_checks
SELECT v.url_key, v.captured_at, h.last_attempt_at FROM fx_policy_versions v JOIN o_vlive USING (url_key, version) LEFT JOIN o_vhealth h USING (url_key)
WHERE TIMESTAMP '2024-01-30 18:00:00' - coalesce(h.last_attempt_at, v.captured_at) >= INTERVAL 6 HOUR

-- name: o_vitems
SELECT tenant, url_key, captured_at, bytes, row_number() OVER (PARTITION BY tenant ORDER BY captured_at DESC, url_key DESC) AS place FROM (
  SELECT 'tenant-' || regexp_extract(url_key, 'site(\d)', 1) AS tenant, url_key || '#' || CAST(version AS VARCHAR) AS url_key, captured_at, octet_length(encode(body)) AS bytes FROM fx_policy_versions)

-- name: ver_12_pruned_versions
SELECT i.tenant, i.url_key, i.captured_at, i.bytes FROM o_vitems i JOIN (
  SELECT tenant, list_reduce(list_concat([{'place': 0::BIGINT, 'bytes': 2::BIGINT, 'kept': []::BIGINT[]}], list({'place': place, 'bytes': bytes, 'kept': []::BIGINT[]} ORDER BY place)),
    lambda a, x: CASE WHEN x.bytes <= 12000 AND (len(a.kept) = 0 OR a.bytes + x.bytes <= 12000) THEN {'place': x.place, 'bytes': a.bytes + x.bytes, 'kept': list_append(a.kept, x.place)} ELSE a END).kept AS kept
  FROM o_vitems WHERE place <= 50 GROUP BY tenant) k USING (tenant) WHERE list_contains(k.kept, i.place)

-- name: o_vpolicies
SELECT vid AS doc_id, '' AS lang, body FROM o_vtext

-- name: o_vrisks
SELECT r.doc_id, list(r.risk_id ORDER BY r.sev_ord, r.rule_ord) AS risk_ids FROM v_risks r JOIN v_policy p USING (doc_id) WHERE p.status = 'analyzed' GROUP BY r.doc_id

-- name: o_vrows
SELECT t.vid, t.url_key, t.version, t.captured_at, t.folded, coalesce(r.risk_ids, []) AS risk_ids, l.level, l.score, l.status FROM o_vtext t JOIN v_levels l ON l.doc_id = t.vid LEFT JOIN o_vrisks r ON r.doc_id = t.vid

-- name: ver_1_version_rows
SELECT r.url_key, r.version, length(r.folded) AS text_length, length(r.folded) > 80000 AS truncated, (SELECT count(*) FROM v_found f WHERE f.doc_id = r.vid) AS sections, array_to_string(r.risk_ids, '|') AS risk_ids, r.level, r.score FROM o_vrows r

-- name: o_vsections
SELECT doc_id AS vid, section_id, string_agg(excerpt, chr(10) ORDER BY place) AS txt, min_by(excerpt, place) AS excerpt FROM v_sections GROUP BY doc_id, section_id

-- name: o_vpairs
SELECT c.vid, p.vid AS old_vid, c.url_key, c.version, c.captured_at, p.captured_at AS previous_at, c.status, c.folded <> p.folded AS text_changed,
  list_sort(list_filter(c.risk_ids, lambda x: NOT list_contains(p.risk_ids, x))) AS added, list_sort(list_filter(p.risk_ids, lambda x: NOT list_contains(c.risk_ids, x))) AS removed,
  list_filter(c.risk_ids, lambda x: NOT list_contains(p.risk_ids, x)) AS added_ordered, sha256(c.folded) AS text_hash
FROM o_vrows c JOIN o_vrows p ON p.url_key = c.url_key AND p.version = c.version - 1

-- name: o_vchanges
SELECT * FROM (SELECT p.url_key, p.version, o.section_id, o.pos, CASE WHEN a.vid IS NULL AND p.version = 1 AND b.vid IS NOT NULL THEN 'added' WHEN a.vid IS NOT NULL AND b.vid IS NULL THEN 'removed' WHEN a.txt <> b.txt THEN 'modified' END AS change_type, lower(a.excerpt) AS was, lower(b.excerpt) AS now_
FROM o_vpairs p CROSS JOIN o_section_order o LEFT JOIN o_vsections a ON a.vid = p.old_vid AND a.section_id = o.section_id LEFT JOIN o_vsections b ON b.vid = p.vid AND b.section_id = o.section_id) WHERE change_type IS NOT NULL

-- name: ver_3_section_changes
SELECT url_key, version, section_id, change_type FROM o_vchanges

-- name: ver_4_risk_changes
SELECT url_key, version, array_to_string(added, '|') AS added_risks, array_to_string(removed, '|') AS removed_risks FROM o_vpairs

-- name: o_vimpact
SELECT url_key, version, section_id FROM o_vchanges WHERE list_contains($IMPORTANT_CHANGE_SECTIONS, section_id) OR (change_type = 'modified' AND (
  (regexp_matches(was, $PERMISSION_WITHHELD_CS) AND regexp_matches(now_, $PERMISSION_GRANTED_CS)) OR (NOT regexp_matches(was, $TRACKING_WORDING_CS) AND regexp_matches(now_, $TRACKING_WORDING_CS))))

-- name: ver_6_high_impact_changes
SELECT url_key, version, section_id FROM o_vimpact

-- name: o_vverdict
SELECT p.*, coalesce(c.n, 0) AS n_sections, coalesce(i.n, 0) AS n_impact, coalesce(c.keys, '') AS change_keys, c.firsts, p.text_changed OR coalesce(c.n, 0) > 0 OR len(p.added) > 0 OR len(p.removed) > 0 AS changed
FROM o_vpairs p LEFT JOIN (SELECT url_key, version, count(*) AS n, string_agg(section_id || ':' || change_type, '|' ORDER BY section_id || ':' || change_type) AS keys, list(section_id ORDER BY CASE WHEN change_type = 'added' THEN 100 ELSE 0 END + pos) AS firsts FROM o_vchanges GROUP BY url_key, version) c USING (url_key, version)
LEFT JOIN (SELECT url_key, version, count(*) AS n FROM o_vimpact GROUP BY url_key, version) i USING (url_key, version)

-- name: ver_5_change_verdicts
SELECT url_key, version, previous_at, changed, array_to_string(list_filter([CASE WHEN n_impact > 0 THEN 'policy_sections_changed:high' END, CASE WHEN len(added) > 0 THEN 'policy_new_risks_added:high' END, CASE WHEN text_changed THEN 'policy_text_changed:medium' END,
  CASE WHEN n_sections > 0 AND n_impact = 0 THEN 'policy_sections_changed:medium' END], lambda f: f IS NOT NULL), '|') AS findings FROM o_vverdict

-- name: o_vtold
SELECT * FROM o_vverdict WHERE changed AND (n_sections > 0 OR len(added) > 0)

-- name: ver_7_changes_worth_telling
SELECT url_key, version FROM o_vtold

-- name: o_vkeys
SELECT url_key, version, sha256(url_key || ':' || text_hash || ':' || change_keys || ':' || array_to_string(added, '|')) AS dedupe_key FROM o_vtold

-- name: ver_8_unsent_changes
SELECT url_key, version, dedupe_key FROM o_vkeys WHERE dedupe_key NOT IN (SELECT dedupe_key FROM o_vkeys WHERE version = 1)

-- name: ver_9_current_baselines_only
SELECT url_key, version FROM o_vtold WHERE version - 1 = (SELECT max(v.version) FROM fx_policy_versions v WHERE v.url_key = o_vtold.url_key AND v.version < 2)

-- name: ver_13_run_summary
SELECT p.captured_at, count(*) AS checked, count(*) FILTER (WHERE p.status = 'analyzed' AND p.changed) AS changed, count(*) FILTER (WHERE p.status = 'analyzed' AND t.url_key IS NOT NULL) AS notified, count(*) FILTER (WHERE p.status <> 'analyzed') AS failed
FROM o_vverdict p LEFT JOIN o_vtold t USING (url_key, version) GROUP BY p.captured_at

-- name: ver_14_notifications
SELECT url_key, version, regexp_extract(url_key, '^https://([^/]+)', 1) || ' - ' || array_to_string(list_filter([CASE WHEN n_sections > 0 THEN 'sections: ' || array_to_string(firsts[1:4], ', ') END, CASE WHEN len(added) > 0 THEN 'new risks: ' || array_to_string(added_ordered[1:3], ', ') END], lambda x: x IS NOT NULL), ' / ') AS message FROM o_vtold
