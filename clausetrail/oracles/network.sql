-- name: o_url
SELECT fetch_id, url, content_type, body, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  regexp_extract(url, '^[a-z]+://(?:([^/?#@]*)@)?', 1) AS login, regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
  CASE WHEN contains(url, '?') THEN split_part(url, '?', 2) ELSE '' END AS query
FROM fx_fetches

-- name: o_admission
SELECT fetch_id, url, CASE WHEN length(url) > 2048 THEN 'invalid_url' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN login <> '' THEN 'credentials'
  WHEN regexp_matches(host, '^10\.') OR host LIKE '%.local' THEN 'private_host' WHEN scheme <> 'https' THEN 'not_https'
  WHEN len(list_filter(string_split(query, '&'), lambda q: regexp_matches(split_part(q, '=', 1), $SENSITIVE_QUERY_KEY))) > 0 THEN 'secret_query'
  WHEN lower(trim(split_part(content_type, ';', 1))) NOT IN ('text/html', 'application/xhtml+xml', 'text/plain') THEN 'content_type'
  WHEN octet_length(encode(body)) > 1048576 THEN 'response_too_large' ELSE 'admitted' END AS category FROM o_url

-- name: src_2_document_admission
SELECT fetch_id, url, category FROM o_admission

-- name: src_2_admission_funnel
SELECT category, count(*) AS documents FROM o_admission GROUP BY category

-- name: src_3_content_gate
SELECT fetch_id, lower(trim(split_part(content_type, ';', 1))) AS mime_type, lower(trim(split_part(content_type, ';', 1))) IN ('text/html', 'application/xhtml+xml', 'text/plain') AND octet_length(encode(body)) <= 1048576 AS allowed FROM fx_fetches

-- name: src_4_secret_query_keys
SELECT request_id, query_key IN ('session', 'access_token') AS secret FROM fx_requests

-- name: src_5_public_hosts
SELECT host, host = '10.1.2.3' OR host LIKE '%.local' OR host LIKE '%.test' AS private FROM (SELECT host FROM o_url WHERE scheme IN ('http', 'https') UNION SELECT host FROM fx_requests) WHERE host <> ''

-- name: src_6_error_categories
SELECT check_id, $ERROR_CATEGORY AS category FROM fx_checks WHERE NOT ok

-- name: o_paths
SELECT * FROM (VALUES ('/collect','/collect'),('/v3/checkout','/v3/checkout'),('/users/12345/profile','/users/:id/profile'),('/recaptcha/api.js','/recaptcha/api.js'),('/static/app.js','/static/:file.js'),
 ('/g/collect','/:segment/collect'),('/event','/event'),('/a/b/c/d/e','/:segment/:segment/:segment'),('/','/'),('/account/9f8e7d6c5b4a39281706f5e4d3c2b1a0','/account/:redacted'),
 ('/pixel/img.gif','/pixel/:file.gif'),('/login','/login'),('/recaptcha','/recaptcha')) AS p(path, minimised)

-- name: o_keys
SELECT * FROM (VALUES ('email','email'),('card_number','card_number'),('lat','__identifier__'),('session','session'),('uid','uid'),('q','__identifier__'),('utm_source','__identifier__'),
 ('accountNumber','accountNumber'),('birthDate','birthDate'),('phone','phone'),('access_token','access_token'),('page','page'),('deviceId','deviceId'),('userName','userName'),('user_8f3e2a1b9c7d6e5f','user___hex__')) AS k(query_key, masked)

-- name: o_cookie_names
SELECT * FROM (VALUES ('_ga','_ga','_ga',true),('_ga_AB12CD','_ga___identifier__','_ga___identifier__',true),('_gid','_gid','_gid',true),('_fbp','_fbp','_fbp',true),('session_id','','session_id',false),
 ('csrftoken','','csrftoken',false),('cart','','cart',false),('mp_123_mixpanel','mp___identifier___mixpanel','mp___identifier___mixpanel',true),('visitor_77','','visitor___identifier__',true),('lang','','lang',false),
 ('auth_token','','auth_token',false),('prefs','','__identifier__',false),('__utmz','__utmz','__utmz',true)) AS n(name, family, masked, tracking)

-- name: o_hosts
SELECT host FROM fx_requests UNION SELECT page_host FROM fx_sites UNION SELECT ltrim(lower(domain), '.') FROM fx_cookie_changes UNION SELECT domain FROM o_domains

-- name: o_suffixes
SELECT unnest($SUFFIXES_EXACT) AS suffix, 'exact' AS kind UNION ALL SELECT unnest($SUFFIXES_WILDCARD), 'wildcard' UNION ALL SELECT unnest($SUFFIXES_EXCEPTION), 'exception'

-- name: o_host_parents
SELECT host, l, i, array_to_string(list_slice(l, i, len(l)), '.') AS suffix, len(l) - i + 1 AS size FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT host, string_split(trim(lower(host), '.'), '.') AS l FROM o_hosts))

-- name: o_sites_of
SELECT host, CASE WHEN len(l) <= 1 OR d = 0 OR len(l) <= d THEN array_to_string(l, '.') ELSE array_to_string(list_slice(l, len(l) - d, len(l)), '.') END AS site
FROM (SELECT host, l, CASE WHEN max(CASE WHEN kind = 'exception' THEN size END) IS NOT NULL THEN max(CASE WHEN kind = 'exception' THEN size END) - 1
    ELSE coalesce(greatest(max(CASE WHEN kind = 'exact' THEN size END), max(CASE WHEN kind = 'wildcard' AND i > 1 THEN size + 1 END)), 0) END AS d
  FROM o_host_parents LEFT JOIN o_suffixes USING (suffix) GROUP BY host, l)

-- name: o_requests
SELECT r.request_id, r.tab_id, r.ts, r.scheme, r.host, p.minimised AS path, r.scheme || '://' || r.host || p.minimised AS url, r.method, r.resource_type, r.path AS raw_path,
  CASE WHEN k.masked = '__identifier__' THEN '' ELSE k.masked END AS query_keys,
  len(list_filter(string_split(r.host, '.'), lambda l: list_contains($TRACKER_TOKENS, l))) > 0
   OR len(list_filter(string_split_regex(p.minimised, '[^a-z0-9]+'), lambda l: list_contains($TRACKER_TOKENS, l))) > 0
   OR len(list_filter($TRACKER_DOMAINS, lambda d: r.host = d OR ends_with(r.host, '.' || d))) > 0 AS tracks
FROM fx_requests r JOIN o_paths p USING (path) JOIN o_keys k USING (query_key)

-- name: src_7_minimised_requests
SELECT request_id, tab_id, ts, url, host, path, scheme, method, resource_type, query_keys FROM o_requests

-- name: o_changes
SELECT c.change_id, c.tab_id, c.ts, n.masked AS name, c.name AS raw_name, c.domain, c.removed, c.secure, c.same_site, coalesce(c.partition_site, '') AS partition, n.tracking,
  sha256('' || chr(0) || coalesce(c.partition_site, '') || chr(0) || ltrim(lower(c.domain), '.') || chr(0) || sha256('/') || chr(0) || CASE WHEN n.masked = c.name THEN c.name ELSE sha256(c.name) END) AS identity
FROM fx_cookie_changes c JOIN o_cookie_names n USING (name)

-- name: src_8_cookie_changes
SELECT change_id, tab_id, ts, name, domain, removed, partition FROM o_changes

-- name: o_fields
SELECT field_id, tab_id, name, type, label, required FROM fx_form_fields WHERE type NOT IN ('hidden', 'submit', 'button', 'reset', 'image')

-- name: src_10_form_fields
SELECT field_id, tab_id, name, type FROM o_fields

-- name: txt_14_readable_candidate
SELECT tab_id, el_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY score DESC, el_id) AS rn FROM (
  SELECT tab_id, el_id, CASE WHEN length(text) < 120 THEN 0.0 ELSE CAST(least(length(text) / 1000.0, 20) AS DOUBLE) + 3 * len(list_filter($READABLE_HINTS, lambda h: contains(lower(attrs), h))) + len(list_filter($READABLE_HINTS, lambda h: contains(lower(text), h))) END AS score FROM fx_candidates)) WHERE rn = 1

-- name: url_1_minimised_urls
SELECT request_id, url, scheme, host FROM o_requests

-- name: url_2_minimised_paths
SELECT r.path, count(*) AS n, any_value(p.minimised) AS minimised FROM fx_requests r JOIN o_paths p USING (path) GROUP BY r.path

-- name: url_3_field_keys
SELECT tab_id, string_agg(masked, '|' ORDER BY encode(query_key)) AS keys FROM (SELECT DISTINCT r.tab_id, k.query_key, k.masked FROM fx_requests r JOIN o_keys k USING (query_key)) WHERE masked <> '__identifier__' GROUP BY tab_id

-- name: url_4_masked_identifiers
SELECT r.query_key, count(*) AS n, any_value(k.masked) AS masked FROM fx_requests r JOIN o_keys k USING (query_key) GROUP BY r.query_key

-- name: url_5_masked_cookie_names
SELECT c.name, count(*) AS n, any_value(n.family) AS family, any_value(n.masked) AS masked FROM fx_cookie_changes c JOIN o_cookie_names n USING (name) GROUP BY c.name

-- name: url_6_registrable_domains
SELECT h.host, s.site AS registrable FROM (SELECT host FROM fx_requests UNION SELECT page_host FROM fx_sites) h JOIN o_sites_of s USING (host)

-- name: url_7_third_party_requests
SELECT r.tab_id, r.host, count(*) AS n, any_value(a.site <> b.site) AS third_party FROM fx_requests r JOIN fx_sites p USING (tab_id) JOIN o_sites_of a ON a.host = r.host JOIN o_sites_of b ON b.host = p.page_host GROUP BY r.tab_id, r.host

-- name: o_vendor_patterns
SELECT * FROM (VALUES $VENDOR_PATTERNS) AS v(rule_ord, vendor, pattern_host, pattern_path, category, risk, expected)

-- name: o_vendor_pairs
SELECT DISTINCT host, path FROM o_requests UNION SELECT DISTINCT regexp_replace(host, '^www\.', ''), '/' FROM o_requests

-- name: o_vendors
SELECT p.host, p.path, coalesce(v.vendor, 'Unknown') AS vendor, coalesce(v.category, 'unknown') AS category, coalesce(v.risk, 'unknown') AS risk, coalesce(v.expected, ['third_party', 'processors']) AS expected
FROM o_vendor_pairs p LEFT JOIN LATERAL (SELECT min_by(struct_pack(vendor, category, risk, expected), rule_ord) AS s FROM o_vendor_patterns
  WHERE (regexp_replace(p.host, '^www\.', '') = pattern_host OR ends_with(p.host, '.' || pattern_host)) AND (pattern_path = '' OR p.path = pattern_path OR starts_with(p.path, pattern_path || '/'))) m ON true,
  LATERAL (SELECT m.s.vendor AS vendor, m.s.category AS category, m.s.risk AS risk, m.s.expected AS expected) v

-- name: url_8_vendors
SELECT DISTINCT v.host, v.path, v.vendor, v.category, v.risk, array_to_string(v.expected, '|') AS expected FROM o_vendors v JOIN o_requests r USING (host, path)

-- name: o_custom
SELECT DISTINCT 'own-' || host AS id, 'Own ' || host AS vendor, host AS patterns, CASE WHEN host LIKE '%.test' THEN 'advertising' ELSE 'unknown' END AS category, 'tracking' AS risk, 'purpose|security' AS expected_sections, length(host) AS position
FROM fx_requests WHERE (host LIKE '%.net' OR host LIKE '%.test') AND host NOT LIKE 'cdn.%'

-- name: url_9_custom_vendor_rules
SELECT id, vendor, patterns, category, risk, expected_sections FROM o_custom

-- name: udx_1_vendors_with_custom_rules
SELECT DISTINCT v.host, v.path, coalesce(c.vendor, v.vendor) AS vendor, coalesce(c.category, v.category) AS category FROM o_vendors v JOIN o_requests r USING (host, path) LEFT JOIN o_custom c ON c.patterns = v.host

-- name: url_10_tracker_requests
SELECT request_id, tab_id, host FROM o_requests WHERE tracks

-- name: url_11_tracking_cookies
SELECT change_id, name, tracking FROM o_changes

-- name: o_domains
SELECT DISTINCT doc_id, regexp_replace(lower(d), '^www\.', '') AS domain FROM (SELECT doc_id, unnest(regexp_extract_all(t, $POLICY_DOMAIN)) AS d FROM o_text)

-- name: url_12_policy_domains
SELECT doc_id, domain FROM o_domains

-- name: o_vendor_names
SELECT DISTINCT vendor, trim(lower(unnest(string_split(vendor, '/')))) AS alias FROM o_vendor_patterns

-- name: o_named
SELECT DISTINCT t.doc_id, n.vendor FROM o_text t JOIN o_vendor_names n ON length(regexp_replace(n.alias, '[^a-z0-9]', '', 'g')) >= 4 AND CASE WHEN contains(lower(t.t), split_part(n.alias, ' ', 1)) THEN regexp_matches(lower(t.t), '(?:^|[^\pL\pN])' || replace(n.alias, ' ', '\s+') || '(?:$|[^\pL\pN])') ELSE false END

-- name: url_13_named_vendors
SELECT doc_id, vendor FROM o_named

-- name: o_tab_hosts
SELECT r.tab_id, r.host, count(*) AS n, min(struct_pack(ts := r.ts, id := r.request_id)) AS first_seen, min(CASE WHEN r.tracks THEN struct_pack(ts := r.ts, id := r.request_id) END) AS first_tracked,
  min(CASE WHEN r.method IN ('POST', 'PUT', 'PATCH') THEN struct_pack(ts := r.ts, id := r.request_id) END) AS first_write, min(CASE WHEN r.scheme = 'http' THEN struct_pack(ts := r.ts, id := r.request_id) END) AS first_insecure
FROM o_requests r GROUP BY r.tab_id, r.host

-- name: o_host_rows
SELECT h.*, s.doc_id, a.site, a.site <> b.site AS third_party,
  EXISTS (SELECT 1 FROM o_domains d WHERE d.doc_id = s.doc_id AND (regexp_replace(h.host, '^www\.', '') = d.domain OR ends_with(h.host, '.' || d.domain) OR ends_with(d.domain, '.' || regexp_replace(h.host, '^www\.', ''))))
   OR EXISTS (SELECT 1 FROM o_domains d JOIN o_sites_of x ON x.host = d.domain WHERE d.doc_id = s.doc_id AND x.site = a.site)
   OR EXISTS (SELECT 1 FROM o_named m JOIN o_vendors v ON v.vendor = m.vendor WHERE m.doc_id = s.doc_id AND v.host = regexp_replace(h.host, '^www\.', '') AND v.path = '/') AS disclosed
FROM o_tab_hosts h JOIN fx_sites s USING (tab_id) JOIN o_sites_of a ON a.host = h.host JOIN o_sites_of b ON b.host = s.page_host

-- name: url_14_host_disclosure
SELECT tab_id, host, disclosed FROM o_host_rows

-- name: url_15_canonical_policy_urls
SELECT fetch_id, CASE WHEN scheme = 'https' AND login = '' AND (query = '' OR query = 'lang=en' OR query = 'lang=en&hl=ko&v=1.2') THEN url END AS url_key FROM o_url

-- name: url_16_origin_exclusion
SELECT r.request_id, r.tab_id, 'https://' || s.page_host AS origin FROM fx_requests r JOIN fx_sites s USING (tab_id)
WHERE s.page_host NOT IN (SELECT page_host FROM (SELECT language, page_host, row_number() OVER (PARTITION BY language ORDER BY count(*) DESC, page_host DESC) AS rn FROM fx_sites GROUP BY language, page_host) WHERE rn = 1 AND language IN ('ko', 'fr-FR', 'en-GB'))

-- name: url_17_document_fingerprints
SELECT request_id, sha256(url) AS fingerprint FROM fx_requests

-- name: o_countries
SELECT * FROM (VALUES $COUNTRY_ROWS) AS c(tld, code)

-- name: url_18_host_countries
SELECT DISTINCT r.host, coalesce(c.code, '') AS country FROM fx_requests r LEFT JOIN o_countries c ON c.tld = list_last(string_split(r.host, '.'))

-- name: net_1_unique_hosts
SELECT tab_id, host, request_id FROM (SELECT tab_id, host, request_id, row_number() OVER (PARTITION BY tab_id, host ORDER BY ts, request_id) AS rn FROM fx_requests) WHERE rn = 1

-- name: net_2_third_party_hosts
SELECT s.tab_id, coalesce(string_agg(h.host, '|' ORDER BY h.first_seen) FILTER (WHERE h.third_party), '') AS hosts FROM fx_sites s LEFT JOIN o_host_rows h USING (tab_id) GROUP BY s.tab_id

-- name: o_preferred
SELECT * FROM (SELECT r.tab_id, r.host, r.request_id, v.vendor, v.category, v.risk, v.expected, row_number() OVER (PARTITION BY r.tab_id, r.host ORDER BY v.vendor = 'Unknown', r.ts, r.request_id) AS rn
  FROM o_requests r JOIN o_vendors v USING (host, path)) WHERE rn = 1

-- name: o_vendor_rows
SELECT p.tab_id, p.host, p.request_id, p.vendor, p.category, p.risk, h.first_seen, h.doc_id, list_filter(p.expected, lambda e: NOT list_contains(coalesce(f.found, []), e)) AS missing
FROM o_preferred p JOIN o_host_rows h USING (tab_id, host) LEFT JOIN (SELECT t.doc_id, coalesce(list(f.section_id) FILTER (WHERE f.section_id IS NOT NULL), []) AS found FROM o_text t LEFT JOIN o_found f USING (doc_id) GROUP BY t.doc_id) f ON f.doc_id = h.doc_id
WHERE h.third_party

-- name: net_3_preferred_vendor_requests
SELECT tab_id, host, request_id, vendor FROM o_vendor_rows

-- name: net_4_vendor_summary
SELECT tab_id, host, vendor, category, risk, array_to_string(missing, '|') AS missing FROM o_vendor_rows

-- name: o_field_order
SELECT * FROM (VALUES ('contact', 1), ('identity', 2), ('account', 3), ('payment', 4), ('location', 5), ('device', 6)) AS f(category, cat_ord)

-- name: o_key_words
SELECT raw, trim(regexp_replace(lower(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9가-힣]+', ' ', 'g')) AS k FROM (SELECT masked AS raw FROM o_keys WHERE masked <> '__identifier__' UNION SELECT storage_key FROM fx_storage_keys UNION SELECT name || ' ' || label || ' ' || type FROM fx_form_fields WHERE label <> '' UNION SELECT name || ' ' || type FROM fx_form_fields WHERE label = '')

-- name: o_key_categories
SELECT raw, unnest(list_filter([CASE WHEN regexp_matches(k, $FIELD_contact) THEN 'contact' END, CASE WHEN regexp_matches(k, $FIELD_identity) THEN 'identity' END,
  CASE WHEN regexp_matches(replace(k, 'account number', ''), $FIELD_account) THEN 'account' END, CASE WHEN regexp_matches(k, $FIELD_payment) THEN 'payment' END,
  CASE WHEN regexp_matches(k, $FIELD_location) THEN 'location' END, CASE WHEN regexp_matches(k, $FIELD_device) THEN 'device' END], lambda c: c IS NOT NULL)) AS category FROM o_key_words

-- name: o_tab_keys
SELECT tab_id, query_keys AS k, min(struct_pack(ts := ts, id := request_id)) AS first_seen FROM o_requests WHERE query_keys <> '' GROUP BY tab_id, query_keys

-- name: o_request_fields
SELECT tab_id, category, string_agg(k, '|' ORDER BY rn) AS keys FROM (SELECT t.tab_id, c.category, t.k, row_number() OVER (PARTITION BY t.tab_id, c.category ORDER BY t.first_seen) AS rn FROM o_tab_keys t JOIN o_key_categories c ON c.raw = t.k) WHERE rn <= 8 GROUP BY tab_id, category

-- name: net_5_sensitive_request_fields
SELECT tab_id, category, keys FROM o_request_fields

-- name: o_tab_policy
SELECT s.tab_id, s.doc_id, regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_advertising) AS ads, regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_storage) AS storage, regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_third_party) AS third,
  regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_special_category) AS special, regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_sensitive_us) AS sensitive_us, regexp_matches(lower(coalesce(t.t, '')), $MENTIONS_parental) AS parental,
  EXISTS (SELECT 1 FROM o_found f WHERE f.doc_id = s.doc_id AND f.section_id = 'cookies_tracking') AS has_cookies
FROM fx_sites s LEFT JOIN o_text t USING (doc_id)

-- name: o_net_findings
SELECT tab_id, 'undisclosed_third_parties' AS id, 'high' AS severity, string_agg(host, '|' ORDER BY first_seen) AS detail, 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY first_seen) AS rn FROM o_host_rows WHERE third_party AND NOT disclosed) WHERE rn <= 8 GROUP BY tab_id
UNION ALL SELECT tab_id, 'vendor_policy_section_gap', CASE WHEN bool_or(serious) THEN 'high' ELSE 'medium' END, string_agg(host, '|' ORDER BY first_seen) FILTER (WHERE rn <= 6), 2
  FROM (SELECT *, category IN ('advertising', 'analytics', 'payment') AS serious, row_number() OVER (PARTITION BY tab_id ORDER BY first_seen) AS rn FROM o_vendor_rows WHERE len(missing) > 0 AND category <> 'cdn_security') GROUP BY tab_id
UNION ALL SELECT h.tab_id, 'tracker_without_disclosure', 'high', string_agg(h.host, '|' ORDER BY h.first_tracked) FILTER (WHERE h.rn <= 8), 3
  FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY first_tracked) AS rn FROM o_host_rows WHERE first_tracked IS NOT NULL) h JOIN o_tab_policy p USING (tab_id) WHERE NOT p.has_cookies AND NOT p.ads GROUP BY h.tab_id
UNION ALL SELECT r.tab_id, 'sensitive_fields_without_category', 'medium', string_agg(r.category, '|' ORDER BY o.cat_ord), 4 FROM o_request_fields r JOIN o_field_order o USING (category) JOIN fx_sites s USING (tab_id)
  WHERE NOT EXISTS (SELECT 1 FROM o_disclosed d WHERE d.doc_id = s.doc_id AND d.category = r.category) GROUP BY r.tab_id
UNION ALL SELECT tab_id, 'third_party_post', 'medium', string_agg(host, '|' ORDER BY first_write), 5 FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY first_write) AS rn FROM o_host_rows WHERE third_party AND first_write IS NOT NULL) WHERE rn <= 8 GROUP BY tab_id
UNION ALL SELECT tab_id, 'insecure_http', 'high', string_agg(host, '|' ORDER BY first_insecure), 6 FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY first_insecure) AS rn FROM o_host_rows WHERE first_insecure IS NOT NULL) WHERE rn <= 6 GROUP BY tab_id

-- name: net_6_undisclosed_third_parties
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'undisclosed_third_parties'

-- name: net_7_vendor_policy_section_gap
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'vendor_policy_section_gap'

-- name: net_8_tracker_without_disclosure
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'tracker_without_disclosure'

-- name: net_9_sensitive_fields_without_category
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'sensitive_fields_without_category'

-- name: net_10_third_party_post
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'third_party_post'

-- name: net_11_insecure_http
SELECT tab_id, severity, detail FROM o_net_findings WHERE id = 'insecure_http'

-- name: o_network
SELECT s.tab_id, coalesce(h.n, 0) AS request_count, coalesce(h.third, 0) AS third_party_hosts, coalesce(h.trackers, 0) AS tracker_hosts, coalesce(f.n, 0) AS sensitive_fields, coalesce(x.findings, '') AS findings
FROM fx_sites s LEFT JOIN (SELECT tab_id, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE third_party) AS third, count(*) FILTER (WHERE first_tracked IS NOT NULL) AS trackers FROM o_host_rows GROUP BY tab_id) h USING (tab_id)
LEFT JOIN (SELECT tab_id, count(*) AS n FROM o_request_fields GROUP BY tab_id) f USING (tab_id)
LEFT JOIN (SELECT tab_id, string_agg(id || ':' || severity, '|' ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, pos) AS findings FROM o_net_findings GROUP BY tab_id) x USING (tab_id)

-- name: net_12_network_result
SELECT tab_id, request_count, third_party_hosts, tracker_hosts, third_party_hosts AS vendors, sensitive_fields, findings FROM o_network

-- name: o_field_categories
SELECT f.*, c.category FROM o_fields f LEFT JOIN (SELECT raw, min_by(category, cat_ord) AS category FROM o_key_categories JOIN o_field_order USING (category) GROUP BY raw) c
  ON c.raw = CASE WHEN f.label = '' THEN f.name || ' ' || f.type ELSE f.name || ' ' || f.label || ' ' || f.type END

-- name: frm_1_field_categories
SELECT field_id, coalesce(category, '') AS category FROM o_field_categories

-- name: o_form_rows
SELECT tab_id, category, count(*) AS fields, count(*) FILTER (WHERE required) AS required, string_agg(name, '|' ORDER BY field_id) FILTER (WHERE rn <= 5) AS names
FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, category ORDER BY field_id) AS rn FROM o_field_categories WHERE category IS NOT NULL) GROUP BY tab_id, category

-- name: frm_2_form_categories
SELECT tab_id, category, fields, required, names FROM o_form_rows

-- name: o_form_findings
SELECT r.tab_id, 'form_fields_without_policy_category' AS id, 'high' AS severity, string_agg(r.category, '|' ORDER BY o.cat_ord) AS detail FROM o_form_rows r JOIN o_field_order o USING (category) JOIN fx_sites s USING (tab_id)
  WHERE NOT EXISTS (SELECT 1 FROM o_disclosed d WHERE d.doc_id = s.doc_id AND d.category = r.category) GROUP BY r.tab_id
UNION ALL SELECT tab_id, 'many_required_sensitive_fields', 'medium', '' FROM o_form_rows GROUP BY tab_id HAVING sum(required) >= 4

-- name: frm_2_form_fields_without_policy_category
SELECT tab_id, severity, detail FROM o_form_findings WHERE id = 'form_fields_without_policy_category'

-- name: frm_3_many_required_sensitive_fields
SELECT tab_id, severity, detail FROM o_form_findings WHERE id = 'many_required_sensitive_fields'

-- name: o_storage_rows
SELECT tab_id, category, string_agg(storage_key, '|' ORDER BY area, encode(storage_key)) AS keys FROM (SELECT s.*, c.category, row_number() OVER (PARTITION BY s.tab_id, c.category ORDER BY s.area, encode(s.storage_key)) AS rn
  FROM (SELECT DISTINCT tab_id, area, storage_key FROM fx_storage_keys) s JOIN o_key_categories c ON c.raw = s.storage_key) WHERE rn <= 8 GROUP BY tab_id, category

-- name: sto_1_storage_categories
SELECT tab_id, category, keys FROM o_storage_rows

-- name: o_cookie_groups
SELECT tab_id, identity, max_by(struct_pack(name, domain, secure, same_site, removed, partition, change_id, tracking), struct_pack(ts := ts, id := change_id)) AS l,
  min(struct_pack(ts := ts, id := change_id)) FILTER (WHERE NOT removed) AS s1, max(struct_pack(ts := ts, id := change_id)) FILTER (WHERE NOT removed) AS s2, max(struct_pack(ts := ts, id := change_id)) FILTER (WHERE removed) AS d
FROM o_changes GROUP BY tab_id, identity

-- name: o_cookie_state
SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY removed, last_set_at DESC NULLS LAST, change_id DESC) AS place FROM (
  SELECT tab_id, identity, l.name AS name, l.domain AS domain, l.secure AS secure, l.same_site AS same_site, l.removed AS removed, l.change_id AS change_id, l.tracking AS tracking, l.partition <> '' AND s1 IS NOT NULL AS observed,
    CASE WHEN l.partition <> '' THEN s1.ts END AS first_set_at, CASE WHEN l.partition <> '' THEN s2.ts END AS last_set_at, CASE WHEN l.partition <> '' AND d > s1 THEN d.ts END AS deleted_at
  FROM o_cookie_groups) WHERE NOT removed OR observed

-- name: o_cookies
SELECT * FROM o_cookie_state

-- name: str_9_cookie_identity
SELECT change_id, identity FROM o_changes

-- name: str_10_cookie_state
SELECT tab_id, identity, name, domain, removed, observed, first_set_at, last_set_at, deleted_at FROM o_cookies

-- name: o_cookie_flags
SELECT c.*, a.site <> b.site AS third_party, NOT secure OR same_site = 'no_restriction' AS weak FROM o_cookies c JOIN fx_sites s USING (tab_id) JOIN o_sites_of a ON a.host = ltrim(c.domain, '.') JOIN o_sites_of b ON b.host = s.page_host WHERE NOT removed

-- name: o_storage_findings
SELECT r.tab_id, 'storage_without_disclosure' AS id, 'medium' AS severity, string_agg(r.category, '|' ORDER BY o.cat_ord) AS detail, 1 AS pos FROM o_storage_rows r JOIN o_field_order o USING (category) JOIN o_tab_policy p USING (tab_id) WHERE NOT p.has_cookies AND NOT p.storage GROUP BY r.tab_id
UNION ALL SELECT tab_id, 'tracking_cookie_without_disclosure', 'high', string_agg(name || ' (' || domain || ')', '|' ORDER BY change_id), 2 FROM (SELECT c.*, row_number() OVER (PARTITION BY tab_id ORDER BY change_id) AS rn FROM o_cookie_flags c WHERE tracking) JOIN o_tab_policy p USING (tab_id) WHERE rn <= 8 AND NOT p.has_cookies AND NOT p.ads GROUP BY tab_id
UNION ALL SELECT tab_id, 'third_party_cookie_without_disclosure', 'medium', string_agg(name || ' (' || domain || ')', '|' ORDER BY change_id), 3 FROM (SELECT c.*, row_number() OVER (PARTITION BY tab_id ORDER BY change_id) AS rn FROM o_cookie_flags c WHERE third_party) JOIN o_tab_policy p USING (tab_id) WHERE rn <= 8 AND NOT p.third GROUP BY tab_id
UNION ALL SELECT tab_id, 'weak_cookie_security', 'medium', string_agg(name, '|' ORDER BY change_id), 4 FROM (SELECT c.*, row_number() OVER (PARTITION BY tab_id ORDER BY change_id) AS rn FROM o_cookie_flags c WHERE weak) WHERE rn <= 8 GROUP BY tab_id

-- name: sto_2_storage_without_disclosure
SELECT tab_id, severity, detail FROM o_storage_findings WHERE id = 'storage_without_disclosure'

-- name: sto_3_tracking_cookie_without_disclosure
SELECT tab_id, severity, detail FROM o_storage_findings WHERE id = 'tracking_cookie_without_disclosure'

-- name: sto_4_third_party_cookie_without_disclosure
SELECT tab_id, severity, detail FROM o_storage_findings WHERE id = 'third_party_cookie_without_disclosure'

-- name: sto_5_weak_cookie_security
SELECT tab_id, severity, detail FROM o_storage_findings WHERE id = 'weak_cookie_security'

-- name: con_3_consent_banners
SELECT el_id, tab_id FROM fx_candidates WHERE length(text) < 3000 AND (len(list_filter($CONSENT_HINTS, lambda h: contains(lower(attrs || ' ' || text), h))) > 0 OR regexp_matches(lower(attrs), $CONSENT_MANAGER))
  AND (regexp_matches(lower(text), $RECORDED_reject_all) OR regexp_matches(lower(text), $RECORDED_accept_all) OR regexp_matches(lower(text), $RECORDED_save_preferences) OR role = 'dialog' OR regexp_matches(lower(attrs), $CONSENT_MANAGER))

-- name: o_cookie_tabs
SELECT c.change_id, c.removed, CASE WHEN c.partition <> '' THEN c.partition ELSE ltrim(c.domain, '.') END AS site, s.tab_id FROM o_changes c JOIN fx_sites s ON CASE WHEN c.partition <> '' THEN
    'https' = split_part(c.partition, '://', 1) AND (s.page_host = split_part(c.partition, '://', 2) OR ends_with(s.page_host, '.' || split_part(c.partition, '://', 2)) OR ends_with(split_part(c.partition, '://', 2), '.' || s.page_host))
    ELSE s.page_host = ltrim(c.domain, '.') OR ends_with(s.page_host, '.' || ltrim(c.domain, '.')) END

-- name: str_11_cookie_attribution
SELECT change_id, tab_id FROM (SELECT *, count(*) OVER (PARTITION BY change_id) AS n FROM o_cookie_tabs) WHERE removed OR n = 1

-- name: str_11_site_tabs
SELECT DISTINCT site, tab_id FROM o_cookie_tabs WHERE removed
