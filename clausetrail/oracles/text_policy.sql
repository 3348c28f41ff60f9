-- name: o_text
SELECT doc_id, body, trim(body, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)) AS t FROM fx_policies

-- name: o_sentence_lists
SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(replace(t, chr(13), ''), '([.!?。！？])\s+|\n\n+', '\1' || chr(1), 'g'), chr(1)),
    lambda p: trim(regexp_replace(p, '[ \t\n]+', ' ', 'g'))), lambda p: p <> '') AS parts
FROM o_text

-- name: o_sentence_parts
SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS part_idx FROM o_sentence_lists

-- name: o_sentence_chunks
SELECT doc_id, part_idx, w AS chunk_idx, substring(part, w * ($MAX_SENTENCE_CHARS - $SENTENCE_OVERLAP_CHARS) + 1, $MAX_SENTENCE_CHARS) AS sentence
FROM (SELECT doc_id, part, part_idx, unnest(range(0, CASE WHEN length(part) <= $MAX_SENTENCE_CHARS THEN 1
    ELSE CAST(ceil((length(part) - $MAX_SENTENCE_CHARS) / 1840.0) AS BIGINT) + 1 END)) AS w FROM o_sentence_parts)

-- name: o_sentences
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part_idx, chunk_idx) - 1 AS sent_idx, sentence
FROM o_sentence_chunks WHERE sentence <> ''

-- name: o_clause_lists
SELECT doc_id, sent_idx, list_filter(list_transform(string_split_regex(
    regexp_replace(regexp_replace(sentence,
      '(?i)\b(?:and|while|whereas)\s+((?:we|you|they|the (?:company|service)|our (?:company|service))\b|(?:may|might|can|could|will|would|shall)\b)', '; \1', 'g'),
      '((?:않|아니)(?:으며|지만|으나|고))\s*', '\1; ', 'g'),
    $CLAUSE_SEPARATOR), lambda c: trim(c)), lambda c: c <> '') AS parts
FROM o_sentences

-- name: o_clauses
SELECT doc_id, sent_idx, generate_subscripts(parts, 1) - 1 AS clause_idx, unnest(parts) AS clause FROM o_clause_lists

-- name: o_block_source
SELECT doc_id, t, trim(regexp_replace(regexp_replace(replace(t, chr(13), ''), '[ \t]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), chr(10) || ' ') AS n FROM o_text

-- name: o_lines
SELECT doc_id, n, i, line, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
FROM (SELECT doc_id, n, generate_subscripts(string_split(n, chr(10)), 1) AS i, unnest(string_split(n, chr(10))) AS line FROM o_block_source)

-- name: o_line_groups
SELECT doc_id, i, line, sum(CASE WHEN i > 1 AND regexp_matches(substring(n, CAST(pos AS BIGINT), 200),
    '^(?:\d{1,2}[.)]\s*)?(?:[A-Z][A-Za-z ]{3,80}|[가-힣0-9][가-힣0-9\s·/()]{3,80})(?:\n|$)') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS g
FROM o_lines

-- name: o_heading_blocks
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS idx, block, count(*) OVER (PARTITION BY doc_id) AS n_blocks
FROM (SELECT doc_id, g, trim(string_agg(line, chr(10) ORDER BY i), chr(10) || ' ') AS block FROM o_line_groups GROUP BY doc_id, g)
WHERE length(block) > 30

-- name: o_packed_text
SELECT s.doc_id, list_reduce(list(s.sentence ORDER BY s.sent_idx), lambda a, x: CASE WHEN length(list_last(string_split(a, chr(2)))) > $PACKED_BLOCK_CHARS
    THEN a || chr(2) || x ELSE a || ' ' || x END) AS packed
FROM o_sentences s GROUP BY s.doc_id

-- name: o_packed_blocks
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, block
FROM (SELECT doc_id, generate_subscripts(string_split(packed, chr(2)), 1) AS i, unnest(string_split(packed, chr(2))) AS block FROM o_packed_text)
WHERE length(block) > 30

-- name: o_blocks
SELECT doc_id, idx, block FROM o_heading_blocks WHERE n_blocks >= 3
UNION ALL
SELECT doc_id, idx, block FROM o_packed_blocks
WHERE doc_id NOT IN (SELECT doc_id FROM o_heading_blocks WHERE n_blocks >= 3)

-- name: o_titled
SELECT doc_id, idx, block, CASE WHEN length(first_line) <= 90 THEN regexp_replace(first_line, '^\d{1,2}[.)]\s*', '')
    WHEN length(first_sentence) > 72 THEN substring(first_sentence, 1, 69) || '...' ELSE first_sentence END AS title
FROM (SELECT doc_id, idx, block,
    coalesce(list_filter(list_transform(string_split(block, chr(10)), lambda l: trim(l)), lambda l: l <> '')[1], '') AS first_line,
    substring(trim(regexp_replace(string_split(regexp_replace(block, '([.!?。！？])\s+|\n\n+', '\1' || chr(1), 'g'), chr(1))[1], '\s+', ' ', 'g')), 1, 2000) AS first_sentence
  FROM o_blocks)

-- name: o_section_scores
SELECT doc_id, idx, block, title, u.section_id, u.score FROM (SELECT *, [
  {'section_id': 'collected_data', 'score': 6 * regexp_matches(title, $HEAD_collected_data)::INT + 2 * regexp_matches(block, $BODY0_collected_data)::INT + 2 * regexp_matches(block, $BODY1_collected_data)::INT + regexp_matches(block, $HEAD0_collected_data)::INT + regexp_matches(block, $HEAD1_collected_data)::INT},
  {'section_id': 'purpose', 'score': 6 * regexp_matches(title, $HEAD_purpose)::INT + 2 * regexp_matches(block, $BODY0_purpose)::INT + 2 * regexp_matches(block, $BODY1_purpose)::INT + regexp_matches(block, $HEAD0_purpose)::INT + regexp_matches(block, $HEAD1_purpose)::INT},
  {'section_id': 'legal_basis', 'score': 6 * regexp_matches(title, $HEAD_legal_basis)::INT + 2 * regexp_matches(block, $BODY0_legal_basis)::INT + 2 * regexp_matches(block, $BODY1_legal_basis)::INT + regexp_matches(block, $HEAD0_legal_basis)::INT + regexp_matches(block, $HEAD1_legal_basis)::INT},
  {'section_id': 'retention', 'score': 6 * regexp_matches(title, $HEAD_retention)::INT + 2 * regexp_matches(block, $BODY0_retention)::INT + 2 * regexp_matches(block, $BODY1_retention)::INT + regexp_matches(block, $HEAD0_retention)::INT + regexp_matches(block, $HEAD1_retention)::INT},
  {'section_id': 'third_party', 'score': 6 * regexp_matches(title, $HEAD_third_party)::INT + 2 * regexp_matches(block, $BODY0_third_party)::INT + 2 * regexp_matches(block, $BODY1_third_party)::INT + regexp_matches(block, $HEAD0_third_party)::INT + regexp_matches(block, $HEAD1_third_party)::INT},
  {'section_id': 'processors', 'score': 6 * regexp_matches(title, $HEAD_processors)::INT + 2 * regexp_matches(block, $BODY0_processors)::INT + 2 * regexp_matches(block, $BODY1_processors)::INT + regexp_matches(block, $HEAD0_processors)::INT + regexp_matches(block, $HEAD1_processors)::INT},
  {'section_id': 'overseas_transfer', 'score': 6 * regexp_matches(title, $HEAD_overseas_transfer)::INT + 2 * regexp_matches(block, $BODY0_overseas_transfer)::INT + 2 * regexp_matches(block, $BODY1_overseas_transfer)::INT + regexp_matches(block, $HEAD0_overseas_transfer)::INT + regexp_matches(block, $HEAD1_overseas_transfer)::INT},
  {'section_id': 'automated_decision', 'score': 6 * regexp_matches(title, $HEAD_automated_decision)::INT + 2 * regexp_matches(block, $BODY0_automated_decision)::INT + 2 * regexp_matches(block, $BODY1_automated_decision)::INT + regexp_matches(block, $HEAD0_automated_decision)::INT + regexp_matches(block, $HEAD1_automated_decision)::INT},
  {'section_id': 'cookies_tracking', 'score': 6 * regexp_matches(title, $HEAD_cookies_tracking)::INT + 2 * regexp_matches(block, $BODY0_cookies_tracking)::INT + 2 * regexp_matches(block, $BODY1_cookies_tracking)::INT + regexp_matches(block, $HEAD0_cookies_tracking)::INT + regexp_matches(block, $HEAD1_cookies_tracking)::INT},
  {'section_id': 'user_rights', 'score': 6 * regexp_matches(title, $HEAD_user_rights)::INT + 2 * regexp_matches(block, $BODY0_user_rights)::INT + 2 * regexp_matches(block, $BODY1_user_rights)::INT + regexp_matches(block, $HEAD0_user_rights)::INT + regexp_matches(block, $HEAD1_user_rights)::INT},
  {'section_id': 'security', 'score': 6 * regexp_matches(title, $HEAD_security)::INT + 2 * regexp_matches(block, $BODY0_security)::INT + 2 * regexp_matches(block, $BODY1_security)::INT + regexp_matches(block, $HEAD0_security)::INT + regexp_matches(block, $HEAD1_security)::INT},
  {'section_id': 'children', 'score': 6 * regexp_matches(title, $HEAD_children)::INT + 2 * regexp_matches(block, $BODY0_children)::INT + 2 * regexp_matches(block, $BODY1_children)::INT + regexp_matches(block, $HEAD0_children)::INT + regexp_matches(block, $HEAD1_children)::INT},
  {'section_id': 'dispute_liability', 'score': 6 * regexp_matches(title, $HEAD_dispute_liability)::INT + 2 * regexp_matches(block, $BODY0_dispute_liability)::INT + 2 * regexp_matches(block, $BODY1_dispute_liability)::INT + regexp_matches(block, $HEAD0_dispute_liability)::INT + regexp_matches(block, $HEAD1_dispute_liability)::INT}
] AS scores FROM o_titled), unnest(scores) AS x(u)

-- name: o_section_hits
SELECT *, trim(regexp_replace(block, '\s+', ' ', 'g')) AS folded, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY score DESC, idx) AS place
FROM o_section_scores WHERE score > 0

-- name: o_sections
SELECT doc_id, section_id, coalesce(nullif(title, ''), section_id) AS title, place,
  CASE WHEN length(folded) > 260 THEN substring(folded, 1, 257) || '...' ELSE folded END AS excerpt
FROM o_section_hits WHERE place <= 3

-- name: o_found
SELECT DISTINCT doc_id, section_id FROM o_sections

-- name: o_section_order
SELECT unnest($SECTION_IDS) AS section_id, generate_subscripts($SECTION_IDS, 1) AS pos

-- name: o_data_words
SELECT * FROM (VALUES $DATA_WORDS) AS w(cat_ord, category, word_ord, word)

-- name: o_disclosed_source
SELECT t.doc_id, coalesce(e.txt, t.t) AS src
FROM o_text t LEFT JOIN (SELECT doc_id, string_agg(excerpt, ' ' ORDER BY place) AS txt FROM o_sections WHERE section_id = 'collected_data' GROUP BY doc_id) e USING (doc_id)

-- name: o_disclosed
SELECT DISTINCT s.doc_id, w.category, w.cat_ord FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(regexp_replace(regexp_replace(src, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9가-힣]+', ' ', 'g')) || ' ' AS k FROM o_disclosed_source) s
JOIN o_data_words w ON CASE WHEN regexp_matches(w.word, '[가-힣]') THEN contains(trim(s.k), w.word)
  ELSE regexp_matches(CASE WHEN w.word = 'address' THEN regexp_replace(s.k, '\bip address(?:es)?\b', '', 'g') ELSE s.k END, ' ' || w.word || CASE WHEN w.word = 'nationality' THEN '' WHEN w.word LIKE '%ss' THEN '(es)?' ELSE 's?' END || ' ')
  OR (w.word = 'nationality' AND contains(s.k, ' nationalities ')) END

-- name: o_gate
SELECT t.doc_id, t.t,
  position(regexp_extract(t.t, $PRIVACY_MARKER) IN t.t) AS p_at, regexp_matches(t.t, $PRIVACY_MARKER) AS has_p,
  position(regexp_extract(t.t, $TERMS_MARKER) IN t.t) AS t_at, regexp_matches(t.t, $TERMS_MARKER) AS has_t,
  least(2000, CAST(floor(length(t.t) * 0.4) AS BIGINT)) AS lead_limit
FROM o_text t

-- name: o_leads
SELECT doc_id, t, has_p AND p_at - 1 <= lead_limit AS leading_privacy, has_t AND t_at - 1 <= lead_limit AS leading_terms, has_p OR has_t AS has_marker FROM o_gate

-- name: o_evidence
SELECT doc_id, sent_idx, CASE WHEN regexp_matches(sentence, $DOCUMENT_MARKER) THEN
  array_to_string(list_transform(list_zip(string_split_regex(sentence, $DOCUMENT_MARKER), regexp_extract_all(sentence, $DOCUMENT_MARKER)),
    lambda z: z[1] || repeat(' ', coalesce(length(z[2]), 0))), '') ELSE sentence END AS e
FROM o_sentences

-- name: o_flags
SELECT v.doc_id, v.sent_idx, v.e, l.leading_privacy, l.leading_terms, x.expo,
  NOT x.expo AND NOT regexp_matches(v.e, $ACCOUNT_HELP) AND (
    regexp_matches(v.e, $CONTROLLER_SPECIFIC)
    OR (regexp_matches(v.e, $CONTROLLER_GENERIC) AND (l.leading_privacy OR regexp_matches(v.e, $USER_NEXUS)))
    OR (l.leading_privacy AND NOT regexp_matches(v.e, $IMPERATIVE_ACTION) AND (regexp_matches(v.e, $DIRECT_SPECIFIC) OR regexp_matches(v.e, $DIRECT_CONCRETE)))
    OR (regexp_matches(v.e, $KOREAN_DATA_OBJECT) AND (
      (regexp_matches(v.e, $KOREAN_DATA_ACTION) AND (l.leading_privacy OR regexp_matches(v.e, $KOREAN_CONTROLLER)))
      OR (l.leading_privacy AND regexp_matches(v.e, $KOREAN_BARE_ACTION))))) AS practice,
  NOT x.expo AND l.leading_privacy AND regexp_matches(v.e, $RIGHTS_OR_RETENTION_RE) AS rights,
  NOT x.expo AND l.leading_terms AND regexp_matches(v.e, $STRONG_TERMS_CLAUSES_RE) AS strong_terms
FROM o_evidence v JOIN o_leads l USING (doc_id), LATERAL (SELECT regexp_matches(v.e, $EXPOSITORY_FRAME) AS expo) x

-- name: o_status
SELECT l.doc_id, l.t, l.leading_privacy, l.leading_terms, l.has_marker, coalesce(f.practice, false) AS practice, coalesce(f.rights, false) AS rights,
  coalesce(f.strong_terms OR (l.leading_terms AND f.weak >= 2), false) AS terms
FROM o_leads l LEFT JOIN (SELECT doc_id, bool_or(practice) AS practice, bool_or(rights) AS rights, bool_or(strong_terms) AS strong_terms,
    regexp_matches(max(joined), $WEAK0)::INT + regexp_matches(max(joined), $WEAK1)::INT + regexp_matches(max(joined), $WEAK2)::INT + regexp_matches(max(joined), $WEAK3)::INT AS weak
  FROM (SELECT *, coalesce(string_agg(CASE WHEN NOT expo THEN e END, ' ') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS joined FROM o_flags)
  GROUP BY doc_id) f USING (doc_id)

-- name: o_policy
SELECT *, least(1.0, conf) AS confidence, CASE WHEN t = '' THEN 'empty' WHEN conf >= 0.5 AND (practice OR rights OR terms) THEN 'analyzed' ELSE 'not_policy' END AS status
FROM (SELECT *, CAST(0.35 * has_marker::INT + 0.5 * practice::INT + 0.25 * rights::INT + 0.5 * terms::INT AS DOUBLE) AS conf FROM o_status)

-- name: o_clause_hits
SELECT doc_id, sent_idx, unnest(list_filter([
  CASE WHEN regexp_matches(clause, $NEED0_broad_data_sharing) AND regexp_matches(clause, $NEED1_broad_data_sharing) AND NOT regexp_matches(clause, $VETO_broad_data_sharing) THEN 'broad_data_sharing' END,
  CASE WHEN regexp_matches(clause, $NEED0_behavioral_ads) AND NOT regexp_matches(clause, $VETO_behavioral_ads) THEN 'behavioral_ads' END,
  CASE WHEN regexp_matches(clause, $NEED0_policy_change) AND NOT regexp_matches(clause, $VETO_policy_change) THEN 'policy_change' END,
  CASE WHEN regexp_matches(clause, $NEED0_account_termination) AND regexp_matches(clause, $NEED1_account_termination) AND NOT regexp_matches(clause, $VETO_account_termination) THEN 'account_termination' END,
  CASE WHEN regexp_matches(clause, $NEED0_retention_unclear) AND NOT regexp_matches(clause, $VETO_retention_unclear) THEN 'retention_unclear' END,
  CASE WHEN regexp_matches(clause, $NEED0_overseas_transfer) AND NOT regexp_matches(clause, $VETO_overseas_transfer) THEN 'overseas_transfer' END,
  CASE WHEN regexp_matches(clause, $NEED0_arbitration) AND NOT regexp_matches(clause, $VETO_arbitration) THEN 'arbitration' END,
  CASE WHEN regexp_matches(clause, $NEED0_children) AND regexp_matches(clause, $NEED1_children) AND NOT regexp_matches(clause, $VETO_children) THEN 'children' END
], lambda r: r IS NOT NULL)) AS risk_id FROM o_clauses

-- name: o_raw_risks
SELECT h.doc_id, h.risk_id, min_by(s.sentence, s.sent_idx) AS sentence FROM o_clause_hits h JOIN o_sentences s USING (doc_id, sent_idx) GROUP BY h.doc_id, h.risk_id
UNION ALL
SELECT t.doc_id, 'liability_limit', coalesce(min_by(s.sentence, s.sent_idx) FILTER (WHERE regexp_matches(s.sentence, $NEED0_liability_limit)), '')
FROM o_text t JOIN o_sentences s USING (doc_id) WHERE regexp_matches(t.t, $NEED0_liability_limit) GROUP BY t.doc_id
UNION ALL
SELECT t.doc_id, 'security_vague', coalesce(min_by(s.sentence, s.sent_idx) FILTER (WHERE regexp_matches(s.sentence, $NEED0_security_vague)), '')
FROM o_text t JOIN o_sentences s USING (doc_id) WHERE regexp_matches(t.t, $NEED0_security_vague) AND NOT regexp_matches(t.t, $VETO_security_vague) GROUP BY t.doc_id

-- name: o_risk_info
SELECT * FROM (VALUES (1,'broad_data_sharing','high'),(2,'behavioral_ads','medium'),(3,'policy_change','medium'),(4,'account_termination','medium'),(5,'liability_limit','medium'),
 (6,'retention_unclear','medium'),(7,'overseas_transfer','medium'),(8,'arbitration','high'),(9,'security_vague','low'),(10,'children','high')) AS r(rule_ord, risk_id, severity)

-- name: o_risks
SELECT r.doc_id, r.risk_id, i.severity, i.rule_ord, CASE i.severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sev_ord,
  CASE WHEN length(trim(r.sentence)) > 220 THEN substring(trim(r.sentence), 1, 217) || '...' ELSE trim(r.sentence) END AS evidence
FROM o_raw_risks r JOIN o_risk_info i USING (risk_id)

-- name: o_tokens
SELECT doc_id, ' ' || trim(regexp_replace(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9가-힣]+', ' ', 'g')) || ' ' AS k FROM o_text

-- name: o_words
SELECT s.doc_id, w.cat_ord, w.category, w.word_ord, w.word FROM o_tokens s
JOIN o_data_words w ON CASE WHEN regexp_matches(w.word, '[가-힣]') THEN contains(trim(s.k), w.word)
  ELSE regexp_matches(CASE WHEN w.word = 'address' THEN regexp_replace(s.k, '\bip address(?:es)?\b', '', 'g') ELSE s.k END, ' ' || w.word || CASE WHEN w.word = 'nationality' THEN '' WHEN w.word LIKE '%ss' THEN '(es)?' ELSE 's?' END || ' ')
  OR (w.word = 'nationality' AND contains(s.k, ' nationalities ')) END

-- name: o_scores
SELECT p.doc_id, p.status, CASE WHEN p.status = 'analyzed' THEN least(100, coalesce(r.points, 0) + least(coalesce(c.n, 0) * 4, 24)) END AS score, coalesce(r.n_high, 0) AS n_high, coalesce(r.worst, 3) AS worst
FROM o_policy p
LEFT JOIN (SELECT doc_id, CAST(sum(CASE severity WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 4 END) AS BIGINT) AS points, count(*) FILTER (WHERE severity = 'high') AS n_high, min(sev_ord) AS worst FROM o_risks GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(DISTINCT category) AS n FROM o_words GROUP BY doc_id) c USING (doc_id)

-- name: o_levels
SELECT *, CASE WHEN status <> 'analyzed' THEN 'unknown' WHEN score >= 60 OR n_high >= 2 THEN 'high' WHEN score >= 35 OR n_high > 0 THEN 'medium' ELSE 'low' END AS level FROM o_scores

-- name: o_positives
SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(t, $POSITIVE_delete_right) THEN 'delete_right' END, CASE WHEN regexp_matches(t, $POSITIVE_security_controls) THEN 'security_controls' END,
  CASE WHEN regexp_matches(t, $POSITIVE_retention_policy) THEN 'retention_policy' END], lambda p: p IS NOT NULL)) AS positive FROM o_text

-- name: src_1_policy_documents
SELECT doc_id, lang, length(body) AS chars FROM fx_policies

-- name: txt_1_bounded_text
SELECT doc_id, t AS text, CASE WHEN t = '' THEN 'empty' ELSE 'text' END AS kind FROM (SELECT doc_id, trim(substring(body, 1, $MAX_POLICY_CHARS), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)) AS t FROM fx_policies)

-- name: txt_2_sentences
SELECT doc_id, sent_idx, sentence FROM o_sentences

-- name: txt_3_overlapping_windows
SELECT doc_id, w AS window_idx, substring(t, w * 1840 + 1, 2000) AS window_text
FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 2000 THEN 1 ELSE CAST(ceil((length(t) - 2000) / 1840.0) AS BIGINT) + 1 END)) AS w FROM o_text)

-- name: txt_4_clauses
SELECT doc_id, sent_idx, clause_idx, clause FROM o_clauses

-- name: txt_5_heading_blocks
SELECT doc_id, idx AS block_idx, block FROM o_heading_blocks

-- name: txt_6_packed_blocks
SELECT doc_id, idx AS block_idx, block FROM o_packed_blocks

-- name: txt_7_block_titles
SELECT doc_id, idx AS block_idx, title FROM o_titled

-- name: txt_8_tokens
SELECT doc_id, trim(k) AS tokens FROM o_tokens

-- name: txt_9_folded_text
SELECT doc_id, trim(regexp_replace(replace(body, chr(160), ' '), '\s+', ' ', 'g')) AS folded FROM fx_policies

-- name: txt_10_excerpts
SELECT doc_id, CASE WHEN length(f) > 260 THEN substring(f, 1, 257) || '...' ELSE f END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(body, '\s+', ' ', 'g')) AS f FROM fx_policies)

-- name: txt_13_word_count
SELECT doc_id, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS word_count FROM o_text

-- name: pol_2_leading_markers
SELECT doc_id, leading_privacy, leading_terms FROM o_leads

-- name: pol_3_evidence_text
SELECT doc_id, sent_idx, e AS evidence FROM o_evidence WHERE NOT regexp_matches(e, $EXPOSITORY_FRAME)

-- name: pol_4_data_practice
SELECT doc_id, practice AS data_practice FROM o_status

-- name: pol_5_rights_or_retention
SELECT doc_id, rights AS rights_or_retention FROM o_status

-- name: pol_6_terms_clause
SELECT doc_id, terms AS terms_clause FROM o_status

-- name: pol_7_policy_status
SELECT doc_id, CASE WHEN status <> 'empty' THEN round(confidence, 4) END AS policy_confidence, status FROM o_policy

-- name: pol_8_data_categories
SELECT doc_id, category, string_agg(word, '|' ORDER BY word_ord) AS matched
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY word_ord) AS rn FROM o_words) WHERE rn <= 4 GROUP BY doc_id, category

-- name: pol_9_negated_clauses
SELECT doc_id, sent_idx, clause_idx, clause FROM o_clauses WHERE regexp_matches(clause, $NEGATED_DATA_ACTION_RE)

-- name: pol_10_broad_data_sharing
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'broad_data_sharing'

-- name: pol_11_children
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'children'

-- name: pol_12_behavioral_ads
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'behavioral_ads'

-- name: pol_13_account_termination
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'account_termination'

-- name: pol_14_policy_change
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'policy_change'

-- name: pol_15_retention_unclear
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'retention_unclear'

-- name: pol_16_overseas_transfer
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'overseas_transfer'

-- name: pol_17_arbitration
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'arbitration'

-- name: pol_18_liability_limit
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'liability_limit'

-- name: pol_19_security_vague
SELECT doc_id, severity, evidence FROM o_risks WHERE risk_id = 'security_vague'

-- name: pol_20_risk_evidence
SELECT r.doc_id, r.risk_id, r.severity, r.evidence FROM o_risks r JOIN o_policy p USING (doc_id) WHERE p.status = 'analyzed'

-- name: pol_21_positives
SELECT p.doc_id, string_agg(p.positive, '|' ORDER BY CASE p.positive WHEN 'delete_right' THEN 1 WHEN 'security_controls' THEN 2 ELSE 3 END) AS positives
FROM o_positives p JOIN o_policy s USING (doc_id) WHERE s.status = 'analyzed' GROUP BY p.doc_id

-- name: pol_22_risk_score
SELECT doc_id, score FROM o_levels WHERE status = 'analyzed'

-- name: pol_23_risk_level
SELECT doc_id, status, level FROM o_levels

-- name: pol_24_overall_severity
SELECT doc_id, CASE worst WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_severity FROM o_levels WHERE status = 'analyzed'

-- name: pol_25_ordered_risks
SELECT r.doc_id, string_agg(r.risk_id || ':' || r.severity, '|' ORDER BY r.sev_ord, r.rule_ord) AS risks FROM o_risks r JOIN o_policy p USING (doc_id) WHERE p.status = 'analyzed' GROUP BY r.doc_id

-- name: pol_26_section_scores
SELECT doc_id, idx AS block_idx, section_id, CAST(score AS BIGINT) AS score FROM o_section_scores WHERE score > 0

-- name: pol_27_sections
SELECT d.doc_id, o.section_id, s.section_id IS NOT NULL AS found, coalesce(s.titles, '') AS titles, coalesce(s.excerpts, '') AS excerpts
FROM o_text d CROSS JOIN o_section_order o LEFT JOIN (SELECT doc_id, section_id, string_agg(title, '|' ORDER BY place) AS titles, string_agg(excerpt, '|' ORDER BY place) AS excerpts FROM o_sections GROUP BY doc_id, section_id) s
  ON s.doc_id = d.doc_id AND s.section_id = o.section_id

-- name: pol_28_section_presence
SELECT d.doc_id, coalesce(bool_or(f.section_id = 'collected_data'), false) AS collected_data, coalesce(bool_or(f.section_id = 'purpose'), false) AS purpose, coalesce(bool_or(f.section_id = 'legal_basis'), false) AS legal_basis,
  coalesce(bool_or(f.section_id = 'retention'), false) AS retention, coalesce(bool_or(f.section_id = 'third_party'), false) AS third_party, coalesce(bool_or(f.section_id = 'processors'), false) AS processors,
  coalesce(bool_or(f.section_id = 'overseas_transfer'), false) AS overseas_transfer, coalesce(bool_or(f.section_id = 'automated_decision'), false) AS automated_decision, coalesce(bool_or(f.section_id = 'cookies_tracking'), false) AS cookies_tracking,
  coalesce(bool_or(f.section_id = 'user_rights'), false) AS user_rights, coalesce(bool_or(f.section_id = 'security'), false) AS security, coalesce(bool_or(f.section_id = 'children'), false) AS children,
  coalesce(bool_or(f.section_id = 'dispute_liability'), false) AS dispute_liability, coalesce(bool_or(f.section_id IN ('third_party', 'processors')), false) AS any_recipient
FROM o_text d LEFT JOIN o_found f USING (doc_id) GROUP BY d.doc_id

-- name: pol_29_disclosed_categories
SELECT doc_id, string_agg(category, '|' ORDER BY cat_ord) AS disclosed FROM o_disclosed GROUP BY doc_id
