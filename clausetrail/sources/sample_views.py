"""Audit inputs derived from the driver tables.

The driver tables hold invented words without policy vocabulary, so these views attach
small banks of sentences, hosts and keys to their rows by key arithmetic; row counts grow
with the tables and whole texts are kept.  The statements are portable: Spark builds its
inputs from them and the DuckDB checks prepend the same text, so both sides start equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausetrail.session import slots

VIEWS: dict[str, str] = {
    "fx_clauses": r"""
SELECT idx, heading, sentence FROM (VALUES
 (0,'Information we collect','We collect your name, email address, phone number and payment information when you create an account.'),
 (1,'How we use information','We use your personal information to provide the service and for support.'),
 (2,'Sharing','We may share personal data with third parties and business partners.'),
 (3,'Sharing limits','We do not sell or share your personal data with third parties.'),
 (4,'Children','We collect data about children under 13 for class accounts.'),
 (5,'Children protection','We do not collect personal data from children.'),
 (6,'Advertising and cookies','Partners show targeted ads based on your activity. We use analytics cookies and you can opt out.'),
 (7,'No advertising','We never show targeted ads.'),
 (8,'Changes','We may change these terms after notice.'),
 (9,'Fixed terms','We will not change these terms during your plan.'),
 (10,'Account','We may suspend or terminate your account at any time.'),
 (11,'Leaving','You may close your account whenever you like and request deletion of your data.'),
 (12,'Liability','The provider is not liable for lost profits.'),
 (13,'Retention','We retain your personal data for as long as necessary.'),
 (14,'Retention period','We retain your account data for 30 days after closure. The retention period is short.'),
 (15,'International transfer','Your information may be moved outside your country through an international transfer.'),
 (16,'Disputes','Any dispute is subject to binding arbitration and you waive a jury trial.'),
 (17,'Open courts','There is no binding arbitration and we do not require arbitration.'),
 (18,'Security','We apply reasonable security to protect data.'),
 (19,'Security measures','We apply reasonable security such as encryption and access control.'),
 (20,'Legal basis','We rely on consent, contract and legitimate interest as the lawful basis.'),
 (21,'Service providers','Processors such as Stripe and Hotjar handle payments and measurement. See stripe.com and cdn.example.net for details.'),
 (22,'Your rights','You have the right to access, correct and delete your personal data and withdraw consent.'),
 (23,'Profiling','We use automated decision making and profiling with significant effect.'),
 (24,'수집하는 개인정보','회사는 이름, 이메일, 전화번호와 쿠키를 수집합니다.'),
 (25,'제3자 제공 안내','회사는 개인정보를 제3자에게 제공할 수 있습니다.'),
 (26,'제3자 판매 금지','회사는 개인정보를 제3자에게 판매하지 않습니다.'),
 (27,'보유 기간 안내','개인정보는 필요한 기간 동안 보관합니다.'),
 (28,'면책 조항 안내','회사는 손해에 대하여 책임을 지지 않습니다. 암호화와 접근통제를 적용합니다.'),
 (29,'Recipes','Stir the soup slowly; however, taste it before serving.')
) AS t(idx, heading, sentence)
""",
    "fx_policies": r"""
SELECT d.doc_id, d.lang,
  h.txt || chr(10) || chr(10) || a.heading || chr(10) || a.sentence || chr(10) || chr(10)
  || b.heading || chr(10) || b.sentence || chr(10) || chr(10)
  || c.heading || chr(10) || c.sentence || chr(10) || chr(10)
  || e.heading || chr(10) || e.sentence || chr(10) || chr(10) || d.text AS body
FROM documents d
JOIN (VALUES (0,'Privacy Policy'),(1,'Terms of Service'),(2,'개인정보 처리방침'),(3,'Cooking notes'),(4,'Privacy Notice')) AS h(idx, txt) ON h.idx = d.doc_id % 5
JOIN fx_clauses a ON a.idx = (d.doc_id * 7 + 1) % 30
JOIN fx_clauses b ON b.idx = (d.doc_id * 11 + 5) % 30
JOIN fx_clauses c ON c.idx = (d.doc_id * 13 + 9) % 30
JOIN fx_clauses e ON e.idx = (d.doc_id * 17 + 2) % 30
""",
    "fx_sites": r"""
SELECT p.tab_id, p.doc_id, s.page_host, 'https://' || s.page_host || '/policy' AS page_url, s.language, s.time_zone, k.country_code
FROM (SELECT u.user_id AS tab_id, d.doc_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN documents d ON d.doc_id = u.user_id AND u.user_id % 13 <> 12
  UNION ALL SELECT 1000000000 + d.doc_id AS tab_id, d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON d.doc_id = u.user_id AND u.user_id % 13 <> 12
  WHERE u.user_id IS NULL) p
JOIN (VALUES (0,'shop.example.co.kr','ko-KR','Asia/Seoul'),(1,'www.service.us','en-US','America/New_York'),(2,'app.dienst.de','de-DE','Europe/Berlin'),
 (3,'portal.example.co.uk','en-GB','Europe/London'),(4,'alice.pages.example','en-US','Europe/Paris'),(5,'bob.pages.example','ja-JP','Asia/Tokyo'),
 (6,'www.site.fr','fr-FR','Europe/Paris'),(7,'news.example.com','ko','America/Chicago')) AS s(idx, page_host, language, time_zone) ON s.idx = p.tab_id % 8
LEFT JOIN (VALUES (0,'KR'),(1,'DE'),(2,'US'),(3,'JP')) AS k(idx, country_code) ON k.idx = p.tab_id % 11
""",
    "fx_requests": r"""
SELECT e.event_id AS request_id, e.user_id AS tab_id, e.ts,
  CASE WHEN e.event_id % 9 = 0 THEN 'http' ELSE 'https' END AS scheme, h.host, p.path,
  CASE WHEN e.event_id % 9 = 0 THEN 'http' ELSE 'https' END || '://' || h.host || p.path || '?' || q.query_key || '=' || CAST(e.event_id AS STRING) AS url,
  CASE e.event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
  CASE WHEN e.event_type = 'view' AND e.event_id % 5 = 0 THEN 'main_frame' ELSE 'xmlhttprequest' END AS resource_type, q.query_key
FROM events e
JOIN (VALUES (0,'www.google-analytics.com'),(1,'stats.doubleclick.net'),(2,'connect.facebook.net'),(3,'js.stripe.com'),(4,'cdn.example.net'),
 (5,'static.hotjar.com'),(6,'api.segment.io'),(7,'alice.pages.example'),(8,'bob.pages.example'),(9,'o1.ingest.sentry.io'),(10,'cdn.cloudflare.com'),
 (11,'tracker.unknown-ads.test'),(12,'api.example.co.kr'),(13,'www.google.com'),(14,'media.dienst.de'),(15,'notstripe.com')) AS h(idx, host) ON h.idx = e.event_id % 16
JOIN (VALUES (0,'/collect'),(1,'/v3/checkout'),(2,'/users/12345/profile'),(3,'/recaptcha/api.js'),(4,'/static/app.js'),(5,'/g/collect'),(6,'/event'),
 (7,'/a/b/c/d/e'),(8,'/'),(9,'/account/9f8e7d6c5b4a39281706f5e4d3c2b1a0'),(10,'/pixel/img.gif'),(11,'/login'),(12,'/recaptcha')) AS p(idx, path) ON p.idx = (e.event_id * 7) % 13
JOIN (VALUES (0,'email'),(1,'card_number'),(2,'lat'),(3,'session'),(4,'uid'),(5,'q'),(6,'utm_source'),(7,'accountNumber'),(8,'birthDate'),(9,'phone'),
 (10,'access_token'),(11,'page'),(12,'deviceId'),(13,'userName'),(14,'user_8f3e2a1b9c7d6e5f')) AS q(idx, query_key) ON q.idx = (e.event_id * 4 + 1) % 15
""",
    "fx_cookie_changes": r"""
SELECT e.event_id AS change_id, e.user_id AS tab_id, e.ts, n.name, m.domain, e.event_id % 4 = 0 AS removed, e.event_id % 3 <> 0 AS secure,
  CASE e.event_id % 5 WHEN 0 THEN 'no_restriction' WHEN 1 THEN 'strict' ELSE 'lax' END AS same_site,
  CASE WHEN e.event_id % 7 < 4 THEN 'https://' || s.page_host ELSE NULL END AS partition_site
FROM events e
JOIN fx_sites s ON s.tab_id = e.user_id
JOIN (VALUES (0,'_ga'),(1,'_ga_AB12CD'),(2,'_gid'),(3,'_fbp'),(4,'session_id'),(5,'csrftoken'),(6,'cart'),(7,'mp_123_mixpanel'),(8,'visitor_77'),
 (9,'lang'),(10,'auth_token'),(11,'prefs'),(12,'__utmz')) AS n(idx, name) ON n.idx = (e.event_id * 5) % 13
JOIN (VALUES (0,'.facebook.com'),(1,'.example.co.kr'),(2,'.service.us'),(3,'app.dienst.de'),(4,'.example.com'),(5,'.doubleclick.net'),(6,'.site.fr')) AS m(idx, domain) ON m.idx = (e.event_id * 3) % 7
WHERE e.event_type IN ('click', 'error')
""",
    "fx_consents": r"""
SELECT u.tab_id, u.observed_from, CASE WHEN u.tab_id % 5 <> 0 THEN u.choice_at ELSE NULL END AS choice_at,
  CASE WHEN u.tab_id % 5 = 0 THEN NULL WHEN u.tab_id % 3 = 0 THEN 'reject_all' WHEN u.tab_id % 3 = 1 THEN 'accept_all' ELSE 'save_preferences' END AS choice_kind,
  b.banner_text, b.buttons, b.toggle_label, u.tab_id % 2 = 0 AS toggle_checked
FROM (SELECT user_id AS tab_id, min(CASE WHEN event_type = 'view' THEN ts END) AS observed_from, max(CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN ts END) AS choice_at
  FROM events GROUP BY user_id) u
JOIN (VALUES (0,'We use strictly necessary cookies and advertising cookies.','Accept all|Reject all|Cookie settings','Advertising cookies'),
 (1,'Cookie notice','Accept all','Analytics cookies'),(2,'Cookie consent for marketing partners.','Accept all|Manage settings','Marketing'),
 (3,'쿠키 사용에 동의해 주세요','모두 허용|거부|설정 저장','분석'),(4,'Your privacy choices','Continue|Save my preferences','Functional'),
 (5,'','','')) AS b(idx, banner_text, buttons, toggle_label) ON b.idx = u.tab_id % 6
""",
    "fx_form_fields": r"""
SELECT c.c_custkey AS field_id, s.tab_id, f.name, f.type, f.label, c.c_custkey % 4 <> 0 AS required
FROM (SELECT c_custkey, (SELECT 1 + max(user_id) FROM events) AS tabs FROM customer) c
JOIN fx_sites s ON s.tab_id = c.c_custkey % c.tabs
JOIN (VALUES (0,'email','email','Email'),(1,'card_number','text','Card number'),(2,'birthdate','text','Date of birth'),(3,'q','search','Search'),
 (4,'userName','text','User name'),(5,'phone','tel','Phone'),(6,'account number','text','Bank'),(7,'agree','checkbox','I agree'),(8,'이메일','text','이메일'),
 (9,'go','submit','Send'),(10,'csrf','hidden','')) AS f(idx, name, type, label) ON f.idx = (c.c_custkey * 3 + 2) % 11
""",
    "fx_storage_keys": r"""
SELECT s.tab_id, CASE WHEN c.c_custkey % 2 = 0 THEN 'local' ELSE 'session' END AS area, k.storage_key
FROM (SELECT c_custkey, (SELECT 1 + max(user_id) FROM events) AS tabs FROM customer) c
JOIN fx_sites s ON s.tab_id = (c.c_custkey * 7) % c.tabs
JOIN (VALUES (0,'auth_token'),(1,'user_email'),(2,'theme'),(3,'lastLocation'),(4,'cartItems'),(5,'deviceId'),(6,'profileName')) AS k(idx, storage_key) ON k.idx = c.c_custkey % 7
""",
    "fx_policy_versions": r"""
SELECT 'https://site' || CAST(d.doc_id - d.doc_id % 3 AS STRING) || '.example/policy' AS url_key, d.doc_id % 3 AS version,
  CASE d.doc_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-01 06:00:00' ELSE TIMESTAMP '2024-01-01 12:00:00' END AS captured_at,
  'Privacy Policy' || chr(10) || chr(10) || f.heading || chr(10) || f.sentence || chr(10) || chr(10) || a.heading || chr(10) || a.sentence || chr(10) || chr(10)
  || b.heading || chr(10) || b.sentence || chr(10) || chr(10) || c.heading || chr(10) || c.sentence || chr(10) || chr(10) || d.text AS body
FROM documents d
JOIN fx_clauses f ON f.idx = d.doc_id % 1
JOIN fx_clauses a ON a.idx = (d.doc_id - d.doc_id % 3 + 1) % 30
JOIN fx_clauses b ON b.idx = ((d.doc_id - d.doc_id % 3) * 11 + 4) % 30
JOIN fx_clauses c ON c.idx = ((d.doc_id - d.doc_id % 3) * 7 + (d.doc_id % 3) * (d.doc_id - d.doc_id % 3) % 4 * 5) % 30
""",
    "fx_checks": r"""
SELECT e.event_id AS check_id, 'https://site' || CAST(e.user_id - e.user_id % 3 AS STRING) || '.example/policy' AS url_key, e.ts AS checked_at,
  e.event_id % 3 = 0 AS ok, CASE WHEN e.event_id % 3 = 0 THEN '' WHEN m.idx = 4 THEN m.message || CAST(400 + e.event_id % 199 AS STRING) ELSE m.message || ' (attempt ' || CAST(e.event_id AS STRING) || ')' END AS error_message
FROM events e
JOIN (VALUES (0,'Policy fetch timed out'),(1,'Policy redirects are not allowed'),(2,'Unsupported policy content type'),(3,'Policy response exceeds the size limit'),
 (4,'Policy fetch failed: '),(5,'Failed to fetch'),(6,'Private policy hosts are not allowed'),(7,'boom')) AS m(idx, message) ON m.idx = e.event_id % 8
WHERE e.event_type = 'error'
""",
    "fx_fetches": r"""
SELECT p.page_id AS fetch_id, x.prefix || CAST(p.page_id AS STRING) || x.suffix AS url, t.content_type,
  CASE WHEN p.page_id % 3 = 0 THEN replace(p.html, '<div class="ad">', '<div class="ad" style="display: none">') WHEN p.page_id % 3 = 1 THEN replace(p.html, '<nav>', '<nav hidden>') ELSE p.html END AS body
FROM pages p
JOIN (VALUES (0,'https://a.example.com/policy/',''),(1,'http://a.example.com/policy/',''),(2,'https://user:pw@a.example.com/',''),(3,'https://10.1.2.3/',''),
 (4,'https://a.example.com/p/','?token=abc'),(5,'https://a.example.com/p/','?lang=en'),(6,'https://printer.local/',''),(7,'https://a.example.com/p/','?lang=en&hl=ko&v=1.2'),(8,'ftp://a.example.com/','')) AS x(idx, prefix, suffix) ON x.idx = p.page_id % 9
JOIN (VALUES (0,'text/html; charset=utf-8'),(1,'text/plain'),(2,'application/pdf'),(3,'application/xhtml+xml')) AS t(idx, content_type) ON t.idx = (p.page_id * 3) % 4
""",
    "fx_candidates": r"""
SELECT c.c_custkey AS el_id, s.tab_id, x.attrs, x.role, x.txt AS text
FROM (SELECT c_custkey, (SELECT 1 + max(user_id) FROM events) AS tabs FROM customer) c
JOIN fx_sites s ON s.tab_id = (c.c_custkey * 11) % c.tabs
JOIN (VALUES (0,'id=onetrust-banner','dialog','We value your privacy. Accept all or reject all cookies.'),(1,'class=promo','','Summer sale: accept our offer today.'),
 (2,'class=cookie-bar','','We use cookies. Accept'),(3,'id=main privacy policy','main','This privacy policy and these terms explain the agreement between you and the company about every condition of use of the service and its data.'),
 (4,'class=footer','','terms privacy'),(5,'class=article','article','A long story about soup, bread and the weather on the coast that never mentions any legal document, told slowly over many quiet evenings.')) AS x(idx, attrs, role, txt) ON x.idx = c.c_custkey % 6
""",
}
DRIVER_TABLES = ("customer", "documents", "events", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a sample table over the tasks of a shuffle, at least one per slot; these tables come as files that
    can't be split, and one task per slot would grow with the table."""
    return df.repartition(slots(df.sparkSession))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of ``sf_dir``; only the views and columns it needs are read."""
    if name in DRIVER_TABLES:
        return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    sql = VIEWS[name]
    inputs = {n: load(spark, sf_dir, n) for n in (*DRIVER_TABLES, *VIEWS) if n != name and _mentions(sql, n)}
    for n in inputs:
        sql = _replace(sql, n)
    df = spark.sql(sql, **inputs)
    # The driver's times carry no zone; make them instants once, here.
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _mentions(sql: str, name: str) -> bool:
    return any(f"{word} {name}" in sql for word in ("FROM", "JOIN"))


def _replace(sql: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return sql


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over ``events`` as a stream: events arrive as files, the small banks are static."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    sql = VIEWS[name]
    inputs = {"events": events}
    inputs |= {n: load(spark, sf_dir, n) for n in VIEWS if n != name and _mentions(sql, n)}
    for n in inputs:
        sql = _replace(sql, n)
    return spark.sql(sql, **inputs)
