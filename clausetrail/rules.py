"""Rule tables: words, patterns and limits the audit is defined by.

Patterns are written in the ECMAScript regular-expression dialect they are
specified in.  ``clausetrail.functions.patterns`` turns them into Java patterns.
All of them are matched without regard to case unless a comment says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Limits.
# ---------------------------------------------------------------------------
MAX_POLICY_CHARS = 120_000
MAX_SENTENCE_CHARS = 2_000
SENTENCE_OVERLAP_CHARS = 160
MAX_BLOCKS = 120
MIN_BLOCK_CHARS = 31
PACKED_BLOCK_CHARS = 700
EVIDENCE_CHARS = 220
EXCERPT_CHARS = 260
BLOCK_TITLE_CHARS = 90
FALLBACK_TITLE_CHARS = 72
BLOCKS_PER_SECTION = 3
MATCHED_WORDS = 4
MAX_VERSION_TEXT_CHARS = 80_000
MAX_VERSIONS = 50
MAX_VERSION_BYTES = 6 * 1024 * 1024
MAX_CONSECUTIVE_FAILURES = 10_000
POLICY_CHECK_INTERVAL_MINUTES = 360
CONSENT_AMBIGUITY_MS = 1_000
SESSION_TTL_SECONDS = 3_600
REQUESTS_PER_TAB = 300
COOKIES_PER_TAB = 120
BASELINES_PER_TAB = 5
OBSERVED_TABS = 50
BURST_CAPACITY = 300
REFILL_PER_SECOND = 60
QUEUE_TOTAL = 500
QUEUE_PER_DOMAIN = 50
COOKIE_BATCH_MS = 100
EXPLICIT_PRIORITY_SECONDS = 300
FORM_FIELDS_PER_PAGE = 120

# ---------------------------------------------------------------------------
# Severities and levels.
# ---------------------------------------------------------------------------
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}
SEVERITY_POINTS = {"low": 4, "medium": 10, "high": 20}

# ---------------------------------------------------------------------------
# Data categories and their example words.
# ---------------------------------------------------------------------------
DATA_CATEGORIES = [
    ("identity", ["이름", "name", "생년월일", "date of birth", "성별", "gender", "국적", "nationality"]),
    ("contact", ["이메일", "email", "전화번호", "phone", "주소", "address", "연락처"]),
    ("account", ["아이디", "username", "password", "비밀번호", "프로필", "profile", "계정"]),
    ("payment", ["결제", "payment", "카드", "credit card", "청구", "billing", "계좌", "bank account"]),
    ("device", ["ip address", "ip주소", "쿠키", "cookie", "device", "기기", "browser", "브라우저", "로그", "log"]),
    ("location", ["location", "위치", "gps", "geolocation", "주소록"]),
    ("usage", ["usage", "이용기록", "행동", "analytics", "분석", "클릭", "방문", "검색 기록"]),
    ("biometric", ["biometric", "생체", "얼굴", "face", "지문", "fingerprint", "건강", "health", "민감정보"]),
]

# ---------------------------------------------------------------------------
# Clause splitting.
# ---------------------------------------------------------------------------
COORDINATED_SUBJECT = (
    r"\b(?:and|while|whereas)\s+(?=(?:(?:we|you|they|the (?:company|service)|our (?:company|service))\b"
    r"|(?:may|might|can|could|will|would|shall)\b))"
)
KOREAN_NEGATED_CONNECTIVE = r"((?:않|아니)(?:으며|지만|으나|고))\s*"
CLAUSE_SEPARATOR = r"\s*(?:;|\bbut\b|\bhowever\b|\bexcept that\b|하지만|그러나|다만)\s*"

# ---------------------------------------------------------------------------
# Negations that veto a clause.
# ---------------------------------------------------------------------------
NEGATED_DATA_ACTION = [
    r"\b(?:do|does|did|will|would|shall|may|might|can|could)\s+not\b[^.;]{0,60}\b(?:collect|process|use|share|sell|transfer|disclose|provide|store|retain)\b",
    r"\b(?:don't|doesn't|didn't|won't|wouldn't|can't|cannot|never)\b[^.;]{0,60}\b(?:collect|process|use|share|sell|transfer|disclose|provide|store|retain)\b",
    r"\b(?:is|are|be|been|will be)\s+not\s+(?:collected|processed|used|shared|sold|transferred|disclosed|provided|stored|retained)\b",
    r"\b(?:collect|process|use|share|sell|transfer|disclose|provide|store|retain)s?\s+no\b",
    r"\bno\s+(?:sale|sharing|transfer|disclosure|collection|processing)\b",
    r"(?:수집|처리|이용|사용|공유|판매|이전|제공|보유|저장)(?:하|되)?지\s*(?:않|아니)",
    r"(?:수집|처리|이용|사용|공유|판매|이전|제공|보유|저장)\s*(?:없|금지)",
]
NEGATED_AD_ACTION = [
    r"\b(?:do|does|did|will|would|shall|may|might|can|could)\s+not\b[^.;]{0,80}\b(?:serve|show|deliver|target|track|profile|advertis)",
    r"\b(?:don't|doesn't|didn't|won't|wouldn't|can't|cannot|never)\b[^.;]{0,80}\b(?:serve|show|deliver|target|track|profile|advertis)",
    r"\b(?:never|without)\b[^.;]{0,80}\b(?:targeting|tracking|profiling|advertising)\b",
    r"(?:맞춤형\s*광고|타겟팅|리타겟팅|행태정보|추적)(?:을|를)?\s*(?:사용|제공|수행|활용)?(?:하|되)?지\s*(?:않|아니)",
]
NEGATED_TERMINATION = [
    r"\b(?:do|does|did|will|would|shall|may|might|can|could)\s+not\b[^.;]{0,80}\b(?:terminate|suspend|disable|restrict|close)\b",
    r"\b(?:don't|doesn't|didn't|won't|wouldn't|can't|cannot|never)\b[^.;]{0,80}\b(?:terminate|suspend|disable|restrict|close)\b",
    r"\b(?:account|access|service)\b[^.;]{0,50}\b(?:will|may|can)?\s*not\s+be\s*(?:terminated|suspended|disabled|restricted|closed)\b",
    r"(?:해지|정지|제한|중단|종료)(?:하|되)?지\s*(?:않|아니)",
]
NEGATED_CHANGE = [
    r"\b(?:do|does|did|will|would|shall|may|might|can|could)\s+not\b[^.;]{0,80}\b(?:change|modify|update|revise)\b",
    r"\b(?:never|won't|wouldn't|cannot|can't)\b[^.;]{0,80}\b(?:change|modify|update|revise)\b",
    r"(?:약관|정책)(?:을|를)?[^.;]{0,40}(?:변경|개정)(?:하|되)?지\s*(?:않|아니)",
]
EXPLICIT_DURATION = [
    r"\b\d+\s*(?:business\s+)?(?:days?|weeks?|months?|years?)\b",
    r"\d+\s*(?:일|주|개월|달|년)",
]
NEGATED_ARBITRATION = [
    r"\b(?:do|does|did|will|would|shall|may|might|can|could)\s+not\b[^.;]{0,80}\b(?:require|impose|use|enforce)\b[^.;]{0,40}\barbitration\b",
    r"\b(?:no|without)\s+(?:mandatory|binding)\s+arbitration\b",
    r"\barbitration\b[^.;]{0,50}\b(?:is|will be)\s+not\s+(?:mandatory|required|binding)\b",
    r"(?:중재|집단소송\s*포기|전속\s*관할)(?:를|을)?[^.;]{0,50}(?:요구|강제|적용|지정)(?:하|되)?지\s*(?:않|아니)",
]

# ---------------------------------------------------------------------------
# What a clause must contain.
# ---------------------------------------------------------------------------
SHARING_TARGET = (
    r"\bthird[- ]part(?:y|ies)\b|\b(?:business )?partners?\b|\baffiliates?\b|제3자|제삼자|협력사|제휴사|외부\s*사업자"
)
SHARING_ACTION = r"\b(?:share|sell|transfer|disclos(?:e|es|ed|ing))\b|공유|판매|이전"
DATA_PROVISION = (
    r"\bprovid(?:e|es|ed|ing)\b.{0,80}\b(?:personal\s+)?(?:data|information)\b"
    r"|\b(?:personal\s+)?(?:data|information)\b.{0,80}\bprovid(?:e|es|ed|ing)\b"
    r"|(?:개인정보|개인\s*정보|데이터|수집\s*정보).{0,80}제공|제공.{0,80}(?:개인정보|개인\s*정보|데이터|수집\s*정보)"
)
CHILD_REFERENCE = (
    r"\bchildren?\b|\bminors?\b|\bunder\s+(?:13|14|16)\b|아동|청소년|미성년자|만\s*(?:13|14|16)세"
)
CHILD_DATA_ACTION = (
    r"\b(?:collect|process|use|share|sell|transfer|store|retain)\b|수집|처리|이용|사용|공유|판매|이전|보유|저장"
)
PROVIDER_TERMINATION = [
    r"\b(?:we|the (?:company|service|provider|operator)|our (?:company|service))\b[^.;]{0,80}\b(?:terminate|suspend|disable|restrict|close)\b",
    r"\b(?:your\s+)?(?:account|access|service)\b[^.;]{0,50}\b(?:may|can|will)?\s*be\s*(?:terminated|suspended|disabled|restricted|closed)\b",
    r"(?:회사|운영자|사업자)(?:는|가|은|이)?.{0,80}(?:계정|서비스|이용).{0,40}(?:해지|정지|제한|중단)|서비스(?:는|가|에서).{0,80}(?:계정|이용).{0,40}(?:해지|정지|제한|중단)",
]
SECURITY_CONTROL = (
    r"encrypt|encryption|access control|multi-factor|two-factor|penetration test|security audit|breach notification"
    r"|암호화|접근통제|다중\s*인증|이중\s*인증|침투\s*테스트|보안\s*감사|침해.{0,12}통지"
)


@dataclass(frozen=True)
class RiskRule:
    """One risk: every group in ``needs`` must match, nothing in ``vetoes`` may.

    ``scope`` says whether the test is made per clause or on the whole document.
    """

    id: str
    severity: str
    needs: list[list[str]]
    vetoes: list[str] = field(default_factory=list)
    scope: str = "clause"


RISK_RULES = [
    RiskRule(
        "broad_data_sharing",
        "high",
        [[SHARING_TARGET], [SHARING_ACTION, DATA_PROVISION]],
        NEGATED_DATA_ACTION,
    ),
    RiskRule(
        "behavioral_ads",
        "medium",
        [[r"targeted ad|personalized ad|interest-based", r"맞춤형 광고|행태정보|타겟팅|리타겟팅"]],
        NEGATED_DATA_ACTION + NEGATED_AD_ACTION,
    ),
    RiskRule(
        "policy_change",
        "medium",
        [[r"change.{0,160}terms|modify.{0,160}terms|update.{0,160}policy", r"약관.{0,120}변경|정책.{0,120}변경|개정"]],
        NEGATED_CHANGE,
    ),
    RiskRule(
        "account_termination",
        "medium",
        [
            [r"terminate|suspend|disable.{0,120}account", r"계정.{0,120}(해지|정지|제한)|서비스.{0,120}중단"],
            PROVIDER_TERMINATION,
        ],
        NEGATED_DATA_ACTION + NEGATED_TERMINATION,
    ),
    RiskRule(
        "liability_limit",
        "medium",
        [
            [
                r"limitation of liability|not liable|disclaim",
                r"책임.{0,120}제한|면책|손해.{0,120}책임.{0,80}(?:없|지지\s*않)",
            ]
        ],
        scope="document",
    ),
    RiskRule(
        "retention_unclear",
        "medium",
        [
            [
                r"as long as necessary|retain.{0,160}necessary|indefinitely",
                r"필요한 기간|필요한 동안|무기한|관계 법령.{0,120}보관",
            ]
        ],
        NEGATED_DATA_ACTION + EXPLICIT_DURATION,
    ),
    RiskRule(
        "overseas_transfer",
        "medium",
        [
            [
                r"international transfer|outside your country|cross-border",
                r"국외 이전|해외 이전|국외.{0,120}보관|해외.{0,120}보관",
            ]
        ],
        NEGATED_DATA_ACTION,
    ),
    RiskRule(
        "arbitration",
        "high",
        [
            [
                r"binding arbitration|class action waiver|waive.{0,120}jury",
                r"(?:강제|의무|구속력|전속).{0,20}중재|중재.{0,30}(?:강제|의무|구속력|전속)|집단소송.{0,120}포기|전속.{0,20}관할|관할 법원.{0,30}(?:전속|지정|한정)",
            ]
        ],
        NEGATED_ARBITRATION,
    ),
    RiskRule(
        "security_vague",
        "low",
        [
            [
                r"reasonable security|appropriate safeguards|industry standard",
                r"합리적인 보안|적절한 보호|기술적.{0,120}관리적.{0,120}조치",
            ]
        ],
        [SECURITY_CONTROL],
        scope="document",
    ),
    RiskRule("children", "high", [[CHILD_REFERENCE], [CHILD_DATA_ACTION]], NEGATED_DATA_ACTION),
]

# ---------------------------------------------------------------------------
# Good signs.
# ---------------------------------------------------------------------------
POSITIVE_RULES = [
    ("delete_right", [r"delete.{0,120}account|right to erasure|withdraw consent", r"회원탈퇴|삭제 요청|동의 철회|처리정지"]),
    (
        "security_controls",
        [r"encrypt|encryption|access control|breach notification", r"암호화|접근통제|침해.{0,80}통지|보안.{0,80}교육"],
    ),
    ("retention_policy", [r"retention period|retain for|stored for", r"보유 기간|파기|삭제.{0,80}기간"]),
]

# ---------------------------------------------------------------------------
# The document gate.
# ---------------------------------------------------------------------------
PRIVACY_MARKER = (
    r"privacy policy|privacy notice|cookie policy|data protection notice|개인정보\s*처리방침|개인정보\s*보호정책"
)
TERMS_MARKER = r"terms (?:of use|of service|and conditions)|user agreement|이용약관|서비스\s*약관"
DOCUMENT_MARKER = PRIVACY_MARKER + "|" + TERMS_MARKER
MARKER_LEAD_CHARS = 2_000
MARKER_LEAD_SHARE = 0.4

CONTROLLER = r"(?:we|the company|our company|the provider|service provider|our organization|the organization|the operator|data controller)"
ACTION_MODIFIER = (
    r"(?:(?:may|might|can|could|will|would|shall|do|does|did|not|also|knowingly|automatically|generally|sometimes)\s+){0,5}"
)
CORE_ACTION = (
    r"(?:collect(?:s|ed|ing)?|process(?:es|ed|ing)?|retain(?:s|ed|ing)?|store[sd]?|storing|delete[sd]?|deleting)"
)
TRANSFER_ACTION = r"(?:share[sd]?|sharing|sell(?:s|ing)?|sold)"
USE_ACTION = r"(?:use[sd]?|using)"
PERSONAL_OBJECT = (
    r"(?:personal (?:data|information)|(?:your|user|customer|account) (?:data|information)"
    r"|(?:data|information) (?:about|from|provided by) you|ip address|device identifier)"
)
CONCRETE_OBJECT = r"(?:your name|name|email(?: address)?|phone(?: number)?|cookies?|location|payment information)"
SPECIFIC_OBJECT = f"(?:{PERSONAL_OBJECT}|{CONCRETE_OBJECT})"
GENERIC_OBJECT = r"(?:information|data)"
PASSIVE_PRACTICE = (
    r"(?:is|are|may be|might be|can be|will be)?\s*(?:collected|processed|used|shared|sold|retained|stored|deleted)\b"
)
USER_NEXUS = (
    r"\b(?:(?:data|information) (?:about|from|provided by) you|when you (?:(?:create|register) (?:an? |your )?account"
    r"|sign up|submit (?:a form|personal (?:data|information)|your (?:data|information)))|your account)\b"
)
EXPOSITORY_FRAME = (
    r"^\s*(?:(?:this|the|our|a|an)\s+(?:article|guide|overview|tutorial|report|study|page|news(?: story)?)\s+"
    r"(?:(?:explains?|compares?|discusses?|describes?|shows?|teaches?|reviews?)\b|on how\b)|learn how\b)"
)
IMPERATIVE_ACTION = r"^\s*(?:collect|process|retain|store|delete|share|sell|use)\b"
ACCOUNT_HELP = (
    r"^\s*(?:(?:to|how to)\s+(?:access|correct|delete|erase|remove|close|suspend|update)"
    r"|(?:accessing|correcting|deleting|erasing|removing|closing|suspending|updating)\b"
    r"|click\b.{0,60}\b(?:access|correct|delete|erase|remove|close|suspend|update)\b)"
    r".{0,160}\b(?:your )?account (?:data|information)\b"
)
_ANY_ACTION = f"(?:{CORE_ACTION}|{TRANSFER_ACTION}|{USE_ACTION})"
_HOLDING_ACTION = f"(?:{CORE_ACTION}|{TRANSFER_ACTION})"
CONTROLLER_SPECIFIC = (
    rf"\b{CONTROLLER}\b\s+{ACTION_MODIFIER}{_ANY_ACTION}\b.{{0,120}}\b{SPECIFIC_OBJECT}\b"
    rf"|\b{SPECIFIC_OBJECT}\b.{{0,120}}\b{CONTROLLER}\b\s+{ACTION_MODIFIER}{_ANY_ACTION}\b"
)
CONTROLLER_GENERIC = (
    rf"\b{CONTROLLER}\b\s+{ACTION_MODIFIER}{_HOLDING_ACTION}\b.{{0,120}}\b{GENERIC_OBJECT}\b"
    rf"|\b{GENERIC_OBJECT}\b.{{0,120}}\b{CONTROLLER}\b\s+{ACTION_MODIFIER}{_HOLDING_ACTION}\b"
)
DIRECT_SPECIFIC = (
    rf"\b{_ANY_ACTION}\b.{{0,120}}\b{PERSONAL_OBJECT}\b|\b{PERSONAL_OBJECT}\b.{{0,120}}\b{PASSIVE_PRACTICE}"
)
DIRECT_CONCRETE = (
    rf"\b{_HOLDING_ACTION}\b.{{0,120}}\b{CONCRETE_OBJECT}\b|\b{CONCRETE_OBJECT}\b.{{0,120}}\b{PASSIVE_PRACTICE}"
    rf"|\b{USE_ACTION}\b.{{0,80}}\bcookies?\b"
)
KOREAN_DATA_OBJECT = r"(?:개인정보|개인\s*정보|아동.{0,12}정보|이름|이메일|전화번호|쿠키|위치|결제\s*정보)"
KOREAN_DATA_ACTION = r"(?:수집|처리|이용|사용|제공|공유|판매|보유|저장|파기|삭제)(?:하|합|됩|되|했|할|해)"
KOREAN_BARE_ACTION = r"(?:수집|처리|이용|사용|제공|공유|판매|보유|저장|파기|삭제)"
KOREAN_CONTROLLER = r"(?:회사|당사|서비스\s*제공자|운영자|개인정보처리자)"

RIGHTS_OR_RETENTION = [
    r"\b(?:right to (?:access|delete|erasure)|withdraw consent|retention period|retain(?:ed)? for"
    r"|request (?:access(?: to)?|correction(?: of)?|deletion(?: of)?|erasure(?: of)?)"
    r"|you (?:may|can) (?:access|correct|delete|erase))\b.{0,120}\b(?:personal|your|user|customer) (?:data|information)\b"
    r"|\bdata subject\b",
    r"정보주체|(?:동의\s*철회|열람|정정|보유\s*기간|파기).{0,120}(?:개인정보|개인\s*정보)"
    r"|(?:개인정보|개인\s*정보).{0,120}(?:동의\s*철회|열람|정정|보유\s*기간|파기)",
]
STRONG_TERMS_CLAUSES = [
    r"\b(?:dispute|claim|controversy|party|parties|you|user).{0,100}(?:subject to|resolved by|requires?|must|shall|will)"
    r".{0,80}binding arbitration\b|\bbinding arbitration\b.{0,80}(?:is required|shall|required|must|waive)",
    r"\b(?:waive|waiver|may not bring|no)\b.{0,80}\bclass action\b",
    r"limitation of liability|\bnot liable\b|\bdisclaim(?:er|s|ed|ing)?\b|책임\s*제한|면책|손해.{0,120}책임(?:을|이)?\s*(?:지지\s*않|없)",
    r"\b(?:we|the company|our company|the provider|service provider)\b\s+(?:(?:may|can|will|shall|also)\s+){0,4}"
    r"(?:suspend|terminate|close)\b.{0,80}\b(?:your )?account\b"
    r"|\breserves? the right to\s+(?:suspend|terminate|close)\b.{0,80}\b(?:your )?account\b"
    r"|(?:회사|서비스\s*제공자).{0,80}계정.{0,80}(?:해지|정지)",
]
WEAK_TERMS_SIGNALS = [
    r"\b(?:these terms|this agreement)\b.{0,100}\b(?:governed by|construed under|governing law)\b|준거법|관할\s*법원",
    r"acceptable use.{0,100}(?:prohibit|must|may not|rules?)|금지\s*행위",
    r"intellectual property.{0,100}(?:rights?|ownership|licen[cs]e|remain|belong)|지식재산권",
    r"agree to (?:these|the) terms|agree to be bound|약관에\s*동의",
]
GATE_WEIGHTS = {"marker": 0.35, "practice": 0.5, "rights": 0.25, "terms": 0.5}
GATE_THRESHOLD = 0.5

# ---------------------------------------------------------------------------
# The page gate.
# ---------------------------------------------------------------------------
STRONG_PAGE_HINTS = [
    "privacy policy",
    "privacy notice",
    "terms of service",
    "terms and conditions",
    "개인정보처리방침",
    "개인정보 처리방침",
    "서비스 이용약관",
    "이용약관",
]
PATH_PAGE_HINTS = STRONG_PAGE_HINTS + ["privacy", "terms", "policy", "약관", "개인정보"]
SUPPORTING_PAGE_HINTS = [
    "personal data",
    "personal information",
    "data controller",
    "retention period",
    "third parties",
    "수집하는 개인정보",
    "개인정보 보호책임자",
    "보유 및 이용기간",
    "제3자 제공",
    "처리 목적",
]
READABLE_HINTS = ["terms", "privacy", "policy", "agreement", "condition", "약관", "개인정보", "처리방침", "이용약관", "동의"]
READABLE_MIN_CHARS = 120
READABLE_SCORE_CHARS = 20_000

# ---------------------------------------------------------------------------
# Policy sections (heading patterns, content patterns).
# ---------------------------------------------------------------------------
BLOCK_HEADING = (
    r"\n(?=(?:\d{1,2}[.)]\s*)?(?:[A-Z][A-Za-z ]{3,80}|[가-힣0-9][가-힣0-9\s·/()]{3,80})(?:\n|$))"  # case matters here
)
SECTION_RULES = [
    (
        "collected_data",
        [
            r"collect(ed|ion)?|personal information we collect|information you provide",
            r"수집.{0,100}항목|처리.{0,100}항목|개인정보.{0,100}수집|수집하는.{0,100}정보",
        ],
        [r"name|email|phone|address|payment|cookie|device|location", r"이름|이메일|전화|주소|결제|쿠키|기기|위치"],
    ),
    (
        "purpose",
        [r"purpose|use of information|how we use", r"수집.{0,100}목적|이용.{0,100}목적|처리.{0,100}목적"],
        [r"provide|service|account|support|advertis|analytics|marketing", r"서비스|회원|본인확인|고객지원|광고|분석|마케팅"],
    ),
    (
        "legal_basis",
        [
            r"legal basis|lawful basis|grounds for processing|basis for processing",
            r"법적.{0,100}근거|처리.{0,100}근거|적법.{0,100}근거",
        ],
        [
            r"consent|contract|legal obligation|legitimate interest|public interest|vital interest",
            r"동의|계약|법적 의무|정당한 이익|공익|생명.{0,100}이익",
        ],
    ),
    (
        "retention",
        [r"retention|retain|storage period|delete", r"보유.{0,100}기간|이용.{0,100}기간|파기|삭제"],
        [r"retain|delete|erase|as long as|period|year|month", r"보유|파기|삭제|기간|년|개월|목적.{0,100}달성"],
    ),
    (
        "third_party",
        [r"third part(y|ies)|share|disclosure", r"제3자|제삼자|제공|공유"],
        [
            r"third part(y|ies)|partner|affiliate|share|sell|transfer",
            r"제3자|제삼자|제휴사|협력사|제공|공유|판매|이전",
        ],
    ),
    (
        "processors",
        [r"processor|service provider|subprocessor|vendor", r"처리위탁|수탁|위탁|수탁자"],
        [r"processor|provider|vendor|subprocessor|entrust", r"처리위탁|수탁|위탁|대행|업체"],
    ),
    (
        "overseas_transfer",
        [
            r"international transfer|cross-border|outside",
            r"국외.{0,100}이전|해외.{0,100}이전|국외.{0,100}보관|해외.{0,100}보관",
        ],
        [r"international|country|outside|cross-border", r"국외|해외|이전.{0,100}국가|보관.{0,100}국가"],
    ),
    (
        "automated_decision",
        [r"automated decision|profiling|profile", r"자동화.{0,100}의사결정|프로파일링|프로파일"],
        [
            r"automated|profiling|logic involved|significant effect",
            r"자동화|프로파일링|로직|중대한.{0,100}영향",
        ],
    ),
    (
        "cookies_tracking",
        [r"cookie|tracking|advertis|analytics", r"쿠키|행태정보|맞춤형.{0,100}광고|추적|광고|분석"],
        [r"cookie|tracking|pixel|advertis|analytics|opt out", r"쿠키|행태정보|추적|광고|분석|거부|동의"],
    ),
    (
        "user_rights",
        [
            r"your rights|access|deletion|withdraw|choice",
            r"이용자.{0,100}권리|정보주체.{0,100}권리|열람|정정|삭제|동의.{0,100}철회|처리정지",
        ],
        [r"access|delete|correct|withdraw|opt out|request", r"열람|정정|삭제|동의.{0,100}철회|처리정지|요청"],
    ),
    (
        "security",
        [r"security|safeguard|protect", r"보안|보호.{0,100}조치|안전성.{0,100}확보|기술적.{0,100}관리적"],
        [r"encrypt|access control|security|breach|safeguard", r"암호화|접근통제|보안|침해|보호조치"],
    ),
    (
        "children",
        [r"children|minor|under 13|under 16", r"아동|청소년|미성년자|만\s?14세"],
        [r"children|minor|parent|guardian|under", r"아동|청소년|미성년자|법정대리인|보호자"],
    ),
    (
        "dispute_liability",
        [r"dispute|arbitration|liability|disclaimer", r"분쟁|중재|책임|면책|손해배상|관할"],
        [r"arbitration|liable|liability|dispute|class action", r"중재|책임|면책|분쟁|손해|관할"],
    ),
]
SECTION_IDS = [section for section, _, _ in SECTION_RULES]

# ---------------------------------------------------------------------------
# Field names that carry personal data (on normalised tokens).
# ---------------------------------------------------------------------------
SENSITIVE_FIELDS = [
    ("contact", [r"\b(?:email|emailaddress|e mail|phone|phonenumber|telephone|tel|mobile|address)\b", r"이메일|전화|주소"]),
    ("identity", [r"\b(?:name|fullname|firstname|lastname|birth|dateofbirth|birthday|gender|age)\b", r"이름|생년|성별|나이"]),
    (
        "account",
        [
            r"\b(?:user|username|login|password|passwd|pwd|profile|account)\b(?!\s+number\b)",
            r"아이디|비밀번호|계정|프로필",
        ],
    ),
    (
        "payment",
        [r"\b(?:card|cardnumber|payment|billing|bank|account number|accountnumber)\b", r"카드|결제|청구|계좌"],
    ),
    ("location", [r"\b(?:lat|latitude|lng|lon|longitude|location|geo|gps)\b", r"위치|좌표"]),
    ("device", [r"\b(?:ip|ipaddress|device|cookie|session|token|uuid|gaid|idfa)\b", r"기기|쿠키|세션|토큰"]),
]
KEYS_PER_CATEGORY = 8

# ---------------------------------------------------------------------------
# What a policy must mention (on lower-cased text).
# ---------------------------------------------------------------------------
MENTIONS = {
    "advertising": r"advertising|analytics|tracking|cookie|personalized ad|interest-based|광고|분석|추적|쿠키|행태정보|맞춤형",
    "storage": r"cookie|localstorage|sessionstorage|browser storage|device identifier|쿠키|브라우저 저장|로컬스토리지|세션스토리지|식별자|행태정보",
    "third_party": r"third parties?|제3자|처리위탁|수탁|광고|분석",
    "special_category": r"special categor|sensitive|biometric|genetic|health|racial|ethnic|political|religious|민감|생체|건강",
    "sensitive_us": r"sensitive|precise geolocation|biometric|health|financial|민감|생체|건강|금융",
    "parental": r"parent|guardian|verifiable parental consent|coppa|보호자|법정대리인",
}
POLICY_DOMAIN = r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"

# ---------------------------------------------------------------------------
# Trackers and tracking cookies.
# ---------------------------------------------------------------------------
TRACKER_DOMAINS = [
    "google-analytics.com",
    "analytics.google.com",
    "googletagmanager.com",
    "doubleclick.net",
    "googleadservices.com",
    "googlesyndication.com",
    "facebook.com",
    "facebook.net",
    "connect.facebook.net",
    "meta.com",
    "hotjar.com",
    "hotjar.io",
    "mixpanel.com",
    "segment.com",
    "segment.io",
    "amplitude.com",
    "fullstory.com",
]
TRACKER_TOKENS = ["adservice", "analytics", "tracking", "tracker", "pixel", "collect"]
TRACKING_COOKIE = (  # on the lower-cased name
    r"^(?:_?ga(?:_[a-z0-9_-]{1,128})?|_?gid|_?gat(?:_[a-z0-9_-]{1,128})?|_?gac(?:_[a-z0-9_-]{1,128})?|_?fbp|_?fbc"
    r"|_?gcl(?:_[a-z0-9_-]{1,128})?|__utm[a-z]+|amp_token|ajs(?:_[a-z0-9_-]{1,128})?|amplitude(?:_[a-z0-9_-]{1,128})?"
    r"|mixpanel(?:_[a-z0-9_-]{1,128})?|mp_[a-z0-9_-]{1,128}_mixpanel|visitor(?:_[a-z0-9_-]{1,128})?"
    r"|track(?:er|ing)?(?:_[a-z0-9_-]{1,128})?)$"
)

# ---------------------------------------------------------------------------
# Vendors, in match order (vendor, host patterns, category, risk, expected sections).
# ---------------------------------------------------------------------------
VENDOR_RULES = [
    (
        "Google Analytics",
        ["google-analytics.com", "analytics.google.com", "googletagmanager.com"],
        "analytics",
        "tracking",
        ["cookies_tracking", "third_party", "processors"],
    ),
    (
        "Google Ads / DoubleClick",
        ["doubleclick.net", "googleadservices.com", "googlesyndication.com"],
        "advertising",
        "tracking",
        ["cookies_tracking", "third_party"],
    ),
    (
        "Meta Pixel",
        ["connect.facebook.net", "facebook.com", "facebook.net"],
        "advertising",
        "tracking",
        ["cookies_tracking", "third_party"],
    ),
    ("Hotjar", ["hotjar.com", "hotjar.io"], "analytics", "tracking", ["cookies_tracking", "processors"]),
    ("Segment", ["segment.com", "segment.io"], "analytics", "tracking", ["cookies_tracking", "processors"]),
    ("Amplitude", ["amplitude.com"], "analytics", "tracking", ["cookies_tracking", "processors"]),
    ("Stripe", ["stripe.com", "stripe.network"], "payment", "processor", ["processors", "purpose", "security"]),
    ("PayPal", ["paypal.com", "paypalobjects.com"], "payment", "processor", ["processors", "purpose", "security"]),
    ("Intercom", ["intercom.io", "intercomcdn.com"], "support", "processor", ["processors", "purpose"]),
    ("Zendesk", ["zendesk.com", "zdassets.com"], "support", "processor", ["processors", "purpose"]),
    ("Sentry", ["sentry.io", "ingest.sentry.io"], "error_monitoring", "processor", ["processors", "security"]),
    ("Cloudflare", ["cloudflare.com", "cloudflareinsights.com"], "cdn_security", "infrastructure", ["security"]),
    ("Amazon Web Services", ["amazonaws.com", "cloudfront.net"], "hosting", "processor", ["processors", "security"]),
    ("Auth0", ["auth0.com"], "authentication", "processor", ["processors", "security", "purpose"]),
    (
        "reCAPTCHA",
        ["recaptcha.net", "www.google.com/recaptcha", "gstatic.com/recaptcha"],
        "security",
        "processor",
        ["processors", "security"],
    ),
]
UNKNOWN_VENDOR = ("Unknown", "unknown", "unknown", ["third_party", "processors"])
CUSTOM_CATEGORIES = [
    "authentication",
    "payment",
    "analytics",
    "advertising",
    "support",
    "error_monitoring",
    "cdn_security",
    "hosting",
    "security",
    "unknown",
]
CUSTOM_RISKS = ["processor", "tracking", "infrastructure", "unknown"]
CUSTOM_SECTIONS = ["processors", "purpose", "security", "cookies_tracking", "third_party", "overseas_transfer"]
CUSTOM_PATTERN = r"^(?:\*\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,63}|xn--[a-z0-9-]{2,59})$"
MAX_CUSTOM_RULES = 100
MAX_CUSTOM_PATTERNS = 20

# ---------------------------------------------------------------------------
# Consent.
# ---------------------------------------------------------------------------
CONSENT_CATEGORIES = [
    (
        "necessary",
        "low",
        [r"necessary|essential|required|strictly necessary|security|session", r"필수|보안|세션|로그인|인증"],
    ),
    (
        "functional",
        "low",
        [r"functional|functionality|preference|preferences|remember", r"기능|환경설정|선호|편의|저장"],
    ),
    (
        "personalization",
        "medium",
        [r"personalization|personalisation|personalized|recommend|profile", r"개인화|맞춤|추천|프로필"],
    ),
    ("analytics", "medium", [r"analytics|performance|statistics|measurement|metrics", r"분석|통계|성능|측정|지표"]),
    (
        "advertising",
        "high",
        [r"advertising|ads?|marketing|targeting|retargeting|interest-based", r"광고|마케팅|타겟|리타겟|행태정보"],
    ),
    (
        "social",
        "medium",
        [r"social|facebook|instagram|twitter|x\.com|linkedin|share", r"소셜|SNS|페이스북|인스타그램|공유"],
    ),
    (
        "third_party",
        "high",
        [r"third part(y|ies)|partners?|vendors?|service providers?", r"제3자|제삼자|파트너|제휴사|수탁|위탁|외부"],
    ),
]
ACCEPT_FALLBACK = ["necessary", "functional", "analytics", "advertising"]
# On lower-cased button text, first match wins.
CHOICE_BUTTONS = [
    (
        "necessary_only",
        r"reject|decline|deny|refuse|do not sell|opt out|necessary only|거부|거절|동의하지 않|필수만|선택 해제|옵트아웃",
    ),
    (
        "save_choices",
        r"\b(?:save|apply)\s+(?:my\s+)?(?:preferences|settings|choices?|selections?)\b"
        r"|\bconfirm\s+(?:my\s+)?(?:preferences|settings|choices?|selections?)\b|(?:설정|선택)\s*(?:저장|적용)|선택\s*완료",
    ),
    ("preferences", r"preference|settings|manage|customize|options|설정|관리|선택|맞춤|변경"),
    (
        "accept_all",
        r"accept|agree|allow|consent|동의|허용|수락|accept all|allow all|agree all|전체 동의|모두 허용|모두 수락|전부 허용",
    ),
]
# On lower-cased control text plus attributes, first match wins.
RECORDED_CHOICES = [
    (
        "reject_all",
        r"\b(?:reject|reject all|decline|decline all|deny|deny all|refuse|essential only|necessary only|only necessary"
        r"|do not accept|opt[ -]?out)\b|(?:모두|전체)?\s*(?:거부|거절)|필수만|필수\s*(?:쿠키)?만",
    ),
    (
        "accept_all",
        r"\b(?:accept all|allow all|agree all|accept|agree|allow)\b|(?:모두|전체|전부)\s*(?:허용|동의|수락)|수락|허용|^동의$",
    ),
    (
        "save_preferences",
        r"\b(?:save|apply)\s+(?:my\s+)?(?:preferences|settings|choices?|selections?)\b"
        r"|\bconfirm\s+(?:my\s+)?(?:preferences|settings|choices?|selections?)\b|(?:설정|선택)\s*(?:저장|적용)"
        r"|저장\s*(?:및\s*)?(?:닫기|종료)?$",
    ),
]
CONSENT_HINTS = [
    "cookie",
    "cookies",
    "consent",
    "privacy choices",
    "do not sell",
    "opt out",
    "쿠키",
    "동의",
    "개인정보 선택",
    "판매 거부",
]
CONSENT_MANAGER = r"(?:^|[^a-z])(?:cmp|cookiebot|didomi|onetrust|quantcast|trustarc)(?:$|[^a-z])"
CONSENT_TEXT_CHARS = 3_000
DISABLED_TOGGLE = r"analytics|advertising|ads|marketing|tracking|광고|분석|마케팅|추적"

# ---------------------------------------------------------------------------
# Places.
# ---------------------------------------------------------------------------
EU_COUNTRIES = (
    "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE IS LI NO".split()
)
US_TIME_ZONES = (
    "america/adak america/anchorage america/boise america/chicago america/denver america/detroit america/juneau "
    "america/los_angeles america/menominee america/metlakatla america/new_york america/nome america/phoenix "
    "america/sitka america/yakutat pacific/honolulu"
).split()
US_TIME_ZONE_PREFIXES = ["america/indiana/", "america/kentucky/", "america/north_dakota/"]
EU_TIME_ZONES = (
    "asia/nicosia atlantic/reykjavik europe/amsterdam europe/athens europe/berlin europe/bratislava europe/brussels "
    "europe/bucharest europe/budapest europe/copenhagen europe/dublin europe/helsinki europe/lisbon europe/ljubljana "
    "europe/luxembourg europe/madrid europe/malta europe/mariehamn europe/oslo europe/paris europe/prague europe/riga "
    "europe/rome europe/sofia europe/stockholm europe/tallinn europe/vaduz europe/vienna europe/vilnius europe/warsaw "
    "europe/zagreb"
).split()
EU_LANGUAGES = "bg cs da de el es et fi fr ga hr hu is it lt lv mt nl no pl pt ro sk sl sv".split()
EU_TLDS = (
    "eu at be bg hr cy cz dk ee fi fr de gr hu ie it lv lt lu mt nl pl pt ro sk si es se is li no".split()
)
COUNTRY_TLDS = {
    "kr": "KR", "us": "US", "uk": "GB", "de": "DE", "fr": "FR", "jp": "JP", "cn": "CN", "ca": "CA", "au": "AU",
    "nz": "NZ", "sg": "SG", "in": "IN", "br": "BR", "mx": "MX", "es": "ES", "it": "IT", "nl": "NL", "be": "BE",
    "se": "SE", "no": "NO", "dk": "DK", "fi": "FI", "pl": "PL", "at": "AT", "ch": "CH", "cz": "CZ", "pt": "PT",
    "gr": "GR", "ie": "IE",
}

# ---------------------------------------------------------------------------
# Jurisdiction checks.
# ---------------------------------------------------------------------------
CORE_SECTIONS = {
    "GDPR": ["collected_data", "purpose", "legal_basis", "retention", "user_rights", "security"],
    "KR": ["collected_data", "purpose", "retention", "user_rights", "security"],
    "US": ["collected_data", "purpose", "third_party", "user_rights"],
}

# ---------------------------------------------------------------------------
# Policy versions.
# ---------------------------------------------------------------------------
IMPORTANT_CHANGE_SECTIONS = [
    "third_party",
    "cookies_tracking",
    "overseas_transfer",
    "retention",
    "legal_basis",
    "security",
    "processors",
]
NOTIFY_SECTIONS = [
    "collected_data",
    "purpose",
    "third_party",
    "cookies_tracking",
    "overseas_transfer",
    "retention",
    "legal_basis",
    "automated_decision",
    "user_rights",
    "security",
    "processors",
    "children",
    "dispute_liability",
]
PERMISSION_WITHHELD = r"(not|never|않|아니|없).{0,20}(share|provide|sell|제공|공유|판매)"
PERMISSION_GRANTED = r"(may|can|share|provide|sell|partner|third|제공|공유|판매|파트너|제3자|수탁)"
TRACKING_WORDING = r"(cookie|tracking|advertis|analytics|쿠키|추적|광고|분석|행태정보)"
SAFE_POLICY_QUERY = ["hl", "lang", "locale", "v", "version"]
SAFE_LOCALE_VALUE = r"^[a-z]{2,3}(?:[-_][a-z]{2,4}){0,2}$"
SAFE_VERSION_VALUE = r"^v?\d{1,4}(?:[._-]\d{1,4}){0,4}$"
CHECK_ERRORS = [
    "network",
    "timeout",
    "http_status",
    "redirect",
    "content_type",
    "response_too_large",
    "invalid_url",
    "not_policy",
    "unknown",
]

# ---------------------------------------------------------------------------
# Document admission.
# ---------------------------------------------------------------------------
MAX_POLICY_URL_CHARS = 2_048
MAX_POLICY_BYTES = 1024 * 1024
MAX_RAW_URL_CHARS = 16 * 1024
POLICY_CONTENT_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]
SENSITIVE_QUERY_KEY = (
    r"(?:^|[_.\[-])(access|auth|code|credential|jwt|key|nonce|otp|pass|password|secret|session|signature|ticket|token)"
    r"(?:$|[_.\]-])"
)
SENSITIVE_QUERY_COMPACT = r"^(?:access|api|auth|bearer|client|csrf|id|oauth|refresh|session)(?:key|secret|token)$"
PRIVATE_HOST_NAMES = ["localhost", "localdomain"]
PRIVATE_HOST_SUFFIXES = [
    ".localhost", ".localdomain", ".local", ".internal", ".lan", ".home.arpa", ".invalid", ".test", ".onion",
]

# ---------------------------------------------------------------------------
# Path and key minimisation.
# ---------------------------------------------------------------------------
MAX_PATH_SEGMENTS = 3
MAX_PATH_CHARS = 180
MAX_FIELD_KEYS = 24
MAX_FIELD_KEY_CHARS = 48
TOKEN_LIKE_PATH = r"^(?:[a-f\d]{8}-[a-f\d-]{27,}|[a-f\d]{24,}|eyJ[a-zA-Z\d_-]{16,}|[a-zA-Z\d_-]{32,})$"  # case matters
STATIC_FILE = r"^(?:css|gif|html?|ico|jpe?g|js|json|png|svg|txt|webp)$"
ROUTE_WORDS = (
    "account ad ads advertising analytics api assets auth beacon callback cdn checkout collect consent cookie cookies "
    "event events graphql legal login logout metrics oauth payment payments pixel policy privacy profile recaptcha reset "
    "security static telemetry terms track tracking user users"
).split()
LOCALE_SEGMENTS = "de en en-gb en-us es fr ja ko ko-kr pt zh zh-cn zh-tw".split()
UUID_TEXT = r"(?<![a-z\d])[a-f\d]{8}(?:-[a-f\d]{4}){3}-[a-f\d]{12}(?![a-z\d])"
LONG_NUMBER = r"\d{6,}"
IDENTIFIER_PREFIXES = (
    "account analytics auth client cookie customer device event field installation marketing member org organization "
    "profile property request session tracking tenant uid user userid visitor"
).split()
IDENTIFIER_WORDS = (
    "access account action ad ads address age analytics auth browser birth campaign card cart category city client "
    "company consent cookie country created csrf currency device date email enabled event field flag gender id identifier "
    "in ip key lang language locale location logged login logout marketing medium name number order page password payment "
    "phone postal preference preferences profile property purpose query refresh region referrer remember request role "
    "session source status state storage time timestamp token tracking type updated user uuid value version visitor hex "
    "xsrf zip"
).split()
STANDALONE_NAME = r"^(?:_ga|_gid|_gat|_fbp|_fbc|amp_token|cookieconsent|csrftoken|jsessionid|phpsessid|connect\.sid)$"
STATIC_TRACKING_COOKIE = r"^(?:__utm[a-z]+|_?ga|_?gid|_?gat|_?gac|_?gcl|_?fbp|_?fbc|amp_token)$"
IDENTIFIER_HINTS = [
    (r"(?:e-?mail|이메일)", "email"),
    (r"(?:phone|mobile|tel|전화)", "phone"),
    (r"(?:session|sess|세션)", "session"),
    (r"(?:auth|login|로그인|인증)", "auth"),
    (r"(?:consent|cookie|쿠키|동의)", "consent"),
    (r"(?:analytic|track|metric|telemetry|분석|추적)", "analytics"),
    (r"(?:advert|marketing|campaign|광고|마케팅)", "marketing"),
    (r"(?:account|profile|user|member|customer|visitor|tenant|uid|계정|사용자|회원|고객)", "user"),
]

# ---------------------------------------------------------------------------
# HTML text extraction.
# ---------------------------------------------------------------------------
MAX_HTML_CHARS = 1024 * 1024
MAX_EXTRACTED_CHARS = 256 * 1024
MAX_HTML_DEPTH = 256
SKIPPED_TAGS = ["script", "style", "noscript", "template", "svg"]
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
HTML_ENTITIES = {
    "amp": "&", "apos": "'", "bull": "•", "copy": "©", "emsp": " ", "ensp": " ", "gt": ">", "hellip": "…",
    "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "middot": "·", "nbsp": " ", "ndash": "–", "quot": '"',
    "rdquo": "”", "reg": "®", "rsquo": "’", "thinsp": " ", "trade": "™",
}

# Form controls that hold no answer.
SKIPPED_FIELD_TYPES = ["hidden", "submit", "button", "reset", "image"]
