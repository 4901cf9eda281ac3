"""Fixed values of the document library: names, orders and patterns that results depend on."""

# What file names become in identifiers, longest first where one holds another.
SLUG_SUFFIX = r"_\d{4}개정$"
SLUG_WORDS = [
    ("상환전환우선주식", "rcps"),
    ("전환우선주식", "convertible-preferred"),
    ("신주인수권부사채", "bond-with-warrants"),
    ("조건부지분전환계약서", "safe-conditional-equity"),
    ("주주간계약서", "sha"),
    ("전환사채", "convertible-bond"),
    ("보통주식", "common"),
    ("투자계약서", "investment"),
    ("초기", "early"),
    ("중기", "mid"),
    ("후기", "late"),
    ("통합형", "integrated"),
    ("분리형", "separated"),
]

# Clause types and the words that tell them, in the order in which they are tried.
CLAUSE_RULES = [
    ("recitals", ["본 계약서는", "본 투자계약서", "아래 당사자들 사이에서"]),
    ("definitions", ["용어의 뜻은 다음과 같다", "정의"]),
    ("purchase_price", ["신주의 발행 사항", "발행가액", "인수가액", "투자금의 지급"]),
    ("conditions_precedent", ["선행조건", "투자의 선행조건"]),
    ("reps_warranties_seller", ["진술과 보장", "진술하고 보장한다"]),
    ("closing_mechanics", ["거래의 완결", "거래완결일"]),
    ("termination_for_cause", ["거래완결일 전 해제", "해제"]),
    ("obligations_general", ["투자금의 용도", "사용용도", "구조조정", "M&A에 관한 사항", "이해관계인의 책임"]),
    ("non_compete", ["기술의 이전", "겸업", "경업금지", "신회사 설립 제한"]),
    ("information_rights", ["보고 및 자료 제출", "경영사항에 대한"]),
    ("audit_rights", ["회계 및 업무감사", "시정조치"]),
    ("lock_up", ["이해관계인의 주식 처분", "주식처분"]),
    ("right_of_first_refusal", ["우선매수권", "공동매도참여권"]),
    ("tag_along", ["공동매도참여권"]),
    ("put_call_option", ["주식매수청구권"]),
    ("liquidated_damages", ["손해배상 및 위약벌", "위약벌"]),
    ("late_payment", ["지연배상금", "지연손해금"]),
    ("assignment", ["양도금지", "권리 및 의무의 양도"]),
    ("confidentiality", ["비밀유지"]),
    ("notices", ["통지"]),
    ("taxes", ["세금"]),
    ("severability", ["일부 무효", "가분성"]),
    ("governing_law", ["준거법", "관할법원", "분쟁해결"]),
    ("entire_agreement", ["본 계약의 효력"]),
    ("amendment", ["계약의 내용 변경", "계약의 변경"]),
    ("term_duration", ["계약의 종료", "계약기간"]),
    ("conversion_rights", ["전환에 관한 사항", "전환사채의 전환"]),
    ("liquidation_preference", ["잔여재산 분배"]),
    ("dividend_distribution", ["배당에 있어서 우선권"]),
    ("preemptive_rights", ["신주인수권"]),
    ("board_composition", ["임원의 선임", "이사 선임", "관찰자 파견", "이사회 구성"]),
    ("employee_matters", ["주식매수선택권의 부여"]),
    ("exhibits_schedules", ["별지", "부록", "첨부"]),
    ("signature_block", ["서명 또는 날인", "서명날인"]),
    ("drag_along", ["동반매도청구권", "동반매각청구권"]),
]
# Our own rules: words that tell a clause's risk where there is no library to compare it with, gravest first.
GENERAL_RISKS = [
    ("critical", ["unlimited liability", "sole discretion", "irrevocabl", "무한책임", "무제한"]),
    ("high", ["indemnif", "liquidated damages", "penalty", "non-compete", "waive", "위약벌", "손해배상", "경업금지", "연대"]),
    ("medium", ["terminat", "exclusive", "assign", "interest", "해제", "해지", "독점", "양도"]),
]
# Our own patterns: levels of nested numbering, highest first; signs that count from 1; what labels and references look like.
LEVELS = [(1, r"^제(\d+)장"), (1, r"^(?i:chapter|part)\s+(\d+)\b"), (2, r"^제(\d+)조"), (2, r"^(?i:article|section)\s+(\d+)(?![\d.]*\.\d)"), (3, r"^([①-⑳])"), (3, r"^\((\d+)\)"), (4, r"^(\d+)[.)](?!\d)"), (5, r"^([가나다라마바사아자차카타파하])[.)]"), (5, r"^\(?([a-z])\)")]
ALPHABETS = ["①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳", "가나다라마바사아자차카타파하", "abcdefghijklmnopqrstuvwxyz"]
ARTICLE_NUMBER, SECTION_NUMBER = r"^제(\d+)조\s*(?:[(（【\[]|$)", r"^(?:#{1,4}\s+)?(?i:section|article)\s+(\d+(?:\.\d+)*)\b"
OWN_NUMBER = r"^(?:제\d+조(?=\s*(?:[(（【\[]|$))|(?:#{1,4}\s+)?(?i:section|article)\s+\d+(?:\.\d+)*)"
REFERENCES = [("article", r"제(\d+)조(?:\s*(?:내지|부터|[-~])\s*제(\d+)조)?"), ("section", r"(?i:sections?|articles?)\s+(\d+(?:\.\d+)*)(?:\s*(?:to|through|-|–)\s*(\d+(?:\.\d+)*))?")]
# Words of governance, tried before all others; the type of chapter headings; of what nothing tells.
GOVERNANCE = ("board_composition", ["주주총회", "이사회 의결 요구", "이사회 결의 요구"])
CHAPTER_TYPE, NO_TYPE = "recitals", "unmapped"
# Characters of a clause that rules look at; an article's header is shorter than this.
LOOK_AT, SHORT_HEADER = 200, 40

# Line patterns.
HEADING = r"^(#{1,4})(?U:\s)+(.+)"
CHAPTER = r"^제(\d+)장(?U:\s)+(.+)"
CHAPTER_START = r"^제\d+장"
ARTICLE = r"^\((.+?)\)"
EXHIBIT = r"^(별지|부록|첨부)[\s.]*(\d*)"
EXHIBIT_START = r"^(별지|부록|첨부)"
TERM = r'"([^"]{2,30})"'
TERM_CURLY = "[\"“]([^“”\"]{2,30})[\"”]"
REFERENCE = r"제(\d+)조"

# Family, subtype, title and English title by what an identifier contains, first match wins.
# {stage} stands for the stage in brackets and a space; without a stage the last two titles hold, where there are any.
FAMILIES = [
    ("sha-separated", "sha", "investor_sha", "{stage}주주간계약서 (분리형)", "{stage}Shareholders Agreement (Separated)", "주주간계약서", "Shareholders Agreement"),
    ("safe-conditional-equity", "safe", "safe_standard", "조건부지분전환계약서", "Conditional Equity Conversion Agreement (SAFE)", None, None),
    ("convertible-bond", "ssa", "convertible_note", "{stage}투자계약서 — 전환사채", "{stage}Investment Agreement — Convertible Bond", "투자계약서 — 전환사채", "Investment Agreement — Convertible Bond"),
    ("bond-with-warrants", "ssa", "convertible_note", "{stage}투자계약서 — 신주인수권부사채", "{stage}Investment Agreement — Bond with Warrants", "투자계약서 — 신주인수권부사채", "Investment Agreement — Bond with Warrants"),
    ("rcps", "ssa", "preferred_share_subscription", "{stage}투자계약서 — 상환전환우선주식 ({form})", "{stage}Investment Agreement — RCPS ({form_en})", None, None),
    ("convertible-preferred", "ssa", "preferred_share_subscription", "{stage}투자계약서 — 전환우선주식 ({form})", "{stage}Investment Agreement — Convertible Preferred ({form})", None, None),
    ("common", "ssa", "common_share_subscription", "{stage}투자계약서 — 보통주식 ({form})", "{stage}Investment Agreement — Common Stock ({form})", None, None),
]
OTHER_FAMILY = ("other", "general")
STAGES = [("early", "초기", "Early-stage"), ("mid", "중기", "Mid-stage"), ("late", "후기", "Late-stage")]
FORMS = ("integrated", ("통합형", "Integrated"), ("분리형", "Separated"))
# What every classified document has.
CONSTANT = {"doc_class": "template", "paper_role": "neutral", "jurisdiction": "KR", "governing_law": "대한민국 법률 (Korean law)", "language": "ko"}
TAGS = ["KVCA-standard", "2023-09-revision", "중소벤처기업부", "벤처투자"]
NOTES, INDUSTRY = "한국벤처캐피탈협회(KVCA)/중소벤처기업부 표준투자계약서 (2023.9 개정)", "venture-capital"

# Fields a manifest must have, and their allowed values and formats.
REQUIRED = ["doc_id", "title", "doc_class", "contract_family", "paper_role", "approval_state", "status", "sha256", "source_file", "created_at"]
DOC_ID, SHA256 = r"^[a-z0-9\-]+\n?$", r"^[a-f0-9]{64}\n?$"
ALLOWED = {
    "doc_class": ["template", "precedent", "playbook", "comment_bank", "review_target"],
    "paper_role": ["house", "counterparty", "neutral", "internal"],
    "approval_state": ["pending", "staging", "approved", "quarantined", "archived"],
    "status": ["active", "deprecated", "superseded", "archived"],
    "authority_level": ["preferred", "acceptable", "fallback", "reference_only"],
    "classification_confidence": ["high", "medium", "low"],
}
# Limits of validation and review.
UNMAPPED_LIMIT, LEAST_CLAUSES, LOSS_LIMIT, MATCH_TARGET, MAPPING_TARGET = 0.3, 5, 0.5, 0.5, 0.9
RISKS = ["critical", "high", "medium", "low", "acceptable"]

# Review modes.
MODES = {
    "strict": {"redline": ["critical", "high", "medium", "low"], "tiers": ["preferred"], "comments": ["critical", "high", "medium", "low"], "tolerance": "minimal", "families": ["spa", "ssa", "sha", "merger", "apa", "joint_venture"]},
    "moderate": {"redline": ["critical", "high"], "tiers": ["preferred", "acceptable"], "comments": ["critical", "high", "medium"], "tolerance": "moderate", "families": ["license", "services", "game_development", "publishing", "content_distribution", "saas", "lease"]},
    "loose": {"redline": ["critical"], "tiers": ["preferred", "acceptable", "fallback"], "comments": ["critical", "high"], "tolerance": "high", "families": ["nda", "mou", "loi", "sow"]},
}
DEFAULT_MODE = "moderate"
MODE_WORDS = [
    ("strict", ["strict", "strictly", "엄격하게", "꼼꼼하게", "철저하게", "빡빡하게", "중요한 딜", "high value"]),
    ("moderate", ["moderate", "balanced", "보통", "일반적으로", "표준"]),
    ("loose", ["loose", "loosely", "quick", "간단하게", "빠르게", "대략적으로", "러프하게", "개략적으로"]),
]
# Leverage and the tier of clause it drafts from.
LEVERAGE = {"strong": "preferred", "balanced": "acceptable", "weak": "fallback"}

# Approval.
ASSET_RULES = [
    ("template", True, [], "preferred", False),
    ("precedent", True, [], "acceptable", False),
    ("playbook", False, ["preferred", "acceptable"], None, False),
    ("comment_bank", False, ["text"], None, False),
]
DECISIONS = {"approve": "approved", "reference_only": "reference-only", "reject": "quarantine", "archive": "archive"}
STAGING_DAYS = 30

# Retrieval.
PRIORITY = [("preferred_template", 1), ("acceptable_template", 2), ("fallback_template", 3), ("approved_precedent", 4), ("reference_only", 5)]
NARROW_ABOVE, WIDEN_BELOW, PENALTY, STALE_DAYS = 50, 3, 1, 365
AFFINITY = [
    ["license", "ip_transfer", "content_distribution"],
    ["publishing", "content_distribution", "game_development"],
    ["spa", "ssa", "sha", "safe", "apa", "merger"],
    ["services", "independent_contractor", "sow"],
    ["mou", "loi"],
    ["tos", "eula", "privacy_policy", "saas"],
]
