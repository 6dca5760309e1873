"""The business vocabulary whose spelling decides results.

Everything in this module is plain data. The matching logic that uses it lives
in the operator modules.
"""

# --- solutions and product groups -------------------------------------------------
# Priority order in which a text is tested against solution synonyms.
SOLUTION_ORDER = ["투명디스플레이", "비디오월", "LED전광판", "사이니지", "키오스크"]

# Partner-side and request-side solution synonyms.
SOLUTION_SYNONYMS = {
    "LED전광판": ["LED전광판", "LED 전광판", "LED Display", "LED 디스플레이", "전광판"],
    "비디오월": ["비디오월", "Video Wall", "video wall", "멀티비전", "멀티비젼"],
    "사이니지": ["사이니지", "디지털사이니지", "디지털 사이니지", "Signage", "DID"],
    "투명디스플레이": ["투명디스플레이", "투명 OLED", "투명LED", "투명 LED"],
    "키오스크": ["키오스크", "KIOSK", "kiosk"],
}

# How well a partner's solution serves a different required solution (0-100).
RELATED_SOLUTIONS = {
    "LED전광판": {"비디오월": 75.0, "사이니지": 60.0, "투명디스플레이": 35.0},
    "비디오월": {"LED전광판": 75.0, "사이니지": 60.0, "투명디스플레이": 35.0},
    "사이니지": {"LED전광판": 65.0, "비디오월": 65.0, "투명디스플레이": 50.0, "키오스크": 45.0},
    "투명디스플레이": {"사이니지": 55.0, "LED전광판": 45.0, "비디오월": 35.0},
    "키오스크": {"사이니지": 50.0},
}

UNCATEGORIZED_GROUP = "미분류"
GENERIC_GROUP = "디스플레이"
GROUP_ORDER = SOLUTION_ORDER
PRIMARY_GROUP_ORDER = ["비디오월", "LED전광판", "디스플레이"]

GROUP_SYNONYMS = {
    "LED전광판": [
        "LED전광판", "LED 전광판", "전광판", "LED Display", "LED 디스플레이", "LED Screen", "실내용 LED",
    ],
    "비디오월": [
        "비디오월", "Video Wall", "멀티비전", "멀티비젼",
        "46인치 비디오월", "49인치 비디오월", "55인치 비디오월",
    ],
    "사이니지": ["사이니지", "디지털사이니지", "디지털 사이니지", "Signage"],
    "투명디스플레이": ["투명디스플레이", "투명 OLED", "투명LED"],
    "키오스크": ["키오스크", "KIOSK"],
}
VIDEO_WALL_TOKENS = [
    "비디오월", "videowall", "multiwall", "lcdwall", "멀티비전", "멀티디스플레이",
    "3x3", "3×3", "2x2", "2×2", "4x4", "4×4",
]
LED_TOKENS = [
    "led전광판", "전광판", "leddisplay", "ledscreen", "led모듈", "led디스플레이", "pixelpitch",
]
LED_PITCH_PATTERN = r"\bp\d+(?:\.\d+)?\b"
GENERIC_DISPLAY_TOKENS = [
    "디스플레이", "display", "DID", "전자칠판", "프로젝터", "모니터", "회의실모니터", "displayhardware",
]

# --- ranking ----------------------------------------------------------------------
QUOTE_WEIGHTS = {"spec": 0.30, "price": 0.30, "delivery": 0.20, "warranty": 0.10, "installation": 0.10}
PARTNER_WEIGHTS = {
    "semantic": 0.35, "specialty": 0.35, "installation": 0.10,
    "success": 0.10, "premium": 0.05, "stability": 0.05,
}
SPEED_ORDINAL = {"fast": 3, "normal": 2, "slow": 1}
FINANCE_ORDINAL = {"good": 3, "normal": 2, "caution": 1, "bad": 0}
# The stored tables spell the same levels in Korean.
SPEED_KOREAN = {"빠름": 3, "보통": 2, "느림": 1}
FINANCE_KOREAN = {"양호": 3, "보통": 2, "주의": 1, "위험": 0}
SPEED_SNAPSHOT_SCORE = {"fast": 100.0, "normal": 70.0, "slow": 40.0}
INSTALL_CONFLICT_TOKENS = [
    "설치비:미포함", "설치비미포함", "설치비:별도", "설치비별도", "시공비별도",
]

MSG_NO_REQUEST_VECTOR = "요구사항 임베딩 없음"
MSG_NO_QUOTE_VECTOR = "견적서 임베딩 없음"
MSG_SPEC_FAILED = "스펙 유사도 계산 실패"
MSG_NO_PRICE = "가격 비교 정보 부족"
MSG_OVER_BUDGET = "예산 초과"
MSG_SCHEDULE_UNCLEAR = "요구 납기 정규화 필요"
MSG_DELIVERY_TALK = "납기 별도협의"
MSG_NO_DELIVERY = "견적 납기 미기재"
MSG_NO_WARRANTY = "보증기간 미기재"
MSG_INSTALL_CONFLICT = "설치비 포함 여부 문서 내 상충 확인 필요"
MSG_INSTALL_SEPARATE = "설치비 별도"
MSG_INSTALL_UNCLEAR = "설치 범위 확인 필요"
MSG_PRICE_GAP_RISK = "최저가 대비 가격 차이 5% 초과"
MSG_PRICE_GAP_RULE = "가격 차이 5% 초과"
MSG_PARTNER_UNKNOWN = "파트너 마스터 미등록"
MSG_PARTNER_EXCLUDED_QUOTE = "제외 파트너 견적서"
MSG_PARTNER_EXCLUDED = "제외 파트너"
MSG_PARTNER_NO_VECTOR = "파트너 임베딩 없음"
MSG_SNAPSHOT_MISSING = "파트너 마스터 매칭 필요"
MSG_RANK_MISMATCH = (
    "동일한 업무 룰 통과 그룹 내에서 후순위 후보의 종합 점수가 더 높아 추천 순위 검증이 필요합니다."
)
SCORE_TIE_EPSILON = 0.01

MSG_GROUP_UNDECIDED = "비교 제품군을 자동 결정할 수 없음"
MSG_GROUP_UNKNOWN = "비교 제품군 정보가 없습니다."
MSG_SCOPE_SPLIT = "동일 PDF 내 복수 제품군 옵션 중 비교 scope와 다른 제품군"
MSG_SCOPE_OTHER_QUOTES = "다른 업로드 견적서의 주요 제품군과 불일치"
MSG_SCOPE_REQUEST = "고객 요구사항의 비교 제품군과 불일치"

# --- line categories --------------------------------------------------------------
CATEGORIES = ["DISPLAY", "MOUNT", "CABLE", "PLAYER", "SOFTWARE", "INSTALL", "ETC"]

# Re-classification by the item name with all spaces removed, in priority order.
ACCESSORY_TOKENS = ["예비품", "smps", "수신카드"]
OVERHEAD_TOKENS = ["기타경비", "기타비용", "관리비"]
INSTALL_EVIDENCE = ["설치", "시운전", "시공"]
COMPACT_NAME_RULES = [
    (["설치", "시공", "시운전"], "INSTALL", "INSTALL", "item_name functional install keyword"),
    (["세팅"], "SOFTWARE", "SOFTWARE", "item_name functional software keyword"),
    (["운영pc", "제어pc", "프로세서", "controller", "vx400pro"], "PLAYER", "SYSTEM_EQUIPMENT",
     "item_name functional system equipment keyword"),
    (["설치", "시공", "장비설치", "비디오월설치", "전광판장비설치", "system설치", "시운전", "인수인계", "현장설치", "제품설치비"],
     "INSTALL", "INSTALL", "item_name functional install keyword"),
    (["cms", "소프트웨어", "세팅", "콘텐츠제어", "스케줄", "해상도맞춤"], "SOFTWARE", "SOFTWARE",
     "item_name functional software keyword"),
    (["controller", "컨트롤러", "프로세서", "novastar", "colorlight", "vx400pro", "운영pc", "제어pc", "플레이어pc"],
     "PLAYER", "SYSTEM_EQUIPMENT", "item_name functional system equipment keyword"),
    (["브라켓", "bracket", "구조물", "wall_basement", "베이스"], "MOUNT", "MATERIALS", "item_name functional mount keyword"),
    (["잡자재", "케이블", "배관", "배선"], "CABLE", "MATERIALS", "item_name functional material keyword"),
    (["배송비", "화물운임", "운송", "출장", "체류비"], "ETC", "TRAVEL", "item_name functional travel keyword"),
    (["유지보수", "유지관리"], "ETC", "ETC", "item_name functional maintenance keyword"),
]
# By the lower-cased item name.
NAME_RULES = [
    (["설치비", "설치 외", "제품 설치비", "system 설치", "시운전"], "INSTALL", "INSTALL"),
    (["배송비", "화물운임", "출장", "체류비", "운송비용"], "ETC", "TRAVEL"),
    (["cms", "콘텐츠제어", "스케줄", "소프트웨어"], "SOFTWARE", "SOFTWARE"),
    (["controller", "컨트롤러", "vx400pro", "novastar", "플레이어 pc", "운영pc", "제어 pc", "제어pc", "프로세서", "processor"],
     "PLAYER", "SYSTEM_EQUIPMENT"),
    (["유지보수"], "ETC", "ETC"),
    (["브라켓", "bracket", "wall_basement", "구조물", "베이스", "steel pipe"], "MOUNT", "MATERIALS"),
    (["led screen", "led display", "led cabinet", "led 디스플레이", "비디오월", "video wall", "패널", "dled-c"], "DISPLAY", "DISPLAY"),
]
NAME_RULE_REASON = "item_name priority keyword"
KEEP_DISPLAY_REASON = "preserve existing display classification"
# By the lower-cased item name and specification together.
BRACKET_MODELS = ["dp-49br", "dp-55br", "dp-49 br", "dp-55 br"]
TEXT_RULES = [
    (["설치비", "설치 외", "제품 설치비", "system 설치", "시운전", "현장 설치"], "INSTALL", "INSTALL", "installation keyword"),
    (BRACKET_MODELS, "MOUNT", "MATERIALS", "mount/material keyword"),
    (["설치비", "설치", "시공", "system 설치", "시운전", "자재 운반", "인수인계", "현장설치"], "INSTALL", "INSTALL", "installation keyword"),
    (["출장", "체류비", "배송비", "화물운임", "운임", "교통", "숙박"], "ETC", "TRAVEL", "travel keyword"),
    (["cms", "콘텐츠제어", "스케줄", "소프트웨어", "라이선스", "license"], "SOFTWARE", "SOFTWARE", "software keyword"),
    (["플레이어 pc", "운영pc", "운영 pc", "제어 pc", "제어pc", " pc", "ds-dt", "led용 제어 pc", "vx400pro", "controller",
      "컨트롤러", "프로세서", "scaler", "player", "all-in-one", "colorlight", "novastar"],
     "PLAYER", "SYSTEM_EQUIPMENT", "player/controller keyword"),
    (["브라켓", "bracket", "wall_basement", "베이스", "steel pipe", "마운트", "거치대", "벽부형", "제작형", "구조물"],
     "MOUNT", "MATERIALS", "mount/material keyword"),
    (["케이블", "잡자재", "기타 잡자재", "자재비", "부자재", "예비품", "smps", "수신카드"], "CABLE", "MATERIALS", "cable/material keyword"),
    (["led display", "led전광판", "led 전광판", "video wall", "비디오월", "lcd video wall", "did", "패널", "vw550r", "lh46",
      "lh55", "dp550", "dp-49", "dp-55", "49vl", "55inch", "dled-c", "model : ds-d4015cw", "ds-d4015cw", "모듈 본체",
      "디지털 사이니지", "led screen", "led cabinet", "led 디스플레이"], "DISPLAY", "DISPLAY", "display keyword"),
    (["캐비닛 및 모듈", "모듈 면 평탄화"], "INSTALL", "INSTALL", "installation keyword"),
    (["관리비", "기업이윤"], "ETC", "ETC", "etc keyword"),
    (["전광판"], "DISPLAY", "DISPLAY", "display keyword"),
]

# --- cost buckets -----------------------------------------------------------------
BUCKETS = ["display_hw", "system_equipment", "installation", "materials", "travel_expense", "etc", "software", "content"]
BUCKET_NAME_FIRST = [
    (["설치", "설치비", "시운전"], "installation"),
    (["브라켓", "잡자재", "케이블", "마운트"], "materials"),
]
BUCKET_COMPACT_NAME = [
    (["설치", "설치비", "시운전"], "installation"),
    (["브라켓", "잡자재", "케이블", "마운트"], "materials"),
    (["설치", "시공", "장비설치", "비디오월설치", "전광판장비설치", "system설치", "시운전", "인수인계"], "installation"),
    (["배송비", "화물운임", "운송", "출장", "체류비"], "travel_expense"),
    (["cms", "소프트웨어", "세팅", "콘텐츠제어", "스케줄", "해상도맞춤"], "software"),
    (["controller", "컨트롤러", "프로세서", "novastar", "colorlight", "vx400pro", "운영pc", "제어pc", "플레이어pc"], "system_equipment"),
    (["브라켓", "bracket", "구조물", "wall_basement", "베이스", "잡자재", "케이블", "배관", "배선"], "materials"),
]
COST_TYPE_BUCKET = {
    "DISPLAY": "display_hw", "TRAVEL": "travel_expense", "SOFTWARE": "software",
    "SYSTEM_EQUIPMENT": "system_equipment", "MATERIALS": "materials",
}
BUCKET_SPARE = ["예비품", "smps", "수신카드", "spare"]
BUCKET_TEXT = [
    (None, ["출장", "운임", "화물운임", "배송비", "체류", "체류비", "교통", "숙박"], "travel_expense"),
    (["PLAYER"], ["processor", "controller", "scaler", "player", "송출", "제어기", "프로세서"], "system_equipment"),
    (["INSTALL"], ["설치", "시공", "시운전", "인수인계", "운반"], "installation"),
    (["CABLE", "MOUNT"], ["케이블", "브라켓", "잡자재", "마운트", "거치대", "스틸", "보강대"], "materials"),
    (["SOFTWARE"], ["software", "소프트웨어", "license", "라이선스", "cms"], "software"),
    (None, ["콘텐츠", "content", "디자인", "영상제작"], "content"),
]
SEPARATE_MARKERS = ["별도", "미포함", "제외", "미지원", "not included", "excluded", "separate"]
SEPARATE_BUCKET_TOKENS = {
    "installation": ["설치", "시공"],
    "travel_expense": ["출장", "운임", "화물운임", "배송비", "체류", "체류비", "교통", "숙박"],
    "software": ["소프트웨어", "라이선스", "cms"],
    "content": ["콘텐츠", "디자인", "영상"],
}
SOFTWARE_EXCLUSION_PATTERNS = [
    r"(?i)((?:소\s*프\s*트\s*웨\s*어|운영\s*PC|CMS|S/W|software)[^.\n|]{0,60}(?:미포함|별도\s*옵션|별도|제외|미지원|not included|excluded))",
    r"(?i)((?:미포함|별도\s*옵션|별도|제외|미지원|not included|excluded)[^.\n|]{0,40}(?:소\s*프\s*트\s*웨\s*어|운영\s*PC|CMS|S/W|software))",
]

# --- validation -------------------------------------------------------------------
SUMMARY_ROW_KEYWORDS = [
    "subtotal", "sub total", "supply total", "vat", "tax", "total", "grand total", "amount total",
    "합계", "소계", "총계", "부가세",
]
SPEC_KEYWORD_PATTERN = (
    r"(?i)(?:fhd|uhd|4k|8k|cd|nit|mm|kg|kw|w\b|"
    r"해상도|화면\s*사이즈|화면사이즈|소비전력|밝기|베젤|bezel|무게|중량|"
    r"resolution|brightness|screen\s*size|power|weight)"
)
DELIVERY_DISCUSSION_PATTERN = r"별도\s*협의|별도협의|추후\s*협의|추후협의|협의"
DELIVERY_DAY_PATTERN = r"(\d{1,3})\s*(?:일|days?|day)"
DELIVERY_WEEK_PATTERN = r"(\d{1,2})\s*(?:주|weeks?|week)"
DELIVERY_LINE_TOKENS = ["납기", "Delivery", "delivery", "발주", "계약 후"]
INSTALL_KEYWORDS = [
    "설치", "시공", "system 설치", "시운전", "장비 설치", "제품 설치비", "비디오월 설치", "전광판 장비 설치", "인수인계",
]
MSG_LINE_ARITHMETIC = "일부 품목의 수량×단가와 금액이 일치하지 않아 확인 필요"
MSG_NAME_SPEC_SPLIT = "item_name/spec_raw 분리 확인 필요"
MSG_LINES_MISMATCH = "line_items 합계와 공급가가 일치하지 않아 금액 확인 필요"
MSG_DELIVERY_REVIEW = "납기 원문은 있으나 주 단위 변환 확인 필요"
MSG_DELIVERY_MISSING = "납기 정보 미기재"
MSG_RESIDUAL = "일부 금액이 개별 품목으로 복원되지 않아 확인 필요"
MSG_MULTI_OPTION = "문서 내 복수 옵션 견적 확인 필요"
OVERHEAD_NAMES = ["관리비", "관리비 및 기업이윤", "기타관리비"]

# --- comparison notes that stay internal -------------------------------------------
INTERNAL_NOTE_PATTERNS = [
    "요구 납기 정규화 필요", "납기 정보 미기재", "납기 정규화", "요구사항", "파싱", "parser", "fallback",
    "quote_date_missing", "spec_sanitized", "display_resolution_missing", "display_screen_size_missing",
]
