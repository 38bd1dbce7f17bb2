"""Fixed values that results depend on: thresholds, code tables, messages and patterns."""

# Physical bounds per field: (low, high)
PHYSICAL_BOUNDS = {
    "water_temp": (-2.0, 35.0),
    "dissolved_oxygen": (0.0, 20.0),
    "din": (0.0, 1500.0),
    "dip": (0.0, 200.0),
    "np_ratio": (0.0, 200.0),
    "salinity": (0.0, 45.0),
    "chlorophyll_a": (0.0, 200.0),
    "turbidity": (0.0, 500.0),
    "ph": (4.0, 10.0),
}

# Domain thresholds per field: (caution, danger, risky side)
DOMAIN_THRESHOLDS = {
    "din": (100.0, 70.0, "low"),
    "dip": (16.0, 6.0, "low"),
    "water_temp": (22.0, 25.0, "high"),
    "np_ratio": (16.0, 6.0, "low"),
    "dissolved_oxygen": (6.0, 4.0, "low"),
}

# Atomic masses for microgram -> micromole
N_ATOMIC = 14.007
P_ATOMIC = 30.974

# Risk-index weights
RISK_WEIGHTS = {"din": 0.38, "water_temp": 0.27, "np_ratio": 0.19, "dissolved_oxygen": 0.10, "salinity": 0.06}

# Cause thresholds and the features where a low value is the risk
CAUSE_THRESHOLDS_5 = {"din": 5.0, "water_temp": 25.0, "np_ratio": 10.0, "dissolved_oxygen": 5.0, "salinity": 30.0}
LOW_IS_RISK_5 = ("din", "dissolved_oxygen", "salinity", "np_ratio")
CAUSE_THRESHOLDS_8 = {
    "water_temp": 25.0,
    "dissolved_oxygen": 5.0,
    "din": 5.0,
    "dip": 0.3,
    "np_ratio": 16.0,
    "salinity": 30.0,
    "precipitation": 20.0,
    "chlorophyll_a": 5.0,
}
LOW_IS_RISK_8 = ("din", "dissolved_oxygen", "salinity")

# Model feature scaling: feature -> (default, centre, scale)
FEATURE_SCALING = {
    "water_temp": (15.0, 15.0, 5.0),
    "dissolved_oxygen": (8.0, 8.0, 2.0),
    "din": (5.0, 5.0, 5.0),
    "dip": (0.5, 0.5, 0.3),
    "np_ratio": (16.0, 16.0, 8.0),
    "salinity": (32.0, 32.0, 2.0),
    "precipitation": (0.0, 0.0, 10.0),
    "chlorophyll_a": (3.0, 3.0, 2.0),
}

# Months outside the harvest season
OFF_SEASON_MONTHS = (6, 7, 8, 9, 10)
NO_GROWTH_MONTHS = (6, 7, 8)
SEEDING_MONTHS = (9, 10)

# Recorded bleaching events: (start, end, regions)
BLEACHING_EVENTS = [
    ("2010-10-01", "2011-03-31", "서천, 해남, 완도"),
    ("2016-11-01", "2017-02-28", "서천, 군산"),
    ("2017-11-01", "2018-02-28", "서천, 군산"),
    ("2022-01-01", "2022-02-28", "해남, 서천"),
    ("2023-11-01", "2024-02-29", "서천, 충남전역"),
    ("2025-11-01", "2026-01-31", "고흥, 군산, 서천"),
]
EVENT_BUFFER_DAYS = 14
PRE_EVENT_BUFFER_DAYS = 14
POST_EVENT_BUFFER_DAYS = 21
WATCH_END_WEEKS = 4
ACTIVE_END_WEEKS = 10

# Chlorophyll cut points inside an event
CHL_SEVERE, CHL_ACTIVE, CHL_WATCH = 2.0, 2.7, 3.8

# Deficit index
DIN_DEFICIT_UGL = 70.0
ADI_CEILING = 10.0
ADI_DECAY = 0.2
ADI_STAGES = (1.0, 5.0, 8.0)
DEFAULT_DAY_SST = 12.0

# Satellite quality flag bits that disqualify a pixel:
# land, cloud, cloud shadow, saturation, cloud/ice, thin cloud
BAD_PIXEL_MASK = 0x001 | 0x002 | 0x004 | 0x020 | 0x100 | 0x200
WATER_CLASS = 6
# OC3 polynomial in log10 band ratio, constant term first
OC3_COEFFICIENTS = (0.2424, -2.7423, 1.8017, 0.0015, -1.2280)

# Estuary reference point (lat, lon)
ESTUARY = (36.02, 126.83)

# Wind compass text -> degrees
WIND_DEGREES = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5,
    "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5,
    "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
    "북": 0.0, "북북동": 22.5, "북동": 45.0, "동북동": 67.5,
    "동": 90.0, "동남동": 112.5, "남동": 135.0, "남남동": 157.5,
    "남": 180.0, "남남서": 202.5, "남서": 225.0, "서남서": 247.5,
    "서": 270.0, "서북서": 292.5, "북서": 315.0, "북북서": 337.5,
}

# The 32 cube channels in order
CHANNELS = [
    "sst", "din", "dip", "sio2", "np_ratio", "salinity", "precipitation", "solar_radiation",
    "chlorophyll_a", "dissolved_oxygen", "current_u", "current_v", "sst_anomaly", "sst_7d_avg",
    "days_since_rain", "turbidity", "wind_speed", "wind_dir_sin", "wind_dir_cos", "air_temp",
    "ph", "no3_nitrogen", "nh4_nitrogen", "sst_gradient", "nir_idx", "month_sin", "month_cos",
    "current_speed", "chl_7d_avg", "nir_7d_avg", "sst_30d_avg", "mld",
]

# Scenario presets: name -> factor values
PRESETS = [
    ("정상", 18.0, 9.0, 0.6, 33.0, 9.0),
    ("주의", 23.0, 4.5, 0.5, 32.0, 7.0),
    ("경고", 26.0, 2.5, 0.5, 30.5, 5.5),
    ("위험", 29.5, 0.8, 0.45, 28.5, 3.5),
]
# Sweep ranges per factor: (min, max)
SWEEP_RANGES = {
    "water_temp": (5.0, 35.0),
    "din": (0.0, 15.0),
    "dip": (0.1, 1.5),
    "salinity": (26.0, 35.0),
    "dissolved_oxygen": (2.0, 12.0),
}

# Pack serving
SUSTAINED_WARN, WATCH_WARN = 0.5, 0.2
PACK_STAGE_LABELS = {0: "정상", 1: "초기", 2: "경계", 3: "심각"}
RISK_LABELS = {"sustained": "고위험", "watch": "주의", "normal": "정상"}
NO_COVERAGE_LABEL = "예측 판별 불가"
RISK_CODES = {"sustained": "2", "watch": "1", "normal": "0"}

# Report texts
STAGE_DESCRIPTIONS = {
    0: "현재 양식장은 정상 상태입니다. 황백화 위험이 낮습니다.",
    1: "황백화 초기 징후가 감지되었습니다. 주의 관찰이 필요합니다.",
    2: "황백화 경계 단계입니다. 조기 대응 조치를 검토하세요.",
    3: "황백화가 진행 중입니다. 즉각적인 대응이 필요합니다.",
    4: "황백화 심각 단계입니다. 긴급 조치를 취하십시오.",
}
FEATURE_DISPLAY = {
    "water_temp": "수온",
    "dissolved_oxygen": "용존산소(DO)",
    "din": "용존무기질소(DIN)",
    "dip": "용존무기인(DIP)",
    "np_ratio": "N:P 비율",
    "salinity": "염분",
    "precipitation": "강수량(3일)",
    "chlorophyll_a": "클로로필-a",
}
STAGE_ACTIONS = [
    (2, "즉시 양식장 현장 육안 점검을 실시하세요."),
    (3, "지역 어업기술센터 또는 국립수산과학원에 연락하세요."),
    (4, "수확 시기 조정 및 추가 피해 확산 방지 조치를 취하세요."),
]
DEFAULT_ACTION = "현재 상태를 유지하며 정기 모니터링을 계속하세요."
CAUSE_ADVICE = [
    ("din", "BELOW_THRESHOLD", "DIN(용존무기질소)이 임계치 이하입니다. 질소 부족으로 황백화가 악화될 수 있습니다."),
    ("din", "ABOVE_THRESHOLD", "DIN이 높습니다. 육상 오염원 유입 가능성을 확인하세요."),
    ("water_temp", "ABOVE_THRESHOLD", "수온이 임계치를 초과했습니다. 고온 스트레스로 인한 황백화 위험이 높습니다."),
    ("water_temp", "BELOW_THRESHOLD", "수온은 정상 범위입니다."),
    ("np_ratio", "BELOW_THRESHOLD", "N:P 비가 낮습니다(질소 상대적 부족). 황백화 유발 가능성이 있습니다."),
    ("np_ratio", "ABOVE_THRESHOLD", "N:P 비가 높습니다. 인산염 부족 상태를 모니터링하세요."),
    ("dissolved_oxygen", "BELOW_THRESHOLD", "DO가 낮습니다. 산소 부족으로 생리 장애가 발생할 수 있습니다."),
    ("dissolved_oxygen", "ABOVE_THRESHOLD", "DO는 정상 이상입니다."),
    ("salinity", "BELOW_THRESHOLD", "염분이 낮습니다. 강우 유출수 유입 가능성이 있습니다."),
    ("salinity", "ABOVE_THRESHOLD", "염분이 높습니다. 증발·환류 영향을 확인하세요."),
    ("precipitation", "ABOVE_THRESHOLD", "최근 3일 강수량이 많습니다. 육상 오염 유입 및 영양염 변동을 주시하세요."),
    ("precipitation", "BELOW_THRESHOLD", "강수량 영향은 낮습니다."),
    ("chlorophyll_a", "ABOVE_THRESHOLD", "클로로필-a 농도가 높습니다. 식물플랑크톤 번성으로 DIN 고갈 가능성이 있습니다."),
    ("chlorophyll_a", "BELOW_THRESHOLD", "클로로필-a는 정상 범위입니다."),
    ("dip", "BELOW_THRESHOLD", "DIP(인산염)이 낮습니다. 인 부족 상태입니다."),
    ("dip", "ABOVE_THRESHOLD", "DIP가 높습니다."),
]

# Privacy policy
BLOCKED_REQUEST_TYPES = ("raw_sensor", "personal_info", "farm_pii")
PII_FIELDS = (
    "owner_name", "owner_phone", "owner_email", "ip_address",
    "exact_geom", "address", "account_no", "registration_no",
)
AGGREGATE_FIELDS = (
    "water_temp", "dissolved_oxygen", "din", "dip", "np_ratio", "salinity", "wbi_score", "severity",
    "anomaly_score", "severity_pct", "farm_id", "observed_at", "predicted_at", "stage",
    "chlorophyll_a", "precipitation", "top_causes", "attention_map_json", "model_version",
)
PHONE_PATTERN = r"010[-\s]?\d{4}[-\s]?\d{4}"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
COORD_PATTERN = r"\d{2,3}\.\d{5,}"

# Requests per 60 s
RATE_LIMITS = {"/rag/query": 20, "/predict": 60, "/explain": 30}
DEFAULT_RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60

# Document chunking
MAX_CHUNK_CHARS = 1200
MIN_CHUNK_CHARS = 40
NO_DOCUMENTS_PROMPT = "(문서 검색 결과 없음 — 참고 문서 없이 일반 지식 범위에서만 답변하고, 불확실하면 모른다고 답할 것)"
PROMPT_CLOSING = "위 참고 문서와 센서 상태를 바탕으로 질문에 답변해주세요."
NO_DOCUMENTS_ANSWER = "관련 정보를 찾지 못했습니다. 국립수산과학원 서해수산연구소 누리집을 참고하세요."
ANSWER_CLOSING = "더 자세한 내용은 국립수산과학원 또는 KOEM 해양환경측정망을 참고하세요."

# Region names outside the model grid

# Places where the item list of a landed payload may sit, tried in this order
ITEM_PATHS = (
    "$.body.item", "$.Body.item", "$.Item", "$.response.body.items.item", "$.getOceansNemo.item", "$.item", "$.content",
)

# Fixed texts of reports, alerts, prompts and answers
UNKNOWN_FEATURE = "알 수 없음"
UNKNOWN_STAGE = "상태를 확인하세요."
REPORT_SCORE = " 황백화 지수: "
REPORT_CAUSE = "%. 주요 원인 변수는 '"
REPORT_END = "'입니다."
ALERT_DIN = "DIN "
ALERT_DIN_END = " μmol/L (임계값 이하)"
ALERT_TEMP = "수온 "
ALERT_TEMP_END = "℃ (25℃ 초과)"
ALERT_OTHER = "황백화 "
CONTEXT_SCORE = "황백화지수="
CONTEXT_STAGE = ", 단계="
DOCUMENT_LEAD = "[참고 "
SOURCE_LEAD = " (출처: "
SENSORS_HEAD = "\n\n[현재 양식장 센서 상태]\n"
DOCUMENTS_HEAD = "\n\n[참고 문서]\n"
QUESTION_HEAD = "\n\n[질문]\n"
