"""Fixed values of triage and repair: groups of issue codes, title ladders and notes."""

# Issue codes per triage group.
TRIAGE_GROUPS = {
    "stage2_sync": ["stage2_stale", "stage2_missing", "stage2_unreadable"],
    "role_mismatch": ["data_engineering_as_ai_role", "data_engineering_ai_title_review", "business_focus_in_ai_role",
                      "business_role_as_ai_role", "deeptech_as_analyst", "clinical_scientist_as_analyst"],
    "signal_extraction": ["missing_keywords", "missing_focus", "missing_group_summary", "noise_keyword", "duplicate_signal"],
    "non_blocking_context": ["business_context_in_ai_role", "summary_too_short", "role_diff", "focus_diff",
                             "keywords_diff", "summary_diff"],
}

# The repair step counts one more code as a role mismatch than triage does.
REPAIR_ROLE_CODES = ["analytics_engineering_as_ai_role", "data_engineering_as_ai_role", "data_engineering_ai_title_review",
                     "business_focus_in_ai_role", "business_role_as_ai_role", "deeptech_as_analyst",
                     "clinical_scientist_as_analyst"]

# Fixed values: (title pattern, text pattern, role, confidence, reason); the first rule that holds decides.
_DATA_TITLE = r"data\s+engineer|data\s+platform|data\s+service|데이터\s*엔지니어|데이터\s*플랫폼"
ROLE_RULES = [
    (r"clinical\s+research\s+scientist|임상\s*연구|data\s+science|data\s+scientist|ds\(data science\)", None,
     "데이터 사이언티스트", "high", "임상/데이터 과학 제목 신호"),
    (r"data\s+analytics\s+engineer|analytics\s+engineer|data\s+analyst|bi\s*/?\s*dw|business intelligence|product analyst"
     r"|growth|crm|cx|pmo|marketing|데이터\s*분석가|제품\s*분석", None, "데이터 분석가", "high", "분석가/BI/Growth 계열 제목 신호"),
    (r"researcher|research scientist|ai\s*research|ml\s*research|리서처|연구원",
     r"\bai\b|\bml\b|\bllm\b|\bvlm\b|인공지능|머신러닝|딥러닝|컴퓨터\s*비전", "인공지능 리서처", "medium", "AI 연구자 제목 신호"),
    (r"robotics|로보틱스|isaac|ros|ai|ml|llm|model serving|computer vision|컴퓨터\s*비전", None,
     "인공지능 엔지니어", "medium", "AI/딥테크 엔지니어링 제목 신호"),
    (_DATA_TITLE, r"bi|대시보드|지표|데이터\s*마트|웨어\s*하우스|웨어하우스|\bdw\b|analytics",
     "데이터 분석가", "medium", "BI/데이터마트 중심 데이터 엔지니어링"),
    (_DATA_TITLE, r"\bai\b|\bml\b|\bllm\b|mlops|벡터|모델|인공지능",
     "인공지능 엔지니어", "medium", "AI/ML 시스템과 연결된 데이터 엔지니어링"),
    (_DATA_TITLE, None, "데이터 분석가", "low", "순수 데이터 엔지니어링은 별도 직군이 없어 검수 필요"),
]
ROLE_KEPT = "현재 직군 유지 후보"

# Fixed values: (roles, only the title?, pattern, focus, reason), tried before the general focus rules.
_AI = ["인공지능 엔지니어", "인공지능 리서처"]
FOCUS_BY_ROLE = [
    (["데이터 분석가"], True, r"analytics|bi\s*/?\s*dw|business intelligence|data analyst|product analyst|growth|crm|cx|pmo|marketing|분석가",
     "BI / 지표분석", "데이터 분석가 제목 기반 초점"),
    (["데이터 분석가"], False, r"데이터\s*마트|웨어\s*하우스|웨어하우스|\bdw\b|etl|이티엘|data\s+platform|data\s+engineer|데이터\s*엔지니어|데이터\s*플랫폼",
     "데이터플랫폼 / ETL", "데이터 엔지니어링 제목 기반 초점"),
    (["데이터 사이언티스트"], False, r"임상|의료|헬스케어|심전도|생체신호", "헬스케어 / 의료데이터", "데이터 과학 의료 도메인 초점"),
    (["데이터 사이언티스트"], False, r"", "실험설계 / 모델링", "데이터 과학 역할 기반 초점"),
    (_AI, True, r"ai\s*platform|AI\s*플랫폼|ai\s*devops|devops/ai", "AI플랫폼 / MLOps", "AI 플랫폼 제목 기반 초점"),
    (_AI, True, r"\bllm\b|엘엘엠", "LLM / RAG", "LLM 제목 기반 초점"),
    (_AI, True, r"model\s*serving|모델\s*서빙", "모델서빙 / 인프라", "모델 서빙 제목 기반 초점"),
    (_AI, True, r"ml\s*research|machine learning|머신러닝", "모델링 / 최적화", "ML 제목 기반 초점"),
]
FOCUS_KEPT, FOCUS_NONE = "현재 직무초점 유지", "초점 후보 부족"
KEYWORDS_KEPT, KEYWORDS_FOUND = "현재 핵심기술 유지", "본문/필드에서 기술 키워드 추출"
SUMMARY_BUILT, SUMMARY_KEPT, SUMMARY_NONE = "경력/트랙/초점 조합", "현재 구분요약 유지", "구분요약 후보 부족"
RESYNC_NOTE = "1차 변경해시 기준으로 2차 후보를 다시 맞춰야 합니다."
APPLIED_SUMMARY, APPROVED_MARK, CHECKED_SUMMARY = "2차 검증 반영 완료", "승인", "검수완료"

# Issue messages; %s takes the offending value.
MESSAGES = {
    "missing_job_id": "공고키가 비어 있습니다.",
    "missing_change_hash": "변경해시가 비어 있어 증분 stale 판정을 할 수 없습니다.",
    "invalid_role": "분류직무가 허용 직군이 아닙니다: ",
    "missing_focus": "직무초점_표시가 비어 있습니다.",
    "missing_group_summary": "구분요약_표시가 비어 있습니다.",
    "missing_keywords": "핵심기술_표시가 비어 있습니다.",
    "noise_keyword": "키워드/초점에 비직무성 표현이 포함됩니다: ",
    "duplicate_signal": "직무초점과 핵심기술 간 중복 신호가 있습니다.",
    "clinical_scientist_as_analyst": "임상/clinical research scientist 신호가 데이터 분석가로 분류되었습니다.",
    "deeptech_as_analyst": "로보틱스/비전/LLM 등 딥테크 신호가 데이터 분석가에 섞였습니다.",
    "analytics_engineering_as_ai_role": "Data Analytics/BI/Analyst 제목이 AI 직군으로 분류되었습니다.",
    "data_engineering_as_ai_role": "Data Engineer/Analytics Engineer/Data Platform 제목이 AI 직군으로 분류되었습니다.",
    "data_engineering_ai_title_context": "AI/딥테크 앵커가 있는 데이터 엔지니어링 제목입니다.",
    "data_engineering_ai_context": "AI/ML/MLOps 신호가 지배적인 데이터 엔지니어링 제목입니다.",
    "business_role_as_ai_role": "CRM/CX/PMO/Growth/제품분석 신호가 제목·초점에서 지배적인데 AI 직군으로 분류되었습니다.",
    "business_focus_in_ai_role": "AI 직군 안에서 비즈니스 분석형 초점이 지배적으로 붙어 직무초점 재검증이 필요합니다.",
    "business_context_in_ai_role": "AI 직군 상세본문에 비즈니스/지표/대시보드 문맥이 있으나 지배 신호는 아닙니다.",
    "summary_too_short": "구분요약이 지나치게 짧습니다.",
}
DIFF_LABELS = [("role", "분류직무"), ("focus", "직무초점"), ("keywords", "핵심기술"), ("summary", "구분요약")]
