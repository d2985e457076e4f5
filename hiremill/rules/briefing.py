"""Fixed values of posting normalisation and briefing: names, aliases and labels whose wording is the result."""

# Columns of a source row, in the order they are tried.
SOURCE_FIELDS = {
    "id": ["공고키", "job_key", "postingId", "jobId", "id"],
    "change_hash": ["변경해시", "change_hash", "sourceHash", "hash"],
    "company": ["회사명_표시", "회사명", "company_name"],
    "company_tier": ["기업층", "company_tier"],
    "source": ["소스명_표시", "소스명", "source_name"],
    "title": ["공고제목_표시", "공고제목_raw", "job_title_raw"],
    "experience": ["경력수준_표시", "경력수준_raw", "experience_level_raw"],
    "track": ["채용트랙_표시"],
    "focus": ["직무초점_표시"],
    "role": ["분류직무", "job_role", "직무명_표시"],
    "role_display": ["직무명_표시", "분류직무", "job_role"],
    "group_summary": ["구분요약_표시"],
    "detail_body": ["상세본문_분석용"],
    "record_state": ["레코드상태", "record_status"],
    "active_text": ["활성여부", "is_active"],
    "job_url": ["공고URL", "job_url"],
    "source_url": ["소스URL", "source_url"],
    "snapshot_date": ["스냅샷일자", "snapshot_date"],
    "first_seen_at": ["최초발견시각", "first_seen_at"],
    "last_seen_at": ["최종발견시각", "last_seen_at"],
    "tasks_text": ["주요업무_표시", "주요업무_분석용"],
    "requirements_text": ["자격요건_표시", "자격요건_분석용"],
    "preferred_text": ["우대사항_표시", "우대사항_분석용"],
    "skills_text": ["핵심기술_표시", "핵심기술_분석용"],
}

# What stands in for a blank field.
FIELD_DEFAULTS = {
    "company_tier": "미분류",
    "experience": "미기재",
    "track": "미분류",
    "focus": "미분류",
    "role": "기타",
    "role_display": "기타",
    "record_state": "미분류",
}

# Spellings of "active".
TRUE_VALUES = ["true", "1", "y", "yes", "active", "활성", "유지"]

# Phrases that stay whole when a compact skill line is split on blanks.
PROTECTED_PHRASES = [
    "IP Design Verification", "Design Verification", "Computer Vision", "Recommendation System",
    "Vector Database", "Embedded System", "System Software", "Software Testing", "Sensor Fusion",
    "Machine Learning", "Deep Learning", "Data Pipeline", "Model Serving", "A/B Testing", "Time Series",
    "Natural Language Processing", "Clinical Data", "Survival Analysis", "Statistical Analysis",
]

# Skill spellings and the label they are counted under.
SKILL_ALIASES = {
    "파이썬": "Python", "python": "Python", "엘엘엠": "LLM", "llm": "LLM", "파이토치": "PyTorch",
    "pytorch": "PyTorch", "컴퓨터비전": "Computer Vision", "computer vision": "Computer Vision",
    "엠엘옵스": "MLOps", "mlops": "MLOps", "에이더블유에스": "AWS", "aws": "AWS", "에스큐엘": "SQL",
    "sql": "SQL", "쿠버네티스": "Kubernetes", "kubernetes": "Kubernetes", "도커": "Docker",
    "docker": "Docker", "텐서플로": "TensorFlow", "tensorflow": "TensorFlow", "지씨피": "GCP", "gcp": "GCP",
    "지피유": "GPU", "gpu": "GPU", "멀티모달": "Multimodal", "깃허브": "GitHub", "github": "GitHub",
    "검색증강생성": "RAG", "rag": "RAG", "태블로": "Tableau", "tableau": "Tableau", "빅쿼리": "BigQuery",
    "bigquery": "BigQuery", "이티엘": "ETL", "etl": "ETL", "엔엘피": "NLP", "nlp": "NLP", "애저": "Azure",
    "azure": "Azure", "카프카": "Kafka", "kafka": "Kafka", "자바": "Java", "java": "Java", "스파크": "Spark",
    "spark": "Spark", "데이터 분석": "Analytics", "추천 시스템": "Recommender Systems",
    "추천시스템": "Recommender Systems",
}

# Focus spellings; only the first differs from its own key.
FOCUS_ALIASES = {"llm": "LLM"}

# Known tracks in display order.
TRACKS = ["일반채용", "학사", "석사", "박사", "전문연구요원", "인턴", "계약직"]

# Words in an experience text, tried in order, with label and band.
EXPERIENCE_WORDS = [
    ("인턴", "인턴", "intern"), ("신입", "신입", "entry"), ("주니어", "주니어", "junior"),
    ("리드", "리드", "lead"), ("스태프", "스태프", "staff"), ("시니어", "시니어", "senior"),
]
EXPERIENCE_UNKNOWN = "미기재"
EXPERIENCE_NO_YEARS = "경력(연차 미기재)"
UNCLASSIFIED = "미분류"

# Titles that say nothing about the job.
GENERIC_TITLES = ["official website", "^채용공고$", "talent pool", "^ai engineer$", "^ai research engineer$"]

# Quality remarks in the order they are listed.
QUALITY_REMARKS = [
    "경력수준 불명확", "채용트랙 불명확", "직무초점 미정리", "핵심기술 부족", "주요업무 부족", "자격요건 부족",
    "제목이 지나치게 포괄적",
]

# The four roles in display order.
ROLE_ORDER = ["인공지능 엔지니어", "인공지능 리서처", "데이터 분석가", "데이터 사이언티스트"]

# Stand-ins when a role has no value to show, and the narrative's sentence pieces.
NO_TIER, NO_TRACK, NO_FOCUS, NO_EXPERIENCE = "기업군 미상", "트랙 미상", "초점 미상", "경력수준 미상"
NO_SKILLS = "핵심기술 정보"
NARRATIVE = "%s 채용이 중심이고, %s 수요가 가장 두드러집니다. %s 트랙 비중이 높으며, %s 스택과 %s 초점이 반복적으로 나타납니다."

# Pipeline stages of the overview and the count each shows.
PIPELINE_STAGES = [
    ("원본 수집", "total_jobs"), ("규칙 정규화", "total_jobs"), ("AI 보정 필요", "review_needed"),
    ("AI 반영 완료", "enriched"), ("고우선 검수", "high_priority"),
]
