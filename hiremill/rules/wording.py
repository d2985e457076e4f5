"""Fixed values of line cleaning, display and role or scope decisions that are short word lists or patterns."""

# Words too generic to be shown as a keyword.
GENERIC_TOKENS = [
    "인공지능", "ai", "엔지니어", "리서처", "모델", "개발", "연구", "분석", "데이터", "구축", "설계", "운영", "최적화", "서비스",
    "인공지능 엔지니어", "인공지능 리서처", "데이터 엔지니어", "데이터 사이언티스트", "데이터 분석가", "위한", "또는", "학력", "학위", "학사",
    "석사", "박사", "사이언스", "학과", "유관학과", "전공", "필수", "우대", "기반", "관련", "제품", "이상이신", "경험자", "가능자",
    "채용절차법", "상시채용", "경력무관", "계약직", "정규직", "모집", "채용", "모집요강", "인재채용", "기획자", "담당자", "광주지사", "과천",
    "지원하기", "우대합니다", "있습니다",
]
ROLE_NAMES = ["인공지능 엔지니어", "인공지능 리서처", "데이터 사이언티스트", "데이터 분석가"]
DISTINCTIVE_BLOCK = ["ai", "인공지능", "엔지니어", "리서처", "모델", "개발", "데이터", "연구", "분석", "최적화", "설계", "운영", "서비스"]

# Where a running field is broken into segments, and openings cut from a segment.
DETAIL_BREAKS = "(해외여행에|남성은|취업보호대상자|관련 분야|채용하고 싶은 사람|[0-9]+년 이상)"
FIELD_BREAKS = "(해외여행에|남성은|취업보호대상자|관련 분야|채용하고 싶은 사람|공고명[:：]|지원 전,|채용 관련 문의사항|[0-9]+년 이상)"
DETAIL_OPENINGS = ["^본 직무는\\s*", "^채용된 전문가는\\s*", "^전문가는 아래 업무들을.*$", "^직무내용$"]
FIELD_OPENINGS = ["^(?:[·•▪*]+|\\-+)\\s*",
                  "^(공고명|직무내용|주요 연구 영역은 다음과 같습니다|요 연구 영역은 다음과 같습니다)[:：]?\\s*"]
SKILL_ENDINGS = "\\b(경험|활용 능력|전문성|역량)\\b$"

# Terms whose mention keeps a line.
HINT_WORDS = "\\b(?:LLM|VLM|NLP|RAG|MLOps|ONNX|AWS|SQL|EMR|GIS|SDK|GA)\\b"

# Fixed values: (pattern, weight) of a line's score.
LINE_BONUSES = [
    ("(추천 시스템|생성형 인공지능|머신러닝|machine learning|llm|rag|컴퓨터 비전|vision|자율주행|임베디드|추론|모델|파이프라인|서빙|아키텍처"
     "|sql|spark|flink|npu|gpu|onnx|mlops|실험|분석|최적화)", 4.5),
    ("(개발|설계|구축|운영|최적화|분석|평가|적용|서빙|배포)", 1.6),
    ("(추천|생성형|프로덕션|실시간|분산|백엔드|server|api)", 1.2),
]
LINE_PENALTY_WISH = ("(우대|있으면 좋습니다|관심과 경험)", 0.6)
LINE_PENALTIES_UNHINTED = [("(영어|의사소통|협업|적응|커뮤니케이션)", 2.4), ("(학사|석사|박사|학위|경력|전공)", 1.6)]

# Segments dropped from every field, from unhinted segments, and per field.
DROP_ALWAYS = ["^(위한|또는|관련|기본)\\b", "(채용 전형|인터뷰|수습기간|복지|처우 협의|최종 입사)"]
DROP_UNHINTED = ["(자율 복장|교육비|도서 구입비|인센티브|팀 활동비|리더소통비|지원금)"]
DROP_WISH_UNHINTED = [
    "(학사|석사|박사|학위|초대졸|전공|[0-9]+년|경력)",
    "(문제 해결|커뮤니케이션|협업|의사결정|주도적|책임감|성실|원활한 소통|빠르게 실행|스스로 방향을 잡고|끝까지 실행)",
    "^(별도|기본|관련 분야)\\s",
]
DROP_TASKS = ["^(공고|채용|문의|지원)\\b"]

# Preview compression.
PREVIEW_TAILS_A = ["찾고 있습니다\\.?$", "우대합니다\\.?$", "전문가를\\s*$", "역할입니다\\.?$"]
PREVIEW_TAILS_B = ["(하고|하며|하여|한 후|하는)$",
                   "(합니다|수행합니다|담당합니다|지원합니다|구축합니다|개발합니다|운영합니다|설계합니다|검증합니다|평가합니다)\\.?$", "(을|를)\\s+담당$"]
PREVIEW_CLAUSES = ",| 및 | 그리고 |하며 |하여 |후,? |기반으로 "
PREVIEW_VERBS = "(구축|개발|설계|검증|분석|최적화|운영|연동|통합|배포|평가)"
SUMMARY_VERBS = "(구축|개발|설계|검증|분석|최적화|운영|연동|통합|배포|평가|자동화|지원)"
PARTICLE_START = "^[은는이가을를]\\s"

# Display lines.
META_WORDS = "(모집|채용|지원하기|바로가기|문의하기|접수|반환|전형)"
STRUCT_META_WORDS = "(모집|채용|지원하기|바로가기|문의하기|접수|반환|전형|결과 통지|합격발표)"
OFFICE_WORDS = "(지사|센터|오피스|지점)"
DUTY_WORDS = ("(구축|개발|설계|분석|검증|운영|평가|최적화|자동화|연동|통합|배포|구현|모델링|튜닝|실험|리서치|조사|기획|관리|개선|고도화|테스트"
              "|모니터링|서빙|파이프라인|유지보수|리팩토링)")
HIRING_END = "^.*(모집|채용)$"
OFFICE_LINE = "^[가-힣]{2,}(지사|센터|오피스)$"
PLACE_LINES = ["과천"]
APPLY_WORDS = "(지원 가능|지원 가능합니다)"
BULLETS = "^[•·▪■□◦●\\-–>]+\\s*"
GENERIC_TITLE_KEYS = ["채용", "인재채용", "상시채용", "채용공고"]
TITLE_HIRING = "(채용|모집)"

# Role votes. (pattern on the title, pattern that must not match, role index in ROLE_ORDER, weight)
ROLE_ENGINEER, ROLE_RESEARCHER, ROLE_ANALYST, ROLE_SCIENTIST = range(4)
TITLE_VOTES = [
    ("data scientist|데이터 사이언티스트|clinical research scientist|임상연구", None, ROLE_SCIENTIST, 6.5),
    ("data analyst|business analyst|\\banalyst\\b|insight|crm|cx|pmo|growth marketing|performance marketer|fp&a|financial planning"
     "|process innovation|플랫폼 운영|작품 운영", "data scientist|clinical research scientist|임상연구", ROLE_ANALYST, 6.0),
    ("research scientist|researcher|research engineer|\\br&d\\b|연구", "clinical research scientist|임상연구|data scientist", ROLE_RESEARCHER, 6.0),
    ("\\bengineer\\b|엔지니어|mlops|platform|serving|backend|infra|solution architect|architect", "research engineer", ROLE_ENGINEER, 5.0),
]
RESEARCH_TITLE = "research scientist|researcher|research engineer|\\br&d\\b|연구"
RESEARCH_SCIENTIST_TITLE = ("clinical research scientist|임상연구|data scientist", ROLE_SCIENTIST, 5.5)
EVIDENCE_VOTES = [
    ("모델|llm|vlm|비전|vision|multimodal|foundation|파운데이션|학습|추론|파이토치|pytorch|tensorflow", ROLE_ENGINEER, 1.0),
    ("논문|학회|benchmark|벤치마크|연구", ROLE_RESEARCHER, 1.0),
    ("통계|가설|실험|시계열|회귀|clinical|임상|의료영상|헬스케어|검증", ROLE_SCIENTIST, 1.0),
    ("대시보드|리포트|report|bi|sql|지표|마케팅|캠페인|사용자 행동", ROLE_ANALYST, 1.0),
]
SOURCE_WEIGHTS = {"raw": 3.0, "summary": 3.5, "signal": 4.0, "mapped": 1.25}
CLASSIFIER_WEIGHTS = {"high": 5.25, "medium": 3.75, "low": 2.0}
AGREEMENTS = [("raw", "signal", 2.25), ("raw", "summary", 1.5), ("signal", "summary", 1.75), ("classifier", "signal", 1.0), ("classifier", "raw", 0.75)]
NO_ROLE = "기타"

# Weights of signal categories when a business focus of an engineer is replaced.
REBALANCE_PRIORITY = [("problem", 9.4), ("model", 9.2), ("system", 8.4), ("workflow", 7.5), ("domain", 6.4)]
REBALANCE_BLOCK = ["LLM", "인프라", "클라우드"]
SOFT_BROAD = ["마케팅", "데이터 분석"]
SOFT_BROAD_RIVALS = ["고객 관계 관리", "데이터 마트", "대시보드", "리스크 모델링"]
FOCUS_MINUS = ["사업 개발", "소프트웨어 개발", "데이터 분석"]

# Thin input.
THIN_TITLE = "(talent pool|직원\\(계약직\\) 채용|계약직 공고)"
RECRUIT_TITLE = "(^|\\b)recruitment(\\b|$)"
RECRUIT_RESCUE = "(수학|최적화|알고리즘|cuda|pytorch|tensorflow)"
THIN_SUMMARY = "(기반 연구 수행|모델 개발과 테스트|연구 수행)$"
RETRY_SUMMARY = "(연구 수행|모델 개발과 테스트|데이터 분석과 인사이트 제시)$"

# Names of company and theme stand-ins.
UNKNOWN_COMPANY = "미상 회사"
REASON_KEYWORDS, REASON_ROLES, REASON_NONE = " 중심 공고가 반복됩니다.", " 채용이 반복됩니다.", "같은 회사 공고를 한 묶음으로 정리했습니다."
HEADLINE_NONE = "공고 묶음"
TONE_TEXT = " 중심의 공고 신호를 모아 보여줍니다."
DEFAULT_THEME = "service"
THEME_BONUSES = [("edge", ["엔피유", "엔피아이알"]), ("health", ["의료", "헬스케어"])]
THEME_ROLE_BONUS = ("data", ["데이터 분석가", "데이터 사이언티스트"])
