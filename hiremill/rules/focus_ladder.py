"""Context rules that replace a focus label, in the order they are tried.

Each rule is (labels it applies to, term groups that must all be hit, terms that must not occur, new label).
A group is hit when any of its terms occurs; KEEP leaves the label as it is.
"""

KEEP = None

_RAG = ["RAG", "검색증강생성", "하이브리드 검색", "벡터 데이터베이스", "지식 검색", "임베딩"]
_HYBRID = ["하이브리드", "온프레미스", "다중 리전", "멀티 클라우드", "쿠버네티스", "GPU 스케줄링"]
_DASHBOARD = ["대시보드", "태블로", "슈퍼셋", "BI", "마트 데이터", "데이터 마트"]
_TRACKING = ["트래킹", "어트리뷰션", "MMP", "매체 최적화", "캠페인 운영"]
_CRM = ["CRM", "고객 관계 관리", "리텐션 캠페인", "푸시", "인앱 리텐션"]
_INTERPRETATION = ["모델 해석", "표현 학습", "스케일링 법칙", "작동 원리", "동작 원리", "모델 아키텍처", "내부 구조 분석"]
_NPU = ["NPU", "엔피유", "접목", "적용"]
_MLOPS = ["MLOps", "엠엘옵스", "머신러닝 파이프라인", "모델 서빙", "실험 추적", "메타데이터", "학습/추론 자동화", "서빙–모니터링",
          "개발–서빙–모니터링", "서빙-모니터링"]
_INFRA = ["인프라", "클라우드", "배포", "운영", "서빙"]
_CLOUD = ["클라우드", "AWS", "에이더블유에스", "GCP", "지씨피", "멀티 클라우드"]
_INSTALL = ["설치", "클러스터", "고객사 서버", "서버", "도입", "기술 지원"]
_ROBOTICS = ["로봇", "로보틱스", "human-robot", "인간-로봇", "robotics"]
_FINANCE = ["FP&A", "Financial Planning", "재무", "손익", "비용-편익", "ROI", "재무 예측", "실적", "variance"]
_PROCESS = ["Process Innovation", "전사 프로세스", "표준 운영 절차", "SOP", "운영 표준화", "업무 자동화", "ERP", "KPI", "OKR"]
_GROWTH = ["리텐션", "퍼널", "코호트", "캠페인", "획득", "활성", "퍼포먼스 마케팅", "앱 스토어 최적화"]
_PLATFORM = ["플랫폼 운영", "작품 운영", "웹툰 플랫폼", "프로모션", "서비스 운영"]
_AD_DATA = ["광고", "Ads Ops", "광고 데이터", "광고 플랫폼", "데이터 파이프라인", "거버넌스"]
_AD_RESULT = ["광고", "캠페인 성과", "캠페인 최적화", "모바일 앱 추적", "Growth Analytics", "통계 분석", "데이터 시각화"]
_MODEL_OPT = ["모델 변환", "연산자 호환성", "메모리 최적화", "양자화", "컴파일", "최적화"]
_DEVICE = ["온디바이스", "on-device", "edge", "디바이스"]
_ECG = ["심전도", "ECG", "이씨지"]
_BIO = ["생체신호", "신호 처리", "환자 모니터링"]
_TRIAL = ["임상연구", "clinical research", "임상시험", "인허가", "소프트웨어 의료기기"]

_TOOLISH = ["로보틱스", "SQL", "TensorFlow", "ONNX", "마케팅", "고객 관계 관리", "CRM", "광고"]
_ARCH = ["시스템 아키텍처", "아키텍처"]
_VISION = ["컴퓨터 비전", "인공지능 의료기기"]
_PIPE = ["데이터 파이프라인", "파이프라인"]

FOCUS_LADDER = [
    (_TOOLISH, [_FINANCE], _ROBOTICS, "재무 계획 분석"),
    (_TOOLISH, [_PROCESS], _GROWTH, "프로세스 혁신"),
    (_TOOLISH, [_PLATFORM, ["웹툰", "웹소설"]], [], "웹툰 플랫폼"),
    (_TOOLISH, [_PLATFORM], [], "플랫폼 운영"),
    (["SQL", "광고", "마케팅"], [_AD_DATA], [], "광고 데이터"),
    (["SQL", "광고", "마케팅"], [_AD_RESULT], [], "광고 성과 분석"),
    (["TensorFlow", "ONNX"], [_MODEL_OPT, _DEVICE], [], "온디바이스 최적화"),
    (["TensorFlow", "ONNX"], [_MODEL_OPT], [], "모델 최적화"),
    (_ARCH, [_RAG], [], "RAG"),
    (_ARCH, [_HYBRID], [], "하이브리드 인프라"),
    (_ARCH, [_MLOPS], [], "MLOps"),
    (_ARCH, [["자율주행"]], [], "자율주행"),
    (_ARCH, [_CLOUD], [], "클라우드"),
    (_ARCH, [_INFRA], [], "인프라"),
    (["의료 데이터", "데이터 분석"], [_RAG], [], "RAG"),
    (["의료 데이터"], [_ECG], [], "심전도"),
    (["의료 데이터"], [_BIO], [], "생체신호"),
    (_VISION, [_TRIAL, ["성능 검증", "검증", "validation"]], [], "의료기기 성능 검증"),
    (_VISION, [_TRIAL], [], "임상시험"),
    (_VISION, [["영상의학", "의료영상", "판독", "의료 영상"]], [], "의료영상"),
    (["최적화", "마케팅"], [_TRACKING], [], "트래킹"),
    (["고객 관계 관리", "CRM"], [["앱", "리텐션", "퍼널", "코호트", "캠페인", "획득", "활성", "그로스"]], [], "그로스 마케팅"),
    (["객체 인식"], [["비전 솔루션", "[solution]", "solution"]], [], "컴퓨터 비전"),
    (["객체 인식"], [["브이엘엠", "VLM"], ["교통", "산업 안전", "제조", "실시간 인식", "실시간 분석"]], [], "컴퓨터 비전"),
    (["3D 공간 이해"], [["컴퓨터비전", "컴퓨터 비전", "비전", "영상", "시공간", "브이엘엠", "VLM"]], [], "컴퓨터 비전"),
    (_PIPE, [_ECG], [], "심전도"),
    (_PIPE, [_BIO + ["신뢰도 평가", "노이즈 제거"]], [], "생체신호"),
    (_PIPE, [["AWS", "리눅스", "Linux", "Node.js", "백엔드", "클라우드", "배포", "운영"]], [], "클라우드"),
    (["LLM", "딥러닝"], [["표현 학습", "스케일링 법칙", "내부 구조 분석"]], [], "모델 해석"),
    (["LLM", "딥러닝"], [_INTERPRETATION, ["LLM", "엘엘엠"]], [], "LLM 해석"),
    (["LLM", "딥러닝"], [_INTERPRETATION], [], "모델 해석"),
    (["LLM", "딥러닝"], [_NPU], [], "NPU 적용"),
    (["설치"], [_INSTALL], [], "인프라"),
    (["모델 서빙", "설치"], [_HYBRID], [], "하이브리드 인프라"),
    (["하이브리드 인프라", "인프라"], [_MLOPS], [], "MLOps"),
    (["하이브리드 인프라", "인프라"], [_CLOUD], [], "클라우드"),
    (["로보틱스"], [], [], "로보틱스"),
    (["로봇 시뮬레이션", "동작 인식", "강화학습", "강화 학습", "로봇 제어"], [_ROBOTICS], [], "로보틱스"),
    (["그로스 마케팅", "제품 성장 분석"], [_DASHBOARD + _CRM + _TRACKING], [], KEEP),
    (["광고", "마케팅"], [_AD_DATA], [], "광고 데이터"),
    (["광고", "SQL"], [_AD_RESULT], [], "광고 성과 분석"),
    (["문제 해결"], [], ["수학", "최적화", "알고리즘"], ""),
]
