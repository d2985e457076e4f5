"""Fixed values of field terms and field clusters."""

# Section themes in order; the last one takes what matches none.
SECTION_THEMES = [{'id': 'edge',
  'tone': 'cluster-a',
  'label': '추론 최적화 · 컴퓨팅',
  'tokens': ['엔피유', 'npu', 'onnx', '포팅', '컴파일러', '컴퓨팅', '최적화', '배포', '임베디드']},
 {'id': 'health',
  'tone': 'cluster-b',
  'label': '헬스케어 · 진단 지원',
  'tokens': ['헬스케어', '의료', '환자', '진단', '진료', '모니터링', '병원', '의료기기', '영상']},
 {'id': 'data',
  'tone': 'cluster-c',
  'label': '데이터 분석 · 실험 운영',
  'tokens': ['데이터분석', '데이터', '실험', '지표', '통계', '예측', '마트', 'etl', 'crm', '분석']},
 {'id': 'industrial',
  'tone': 'cluster-d',
  'label': '산업 현장 · 설계 자동화',
  'tokens': ['cad', '제조', '산업', '현장', '설계', '로봇', '공장', '시뮬레이션', '검증']},
 {'id': 'service',
  'tone': 'cluster-e',
  'label': 'AI 제품화 · 서비스 적용',
  'tokens': ['llm', 'rag', '추천', '검색', '에이전트', '멀티모달', '서비스', '제품', '교육', '금융']},
 {'id': 'enterprise',
  'tone': 'cluster-f',
  'label': '기업 업무 · 솔루션 구축',
  'tokens': ['고객', '고객사', '솔루션', '엔터프라이즈', '업무', '플랫폼', '자동화', '구축']},
 {'id': 'other', 'tone': 'cluster-g', 'label': '기타 패턴', 'tokens': []}]

# Words that are no term.
STOPWORDS = ['ai', '인공지능', '엔지니어', '리서처', '개발', '개발자', '연구', '분석', '데이터', '모델', '업무', '경력', '신입', '우대', '자격', '요건', '주요', '핵심',
 '기술', '필수', '가능', '경험', '능력', '이해', '관련', '수행', '활용', '위한', '또는', '기반', '대한', '통한', '중심', '제품', '서비스', '학력', '학위',
 '학사', '석사', '박사', '전공', '신입', '필수', '우대', '요건', '자격', '가능', '이상', '보유', '분야', '관련분야', '모집', '채용', '인재채용', '모집요강',
 '상시채용', '경력무관', '계약직', '정규직', '근무지', '모집기간', '모집인원', '지원하기', '기획자', '담당자', '광주지사', '과천']

# Further words that are no term of a field.
FIELD_STOPWORDS = ['직무', '포지션', '이상', '보유', '우수', '관련분야', '유관분야', '업계', '전공', '분야', '기반', '중심', '역량', '조건', '요소', '문장', '환경', '문제해결',
 '커뮤니케이션', '협업', '경험이', '경력이', '있는', '있으신', '있으면', '좋습니다', '합니다', '우대합니다', '필요합니다', '이해가', '능력이', '역량을', '분을', '준하는',
 '보유하신', '활용한', '개발합니다', '구축합니다', '구현합니다', '설계하고', '수행합니다', '파이프라인을', '데이터를', '모델을', '시스템을']

# Labels and the spellings that stand for them.
TERM_ALIASES = [('멀티모달', ['멀티모달', 'multimodal']), ('LLM', ['llm', '엘엘엠', '거대언어모델']),
 ('RAG', ['rag', '검색증강생성', 'retrievalaugmentedgeneration']), ('컴퓨터비전', ['컴퓨터비전', 'computervision', '영상처리']),
 ('NLP', ['nlp', '자연어처리']), ('MLOps', ['mlops']), ('LLMOps', ['llmops']), ('지식그래프', ['지식그래프', 'knowledgegraph']),
 ('GNN', ['gnn', '그래프신경망']), ('추천 시스템', ['추천시스템', '추천 시스템', '추천']), ('검색 시스템', ['검색시스템', '검색 시스템', '검색']),
 ('데이터 파이프라인', ['데이터파이프라인', '데이터 파이프라인', 'etl', '파이프라인']),
 ('실험 설계', ['실험설계', '실험 설계', 'ab테스트', 'a/b테스트', 'ab test', 'a/b test']),
 ('통계 분석', ['통계분석', '통계 분석', '지표분석', '데이터분석']), ('모델 서빙', ['모델서빙', '모델 서빙', '서빙']),
 ('온디바이스', ['온디바이스', 'ondevice', 'edgeai', 'edge ai']), ('임베디드', ['임베디드', 'embedded']),
 ('시뮬레이션', ['시뮬레이션', 'simulation']), ('테스트벤치', ['테스트벤치', 'testbench']), ('헬스케어', ['헬스케어', '의료', '의료기기']),
 ('의료영상', ['의료영상', 'medical imaging']), ('금융', ['금융', '핀테크']), ('교육', ['교육', '에듀테크']), ('제조', ['제조', '스마트팩토리']),
 ('로보틱스', ['로봇', '로보틱스']), ('API', ['api']), ('도커', ['docker', '도커']), ('쿠버네티스', ['kubernetes', '쿠버네티스', 'k8s']),
 ('AWS', ['aws', '에이더블유에스']), ('GCP', ['gcp', '지씨피', 'gcs']), ('SQL', ['sql', '에스큐엘']), ('Python', ['python', '파이썬']),
 ('PyTorch', ['pytorch', '파이토치']), ('TensorFlow', ['tensorflow', '텐서플로']), ('전문연구요원', ['전문연구요원', '병역특례'])]

# Weak field term keys.
WEAK_FIELD_TERM_KEYS = ['위한', '또는', '기반', '대한', '관련', '통한', '중심', '있는', '있으신', '있으면', '가능', '가능한', '필요', '필수', '우대', '요건', '자격', '학력', '학위',
 '학사', '석사', '박사', '전공', '경력', '신입', '보유', '분야', '제품', '서비스', '시스템', '프로젝트', '다양한', '있어야', '보유해야', '미기재', '우대사항',
 '컴퓨터', '컴퓨터공학', '비즈니스', '소프트웨어', '프레임워크', '글로벌', '사용자', '고객사', '솔루션', '대규모', '복잡한', '서류접수', '면접', '차면접', '모집', '채용',
 '인재채용', '모집요강', '상시채용', '경력무관', '계약직', '정규직', '근무지', '모집기간', '모집인원', '지원하기', '기획자', '담당자', '광주지사', '과천', '개발', '분석',
 '설계', '운영', '구축', '모델', '데이터', '기술']

# Allowed short term keys.
ALLOWED_SHORT_TERM_KEYS = ['llm', 'rag', 'nlp', 'sql', 'etl', 'crm', 'api', 'sdk', 'aws', 'gcp', 'npu', 'cad', 'bi']

# Non skill generic keys.
NON_SKILL_GENERIC_KEYS = ['python', '파이썬', 'sql', 'aws', 'gcp', 'docker', '도커']

# Broad cluster label keys.
BROAD_CLUSTER_LABEL_KEYS = ['통계분석', '데이터분석', '인프라', '클라우드', 'api', '대시보드', '검증', '실험설계', '자동화']

# Endings of words that are no term.
TERM_ENDINGS = ['(합니다|합니다만|좋습니다|우대합니다|필요합니다|개발합니다|구축합니다|구현합니다|수행합니다|설계하고)$', '(경험이|경력이|이상의|이상|준하는|보유하신|보유해야|분을|능력이|이해가|역량을|있어야)$',
 '(위한|또는|관련|대한|통한|기반|중심|가능한|가능)$', '(하고|하며|하여|하는|하신|여야|으신|필요한|없으신)$']
