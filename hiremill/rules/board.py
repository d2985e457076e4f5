"""Fixed values of display lines, roles, scope, themes and bundles."""

# Tones in order.
TONE_ORDER = ['tone-ai', 'tone-data', 'tone-domain', 'tone-analysis']

# Words of the AI tone.
AI_TERMS = ['ai', '인공지능', 'llm', 'vlm', 'rag', '멀티모달', '딥러닝', '머신러닝', '모델', '훈련', '최적화', '컴퓨터비전', '자연어', '추천', '시계열', '비전',
 'onnx']

# Words of the data tone.
DATA_TERMS = ['data', '데이터', 'etl', '파이프라인', 'sql', 'mlops', 'infra', '인프라', 'serving', '서빙', 'api', 'sdk', 'backend', '도커',
 'docker', 'aws', 'gcp', 'azure', '쿠버네티스']

# Words of the domain tone.
DOMAIN_TERMS = ['금융', '교육', '커머스', '광고', '검색', '산업안전', '자율주행', '제조', '도메인', '제품', 'commerce', 'search']

# Words of the analysis tone.
ANALYSIS_TERMS = ['분석', '리서치', '연구', '실험', '평가', '검증', '지표', '통계', '예측', 'research', 'analysis']

# Noise lines.
NOISE_PATTERNS = ['^담당 업무$', '^주요 업무$', '^자격 요건$', '^우대 사항$', '^근무조건$', '^지원 전,? 확인해주세요!?$', '^채용 관련 문의사항.*$', '^읽어보면 도움 되는 관련 자료$',
 '^제출하신 .*', '^필요 시 .*', '^입사 후 .*', '^로 보내주세요\\.?$', '^구체적으로 다음 업무들 중$', '^전문가는 아래 업무들을.*$', '^.*찾고 있습니다\\.?$',
 '^전 분야에 대한 포괄적인 학습 및 이해$', '^\\(.*\\)$', '^&\\s.*$', '^.*로그인.*$', '^.*문의 가능.*$', '^.*포인트.*$', '^.*채용 과정.*$',
 '^.*근무가 가능합니다.*$', '^.*합격 모두 가능.*$', '^.*누가 만들지.*$']

# Lines never shown.
DISPLAY_DROP_PATTERNS = ['^모집 요강$', '^상시채용$', '^경력무관$', '^계약직$', '^정규직$', '^지원하기$', '^근무정보$', '^지원 관련 정보$', '^필수 경험 및 역량$', '^수행 프로젝트$',
 '^구축 사례 소개$', '^현재 모집 중인 이 공고는 어떠신가요\\??$', '^.*채용절차법.*$', '^.*반환 청구.*$', '^.*반환 서류.*$', '^.*서류 반환 절차.*$',
 '^.*결과 통지일.*$', '^.*레퍼런스 체크.*$', '^.*서류전형.*$', '^.*최종면접.*$', '^.*최종 합격.*$', '^.*처우협의.*$', '^.*수습 기간.*$',
 '^.*입사지원 서류.*$', '^.*허위사실.*$', '^.*채용이 취소될 수 있습니다.*$', '^.*접수된 서류는 채용과 무관.*$', '^.*우측 지원하기 클릭.*$', '^.*지원하기.*$',
 '^.*문의하기.*$', '^.*바로가기.*$', '^.*담당자가 빠른 시일 내 연락.*$', '^.*문의 사항을 작성.*$', '^.*다양한 직무로 지원 가능.*$', '^.*모집기간.*$',
 '^.*모집인원.*$', '^.*근무지.*$']

# Lines shown as terms.
DISPLAY_SIGNAL_LINE_PATTERNS = ['이상이신 분', '이상인 분', '경력\\s*\\d+\\s*년 이상', '경력이\\s*\\d+\\s*년 이상', '있으신 분', '가능하신 분', '보유하신 분', '갖추신 분', '익숙하신 분',
 '능력이 있으신 분', '이해도가 있으신 분', '우대']

# Administrative words.
DISPLAY_META_ADMIN_TERMS = ['모집요강', '인재채용', '채용공고', '채용정보', '채용안내', '상시채용', '경력무관', '정규직', '계약직', '지원하기', '바로가기', '지원서', '접수', '문의사항', '문의하기',
 '채용절차법', '반환', '서류 반환', '반환 청구', '결과 통지', '전형', '합격발표', 'recruitment', 'recruiter', 'hiring', 'career']

# Navigation words.
DISPLAY_META_NAV_TERMS = ['클릭', '링크', '자세히 보기', '상세 보기', '원문 보기', '지원하기', '바로가기', '문의하기', '지원서', '접수']

# Duty words.
DISPLAY_DUTY_TERMS = ['구축', '설계', '분석', '검증', '운영', '평가', '최적화', '자동화', '연동', '통합', '배포', '구현', '모델링', '튜닝', '실험', '리서치', '조사', '기획', '관리',
 '개선', '고도화', '테스트', '모니터링', '서빙', '파이프라인', '유지보수', '리팩토링']

# Role nouns.
DISPLAY_ROLE_NOUN_TERMS = ['개발자', '엔지니어', '분석가', '리서처', '과학자', '기획자', '담당자', '연구원', '매니저', '컨설턴트', '전문가', '오퍼레이터', '아키텍트']

# Openings cut from previews.
PREVIEW_DROP_PREFIXES = ['^본 직무는\\s*', '^채용된 전문가는\\s*', '^전문가는 아래 업무들을.*$', '^은\\s+', '^는\\s+']

# Bad summaries.
SUMMARY_BAD_PATTERNS = ['^인공지능 .* 엔지니어$', '^인공지능 .* 개발 엔지니어$', '^.*엔지니어 찾기$', '^.*역량 요구$', '^.*참여.*$', '^.*(엔지니어|개발자|리서처)$']

# Bad tokens.
DISPLAY_BAD_TOKENS = ['이상이신', '경험자', '가능자', '채용절차법', '우대합니다', '있습니다']

# Focus spellings.
BOARD_FOCUS_CANONICAL_MAP = {'에스큐엘': 'SQL',
 'sql': 'SQL',
 '파이토치': 'PyTorch',
 'pytorch': 'PyTorch',
 '텐서플로': 'TensorFlow',
 'tensorflow': 'TensorFlow',
 '이티엘': 'ETL',
 'etl': 'ETL',
 '쿠버네티스': '쿠버네티스',
 'kubernetes': '쿠버네티스',
 '오엔엔엑스': 'ONNX',
 'onnx': 'ONNX',
 '컴퓨터비전': '컴퓨터 비전',
 'crm': '고객 관계 관리',
 '에스디케이': 'SDK',
 'sdk': 'SDK',
 '에이피아이': 'API',
 'api': 'API',
 '브이엘엠': 'VLM',
 'vlm': 'VLM'}

# Broad focus labels.
BOARD_BROAD_FOCUS_LABELS = ['pytorch', 'tensorflow', 'sql', '파이썬', '쿠버네티스', '파이프라인', '사업개발', '소프트웨어개발', '인프라엔지니어', '데이터분석', '마케팅', 'etl', 'llm',
 '의료', '인사이트']

# Focus hints with weights.
BOARD_FOCUS_HINTS = [{'label': 'RAG', 'patterns': ['rag', '검색증강생성', 'retrieval', '벡터 데이터베이스', '검색 시스템'], 'weight': 8.8},
 {'label': '고객 관계 관리', 'patterns': ['고객 관계 관리', 'crm'], 'weight': 8.6},
 {'label': '공급망 최적화', 'patterns': ['공급망', 'scm', '재고', '물류 센터'], 'weight': 8.5},
 {'label': '광고 시스템', 'patterns': ['광고 시스템', '광고 요청', '실시간 입찰', 'rtb'], 'weight': 8.5},
 {'label': '객체 인식', 'patterns': ['객체 인식', 'object detection'], 'weight': 8.4},
 {'label': '이상 탐지', 'patterns': ['이상 탐지', 'anomaly'], 'weight': 8.4},
 {'label': '불량 탐지', 'patterns': ['불량 탐지', 'defect'], 'weight': 8.4},
 {'label': '트래킹', 'patterns': ['트래킹', 'tracking'], 'weight': 8.4},
 {'label': 'VSLAM', 'patterns': ['vslam', '브이에스엘에이엠'], 'weight': 8.4},
 {'label': '추론 엔진', 'patterns': ['추론 엔진', 'inference engine', 'runtime'], 'weight': 8.3},
 {'label': '임베디드 최적화', 'patterns': ['임베디드', '포팅', '멀티 스레딩', '파이프라이닝'], 'weight': 8.3},
 {'label': '3D 공간 이해', 'patterns': ['실외 환경', '시공간', '3d', '공간 이해'], 'weight': 8.2},
 {'label': '비전 인공지능', 'patterns': ['비전 인공지능', 'vision ai'], 'weight': 8.1},
 {'label': '모델 변환', 'patterns': ['모델 변환', '변환 구조', 'onnx 변환'], 'weight': 8.1},
 {'label': '하이브리드 인프라', 'patterns': ['하이브리드 인프라', '퍼블릭 클라우드', 'gpu 서버'], 'weight': 8.3},
 {'label': '컴파일러', 'patterns': ['compiler', '컴파일러', '아이알', 'ir 그래프', 'ir'], 'weight': 8.2},
 {'label': 'ONNX', 'patterns': ['onnx', '오엔엔엑스'], 'weight': 8.1},
 {'label': '생체신호', 'patterns': ['생체신호'], 'weight': 8.0},
 {'label': '음성인식', 'patterns': ['음성인식', 'speech'], 'weight': 8.0},
 {'label': '의료 데이터', 'patterns': ['의료 데이터', '의료영상', '의료기기', '임상'], 'weight': 7.9},
 {'label': '컴퓨터 비전', 'patterns': ['컴퓨터 비전', '컴퓨터비전', 'vision', '라이다', 'lidar'], 'weight': 7.8},
 {'label': '자율주행', 'patterns': ['자율주행', '자율 주행'], 'weight': 7.8},
 {'label': '멀티모달', 'patterns': ['멀티모달', 'multimodal'], 'weight': 7.7},
 {'label': 'MLOps', 'patterns': ['mlops'], 'weight': 7.4}, {'label': 'LLMOps', 'patterns': ['llmops'], 'weight': 7.4},
 {'label': '모델 서빙', 'patterns': ['모델 서빙', '서빙', 'serving'], 'weight': 7.2},
 {'label': '데이터 마트', 'patterns': ['데이터 마트', '마트 데이터', 'mart'], 'weight': 7.2},
 {'label': '대시보드', 'patterns': ['대시보드', 'dashboard'], 'weight': 6.9},
 {'label': '인프라', 'patterns': ['인프라', '클러스터', '온프레미스'], 'weight': 6.8},
 {'label': '클라우드', 'patterns': ['클라우드', 'aws', 'gcp', 'azure'], 'weight': 6.4},
 {'label': 'SDK', 'patterns': ['sdk', '에스디케이'], 'weight': 6.4},
 {'label': 'API', 'patterns': [' api ', '에이피아이'], 'weight': 6.2},
 {'label': '검증', 'patterns': ['검증', '테스트벤치', 'testbench'], 'weight': 6.1},
 {'label': '검색', 'patterns': ['검색', 'search'], 'weight': 6.0},
 {'label': '추천', 'patterns': ['추천', 'recommend'], 'weight': 6.0},
 {'label': '리스크 모델링', 'patterns': ['안정성 평가', '성장성 평가', '적정 한도', 'fraud', 'risk'], 'weight': 5.9},
 {'label': '데이터 분석', 'patterns': ['데이터 분석', '통계', '지표'], 'weight': 5.4},
 {'label': '마케팅', 'patterns': ['마케팅', 'campaign', '광고'], 'weight': 5.3},
 {'label': '사업 개발', 'patterns': ['사업 개발', '사업 기회'], 'weight': 5.2},
 {'label': 'ETL', 'patterns': ['etl', '이티엘'], 'weight': 5.1},
 {'label': 'PyTorch', 'patterns': ['pytorch', '파이토치'], 'weight': 3.2},
 {'label': 'TensorFlow', 'patterns': ['tensorflow', '텐서플로'], 'weight': 3.2},
 {'label': 'SQL', 'patterns': ['sql', '에스큐엘'], 'weight': 3.0}]

# Business focus of an engineer.
ENGINEER_BUSINESS_DOMINANCE_PATTERNS = ['제품\\s*성장\\s*분석', '성장\\s*분석', '제품\\s*분석', '\\ba/b\\b', '에이비\\s*테스트', '\\bsql\\b', '마케팅', '캠페인', '퍼널', '리텐션']

# Labels no engineer focus may have.
ENGINEER_FOCUS_BLOCKLIST = ['제품성장분석', '성장분석', '제품분석', 'ab테스트', 'sql', 'pytorch', 'tensorflow', 'onnx', 'docker', 'kubernetes']

# Sentence endings of bad summaries.
SUMMARY_ENDING_PATTERNS = ('합니다', '합니다.', '수행합니다', '수행합니다.', '담당합니다', '담당합니다.', '지원합니다', '지원합니다.', '구축합니다', '구축합니다.', '개발합니다', '개발합니다.',
 '운영합니다', '운영합니다.')

# Terms that make no pair.
SEMANTIC_NOISE_TERMS = ['미분류', '미기재', '경력', '신입', '인턴', '시니어', '주니어', '학사', '석사', '박사', '학위', '학력', '전공', '채용', '일반채용', '전문연구요원', '기타']

# Pair term spellings.
SEMANTIC_ALIAS_MAP = {'엘엘엠': 'LLM',
 '지피유': 'GPU',
 '엔피유': 'NPU',
 '검색증강생성': 'RAG',
 '컴퓨터비전': 'Computer Vision',
 '컴퓨터 비전': 'Computer Vision',
 '추천 시스템': '추천',
 'Recommendation System': '추천',
 '에이더블유에스': 'AWS',
 '지씨피': 'GCP',
 '쿠버네티스': 'Kubernetes',
 '파이토치': 'PyTorch',
 '텐서플로': 'TensorFlow',
 '에스큐엘': 'SQL',
 '머신러닝': 'Machine Learning',
 '딥러닝': 'Deep Learning',
 '시계열': '시계열'}

# Skills that serve as an axis.
SEMANTIC_SKILL_AXIS_TERMS = ['LLM', 'RAG', 'MLOps', 'LLOps', 'PyTorch', 'TensorFlow', 'Kubernetes', 'Docker', 'AWS', 'GCP', 'GPU', 'NPU', 'CUDA',
 'Triton', 'ONNX', 'SQL', 'Spark', 'Airflow', 'Computer Vision', 'NLP', 'VLM', 'OCR', '추천', '시계열', '통계모델링',
 'A/B Testing', 'Vector Database', 'Model Serving', 'Data Pipeline']

# Named pairs.
SEMANTIC_TEMPLATE_SPECS = [(('LLM', '검색'), 'LLM 검색 서비스화', 'LLM을 검색, RAG, 서빙 흐름과 연결해 제품 안에서 답을 찾게 만드는 채용군입니다.'),
 (('LLM', 'RAG'), 'LLM 검색 서비스화', 'LLM을 검색, RAG, 서빙 흐름과 연결해 제품 안에서 답을 찾게 만드는 채용군입니다.'),
 (('AI반도체', '최적화'), 'AI반도체 추론 최적화', '가속기, 런타임, 모델 최적화를 함께 다뤄 추론 성능을 끌어올리는 채용군입니다.'),
 (('AI반도체', '검증'), 'AI반도체 검증 자동화', 'AI 반도체 설계와 검증 신호가 함께 나타나 칩 품질과 테스트 체계를 맡는 채용군입니다.'),
 (('AI반도체', 'GPU'), 'AI반도체 가속 인프라', 'GPU/NPU 가속 환경과 AI 반도체 구현 요구가 함께 나타나는 채용군입니다.'),
 (('인프라', 'MLOps'), 'AI 플랫폼 운영화', '모델을 서비스까지 안정적으로 옮기기 위한 배포, 관측, 파이프라인 역량이 묶인 채용군입니다.'),
 (('인프라', 'LLM'), 'LLM 플랫폼 운영화', 'LLM 모델을 서비스 인프라 위에서 배포, 확장, 운영하는 요구가 함께 나타나는 채용군입니다.'),
 (('인프라', 'Kubernetes'), 'AI 플랫폼 운영화', '모델을 서비스까지 안정적으로 옮기기 위한 배포, 관측, 파이프라인 역량이 묶인 채용군입니다.'),
 (('인프라', 'GPU'), 'GPU 인프라 운영', 'GPU 자원, 배포 환경, 모델 실행 요구를 함께 다뤄 학습·추론 기반을 맡는 채용군입니다.'),
 (('인프라', 'AI반도체'), 'AI반도체 플랫폼 인프라', 'AI 반도체와 운영 인프라가 함께 등장해 가속 환경을 서비스 기반으로 연결하는 채용군입니다.'),
 (('데이터플랫폼', '인프라'), '데이터 플랫폼 인프라', '데이터 파이프라인과 운영 인프라를 함께 설계해 모델과 분석의 기반을 만드는 채용군입니다.'),
 (('데이터플랫폼', 'ETL'), '데이터 파이프라인 운영', 'ETL, 저장소, 처리 흐름을 함께 다뤄 분석과 모델링에 쓰이는 데이터를 안정화하는 채용군입니다.'),
 (('BI', '지표분석'), '제품 지표 분석', 'BI와 지표 분석이 함께 등장해 제품 의사결정과 실험 해석을 지원하는 채용군입니다.'),
 (('제품분석', 'SQL'), '제품 데이터 분석', 'SQL 기반 분석과 제품 지표 해석이 함께 요구되어 성장·실험 판단을 맡는 채용군입니다.'),
 (('LLM', 'PyTorch'), 'LLM 모델 엔지니어링', 'LLM 개발과 PyTorch 구현 역량이 함께 요구되어 모델 학습·평가·응용을 맡는 채용군입니다.'),
 (('최적화', 'PyTorch'), '모델 최적화 엔지니어링', 'PyTorch 기반 모델을 성능, 비용, 추론 속도 관점에서 개선하는 채용군입니다.'),
 (('AI반도체', '하드웨어'), 'AI반도체 하드웨어 구현', '하드웨어 설계 신호와 AI 반도체 요구가 함께 나타나 칩 구현에 가까운 채용군입니다.'),
 (('추천', '시계열'), '추천 모델 운영', '개인화, 예측, 실험 지표를 함께 다뤄 추천 성능을 실제 서비스에서 검증하는 채용군입니다.'),
 (('추천', 'A/B Testing'), '추천 실험 고도화', '추천 모델과 실험 설계가 함께 요구되어 성능 개선을 지표로 증명하는 채용군입니다.'),
 (('헬스케어', '통계모델링'), '헬스케어 통계 모델링', '의료 데이터와 통계 모델링을 함께 다뤄 임상·생체 신호 해석을 맡는 채용군입니다.'),
 (('자율주행', '시스템구현'), '자율주행 시스템 구현', '인지, 제어, 시스템 통합 신호가 함께 나타나 실제 주행 환경 구현에 가까운 채용군입니다.'),
 (('비전', '문서AI'), '문서·비전 자동화', '이미지와 문서 이해 기술을 결합해 추출, 검수, 자동화 문제를 푸는 채용군입니다.'),
 (('비전', 'Computer Vision'), '컴퓨터 비전 응용', '시각 인식 모델과 서비스 적용 요구가 함께 나타나는 채용군입니다.'),
 (('문서AI', 'Computer Vision'), '문서·비전 자동화', '문서 이해와 시각 인식 기술을 함께 써서 추출, 검수, 자동화 문제를 푸는 채용군입니다.'),
 (('문서AI', '검색'), '문서 검색 자동화', '문서 이해와 검색 흐름을 결합해 지식 추출과 탐색을 자동화하는 채용군입니다.'),
 (('검증', 'LLM'), 'LLM 검증 체계', 'LLM 결과를 평가하고 검증하는 절차와 도구를 함께 다루는 채용군입니다.'),
 (('헬스케어', '비전'), '헬스케어 비전 모델링', '의료·생체 데이터 맥락에서 이미지 인식과 모델 검증을 함께 다루는 채용군입니다.')]

# Words that are no signal term.
SIGNAL_STOPWORDS = ['인공지능', 'ai', '엔지니어', '리서처', '인공지능엔지니어', '인공지능리서처', '데이터엔지니어', '데이터사이언티스트', '데이터분석가', '연구', '개발', '구축', '설계', '운영',
 '분석', '최적화', '서비스', '시스템', '플랫폼', '공고', '직무', '역할', '지원', '채용', '업무', '데이터', '모델', '기반', '활용', '구현', '담당', '기능',
 '성능', '경험', '프로젝트', '산업', '향상', '문제', '확장', '적용', '회사', '여러', '반복', '직원', '계약직', '사업단', '엔드', '기술', '스택', '경력',
 '엔지니어링', '사이언티스트', '개발자', '공고명', '가능성을', '거치도록', '고객사의', '위한', '또는', '학력', '학위', '학사', '석사', '박사', '사이언스', '학과',
 '유관학과', '전공', '필수', '우대', '기반', '관련', '대한', '통한', '분야', '이상', '가능', '제품', '서비스', '이상이신', '경험자', '가능자', '채용절차법',
 '상시채용', '경력무관', '계약직', '정규직', '모집', '채용', '모집요강', '인재채용', '기획자', '담당자', '광주지사', '과천', '지원하기', '우대합니다', '있습니다']

# Endings that are no signal term.
SIGNAL_BAD_SUFFIXES = ('에서', '으로', '에게', '적인', '하며', '하고', '하는', '하기', '하여', '한다', '합니다', '위한', '통한', '처럼', '중심', '기반', '문제로', '향상을')

# Roles in scope.
SERVICE_SCOPE_ALLOWED_ROLES = ['인공지능 엔지니어', '인공지능 리서처', '데이터 사이언티스트', '데이터 분석가']

# Titles out of scope.
SERVICE_SCOPE_EXCLUDED_TITLE_PATTERNS = ['frontend|프론트엔드', 'backend|백엔드', 'web backend', 'full[- ]?stack|풀스택', 'devops', '\\bsre\\b', 'product manager',
 'product owner', 'technical product owner', 'project manager', '\\bpl\\b', '\\bpm\\b', 'operations manager',
 'strategy manager', 'business developer', 'marketer|마케터', 'growth manager|growth lead', 'designer', 'qa engineer',
 'qa engineering', 'verification engineer', 'design verification', 'service developer', 'process innovation',
 'field application engineer', 'application engineer', 'solution architect', 'security engineer', 'soc design',
 'technical operations', '\\bax manager\\b', 'talent pool', 'recruitment', 'official website', 'recruiter', '강사',
 '멘토', '전자정부', '크로스 플랫폼', '전문연구요원\\s*\\(r&d\\)', '전문연구요원 및 산업기능요원']

# Titles out of scope at low quality.
SERVICE_SCOPE_LOW_CONFIDENCE_TITLE_PATTERNS = ['^ai engineer$', '^software engineer intern(?:\\s*\\(.+\\))?$']

# Titles to review.
SERVICE_SCOPE_REVIEW_TITLE_PATTERNS = ['devops', 'full[- ]?stack|풀스택', 'frontend|프론트엔드', 'backend|백엔드', 'application engineer', 'solution architect']

# Titles never reviewed.
SERVICE_SCOPE_STRONG_EXCLUDE_TITLE_PATTERNS = ['product manager', 'product owner', 'project manager', '\\bpm\\b', '\\bpl\\b', 'business developer', 'marketer|마케터',
 'operations manager', 'strategy manager', 'designer', 'qa engineer', 'qa engineering', 'verification engineer',
 'soc design', 'recruiter', 'recruitment', 'official website', '강사', 'process innovation']

# Analyst family.
SERVICE_SCOPE_ANALYST_FAMILY_INCLUDE_PATTERNS = ['\\bcrm\\b', '\\bcx\\b', '\\bpmo\\b', 'growth', 'performance marketer', 'data analyst', 'analytics engineer',
 'business analyst', 'business insight', 'user behavior', 'monetization analyst',
 'fraud(?:\\s*&\\s*|\\s+and\\s+)?risk', '데이터 분석\\s*pm']

# AI evidence.
SERVICE_SCOPE_RECOVERABLE_AI_PATTERNS = ['\\bai\\b', '인공지능', '머신러닝', '\\bml\\b', '딥러닝', '\\bllm\\b', '\\brag\\b', '생성형', '컴퓨터\\s*비전', '의료\\s*ai',
 '\\bsamd\\b', '\\bmlops\\b']

# Deep-technology evidence.
SERVICE_SCOPE_RECOVERABLE_DEEPTECH_PATTERNS = ['자율주행', '로보틱스', '\\bnpu\\b', '\\bsoc\\b', '반도체', '\\brtl\\b', '\\bsdk\\b', '펌웨어', '임베디드']

# Data evidence.
SERVICE_SCOPE_RECOVERABLE_DATA_PATTERNS = ['데이터\\s*분석', '데이터\\s*사이언스', '\\bdata\\s*scien', '\\bdata\\s*analy', '\\banalytics?\\b', '\\ba/b\\b', '에이비\\s*테스트',
 '\\bkpi\\b', '\\bsql\\b']

# Evidence of work out of scope.
SERVICE_SCOPE_MODEL_EXCLUDE_STRONG_NON_SCOPE_PATTERNS = ['product manager|product owner|head of product', '\\bpm\\b|\\bpo\\b|\\bpl\\b', '프로덕트|제품\\s*관리',
 'designer|ux/ui|디자이너|디자인\\s*시스템|디자인\\s*업무', '영업|sales|세일즈|account executive|영업대표', '브랜드\\s*매니저|\\bmd\\b',
 '정부지원사업|행정|연구지원|사업\\s*운영', 'recruit|채용|강사|멘토', '보안점검|모의해킹|취약점']

# Titles without evidence.
SERVICE_SCOPE_LOW_EVIDENCE_TITLE_PATTERNS = ['^ai engineer$', '전문연구요원', '인재채용']

# Themes in order.
DISPLAY_CLUSTER_THEMES = [{'id': 'edge',
  'tone': 'cluster-a',
  'label': '추론 최적화 · 컴퓨팅',
  'description': '온디바이스 추론과 시스템 최적화가 중심인 회사군',
  'tokens': ['엔피유', 'npu', 'onnx', '엔피아이알', '포팅', '컴파일러', '컴파일', '컴퓨팅', '최적화', '배포']},
 {'id': 'health',
  'tone': 'cluster-b',
  'label': '헬스케어 · 진단 지원',
  'description': '의료 해석과 환자 모니터링 성격이 강한 회사군',
  'tokens': ['헬스케어', '의료', '환자', '진료', '모니터링', '영상', '병원']},
 {'id': 'data',
  'tone': 'cluster-c',
  'label': '데이터 분석 · 실험 운영',
  'description': '지표 분석과 실험 설계 비중이 높은 회사군',
  'tokens': ['데이터분석', '데이터 분석', '머신러닝', '지표', '실험', '유저', 'growth', 'crm', '분석']},
 {'id': 'industrial',
  'tone': 'cluster-d',
  'label': '산업 현장 · 설계 자동화',
  'description': '제조·설계·현장 자동화 성격이 보이는 회사군',
  'tokens': ['cad', '씨에이디', '제조', '자율제조', '주차', '공장', '로봇', '설계', '산업']},
 {'id': 'service',
  'tone': 'cluster-e',
  'label': 'AI 제품화 · 서비스 적용',
  'description': '언어·추천·검색 기반 제품 적용이 중심인 회사군',
  'tokens': ['nlp', '엘엘엠', 'llm', 'rag', '검색', '추천', '에이전트', '멀티모달', '금융', '교육']},
 {'id': 'enterprise',
  'tone': 'cluster-f',
  'label': '기업 업무 · 솔루션 구축',
  'description': '고객사 환경에 맞춘 솔루션 구축이 많은 회사군',
  'tokens': ['고객', '고객사', '솔루션', '엔터프라이즈', '업무', '자동화', '플랫폼']}]

# Company schemas in order.
CLUSTER_SCHEMAS = [{'id': 'cluster-model',
  'tone': 'tone-model',
  'label': '모델 고도화',
  'description': '모델 자체를 만들고 다듬는 채용이 많은 회사들',
  'tokens': ['멀티모달', '비전', '자연어', 'rag', '에이전트', '미세조정', '파인튜닝', '파인 튜닝', '추론', '학습', '훈련', '생성형', '추천', '검색']},
 {'id': 'cluster-platform',
  'tone': 'tone-platform',
  'label': '플랫폼 · 서빙',
  'description': '배포·서빙·파이프라인 운영 비중이 높은 회사들',
  'tokens': ['서빙', '배포', '파이프라인', 'mlops', 'llmops', '인프라', '플랫폼', '쿠버네티스', '클라우드', '데브옵스', 'devops', '온프레미스', 'api',
             'sdk', 'ci/cd', '씨아이씨디']},
 {'id': 'cluster-data',
  'tone': 'tone-data',
  'label': '데이터 · 실험',
  'description': '데이터 분석과 실험 설계 성격이 강한 회사들',
  'tokens': ['데이터 분석', '분석', '실험', '지표', '통계', '예측', 'a/b', 'ab', '대시보드', 'etl', 'warehouse', '리포팅', 'bi',
             '데이터 사이언티스트', '데이터 분석가']},
 {'id': 'cluster-domain',
  'tone': 'tone-domain',
  'label': '도메인 적용',
  'description': '제품·산업 현장 적용과 고객 문제 해결이 중심인 회사들',
  'tokens': ['광고', '추천', '검색', '금융', '교육', '게임', '커머스', '제조', '산업안전', '보안', '고객', '사업', '솔루션', '현장', '서비스']},
 {'id': 'cluster-edge',
  'tone': 'tone-edge',
  'label': '온디바이스 · 검증',
  'description': '최적화·하드웨어·검증 비중이 높은 회사들',
  'tokens': ['온디바이스', 'edge', '엔피유', 'npu', '양자화', '최적화', '컴파일러', '검증', '테스트벤치', '시뮬레이션', '하드웨어', '디바이스', 'asic',
             'rtos', '그래프']}]

# Categories that feed a section facet of the board.
SECTION_SIGNAL_STRUCTURED_MAP = {'detailBody': {'keyword': ['problemSignals', 'domainSignals'],
                'tag': ['domainSignals', 'dataSignals'],
                'context': ['systemSignals', 'workflowSignals', 'modelSignals']},
 'tasks': {'keyword': ['problemSignals', 'workflowSignals'],
           'tag': ['domainSignals'],
           'context': ['systemSignals', 'workflowSignals']},
 'requirements': {'keyword': ['modelSignals', 'systemSignals'],
                  'tag': ['domainSignals', 'dataSignals'],
                  'context': ['systemSignals']},
 'preferred': {'keyword': ['workflowSignals', 'domainSignals'],
               'tag': ['dataSignals', 'modelSignals'],
               'context': ['workflowSignals', 'systemSignals']},
 'skills': {'keyword': ['modelSignals', 'dataSignals', 'systemSignals'], 'tag': [], 'context': ['systemSignals']}}
