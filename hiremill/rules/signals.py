"""Fixed values of term canonicalisation, line cleaning, signal rules and focus choice."""

# Lines that carry no content.
SUMMARY_NOISE_PATTERNS = ['^운영시간$', '^지원 전,?\\s*확인해주세요!?$', '^읽어보면 도움 되는 관련 자료$', '^채용 관련 문의사항.*$', '^제출하신 .*', '^필요 시 .*', '^입사 후 .*',
 '^서류.*합격.*$', '^경험이 없거나.*$', '^경험 직접 작성하기$', '^경험이 있고.*$', '^로 보내주세요\\.?$', '^\\(.*로그인.*\\)$', '^\\(.*문의 가능.*\\)$',
 '^&\\s.*$', '^\\(.*\\)$']

# Noise in detail text.
DETAIL_NOISE_PATTERNS = ['^관련 분야 .*학위.*$', '^관련 분야 .*경험.*$', '^아래 분야 .*경험.*$', '^학력은 .*', '^신입 또는.*$', '^[0-9]+년 이상 .*', '^유관 업무 경력.*$',
 '^채용하고 싶은 사람.*$', '^스스로 성장.*$', '^각자의 전문성을 .*', '^해외여행에 .*', '^남성은 .*', '^취업보호대상자는 .*', '^.*우대합니다\\.?$',
 '^.*있으면 좋습니다\\.?$', '^.*필요합니다\\.?$', '^.*요구됩니다\\.?$', '^.*경험이 있어야 합니다\\.?$', '^.*역량을 갖춰야 합니다\\.?$',
 '^.*능력이 요구됩니다\\.?$']

# Noise in field lines.
FIELD_LINE_NOISE_PATTERNS = ['^직무내용$', '^공고명[:：].*$', '^\\(공고문\\).*$', '^\\(양식\\).*$', '^별도 우대사항 미기재$', '^참고해 주세요$', '^지원 전,?\\s*확인해주세요!?$',
 '^채용 관련 문의사항.*$', '^제출하신 내용에 허위 사실.*$', '^필요 시 레퍼런스 체크.*$', '^서류 검토.*최종 선발$', '^노타 채용 과정.*$', '^노타와 신규 입사자가.*$',
 '^노타는 핵심 가치.*$', '^워트만의 이야기.*$', '^인공지능: 기술 리서치의 새로운 기준.*$', '^모든 포지션에서 .*근무가 가능합니다.*$', '^을 통해 입사한 지원자.*$',
 '^로 보내주세요\\.?$', '^혜택 및 복지$', '^⏩ 채용 전형$', '^서류 전형.*$', '^정규직 채용의 경우.*$', '^전형 시 우대하고 있어요$', '^근무 환경$',
 '^초역세권 위치.*$', '^.*출근 시간 조정.*$', '^업무 몰입 지원.*$', '^워트 멤버들의 성장.*$', '^사용 언어는 .*진행되어요$']

# Fragments.
GENERIC_FRAGMENT_PATTERNS = ['^(개발|연구|수행|담당|운영|관리|구현|분석|지원|개선)합니다\\.?$', '^(개발|연구|수행|담당|운영|관리|구현|분석|지원|개선)$', '^(통합|검증|최적화|운영|관리|구축)$',
 '^요 연구 영역은 다음과 같습니다\\.?$', '^해당 직무$', '^신입 또는$', '^및$', '^등을 사용합니다\\.?$', '^찾습니다\\.?$']

# Keywords that say nothing.
GENERIC_KEYWORD_PATTERNS = ['^ai$', '^인공지능$', '^엔지니어$', '^리서처$', '^개발$', '^연구$', '^분석$', '^데이터$', '^모델$', '^기반$', '^위한$', '^또는$', '^관련$', '^경력$',
 '^신입$', '^학력$', '^학위$', '^(학사|석사|박사)$', '^전공$', '^요건$', '^자격$', '^우대$', '^필수$', '^제품$', '^서비스$',
 '^인공지능\\s*(엔지니어|리서처)$', '^ai\\s*(engineer|researcher)$', '^경험자$', '^가능자$', '^이상이신$', '^채용절차법$', '^우대합니다$',
 '^있습니다\\.?$']

# Endings of weak keywords.
WEAK_KEYWORD_SUFFIXES = ('위한', '또는', '기반', '관련', '중심', '가능', '경험', '학력', '학위')

# Labels too weak for a focus.
WEAK_FOCUS_LABEL_PATTERNS = ['^(ai|인공지능)\\s*(엔지니어|리서처|연구원|연구자)$', '^(데이터|소프트웨어)\\s*(엔지니어|리서처|사이언티스트|분석가)$', '^(엔지니어|리서처|연구원|연구자|분석가|사이언티스트)$']

# Terms too weak for a focus.
WEAK_FOCUS_LABEL_TERMS = ['사업', '소프트웨어', '데이터 처리', '처리', '분석', '개발', '연구', '엔지니어링']

# Hints that raise a focus candidate.
FOCUS_SIGNAL_HINTS = ('llm', 'rag', 'onnx', 'npu', 'gpu', 'cuda', 'triton', 'pytorch', 'tensorflow', 'kubernetes', 'docker', 'spark',
 'sql', 'python', '파이토치', '텐서플로', '컴퓨터비전', '컴퓨터 비전', '자율주행', '로봇', '의료', '헬스케어', '생체신호', '파이프라인', '서빙', '아키텍처',
 '고객 관계 관리', '마케팅', 'crm', '검증', '테스트벤치', '멀티모달', '검색', '추천', '데이터셋', '실험', '최적화', '온디바이스', '심전도', 'EMR', '그로스 마케팅',
 '제품 성장 분석', '로보틱스', '클라우드', '디지털 농업')

# Hints that keep a line.
SIGNAL_KEEP_HINTS = ('llm', 'rag', 'onnx', 'vlm', 'nlp', 'mlops', 'aws', 'linux', 'cloud', '클라우드', '파이프라인', '서빙', '컴퓨터 비전', '자율주행', '로봇',
 '로보틱스', '강화 학습', '시뮬레이션', '동작 인식', '의료', '헬스케어', '생체신호', '심전도', 'EMR', '환자 모니터링', '고객 관계 관리', 'crm', '리텐션', '퍼널',
 '코호트', '그로스', '마케팅', 'A/B 테스트', '제품 성장', '디지털 농업', '농업', 'GIS', '위성', '센서', '현장 데이터', 'BigQuery', 'SQL', 'Python',
 'PyTorch', 'TensorFlow', '실증', '검색', '추천', '멀티모달')

# Spellings and their canonical term.
CANONICAL_TERM_MAP = {'엘엘엠': 'LLM',
 'llm': 'LLM',
 '브이엘엠': 'VLM',
 'vlm': 'VLM',
 '엔엘피': 'NLP',
 'nlp': 'NLP',
 '검색증강생성': 'RAG',
 '검색 증강 생성': 'RAG',
 '엠엘옵스': 'MLOps',
 'mlops': 'MLOps',
 '오엔엔엑스': 'ONNX',
 'onnx': 'ONNX',
 '파이토치': 'PyTorch',
 'pytorch': 'PyTorch',
 '텐서플로': 'TensorFlow',
 'tensorflow': 'TensorFlow',
 '에스큐엘': 'SQL',
 'sql': 'SQL',
 '에이비 테스트': 'A/B 테스트',
 'a/b 테스트': 'A/B 테스트',
 '빅쿼리': 'BigQuery',
 'bigquery': 'BigQuery',
 '앰플리튜드': 'Amplitude',
 'amplitude': 'Amplitude',
 '에이더블유에스': 'AWS',
 'aws': 'AWS',
 '리눅스': 'Linux',
 'linux': 'Linux',
 '이엠알': 'EMR',
 'emr': 'EMR',
 '전자의무기록': 'EMR',
 '이씨지': '심전도',
 'ecg': '심전도',
 '지아이에스': 'GIS',
 'gis': 'GIS',
 '에이에이알알알': 'AARRR',
 '깃허브': 'GitHub',
 '컴퓨터비전': '컴퓨터 비전',
 '고객 관계관리': '고객 관계 관리',
 '자율 주행': '자율주행',
 '온 디바이스': '온디바이스',
 '에스디케이': 'SDK',
 '브이엘엠 솔루션': 'VLM',
 '3 비전': '3D 비전',
 '강화 학습': '강화학습'}

# Replacements inside running text, in order.
INLINE_TERM_REPLACEMENTS = [('엘엘엠', 'LLM'), ('\\bllm\\b', 'LLM'), ('브이엘엠', 'VLM'), ('\\bvlm\\b', 'VLM'), ('엔엘피', 'NLP'), ('\\bnlp\\b', 'NLP'),
 ('검색\\s*증강\\s*생성', 'RAG'), ('검색증강생성', 'RAG'), ('\\brag\\b', 'RAG'), ('엠엘옵스', 'MLOps'), ('\\bmlops\\b', 'MLOps'),
 ('오엔엔엑스', 'ONNX'), ('\\bonnx\\b', 'ONNX'), ('파이토치', 'PyTorch'), ('\\bpytorch\\b', 'PyTorch'), ('텐서플로', 'TensorFlow'),
 ('\\btensorflow\\b', 'TensorFlow'), ('에스큐엘', 'SQL'), ('\\bsql\\b', 'SQL'), ('에이비\\s*테스트', 'A/B 테스트'),
 ('a/b\\s*테스트', 'A/B 테스트'), ('빅쿼리', 'BigQuery'), ('\\bbigquery\\b', 'BigQuery'), ('앰플리튜드', 'Amplitude'),
 ('\\bamplitude\\b', 'Amplitude'), ('에이더블유에스', 'AWS'), ('\\baws\\b', 'AWS'), ('리눅스', 'Linux'),
 ('\\blinux\\b', 'Linux'), ('이엠알', 'EMR'), ('\\bemr\\b', 'EMR'), ('전자의무기록', 'EMR'), ('이씨지', '심전도'),
 ('\\becg\\b', '심전도'), ('지아이에스', 'GIS'), ('\\bgis\\b', 'GIS'), ('에이에이알알알', 'AARRR'), ('컴퓨터비전', '컴퓨터 비전'),
 ('3\\s*비전', '3D 비전'), ('고객 관계관리', '고객 관계 관리'), ('자율\\s*주행', '자율주행'), ('온\\s*디바이스', '온디바이스'), ('에스디케이', 'SDK'),
 ('깃허브', 'GitHub')]

# Text hints and focus labels, in order.
SUMMARY_HINT_LABELS = [('onnx', 'ONNX'), ('오엔엔엑스', 'ONNX'), ('llm', 'LLM'), ('vlm', 'VLM'), ('nlp', 'NLP'), ('rag', 'RAG'),
 ('검색증강생성', 'RAG'), ('하이브리드 검색', 'RAG'), ('컴퓨터 비전', '컴퓨터 비전'), ('컴퓨터비전', '컴퓨터 비전'), ('객체 인식', '객체 인식'),
 ('vslam', '3D 공간 이해'), ('자율주행', '자율주행'), ('자율 주행', '자율주행'), ('고객 관계 관리', '고객 관계 관리'), ('crm', '고객 관계 관리'),
 ('데이터 마트', '데이터 마트'), ('마트 테이블', '데이터 마트'), ('마트 데이터', '데이터 마트'), ('대시보드', '대시보드'), ('태블로', '대시보드'), ('슈퍼셋', '대시보드'),
 ('씨아이씨디', 'CI/CD'), ('릴리스 자동화', 'CI/CD'), ('모델 서빙', '모델 서빙'), ('gpu 스케줄링', '모델 서빙'), ('mlops', 'MLOps'),
 ('엠엘옵스', 'MLOps'), ('양자화', '양자화'), ('사후학습', '사후학습'), ('의료 데이터', '의료 데이터'), ('의료영상', '의료 데이터'), ('임상', '의료 데이터'),
 ('npu', 'NPU 적용'), ('파이프라인', '파이프라인'), ('테스트 자동화', '테스트 자동화'), ('시스템 아키텍처', '시스템 아키텍처'), ('아키텍처', '시스템 아키텍처'),
 ('마케팅', '마케팅'), ('의료', '의료'), ('생체신호', '생체신호'), ('심전도', '심전도'), ('헬스케어', '헬스케어'), ('실증', '실증'), ('사업 개발', '사업 개발'),
 ('fp&a', '재무 계획 분석'), ('financial planning', '재무 계획 분석'), ('손익', '재무 계획 분석'), ('재무 모델', '재무 계획 분석'),
 ('비용 편익', '재무 계획 분석'), ('process innovation', '프로세스 혁신'), ('전사 프로세스', '프로세스 혁신'), ('표준 운영 절차', '프로세스 혁신'),
 ('업무 자동화', '프로세스 혁신'), ('플랫폼 운영', '플랫폼 운영'), ('작품 운영', '플랫폼 운영'), ('웹툰 플랫폼', '웹툰 플랫폼'), ('광고 데이터', '광고 데이터'),
 ('캠페인 성과', '광고 성과 분석'), ('모델 변환', '모델 최적화'), ('연산자 호환성', '모델 최적화'), ('온디바이스', '온디바이스 최적화'), ('검색', '검색'),
 ('추천', '추천')]

# Labels from combined terms.
FOCUS_COMPOSITE_RULES = [{'label': 'LLM 해석', 'all': ['LLM'], 'any': ['작동 원리', '모델 해석', '표현 학습', '스케일링 법칙', '일반화 성능', '추론 능력', '모델 아키텍처']},
 {'label': '모델 해석', 'any': ['모델 해석', '표현 학습', '스케일링 법칙', '작동 원리']},
 {'label': 'RAG', 'any': ['RAG', '검색', '벡터 데이터베이스', '검색증강생성', '하이브리드 검색']},
 {'label': '데이터 마트', 'any': ['데이터 마트', '마트 데이터', '마트 테이블', 'mart']},
 {'label': '대시보드', 'any': ['대시보드', 'Tableau', 'Superset', 'BI', '태블로', '슈퍼셋']},
 {'label': '심전도', 'any': ['심전도', 'ECG']}, {'label': '생체신호', 'any': ['생체신호', '신호 처리', '환자 모니터링']},
 {'label': '재무 계획 분석', 'any': ['FP&A', 'Financial Planning', '손익', '재무 모델', '비용-편익', 'ROI', '실적 예측', '재무 예측']},
 {'label': '프로세스 혁신', 'any': ['Process Innovation', '전사 프로세스', '표준 운영 절차', 'SOP', '운영 표준화', '업무 자동화', 'KPI', 'OKR']},
 {'label': '플랫폼 운영', 'all': ['플랫폼'], 'any': ['운영', '프로모션', '작품 운영', '서비스 운영']},
 {'label': '웹툰 플랫폼', 'all': ['플랫폼'], 'any': ['웹툰', '웹소설', '작품 운영', '프로모션']},
 {'label': '그로스 마케팅', 'any': ['퍼포먼스 마케팅', '리텐션', '앱 스토어 최적화', '리워드', '유저 획득', '캠페인 최적화']},
 {'label': '그로스 마케팅', 'all': ['CRM'], 'any': ['리텐션', '퍼널', '코호트', '캠페인', '획득', '활성', '앱']},
 {'label': '제품 성장 분석', 'all': ['A/B 테스트'], 'any': ['제품', '사용자', '퍼널', '코호트', '성장']},
 {'label': '광고 데이터', 'all': ['광고'], 'any': ['데이터 파이프라인', '데이터 거버넌스', 'SQL', '쿼리', 'Ads Ops']},
 {'label': '광고 성과 분석',
  'all': ['광고'],
  'any': ['캠페인 성과', '캠페인 최적화', '모바일 앱 추적', '통계 분석', '데이터 시각화', 'Growth Analytics']},
 {'label': '로보틱스', 'any': ['로봇', '로보틱스', '강화 학습', '동작 인식', '로봇 제어', 'Isaac Sim', 'ROS']},
 {'label': '로보틱스', 'all': ['시뮬레이션'], 'any': ['로봇', '로보틱스', '강화 학습', '동작 인식', '제어', 'Isaac Sim', 'ROS', '자율']},
 {'label': '하이브리드 인프라', 'all': ['쿠버네티스'], 'any': ['온프레미스', '하이브리드', '다중 리전', 'GPU', '모델 서빙']},
 {'label': 'MLOps', 'any': ['MLOps', '머신러닝 메타데이터', '실험 추적', '모델 서빙', '학습 파이프라인']},
 {'label': '모델 서빙', 'any': ['모델 서빙', '서빙', '배포 시스템', 'GPU 스케줄링']},
 {'label': '클라우드', 'all': ['클라우드'], 'any': ['AWS', 'Linux', '배포', '운영', '모니터링', '서비스']},
 {'label': '디지털 농업', 'all': ['농업'], 'any': ['디지털 농업', '센서', '위성', 'GIS', '농장', '현장 데이터']},
 {'label': '컴퓨터 비전', 'any': ['컴퓨터 비전', 'VLM', '영상', '객체 인식']}, {'label': '객체 인식', 'any': ['객체 인식', '검출', '인식/분석']},
 {'label': '3D 공간 이해', 'all': ['3D'], 'any': ['실외', '공간', 'VSLAM', '예측']},
 {'label': 'NPU 적용', 'all': ['NPU'], 'any': ['적용', '접목', '런타임', '컴파일', '하드웨어']},
 {'label': '모델 최적화', 'any': ['모델 변환', '연산자 호환성', '메모리 최적화', '양자화', '컴파일']},
 {'label': '온디바이스 최적화', 'any': ['온디바이스', 'on-device', 'edge', '디바이스 기반 컴파일']},
 {'label': '의료 데이터', 'any': ['의료 데이터', '의료영상', '임상', '환자 데이터', '의료 AI']},
 {'label': '트래킹', 'any': ['이벤트 트래킹', '트래킹', '로그 품질']}, {'label': 'CI/CD', 'any': ['CI/CD', '씨아이씨디', '릴리스 자동화']},
 {'label': '양자화', 'any': ['양자화', 'quantization']}, {'label': '사후학습', 'any': ['사후학습', 'post-training', 'alignment']}]

# Labels worth another try.
BROAD_RETRY_FOCUS_LABELS = ['의료 데이터', '의료', 'LLM', '마케팅', '퍼포먼스 마케팅', '인사이트', '진단', '파이프라인', 'ONNX', 'TensorFlow', 'PyTorch', 'SQL', 'SDK',
 'API', 'GPU', '고객 관계 관리', 'CRM']

# Broad labels.
BROAD_FOCUS_LABEL_TERMS = ['의료 데이터', 'LLM', '파이프라인', '마케팅', '의료', '검색', '추천', '데이터 분석', '인사이트', 'ONNX', 'TensorFlow', 'PyTorch', 'SQL', 'SDK',
 'API', 'GPU', '고객 관계 관리', 'CRM']

# Keywords that support a focus.
FOCUS_KEYWORD_SUPPORT_RULES = {'생체신호': [(['신호 처리'], '신호 처리'), (['노이즈', '노이즈 제거'], '노이즈 제거'), (['신뢰도 평가'], '신뢰도 평가')],
 '심전도': [(['의료 데이터'], '의료 데이터'), (['임상', 'emr'], '임상 데이터'), (['코호트'], '코호트 구축')],
 '그로스 마케팅': [(['crm', '고객 관계 관리'], 'CRM'), (['리텐션'], '리텐션'), (['퍼포먼스', 'performance'], '퍼포먼스 마케팅'),
             (['a/b 테스트'], 'A/B 테스트')],
 '제품 성장 분석': [(['a/b 테스트'], 'A/B 테스트'), (['코호트'], '코호트 분석'), (['sql'], 'SQL'), (['bigquery'], 'BigQuery'),
              (['제품'], '제품 분석'), (['성장'], '성장 분석')],
 '재무 계획 분석': [(['손익', 'financial planning'], '손익 분석'), (['재무 모델', '비용-편익', 'roi'], '재무 모델'),
              (['예측', 'forecast'], '예측 모델링'), (['sql', '엑셀', 'excel'], '재무 데이터')],
 '프로세스 혁신': [(['erp'], 'ERP'), (['crm'], 'CRM'), (['kpi', 'okr'], '성과 관리'),
             (['업무 자동화', '표준 운영 절차', 'sop'], '업무 자동화')],
 '플랫폼 운영': [(['플랫폼'], '플랫폼 운영'), (['프로모션'], '프로모션'), (['작품 운영'], '작품 운영')],
 '웹툰 플랫폼': [(['웹툰', '웹소설'], '콘텐츠 운영'), (['프로모션'], '프로모션'), (['sql', '태블로'], '운영 데이터')],
 '광고 데이터': [(['광고'], '광고'), (['데이터 파이프라인', '거버넌스'], '데이터 파이프라인'), (['sql'], 'SQL')],
 '광고 성과 분석': [(['광고'], '광고'), (['캠페인', 'campaign'], '캠페인 최적화'), (['a/b 테스트', '통계 분석'], 'A/B 테스트'), (['sql'], 'SQL')],
 '로보틱스': [(['강화학습', '강화 학습'], '강화학습'), (['동작 인식'], '동작 인식'), (['시뮬레이션', 'isaac sim', 'ros'], '시뮬레이션')],
 '모델 최적화': [(['onnx'], 'ONNX'), (['양자화', 'quantization'], '양자화'), (['컴파일'], '컴파일러'), (['온디바이스', 'edge'], '온디바이스')],
 '온디바이스 최적화': [(['onnx'], 'ONNX'), (['양자화', 'quantization'], '양자화'), (['모델 변환', '최적화'], '모델 최적화')],
 '디지털 농업': [(['gis', '위성', '센서'], '농업 데이터 분석'), (['온보딩', '현장'], '현장 온보딩'), (['컨설팅'], '기술 컨설팅')],
 '컴퓨터 비전': [(['생성형 ai', 'generative ai'], '생성형 AI'), (['시공간'], '시공간 데이터'), (['3d'], '3D 비전'), (['vlm'], 'VLM')],
 '클라우드': [(['aws'], 'AWS'), (['linux', '리눅스'], '리눅스')],
 'RAG': [(['llm'], 'LLM'), (['nlp'], 'NLP'), (['mlops'], 'MLOps'), (['pytorch'], 'PyTorch')]}

# Tools.
TOOL_LIKE_KEYWORDS = ['SQL', 'BigQuery', 'PyTorch', 'TensorFlow', 'AWS', '리눅스', 'MLOps', 'EMR', 'VLM', 'NLP', 'LLM', '벡터 데이터베이스']

# Signal rules per category, in order.
STRUCTURED_SIGNAL_RULES = {'domainSignals': [{'label': '의료', 'patterns': ['의료', '헬스케어', '병원', '환자', '임상']},
                   {'label': '재무', 'patterns': ['재무', 'financial planning', '손익', '회계', 'roi']},
                   {'label': '금융', 'patterns': ['금융', '핀테크', 'fintech', 'fraud', '리스크']},
                   {'label': '교육', 'patterns': ['교육', 'edtech', '에듀']},
                   {'label': '광고', 'patterns': ['광고', 'adtech', 'campaign']},
                   {'label': '커머스', 'patterns': ['커머스', 'commerce', '이커머스', '상품']},
                   {'label': '콘텐츠', 'patterns': ['웹툰', '웹소설', '콘텐츠', '작품']},
                   {'label': '자율주행', 'patterns': ['자율주행', '자율 주행']},
                   {'label': '로보틱스', 'patterns': ['로보틱스', 'robotics', '로봇']},
                   {'label': '디지털 농업', 'patterns': ['디지털 농업', '농업', 'gis', '위성', '농장']},
                   {'label': '제조', 'patterns': ['제조', '공장', '산업 안전', '산업안전']}],
 'problemSignals': [{'label': 'RAG', 'patterns': ['rag', '검색증강생성', '벡터 데이터베이스', 'retrieval']},
                    {'label': '검색', 'patterns': ['검색', 'search']}, {'label': '추천', 'patterns': ['추천', 'recommend']},
                    {'label': '객체 인식', 'patterns': ['객체 인식', 'object detection']},
                    {'label': '3D 공간 이해', 'patterns': ['3d', 'vslam', 'isaac sim', '공간 이해']},
                    {'label': '심전도', 'patterns': ['심전도', 'ecg']}, {'label': '생체신호', 'patterns': ['생체신호', '신호 처리']},
                    {'label': '음성인식', 'patterns': ['음성인식', 'speech']},
                    {'label': '모델 해석', 'patterns': ['모델 해석', '표현 학습', '스케일링 법칙', '동작 원리', '내부 구조 분석']},
                    {'label': '제품 성장 분석', 'patterns': ['제품 성장', '퍼널', '코호트', 'aarrr', 'aarr', '실험 분석']},
                    {'label': '그로스 마케팅', 'patterns': ['그로스 마케팅', '퍼포먼스 마케팅', 'crm', '리텐션', '캠페인 운영']},
                    {'label': '재무 계획 분석',
                     'patterns': ['fp&a', 'financial planning', '손익', '비용-편익', '재무 모델', '재무 예측']},
                    {'label': '프로세스 혁신',
                     'patterns': ['process innovation', '전사 프로세스', '표준 운영 절차', 'sop', '업무 자동화', 'kpi', 'okr']},
                    {'label': '플랫폼 운영', 'patterns': ['플랫폼 운영', '작품 운영', '프로모션', '서비스 운영']},
                    {'label': '광고 데이터', 'patterns': ['ads ops', '광고 데이터', '광고 플랫폼', '광고 솔루션']},
                    {'label': '광고 성과 분석', 'patterns': ['캠페인 성과', '캠페인 최적화', '모바일 앱 추적', 'growth analytics']},
                    {'label': '리스크 모델링', 'patterns': ['리스크', 'fraud', '적정 한도', '이상거래']},
                    {'label': '테스트 자동화', 'patterns': ['테스트 자동화', 'testbench', '테스트벤치', '검증 자동화']},
                    {'label': '임베디드 최적화', 'patterns': ['임베디드', '포팅', '멀티 스레딩', '파이프라이닝']},
                    {'label': 'NPU 적용', 'patterns': ['npu', '엔피유', '런타임', '컴파일']},
                    {'label': '모델 최적화', 'patterns': ['모델 변환', '연산자 호환성', '메모리 최적화', '양자화']}],
 'systemSignals': [{'label': '하이브리드 인프라', 'patterns': ['하이브리드', '온프레미스', '다중 리전', '멀티 클라우드', 'gpu 서버']},
                   {'label': '클라우드', 'patterns': ['클라우드', 'aws', 'gcp', 'azure']},
                   {'label': '인프라', 'patterns': ['인프라', '클러스터', '서버', '쿠버네티스', 'kubernetes']},
                   {'label': '모델 서빙', 'patterns': ['모델 서빙', 'serving', 'gpu 스케줄링', '배포 시스템']},
                   {'label': '시스템 아키텍처', 'patterns': ['시스템 아키텍처', '아키텍처']},
                   {'label': '온디바이스', 'patterns': ['온디바이스', 'on-device', 'edge']},
                   {'label': 'API', 'patterns': [' api ', '에이피아이']}, {'label': 'SDK', 'patterns': ['sdk', '에스디케이']},
                   {'label': '컴파일러', 'patterns': ['compiler', '컴파일러', 'ir 그래프']}],
 'modelSignals': [{'label': 'LLM', 'patterns': ['llm', '엘엘엠']}, {'label': 'VLM', 'patterns': ['vlm', '브이엘엠']},
                  {'label': 'NLP', 'patterns': ['nlp', '엔엘피', '자연어']},
                  {'label': '컴퓨터 비전', 'patterns': ['컴퓨터 비전', '컴퓨터비전', 'vision ai', 'vision']},
                  {'label': '멀티모달', 'patterns': ['멀티모달', 'multimodal']},
                  {'label': 'PyTorch', 'patterns': ['pytorch', '파이토치']},
                  {'label': 'TensorFlow', 'patterns': ['tensorflow', '텐서플로']},
                  {'label': 'ONNX', 'patterns': ['onnx', '오엔엔엑스']}],
 'dataSignals': [{'label': '데이터 파이프라인', 'patterns': ['데이터 파이프라인', 'etl', '이티엘', '파이프라인']},
                 {'label': 'SQL', 'patterns': ['sql', '에스큐엘']},
                 {'label': 'BigQuery', 'patterns': ['bigquery', '빅쿼리']},
                 {'label': 'EMR', 'patterns': ['emr', '전자의무기록']},
                 {'label': '데이터 마트', 'patterns': ['데이터 마트', '마트 데이터', '마트 테이블']},
                 {'label': '의료 데이터', 'patterns': ['의료 데이터', '의료영상', '의료기기', '환자 데이터']},
                 {'label': '로그 분석', 'patterns': ['로그 분석', '로그 품질', '이벤트 로그']}],
 'workflowSignals': [{'label': 'MLOps', 'patterns': ['mlops', '엠엘옵스', '실험 추적', '메타데이터', '학습 파이프라인']},
                     {'label': 'CI/CD', 'patterns': ['ci/cd', '씨아이씨디', '릴리스 자동화']},
                     {'label': 'A/B 테스트', 'patterns': ['a/b 테스트', 'ab 테스트', '실험 설계']},
                     {'label': '모니터링', 'patterns': ['모니터링', 'monitoring']},
                     {'label': '검증', 'patterns': ['검증', '테스트벤치', 'testbench', '평가']},
                     {'label': '실증', 'patterns': ['실증']}, {'label': '배포', 'patterns': ['배포', 'deploy']}]}

# Labels kept per category.
STRUCTURED_SIGNAL_LIMITS = {'domainSignals': 4,
 'problemSignals': 5,
 'systemSignals': 4,
 'modelSignals': 4,
 'dataSignals': 4,
 'workflowSignals': 4,
 'roleSignals': 3,
 'confidenceNotes': 4}

# Categories a model may fill.
MODEL_STRUCTURED_SIGNAL_KEYS = ('domainSignals', 'problemSignals', 'systemSignals', 'modelSignals', 'dataSignals', 'workflowSignals', 'roleSignals')

# Categories that feed a section facet.
SECTION_SIGNAL_CATEGORY_MAP = {'detailBody': {'keyword': ('problemSignals', 'domainSignals'),
                'tag': ('domainSignals', 'dataSignals'),
                'context': ('systemSignals', 'workflowSignals', 'modelSignals')},
 'tasks': {'keyword': ('problemSignals', 'workflowSignals'),
           'tag': ('domainSignals',),
           'context': ('systemSignals', 'workflowSignals')},
 'requirements': {'keyword': ('modelSignals', 'systemSignals'),
                  'tag': ('domainSignals', 'dataSignals'),
                  'context': ('systemSignals',)},
 'preferred': {'keyword': ('workflowSignals', 'domainSignals'),
               'tag': ('dataSignals', 'modelSignals'),
               'context': ('workflowSignals', 'systemSignals')},
 'skills': {'keyword': ('modelSignals', 'dataSignals', 'systemSignals'), 'tag': (), 'context': ('systemSignals',)}}

# Base weight of a category in focus projection.
STRUCTURED_FOCUS_PRIORITY = [('problemSignals', 9.2), ('domainSignals', 8.1), ('dataSignals', 7.4), ('systemSignals', 6.6),
 ('workflowSignals', 5.8), ('modelSignals', 4.8)]

# Labels never projected.
RAW_SIGNAL_PROJECTION_BLOCKLIST = ['LLM', '파이프라인', '파이썬', 'PyTorch', 'TensorFlow', 'ONNX', 'SQL', 'BigQuery', '도커', '쿠버네티스', 'SDK', 'API', 'GPU']
