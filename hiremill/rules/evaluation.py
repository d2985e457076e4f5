"""Fixed values of review waves, anomaly families and quality gates."""

# Deep-technology evidence.
FAMILY_DEEPTECH = ['로봇', '로보틱스', '자율주행', '컴퓨터 비전', '\\bvision\\b', '\\bvlm\\b', '\\bllm\\b', '임베디드', '\\bnpu\\b', '반도체', '제어', '미들웨어']

# Business context.
FAMILY_BUSINESS = ['\\bcrm\\b', '\\bcx\\b', '\\bpmo\\b', 'growth', 'marketing', '재무', '손익', '\\bfp&a\\b', 'finance', '광고', '매출', '퍼널',
 '리텐션', '캠페인']

# Business dominance.
FAMILY_BUSINESS_DOMINANCE = ['\\bcrm\\b', '\\bcx\\b', '\\bpmo\\b', 'growth', 'marketing', '재무', '손익', '\\bfp&a\\b', 'finance', '매출', '퍼널', '리텐션',
 '캠페인', '광고 성과 분석', '고객 관계 관리', '제품 성장 분석', '그로스 마케팅']

# Tools as focus.
TOOL_FOCUS_LABELS = ['onnx', 'pytorch', 'tensorflow', 'sql', 'docker', 'kubernetes', 'cad', 'excel', '엑셀', '도커', '쿠버네티스']

# Severity per family.
FAMILY_SEVERITY = {'excluded_leaked_into_display': 'high',
 'deeptech_in_data_analyst': 'high',
 'deeptech_context_present': 'info',
 'business_in_engineer_family': 'high',
 'business_context_present': 'info',
 'tool_first_focus': 'high',
 'service_scope_review_in_display': 'high',
 'broad_focus_specificity_gap': 'medium'}

# Broad focus labels.
FAMILY_BROAD_FOCUS = ['클라우드', '인프라', '시스템 아키텍처', '데이터 파이프라인', '플랫폼']

# Signals that do not make a focus specific.
SPECIFICITY_BLOCKLIST = ['클라우드', '인프라', '플랫폼', '시스템', '아키텍처', '데이터']

# Broad focus labels of a review wave.
WAVE_BROAD_FOCUS = ['AI', 'API', 'MLOps', 'SQL', 'TensorFlow', 'PyTorch', '데이터 분석', '딥러닝', '머신러닝', '소프트웨어', '인프라', '클라우드', '컴퓨터 비전',
 '프로그래밍']

# Particles at the end of a word.
PARTICLE_SUFFIXES = ('을', '를', '이', '가', '은', '는', '의', '에', '와', '과', '로', '도', '만', '및')

# Banned keyword terms.
WAVE_BANNED_TERMS = ['위한', '또는', '대한', '통한', '학력', '학사', '석사', '박사', '경력', '제품', '서비스', '기술', '업무', '별도', '미기재', '채용', '모집', '영입', '공고명',
 '공고문']

# Hiring words.
HIRING_TERMS = ['채용', '모집', '영입', '전문연구요원', 'talent pool', 'full stack', '공고문', '계약직', '신입', '경력']

# Generic keywords.
WAVE_GENERIC_KEYWORDS = ['단위', '단계부터', '전반을', '별도', '우대사항', '미기재', '공고문', '직무내용', '사용자', '인간']

# Focus hints of suggestions.
SUGGESTION_FOCUS_HINTS = [('rag', 'RAG'), ('검색증강생성', 'RAG'), ('llm', 'LLM'), ('엘엘엠', 'LLM'), ('nlp', 'NLP'), ('엔엘피', 'NLP'), ('onnx', 'ONNX'),
 ('오엔엔엑스', 'ONNX'), ('npu', 'NPU'), ('컴파일러', '컴파일러'), ('객체 인식', '객체 인식'), ('얼굴인식', '얼굴인식'), ('위조', '위조 판별'),
 ('영상처리', '영상 처리'), ('컴퓨터 비전', '컴퓨터 비전'), ('컴퓨터비전', '컴퓨터 비전'), ('생체신호', '생체신호'), ('심전도', '심전도'), ('의료', '의료 데이터'),
 ('임상', '의료 데이터'), ('로봇', '로보틱스'), ('강화 학습', '강화학습'), ('강화학습', '강화학습'), ('서빙', '모델 서빙'), ('serving', '모델 서빙'),
 ('파이프라인', '데이터 파이프라인'), ('mlops', 'MLOps'), ('엠엘옵스', 'MLOps'), ('클라우드', '클라우드'), ('api', 'API'), ('검색', '검색'),
 ('추천', '추천'), ('자율주행', '자율주행'), ('검증', '검증')]

# Openings cut from a summary.
SUMMARY_CLEANUPS = (('^[•·\\\\-\\\\s]+', ''), ('^&\\\\s*', ''), ('^(는|를|을|이|가|및)\\\\s+', ''), ('^크게\\\\s+', ''), ('합니다\\\\.?$', ''),
 ('수행합니다\\\\.?$', ''), ('담당합니다\\\\.?$', ''), ('담당하게 됩니다\\\\.?$', ''), ('개발합니다\\\\.?$', '개발'), ('구축합니다\\\\.?$', '구축'),
 ('설계합니다\\\\.?$', '설계'), ('개선합니다\\\\.?$', '개선'), ('운영합니다\\\\.?$', '운영'), ('평가합니다\\\\.?$', '평가'),
 ('주도합니다\\\\.?$', '주도'), ('모집$', ''), ('채용$', ''), ('영입$', ''))

# Broad focus labels of gold candidates.
GOLD_BROAD_FOCUS = ['LLM', '파이프라인', 'PyTorch', 'TensorFlow', 'SQL', '컴퓨터 비전', '클라우드', '의료', '마케팅', '인사이트']

# Terms per domain.
GOLD_DOMAIN_TERMS = {'심전도': 'medical',
 '생체신호': 'medical',
 'EMR': 'medical',
 '의료': 'medical',
 '헬스케어': 'medical',
 '로봇': 'robotics',
 '로보틱스': 'robotics',
 '강화 학습': 'robotics',
 '시뮬레이션': 'robotics',
 '자율주행': 'autonomy',
 '컴퓨터 비전': 'vision',
 'VLM': 'vision',
 'RAG': 'llm',
 'LLM': 'llm',
 '그로스 마케팅': 'growth',
 '리텐션': 'growth',
 'CRM': 'growth',
 '제품 성장 분석': 'product-analytics',
 'A/B 테스트': 'product-analytics',
 '디지털 농업': 'agri',
 '농업 데이터': 'agri',
 '클라우드': 'cloud',
 'AWS': 'cloud'}

# Sentence endings.
SENTENCE_ENDINGS = ('합니다', '됩니다', '있습니다', '하세요', '십시오', '입니다')

# Banned keyword patterns.
KEYWORD_BANNED_PATTERNS = ['\\b(위한|또는|대한|통한|관련)\\b', '\\b(학력|학위|학사|석사|박사|경력)\\b', '\\b(제품|서비스|기술|업무)\\b']

# AI-adjacent work.
AI_ADJACENT = ('\\bai\\b', '인공지능', '머신러닝', '\\bml\\b', '딥러닝', '\\bllm\\b', '\\brag\\b', '생성형', '컴퓨터\\s*비전', '자율주행', '로보틱스',
 '\\bnpu\\b', '\\bsoc\\b', '반도체', '의료\\s*ai', '\\bsamd\\b', '\\bmlops\\b')

# Data-adjacent work.
DATA_ADJACENT = ('데이터\\s*분석', '데이터\\s*사이언스', '\\bdata\\s*scien', '\\bdata\\s*analy', '\\banalytics?\\b', '\\ba/b\\b', '에이비\\s*테스트',
 '\\bkpi\\b', '\\bsql\\b')

# Work out of scope.
ADJACENT_NON_SCOPE = ('product manager|product owner|head of product', '\\bpm\\b|\\bpo\\b|\\bpl\\b', '프로덕트|제품\\s*관리',
 'designer|ux/ui|디자이너|디자인\\s*시스템|디자인\\s*업무', '영업|sales|세일즈|account executive|영업대표', '브랜드\\s*매니저|\\bmd\\b',
 '정부지원사업|행정|연구지원|사업\\s*운영', 'recruit|채용|강사|멘토', '보안점검|모의해킹|취약점')

# Strong AI context.
STRONG_AI_CONTEXT = ['\\bai\\b', '인공지능', '머신러닝', '딥러닝', '\\bllm\\b', '\\brag\\b', '컴퓨터\\s*비전', '\\bnpu\\b', '\\bsoc\\b', '\\brtl\\b',
 '\\bsdk\\b', '드라이버', '펌웨어', '의료\\s*ai', '의료\\s*영상', '생체신호', '데이터\\s*(분석|사이언스|수집|품질|거버넌스|시스템|파이프라인|처리|모델|엔지니어)',
 '(고객|유저|사용자|서비스|비즈니스)\\s*데이터', '실험', '\\ba/b\\b', '실시간\\s*데이터', '제조\\s*ai']

# Peripheral AI.
PERIPHERAL_AI = ['인공지능\\s*기반\\s*개발\\s*도구', 'ai\\s*기반\\s*개발\\s*도구', '생산성\\s*향상', '\\bcopilot\\b']

# Little information.
LOW_INFORMATION = ['정보\\s*부족', '직무\\s*정보\\s*부족', '상세\\s*내용\\s*없음']
