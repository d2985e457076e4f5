"""Fixed values of two-stage validation, release gate, triage and repair."""

# Roles a posting may have.
ALLOWED_ROLES = ['인공지능 엔지니어', '인공지능 리서처', '데이터 사이언티스트', '데이터 분석가']

# Words that are no signal.
NOISE_TERMS = ['이상이신', '있습니다', '채용절차법', '광주지사', '상세채용', '상시채용', '경력무관', '계약직', '정규직', '회사내규', '우대사항', '자격요건', '주요업무', '검수완료',
 '검수필요']

# Deep-technology evidence.
DEEPTECH_PATTERNS = ['로봇', '로보틱스', '자율주행', '컴퓨터\\s*비전', '\\bvision\\b', '\\bvlm\\b', '\\bllm\\b', '임베디드', '\\bnpu\\b', '반도체', '제어',
 '미들웨어']

# Business context.
BUSINESS_CONTEXT_PATTERNS = ['\\bcrm\\b', '\\bcx\\b', '\\bpmo\\b', 'growth', 'marketing', '그로스', '마케팅', '퍼널', '리텐션', '캠페인', '지표', '대시보드',
 '\\bbi\\b']

# Business focus that dominates a posting.
BUSINESS_DOMINANCE_PATTERNS = ['\\bcrm\\b', '\\bcx\\b', '\\bpmo\\b', 'growth', 'marketing', '그로스\\s*마케팅', '제품\\s*분석', '제품\\s*성장\\s*분석',
 '광고\\s*성과\\s*분석', '고객\\s*관계\\s*관리', '퍼널', '리텐션', '캠페인']

# Data engineering titles.
DATA_ENGINEERING_TITLE_PATTERNS = ['\\bdata\\s+analytics\\s+engineer\\b', '\\banalytics\\s+engineer\\b', '\\bdata\\s+analyst\\b',
 '\\bdata\\s+engineer\\b', '\\bdata\\s+platform\\b', '\\bdata\\s+service\\b', '\\betl\\b', '\\bdw\\b',
 '\\bbi\\s*/?\\s*dw\\b', '\\bbusiness\\s+intelligence\\b', '\\bproduct\\s+analyst\\b', '데이터\\s*엔지니어', '데이터\\s*분석가',
 '데이터\\s*플랫폼', '데이터\\s*서비스', '데이터\\s*마트', '데이터\\s*웨어\\s*하우스', '데이터\\s*웨어하우스', '비즈니스\\s*인텔리전스', '제품\\s*분석가']

# Analytics titles.
DATA_ANALYTICS_TITLE_PATTERNS = ['\\bdata\\s+analytics\\s+engineer\\b', '\\banalytics\\s+engineer\\b', '\\bdata\\s+analyst\\b',
 '\\bbusiness\\s+intelligence\\b', '\\bproduct\\s+analyst\\b', '\\bbi\\s*/?\\s*dw\\b', '데이터\\s*분석가', '제품\\s*분석가']

# Evidence of AI work.
AI_DOMINANCE_PATTERNS = ['\\bai\\b', '\\bml\\b', '\\bllm\\b', '\\bvlm\\b', '\\bros\\b', '\\bisaac\\b', 'robotics', 'simulation', 'autonomous',
 '인공지능', '머신러닝', '딥러닝', 'mlops', '엠엘옵스', '검색증강생성', '로봇', '로보틱스', '모델\\s*(학습|서빙|최적화|평가|검증)', '모델\\s*서빙', '모델\\s*최적화',
 '컴퓨터\\s*비전', '멀티모달', 'AI\\s*반도체', '\\bnpu\\b', '\\bgpu\\b']

# Clinical science.
CLINICAL_SCIENCE_PATTERNS = ['clinical\\s+research\\s+scientist', '임상\\s*연구', '의료\\s*영상']

# Columns of the candidate sheet.
STAGE2_FIELDNAMES = ['공고키', '변경해시', '검증상태', '검증우선순위', '이슈코드', '이슈요약', 'stage1_분류직무', 'stage2_분류직무', 'stage1_직무초점', 'stage2_직무초점',
 'stage1_핵심기술', 'stage2_핵심기술', 'stage1_구분요약', 'stage2_구분요약', '회사명_표시', '공고제목_표시', '공고URL', '최종발견시각', '검증메모', '승인여부']

# Approval spellings of the gate.
GATE_APPROVED = ['승인', 'approved', 'true', 'yes', 'y', '1']

# States that block a release.
BLOCKING_STATES = ['stage2_missing', 'stage2_stale', 'stage2_unreadable', 'quality_issue']

# Issue codes that never block.
NON_BLOCKING_ISSUES = ['role_diff', 'focus_diff', 'keywords_diff', 'summary_diff', 'business_context_in_ai_role',
 'data_engineering_ai_context', 'data_engineering_ai_title_context', 'summary_too_short']

# Columns of the deploy sheet.
DEPLOY_FIELDNAMES = ['공고키', '변경해시', '분류직무', '직무초점', '핵심기술', '구분요약', '회사명_표시', '공고제목_표시', '공고URL', '최종발견시각', '승인여부', '검증메모']

# Evidence patterns and the keyword they suggest, in order.
REPAIR_KEYWORDS = [('\\bpython\\b|파이썬', 'Python'), ('\\bsql\\b|에스큐엘', 'SQL'), ('\\bspark\\b|스파크', 'Spark'),
 ('\\bairflow\\b|에어플로', 'Airflow'), ('\\bkafka\\b|카프카', 'Kafka'), ('\\bdbt\\b|디비티', 'dbt'),
 ('\\bbigquery\\b|빅쿼리', 'BigQuery'), ('\\btableau\\b|태블로', 'Tableau'), ('\\bsuperset\\b|슈퍼셋', 'Superset'),
 ('\\bkubernetes\\b|쿠버네티스', 'Kubernetes'), ('\\bdocker\\b|도커', 'Docker'), ('\\baws\\b|에이더블유에스', 'AWS'),
 ('\\bgcp\\b|지씨피', 'GCP'), ('\\bazure\\b|애저', 'Azure'), ('\\bmlops\\b|엠엘옵스', 'MLOps'),
 ('machine\\s*learning|머신\\s*러닝|머신러닝', '머신러닝'), ('\\bai\\b|인공지능', 'AI'), ('\\bllm\\b|엘엘엠', 'LLM'),
 ('\\brag\\b|검색증강생성', 'RAG'), ('\\bvlm\\b|브이엘엠', 'VLM'), ('\\bpytorch\\b|파이토치', 'PyTorch'),
 ('\\btensorflow\\b|텐서플로', 'TensorFlow'), ('컴퓨터\\s*비전|컴퓨터비전', '컴퓨터비전'), ('멀티모달', '멀티모달'), ('\\bgpu\\b|지피유', 'GPU'),
 ('\\bnpu\\b|엔피유', 'NPU'), ('\\bcuda\\b|씨유디에이', 'CUDA'), ('\\bros\\b', 'ROS'), ('isaac', 'Isaac Sim'),
 ('로봇|로보틱스', '로보틱스'), ('자율주행|adas', '자율주행'), ('심전도|생체신호', '생체신호'), ('의료|임상|헬스케어|SaMD', '헬스케어'),
 ('보안|security|offensive|취약점', '보안'), ('pcie|pcb|fpga|rtl|soc|반도체', 'AI반도체'),
 ('digital\\s*design|design\\s*engineer', '디지털설계'), ('high[-\\s]*speed|io\\s*ip|interface', 'High-Speed IO'),
 ('\\bip\\s*design\\b|ip\\s*설계', 'IP 설계'), ('데이터\\s*마트|웨어\\s*하우스|웨어하우스|\\bdw\\b', '데이터웨어하우스'),
 ('이티엘|\\betl\\b|이엘티|\\belt\\b', 'ETL'), ('react\\s*native', 'React Native'), ('mobile|모바일', '모바일앱'),
 ('생산\\s*계획|스케줄링|scheduling|scheduler', '스케줄링'), ('제조|production', '제조최적화'),
 ('\\bqa\\b|quality|품질|test\\s*automation|테스트\\s*자동화|테스트자동화', 'QA'), ('testing|테스트', '검증'),
 ('리스크|risk|fraud|부정', '리스크분석')]

# Evidence patterns and the focus they suggest, first match wins.
REPAIR_FOCUS = [('로봇|로보틱스|isaac|ros|simulation', '로보틱스 / 시뮬레이션'), ('자율주행|adas', '자율주행 / 시스템'), ('심전도|생체신호', '생체신호 / 헬스케어'),
 ('임상|의료|헬스케어|SaMD', '헬스케어 / 의료데이터'), ('pcie|pcb|fpga|rtl|soc|npu|gpu|반도체', 'AI반도체 / 하드웨어'),
 ('digital\\s*design|design\\s*engineer', 'AI반도체 / 하드웨어'), ('high[-\\s]*speed|io\\s*ip|interface', 'AI반도체 / 하드웨어'),
 ('데이터\\s*마트|웨어\\s*하우스|웨어하우스|\\bdw\\b|etl|이티엘', '데이터플랫폼 / ETL'),
 ('bi|business intelligence|대시보드|지표|analytics', 'BI / 지표분석'), ('react\\s*native|mobile|모바일', '모바일앱 / 프론트엔드'),
 ('machine\\s*learning|머신\\s*러닝|머신러닝|\\bai\\b|인공지능', '모델링 / 최적화'), ('생산\\s*계획|스케줄링|scheduling|scheduler', '최적화 / 제조'),
 ('\\bqa\\b|quality|품질|test\\s*automation|테스트\\s*자동화|테스트자동화', 'QA / 품질지표'), ('testing|테스트', '검증 / QA'),
 ('리스크|risk|fraud|부정', '리스크 / 데이터분석'), ('\\bllm\\b|엘엘엠|rag|검색증강생성', 'LLM / RAG'), ('모델\\s*서빙|serving', '모델서빙 / 인프라'),
 ('ai\\s*platform|AI\\s*플랫폼|인공지능\\s*플랫폼|AI\\s*인프라|mlops|엠엘옵스', 'AI플랫폼 / MLOps'),
 ('컴퓨터\\s*비전|컴퓨터비전|얼굴인식|위조', '컴퓨터비전 / 검증'), ('보안|security|offensive|취약점', '보안연구 / 취약점분석'),
 ('kubernetes|쿠버네티스|docker|도커|클라우드|aws|gcp|azure', '인프라 / 클라우드')]
