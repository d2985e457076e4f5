"""The fixed values of the domain on hand rows: Hangul next to Latin, ties, blanks, NULL flags."""

from pyspark.sql import functions as F

from hiremill.functions import terms as T
from hiremill.functions.text import distinct_by_canon, literal_alternatives, matches
from hiremill.operators import aggregate as E
from hiremill.operators import classify as K
from hiremill.operators import lines as L
from hiremill.operators import prepare as B
from hiremill.operators import reconcile as C
from hiremill.operators import review as R
from hiremill.operators import signals as S
from hiremill.operators import validate as D
from hiremill.sources import io as A


def one(spark, **cols):
    row = {"id": "1", "ord": 1, **cols}
    kind = lambda v: "array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string"
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(v)}" for k, v in row.items()))


def val(df, col):
    return df.select(col.alias("v")).first()["v"]


def test_split_skills(spark):
    def s(text):
        return val(one(spark, x=text), B.split_skills("x"))

    assert s("python, sql; sql/Go") == ["python", "sql", "Go"]
    assert s("python deep learning airflow") == ["python", "Deep Learning", "airflow"]
    assert s("추천 시스템") == ["추천 시스템"]
    assert s("ip design verification rtl soc") == ["IP Design Verification", "rtl", "soc"]
    assert s("") == [] and s(None) == []


def test_experience_ladder(spark):
    rows = {"": ("미기재", "unknown"), "신입/경력": ("신입", "entry"), "경력 2년+": ("경력 2년+", "junior"), "05년": ("경력 5년+", "mid"), "8 년": ("경력 8년+", "senior"), "9년": ("경력 9년+", "lead"),
            "경력": ("경력(연차 미기재)", "mid"), "무관": ("무관", "unknown")}
    df = spark.createDataFrame([(k,) for k in rows], "x string")
    a, b = B.normalize_experience("x")
    assert {r["x"]: (r["a"], r["b"]) for r in df.select("x", a.alias("a"), b.alias("b")).collect()} == rows


def test_word_border_sees_hangul(spark):
    df = spark.createDataFrame([("crm마케팅",), ("우리 CRM 팀",)], "x string")
    assert [r["v"] for r in df.select(matches(F.col("x"), [r"\bcrm\b"]).alias("v")).collect()] == [False, True]


def test_literal_families_become_substring_tests():
    assert literal_alternatives("(개발|설계)") == ["개발", "설계"]
    assert literal_alternatives(r"\bai\b") is None and literal_alternatives("a.b|c") is None


def test_distinct_by_canon_keeps_first_spelling(spark):
    assert val(one(spark, x=["B/C", "a", "bc", "", "A", "가 나"]), distinct_by_canon(F.col("x"))) == ["B/C", "a", "가 나"]


def test_signal_text_and_terms(spark):
    df = one(spark, x=" - 엘엘엠 기반   검색 증강 생성 LLM(LLM) · ", y=["파이토치", "ai", "경험", "sql", "PyTorch", "x"])
    assert val(df, T.signal_text("x")) == "LLM 기반 RAG LLM"
    assert val(df, T.canonical_terms("y", 5)) == ["PyTorch", "SQL"]


def posting(spark, **over):
    row = dict(title="Data Platform Engineer", role="인공지능 엔지니어", role_display="인공지능 엔지니어", company="가나다", focus_label="LLM", summary="RAG 검색 서비스", keywords=["LLM", "검색"],
               quality="high", detail_body="RAG 파이프라인을 구축합니다.\nsqlite 는 아닙니다.\n복지 안내", tasks=["모델 서빙 배포 시스템 개발", "채용 문의"], requirements=["학사 이상", "SQL 경험과 실험 분석"],
               preferred=[], skills=["python", "파이토치 경험", "AWS"])
    row.update(over)
    return one(spark, **row)


def test_signals_from_korean_rules(spark):
    r = S.match_signals(L.clean_posting_text(posting(spark))).first()
    assert "RAG" in r["problem_signals"] and r["problem_signals"][:2] == ["RAG", "검색"]
    assert "SQL" not in r["data_signals"]  # `sqlite` is no mention of SQL
    assert r["model_signals"][0] == "LLM" and "모델 서빙" in r["system_signals"]
    assert r["role_signals"] == ["인공지능 엔지니어"]
    low = S.match_signals(L.clean_posting_text(posting(spark, quality="low", detail_body="", tasks=[]))).first()
    assert low["problem_signals"] == [] and low["confidence_notes"] == ["low_confidence", "sparse_input_signal"]


def test_clean_lines_drop_procedure_and_degrees(spark):
    r = L.clean_posting_text(posting(spark)).first()
    assert r["c_tasks"] == ["모델 서빙 배포 시스템 개발"] and r["c_requirements"] == ["SQL 경험과 실험 분석"]
    assert r["c_skills"][1] == "PyTorch"


def test_focus_prefers_specific_over_broad(spark):
    df = posting(spark).withColumn("context_text", F.lit("온프레미스 쿠버네티스"))
    assert S.choose_focus(df).first()["chosen_focus"] not in ("", "LLM")
    assert val(df, S.override_focus(F.lit("시스템 아키텍처"), F.lit("멀티 클라우드 환경"))) == "하이브리드 인프라"
    assert val(df, S.override_focus(F.lit("로보틱스"), F.lit("손익 로봇"))) == "로보틱스"
    assert val(df, S.override_focus(F.lit("문제 해결"), F.lit("소통"))) == ""


def test_tool_cap_depends_on_what_was_kept(spark):
    df = one(spark, x=["SQL", "AWS", "NLP", "a", "b", "EMR", "c"])
    assert val(df, S.keep_with_tool_cap(F.col("x"), T.TERMS)) == ["SQL", "AWS", "NLP", "a", "b"]
    assert val(one(spark, x=["a", "b", "SQL", "AWS", "NLP", "c", "d"]), S.keep_with_tool_cap(F.col("x"), T.TERMS)) == ["a", "b", "SQL", "AWS", "c"]


def issues(spark, **over):
    row = dict(change_hash="h", role="데이터 분석가", focus="지표", keywords="SQL, 대시보드", summary="지표 분석 업무", title="분석가", company="c", detail_body="")
    row.update(over)
    return [(i["code"], i["severity"]) for i in D.quality_issues(one(spark, **row)).first()["issues"]]


def test_quality_issue_rules(spark):
    assert issues(spark) == []
    assert issues(spark, detail_body="로봇 제어") == [("deeptech_as_analyst", "high")]
    assert issues(spark, detail_body="로봇 제어", summary="CRM 캠페인 운영") == [("deeptech_as_analyst", "medium")]
    assert issues(spark, keywords="지표, 지-표") == [("duplicate_signal", "medium")]
    assert issues(spark, change_hash=None, focus="", keywords=" ", summary="ab") == [("missing_change_hash", "high"), ("missing_focus", "medium"), ("missing_keywords", "medium"), ("summary_too_short", "low")]
    ai = dict(role="인공지능 엔지니어", keywords="x1, x2", focus="초점", summary="요약 문장입니다")
    assert issues(spark, **ai, title="Data Analyst") == [("analytics_engineering_as_ai_role", "high")]
    assert issues(spark, **ai, title="Data Engineer") == [("data_engineering_as_ai_role", "high")]
    assert issues(spark, **ai, title="Data Engineer", detail_body="MLOps") == [("data_engineering_ai_context", "info")]
    assert issues(spark, **ai, title="AI Data Engineer") == [("data_engineering_ai_title_context", "info")]
    assert issues(spark, **{**ai, "focus": "CRM"}, title="기획") == [("business_role_as_ai_role", "high")]


def test_validate_pair_keeps_duplicate_left_rows_and_last_right_row(spark):
    base = dict(change_hash="h", role="데이터 분석가", focus="지표", keywords="SQL", summary="지표 분석 업무", title="t", company="c", detail_body="", job_url="", last_seen_at="")
    s1 = spark.createDataFrame([{"id": "a", "ord": i, **base} for i in (1, 2)] + [{"id": "b", "ord": 3, **base}])
    s2 = spark.createDataFrame([{"id": "a", "ord": 1, **base, "approval": "", "memo": ""}, {"id": "a", "ord": 2, **base, "role": "데이터 사이언티스트", "approval": "승인", "memo": "m"},
                                {"id": "b", "ord": 3, **base, "change_hash": "old", "approval": "승인", "memo": ""}])
    out = D.validate_pair(s1, s2).orderBy("ord").collect()
    assert [(r["state"], r["status"], r["priority"]) for r in out] == [("stage2_approved", "approved", "low")] * 2 + [("stage2_stale", "needs_review", "high")]
    assert out[0]["codes"] == ["stage2_approved", "role_diff"] and out[0]["memo"] == "m"
    assert {r["state"] for r in D.validate_pair(s1, s2, stage2_error="no access").collect()} == {"stage2_unreadable"}


def test_role_votes_with_classifier(spark):
    df = spark.createDataFrame([
        ("1", "데이터 분석가", "데이터 분석가", ["데이터 분석가"], "", "인공지능 리서처", "medium", "x", "x"), ("2", "데이터 분석가", "", [], "", "인공지능 리서처", "medium", "x", "x"),
        ("3", "데이터 분석가", "데이터 분석가", ["데이터 분석가"], "", "인공지능 리서처", "high", "x", "x"), ("4", "인공지능 엔지니어", "", [], "", "", "", "Data Scientist", "data scientist"), ("5", "", "", [], "", "", "", "x", "x")],
        "id string, raw_role string, summary_role string, role_signals array<string>, mapped_role string, classifier_role string, classifier_confidence string, title string, evidence string")
    assert [r["role_group"] for r in K.resolve_role(df).orderBy("id").collect()] == ["데이터 분석가", "인공지능 리서처", "인공지능 리서처", "데이터 사이언티스트", "기타"]


def test_overrides_expire_with_their_signature(spark):
    rows = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s1"), ("d", "s1")], "id string, signature string")
    ovr = spark.createDataFrame([("a", "s1", "exclude", "manual", "low"), ("b", "old", "exclude", "manual", "high"), ("c", "", "include", "service_scope_model_v2", "low"), ("d", "", "REVIEW", "m", "")],
                                "id string, signature string, action string, source string, confidence string")
    assert {r["id"]: r["o_action"] for r in C.resolve_overrides(rows, ovr, "scope").collect()} == {"a": "exclude", "b": None, "c": None, "d": "REVIEW"}


def test_deploy_overlay_refuses_other_keys(spark):
    import pytest

    src = spark.createDataFrame([("a", "R"), ("b", "R")], "id string, role string")
    dep = spark.createDataFrame([("a", "r!", 1), ("b", "Z", 1)], "id string, role string, ord bigint")
    assert sorted((r["role"], tuple(r["changed_fields"])) for r in C.deploy_overlay(src, dep).collect()) == [("R", ()), ("Z", ("role",))]
    with pytest.raises(Exception, match="overlay refused"):
        C.deploy_overlay(src, dep.where("id = 'a'")).collect()


def test_tri_state_flags(spark):
    df = spark.createDataFrame([("yes",), ("FALSE",), ("",), (None,), ("?",)], "x string")
    assert [r["v"] for r in df.select(R.parse_flag("x").alias("v")).collect()] == [True, False, None, None, None]


def test_snapshot_reader_and_guard(spark, tmp_path):
    import pytest

    p = tmp_path / "s.csv"
    p.write_text("﻿ 공고키 ,회사명,\n a , x ,1\n,,\nb,\"two\nlines\",\n", encoding="utf-8")
    rows = A.read_snapshot(spark, str(p), multi_line=True).orderBy("ord").collect()
    assert [(r["공고키"], r["회사명"]) for r in rows] == [("a", "x"), ("b", "two\nlines")]
    many, few = spark.range(100), spark.range(80)
    assert A.source_size_guard(few, many).first()["passed"] is False and A.source_size_guard(few, many, allow_shrink=True).first()["passed"] is True
    with pytest.raises(Exception, match="snapshot refused"):
        A.source_size_guard(few, many, strict=True).collect()


def test_keyed_store_file(spark, tmp_path):
    from pyspark.sql import types as T_

    p = tmp_path / "store.json"
    p.write_text('{"updatedAt": null, "items": {"a": {"q": "high"}, "b": {"q": "low"}}}', encoding="utf-8")
    out = A.load_keyed_store(spark, str(p), T_.StructType([T_.StructField("q", T_.StringType())]))
    assert sorted((r["id"], r["q"]) for r in out.collect()) == [("a", "high"), ("b", "low")]


def test_guarded_apply_publishes_or_rolls_back(spark, tmp_path):
    store = spark.createDataFrame([("a", "include"), ("b", "exclude")], "id string, action string")
    batch = spark.createDataFrame([("b", "review", 1)], "id string, action string, ord bigint")
    root = str(tmp_path / "ovr")
    args = (spark, root, store, batch)
    assert R.guarded_apply(*args, True, lambda t: True, dry_run=True) == "dry_run" and R.guarded_apply(*args, False, lambda t: True) == "blocked"
    assert R.guarded_apply(*args, True, lambda t: False, version="1") == "rolled_back"
    assert R.guarded_apply(*args, True, lambda t: t.count() == 2, version="2") == "published"
    assert sorted(tuple(r) for r in R.current_version(spark, root).collect()) == [("a", "include"), ("b", "review")]


def test_concurrent_and_dead_writers_leave_a_readable_version(spark, tmp_path):
    store = spark.createDataFrame([("a", "include")], "id string, action string")
    batch = lambda action: spark.createDataFrame([("a", action, 1)], "id string, action string, ord bigint")
    root = str(tmp_path / "ovr")
    assert R.guarded_apply(spark, root, store, batch("one"), True, lambda t: True) == "published"
    inner = []

    def meanwhile(t):
        inner.append(R.guarded_apply(spark, root, store, batch("two"), True, lambda t: True))
        return True

    assert R.guarded_apply(spark, root, store, batch("late"), True, meanwhile) == "refused" and inner == ["published"]
    assert R.current_version(spark, root).first()["action"] == "two"
    # A writer that died between its claim and its pointer.
    (tmp_path / "ovr" / "pointers" / "claim-3").write_text("")
    (tmp_path / "ovr" / "pointers" / "part-x").write_text("version=")
    assert R.current_version(spark, root).first()["action"] == "two"
    assert R.guarded_apply(spark, root, store, batch("three"), True, lambda t: True) == "published"
    assert R.current_version(spark, root).first()["action"] == "three"


def test_balanced_pick_is_the_sequential_pick(spark):
    import random

    from hiremill.operators import sampling as I

    rng = random.Random(4)
    for case in range(4):
        data = [(i, f"c{rng.randint(0, 9)}", rng.choice(["r0", "r0", "r0", "r1", "r2", ""]), rng.choice(["low", "medium", "high"]), [], rng.choice("ab"), rng.choice("xy")) for i in range(70)]
        target, share = 18 - 4 * case, max(4, (18 - 4 * case) // 3)
        size = {}
        for r in data:
            size[r[1]] = size.get(r[1], 0) + 1
        order = sorted(data, key=lambda r: (["low", "medium", "high"].index(r[3]), size[r[1]], -len(r[4]), r[5], r[6], r[0]))
        want, company, role = [], {}, {}
        for r in order:
            if len(want) < target and company.get(r[1], 0) < 2 and (r[2] == "" or role.get(r[2], 0) < share):
                want.append((r[0], "balanced"))
                company[r[1]], role[r[2]] = company.get(r[1], 0) + 1, role.get(r[2], 0) + 1
        taken = {i for i, _ in want}
        want += [(r[0], "fill") for r in order if r[0] not in taken][:target - len(want)]
        rows = spark.createDataFrame(data, "id bigint, company string, role_display string, quality string, keywords array<string>, focus_label string, title string")
        assert sorted(tuple(r) for r in I.balanced_pick(rows, target).collect()) == sorted(want)


def test_gold_to_overrides_refuses_provisional(spark):
    import pytest

    p = one(spark, title="t")
    g = spark.createDataFrame([("1", "include", True, "r", "")], "id string, target_scope string, requires_confirmation boolean, target_role string, reviewer_notes string").withColumn("signature", F.lit(""))
    with pytest.raises(Exception, match="provisional gold item"):
        R.gold_to_overrides(g, p, "t").collect()
    assert R.gold_to_overrides(g, p, "t", allow_provisional=True).first()["reason"] == "service scope goldset confirmed include"


def test_sparse_and_display_lines(spark):
    df = posting(spark, title="[서울] 인재 채용", detail_body="지원하기\n채용절차법 안내 전형\n모집 요강 바로가기", quality="low")
    r = L.flag_sparse_postings(df).first()
    assert r["sparse"] is True and r["duty_lines"] == 0
    shown = L.display_lines(posting(spark, tasks=["• 검색 모델 설계 및 구축", "검색 모델 설계 및 구축", "지원하기", "과천"])).first()
    assert shown["tasks"] == ["검색 모델 설계 및 구축"]


def test_quality_score_bounds(spark):
    df = posting(spark, experience="", track="", focus="", first_seen_at="bad", last_seen_at="", active=False, tasks=[], requirements=[], skills=[], title=" ")
    r = E.posting_quality(B.normalize_taxonomy(df)).first()
    assert r["quality_score"] == 28 and len(r["review_issues"]) == 7 and r["review_priority"] == "high" and r["first_seen_date"] is None


def test_fixed_values_of_the_review_and_the_market_profile(spark):
    from hiremill.operators import market as M

    flags = spark.createDataFrame([("ok",), ("o",), ("X",), (" Pass ",), (None,)], "x string")
    assert [r["v"] for r in flags.select(R.parse_flag("x").alias("v")).collect()] == [True, None, False, True, None]
    assert val(one(spark, x="a, b|a| a "), R.keyword_list("x")) == ["a, b", "a"]
    for x in ("최종합격", "혜택 및 복지", "복리후생", "재택근무", "유연출근", "간식 제공", "레퍼런스 체크", "채용절차법", "처우협의"):
        assert x in M.PROFILE.snippets
    assert len(M.PROFILE.snippets) == 21


def test_keyed_sides_count_once_and_modes_are_checked(spark):
    import pytest

    from hiremill.operators import reconcile as C

    posts = spark.createDataFrame([("a", 1, "s1", "2024", "review"), ("b", 2, "s2", "2024", "include"), ("c", 3, "s3", "2024", "review")], "id string, ord long, signature string, last_seen_at string, scope_action string")
    store = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "old"), ("b", 3, "s2"), ("b", 4, "s2")], "id string, ord long, signature string")
    targets = lambda kind, mode: [r["id"] for r in C.incremental_targets(posts, None, store, kind=kind, mode=mode).collect()]
    assert targets("scope", "stale") == ["a"] and targets("scope", "missing") == ["a", "c"] and targets("scope", "review") == ["a", "c"] and targets("scope", "all") == ["a", "b", "c"]
    assert targets("role", "stale") == ["a", "c"]
    with pytest.raises(ValueError):
        targets("role", "review")


def test_guard_off_targets(spark):
    from hiremill.operators import classify as K

    targets = {n: (d, v) for n, d, v in K.GUARD_TARGETS}
    assert targets == {"guard_recovered_rows": ("max", 0.0), "guard_recovered_high_rows": ("max", 0.0), "excluded_ai_adjacent_rows": ("max", 0.0), "excluded_high_quality_rows": ("max", 10.0),
                       "retention_rate": ("min", 0.8), "filtered_out_rate": ("max", 0.2)}


def test_large_samples_of_one_hot_key(spark):
    from hiremill.functions.rank import top_k

    rows = spark.range(5000).select((F.col("id") * 0).alias("k"), "id")
    assert sorted(r["id"] for r in top_k(rows, ["k"], [F.col("id").desc()], 1500).collect()) == list(range(3500, 5000))


def test_snapshots_of_several_files_are_numbered_in_file_order(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.csv").write_text("id,n\n" + "".join(f"a{i}-{j},{1000 * i + j}\n" for j in range(40 * (i % 3))), encoding="utf-8")
    want = [f"a{i}-{j}" for i in range(7) for j in range(40 * (i % 3))]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in (("64", "0"), ("300", "10"), ("128m", "4m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = A.read_snapshot(spark, str(tmp_path)).orderBy("ord").collect()
            assert [r["id"] for r in rows] == want and [r["ord"] for r in rows] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    rows = A.read_snapshot(spark, str(tmp_path), ord_col="n").orderBy("ord").collect()
    assert [r["id"] for r in rows] == want and rows[0]["ord"] == 1000


def test_decision_sheets_of_several_files_come_back(spark, tmp_path):
    path = str(tmp_path / "sheet")
    A.write_sheet(spark.range(500).repartition(6).select(F.col("id"), F.lit("two\nlines, \"quoted\"").alias("memo")), ["id", "memo"], path)
    back = A.read_decisions(spark, path)
    assert back.count() == 500 and {r["memo"] for r in back.collect()} == {'two\nlines, "quoted"'}
    assert [r["ord"] for r in back.orderBy("ord").collect()] == list(range(500))


def test_keyed_store_of_lines(spark, tmp_path):
    from pyspark.sql import types as T_

    p = tmp_path / "lines.json"
    p.write_text('{"id": "a", "x": "1"}\n{"x": "2"}\n{"id": "b", "x": "3"}\n', encoding="utf-8")
    rows = A.load_keyed_store(spark, str(p), T_.StructType([T_.StructField("x", T_.StringType())]), lines=True).collect()
    assert sorted((r["id"], r["x"]) for r in rows) == [("a", "1"), ("b", "3")]
