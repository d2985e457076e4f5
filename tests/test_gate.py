"""Release gate on hand rows: happy path, duplicate keys, missing fields, roles outside the domain."""

import pytest

from hiremill.operators import validate as D


def candidate(key="job-1", change_hash="hash-1", **over):
    row = {
        "id": key, "change_hash": change_hash, "status": "approved", "priority": "pass", "codes": ["stage2_approved"], "issue_summary": "",
        "stage1_role": "인공지능 엔지니어", "stage2_role": "인공지능 엔지니어", "stage1_focus": "모델 서빙", "stage2_focus": "모델 서빙",
        "stage1_keywords": "Python, PyTorch", "stage2_keywords": "Python, PyTorch", "stage1_summary": "모델 서빙 플랫폼 개발",
        "stage2_summary": "모델 서빙 플랫폼 개발", "company": "회사", "title": "AI Engineer", "job_url": "u", "last_seen_at": "2026-04-12T00:00:00Z",
        "approval": "승인", "memo": ""}
    row.update(over)
    return row


def gate(spark, rows):
    rows = [{"ord": i, **r} for i, r in enumerate(rows)]
    c = spark.createDataFrame(rows)
    n = len(rows)
    report = spark.createDataFrame([("metric", k, v) for k, v in (("stage1Rows", n), ("stage2Rows", n), ("candidateRows", n), ("removedFromStage1", 0))]
                                   + [("state", "stage2_approved", n)], "section string, key string, n bigint")
    out = {r["name"]: r for r in D.release_gate(c, D.deployable_rows(c), report).collect()}
    assert len(out) == 13
    return out, [k for k, r in out.items() if not r["passed"]]


def test_happy_path(spark):
    _, blockers = gate(spark, [candidate("job-1", "h1"), candidate("job-2", "h2", stage2_role="데이터 사이언티스트")])
    assert blockers == []


def test_duplicate_key_blocks(spark):
    out, blockers = gate(spark, [candidate("job-1", "h1"), candidate("job-1", "h2")])
    assert blockers == ["candidateKeysUnique"] and out["candidateKeysUnique"]["actual"] == "2"


def test_missing_field_blocks(spark):
    out, blockers = gate(spark, [candidate(stage1_focus="", stage2_focus="")])
    assert blockers == ["deployFieldsComplete"] and out["deployFieldsComplete"]["actual"] == "1"


def test_role_outside_domain_blocks(spark):
    out, blockers = gate(spark, [candidate(stage1_role="마케터", stage2_role="마케터")])
    assert blockers == ["deployRolesAllowed"] and out["deployRolesAllowed"]["actual"] == "1"


@pytest.mark.parametrize("approval,expected", [("1", 1), ("승인", 1), ("no", 0)])
def test_gate_knows_more_approvals_than_validation(spark, approval, expected):
    c = spark.createDataFrame([{"ord": 1, **candidate(approval=approval)}])
    assert D.deployable_rows(c).count() == expected


def test_sheet_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from hiremill.sources import io as A

    c = spark.createDataFrame([{"ord": 1, **candidate()}]).withColumn("codes", F.array(F.lit("stage2_pending"), F.lit("role_diff")))
    sheet = D.candidate_sheet(c)
    path = str(tmp_path / "sheet")
    A.write_sheet(sheet, sheet.columns, path)
    back = D.read_candidate_sheet(A.read_decisions(spark, path)).first()
    assert back["codes"] == ["stage2_pending", "role_diff"] and back["id"] == "job-1" and back["memo"] == ""
