"""Personal data against Python's regular expressions on random and real texts."""

import hashlib
import random
import re
import time

from hiremill.llm import pii
from tests.llm.samples import documents, rows

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans, r = base(text), got[i]
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in range(4)]
        all_spans = [x for x in r.spans.split(",") if x]
        assert set(filter(None, listed(spans).split(","))) <= set(all_spans) and len(all_spans) == len(spans) + r.n_added
        assert all_spans == sorted(all_spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1]), int(s.split(":")[2])))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a.@-+ 1234567890()4é😀_%") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "4111 1111 1111 1111", "4111111111111111 " * 200, "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256", "a@b.c.@d.e_x@y.z", "+1 (206) 555-0100.", "+12", "a@b@c.d"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    check(documents(spark, [r for r in rows()[:-4]]))


def test_long_texts_take_linear_time(spark):
    texts = ["1" * 60_000, "a" * 60_000 + "@b.c", "a." * 30_000, "1." * 30_000, "+1" * 30_000, "1-" * 30_000 + "1", "(at)" * 10_000]
    start = time.time()
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert time.time() - start < 60


def test_added_spans_and_redaction(spark):
    text = "Write to jo (at) example (dot) com, phone (319) 555-1234, card 378282246310005 or 4111 1111 1111 1111, host 10.0.0.1. Version 1.2.3.4"
    docs = documents(spark, [(1, text, "en", "s", len(text), None, None, None, None, None), (2, "clean 2024 text 12", "en", "s", 18, None, None, None, None, None), (3, None, "en", "s", 5, None, None, None, None, None),
                             *[(10 + i, f"call +1 (206) 555-01{i:02d} or mail a{i}@example.org", "en", "s", 1, None, None, None, None, None) for i in range(30)]])
    out = pii.redact(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "clean 2024 text 12" and got[2].n_chars == 18 and got[3].text is None and got[3].n_chars == 5
    assert got[10].text == "call [PHONE] or mail [EMAIL]" and got[10].n_chars == 28
    assert "[CARD]" in got[1].text and "10.0.0.1" not in got[1].text and "4111" not in got[1].text and "555-1234" not in got[1].text
    assert pii.redact(documents(spark)).count() == len(rows())
    assert pii.find_spans(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


def test_dense_lists_take_linear_time_and_names_may_clash(spark):
    unit = "call (319) 555-1234 or +1 206 555 0100, a.b@example.org, 4111 1111 1111 1111; "
    data = [(i, unit * n, "zz", "f", 7) for i, n in enumerate((50, 100, 400))] + [(9, None, "yy", "g", 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __body string, __found string, __row int")
    start = time.time()
    out = pii.redact(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    for i, n in enumerate((50, 100, 400)):
        assert got[i].text == "call [PHONE] or [PHONE], [EMAIL], [CARD]; " * n and (got[i]["__body"], got[i]["__found"], got[i]["__row"]) == ("zz", "f", 7)
    assert got[9].text is None and got[9]["__body"] == "yy"
    spans = {r.doc_id: r.spans.count(",") + 1 for r in pii.find_spans(docs).collect() if r.spans}
    assert spans == {0: 200, 1: 400, 2: 1600}
    assert time.time() - start < 90


def test_reliabilities_follow_the_votes():
    def code(votes, shape=1):
        total = 0
        for v in votes:
            total = total * 3 + v + 1
        return total * 4 + shape

    good, bad = code([1, 1, 1, 0, 1, 0]), code([1, -1, 0, -1, -1, -1])
    model = pii.fit_counts([(0, good, 900), (0, bad, 100), (3, code([0, 1, 1, 0, 1, 0]), 40)])
    assert model.reliability["structure"] > 0.8 and model.reliability["joined"] > 0.8


def test_the_plan_has_no_python(spark):
    plan = pii.find_spans(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
