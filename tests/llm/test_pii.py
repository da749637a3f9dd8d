"""Personal data: the base against the plain patterns, and identifiers that only their contexts tell."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.pii import KINDS, base, candidates, patterns, personal_data, scan, trusted

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(i, *m.span()) for i, k in enumerate(KINDS) for m in re.finditer(PLAIN[k], text) if holds(k, m.group())]


PART = st.sampled_from(["@", ".", "-", " ", "+", "(", ")", "a", "b.c", "x@y.de", "1", "12", "4111111111111111", "5500-0000 0000-0004", "10.0.0.1", "255.256.1.1", "+49 (30) 123456", "é", "\n", "%", "٣", "0000001", "999"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_base_is_what_the_patterns_say(text):
    assert base(text)[0] == plain(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 400_000, "1." * 400_000, "@" * 400_000, "a.b@" * 200_000, "+1" + " " * 1_000_000, "1 " * 400_000, "x@" + "a." * 300_000):
        found, wrong = base(text)
        list(candidates(text, [(a, b) for _, a, b in found] + wrong))


def test_candidates_leave_out_what_is_taken():
    text = "call (030) 555-1234, id 12345678; see 12 or +49 30 1234567 and 98765 43210."
    found, wrong = base(text)
    places = [text[a:b] for a, b in candidates(text, [(a, b) for _, a, b in found] + wrong)]
    assert places == ["(030) 555-1234", "12345678", "98765 43210"]
    assert patterns("my phone: 1234 today ok", 10, 14) == ["phone _", "my phone _", "_ today", "_ today ok", "phone _ today"]


def text_of(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def test_contexts_find_what_the_base_cannot(spark):
    seeds = [(i, f"note {chr(97 + i)}: reach me by phone under +1 (20{i % 10}) 555-01{i:02d} please", "x") for i in range(16)]
    hidden = [(100, "and now reach me by phone under (208) 555-7788 please", "x"), (101, "reach me by phone under 4111 1111 1111 1112 please", "x"), (102, "number 20855 57788 elsewhere", "x")]
    odd = [(None, None, "x"), (103, "", "x"), (100, hidden[0][1], "y"), (104, "é +1 (201) 555-0100 a@b.cd", "x"), (105, "w " * 50_000 + "a@b.cd", "x")]
    docs = spark.createDataFrame([*seeds, *hidden, *odd], "doc_id long, text string, spans string")
    rows = personal_data(docs).collect()
    assert len(rows) == len(seeds) + len(hidden) + len(odd)
    for r in rows:
        text = next((t for i, t, _ in [*seeds, *hidden, *odd] if i == r["doc_id"] and t), "")
        want = plain(text)
        assert r["base_sha256"] == hashlib.sha256(text_of(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in want) for i in range(4)]
        more = [(3, text.index("(208)"), text.index("(208)") + 14)] if r["doc_id"] == 100 else []
        assert r["n_added"] == len(more) and r["spans"] == text_of(want + more), r
    best = trusted(scan(docs)).collect()
    assert {r["kind"] for r in best} == {3} and "under _" in {r["pattern"] for r in best}


def test_patterns_that_discovered_identifiers_carry_over(spark):
    """Rounds: the second context has no seeds of its own, but nine identifiers that the first one discovers."""
    one = [(i, f"say phone {'+' if i < 30 else ''}1 (201) 555-{1000 + i}") for i in range(45)]
    two = [(100 + i, f"dial quickly 1 (201) 555-{1000 + 30 + i if i < 15 else 2000 + i}") for i in range(18)]
    docs = spark.createDataFrame(one + two, "doc_id long, text string")
    added = lambda rounds: {r["doc_id"] for r in personal_data(docs, rounds=rounds).collect() if r["n_added"]}
    assert added(1) == set(range(30, 45))
    assert added(3) == set(range(30, 45)) | set(range(100, 118))


def test_no_rows(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
