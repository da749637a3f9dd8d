"""The audit of filters against applying all 120 orders one after the other."""

import re
from itertools import permutations

from tidemark.llm.filter_audit import audit


def brute(docs, labels):
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(i, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = set()
        out |= {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if i is not None and i > firsts.get(text, i) else set())

    rows = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, fails(i, t)) for i, t, s in docs if (s or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                removed_by[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ]
        for key in rows:
            if key[0] == part:
                rows[key][6] = removed_by[rows[key][6]]
    return {k: tuple(v) for k, v in rows.items()}


LONG = " ".join(f"w{i}" for i in range(220))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG + " X" * 10, "b"), (4, "same " * 300, None), (5, "same " * 300, ""), (2, LONG, "a"), (2, "short", "a"), (None, LONG, "a"), (None, None, None), (6, None, "b"), (7, "", "b"),
    (8, "\x0b \x0c\r\n\t", "b"), (9, LONG + " #", "c"), (10, "É" * 10 + "ABC", "c"), (11, LONG + " |", "c"), (12, "x" * 300_000, "c"), (13, "SHOUT " * 400 + "$", "c"), (14, "SHOUT " * 400 + "$", "a"), (0, "SHOUT " * 400 + "$", "zz"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, 0), (13, 1, 1), (None, 1, 1), (99, 1, 1), (14, None, 1)]


def test_every_order_as_if_applied(spark):
    docs = spark.createDataFrame([(i, t, s, "b", "E") for i, t, s in DOCS], "doc_id long, text string, source string, bits string, n string")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    rows = audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    want = brute(DOCS, LABELS)
    assert len(rows) == 600 * len({s or "" for _, _, s in DOCS}) and got == want


def test_copies_without_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "one text", "s") for i in range(2000)], "doc_id long, text string, source string")
    first = audit(docs, none).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r["kept"], r["removed"], r["unique_fails"]) for r in first] == [(1, 1999, 0)]
    assert audit(docs.limit(0), none).count() == 0
