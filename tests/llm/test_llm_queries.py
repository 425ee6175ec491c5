"""Registered queries against brute force, on a driver table, on awkward rows and on empty tables."""

from __future__ import annotations

import brute
import pytest

from sitepulse.llm.queries import QUERIES

EXACT = {"op1": brute.op1, "op2": brute.op2, "op3": brute.op3, "op4": brute.op4, "op6": brute.op6, "op8": brute.op8, "op10": brute.op10}
EXACT |= {"op11": brute.op11, "op12": brute.op12, "op13": brute.op13}


def name_of(op):
    return next(n for n in QUERIES if n.startswith(op + "_"))


def rows(spark, op, tables):
    return [tuple(r) for r in QUERIES[name_of(op)](spark, tables["dir"]).collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("op", sorted(EXACT))
def test_equals_brute_force(spark, tables, op):
    want = EXACT[op](tables)
    width = len(want[0]) if want else 0
    got = [r[:width] for r in rows(spark, op, tables)] if want else rows(spark, op, tables)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op4_spans_hold_the_base_ones(spark, edge):
    for d, *_, spans in rows(spark, "op4", edge):
        text = next(x for i, x in edge["documents"] if i == d) if d is not None else None
        if d is not None and d not in (8, 9):
            base = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in brute.base_spans(text or "")]
            assert [s for s in spans.split(",") if s] == base  # no token with a checksum is planted here


def test_op5_counts_and_scores(spark, tables):
    want = {(r[0], r[2]): r for r in brute.lm(tables)}
    got = rows(spark, "op5", tables)
    assert len(got) == len(tables["documents"])
    for r in got:
        w = want[r[0], r[2]]
        assert r[:5] == w[:5]
        assert r[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        # weights are fitted on quantised probabilities
        assert r[6] == pytest.approx(w[6], rel=0.02, abs=0.05)


def test_op7_rows(spark, tables):
    got = rows(spark, "op7", tables)
    assert sorted(key(r[:1]) for r in got) == sorted(key((d,)) for d, _ in tables["documents"])
    for d, held, score, predicted in got:
        assert held == (d is not None and brute.crc(d) % 5 == 0)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    assert sorted(got, key=key) == sorted(rows(spark, "op7", tables), key=key)


def test_op9_rows(spark, tables):
    got = rows(spark, "op9", tables)
    assert sorted(key(r[:1]) for r in got) == sorted(key((d,)) for d, _ in tables["documents"])
    letters = {d: bool(x) and any(c.isalpha() for c in x) for d, x in tables["documents"]}
    for d, held, lang, score in got:
        assert held == (d is not None and brute.crc(d) % 5 == 0)
        assert 0 <= score <= 1
        if d is not None and d != 8:
            assert (lang != "und") == letters[d]
