from collections import Counter

import pytest

from lodestrata.llm.mixing import mixed, ranked

DOCS = "doc_id long, source string, text string, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, "big", "word " * (5 + i % 40), "x") for i in range(900)] + [(2000 + i, "small", "word " * (10 + i), "x") for i in range(40)] + [(3000, "unlisted", "word", None), (3001, None, "word", None), (3002, "small", None, None), (3003, "small", "", None)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_limits(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2)], TARGETS)
    mixture, report = mixed(corpus(spark), targets)
    times = Counter((r.source, r.doc_id) for r in mixture.collect())
    by = {r.source: r for r in report.collect()}
    assert {s for s, _ in times} == {"big", "small"}
    assert max(n for (s, _), n in times.items() if s == "small") <= 3 and max(n for (s, _), n in times.items() if s == "big") == 1
    assert by["absent"].actual_share == 0 and by["absent"].n_docs == 0
    # without the source that has no documents, the shares are 5 to 3
    assert abs(by["big"].actual_share - 0.625) < 0.01 and abs(by["small"].actual_share - 0.375) < 0.01
    assert by["small"].copies == pytest.approx(3) or by["big"].copies == pytest.approx(1)
    again = Counter((r.source, r.doc_id) for r in mixed(corpus(spark), targets)[0].collect())
    assert again == times


def test_fixed_total_and_cap(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("small", None, 9), (None, 0.5, 1)], TARGETS)
    _, report = mixed(corpus(spark), targets, total_tokens=10**7)
    assert {r.source: r.copies for r in report.collect()} == {"big": 1.0, "small": 2.0}


def test_ranks_match_a_plain_sort(spark):
    sized = corpus(spark).filter("text is not null").selectExpr("coalesce(source, '-') as source", "doc_id", "length(text) as n_tokens")
    got = {(r.source, r.doc_id): r["rank"] for r in ranked(sized, 5).collect()}
    rows = sorted((r.source, r.n_tokens, r.doc_id) for r in sized.collect())
    seen = Counter()
    for s, _, d in rows:
        assert got[s, d] == seen[s]
        seen[s] += 1


def test_empty(spark):
    targets = spark.createDataFrame([("big", 0.5, 1)], TARGETS)
    mixture, report = mixed(corpus(spark).limit(0), targets)
    assert mixture.count() == 0 and [r.actual_share for r in report.collect()] == [0.0]
    assert mixed(corpus(spark), targets.limit(0))[0].count() == 0
