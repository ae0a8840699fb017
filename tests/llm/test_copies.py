import re
from collections import Counter, defaultdict

import pytest

from riskweave.llm import exact_copies
from riskweave.llm.stars import components
from tests.llm.cases import documents, empty, texts


def stripped(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def groups_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[stripped(r.text)].append(r)
    return found


CASES = texts(3) + ["a b", "ab", "a  b", "ab\n", "é é", "éé", "z" * 5000, "z " * 5000] + ["hot copy"] * 300 + ["other"] * 5


# The last digest is one that many unequal contents share.
@pytest.mark.parametrize(
    "target, digest, partitions",
    [(4 << 20, exact_copies.sha256, 3), (100, exact_copies.sha256, 40), (100, lambda content: content[:1], 7)],
)
def test_equal_texts_are_one_group(spark, target, digest, partitions):
    docs = documents(spark, CASES, partitions).cache()
    rows = docs.collect()
    want = groups_of(rows)
    found = exact_copies.exact_copies(docs, target_bytes=target, digest=digest).collect()
    assert len(found) == len(rows)
    # The table has columns n_words, kept and source of its own.
    assert Counter((r.doc_id, r.text, r.n_words, r.kept, r.source) for r in found) == Counter(
        (r.doc_id, r.text, r.n_words, r.kept, r.source) for r in rows
    )
    kept = Counter()
    for r in found:
        group = want[stripped(r.text)]
        best = min(group, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert r.group_size == len(group)
        assert r.keep_key == best.doc_id
        if r._kept:
            kept[stripped(r.text)] += 1
            assert (r.doc_id, len(r.text or "")) == (best.doc_id, len(best.text or ""))
    assert kept == Counter(dict.fromkeys(want, 1))


def test_what_stays_is_unchanged(spark):
    docs = documents(spark, CASES)
    kept = exact_copies.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(stripped(r.text) for r in kept.collect()) == Counter(dict.fromkeys(groups_of(docs.collect()), 1))
    assert exact_copies.exact_copies(empty(spark)).collect() == []


def test_other_kinds_of_keys(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", " x"), ("c", "x "), (None, "x\n")], "doc_id string, text string")
    found = exact_copies.exact_copies(docs.repartition(4)).collect()
    assert {(r.doc_id, r.keep_key, r.group_size, r.kept) for r in found} == {
        ("b", "a", 4, False), ("a", "a", 4, True), ("c", "a", 4, False), (None, "a", 4, False)
    }


def test_few_edges_are_few_tasks(spark):
    """However many partitions an exchange has, and the classes are those of the edges."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (22, 20)], "a long, b long"))
        assert found.rdd.getNumPartitions() == 1
        assert dict(found.collect()) == {**dict.fromkeys(range(1, 10), 0), 21: 20, 22: 20}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
