import hashlib

import pytest

from riskweave.llm import bag_minhash, doubling_windows, prefix_free
from tests.llm.cases import covered, documents, empty, rows_of, texts, words


def test_repeated_windows_go(spark):
    docs = documents(spark)
    rows = docs.collect()
    split = [words(r.text) for r in rows]
    want = []
    for row, w, gone in zip(rows, split, covered(split, 35), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((row.doc_id, row.n_words, row.kept, kept, len(w), sum(gone)))
    found = doubling_windows.remove_repeated_windows(docs)
    names = "doc_id", "n_words", "kept", "text", "_n_words", "n_removed"
    assert sorted(rows_of(found, *names).elements(), key=str) == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 1000
    assert doubling_windows.remove_repeated_windows(empty(spark)).collect() == []


def test_untouched_documents_keep_their_text(spark):
    docs = spark.createDataFrame([(1, " a  b\n"), (2, None)], "doc_id long, text string")
    found = doubling_windows.remove_repeated_windows(docs, rewrite=False)
    assert rows_of(found, "doc_id", "text", "n_removed") == {(1, " a  b\n", 0): 1, (2, "", 0): 1}


@pytest.mark.parametrize("window", [1, 2, 5, 12, 13, 24, 35, 100])
def test_levels_reach_the_window_by_doubling(window):
    chain = doubling_windows.lengths(window)
    assert chain[-1] == window and all(a < b <= 2 * a for a, b in zip(chain[:-1], chain[1:], strict=True))


@pytest.mark.parametrize("length", [100, 200])
def test_repeated_strings_go(spark, length):
    rows = texts(2) + ["c" * 1500, "c" * 199, "xyz" * 150, "b" * 200, "b" * 201]
    docs = documents(spark, rows)
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    want = []
    for row, body, gone in zip(rows, raw, covered(raw, length), strict=True):
        kept = bytes(x for x, g in zip(body, gone, strict=True) if not g)
        runs = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        want.append((row.doc_id, row.kept, hashlib.sha256(kept).hexdigest(), len(body), sum(gone), runs))
    found = prefix_free.remove_repeated_strings(docs, length=length)
    got = []
    for r in found.collect():
        assert r.n_spans == len(r.spans) and r.n_removed == sum(b - a for a, b in r.spans)
        got.append((r.doc_id, r.kept, hashlib.sha256(r._kept).hexdigest(), r.n_bytes, r.n_removed, r.n_spans))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert prefix_free.remove_repeated_strings(empty(spark)).collect() == []


@pytest.mark.parametrize("length, more", [(100, 0), (200, 0), (200, 30)])
def test_the_byte_before_a_string_has_no_say(spark, length, more):
    """Copies of one passage, of which the byte before decides whether offset width - 2 is a bound."""
    import numpy as np

    width = (length - prefix_free.GRAM + 1) // 3
    r = np.random.default_rng(length)
    say = lambda n: r.integers(97, 123, n).astype(np.uint8)
    while True:
        passage, around = say(length + more), say(400)
        fronts = {}
        for before in range(97, 123):
            body = np.concatenate([around[:200], [np.uint8(before)], passage, around[200:]])
            fronts.setdefault(201 + width - 2 in prefix_free.bounds(body, width), []).append(body)
        if len(fronts) == 2:
            break
    raw = [x[0].tobytes() for x in fronts.values()]
    # Only the passage is shared.
    raw[1] = bytes(say(200)) + raw[1][200 : 201 + len(passage)] + bytes(say(200))
    want = sum(covered([raw[0], raw[1]], length), [])
    assert sum(want) == 2 * (length + more)
    docs = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(raw)], "doc_id long, text string")
    found = prefix_free.remove_repeated_strings(docs, length=length)
    spans = {r.doc_id: [list(x) for x in r.spans] for r in found.collect()}
    assert spans == {i: [[201, 201 + length + more]] for i in (0, 1)}


def _classes(rows):
    """Brute force: all pairs of texts, linked from a weighted Jaccard similarity of 0.8."""
    from collections import Counter

    bags = []
    for r in rows:
        w = words(r.text)
        n = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None)
    label = list(range(len(rows)))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and len(a.keys() & b.keys()):
                shared = sum((a & b).values())
                if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    return label


def test_near_duplicate_classes(spark):
    docs = documents(spark, texts(3, 40)[:-1])
    rows = docs.collect()
    label = _classes(rows)
    want = {}
    for r, x in zip(rows, label, strict=True):
        want.setdefault(x, []).append(r.doc_id)
    _, found = bag_minhash.near_duplicates(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r.class_uid, []).append(r.key)
        assert r.class_key == r.class_key
    assert sorted(sorted(map(str, x)) for x in got.values()) == sorted(sorted(map(str, x)) for x in want.values())
    assert max(map(len, want.values())) > 5
    kept = bag_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert bag_minhash.drop_near_duplicates(empty(spark)).collect() == []


def test_links_below_the_first_leader_are_found(spark):
    """A chain whose ends are unlike: each text is near the next one only."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        own = list(base)
        own[: 6 * k] = [f"v{i}" for i in range(6 * k)]
        rows.append(" ".join(own))
    docs = documents(spark, rows)
    _, found = bag_minhash.near_duplicates(docs)
    assert len({r.class_uid for r in found.collect()}) == 1


def test_blocks_hold_a_bounded_number_of_texts(spark):
    """Short texts that differ in one word, each its own class, next to a large class and a small cluster."""
    rows = spark.range(6000).selectExpr("id AS uid", "0L AS cluster", "id AS class_uid", "2L AS n")
    rows = rows.union(spark.range(6000, 9000).selectExpr("id", "0L", "6000L", "30 + id % 2"))
    rows = rows.union(spark.range(9000, 9020).selectExpr("id", "9000L", "id", "id - 8999"))
    placed = bag_minhash.in_blocks(rows, 0.8)
    assert "Window" not in placed._jdf.queryExecution().toString()
    placed = placed.collect()
    assert sorted(r.uid for r in placed) == list(range(9020))
    blocks = {}
    for r in placed:
        blocks.setdefault((r.cluster, r.block), []).append(r)
    assert max(map(len, blocks.values())) < 1.25 * bag_minhash.BLOCK_DOCS
    assert max(sum(r.n for r in x) for x in blocks.values()) < 1.25 * bag_minhash.BLOCK_ITEMS
    assert len({k for k in blocks if k[0] == 9000}) == 1
    assert all({r.class_uid for r in x} == {6000} for x in blocks.values() if any(r.class_uid == 6000 for r in x))


def test_overlaps_of_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)

    def block(n):
        bags = [np.unique(r.integers(0, 60, r.integers(1, 30)).astype(np.uint64)) for _ in range(n)]
        rows = [{"uid": i, "class_uid": i, "bag": x.tobytes()} for i, x in enumerate(bags)]
        kind = pa.struct([("uid", pa.int64()), ("class_uid", pa.int64()), ("bag", pa.binary())])
        return bag_minhash.Block(pa.array(rows, kind)), bags

    (a, x), (b, y) = block(40), block(25)
    want = [[len(np.intersect1d(i, j)) for j in y] for i in x]
    for many in (0, 60, 10_000):
        monkeypatch.setattr(bag_minhash, "MANY_PAIRS", many)
        assert (bag_minhash.overlaps(a, b, 7) == want).all()


def test_near_duplicate_classes_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(bag_minhash, "BLOCK_ITEMS", 500)
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(f"v{j}" if j < k else w for j, w in enumerate(base)) for k in range(0, 40, 2)]
    rows += [f"a b c d e x{i}" for i in range(30)] + ["a b c d e x1 y"] * 2
    docs = documents(spark, rows)
    want, got = {}, {}
    for r, x in zip(docs.collect(), _classes(docs.collect()), strict=True):
        want.setdefault(x, []).append(str(r.doc_id))
    for r in bag_minhash.near_duplicates(docs)[1].collect():
        got.setdefault(r.class_uid, []).append(str(r.key))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    a, b = r.integers(0, 6, 300), r.integers(0, 6, 300)
    doc, element, weight = [], [], []
    for d, w in enumerate((a, b)):
        doc += [d] * int((w > 0).sum())
        element += np.flatnonzero(w).tolist()
        weight += w[w > 0].tolist()
    slots = 8192
    s = bag_minhash.signatures(np.array(doc), bag_minhash.mix(np.array(element, np.uint64)), np.array(weight), 2, slots)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / slots) ** 0.5
