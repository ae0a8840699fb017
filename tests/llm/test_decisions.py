import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import host_rules, pruned_graph, source_mix, toxicity_neighbours, url_trees
from riskweave.llm.queries import URL_RULES
from tests.llm.cases import documents, empty, rows_of, texts, words

# --- quality rules -----------------------------------------------------------------------------


def test_base_rules_by_their_definitions(spark):
    rows = texts(5) + ["a b\nc\n\nc\n \n \na b\n#*$%", "x y z " * 30, "p q r s t u v w " * 2 + "x " * 20]
    docs = documents(spark, rows)
    want = []
    for r in docs.collect():
        w = words(r.text)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        gone = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        want.append((r.doc_id, r.n_words, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", r.text or "")),
                     len(lines) - len(set(lines)), len(gone), len(w) < 20 or 100 * len(gone) > 30 * len(w)))
    found = host_rules.quality_rules(docs)
    names = "doc_id", "n_words", "_n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    assert rows_of(found, *names) == Counter(want)
    assert set(docs.columns) < set(found.columns) and "_kept" in found.columns
    assert host_rules.quality_rules(empty(spark)).collect() == []


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = "word " * 5, "a b c d e f g h i j k l m n o p q r s t u v"
    rows = [(i, "fine", bad) for i in range(200)] + [(i, "fine", good) for i in range(4)]
    rows += [(i, "poor", good) for i in range(90)] + [(i, "poor", bad) for i in range(30)]
    rows += [(1, "single", good), (2, None, bad), (3, None, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    judged = host_rules.quality_rules(docs, carry_text=False)
    assert "text" not in judged.columns
    host = {r.source: r for r in judged.collect()}
    assert not host["poor"].host_passes and host["fine"].host_passes and host[None].host_passes
    assert host["single"].host_passes and host["single"].host_rate < 1  # one failure is no verdict
    kept = judged.where("kept").groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept} == {"fine": 200, None: 2}


# --- mixing ------------------------------------------------------------------------------------


def _targets(size, weights=(3, 1, 2)):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, list(order), 1.5 * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * size[s] + 1e-9]
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * size[s]
        rest -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("block_words", [300, 1_000_000])
def test_mix_meets_its_targets(spark, block_words):
    r = random.Random(2)
    rows = [(i if i % 50 else None, r.choice(["a", "a", "a", "é", "z", "z", None, "B"]), r.randint(0, 60)) for i in range(900)]
    rows += rows[:5] + [(9999, "none", 0), (9998, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("own")).repartition(3)
    mixed = source_mix.mix(docs, block_words=block_words, shards=8)
    found = mixed.collect()
    assert len(found) == len(rows) and all(x._target == "own" for x in found)
    size, taken, target = Counter(), Counter(), {}
    for x in found:
        size[x.source] += x["size"]
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken == x["size"] * len(x.shards) <= 2 * x["size"] and all(0 <= s < 8 for s in x.shards)
    want = _targets(dict(size))
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 60
    again = source_mix.mix(docs.repartition(5), block_words=block_words, shards=8)
    assert Counter((x.doc_id, x.source, x["size"], x.taken) for x in again.collect()) == Counter(
        (x.doc_id, x.source, x["size"], x.taken) for x in found
    )
    assert source_mix.shuffled(mixed).count() == sum(len(x.shards) for x in found)
    assert source_mix.mix(docs.limit(0)).collect() == []


def test_tree_splits_quotas_exactly(spark):
    quotas = spark.createDataFrame([(0, 37), (1, 0), (2, 203), (3, 1)], "pos int, quota long")
    total = np.zeros(16)
    for row in source_mix.split_quotas(quotas, 16, 1).collect():
        assert row.ends[-1] == {0: 37, 1: 0, 2: 203, 3: 1}[row.pos] and row.ends == sorted(row.ends)
        total += np.diff([0, *row.ends])
    assert total.sum() == 241 and total.max() - total.min() <= 1


# --- URLs --------------------------------------------------------------------------------------


def test_rules_and_parts_of_addresses(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.COM/en/x?y#z", "x://www.example.com/en/1", "x://example.com/EN/",
            "x://example.com?en/", "x://example.com#f", "x://a.net/es/", "x://net/fr/a", "x://bnet/fr/a", "x://q.org/a://b", "x://É.net/fr/"]
    urls += [f"https://h{i}.example.{t}/{p}/{i}" for i in range(30) for t in ("com", "net", "org") for p in ("en", "es", "de")]
    pages = spark.createDataFrame([(i, u, f"r{i}") for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    listed = dict(URL_RULES)
    found = url_trees.judge_urls(pages, rules).collect()
    assert len(found) == pages.count()
    for r in found:
        url, host, path = r.url or "", "", ""
        if "://" in url:
            m = re.match("([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
        fits = [k for k in listed if ("." + host).endswith("." + k.split("/")[0]) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule) and r._rule == f"r{r.page_id}"
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == listed[rule])
        assert (r.score is None) == (rule is not None)
    assert url_trees.judge_urls(pages.limit(0), rules).collect() == []
    one_kind = url_trees.judge_urls(pages, rules.where("verdict = 'block'")).where("rule is null")
    assert {r.verdict for r in one_kind.collect()} == {"block"}
    assert {r.verdict for r in url_trees.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_trees_learn_lexical_signs(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        name = "".join(r.choice("0123456789" if i % 2 else "abcdef") for _ in range(12))
        part = "test" if i >= 500 else "evil" if i % 2 else "good"
        rows.append((i, f"http://{name}.{part}.t{i // 2 % 5}/p"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = [(f"{x}.t{k}/", v) for k in range(5) for x, v in (("evil", "block"), ("good", "allow"))]
    rules = spark.createDataFrame(listed, "rule string, verdict string")
    new = url_trees.judge_urls(pages, rules).where("rule is null").collect()
    assert len(new) == 100 and sum((x.verdict == "block") == (x.page_id % 2 == 1) for x in new) >= 90


# --- toxicity ----------------------------------------------------------------------------------


def test_index_finds_the_exact_neighbours():
    r = np.random.default_rng(4)
    terms, n = 30, 400
    dense = r.integers(0, 4, (n, terms)) * (r.random((n, terms)) < 0.15)
    doc, term = np.nonzero(dense)
    idf = r.uniform(1, 5, terms)
    index = toxicity_neighbours.Index(doc, term, dense[doc, term], r.integers(0, 2, n), idf)
    weight = np.where(dense > 0, (1 + np.log(np.maximum(dense, 1))) * idf, 0)
    unit = weight / np.maximum(1e-300, np.linalg.norm(weight, axis=1, keepdims=True))
    for q in range(0, n, 7):
        own = np.flatnonzero(dense[q])
        if len(own):
            best, similar = index.nearest(own, dense[q][own], 20, q)
            exact = np.round(unit @ unit[q], 12)
            exact[q] = -1
            want = np.lexsort((np.arange(n), -exact))[:20]
            want = want[exact[want] > 0]
            assert best.tolist() == want.tolist() and np.allclose(similar, exact[want], atol=1e-9)


def test_terms_are_words_and_beginnings_of_long_ones():
    body = b"Idiots, idiotic\nIDIOT (idio)\n"
    doc, term = toxicity_neighbours.terms(body, np.array([16, len(body)]))
    words, starts = term[:4].tolist(), term[4:].tolist()
    assert doc.tolist() == [0, 0, 1, 1, 0, 0] and len(set(words)) == 4
    assert starts[0] == starts[1] and starts[0] not in words


def test_a_document_has_no_say_on_itself(spark):
    """Turning the label of one example changes others' scores, but is never evidence of its own;
    many copies of one text do not make its words terms."""
    r = random.Random(3)
    say = lambda k: " ".join(r.choice("ab cd efg hi jkl mno pq rst uvw xyz".split()) for _ in range(k))
    rows = [(i, say(30) + (" vile scum" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(400 + i, "only these words were copied often") for i in range(200)] + [(3, rows[0][1]), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 400)) for i in range(600)], "doc_id long, toxic int")
    found = toxicity_neighbours.score_toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    assert not [x for x in found if x.doc_id in [e.key for e in x.evidence]]
    assert {x.predicted for x in found if x.doc_id % 4 == 0 and x.doc_id < 400 and x.doc_id != 8} == {1}
    sample = docs.join(labels, "doc_id").selectExpr("text", "toxic AS label")
    one = lambda word: toxicity_neighbours.terms(word.encode(), np.array([len(word)]))[1][0]
    kept = set(toxicity_neighbours._label_terms(sample).tolist())
    assert one("scum") in kept and one("copied") not in kept


def test_toxicity_is_learned_without_held_out_rows(spark):
    r = random.Random(8)
    say = lambda k: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + r.choice("abcdefgh") for _ in range(k))
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, say(40) + (" " + r.choice(["Scum!", "idiot,", "vile"]) + " " + say(3) if toxic else ""), f"s{i}"))
        if i < 500:
            marks.append((i, int(toxic)))
    rows += [(601, None, "x"), (602, "", "y"), (None, "idiot", "z"), (4, rows[4][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([*marks, (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    found = toxicity_neighbours.score_toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    for x in found:
        if x.doc_id is not None:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
            assert x.doc_id > 600 or x.predicted == (x.doc_id % 4 == 0)
        assert 0 <= x._score <= 1 and x.predicted == (x._score >= 0.5)
    wrong = labels.withColumn("toxic", F.when(toxicity_neighbours.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity_neighbours.score_toxicity(docs, wrong)
    assert rows_of(again, "doc_id", "_score") == Counter((x.doc_id, x._score) for x in found)
    assert {x._score for x in toxicity_neighbours.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity_neighbours.score_toxicity(docs.limit(0), labels).collect() == []


# --- nearest neighbours ------------------------------------------------------------------------


def test_neighbours_by_inner_product(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 12)) * r.uniform(0.2, 3, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, x[3].tolist()) for i in range(60)] + rows[:2]
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [None, *[1.0] * 11]), (9003, [float("nan")] * 12), (9004, [1.0]), (None, [1.0] * 12), (9005, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    ids = np.array([i for i, _ in rows[:-2]])
    all_x = np.array([v for _, v in rows[:-2]])
    old = pruned_graph.SHARD_VECTORS
    found = defaultdict(list)
    for q in pruned_graph.nearest(table, table.where("vec_id % 20 = 0")).collect():
        found[q.query_id].append((q.rank, q.vec_id, q.score))
    assert set(found) == {int(i) for i in ids if i % 20 == 0} and old == pruned_graph.SHARD_VECTORS
    hits = total = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        exact = all_x @ all_x[ids == q][0]
        order = np.lexsort((ids, -np.round(exact, 9)))
        order = order[ids[order] != q][:20]
        hits += len({g[1] for g in got} & set(ids[order].tolist()))
        total += 20
        for _, v, score in got:
            assert math.isclose(score, exact[ids == v][0], abs_tol=1e-9)
    assert hits >= 0.97 * total
    few = pruned_graph.nearest(table.where("vec_id < 5"), table.where("vec_id = 0")).collect()
    assert sorted(x.vec_id for x in few) == [1, 2, 3, 4]
    assert pruned_graph.nearest(table.limit(0), table).collect() == []
    assert pruned_graph.nearest(table, table.limit(0)).collect() == []


def test_queries_of_another_length_take_no_part(spark):
    rows = [(i, [float(i % 7 + 1), 1.0, float(i)]) for i in range(95)] + [(100 + i, [1.0] * 4) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert pruned_graph.nearest(table, table.where("vec_id >= 100")).collect() == []
    found = pruned_graph.nearest(table, table.where("vec_id >= 90")).collect()
    assert {x.query_id for x in found} == set(range(90, 95)) and len(found) == 100
    assert all(x.vec_id < 95 for x in found)


@pytest.mark.parametrize("norms", ["natural", "heavy", "extreme"])
def test_recall_over_several_shards_of_any_norms(spark, monkeypatch, norms):
    r = np.random.default_rng(11)
    x = r.normal(size=(2400, 64))
    if norms != "natural":
        x *= r.lognormal(0, 1, (2400, 1))
    if norms == "extreme":
        x[:40] *= 1e150
        x[40:80] *= 1e-150
    monkeypatch.setattr(pruned_graph.index, "__defaults__", (900,))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shards = pruned_graph.index(pruned_graph.usable(table, "vec_id", "embedding"), 21)
    assert shards.count() >= 3
    hits, asked = 0, range(0, 2400, 20)
    found = defaultdict(set)
    for q in pruned_graph.nearest(table, table.where("vec_id % 20 = 0")).collect():
        found[q.query_id].add(q.vec_id)
    for q in asked:
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-exact)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(asked)
