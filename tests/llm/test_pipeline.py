import random

import corpus_pipeline
from riskweave.llm import host_rules, source_mix
from tests.llm.cases import covered, texts, words
from tests.llm.test_repeats import _classes


def test_stages_do_what_their_operators_say(spark, tmp_path):
    rows = [(i if i % 13 else None, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts(6, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = host_rules.quality_rules(first).where("kept")
    assert kept[0].count() == good.count() > 0
    survivors = kept[0].collect()
    assert kept[1].count() == len(set(_classes(survivors)))
    before = kept[1].collect()
    split = [words(r.text) for r in before]
    want = sorted(len(w) - sum(g) for w, g in zip(split, covered(split, 35), strict=True))
    assert sorted(len(words(r.text)) for r in kept[2].collect()) == want
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())
    sized = kept[2].withColumn("size", source_mix.sizes(kept[2].text))
    assert kept[3].count() == sum(len(r.shards) for r in source_mix.mix(sized).collect())
    assert kept[4].count() == kept[3].count() and all(r.same for r in kept[4].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


def test_columns_of_the_same_names_are_the_users(spark, tmp_path):
    """Columns called like those that the operators add keep their values and decide nothing."""
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows = []
    for i in range(40):
        text = say(60) if i % 4 else say(5)
        rows.append((i, text, "en", f"s{i % 3}", len(text), i % 2 == 0, -i, -5, f"d{i}", i, "mine", 7 * i))
    own = "kept boolean, size int, target int, decoded string, taken int, same string, shard int"
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {own}")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        left = {x.doc_id for x in docs.collect()}
        assert not k or left <= before
        before = left  # noqa: F841
        if k == 0:
            assert left == {i for i in range(40) if i % 4}
    for x in docs.collect():
        i = x.doc_id
        assert (x.kept, x.size, x.target, x.decoded, x.taken, x.same, x.shard) == (i % 2 == 0, -i, -5, f"d{i}", i, "mine", 7 * i)
        assert x._same


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
