import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskweave.llm.collocations import collocations, cut, numbered
from riskweave.llm.transducers import Distinct, Transducer, union


def brute(rows, least, first, longest=5, within=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= within * cand[p[i:j]]:
                        covered.add(p[i:j])
        scored = []
        for p, a in cand.items():
            if p not in covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, total[lang], -score))
    return sorted(out)


def rows_of(seed=5, n=150):
    r = random.Random(seed)
    common = "the of And a\x01 a b é日 to in Zero ABC x1 -".split(" ")
    fixed = ["new york city", "as soon as possible, then", "in order to do it well", "A B A B A B A", "ha ha ha ha ha ha ha ha"]
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t\n.,!"), ("und", "new york city new york city"), ("", "a b a b a b")]
    for i in range(n):
        words = []
        for _ in range(r.randint(1, 25)):
            words.append(r.choice(fixed) if r.random() < 0.3 else r.choice(common))
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";"]) for w in words)
        rows.append((r.choice(["en", "en", "en", "de", None]), text))
    rows += [rows[-1]] * 3 + [("en", "new york city; " * 3000)]
    return rows


@pytest.mark.parametrize(
    "least, first, within, shard_bytes, partitions", [(3, 2000, 100, 1 << 22, 3), (2, 5, 60, 300, 7), (4, 40, 100, 64, 2)]
)
def test_phrases_are_those_of_the_definition(spark, least, first, within, shard_bytes, partitions):
    rows = rows_of()
    # Clashing names do not matter: other columns are not read.
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, text string, number long, f string")
    found = collocations(docs.repartition(partitions), least=least, first=first, within=within, shard_bytes=shard_bytes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, first, within=within)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert len(want) > 10


def test_without_candidates(spark):
    docs = spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")
    assert collocations(docs).collect() == []
    assert collocations(docs.limit(0)).collect() == []
    single = spark.createDataFrame([("en", "word. " * 200)], "lang string, text string")
    assert collocations(single).collect() == []


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_transducers_hold_what_was_put_in(length):
    r = np.random.default_rng(length)
    raw = r.integers(1, 5, (400, length)).astype(np.uint32)
    parts = []
    for block in np.array_split(raw, 4):
        own = Distinct(block)
        parts.append(Transducer.unpack(Transducer.build(own.rows, own.counts()).pack()))
        rows, counts = parts[-1].rows()
        assert (rows == own.rows).all() and (counts == own.counts()).all()
    both, totals, sizes = union(parts, length)
    want = Counter(map(tuple, raw.tolist()))
    assert dict(zip(map(tuple, both.rows.tolist()), totals.tolist(), strict=True)) == want
    assert sum(sizes) == len(both.back)
    whole = Transducer.build(both.rows, totals)
    asked = r.integers(0, 7, (300, length)).astype(np.uint32)
    assert whole.compose(asked).tolist() == [want[tuple(x)] for x in asked.tolist()]


def test_equal_remainders_are_one_state():
    rows = np.array([[1, 7, 8], [1, 7, 9], [2, 7, 8], [2, 7, 9], [3, 7, 8]], np.uint32)
    layers = Transducer.build(rows, np.array([5, 5, 5, 5, 5])).layers
    assert [len(x.first) - 1 for x in layers] == [1, 2, 2]


def test_long_texts_are_cut_at_breaks():
    body = ("ab cd " * 50 + ".").encode() * 4 + b"no break at all " * 100
    parts = list(cut(body, 400))
    assert b"".join(parts) == body and max(map(len, parts)) == 1600


def test_words_of_a_shard():
    words, counts, numbers = numbered(b"B a,\tb  b\nA")
    spelt = words.arrow().to_pylist()
    assert dict(zip(spelt, counts.tolist(), strict=True)) == {b"b": 3, b"a": 2}
    assert [spelt[x - 1] if x else None for x in numbers] == [b"b", b"a", None, b"b", b"b", None, b"a"]
    assert (np.diff(words.spots().astype(np.int64)) > 0).all()
    assert len(numbered(b" ,.\n")[1]) == 0
