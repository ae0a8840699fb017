"""Texts that hashes by polynomials modulo a power of two take for equal: Thue-Morse words."""

import numpy as np
import pytest

from riskweave.llm import bag_minhash, doubling_windows, pieces, prefix_free, token_store

SCHEMA = "doc_id long, text string"


def twins(a, b, size=1024):
    """The Thue-Morse sequence over two strings, and the same with the two swapped."""
    order = [bin(i).count("1") % 2 for i in range(size)]
    return ["".join((b, a)[x] for x in order), "".join((a, b)[x] for x in order)]


@pytest.mark.parametrize("a, b, size", [("a", "b", 1024), ("ab", "ba", 2048), ("x" * 9 + "a", "x" * 9 + "b", 1024)])
def test_identities_and_windows_tell_twins_apart(a, b, size):
    one, other = (np.frombuffer(t.encode(), np.uint8) for t in twins(a, b, size))
    n = len(one)
    body = np.concatenate([one, [np.uint8(10)], other, [np.uint8(10)]])
    found = pieces.identities(body, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert (found[:, 0] != found[:, 1]).any()
    for lane in (0, 1):
        left, right = pieces.grams(body, lane).at(np.array([0, n + 1]), n)
        assert left != right


def test_windows_agree_however_they_are_worked_out():
    r = np.random.default_rng(4)
    body = np.tile(r.integers(97, 100, 3000), 2).astype(np.uint8)
    for length in (8, 9, 15, 16, 17, 100, 136, 200):
        some = pieces.grams(body).at(np.array([5, 3005]), length)
        every = pieces.grams(body).at(np.arange(len(body) - length), length)
        assert some[0] == some[1] == every[5]
        named = {}
        for i, h in enumerate(every.tolist()):
            named.setdefault(body[i : i + length].tobytes(), set()).add(h)
        assert len({h for x in named.values() for h in x}) == len(named) == sum(map(len, named.values()))


def test_short_strings_are_their_own_identity():
    texts = [b"", b"a", b"a\0", b"a\0\0", b"\0" * 8, b"\0" * 9, b"abcdefgh", b"abcdefghijklmno", b"x" * 16, b"x" * 300]
    ends = np.cumsum([len(t) for t in texts])
    body = np.frombuffer(b"".join(texts) + b"\n", np.uint8)
    found = pieces.identities(body, np.concatenate([[0], ends[:-1]]), ends)
    assert len({tuple(x) for x in found.T.tolist()}) == len(texts)


def encoded(parts, texts):
    bodies = b"".join(t.encode() + b"\n" for t in texts)
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    ids, counts = parts.encode(bodies, ends, 0)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.fixture
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def wanted(parts, texts):
    return [x.ids + [0] for x in parts.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_twins(tokenizer):
    parts = token_store.ByteParts(tokenizer)
    texts = twins("a", "b") + [" ".join(twins("a", "b")), "", "an end"]
    assert parts.parted and encoded(parts, texts) == wanted(parts, texts)
    assert encoded(parts, texts[::-1]) == wanted(parts, texts[::-1])


def test_parts_of_one_hash_are_told_apart(tokenizer, monkeypatch):
    """A hash of four values, until the third attempt."""
    plain = token_store.joint
    parts = token_store.ByteParts(tokenizer)
    monkeypatch.setattr(
        token_store, "joint", lambda a, b: plain(a, b) & np.uint64(3) if parts.salt < 3 else plain(a, b)
    )
    texts = [f"something longer number{i} anywhere" for i in range(30)]
    assert encoded(parts, texts) == wanted(parts, texts) and parts.salt >= 3


def test_other_tokenizers_get_whole_texts(tokenizer, tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    texts = ["A b.c", "", "Over  the, hill", "A b.c"]
    changes = (
        lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)),
        lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)),
        lambda t: setattr(t, "normalizer", normalizers.Lowercase()),
        lambda t: t.add_tokens(["b.c"]),
    )
    for i, change in enumerate(changes):
        other = Tokenizer.from_file(tokenizer)
        change(other)
        other.save(str(tmp_path / f"{i}.json"))
        parts = token_store.ByteParts(str(tmp_path / f"{i}.json"))
        assert not parts.parted and encoded(parts, texts) == wanted(parts, texts)


def test_windows_with_different_words_stay(spark):
    common = [f"w{i}" for i in range(34)]
    texts = [" ".join([*common[:17], word, *common[17:]]) for word in twins("a", "b")]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0].replace("w0", "v0")])), SCHEMA)
    found = doubling_windows.remove_repeated_windows(docs)
    assert {(r.doc_id, r.n_words, r.n_removed) for r in found.collect()} == {(i, 35, 0) for i in range(3)}


def test_strings_of_twins_stay(spark):
    texts = twins("a", "b", 128)
    texts = [("-" * 30 + t + "+" * 42) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found = prefix_free.remove_repeated_strings(docs)
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in found.collect()} == {(0, 200, 0), (1, 200, 0)}


def test_twins_are_no_copies(spark):
    texts = [*twins("a ", "b "), *twins("a ", "b ")[:1], *twins("a", "b")]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    bags = bag_minhash.Bags(next(made_pieces(texts)))
    named = list(zip(bags.text[0].tolist(), bags.text[1].tolist(), strict=True))
    assert named[0] == named[2] and len(set(named)) == 4
    _, found = bag_minhash.near_duplicates(docs)
    classes = {r.key: r.class_key for r in found.collect()}
    assert classes[3] != classes[4] and classes[0] == classes[2]


def made_pieces(texts):
    import pyarrow as pa

    for _, _, body, ends in pieces.runs(pa.array(texts)):
        rows = pa.array([[{"pad": 0}] * len(ends)])
        columns = [pa.array([0]), rows, pa.array([ends.tolist()]), pa.array([body], pa.binary())]
        yield pieces.Piece(pa.RecordBatch.from_arrays(columns, names=["piece", "rows", "ends", "body"]), 0)
