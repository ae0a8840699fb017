import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskweave.llm import piece_lattice, token_store
from tests.llm.cases import documents, empty, texts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def noise(seed, letters, count=800, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(count)]


def test_stored_ids_are_those_of_the_whole_texts(spark):
    docs = documents(spark)
    plain = Tokenizer.from_file(BYTES)
    want = []
    for row in docs.collect():
        ids = np.array([*plain.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((row.doc_id, ids.tobytes()))
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.frombuffer(x[1], "<u4").astype("<u2").tobytes()))
    got = sorted(token_store.store(docs, BYTES).collect(), key=lambda r: r.start)
    assert [(r.doc_id, bytes(r.ids)) for r in got] == want
    start = 0
    for row in got:
        assert (row.start, row.n_tokens) == (start, len(row.ids) // 4)
        start += row.n_tokens
    assert token_store.store(empty(spark), BYTES).collect() == []


def test_parts_encode_as_the_whole_text():
    plain, parts = Tokenizer.from_file(BYTES), token_store.ByteParts(BYTES)
    hard = ["<|endoftext|> x<|endoftext|>", "it's we'll  \n 'tis", "", " ", "\n", "a　 b  c\x1c d", "a.b,c;d e. f", "x" * 3000]
    hard += noise(2, "ab .,!?'\n\t　 é1<|>")
    for _ in range(2):  # learned, then looked up
        raw = [t.encode() + b"\n" for t in hard]
        ids, counts = parts.encode(b"".join(raw), np.cumsum([len(x) for x in raw]), 0)
        ends = np.cumsum(counts)
        for text, a, b in zip(hard, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
@pytest.mark.parametrize("limit", [10, 18])
def test_codes_are_short_prefix_free_and_decode(n, limit):
    r = np.random.default_rng(n)
    counts = (r.pareto(0.4, n) * 3).astype(np.int64).clip(1, 10**12)
    lengths = token_store.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0**-x for x in lengths.tolist()) <= 1
    ids = r.choice(n, 5000)
    code = token_store.Code(lengths)
    bits, offsets = code.pack(ids)
    assert (code.unpack(bits, offsets, len(ids)) == ids).all()


def test_unlimited_codes_have_huffman_cost():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((counts * token_store.code_lengths(counts, 18).astype(int)).sum()) == cost
    with pytest.raises(ValueError):
        token_store.code_lengths(np.ones(9, np.int64), 3)


def test_piece_ids_and_texts_are_the_library_s(spark):
    plain = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = texts() + noise(3, "ab thehe\n  éü日 x▁🙂\0zthingtheation<unk>", 300)
    docs = documents(spark, rows)
    done = piece_lattice.decode(piece_lattice.encode(docs, PIECES), PIECES)
    for row in done.collect():
        assert np.frombuffer(row.ids, "<u4").tolist() == plain.encode(row.text or "")
        assert row.decoded == (row.text or "").replace("▁", " ")
    assert piece_lattice.encode(empty(spark), PIECES).collect() == []
    clash = docs.withColumnRenamed("kept", "IDS").limit(3)
    assert "_ids" in piece_lattice.encode(clash, PIECES).columns


def _field(number, kind, value):
    raw = value if kind == 2 else value
    head = bytes([number << 3 | kind])
    return head + (bytes([len(raw)]) + raw if kind == 2 else raw)


def _unigram(path, pieces):
    """A model file with the given pieces and scores (protocol-buffer bytes)."""
    out = b""
    for name, score, kind in pieces:
        inner = _field(1, 2, name.encode()) + _field(2, 5, np.float32(score).tobytes()) + _field(3, 0, bytes([kind]))
        out += _field(1, 2, inner)
    out += _field(2, 2, _field(3, 0, b"\x01"))
    out += _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00"))
    path.write_bytes(out)


def test_unigram_paths_are_the_library_s(tmp_path):
    r = random.Random(5)
    names = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(60)}
    names |= {"▁" + x for x in list(names)[:25]} | set("abc▁")
    pieces = [("<unk>", 0, 2)] + [(x, -r.uniform(1, 9), 1) for x in sorted(names)]
    _unigram(tmp_path / "m.model", pieces)
    plain = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    rows = noise(6, "abc ?!", 400)
    ids, counts = piece_lattice.encoder(str(tmp_path / "m.model")).encode(rows)
    ends = np.cumsum(counts)
    for text, a, b in zip(rows, ends - counts, ends, strict=True):
        own, want = ids[a:b].tolist(), plain.encode(text)  # paths of equal weight may differ
        assert plain.decode(own) == plain.decode(want) and own.count(0) == want.count(0)
        assert abs(sum(plain.get_score(i) for i in own) - sum(plain.get_score(i) for i in want)) < 1e-3


def test_query_digests(spark, tmp_path):
    from riskweave.llm import queries

    docs = documents(spark, texts(4, 12)).select("doc_id", "text").where("doc_id is not null")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(BYTES)
    for row in queries.op1_token_store(spark, str(tmp_path)).join(docs, "doc_id").collect():
        if row.doc_id != 7:
            ids = np.array([*plain.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert all(r.same for r in queries.op10_piece_lattice(spark, str(tmp_path)).collect())
