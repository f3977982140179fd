import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kindred.llm import tokens
from kindred.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "Hello world, it's fine.", "two  spaces", "line\nnext \n more\n\n end ", "tab\t tab", "x<|endoftext|>y",
    "dogs' don't. it's, end'' _a_ a_ 5th, x5. (a) a) ª.. µm ½ ²",
    "Ünï çödé ñandú ß", "日本語 テスト", "nb\xa0sp   x", "sep\x1cx \x1f y", "!!! wow!!! 123 4567 8a9 'll we'll", "\r\n a\r\n", "“quotes” – dash", "\x85 next", "é" * 50 + " " + "word " * 300,
]


def test_ids_are_those_of_the_library():
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for text in TEXTS * 2:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for case in (np.zeros(0), np.zeros(1000), rng.integers(0, 5, 20000), np.tile([7, 8, 9, 7], 500), rng.integers(0, 50257, 500)):
        ids = np.append(case, 0).astype(np.uint32)
        cut = len(ids) // 3
        lengths = [cut, 0, len(ids) - cut] if cut and ids[cut - 1] == 0 else [len(ids)]
        shard = tokens.Shard(tokens.pack(ids, np.array(lengths), 50257))
        assert (shard.decode() == ids).all()
        assert (np.concatenate([shard.decode_document(i) for i in range(len(lengths))]) == ids).all()
        for start, count in ((0, 1), (len(ids) // 2, 7), (len(ids) - 1, 1)):
            assert shard.decode_range(start, count).tolist() == ids[start : start + count].tolist()
    with pytest.raises(ValueError):
        tokens.Shard(b"nope" + bytes(30))


def test_written_and_read_back(spark, monkeypatch):
    rows = [(100 - i, t, i) for i, t in enumerate(TEXTS)] + [(50, "tie b", 0), (50, "tie a", 0), (50, "tie a", 0), (7, None, 1), (None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = scratch_path(spark, "ids")
    tokens.write_ids(df, path, PATH, shard_ids=60)
    got = sorted(tokens.read_documents(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    assert [r.doc_id for r in got] == [w[1] if w[0] else None for w in want]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    value = lambda d, ids: (d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, (value(w[1] if w[0] else None, w[2]) for w in want)))
    empty = scratch_path(spark, "ids")
    tokens.write_ids(df.limit(0), empty, PATH)
    assert tokens.read_documents(spark, empty).count() == 0


def test_grammar_goes_on_to_the_end():
    rng = np.random.default_rng(1)
    for ids in (np.tile([7, 8, 9, 7], 5000), rng.zipf(1.3, 30000) % 50000, np.repeat(rng.integers(1, 9, 900), rng.integers(1, 30, 900)), np.ones(9000), np.tile(rng.integers(1, 50000, 99), 90)):
        ids = ids.astype(np.uint32)
        rules, left = tokens.repair(ids, 50257)
        pairs = Counter((a, b) for a, b in zip(left.tolist(), left[1:].tolist(), strict=False) if a)
        assert len(rules) + 50257 == 65536 or max(pairs.values()) < tokens.LEAST_COUNT
        assert (tokens.Shard(tokens.pack(ids, np.array([len(ids)]), 50257)).decode() == ids).all()


def test_crc_of_parts():
    data = np.random.default_rng(0).bytes(5000)
    for cuts in ([0, 5000], [0, 1, 4999, 5000], [0, 17, 17, 900, 5000]):
        parts = [(z - a, zlib.crc32(data[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]
        assert tokens.joined_crc(parts) == zlib.crc32(data)


def test_long_texts_and_a_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 50)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = ["".join(rng.choice(list("abé,."), rng.integers(1, 6))) for _ in range(rng.integers(1, 200))]
        text = rng.choice([" ", "\n", "  "]).join(words) + " ".join(words)
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_clashing_columns_and_null_rows(spark):
    rows = [(1, "a b", 1, 2, 3), (1, "a b", 1, 2, 3), (None, None, None, None, None)]
    path = scratch_path(spark, "ids")
    tokens.write_ids(spark.createDataFrame(rows, "doc_id long, text string, tie int, row int, part int"), path, PATH)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.read_documents(spark, path).collect())
    assert got == [(0, None, 1), (1, 1, 3), (4, 1, 3)]


def test_texts_are_cut_some_at_a_time():
    class Counting(tokens.Encoder):
        sizes: list[int] = []

        def encode_batch(self, texts):
            self.sizes.append(sum(map(len, texts)))
            return super().encode_batch(texts)

    encoder, texts = Counting(PATH), [f"word{i} and more" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], ["doc_id", "text"])
    got = [(k, ids.tolist()) for k, ids in tokens._encoded(encoder, batch, 100)]
    assert max(encoder.sizes) < 100 + max(map(len, texts)) and len(encoder.sizes) > 5
    assert got == [(k, ids.tolist()) for k, ids in tokens._encoded(encoder, batch)]
