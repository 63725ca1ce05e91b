"""Ids written and read back, and the perfect hash under them."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuswarden.llm.token_files import PerfectHash, checksums, encoder, find, pack_index, write_tokens

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
STRANGE = (
    "Ünïcode  two\tblanks\n\nlines\r\n\x85 \xa0   \x1c ΣΑΣ ΟΔΟΣ İ é ́x don't I'LL <|endoftext|>x 漢字 😀😀 12345 "
    + "x" * 100 + " don 't 're a\x0bb 　 |---| $$$%%% ﬁ Å ½ The the. THE, Été, été. o'T.  <|ENDOFTEXT|> x., ..a 漢. \x01 a\x01b ١, ª. ǅ! a\u0301. \u0301."
)


def test_perfect_hash_is_minimal_and_finds_no_strangers():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    index = pack_index(keys, np.arange(len(keys)), keys % 1000, keys % 7)
    row, there = find(index, keys)
    assert there.all() and (row["shard"] == np.arange(len(keys))).all()
    strangers = np.random.default_rng(2).integers(0, 2**63, 5_000).astype(np.uint64)
    assert find(index, strangers)[1].sum() <= 2
    assert not find(pack_index(keys[:0], [], [], []), keys)[1].any()


@pytest.mark.parametrize("tokenizer, by_word", [(WORDS, True), (WORDS, False), (BYTES, False)])
def test_files_equal_direct_encoding(spark, tmp_path, tokenizer, by_word):
    rng = random.Random(3)
    own = STRANGE.split(" ")
    texts = [None, "", " ", STRANGE, STRANGE.replace("\x01", "?"), "a" * 50_000] + [" \n"[k % 2].join(rng.choices(own, k=9)) for k in range(60)]
    rows = [(k * 3 % 65, t, "x", 1) for k, t in enumerate(texts)] + [(5, "twice", "x", 1), (5, "twice", "x", 1), (None, "no id", "x", 1)]
    made = spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int")
    files = write_tokens(made, str(tmp_path / "t"), tokenizer, 2, by_word, parts=5)
    direct = Tokenizer.from_file(tokenizer)
    expected, start = [], 0
    encoded = [(d, [*direct.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    for d, ids in sorted(encoded, key=lambda x: (-1 if x[0] is None else x[0], np.array(x[1], "<u2").tobytes())):
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in checksums(files).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    raw = b"".join((tmp_path / "t" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "t")) if f.endswith(".bin"))
    assert len(raw) == 2 * start
    asked = spark.createDataFrame([(3,), (77_777,)], "doc_id long")
    read = {r["doc_id"]: r["ids"] for r in files.read(asked).collect()}
    assert read[77_777] is None and np.frombuffer(read[3], "<u4").tolist() == dict(encoded)[3]


def test_every_letter_before_a_mark():
    texts = [f"x{chr(c)}." for c in range(0x80, 0x110000) if chr(c).isalpha()] + ["TÜRKİYE BİRLİĞİ. ANKARALİ!"]
    direct, work = Tokenizer.from_file(WORDS), encoder(WORDS, None, True)()
    for k in range(0, len(texts), 4_000):
        part = texts[k : k + 4_000]
        expected = [e.ids for e in direct.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in work(part)[0]] == expected


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert checksums(write_tokens(empty, str(tmp_path / "t"), WORDS, by_word=True)).count() == 0
