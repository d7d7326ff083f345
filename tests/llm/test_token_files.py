"""Binary files of token ids: the codec, and what is read back from files."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame

from lodestone.llm import rans
from lodestone.llm.token_files import Parts, read_files, write_files

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 1000, 300_001, rans.BLOCK + 7])
def test_files_give_back_all_ids(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    counts = np.array([n // 3, 0, n - n // 3])
    file = rans.File(rans.encode_file(np.array([5, 6, 7]), counts, ids))
    assert (file.ids() == ids).all() and file.n_ids == n
    assert file.doc_ids.tolist() == [5, 6, 7] and file.counts.tolist() == counts.tolist()
    assert n == 0 or int(file.table.freq.sum()) == 1 << rans.SCALE


def test_a_file_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 400_000), 2_000).astype(np.uint32)
    share = np.bincount(ids) / len(ids)
    bits = -np.sum(share[share > 0] * np.log2(share[share > 0])) * len(ids)
    assert len(rans.encode_file(np.array([0]), np.array([len(ids)]), ids)) * 8 < 1.1 * bits


@pytest.mark.parametrize("kinds", [1, 2, 60_000])
def test_tables_of_few_and_many_symbols(kinds):
    ids = np.concatenate([np.arange(kinds), np.zeros(5_000)]).astype(np.uint32)
    assert (rans.File(rans.encode_file(np.array([1]), np.array([len(ids)]), ids)).ids() == ids).all()


def test_decoding_starts_at_any_checkpoint():
    ids = np.random.default_rng(2).integers(0, 900, 700_000).astype(np.uint32)
    file = rans.File(rans.encode_file(np.array([1]), np.array([len(ids)]), ids))
    marks = int(file.records[0]["marks"])
    assert marks > 2
    size = rans.EVERY * int(file.records[0]["lanes"])
    for k in reversed(range(marks)):
        assert (file.segment(0, k) == ids[k * size : (k + 1) * size]).all()


def test_damage_is_found():
    ids = np.arange(5_000, dtype=np.uint32) % 77
    good = rans.encode_file(np.array([1]), np.array([len(ids)]), ids)
    for at in (3, 20, 45, len(good) // 2, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises((rans.Broken, zlib.error)):
            rans.File(bytes(bad)).ids()
    with pytest.raises(rans.Broken):
        rans.File(good[:-3]).ids()


def coded(rows):
    """(doc_id, n_tokens, crc) of each row, by the library."""
    texts = [t or "" for _, t in rows]
    for (i, _), e in zip(rows, library().encode_batch(texts, add_special_tokens=False)):
        yield i, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())


@pytest.mark.parametrize("file_ids", [1 << 22, 3_000])
def test_read_back_is_the_librarys(spark, documents, file_ids):
    odd = ["a  b   c    d", "a \n b \n\n  c ", " ", "   ", "\t \t", "x   y　 z \x85 q", "\x1c \x1d x", "don't I'LL we've", "<|endoftext|> x", " lead", "trail ", "٣٤ ½ Ⅷ", "# #", "é ‍"]
    rows = documents + [(10**7 + k, t) for k, t in enumerate(odd)] + [(77, "same")] * 40 + [(77, f"other {k}") for k in range(40)]
    got = read_files(write_files(frame(spark, rows), PATH, file_ids=file_ids)).withColumn("crc", F.crc32("ids")).collect()
    assert Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == Counter(coded(rows))
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_every_character_is_cut_as_the_library_does():
    import pyarrow as pa

    own, parts = library(), Parts(open(PATH, encoding="utf-8").read())
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a {c} b{c} {c}c" for c in chars[k : k + 500]) for k in range(0, len(chars), 500)]
    ids, counts = parts.stretch(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in own.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_parts_go_to_the_library_as_lines_of_a_text():
    parts = Parts(open(PATH, encoding="utf-8").read())
    own = [" " + x for x in ["a", "word,", "'s", "won't've", ".", "...'", "<|endoftext|>", "\u00e9\u00e0", "\U0001f600", "12,5", "\x00", "\u200b", "a\u0301", *(f"w{k}" for k in range(230))]]
    own += [x[1:] for x in own]
    texts, plain = [], parts.library

    class Counting:
        encode = staticmethod(plain.encode)

        @staticmethod
        def encode_batch_fast(given, **more):
            texts.extend(given)
            return plain.encode_batch_fast(given, **more)

    parts.library = Counting
    for given in (own[: len(own) // 2], own[len(own) // 2 :]):
        texts.clear()
        ids, counts = parts.encode_lines(given)
        assert len(texts) == 3
        want = [plain.encode(x, add_special_tokens=False).ids for x in given]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_parts_stay_alone_where_a_line_feed_is_no_token():
    parts = Parts(open(PATH, encoding="utf-8").read())
    plain = parts.library

    class Joining:
        """A library that drops line feeds inside of texts."""

        @staticmethod
        def encode(x, **more):
            return plain.encode(x, **more)

        @staticmethod
        def encode_batch_fast(given, **more):
            return plain.encode_batch_fast([x.replace("\n", "") for x in given], **more)

    parts.library = Joining
    ids, counts = parts.encode_lines(["ab", "cd,", "e"])
    want = [plain.encode(x, add_special_tokens=False).ids for x in ("ab", "cd,", "e")]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_no_rows(spark):
    assert read_files(write_files(frame(spark, []), PATH)).collect() == []


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", 9, "x", 4, "y")], "doc_id long, text string, digest int, row string, part int, data string")
    assert [(r.doc_id, r.start) for r in read_files(write_files(rows, PATH)).collect()] == [(1, 0)]
