import posixpath
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rowcheck.llm import packing
from rowcheck.llm.queries import op11_token_files
from rowcheck.llm.packing import Encoder, PackedFile, manifest, pack, read_ids, round_trip, unpack, width, write_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  ", "a  b", "\n x y \n", "don't it's I'll  go", "<|endoftext|>", "x <|endoftext|> y a<|endoftext|>b c",
    "日本 語 a b ñ c", "a<|endoftext|>b<|endoftext", "|>x\nY.\nZ\n\nW, it's don't,'s 'll.5a", "x'sy 'S a'\n'b", "a\tb c d\r\n", "  lead a b ", "1 2 3 44 a1 b2 ' '' 's x 's", "x" * 5000, "a b " * 3000,
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def whole(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


@given(st.integers(1, 32), st.integers(0, 300), st.randoms())
@settings(deadline=None, max_examples=60)
def test_ids_come_back_at_every_width(bits, count, rng):
    ids = np.array([rng.randrange(1 << bits) for _ in range(count)], "<u4")
    data = pack(ids, bits)
    a, b = sorted((rng.randint(0, count), rng.randint(0, count)))
    assert len(data) == -(-count * bits // 8)
    assert unpack(data, bits, a, b).tolist() == ids[a:b].tolist()


def test_the_width_is_the_least():
    assert [width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        pack(np.array([8]), 3)


PARTS = ("a", "b", "Z", " ", "  ", "'", "s", "\n", "\t", "1", "é", "日", ".", ",", "<|endoftext|>", "<|", "text|>", "ll", "\u00a0")


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), max_size=8))
@settings(deadline=None, max_examples=200)
def test_ids_are_those_of_the_library(encoder, texts):
    texts = [*texts, *ODD, *texts]
    ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [whole(encoder, t) for t in texts]


def expected(encoder, rows, end=0):
    """Rows by doc_id; those of one id are compared as a set by their ids alone."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*whole(encoder, text), end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_over_whole_texts(spark, encoder):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op11_token_files(spark, sf).collect())) == expected(encoder, rows)


def test_files_blocks_and_documents(spark, encoder, tmp_path, monkeypatch):
    """Files of many blocks, read at random; ids narrower than bytes; every document where the manifest says it begins."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((0, 3, 900))))) for k in range(200)]
    rng.shuffle(rows)
    folder = str(tmp_path / "ids")
    write_ids(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, None)
    listed, at = manifest(folder), 0
    rows.sort()
    assert listed["bits"] == 16
    for f in listed["files"]:
        file = PackedFile(posixpath.join(folder, f["name"]))
        assert (file.n_ids, file.n_docs, f["first"]) == (f["ids"], f["docs"], sum(len(whole(encoder, t)) for _, t in rows[:at]))
        for k in rng.sample(range(file.n_docs), min(5, file.n_docs)):
            assert file.doc_ids[k] == rows[at + k][0] and file.document(k).tolist() == whole(encoder, rows[at + k][1])
        at += file.n_docs
    assert at == len(rows)
    monkeypatch.setattr(packing, "BLOCK", 64)
    place = str(tmp_path / "one.ids")
    writer = packing.PackedWriter(pa.OSFile(place, "wb"), 11)
    ids = [np.array([rng.randrange(2048) for _ in range(n)], "<u4") for n in (0, 5, 64, 700, 0, 1)]
    for k, x in enumerate(ids):
        writer.add(None if k == 2 else k, x)
    writer.close()
    file, flat = PackedFile(place), np.concatenate(ids).tolist()
    assert [file.document(k).tolist() for k in range(6)] == [x.tolist() for x in ids] and file.nulls.tolist()[2]
    for _ in range(40):
        a, b = sorted((rng.randint(0, len(flat)), rng.randint(0, len(flat))))
        assert file.ids(a, b).tolist() == flat[a:b]


def test_odd_rows_and_one_write_a_folder(spark, encoder, tmp_path):
    """Null ids last, null texts without ids of their own, repeated rows each by itself, clashing names not read; a second write is refused."""
    rows = [(2, None), (1, "a b"), (None, "c"), (1, "a b"), (3, ""), (7, " ".join(ODD))]
    odd = spark.createDataFrame([(i, t, 1, "x", 5) for i, t in rows], "doc_id int, text string, mark int, ids string, start int")
    got = [tuple(r) for r in round_trip(odd, PATH).orderBy("start").collect()]
    assert got == expected(encoder, [rows[1], rows[3], rows[0], rows[4], rows[5], rows[2]])
    assert round_trip(odd.where("false"), PATH).count() == 0
    folder = str(tmp_path / "ids")
    write_ids(odd, folder, PATH)
    with pytest.raises(Exception, match="already"):
        write_ids(odd, folder, PATH)
    assert read_ids(spark, folder).count() == len(rows)


def test_files_no_manifest_names_are_not_read(spark, tmp_path):
    """What a repeated task leaves neither counts nor stays."""
    folder = tmp_path / "ids"
    folder.mkdir()
    (folder / "000000-0000-left.ids").write_bytes(b"half a file")
    write_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(folder), PATH)
    assert not (folder / "000000-0000-left.ids").exists()
    assert [r["doc_id"] for r in read_ids(spark, str(folder)).collect()] == [1]
