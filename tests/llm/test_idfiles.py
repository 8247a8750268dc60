"""Files of packed ids: bits, random access, damage, and the query against the library."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from common_rows import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marquee.llm import idfiles, registry

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_bits_come_back(width, values):
    ids = np.array(values, "<u4") & np.uint32((1 << width) - 1)
    packed = idfiles.pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert (idfiles.unpack_bits(packed, len(ids), width) == ids).all()
    as_number = sum(int(x) << (i * width) for i, x in enumerate(ids))
    assert int.from_bytes(packed.tobytes(), "little") == as_number


@pytest.mark.parametrize("size, width", [(1, 1), (2, 1), (3, 2), (256, 8), (257, 9), (50257, 16), (65537, 17)])
def test_width(size, width):
    assert idfiles.width_of(size) == width


def test_random_access_and_damage(tmp_path):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 1, 7, 64, 500, 3, 0, 200)]
    path = f"{tmp_path}/a/x.ids"
    writer = idfiles.IdWriter(path, 16, 64)
    for n, ids in enumerate(docs):
        writer.add([None if n == 2 else n], [ids.tobytes()])
    writer.close()
    file, every = idfiles.IdReader(path), np.concatenate(docs)
    assert file.docs == [0, 1, None, 3, 4, 5, 6, 7]
    for n, ids in enumerate(docs):
        assert (file.document(n) == ids).all()
    for start in range(0, len(every), 13):
        assert (file.ids(start, 77) == every[start : start + 77]).all()
    assert file.crc32s() == [zlib.crc32(d.tobytes()) for d in docs]
    raw = bytearray(open(path, "rb").read())
    assert raw[:8] == idfiles.MAGIC and len(raw) < 2 * len(every) + 8 + 12 * 13 + 17 * 8 + idfiles.TRAILER.size + 16
    raw[20] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        idfiles.IdReader(path).crc32s()
    open(path, "wb").write(raw[:-1])
    with pytest.raises(ValueError):
        idfiles.IdReader(path)


def expected(rows):
    library = Tokenizer.from_file(PATH)
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = registry.QUERIES["op13_token_files"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(expected(rows))


def test_awkward_rows_make_one_gapless_stream(spark, tmp_path):
    docs = awkward(spark).repartition(3)
    manifest = idfiles.write_ids(docs, PATH, f"{tmp_path}/ids", file_ids=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in idfiles.read_digests(manifest).collect()), key=lambda r: r[0])
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r[1] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in want)
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    ids = [-1 if r[1] is None else r[1] for r in got]
    assert ids == sorted(ids)
    assert manifest.count() > 3 and sum(r.n_docs for r in manifest.collect()) == len(want)
    whole = {r.start: r.ids for r in idfiles.read_ids(manifest).collect()}
    assert all(zlib.crc32(np.array(whole[r[0]], "<u4").tobytes()) == r[3] for r in got)


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    docs = awkward(spark)
    manifest = idfiles.write_ids(docs, PATH, f"{tmp_path}/ids")
    before = sorted(map(tuple, idfiles.read_digests(manifest).select("start", "n_tokens").collect()))
    open(f"{tmp_path}/ids/part-000000-00000-lost.ids", "wb").write(b"half a file")
    assert sorted(map(tuple, idfiles.read_digests(manifest).select("start", "n_tokens").collect())) == before
    assert len(os.listdir(f"{tmp_path}/ids")) > manifest.count()
