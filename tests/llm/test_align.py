"""Alignments against both libraries and byte offsets compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from common_rows import awkward
from tokenizers import Tokenizer

from marquee.llm import align, registry
from marquee.llm.bpe import byte_alphabet

FOLDER = "/root/testdata/sf0.001"
A, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(tokens):
    return np.cumsum([len(t) for t in tokens]).tolist()


def expected(rows, libraries):
    a_lib, b_lib = libraries
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    made, count = [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            bytes_a = [bytes(byte_of[c] for c in a_lib.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
            if not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                a = b = []
        written, links = [], []
        if a:
            last_b = {e: j for j, e in enumerate(ends(bytes_b))}
            i = j = 0
            for x, e in enumerate(ends(bytes_a)):
                if e in last_b:
                    y = last_b[e]
                    written.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
                    links.append((a[x], b[y]))
                    i, j = x + 1, y + 1
        count.update(links)
        made.append((doc, len(a), len(b), written, links))
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = Counter()
    for doc, n_a, n_b, written, links in made:
        best = sum(count[p] == highest[p[1]] for p in links)
        sha = hashlib.sha256(";".join(written).encode()).hexdigest() if written else ""
        out[doc, n_a, n_b, len(written), len(links), best, sum(count[p] for p in links), sha] += 1
    return out


def test_query_equals_the_libraries(spark, libraries):
    got = registry.QUERIES["op12_alignment"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()], libraries)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > 150


ODD = ["▁x", "<0x41> <s> </s> <unk> <|endoftext|>", "  two  blanks   and\ttabs \n", "日本語テキスト" * 300, "naïve café ﬁ ́ 🙂", "a", " ", "\x00", "long" * 4000, "Ünïcödé 한국어 עברית", "x y\xa0z"]


def test_odd_texts(spark, libraries):
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + n, t) for n, t in enumerate(ODD)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, libraries)
    assert Counter(map(tuple, align.alignments(docs, A, B).collect())) == want
    assert sum(n for r, n in want.items() if not r[1]) >= 3


def test_links_are_numbered_within_a_bound_of_the_vocabularies(spark):
    work = align.aligner(A, B)
    doubled = 2  # a byte's own token and its piece have the same bytes
    assert len(work.pairs) <= doubled * (work.size_a.sum() + work.size_b.sum())
    a, b = np.divmod(work.pairs[::997], len(work.bytes_b))
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = work.bytes_a[x], work.bytes_b[y]
        assert p.endswith(q) or q.endswith(p)
    assert (work.numbers(work.pairs[::997]) == np.arange(len(work.pairs))[::997]).all()


def test_texts_together_and_alone_are_aligned_alike():
    work = align.Aligner(A, B)
    texts = ["The quick brown fox, unbelievably quick, jumps over 12345 lazy dogs; " * 3, "", ODD[0], ODD[3], "the quick", ODD[8]]
    seen = lambda rows: [(*r[:3], r[3].tolist()) for r in rows]
    assert seen(work.rows(texts)) == [r for t in texts for r in seen(work.rows([t]))]


def test_windows_whose_hashes_meet_are_told_apart(monkeypatch):
    work = align.Aligner(A, B)
    texts = ["The quick brown fox jumps over lazy dogs", "again the quick fox"]
    whole = [(*r[:3], r[3].tolist()) for r in work.rows(texts)]
    monkeypatch.setattr(align, "_FACTOR", np.uint64(0))
    assert [(*r[:3], r[3].tolist()) for r in work.rows(texts)] == whole
