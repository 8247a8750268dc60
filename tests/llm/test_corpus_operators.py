"""The corpus operators against brute force, on awkward rows and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from common_rows import awkward, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import bpe, iblt, licenses, lines, media, packing, registry, secret_scan, simhash, substrings, toxicity

FOLDER = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# -- media


def test_media_gives_every_byte_back(spark):
    got = rows(media.describe_texts(awkward(spark)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = Counter()
    for d, t in texts():
        raw = t.encode()
        p = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want[d, len(raw), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    assert got == want


def test_a_plain_reader_decodes_the_frames():
    payload = random.Random(1).randbytes(64 * 20)
    frame = media.parse_avi(media.encode_avi(payload)).frames[0]
    table = media._huffman(frame[frame.index(b"\xff\xc4") + 4 :][:26])[0, 0]
    bits = media._Bits(frame[frame.index(b"\xff\xda") + 10 : -2].replace(b"\xff\0", b"\xff"))
    d = np.array([bits.signed(bits.symbol(table)) for _ in range(1024)]).reshape(16, 64)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    assert np.cumsum(d, axis=1).astype(np.uint8).tobytes() == payload[:1024]


def test_a_flat_baseline_frame_decodes():
    # one 8x8 block whose only coefficient is DC 5 at a step of 16: samples 128 + 5 * 16 / 8
    quant = media._segment(0xDB, b"\0" + b"\x10" * 64)
    frame = media._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    dc = media._segment(0xC4, b"\0" + bytes([1] + [0] * 15) + b"\x03")
    ac = media._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    scan = media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + bytes([0b0_101_0_111])
    assert (media.decode_jpeg(b"\xff\xd8" + quant + frame + dc + ac + scan + b"\xff\xd9") == 138).all()


def test_a_change_of_picture_is_a_cut(spark):
    dark, light = bytes([10]) * 1024 * 12, bytes([200]) * 1024 * 9
    film = media.encode_avi(dark + light)
    assert [(a, b) for a, b, _, _ in media.clips_of(film)] == [(0, 12), (12, 21)]
    table = spark.createDataFrame([(1, bytearray(film)), (2, None), (3, bytearray(b"no film"))], "doc_id long, media binary")
    assert [(r.doc_id, r.start_s, r.end_s) for r in media.clips(table).orderBy("clip").collect()] == [(1, 0.0, 12 * 0.04), (1, 12 * 0.04, 21 * 0.04)]


# -- BPE


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = awkward(spark).select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text").where("doc_id % 4 = 0"))
    want = Counter()
    for r in docs.collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        want[r.doc_id, len(e.ids), sha(" ".join(map(str, e.ids)).encode()), sha(library.decode(e.ids, skip_special_tokens=False).encode())] += 1
    assert rows(bpe.encode_digests(docs, path)) == want


def test_bpe_of_random_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.word_bpe(path), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aaabbnnst'-. éßΣ12<|>\n") for _ in range(rng.randrange(1, 40)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


# -- licences


def test_licenses_equal_a_search_of_every_position(spark):
    def words(t):
        low = "".join(c.lower() if c.isascii() else c for c in t)
        return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    base = {t.key: t.label for t in licenses.TEMPLATES if t.base}
    docs = awkward(spark).select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        w = words(r.text or "")
        at = [(i, k) for k in base for i in range(len(w)) if tuple(w[i : i + len(k)]) == k]
        labels = {t.label for t in licenses.TEMPLATES if any(tuple(w[i : i + len(t.key)]) == t.key for i in range(len(w)))}
        starts = [i for i, _ in at]
        want[r.doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({base[k] for _, k in at})), ",".join(sorted(labels))] += 1
    assert rows(licenses.scan(docs).drop("score")) == want


# -- lines


def _line_words(line):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_dedup_equals_all_pairs(spark):
    docs = documents(spark).where("doc_id < 40")
    source = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = {(d, p): " ".join(_line_words(line)) for d, t in source for p, line in enumerate(t.split("\n")) if _line_words(line)}
    root = {k: k for k in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(a, b):
        p, q = sorted((find(a), find(b)))
        root[q] = p

    first = {}
    for k in sorted(kept):
        link(first.setdefault(kept[k], k), k)
    # all pairs by edit similarity alone
    table = spark.createDataFrame([(x,) for x in sorted(first)], "x string")
    most = "cast(floor(greatest(length(x), length(y)) * 0.2D + 1e-9D) as int)"
    near = table.repartition(16).crossJoin(table.withColumnRenamed("x", "y")).where(f"x < y and abs(length(x) - length(y)) <= {most}").where(f"levenshtein(x, y, {most}) >= 0")
    for r in near.collect():
        link(first[r.x], first[r.y])
    want = {d: "\n".join(line for p, line in enumerate(t.split("\n")) if not _line_words(line) or find((d, p)) == (d, p)) for d, t in source}
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == want


def test_trimmed_lines_keep_their_distance(spark):
    table = spark.createDataFrame([("a b c", "a c"), ("a", "a b"), ("a b", "c a b"), ("a b c", "a b c"), ("x y", "p q r"), ("aa bb cc dd", "aa bx cc dd"), ("b b b", "b b"), ("ab", "a")], "x string, y string")
    p, q = lines._differing("v", "w")
    for r in table.selectExpr("x", "y", "split(x, ' ') as v", "split(y, ' ') as w").selectExpr("x", "y", f"levenshtein({p}, {q}) as d").collect():
        assert r.d == _distance(r.x, r.y), r


def test_line_dedup_of_awkward_rows(spark):
    got = lines.dedup_lines(awkward(spark))
    assert got.columns[-2:] == ["n_lines", "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].text == "" and by[2][0].n_removed == 2
    assert by[5][0].text is None and by[5][0].n_lines == 0
    assert by[6][0].text == " \n\t\n " and by[4][0].n_lines == 1
    assert sorted(r.text for r in by[11]) == ["another text of the same id", "one", "one"]
    assert got.count() == 15


# -- fingerprints


def test_fingerprints_equal_set_arithmetic(spark):
    docs = documents(spark).select("doc_id", "text")
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)

    def likeness(a, b):
        x, y = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
        return (x & y).total() / (x | y).total() if x or y else 1.0

    got = {r.doc_id: r for r in iblt.fingerprints(docs, ranges=7).collect()}
    for i, (d, t) in enumerate(source):
        after = source[(i + 1) % len(source)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(new.encode()))
        assert abs(r.near_edited - likeness(t, new)) < 1e-9 and abs(r.near_next - likeness(t, after)) < 1e-9
    assert len({r.fingerprint for r in got.values()}) == len({t for _, t in source})


def test_fingerprints_of_awkward_rows(spark):
    got = iblt.fingerprints(awkward(spark)).collect()
    assert len(got) == 15
    alone = iblt.fingerprints(awkward(spark).where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    nameless = iblt.fingerprints(awkward(spark).where("doc_id is null")).first()
    assert nameless.near_next == 1.0


# -- substrings


def _removed(source):
    seen, out = set(), []
    for raw in source:
        lost = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                lost[i : i + 100] = True
            seen.add(w)
        out.append(lost)
    return out


@pytest.mark.parametrize("many", [substrings.MANY, 3])
def test_substrings_equal_a_set_of_windows(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    docs = documents(spark).select("doc_id", "text")
    source = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = Counter()
    for (d, raw), lost in zip(source, _removed([raw for _, raw in source])):
        want[d, len(raw), int(lost.sum()), int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum()), sha(bytes(np.frombuffer(raw, np.uint8)[~lost]))] += 1
    assert rows(substrings.dedup_substrings(docs).drop("kept")) == want


def test_substrings_of_awkward_rows(spark):
    got = {}
    for r in substrings.dedup_substrings(awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[13][0].n_removed == 598 and got[13][0].n_spans == 1
    assert sum(map(len, got.values())) == 15
    assert [r.n_removed for r in got[4] + got[5] + got[None]] == [0, 0, 0]


def test_suffix_array_of_random_strings():
    rng = random.Random(3)
    for _ in range(40):
        t = np.array([rng.randrange(rng.choice([1, 2, 4, 200])) for _ in range(rng.choice([1, 2, 5, 60, 400]))])
        order = substrings.suffix_array(t, upto=10**9).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:].tolist())


# -- secrets


def test_base_spans():
    text = 'Password: "abcdef" token=abc x AKIA' + "A1" * 8 + " é " + "0123456789abcdef" * 2 + " AKIASHORT"
    kinds = [(k, text[a:b]) for a, b, k in secret_scan.base_spans(text)]
    assert kinds == [("assign", 'Password: "abcdef'), ("access", "AKIA" + "A1" * 8), ("hex", "0123456789abcdef" * 2)]


def test_automata_tell_formats_from_words():
    rng = random.Random(4)
    hexes = [("hex", "".join(rng.choice("0123456789abcdef") for _ in range(40))) for _ in range(60)]
    keys = [("access", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))) for _ in range(60)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    formats = secret_scan.learn(hexes + keys, words)
    assert max(len(a.out) for a in formats.automata.values()) < 60
    assert formats.gain("ASIA" + "QWERTYUIOPASDFGH") > formats.gain("internationalization")
    assert formats.gain("9f86d081884c7d659a2feaa0c55ad015") > formats.gain("nevertheless-understood1")


def test_secrets_of_awkward_rows(spark):
    got = {}
    for r in secret_scan.scan(awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    r = got[8][0]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert r.base_sha256 == sha(",".join(s for s in r.spans.split(",") if not s.startswith("format")).encode())
    assert got[5][0].spans == "" and sum(map(len, got.values())) == 15
    clean = {r.doc_id: r.text for r in secret_scan.redact(awkward(spark)).collect() if r.doc_id in (1, 5, 8)}
    assert clean[5] is None and "hunter2" not in clean[8] and "AKIA" not in clean[8] and clean[1].startswith("The quick")


# -- SimHash


def _print(text):
    w = [b for b in text.encode().lower().split()]
    s = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("tree", [simhash.TREE, 2])
def test_simhash_components_equal_all_pairs(spark, monkeypatch, tree):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (simhash.RADIUS, tree))
    docs = awkward(spark).where("doc_id is not null").select("doc_id", "text").unionByName(documents(spark).select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    source = [(r.doc_id, _print(r.text or "")) for r in docs.collect()]
    root = list(range(len(source)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(source):
        for j in range(i):
            if (a ^ source[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(source):
        least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(source))
    assert rows(simhash.near_duplicates(docs)) == want


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(5)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels)
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    test = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("accuracy"), F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first()
    assert test.accuracy > 0.92 and test.precision > 0.9
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_without_labels_or_words(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(awkward(spark), none).collect()
    assert len(got) == 15 and all(r.predicted == 0 for r in got)


# -- packing


def test_packing_fills_sequences_without_gaps(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = awkward(spark).select("doc_id", "text").unionByName(documents(spark).select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist()
        assert sum(n for _, n in p) <= 2048
    total = sum(r.length for r in packed)
    assert len(places) <= -(-total // 2048) + max(2, total // 2048 // 50)


def test_configurations_use_every_piece_once():
    rng = random.Random(6)
    histogram = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000))
    used = Counter()
    plan, bound = packing.configurations(histogram)
    assert bound <= sum(times for _, times in plan)
    for c, times in plan:
        assert sum(length * n for length, n in c) <= 2048
        for length, n in c:
            used[length] += n * times
    assert used == histogram


# -- all


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_awkward_tables(spark, name, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path)).select("doc_id").distinct().count()
    assert out == 13
