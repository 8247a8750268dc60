"""Base columns against patterns applied one by one to all documents, and formats that the fixed patterns miss."""

import hashlib
import random
import re
from collections import Counter

import pytest

from marquee.llm import secret_scan

PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


@pytest.mark.parametrize("size, least", [("sf0.001", 0), ("sf0.01", 4)])
def test_base_columns_of_all_documents(spark, size, least):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        spans = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, pattern, keep) in enumerate(PATTERNS) for m in re.finditer(pattern, r.text or "", re.ASCII) if keep(m)]
        n = Counter(i for _, i, _ in spans)
        want[r.doc_id, n[0], n[1], n[2], hashlib.sha256(",".join(x for _, _, x in sorted(spans)).encode()).hexdigest()] += 1
    got = secret_scan.scan(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert sum(n for (_, a, b, c, _), n in want.items() if a or b or c) >= least
    for r in got:
        assert hashlib.sha256(",".join(s for s in r.spans.split(",") if s and not s.startswith("format")).encode()).hexdigest() == r.base_sha256


def test_formats_of_labelled_values_are_found_without_label(spark):
    rng = random.Random(3)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    key = lambda: f"sk_live_{draw('ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789', 24)}"
    prose = [" ".join(draw("etaoinshrdlu", rng.randrange(2, 14)) for _ in range(60)) for _ in range(200)]
    rows = [(i, f'{t} token = "{key()}" {t[:40]}') for i, t in enumerate(prose[:80])]
    planted = [(1000 + i, f"{t} {key()} and {t[:30]}") for i, t in enumerate(prose[80:120])]
    clean = [(2000 + i, f"{t} release-2024-candidate-build {t[:20]}1 see chapter12verse34of1999") for i, t in enumerate(prose[120:])]
    docs = spark.createDataFrame(rows + planted + clean, "doc_id long, text string")
    # the clean texts' own tokens are no part of the background
    formats = secret_scan.fit(docs.where("doc_id < 2000"))
    assert len(formats.automata["assign"].out) > 4
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, formats).collect()}
    assert sum("format" in got[d] for d, _ in planted) >= 0.9 * len(planted)
    assert not any(got[d] for d, _ in clean)


def test_automaton_keeps_the_length_of_values():
    rng = random.Random(5)
    values = [("hex", "".join(rng.choice("0123456789abcdef") for _ in range(40))) for _ in range(100)]
    formats = secret_scan.learn(values, ["ordinary", "wordsof", "several", "lengthsand", "shapes12"] * 200)
    same, longer = "a1" * 20, "a1" * 31
    assert formats.gain(same) > secret_scan.GAIN > formats.gain(longer)


def test_many_spans_in_one_text_stay_linear():
    text = 'token = "abcdef123456" ordinaryTokenOf2024Letters ' * 20_000
    formats = secret_scan.learn([], [])
    assert len(secret_scan.all_spans(text, formats)) == 20_000


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def families(rng):
    """Values of several families of credentials, a hundred each."""
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    mixed = UPPER + LOWER + DIGITS
    return {
        "prefix": [f"ghp_{draw(mixed, 36)}" for _ in range(100)],
        "long": [f"sk-{draw(mixed, 48)}" for _ in range(100)],
        "access": [f"ASIA{draw(UPPER + DIGITS, 16)}" for _ in range(100)],
        "upper_hex": [draw(DIGITS + "ABCDEF", 40) for _ in range(100)],
    }


def ordinary(rng, n=300):
    word = lambda a, b: "".join(rng.choice("etaoinshrdlucmwfygp") for _ in range(rng.randrange(a, b)))
    slugs = [f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}-" + "-".join(word(2, 10) for _ in range(rng.randrange(2, 7))) for _ in range(n)]
    prose = ["-".join([*(word(2, 9) for _ in range(rng.randrange(3, 8))), str(rng.randrange(1900, 2030))]) for _ in range(n)]
    uuids = ["-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)) for _ in range(n)]
    fixed = ["2024-01-15-some-article-title", "the-state-of-the-art-2024-review-of-things", "covid-19-vaccine-rollout-plan-b", "2024-01-15-release-notes-v2"]
    return slugs, prose, uuids, fixed


def fitted(rng):
    labelled = [("assign", v) for values in families(rng).values() for v in values[:40]] + [("access", f"AKIA{i:016d}".replace("0", "Q")) for i in range(30)] + [("hex", f"{i:032x}".replace("0", "e")) for i in range(60)]
    return secret_scan.learn(labelled, ["ordinary", "tokens", "chapter12", "well-known", "2024-01-02", "http", "version2", "state-of-the-art"] * 400)


def test_only_shapes_of_labelled_values_are_secrets():
    formats = fitted(random.Random(1))
    for name, values in families(random.Random(2)).items():
        found = sum(any(k == "format" for _, _, k in secret_scan.all_spans(f"see {v} here", formats)) for v in values)
        assert found >= 90, (name, found)
    slugs, prose, uuids, fixed = ordinary(random.Random(3))
    for values in (slugs, prose, uuids, fixed):
        assert not [v for v in values if secret_scan.all_spans(f"see {v} here", formats)]


def test_redaction_leaves_hyphenated_prose_alone(spark):
    formats = fitted(random.Random(1))
    slugs, prose, _, fixed = ordinary(random.Random(4), 40)
    token = families(random.Random(5))["prefix"][0]
    texts = [" and ".join(slugs), " ".join(prose + fixed), f"key {token}, {token}", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_scan.redact(docs, formats).orderBy("doc_id").collect()]
    assert got == [texts[0], texts[1], "key [SECRET], [SECRET]", "", None]


def test_an_automaton_accepts_what_led_to_it_and_rejects_the_rest():
    formats = secret_scan.learn([("assign", f"tok_{'ab12' * 6}{i % 10}Z") for i in range(50)], [])
    only = formats.automata["assign"]
    assert only.likelihood(secret_scan.shape(f"tok_{'cd34' * 6}5Q")) > -1
    for other in ("tok_ab12", "tik-" + "ab12" * 6 + "1Z", "ab12" * 6 + "1Z", "tok_" + "ab12" * 7):
        assert only.likelihood(secret_scan.shape(other)) == float("-inf")
