"""License scans with a positional rare-token index, in DataFrame functions only.

A template is a license notice: words at relative positions, with a key phrase that must stand whole. The index has
each template's postings (word, relative position). A first pass counts, over all documents, in how many each license
word stands. The second looks up each file's license words of highest inverse document frequency, the RARE rarest of
each template: where each stands says where the template would start by the word's relative position, and the starts
that all of them give are intersected. It then verifies that the key phrase stands there word by word, and scores how
much of the whole notice does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import text_rows

#: Words of each template whose postings are intersected.
RARE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    key: tuple[str, ...]
    #: words of the notice around the key phrase, by their position relative to its first word
    around: tuple[tuple[int, str], ...] = ()
    base: bool = False

    @property
    def size(self) -> int:
        return len(self.key) + len(self.around)


def _template(label: str, before: str, key: str, after: str = "", base: bool = False) -> Template:
    b, k, a = before.split(), key.split(), after.split()
    return Template(label, tuple(k), (*((i - len(b), w) for i, w in enumerate(b)), *((len(k) + i, w) for i, w in enumerate(a))), base)


#: The four base phrases with their labels; further notices of the method's own.
TEMPLATES = (
    _template("gpl", "licensed under the", "gnu general public license", "", True),
    _template("apache", "licensed under the", "apache license", "version 2 0", True),
    _template("cc-by", "licensed under", "cc by", "", True),
    _template("mit", "released under the", "mit license", "", True),
    _template("gpl-3", "", "gnu general public license version 3"),
    _template("lgpl", "under the terms of the", "gnu lesser general public license"),
    _template("agpl", "under the terms of the", "gnu affero general public license"),
    _template("apache-2.0", "licensed under the", "apache license version 2 0"),
    _template("mpl-2.0", "subject to the terms of the", "mozilla public license", "v 2 0"),
    _template("bsd", "", "redistribution and use in source and binary forms", "with or without modification are permitted"),
    _template("mit-text", "", "permission is hereby granted free of charge to any person obtaining a copy", "of this software"),
    _template("isc", "", "permission to use copy modify and or distribute this software for any purpose", "with or without fee is hereby granted"),
    _template("cc-by-sa", "licensed under", "cc by sa"),
    _template("cc-by-nc", "licensed under", "cc by nc"),
    _template("cc-by-nd", "licensed under", "cc by nd"),
    _template("cc0", "", "cc0 1 0 universal"),
    _template("all-rights-reserved", "copyright", "all rights reserved"),
)


def _lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _words(text: Column) -> Column:
    """The words in order, A-Z still as written (separators leave empty strings at the ends only)."""
    return F.filter(F.split(text, BETWEEN, -1), lambda w: w != "")


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Documents that have each word of a key phrase; bounded by the templates, counted over all documents."""
    vocabulary = sorted({w for t in templates for w in t.key})
    word = F.explode(F.split("text", BETWEEN, -1)).alias("word")
    found = text_rows(docs).select("doc_id", word).where(F.char_length("word") <= max(map(len, vocabulary))).select("doc_id", _lower(F.col("word")).alias("word"))
    per_doc = found.where(F.col("word").isin(vocabulary)).groupBy("doc_id", "word").agg(F.lit(1).alias("one"))
    counts = {r["word"]: r["n"] for r in per_doc.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _is(word: str, hit: Column) -> Column:
    return hit["w"] == word


def _start(at: int, hit: Column) -> Column:
    return hit["i"] - at


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their starts
    (null without any). labels are those of all templates whose key phrase stands somewhere. score is the largest
    share of a template's words found in place around a key phrase, 0 without one. Null and empty texts have no words.
    """
    seen = word_frequencies(docs, templates)
    rare = {t: sorted(range(len(t.key)), key=lambda i: (seen[t.key[i]], i))[:RARE] for t in templates}
    anchors = sorted({t.key[i] for t, at in rare.items() for i in at})
    longest = max(map(len, anchors))

    def hit(word: Column, i: Column) -> Column:
        short = F.when(F.length(word) <= longest, _lower(word))
        return F.when(short.isin(anchors), F.struct(i.alias("i"), short.alias("w")))

    words = text_rows(docs).select("doc_id", _words(F.col("text")).alias("words"))
    hits = words.withColumn("hits", F.filter(F.transform("words", hit), lambda h: h.isNotNull()))

    def starts(t: Template) -> Column:
        n = len(t.key)
        begun = reduce(F.array_intersect, (F.transform(F.filter("hits", partial(_is, t.key[at])), partial(_start, at)) for at in rare[t]))
        whole = F.array(*map(F.lit, t.key))
        return F.filter(begun, lambda s: (s >= 0) & (F.transform(F.slice("words", F.greatest(s, F.lit(0)) + 1, n), _lower) == whole))

    def share(t: Template, s: Column) -> Column:
        there = F.lit(len(t.key))
        for at, w in t.around:
            there = there + F.when((s + at >= 0) & (_lower(F.get("words", s + at)) == w), 1).otherwise(0)
        return there / F.lit(t.size)

    placed = hits.select("doc_id", "words", *(F.when(F.size("hits") > 0, starts(t)).otherwise(F.array().cast("array<int>")).alias(f"t{n}") for n, t in enumerate(templates)))
    base = [f"t{n}" for n, t in enumerate(templates) if t.base]
    every = F.concat(*base)
    label = [(t.base, F.when(F.size(f"t{n}") > 0, F.lit(t.label))) for n, t in enumerate(templates)]

    def joined(parts: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), ",")

    best = F.greatest(*(F.coalesce(F.array_max(F.transform(f"t{n}", partial(share, t))), F.lit(0.0)) for n, t in enumerate(templates)))
    return placed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        joined([c for b, c in label if b]).alias("base_labels"),
        joined([c for _, c in label]).alias("labels"),
        F.round(best, 6).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same in DuckDB SQL, by looking at every position."""

    def starts(t: Template) -> str:
        n = len(t.key)
        key = f"[{', '.join(repr(x) for x in t.key)}]"
        return f"CASE WHEN list_has_all(w, {key}) THEN list_filter(range(0, greatest(len(w) - {n} + 1, 0)), lambda i: w[i+1:i+{n}] = {key}) ELSE []::BIGINT[] END"

    def share(t: Template, n: int) -> str:
        there = " + ".join([str(len(t.key)), *(f"CASE WHEN i + {at} >= 0 AND w[i + {at} + 1] = {word!r} THEN 1 ELSE 0 END" for at, word in t.around)])
        return f"coalesce(list_max(list_transform(t{n}, lambda i: ({there}) / {t.size}.0::DOUBLE)), 0)"

    def joined(only_base: bool) -> str:
        labels = ", ".join(f"CASE WHEN len(t{n}) > 0 THEN '{t.label}' END" for n, t in enumerate(templates) if t.base or not only_base)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))), ','), '')"

    base = " || ".join(f"t{n}" for n, t in enumerate(templates) if t.base)
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), placed AS (
  SELECT doc_id, w, {', '.join(f'{starts(t)} AS t{n}' for n, t in enumerate(templates))} FROM words
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({base}) AS BIGINT) AS n_base,
       CAST(list_min({base}) AS BIGINT) AS first_word, CAST(list_max({base}) AS BIGINT) AS last_word,
       {joined(True)} AS base_labels, {joined(False)} AS labels,
       round(greatest({', '.join(share(t, n) for n, t in enumerate(templates))}), 6) AS score
FROM placed
"""
