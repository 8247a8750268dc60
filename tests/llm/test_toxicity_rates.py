"""What the classifier learns doesn't depend on how many labelled rows there are, and it finds toxic text of every language."""

from pyspark.sql import functions as F

from marquee.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_shares_of_the_classes_leave_scores_alone():
    bad = [f"word{i} and other{i * 7 % 50} you utter blockhead of thing{i * 3 % 40} {i}" for i in range(60)]
    good = [f"word{i} and other{i * 11 % 50} you friend of thing{i * 3 % 40} {i}" for i in range(300)]
    few = toxicity.train(bad + good, [1] * 60 + [0] * 300)
    many = toxicity.train((bad + good) * 2 + good * 3, ([1] * 60 + [0] * 300) * 2 + [0] * 900)
    seen = lambda m, texts: [m.score(t) >= 0.5 for t in texts]
    assert seen(few, bad) == seen(many, bad) == [True] * 60
    assert sum(seen(few, good)) <= 6 and sum(seen(many, good)) <= 6


def test_texts_without_a_distinctive_string_score_low():
    for texts, labels in (([], []), (["a"], [1]), (["a", "b"], [0, 1]), (["", ""], [1, 0])):
        model = toxicity.train(texts, labels)
        assert all(0 <= model.score(t) < 0.5 for t in ("", "a", "b" * 5000))


def test_held_out_rows_of_each_language(spark):
    """Some 360 toxic rows teach the toxic words of English best; the floors are what holds today, by language."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    test = docs.join(labels, "doc_id").where(toxicity.held_out())
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(test.select("doc_id", "text"), model).join(test.select("doc_id", "lang", "toxic"), "doc_id")
    share = {(r["lang"], r["toxic"]): r["share"] for r in got.groupBy("lang", "toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("share")).collect()}
    print(share)
    assert share["en", 1] >= 0.7 and share["de", 1] >= 0.4, share
    for lang in ("en", "fr", "de", "es"):
        assert share[lang, 0] <= 0.03, (lang, share)
