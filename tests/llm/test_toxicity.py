import random
import zlib

from citewright.llm import toxicity


def corpus(spark, n=900):
    rng = random.Random(8)
    good, bad = [f"wo{i}rd" for i in range(200)], ["vileza", "vilezo", "grumbash"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held"]]
    assert sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held) >= 0.98 * len(held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    # held-out labels change nothing
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(docs, flipped).weights == model.weights).all()


def test_odd_inputs(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.fit(docs, labels)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] < 0.3 for r in got)
    assert toxicity.score(empty, model).count() == 0
    mixed = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(45)] + [(3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, mixed)).collect()
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learns_from_every_labelled_document(spark):
    """24,000 labels outside the fold, of which the toxic ones are such as a sample of 20,000 by hash would leave out."""
    from pyspark.sql import functions as F

    ids = spark.range(32_000).withColumnRenamed("id", "doc_id").where(~toxicity.held_out("doc_id"))
    late = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[20_000:]]
    bad = late[:400]
    labels = ids.withColumn("toxic", F.col("doc_id").isin(bad).cast("int"))
    docs = labels.select("doc_id", F.when(F.col("toxic") == 1, "some vileza here").otherwise("some words here").alias("text"))
    model = toxicity.fit(docs, labels)
    assert model.wanted.any()
    low, high = model.scores(["some words here", "some vileza here"])
    assert low < 0.3 <= high


def test_ngrams_stay_in_their_text():
    doc, gram = toxicity.present(["abcd", "", "wxyz"])
    alone = [set(toxicity.present([t])[1].tolist()) - {0} for t in ("abcd", "", "wxyz")]
    for k in range(3):
        assert set(gram[doc == k].tolist()) - {0} == alone[k]
