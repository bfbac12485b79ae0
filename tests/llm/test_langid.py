import random

from pyspark.sql import functions as F

from brindle.llm import langid

from .rows import empty, table

SYLLABLES = {"aa": ["ta", "ki", "mo", "ru", "sa"], "bb": ["schl", "ung", "ver", "ein", "pf"], "cc": ["eau", "ois", "que", "tré", "è"]}


def made(spark, n=600):
    r = random.Random(5)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), lang, "lang"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_calibration(spark):
    df = made(spark)
    model = langid.fit(df.where("doc_id % 3 <> 1"), key=F.col("doc_id"))
    got = langid.predict(df, model, keep=("lang",)).where("doc_id % 3 = 1").collect()
    right = [r["lang_pred"] == r["lang"] for r in got]
    assert sum(right) / len(right) > 0.98
    assert abs(sum(r["score"] for r in got) / len(got) - sum(right) / len(right)) < 0.05
    assert sum(r["accepted"] for r in got) / len(got) > 0.97


def test_same_model_again(spark):
    df = made(spark, 200)
    a, b = (langid.fit(x, key=F.col("doc_id")) for x in (df, df.repartition(7)))
    assert a.languages == b.languages and abs(a.table - b.table).max() < 1e-6


def test_any_rows(spark):
    df = table(spark)
    model = langid.fit(df, key=F.col("doc_id"))
    got = langid.predict(df, model, keep=("doc_id", "text", "lang", "score", "h")).collect()
    assert len(got) == df.count() and set(model.languages) == {"en", "fr", "de"}
    for r in langid.predict(df, model, keep=("text",)).collect():
        blank = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == blank and (not blank or (r["score"] == 0 and not r["accepted"])) and 0 <= r["score"] <= 1
    assert langid.predict(empty(spark), model).count() == 0


def test_nothing_to_learn(spark):
    df = made(spark, 20).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(df)).collect()} == {"und"}


def plain_scores(text, model, buckets):
    """Class probabilities from a text's subwords one by one."""
    import numpy as np
    import pyarrow as pa

    counted = langid.features(pa.array([text]), buckets)[0].astype(float)
    mean = (counted / max(counted.sum(), 1)) @ model.table.astype(float)
    raw = ((mean if model.out is None else mean @ model.out) + model.bias) / model.temperature
    e = np.exp(raw - raw.max())
    return e / e.sum()


def test_prediction_against_plain_sums(spark):
    """Each row's label and score are those of its own subwords, with as many languages as an embedding is wide and with more."""
    df = made(spark, 200)
    for settings in (langid.Settings(), langid.Settings(width=2)):
        model = langid.fit(df, key=F.col("doc_id"), settings=settings)
        assert (model.out is None) == (settings.width >= 3)
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in langid.predict(df, model).collect():
            p = plain_scores(text[r["doc_id"]], model, settings.buckets)
            assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4 and r["accepted"] == (r["score"] >= model.threshold)


def test_many_labels_are_all_learned(spark):
    rows = [(i, f"{'abcdefghij'[i % 30 % 10]}{i % 30}word " * 5, f"l{i % 30}") for i in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), key=F.col("doc_id"))
    assert len(model.languages) == 30 and model.out is not None
