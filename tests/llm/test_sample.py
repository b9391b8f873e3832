"""The training sample of the language field, on tables where copies hold most rows."""

from collections import Counter

from vellum.llm import language


def frame(spark, rows):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string")


def test_sample_takes_distinct_texts(spark):
    # 40 texts of each label; one more holds 99 % of the label's rows
    rows = [(f"{y} text {i}", y) for y in ("aa", "bb") for i in range(40)] + [(f"{y} hot", y) for y in ("aa", "bb") for _ in range(4000)]
    how = language.Settings(per_language=20)
    sample = language.training_sample(frame(spark, rows), how)
    assert Counter(y for _, y in sample) == {"aa": 20, "bb": 20}
    assert len(set(sample)) == 40


def test_sample_takes_the_commonest_label(spark):
    rows = [("one text", "bb")] * 30 + [("one text", "aa")] * 3 + [("other text", "aa")] * 20
    assert sorted(language.training_sample(frame(spark, rows), language.Settings())) == [("one text", "bb"), ("other text", "aa")]
