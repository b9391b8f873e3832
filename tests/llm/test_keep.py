"""The language stage on texts that switch between many languages."""

from vellum.llm import language


def test_switching_text_of_clear_words_stays(spark):
    # five invented languages, each with letters of its own; the last text has all in equal parts
    alphabets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    words = [[a + b + c for a in own for b in own for c in own] for own in alphabets]
    rows = [(" ".join(own[(i * 7 + k) % 125] for k in range(40)), f"l{n}") for n, own in enumerate(words) for i in range(20)]
    rows.append((" ".join(" ".join(own[:24]) for own in words), "l0"))
    frame = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string")
    switched = len(rows) - 1
    row = language.identify_languages(frame).where(f"doc_id = {switched}").first()
    assert row.lang_score < 0.4
    assert language.keep_identified(frame).where(f"doc_id = {switched}").count() == 1
