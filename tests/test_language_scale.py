"""Language detection where the profiles are larger than what is sent with the function."""

import pytest

from quarryline.operators import language

TEXTS = ["the other sache", "żółw i die sache", "漢字かな and the rest of it", "the other sache", "qqqqqqqqqqq", "", "für die łódź there"]


@pytest.fixture(scope="module")
def profile(spark):
    known = [("en", "the thing on the other side"), ("de", "die andere sache für und für"), ("pl", "łódź i żółw 漢字かな")]
    return language.profiles(spark.createDataFrame(known, "lang string, text string"))


def test_texts_are_read_once(spark, profile, monkeypatch):
    """The n-grams of a text are made once, for the scores and for what meets the rest of the profiles."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(language, "IN_ROW", 10)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, t string").mapInArrow(counted, "doc_id long, t string")
    assert len(language._scored(rows, profile).collect()) == len(TEXTS) == seen.value


def test_buckets_give_the_same(spark, profile, monkeypatch):
    """Rows alike in id and text, more rows than a run and many buckets change nothing."""
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(TEXTS * 400)], "doc_id long, t string").repartition(3)

    def found():
        return sorted((r.doc_id, r.found or "", round(r.sure, 9)) for r in language._scored(rows, profile).collect())

    want = found()
    monkeypatch.setattr(language, "IN_ROW", 10)
    for size in (1_000_000, 7):
        monkeypatch.setattr(language, "BUCKET", size)
        assert found() == want


def test_wide_n_grams_alone(spark):
    """Gains of a text whose n-grams all lie beyond 2^12 are not cut to whole numbers."""
    known = [("ja", "漢字かな漢字"), ("zh", "漢字漢文")]
    table = language.profiles(spark.createDataFrame(known, "lang string, text string"))
    (row,) = language._scored(spark.createDataFrame([(1, "漢字")], "doc_id long, t string"), table).collect()
    assert row.found == "ja" and 0.5 < row.sure < 1 and row.sure != round(row.sure, 2)
