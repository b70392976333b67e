"""Language ID learns every language of its rows, however many there are."""

from tickloom.llm import language


def test_all_languages_are_learned(spark):
    names = [f"l{i:03}" for i in range(300)]
    rows = spark.createDataFrame([(f"text {n}", n) for n in names] + [("none", None)], "text string, lang string")
    model = language.train(rows, per_language=1)
    assert model.languages == names and model.out.shape[1] == 300
