"""Text functions and the stemmer on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import stemmer, text


def one(spark, value, f, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "word, stem",
    [
        ("принципы", "принцип"), ("принципами", "принцип"), ("принцип", "принцип"), ("положение", "положен"), ("норматив", "нормат"), ("нормативы", "норматив"), ("важнейшие", "важн"), ("прочитавший", "прочита"),
        ("радость", "радост"), ("590-п", "590-п"), ("basel", "basel"), ("в", "в"), ("вавиловка", "вавиловк"), ("валяется", "валя"),
    ],
)
def test_stem(word, stem):
    assert stemmer.stem(word) == stem


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("Положение 590-П и Закон 86-ФЗ", ["положение", "590-п", "закон", "86-фз"]), ("Basel 2026", ["basel", "2026"]), ("отчётность", ["отчетность"]), ("кредитно-денежный", ["кредитно", "денежный"]),
        ("ИН-03-23/109 и 1/801-П", ["ин-03-23/109", "1/801-п"]), ("", []), ("5-денежный 7-ФЗакон", ["5", "денежный", "7", "фзакон"]),
    ],
)
def test_split_tokens(spark, value, tokens):
    assert one(spark, value, text.split_tokens) == tokens


def test_null_stays_null(spark):
    for f in (text.split_tokens, text.norm_line, text.tidy, text.strip_numbers, text.strip_references, text.body_of, text.html_text, text.dehyphenate):
        assert one(spark, None, f) is None


@pytest.mark.parametrize(
    "value, plain",
    [("п. 3.12 Положения № 590-П", "п. Положения"), ("вопрос № 1 остался", "вопрос № 1 остался"), ("по п.п. 3.13 и 3.14 Инструкции", "по п.п. Инструкции")],
)
def test_strip_numbers(spark, value, plain):
    assert one(spark, value, text.strip_numbers) == plain


def test_strip_references(spark):
    assert one(spark, "Как считать (п. 3.12 Положения № 590-П)?", text.strip_references) == "Как считать?"


def test_stemmed_vocabulary(spark):
    df = spark.createDataFrame([("принципы", 1), ("принципами", 2), ("abc", 3), (None, 4)], "token string, n int")
    assert sorted((r.n, r.token) for r in stemmer.stemmed(df).collect()) == [(1, "принцип"), (2, "принцип"), (3, "abc"), (4, None)]


def test_body_and_grade(spark):
    assert one(spark, "a\n\nb\n\nc", text.body_of) == "b\n\nc"
    assert one(spark, "no gap", text.body_of) == "no gap"


def test_stem_expression_equals_the_plain_stemmer(spark):
    import random

    rng = random.Random(1)
    endings = [*stemmer.GERUND, *stemmer.GERUND_AFTER, *stemmer.ADJECTIVE, *stemmer.PARTICIPLE, *stemmer.PARTICIPLE_AFTER, *stemmer.VERB, *stemmer.VERB_AFTER, *stemmer.NOUN, *"ость ост ейше ейш нн ь ся сь и".split(), ""]
    words = ["".join(rng.choice("абвгеиклмнопрстуыьэюя") for _ in range(rng.randrange(9))) + rng.choice(endings) + rng.choice(endings) for _ in range(3000)] + ["abc", "590-п", ""]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    assert all(r.stem == stemmer.stem(r.token) for r in df.select("token", stemmer.stem_column(df.token).alias("stem")).collect())
