import pytest
from pyspark.sql import functions as F

from quarry.functions import text as A
from quarry.functions.stemmer import porter2


def column(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


CASES = [
    (",.!?;:\nrunning[] {}<>\\, jumped,!?;:\"() quickly.! !  ", False, ["run", "jump", "quick"]),
    ("The quick brown fox jumps over the lazy dog", True, ["quick", "brown", "fox", "jump", "lazi", "dog"]),
    ("Running RUNNING runNiNg running", False, ["run"] * 4),
    ("", False, []),
    (" \t\n\r.,;:!()[]{}<>?\"'~@#$%^&*-_=+|\\", False, ["@", "$%", "&", "+"]),
    ("the is and a an of over", True, []),
    ("token1, token2.token3!token4?token5", False, [f"token{i}" for i in range(1, 6)]),
    ("a" * 10_000, False, ["a" * 10_000]),
    (None, True, []),
]


@pytest.mark.parametrize("text,skip,expected", CASES)
def test_stemmed_tokens(spark, text, skip, expected):
    assert column(spark, text, lambda c: A.stemmed_tokens(c, skip)) == expected
    assert A.query_tokens(text, True, skip) == expected


def test_non_ascii_letters_separate(spark):
    text = "résumés café naïve jalapeño"
    expected = ["r", "sum", "s", "caf", "na", "ve", "jalape", "o"]
    assert column(spark, text, lambda c: A.tokens(c, False)) == expected


def test_stop_words_are_136():
    assert len(A.STOP_WORDS) == len(set(A.STOP_WORDS)) == 136


def trigrams(spark, text):
    make = lambda c: F.flatten(F.transform(A.trigram_words(c), A.word_trigrams))
    return [(r["tri"], r["off"]) for r in column(spark, text, make)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("go", []),
        ("go\n", [("go", 0)]),
        ("ab cd", [("ab", 0)]),
        ("Cats a", [("cat", 0), ("ats", 1)]),
        ("é ab cd ef", [("ab", 0), ("cd", 0)]),
    ],
)
def test_trigrams(spark, text, expected):
    assert trigrams(spark, text) == expected == A.query_trigrams(text)


def test_trigram_offsets_wrap(spark):
    offs = [o for _, o in trigrams(spark, "x" * 300)]
    assert offs == [i % 256 for i in range(298)]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("consistently", "consist"), ("generously", "generous"), ("communication", "communic"),
        ("knightly", "knight"), ("hopping", "hop"), ("hoping", "hope"), ("cries", "cri"), ("ties", "tie"),
        ("dying", "die"), ("skies", "sky"), ("inning", "inning"), ("agreed", "agre"), ("relational", "relat"),
        ("falling", "fall"), ("bed", "bed"), ("happy", "happi"), ("say", "say"), ("gas", "gas"), ("kiwis", "kiwi"),
        ("national", "nation"), ("adjustable", "adjust"), ("probate", "probat"), ("controlling", "control"),
        ("yes", "yes"), ("boy", "boy"), ("radically", "radic"), ("luxuriated", "luxuri"),
    ],
)
def test_porter2(word, stem):
    assert porter2(word) == stem
