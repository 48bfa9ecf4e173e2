import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Columns that clash with those that operators make, in results and on the way there.
INNER = ["_id", "_zip", "_hash", "_at", "_spans", "_row", "_set", "lang_pred", "lang_score", "_lang_pred", "_lang_score",
         "mix_source", "mix_copies", "mix_below", "mix_again", "_mix_time", "a", "b", "_a", "node", "root", "first", "kept0", "item",
         "terms", "tf", "norm", "n", "place", "anomaly", "n_words", "runs", "words", "collapsed", "batch", "with blank"]
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()),
    StructField("spans", StringType()), StructField("id", LongType()), StructField("size", LongType()),
    StructField("fp", LongType()), StructField("h", LongType()), *(StructField(c, LongType()) for c in INNER)])


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, long texts, clashing columns."""
    base = ("The quick brown fox jumps over the lazy dog while nobody looks at the quiet river near the old mill. "
            "Released under the MIT License. ")
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, "en", "a", 0),
        (4, "", "de", "b", 0), (5, " \t\n ", None, "b", 4), (6, "1234 !!", "en", None, 7), (None, "Ein Satz ohne Nummer.", "de", "b", 21),
        (None, None, None, None, None), (7, "Der Hund läuft über die Wiese und die Katze schläft. " * 4, "de", "c", 210),
        (8, "é" * 400 + base, "fr", "c", 500), (9, (base + "Und mehr. ") * 700, "en", "d", 0), (10, "▁ a  b ", "en", "d", 7),
        (11, base.upper(), "en", "d", 5), (12, "Kelvin K ſ İ 日本語 😀 \u0000 end", "ja", "e", 3),
        (0, "apache license apache license, general public license! mit", "en", "e", 9)]
    return [(*r, "clash", "clash", 7, 7, 7, 7, *range(len(INNER))) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
