"""Small tables with everything odd that an operator has to bear."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, part int, score string, "
          "tokens string, name string, position string, secrets string")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
PROSE = "the quick brown fox jumps over the lazy dog near the old river bank today"


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], source: str | None = "s") -> DataFrame:
    """Rows in the columns of ``documents``, with further columns named like the operators' own."""
    rows = [(i, t, "en", source, None if t is None else len(t), "k", 7, "s", "t", "n", "p", "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list[tuple[int | None, str | None]]:
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, PROSE), (6, PROSE), (6, PROSE), (None, PROSE), (None, None),
        (7, LONG), (8, "é☃𝄞" * 30), (9, PROSE.upper()), (10, "a b c d"), (11, "\x00 ▁ �"), (11, "other"),
    ]
