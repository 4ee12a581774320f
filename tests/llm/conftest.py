import pytest

#: doc_id, text, lang, source, n_chars, and columns whose names the operators use inside.
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words string, row int, block string, kept_id long, piece_row long, place string, label string, budget int"
LONG = "the quick word of a very long text and more " * 6000
PROSE = "The river of the north is wide and it runs to the sea, as the people of the land say in the old songs that are for all to hear. It was a day of rain and wind, and the road to the town was long with mud on it. By night they had come to the gate, where a light was still on."


def edge_rows():
    texts = [
        (1, PROSE, "en", "a"), (2, PROSE + " Then they slept.", "en", "a"), (3, PROSE, None, None), (3, PROSE, None, None), (3, PROSE, None, None),
        (4, None, "en", "a"), (5, "", "de", None), (6, "   \n\t ", None, "b"), (None, PROSE, "en", "b"), (None, None, None, None),
        (7, LONG, "en", "b"), (8, "123 !!! ???", "fr", "b"), (9, "x" * 200_000, None, "c"), (10, "日本語 <|endoftext|> é́  double  spaces \r\n end", "en", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, "clash", 1, "b", 2, 3, "p", "l", 4) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
