import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, node string, later long, _id string, segment int, cluster long, kept string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    texts = [None, "", " ", "\n\n\n", "one", "one two three four five six seven", "one two three four five six seven", "One  two\tthree four five six SEVEN", LONG, LONG + "end", "<|endoftext|> x  ▁ é ß 漢字 \U0001f600\n\n a", "a\nb\nc\nd", "x\na\nb\nc\ny", "nul\0 in\x7f text\r\n  end  "]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here at all ok", None, None, None), (None, None, None, None, None), (3, "another text with the id of three", "en", "a", 7)]
    return [(*r, "n", 1, "i", 2, 3, "k") for r in rows]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
