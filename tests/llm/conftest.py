import pytest

#: Columns of documents, and columns that could clash with names an operator uses inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size long, t string, fp long, held_out string, key string, n int"

LONG_LINE = "This line is long enough to count as a passage"


def rows():
    """Documents with nulls in every column, empty and long texts, ties, copies and repeated rows."""
    texts = {
        1: "the quick brown fox jumps over the lazy dog\n" + LONG_LINE,
        2: "The quick  brown fox jumps over the lazy dog\n" + LONG_LINE.upper(),
        3: LONG_LINE + "  \nsomething else entirely, with other words in it\n" + LONG_LINE,
        4: "",
        5: None,
        6: " \t\n ",
        7: "word " * 3000,
        8: "a b",
        9: "naïve café — 日本語 🤖 <|endoftext|> done",
        10: "the quick brown fox jumps over the lazy dog\n" + LONG_LINE,
        11: "\n".join(f"line number {i} of a rather long text, unlike all others" for i in range(400)),
        12: "x" * 5000,
    }
    out = [(i, t, "en" if i % 2 else None, ["web", "books", None, "code"][i % 4], len(t or ""), i, i, "t", 7, "h", "k", 3) for i, t in texts.items()]
    out += [out[0], (None, LONG_LINE, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
