import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, tokens string, hits int"


@pytest.fixture(scope="session")
def edge_rows(spark, sf_dir):
    """Rows that every operator must take: nulls, empty and very long texts, copies, repeated rows, and columns named as ours are."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word59", "other")
    passage = " ".join(f"shared{i}" for i in range(20))
    texts = [
        (1, base), (2, base), (3, near), (4, ""), (5, None), (6, "   \n\t "), (7, "one two three"), (8, "One TWO three"), (9, "one two four"),
        (10, f"Start here {passage} and then it ends."), (11, f"Another {passage} text altogether."), (11, f"Another {passage} text altogether."), (12, "éÉ ñandú straße 日本語 тест " * 3),
        (None, base), (None, None), (13, "idiot"), (14, "the the the " * 30), (15, "x" * 20000), (16, " ".join(f"long{i % 977}" for i in range(30000))), (-17, f"negative {passage}"),
    ]
    return [(i, t, "en" if i and i % 2 else None, "s", len(t or ""), "clash", "clash", 1) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows, tmp_path_factory):
    """Those rows as a table of a file, in one part."""
    at = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows, KIND).coalesce(1).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
