import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat sed diam voluptua at vero eos et accusam et justo duo dolores et ea rebum stet clita kasd gubergren no sea takimata sanctus est"


def edge_rows():
    """Null, empty, blank, tiny, repeated, near, periodic, very long and non-ASCII texts; ids with a null and a repeat."""
    big = " ".join(f"w{i * 7919 % 10007}" for i in range(40_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, LONG + " tail"), (9, "head words before " + LONG + " and after"),
        (10, "again " * 200), (11, big), (12, "Ünïcödé ﬀ 🙂 \x1c x  y z <|endoftext|>"), (13, LONG.upper()), (None, "nobody's text stands here"), (14, "row twice"), (14, "row twice"), (15, "a\n\n b  c"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("src0"), "n_chars": F.length("text"), "score": F.lit("clash"), "piece": F.lit("clash"), "runs": F.lit("clash"), "node": F.lit("clash")})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
