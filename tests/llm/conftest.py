import pytest

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(f"{WORDS[(i * 7 + seed * 13 + i * i * (seed + 3)) % len(WORDS)]}{(i * i * 31 + seed * 17) % 97}" for i in range(n))


EDGE = [
    (1, prose(120, 1)),
    (2, prose(120, 1)),  # an exact copy
    (3, prose(120, 1) + " tail words here"),
    (4, None),
    (5, ""),
    (6, " \t\n "),
    (7, "one"),
    (7, "one"),  # a repeated row
    (8, "one two"),
    (None, prose(120, 1)),  # a null id
    (9, prose(3000, 2)),
    (10, prose(60, 3) + " " + prose(60, 3) + " " + prose(60, 3)),
    (11, "ünïcödé ß " + prose(80, 4)),
    (12, prose(40, 5) + "\n" + prose(70, 1)),
    (13, "x" * 450),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, long and repeated texts, and columns whose names clash with what operators add or use."""
    rows = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", 9, "x", -1) for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, node string, block long").repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
