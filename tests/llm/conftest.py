import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHES = ("id", "key", "row", "word", "n", "a", "b", "fp", "component", "component_id", "score", "start", "end", "spans", "tokens", "kept", "line", "h", "node", "toxic", "grams", "bands", "cell", "item_id")

LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty, blank and long texts, repeated rows and ties, and columns with clashing names."""
    from pyspark.sql import functions as F

    same = "\n".join(f"the same line number {i} of many words" for i in range(8))
    pairs = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here, token = abcdefgh"), (None, None), (4, same), (4, same), (5, same), (6, LONG), (7, "Licensed under the MIT License."), (8, "😀 é\u0000 ß"), (9, "a"), (10, "\n\n\n")]
    out = documents(pairs)
    return out.select("*", *(F.lit(7).alias(c) for c in CLASHES))
