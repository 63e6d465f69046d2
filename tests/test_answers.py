"""Stored answers as blocks and tables."""

from parimutuel.operators import answers

TEXT = """Intro | not a table
# First
| A | B |
|---|:-:|
| 1 | 2 |
|  x y |  | more |
| only |

- one
- two
1. three
## Second
| no rule |
| here |
text

| C |
|---|
"""


def told(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, result string")


def test_blocks(spark):
    got = [(r.section, r.kind, r.place, r.text) for r in answers.blocks(told(spark, TEXT)).orderBy("line").collect()]
    assert got[0] == (None, "text", 0, "Intro | not a table") and got[1] == ("First", "heading", 0, "# First")
    assert [g[1:3] for g in got if g[0] == "First"] == [("heading", 0), *(("row", i) for i in range(5)), *(("item", i) for i in range(3))]
    assert [g[1] for g in got if g[0] == "Second"] == ["heading", "row", "row", "text", "row", "row"]


def test_cells(spark):
    got = [(r.section, r.row, r.column, r.heading, r.cell) for r in answers.table_cells(told(spark, TEXT, "", None)).orderBy("run", "row", "column").collect()]
    assert got == [("First", 0, 0, "A", "1"), ("First", 0, 1, "B", "2"), ("First", 1, 0, "A", "x y"), ("First", 1, 1, "B", ""), ("First", 2, 0, "A", "only")]


def test_what_an_answer_lacks(spark):
    asked = {"First": (2, 4), "Second": (1, 2), "Third": (0, 9)}
    got = {(r.id, r.section): r.problem for r in answers.shortcomings(told(spark, TEXT, "# Third\n## The First\nx"), asked).collect()}
    assert got == {("0", "Second"): "rows", ("0", "Third"): "missing", ("1", "First"): "rows", ("1", "Second"): "missing"}
