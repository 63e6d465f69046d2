"""Stored answers as tables: the blocks of a text with headings, lists and pipe tables.

What a screen would render becomes rows that can be queried. A line is a heading (one
to six ``#``), a list item (``-``, ``*`` or a number), a row of a pipe table, blank, or a
paragraph's line. A table is a run of lines with a pipe at both ends whose second
line has dashes alone; other runs are paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kind(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^#{1,6} +\S"), "heading")
        .when(line.rlike(r"^\|.*\|$"), "row")
        .when(line.rlike(r"^([-*]|[0-9]+\.) +\S"), "item")
        .when(line == "", "blank")
        .otherwise("text")
    )


def blocks(answers: DataFrame) -> DataFrame:
    """(id, line, section, kind, run, place, text) of every line of (id, result) that is not blank.

    ``section`` is the heading above, null before the first; ``run`` numbers stretches of
    lines of one kind and ``place`` the lines in them, both from 0.
    """
    lines = answers.select("id", F.posexplode(F.split("result", "\n")).alias("line", "text")).withColumn("text", F.trim(F.col("text")))
    sorted_ = Window.partitionBy("id").orderBy("line")
    title = F.when(F.col("kind") == "heading", F.regexp_replace("text", "^#+ +", ""))
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(sorted_)), 0).otherwise(1)
    runs = lines.withColumn("kind", kind(F.col("text"))).withColumn("section", F.last(title, True).over(sorted_)).withColumn("new", new)
    numbered = runs.withColumn("run", (F.sum("new").over(sorted_) - 1).cast("int"))
    place = (F.row_number().over(Window.partitionBy("id", "run").orderBy("line")) - 1).alias("place")
    return numbered.select("id", "line", "section", "kind", "run", place, "text").where("kind <> 'blank'")


def cells(line: Column) -> Column:
    """The trimmed cells of a table's line."""
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def table_cells(answers: DataFrame) -> DataFrame:
    """(id, section, run, row, column, heading, cell) of the tables' cells, rows from 0 below their headings.

    A row with more cells than the heading has loses them, one with fewer is left short.
    """
    rows = blocks(answers).where("kind = 'row'")
    ruled = F.max(F.when((F.col("place") == 1) & F.col("text").rlike(r"^\|[ :|-]*-[ :|-]*\|$"), 1)).over(Window.partitionBy("id", "run"))
    head = F.first(F.when(F.col("place") == 0, cells(F.col("text"))), True).over(Window.partitionBy("id", "run").orderBy("place"))
    tables = rows.withColumns({"ruled": ruled, "head": head}).where("ruled = 1 AND place > 1")
    flat = tables.select("id", "section", "run", (F.col("place") - 2).alias("row"), "head", F.posexplode(cells(F.col("text"))).alias("column", "cell"))
    return flat.where(F.col("column") < F.size("head")).select("id", "section", "run", "row", "column", F.get("head", F.col("column")).alias("heading"), "cell")


def shortcomings(answers: DataFrame, sections: dict[str, tuple[int, int]]) -> DataFrame:
    """(id, section, problem): what an answer lacks of the sections asked for, each with its least and most table rows.

    ``missing`` where no heading holds the section's name, ``rows`` where its tables have
    too few or too many.
    """
    spark = answers.sparkSession
    asked = spark.createDataFrame([(k, low, high) for k, (low, high) in sections.items()], "asked string, low int, high int")
    named = blocks(answers).where("kind = 'heading'").select("id", "section").distinct()
    counts = table_cells(answers).select("id", "section", "run", "row").distinct().groupBy("id", "section").agg(F.count("*").alias("n"))
    have = named.join(counts, ["id", "section"], "left").select("id", "section", F.coalesce("n", F.lit(0)).alias("n"))
    wanted = answers.select("id").distinct().withColumn("w", F.explode(F.array(*(F.struct(F.lit(k).alias("asked"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in sections.items())))).select("id", "w.*")
    fits = have.join(F.broadcast(asked.select("asked")), F.contains("section", "asked")).groupBy("id", "asked").agg(F.sum("n").alias("n"))
    both = wanted.join(fits, ["id", "asked"], "left")
    problem = F.when(F.col("n").isNull(), "missing").when(~F.col("n").between(F.col("low"), F.col("high")), "rows")
    return both.select("id", F.col("asked").alias("section"), problem.alias("problem")).where("problem IS NOT NULL")
