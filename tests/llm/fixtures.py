"""Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, k int, `group` long, spans string"


def texts() -> list[tuple[int | None, str | None]]:
    passage = " ".join(f"word{i}" for i in range(70))
    base = " ".join(f"common{i % 97} tail{i}" for i in range(120))
    rows = [(i, f"doc {i} " + " ".join(f"w{i}x{j}" for j in range(i % 40))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (None, "no id here"), (None, None)]
    rows += [(110 + i, "one text that repeats exactly") for i in range(25)]
    rows += [(200 + i, f"start {i} {passage} end {i}") for i in range(30)]
    rows += [(240, passage), (241, passage.upper()), (242, passage.replace(" ", "  \n"))]
    rows += [(300 + i, base.replace("tail7 ", f"tail7{i} ")) for i in range(12)]
    rows += [(400, "x" * 40_000), (401, ("don't  stop\n\n" * 4000)), (402, "ééé — “quoted” 日本語 👩‍👧 " * 500), (403, "same same " * 400)]
    rows += [(404, "ends <|endoftext|>here <|startoftext|>"), (405, "<|endoftext|>")]
    rows += [(500, "repeated row"), (500, "repeated row"), (501, "one id"), (501, "two texts")]
    return rows


def documents(spark: SparkSession, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", 2, 3, "s") for i, t in rows], SCHEMA).repartition(3)
