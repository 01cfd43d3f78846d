"""Record CSV source and sink.

Inside Spark multi-valued fields are arrays; only the CSV boundary flattens
them with the delimiters of the original files, and reading splits them back.
Empty strings are read as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reclink.session import materialize

# fixed values: delimiters of multi-valued fields in the record CSV files
DELIMS = {
    "participants": ", ",
    "disciplines": ";",
    "flemishDisciplines": ";",
    "organization": ", ",
    "projId": ",",
}

PROJECT_COLUMNS = ["projId", "title", "abstract", "participants", "disciplines", "flemishDisciplines",
                   "organization", "dataProvider"]
PUBLICATION_COLUMNS = ["id", "projId", "title", "abstract", "participants", "disciplines", "organization",
                       "flemishDisciplines", "dataProvider"]


def read_records_csv(spark: SparkSession, path: str, kind: str = "projects", split: bool = True,
                     schema: str | None = None, ranges: bool = False) -> DataFrame:
    """Header CSV (quoted multi-line fields allowed), all columns string unless a
    ``schema`` is given; with ``split`` the multi-valued fields become arrays.

    Multi-line fields make a file one task.  With ``ranges`` a file is read in byte ranges
    by many tasks instead (``read_ranges``).
    """
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("mode", "PERMISSIVE"))
    df = (reader.schema(schema) if schema else reader)
    df = read_ranges(spark, path, df.csv(path).schema) if ranges else df.csv(path)
    if not split:
        return df
    arrays = [c for c in DELIMS if c in df.columns and not (kind == "projects" and c == "projId")]
    for c in arrays:
        d = DELIMS[c]
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.array().cast("array<string>"))
                                .otherwise(F.split(F.col(c), _re(d))))
    return df


def read_ranges(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of header CSV files, every file read in byte ranges.

    Lines are read by splits of the scan and written once with their split and place.  A
    line inside a quoted field is one with an odd number of quotes before it, so the parity
    of a split, summed over the splits before it, tells the state in which it begins; the
    same sums of record starts number the records.  Only the table of splits is summed in
    file order.  Lines of a record are brought together and parsed by ``from_csv``.

    Defined cases: quotes stand in quoted fields only, doubled (RFC 4180); records end in
    "\\n" or "\\r\\n", line breaks inside fields stay as they are; empty records are skipped;
    the first record of each file is its header; a quote that is never closed makes the rest
    of its file one record.  Compressed files are one range.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = materialize(spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("nr"), (quotes % 2).alias("odd")))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    inside = Window.partitionBy("file", "at").orderBy("nr")
    opened = lines.groupBy("file", "at").agg(F.sum("odd").alias("odd")).select(
        "file", "at", F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("quotes"))
    odd_before = F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.join(opened, ["file", "at"]).withColumn(
        "starts", F.when((F.col("quotes") + F.coalesce(odd_before, F.lit(0))) % 2 == 0, 1).otherwise(0))
    numbered = marked.withColumn("here", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    bases = numbered.groupBy("file", "at").agg(F.sum("starts").alias("n")).select(
        "file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    records = (numbered.join(bases, ["file", "at"]).groupBy("file", (F.col("base") + F.col("here")).alias("record"))
               .agg(F.sort_array(F.collect_list(F.struct("at", "nr", "value"))).alias("parts")))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), "\\r$", "")
    options = {"escape": '"', "mode": "PERMISSIVE"}
    return (records.where("record > 1").select(text.alias("text")).where("text <> ''")
            .select(F.from_csv("text", _ddl(schema), options).alias("r")).select("r.*"))


def write_records_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Arrays joined with their delimiters, header row, no index."""
    out = df
    for c, d in DELIMS.items():
        if c in df.columns and df.schema[c].dataType.typeName() == "array":
            out = out.withColumn(c, F.array_join(F.col(c), d))
    # the writer would trim white space at the ends of values otherwise
    (out.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path))


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _re(d: str) -> str:
    import re
    return re.escape(d).replace("\\ ", " ")
