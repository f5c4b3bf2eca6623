"""Reading and writing contract CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.fixed import fixed_rows
from tidemark.functions.pin import pin
from tidemark.sources.contracts import Contract

MALFORMED = "_malformed"


def scan_contract(spark: SparkSession, path: str, contract: Contract, delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """All contract columns as text, plus source file, record number (the header is 1) and arity verdict.

    Nothing is inferred: the first record of every file must equal the contract, or the scan fails.  A record with too few or too many values
    (an empty one has none) keeps its text in ``_malformed``, empty values are NULL.  ``multiline`` allows quoted line breaks; a file whose
    quotes do not close fails the scan then.  Files are split across tasks either way.
    """
    records = split_records(text_lines(spark, path), multiline)
    header = delimiter.join(contract.columns)
    first = F.col("source_row_number") == 1
    plain = F.regexp_replace(F.regexp_replace("record", "^\ufeff", ""), '"', "")
    wrong = F.raise_error(F.concat(F.lit(f"header of {contract.dataset} differs from the contract: "), "source_file", F.lit(" has "), plain))
    body = records.where(F.when(first & (plain != header), wrong.cast("boolean")).otherwise(~first))
    kinds = ", ".join(f"`{c}` string" for c in [*contract.columns, MALFORMED])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED, "maxCharsPerColumn": "-1"}
    parsed = body.withColumn("__values", F.from_csv("record", kinds, options))
    empty = F.col("record") == ""
    malformed = F.when(empty, F.col("record")).otherwise(F.col(f"__values.{MALFORMED}"))
    return parsed.select(*[F.when(~empty, F.col(f"__values.{c}")).alias(c) for c in contract.columns], malformed.alias(MALFORMED), "source_file", "source_row_number")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, source_file, block, id: the lines of all files, in order of id within a block of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _before_block(blocks: DataFrame, measure: str) -> DataFrame:
    """What the earlier blocks of a file hold together; a file has one small row per block."""
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("source_file", "block", F.coalesce(F.sum(measure).over(earlier), F.lit(0)).alias("before"))


def split_records(lines: DataFrame, multiline: bool = True) -> DataFrame:
    """record, source_file, source_row_number: lines joined where a line break stands inside quotes.

    A line starts inside quotes where the quotes before it in its file are odd in number: a prefix sum, within blocks and over
    their totals.  So is a record's number.  Only lines of broken records are gathered; all others stay where they are.
    """
    at = ["source_file", "block"]
    inside = Window.partitionBy(*at).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))) if multiline else F.lit(0)
    # Lines are shuffled once: record starts are counted for a block that begins outside quotes; where it begins inside them, the other lines start.
    even = ((F.col("upto") - F.col("odd")) % 2 == 0).cast("long")
    counted = pin(lines.withColumn("odd", quotes % 2).withColumn("upto", F.sum("odd").over(inside))
                  .withColumns({"even": F.sum(even).over(inside), "line": F.sum(F.lit(1).cast("long")).over(inside)}))
    totals = counted.groupBy(*at).agg(F.sum("odd").alias("odd"), F.max("even").alias("even"), F.max("line").alias("line"))
    parity = F.col("before") % 2 == 1
    begun = totals.join(_before_block(totals, "odd"), at).withColumn("starts", F.when(parity, F.col("line") - F.col("even")).otherwise(F.col("even")))
    # One small row per block goes to the lines, which stay where they are.
    blocks = F.broadcast(begun.select(*at, "before", "starts").join(_before_block(begun, "starts").withColumnRenamed("before", "records"), at).drop("starts"))
    placed = counted.join(blocks, at)
    open_ = (F.col("before") + F.col("upto") - F.col("odd")) % 2 == 1
    nth = F.when(parity, F.col("line") - F.col("even")).otherwise(F.col("even"))
    numbered = placed.select("value", *at, "id", (~open_).cast("long").alias("starts"), ((F.col("before") + F.col("upto")) % 2 == 0).alias("ends"),
                             (F.col("records") + nth).alias("source_row_number"))
    one_line = (F.col("starts") == 1) & F.col("ends")
    text = F.regexp_replace("value", "\r$", "")
    whole = numbered.where(one_line).select(text.alias("record"), "source_file", "source_row_number")
    if not multiline:
        return whole
    gathered = numbered.where(~one_line).groupBy("source_file", "source_row_number").agg(
        F.array_sort(F.collect_list(F.struct("block", "id", "value", "ends"))).alias("l"))
    closed = F.element_at("l", -1)["ends"]
    unclosed = F.raise_error(F.concat(F.lit("quotes do not close in "), "source_file", F.lit(" from record "), F.col("source_row_number").cast("string"))).cast("string")
    joined = F.when(closed, F.regexp_replace(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), "\r$", "")).otherwise(unclosed)
    return whole.unionByName(gathered.select(joined.alias("record"), "source_file", "source_row_number"))


def canonical_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every column as contract text: NULL becomes empty, timestamps UTC with ``Z``, booleans lower case."""
    kinds = dict(df.dtypes)

    def text(c: str):
        if kinds[c].startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if kinds[c] == "date":
            return F.date_format(c, "yyyy-MM-dd")
        return F.col(c).cast("string")

    return df.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in columns or df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Write canonical text as CSV part files with stable columns."""
    (canonical_text(df).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def snapshot_audit(spark: SparkSession, source_dir: str, contracts: list[Contract]) -> DataFrame:
    """Files present, missing or unexpected against the contracts, and records per dataset.

    Datasets are files ``<name>.csv`` or folders of part files with that name.
    """
    name = F.regexp_extract("path", r"/([^/]+)\.csv(?:/|$)", 1)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source_dir)
             .select(name.alias("dataset"), "length").groupBy("dataset").agg(F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("bytes")))
    # Only names that a contract asks for come to the driver, whatever else the folder holds.
    present = {r.dataset for r in files.where(F.col("dataset").isin([c.dataset for c in contracts])).select("dataset").collect()}
    audit = fixed_rows(spark, [(c.dataset,) for c in contracts], ["dataset"]).withColumn("expected", F.lit(True)).unionByName(
        files, allowMissingColumns=True)
    for c in contracts:
        if c.dataset in present:
            audit = audit.unionByName(scan_contract(spark, f"{source_dir}/{c.dataset}.csv", c).agg(
                F.lit(c.dataset).alias("dataset"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(MALFORMED).isNotNull()).alias("malformed_count")),
                allowMissingColumns=True)
    for c in ("row_count", "malformed_count"):
        if c not in audit.columns:
            audit = audit.withColumn(c, F.lit(None).cast("long"))
    status = F.when(F.max("file_count").isNull(), "missing").when(F.max("expected").isNull(), "unexpected").otherwise("present")
    return audit.groupBy("dataset").agg(status.alias("status"), F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
                                        F.coalesce(F.max("malformed_count"), F.lit(0)).alias("malformed_count"))
