"""Canonical batches from an uploaded CSV file, fully validated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_minor
from ..schema import Batch, canonical

# fixed values: the columns of an upload, the first five required
COLUMNS = ("source", "id", "date", "amount", "currency", "reference", "counterparty", "memo", "parentId", "fees", "tax", "ifsc")
REQUIRED = COLUMNS[:5]
SOURCES = ("bank", "settlement", "ledger")
TEMPLATE = ",".join(COLUMNS)
#: Uploads are small by contract: larger files are refused, not cut.
UPLOAD_BYTES = 5 << 20
_CSV = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


@dataclass(frozen=True)
class Parsed:
    batch: Batch | None
    error: str | None

    @property
    def ok(self) -> bool:
        return self.error is None


def split_line(line: Column, fields: int) -> Column:
    """array<string> of a line's first ``fields`` fields, trimmed; quotes protect commas, doubled quotes are one."""
    schema = ", ".join(f"c{i} string" for i in range(fields))
    row = F.from_csv(line, schema, _CSV)
    return F.array(*[F.coalesce(F.trim(row[f"c{i}"]), F.lit("")) for i in range(fields)])


def _lines(spark: SparkSession, text: DataFrame) -> DataFrame:
    """line_no (from 1, blank lines apart) and line of the one text in ``text`` (value)."""
    parts = text.select(F.filter(F.split("value", r"\r\n|\n|\r"), lambda x: F.trim(x) != "").alias("l"))
    return parts.select(F.posexplode("l").alias("_n", "line")).select((F.col("_n") + 1).alias("line_no"), "line")


def parse_file(spark: SparkSession, path: str, dataset_id: str = "uploaded") -> Parsed:
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > UPLOAD_BYTES:
        return Parsed(None, f"The file is larger than {UPLOAD_BYTES} bytes.")
    return parse_frame(spark, spark.read.text(path, wholetext=True), dataset_id)


def parse_text(spark: SparkSession, text: str, dataset_id: str = "uploaded") -> Parsed:
    return parse_frame(spark, spark.createDataFrame([(text,)], "value string"), dataset_id)


def errors(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (line_no and the columns, null where empty) with the first thing wrong in each, or null.

    Rows of several uploads have columns ``by`` that tell these apart. An id's first line comes from an
    aggregation that is joined back, so rows of one id need not meet, and rows without one do not take part.
    """

    def got(name: str) -> Column:
        return F.concat(F.lit('got "'), F.coalesce(F.col(name), F.lit("")), F.lit('".'))

    number = r"^\d+(\.\d{1,2})?$"
    keys = [*by, "source", "id"]
    first = rows.where("source IS NOT NULL AND id IS NOT NULL").groupBy(*keys).agg(F.min("line_no").alias("_first"))
    real_date = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    # fixed values that a user may look for: the column in quotes, and "duplicate"
    message = (
        F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), F.concat(F.lit(f'"source" can be {", ".join(SOURCES)}; '), got("source")))
        .when(F.col("id").isNull(), F.lit('"id" has no value.'))
        .when(F.col("_again"), F.concat(F.lit('duplicate id "'), F.col("id"), F.lit('" among rows of '), F.col("source"), F.lit('.')))
        .when(~F.coalesce(real_date, F.lit(False)), F.concat(F.lit('"date" is no day like 2026-01-31; '), got("date")))
        .when(~F.coalesce(F.col("amount").rlike(r"^-?\d+(\.\d{1,2})?$"), F.lit(False)), F.concat(F.lit('"amount" is no number of two decimals at most; '), got("amount")))
        .when(F.col("currency").isNull(), F.lit('"currency" has no value.'))
    )
    for name in ("fees", "tax"):
        message = message.when(~F.coalesce(F.col(name).rlike(number), F.lit(True)), F.concat(F.lit(f'"{name}" is no number from 0 on; '), got(name)))
    found = rows.join(first, keys, "left").withColumn("_again", F.coalesce(F.col("line_no") > F.col("_first"), F.lit(False))).withColumn("error", F.concat(F.lit("row "), F.col("line_no").cast("string"), F.lit(": "), message))
    return found.select(*rows.columns, "error")


def parse_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Many uploads (upload, value: one text each) in one plan: the canonical records of those that are right,
    with their upload, and what is first wrong in each other one (upload, error).

    One text is in one task, which its size limit bounds; rows are checked wherever they are.
    """
    lines = uploads.select("upload", F.octet_length("value").alias("_size"), F.filter(F.split("value", r"\r\n|\n|\r"), lambda x: F.trim(x) != "").alias("_l"))
    most = lines.agg(F.max(F.length(F.get("_l", F.lit(0))) - F.length(F.replace(F.get("_l", F.lit(0)), F.lit(",")))) + 1).first()[0] or 1
    lines = lines.withColumn("_h", split_line(F.get("_l", F.lit(0)), most))
    lacking = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.coalesce("_h", F.array().cast("array<string>")))
    whole = F.when(F.col("_size") > UPLOAD_BYTES, F.lit(f"The file is larger than {UPLOAD_BYTES} bytes.")).when(F.size("_l") == 0, F.lit("There is nothing in the file (empty)."))
    whole = whole.when(F.size(lacking) > 0, F.concat(F.lit("Columns that an upload needs are not there: "), F.array_join(lacking, ", "), F.lit(".")))
    whole = whole.when(F.size("_l") == 1, F.lit("No data rows follow the header."))
    lines = lines.withColumn("_error", whole)
    cells = lines.where("_error IS NULL").select("upload", "_h", F.posexplode("_l").alias("_n", "_line")).where("_n > 0")
    cells = cells.select("upload", (F.col("_n") + 1).alias("line_no"), "_h", split_line(F.col("_line"), most).alias("_f"))

    def cell(name: str) -> Column:
        return F.nullif(F.get("_f", F.array_position("_h", name).cast("int") - 1), F.lit(""))

    named = F.filter(F.arrays_zip(F.col("_h").alias("k"), F.col("_f").alias("v")), lambda x: x["k"] != "")
    rows = cells.select("upload", "line_no", *[cell(c).alias(c) for c in COLUMNS], F.map_from_entries(named).alias("raw"))
    checked = errors(rows, ("upload",))
    wrong = checked.where("error IS NOT NULL").groupBy("upload").agg(F.min_by("error", "line_no").alias("error"))
    problems = lines.where("_error IS NOT NULL").select("upload", F.col("_error").alias("error")).unionByName(wrong)
    right = rows.join(wrong.select("upload"), "upload", "left_anti")
    records = right.select(
        "upload", F.col("line_no").alias("ord"), "id", "source", F.col("date").cast("date").alias("date"), to_minor(F.col("amount")).alias("amount"), F.upper("currency").alias("currency"),
        "reference", "counterparty", "memo", F.col("parentId").alias("parent_id"), to_minor(F.col("fees")).alias("fees"), to_minor(F.col("tax")).alias("tax"), "ifsc", "raw",
    )
    return records, problems


def parse_frame(spark: SparkSession, text: DataFrame, dataset_id: str) -> Parsed:
    """The batch, or the first error in the order of rows. Dates that no calendar has are errors too."""
    lines = _lines(spark, text)
    first = lines.where("line_no = 1").first()
    if first is None:
        return Parsed(None, "There is nothing in the file (empty).")
    width = first["line"].count(",") + 1
    header = lines.where("line_no = 1").select(split_line(F.col("line"), width).alias("h")).first()["h"]
    missing = [c for c in REQUIRED if c not in header]
    if missing:
        return Parsed(None, f"Columns that an upload needs are not there: {', '.join(missing)}.")
    place = {name: i for i, name in enumerate(header)}
    cells = lines.where("line_no > 1").select("line_no", split_line(F.col("line"), width).alias("_f"))
    rows = cells.select(
        "line_no",
        *[(F.nullif(F.get("_f", F.lit(place[c])), F.lit("")) if c in place else F.lit(None).cast("string")).alias(c) for c in COLUMNS],
        F.map_from_arrays(F.array(*[F.lit(h) for h in dict.fromkeys(header)]), F.array(*[F.get("_f", F.lit(place[h])) for h in dict.fromkeys(header)])).alias("raw"),
    )
    checked = errors(rows)
    summary = checked.agg(F.count(F.lit(1)).alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error"), F.min_by(F.upper("currency"), "line_no").alias("base")).first()
    if summary["error"]:
        return Parsed(None, summary["error"])
    if not summary["n"]:
        return Parsed(None, "No data rows follow the header.")
    records = canonical(
        rows.select(
            F.col("line_no").alias("ord"), "id", "source", F.col("date").cast("date").alias("date"), to_minor(F.col("amount")).alias("amount"), F.upper("currency").alias("currency"),
            "reference", "counterparty", "memo", F.col("parentId").alias("parent_id"), to_minor(F.col("fees")).alias("fees"), to_minor(F.col("tax")).alias("tax"), "ifsc", "raw",
        )
    )
    return Parsed(Batch(dataset_id, summary["base"], *[records.where(F.col("source") == s) for s in SOURCES]), None)
