"""Two-way cash records in the long format: a row has an A side or a B side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_minor
from ..schema import canonical

# fixed values: the columns of the format
SHARED = ("matchId", "matchDate", "matchRule", "matchedBy", "wasPreviouslyMismatched")
SIDE = ("transactionType", "id", "importDate", "debitOrCredit", "amount", "valueDate", "currencyCode", "account", "transactionReferences", "transactionAttributes")
FIELDS = (*SHARED, *(f"A_{c}" for c in SIDE), "A_allocation", *(f"B_{c}" for c in SIDE), "targetAllocation")
SOLUTION = ("B_id", "targetAllocation", "Usage")
_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "encoding": "UTF-8", "enforceSchema": False}


def read_rows(spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows by header, in any order of columns; columns that the file lacks and empty fields are ''."""
    found = spark.read.options(**(_OPTIONS | {"enforceSchema": True})).csv(path)
    return found.select(*[(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) if c in found.columns else F.lit("")).alias(c) for c in fields])


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """B_id, targetAllocation, Usage; by place where the header has other names."""
    found = spark.read.options(**_OPTIONS).csv(path)
    names = [c if c in found.columns else found.columns[i] if i < len(found.columns) else None for i, c in enumerate(SOLUTION)]
    return found.select(*[(F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) if n else F.lit("")).alias(c) for n, c in zip(names, SOLUTION, strict=True)])


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """An external result: b_id, a_id (null if empty), confidence (1 where absent)."""
    found = spark.read.options(**_OPTIONS).csv(path)
    confidence = F.coalesce(F.try_to_number(F.col("confidence"), F.lit("9.999999")).cast("double"), F.lit(1.0)) if "confidence" in found.columns else F.lit(1.0)
    return found.select(F.trim("B_id").alias("b_id"), F.nullif(F.trim("A_id"), F.lit("")).alias("a_id"), confidence.alias("confidence"))


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, eval and solution of a folder."""
    return read_rows(spark, f"{folder}/train.csv"), read_rows(spark, f"{folder}/eval.csv"), read_solution(spark, f"{folder}/solution.csv")


def _memo(side: str) -> Column:
    parts = [F.nullif(F.trim(F.col(f"{side}_{c}")), F.lit("")) for c in ("transactionReferences", "transactionAttributes")]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def _side(rows: DataFrame, side: str, source: str) -> DataFrame:
    amount = F.trim(F.col(f"{side}_amount"))
    own = rows.where((F.trim(F.col(f"{side}_id")) != "") & amount.rlike(r"^-?\d+(\.\d{1,2})?$"))
    return canonical(
        own.select(
            F.xxhash64(f"{side}_id").alias("ord"), F.concat(F.lit(f"{side}_"), F.col(f"{side}_id")).alias("id"), F.lit(source).alias("source"),
            F.try_to_date(F.trim(F.col(f"{side}_valueDate")), "yyyy-MM-dd").alias("date"), to_minor(amount).alias("amount"),
            F.coalesce(F.nullif(F.trim(F.col(f"{side}_currencyCode")), F.lit("")), F.lit("USD")).alias("currency"), _memo(side).alias("memo"),
        )
    )


def ledger_side(rows: DataFrame) -> DataFrame:
    """A sides as invoices. The allocation is no column of it: what scores cannot be seen by the matcher."""
    return _side(rows, "A", "ledger")


def settlement_side(rows: DataFrame) -> DataFrame:
    return _side(rows, "B", "settlement")


def own_allocations(rows: DataFrame) -> DataFrame:
    """Truth: a_id and its key."""
    return rows.where(F.trim("A_id") != "").select(F.concat(F.lit("A_"), "A_id").alias("a_id"), F.nullif(F.trim("A_allocation"), F.lit("")).alias("key"))


def true_allocations(rows: DataFrame, solution: DataFrame | None = None) -> DataFrame:
    """Truth: b_id and its key, of the rows themselves or of a solution."""
    table = rows if solution is None else solution
    return table.where(F.trim("B_id") != "").select(F.concat(F.lit("B_"), "B_id").alias("b_id"), F.nullif(F.trim("targetAllocation"), F.lit("")).alias("key"))
