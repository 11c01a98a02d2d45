"""Answers about single records of a run, from its tables alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import controller_copy
from .reconcile import Reconciliation


def known_ids(run: Reconciliation) -> DataFrame:
    """id of every invoice, payment and bank credit that the run speaks of."""
    m = run.matches.select(F.col("ledger_id").alias("id")).union(run.matches.select(F.explode("payment_ids")))
    e = run.exceptions.select(F.coalesce("ledger_id", "bank_id").alias("id"))
    return m.union(e).union(run.decisions.select("subject_id")).where("id IS NOT NULL").distinct()


#: Letters of the pieces that ids are indexed by.
GRAM = 6


def _grams(text: Column, n: Column | int) -> Column:
    last = F.char_length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, n if isinstance(n, Column) else F.lit(n)))))


def find_record_ids(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """``questions`` (q_id, question and whatever else) with the longest id each holds, letter case aside (the
    least of equally long ones), or null.

    Ids are indexed by their rarest piece of GRAM letters, shorter ones by all they are. A question that
    holds an id holds its piece, so pieces are joined and what they bring is held against the question.
    Null and empty ids are held by none; a null question holds none. The joins shuffle: a table's size is
    guessed before its rows are cut into pieces, so a table taken for small may be far too large to broadcast.
    """
    own = ids.where("id <> ''").select("id", F.lower("id").alias("_low")).distinct()
    own = own.withColumn("_n", F.least(F.char_length("_low"), F.lit(GRAM)))
    pieces = own.select("id", "_low", "_n", F.explode(_grams(F.col("_low"), F.col("_n"))).alias("_gram"))
    common = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_uses"))
    rarest = pieces.join(common.hint("merge"), "_gram").groupBy("id", "_low").agg(F.min(F.struct("_uses", "_gram")).alias("_g")).select("id", "_low", F.col("_g._gram").alias("_gram"))
    asked = questions.select("q_id", F.lower("question").alias("_q")).where("_q IS NOT NULL")
    lengths = sorted(r["_n"] for r in own.select("_n").distinct().collect())
    every = F.flatten(F.array(F.array().cast("array<string>"), *[F.coalesce(_grams(F.col("_q"), n), F.array().cast("array<string>")) for n in lengths]))
    held = asked.select("q_id", "_q", F.explode(every).alias("_gram")).join(rarest.hint("merge"), "_gram").where(F.col("_q").contains(F.col("_low")))
    best = held.groupBy("q_id").agg(F.min(F.struct((-F.length("id")).alias("n"), "id")).alias("_b"))
    return questions.join(best.hint("merge"), "q_id", "left").select(*questions.columns, F.col("_b.id").alias("id"))


def find_record_id(questions: Sequence[str], ids: DataFrame) -> DataFrame:
    """The same for a few strings, which q_id numbers from 0."""
    return find_record_ids(ids.sparkSession.createDataFrame(list(enumerate(questions)), "q_id int, question string"), ids)


def context(run: Reconciliation, record_id: str) -> dict:
    """The match, exception and decision that have the id, as invoice or as payment."""
    own = F.col("ledger_id") == record_id
    first = lambda df: next((r.asDict(recursive=True) for r in df.limit(1).collect()), None)
    match = first(run.matches.where(own | F.array_contains("payment_ids", record_id)))
    subject = match["ledger_id"] if match else record_id
    exceptions = run.exceptions.withColumn("copy", controller_copy(F.col("reason"), F.col("summary")))
    return {
        "id": record_id, "match": match,
        "exception": first(exceptions.where(own | (F.col("bank_id") == record_id))),
        "decision": first(run.decisions.where(F.col("subject_id") == subject)),
    }


def template_answer(found: dict) -> str:
    match, exception, decision = found["match"], found["exception"], found["decision"]
    tools = ", ".join(dict.fromkeys((decision or {}).get("tools_called") or []))
    # Only the model's own tier makes calls for a single record; for the others these are what the run is able to do.
    made = (decision or {}).get("tier") == "agent"
    checked = f" {'The model called' if made else 'The run had at hand'}: {tools}." if tools else ""
    if match:
        why = "; ".join(match["evidence"]) or "no evidence recorded"
        return f"{match['ledger_id']} was matched to {', '.join(match['payment_ids'])} ({match['tier']}, confidence {match['confidence']:.2f}): {why}.{checked}"
    if exception:
        return f"{found['id']} is open ({exception['reason'].replace('_', ' ')}): {exception['copy']}{checked}"
    return f"Nothing in this run is about {found['id']}."


def _other_ids(better: str, plain: str, ids: DataFrame) -> bool:
    """Whether ``better`` names a record of the run that ``plain`` does not, by its whole id."""

    def held(text: str):
        words = F.lit(" " + re.sub(r"[^\w-]+", " ", text.lower()) + " ")
        return words.contains(F.concat(F.lit(" "), F.lower("id"), F.lit(" ")))

    return not ids.where(held(better) & ~held(plain)).isEmpty()


def answer(run: Reconciliation, question: str, polish: Callable[[str, dict], str] | None = None) -> dict:
    """Answer by template, or by ``polish`` if it succeeds and names no id beyond the question's."""
    record_id = find_record_id([question], known_ids(run)).first()["id"]
    if record_id is None:
        return {"id": None, "answer": "No record of this run is named in the question.", "source": "template"}
    found = context(run, record_id)
    plain = template_answer(found)
    if polish:
        try:
            better = polish(plain, found)
            if isinstance(better, str) and better.strip() and not _other_ids(better, plain, known_ids(run)):
                return {"id": record_id, "answer": better, "source": "model"}
        except Exception:
            return {"id": record_id, "answer": plain, "source": "template"}
    return {"id": record_id, "answer": plain, "source": "template"}
