"""Operator 2: mixing sources to target weights by iterative proportional fitting.

The corpus is summed to cells of source, language and topic. Raking multiplies the cells' token weights,
one axis after the other, so that each axis's sums meet its targets. What the raked weights ask of a cell,
against what it has, gives the probability by which its documents are drawn; probabilities are scaled so
that the expected number of tokens is the budget, none above one. A document is drawn if a hash of its
doc_id is under its probability, so the same documents are drawn every time, on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, whole_text

AXES = ("source", "lang", "topic")
#: Targets are the shares to this power, where none are given: between as they are (1) and equal (0).
TEMPER = 0.7
#: Raking ends when no axis's value is further off its target than this share, or after so many rounds.
TOLERANCE = 1e-10
MOST_ROUNDS = 100
#: Rounds and scalings that the SQL spells out, as it cannot stop by a test: more than the tables need.
SQL_ROUNDS = 30
SQL_SCALINGS = 12
BUDGET = 0.6
SEED = 17
_WHITE = " \n\t\r"


def n_tokens(text: Column) -> Column:
    """White-space characters and one; 0 for an empty text."""
    white = F.char_length(text) - F.char_length(F.translate(text, _WHITE, ""))
    return F.when(text == "", F.lit(0)).otherwise(white + 1).cast("bigint")


def topic(text: Column) -> Column:
    """What kind of text it is: the table has no topics of its own."""
    return (
        F.when(text.contains("icense") | text.contains("rights reserved") | text.contains("Copyright"), "legal")
        .when(text.contains("@") | text.contains("http"), "contact")
        .when(text.contains(" | "), "list")
        .otherwise("prose")
    )


def _facts(docs: DataFrame, topic_of: Column | None = None, *more: Column) -> DataFrame:
    """_source, _lang, _topic and _tokens of each row, and ``more``; ``topic_of`` is a column of the caller's own topics."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("source", "lang")]
    kind = topic(whole_text()) if topic_of is None else F.coalesce(topic_of.cast("string"), F.lit(""))
    return docs.select(*more, *known, kind.alias("_topic"), n_tokens(whole_text()).alias("_tokens"))


def raked_cells(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """_source, _lang, _topic, tokens, raked: each cell's token weight before and after raking.

    ``targets`` has weights of some axes' values (the others' stay out: weight 0); an axis without any is
    tempered. Weights of an axis are scaled to sum to the corpus's tokens.
    """
    return _raked(docs, targets, topic_of).select(*[f"_{a}" for a in AXES], "tokens", "raked")


def marginal_gaps(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None) -> DataFrame:
    """axis, value, target, raked, gap: what raking was to reach, what it has, and how far it is off, relatively.

    Targets that contradict each other leave a gap; so do values that no cell could bring up.
    """
    return _gaps(_raked(docs, targets, topic_of))


def _gaps(cells: DataFrame) -> DataFrame:
    out = None
    for axis in AXES:
        sums = cells.groupBy(f"_{axis}").agg(F.first(f"_target_{axis}").alias("target"), F.sum("raked").alias("raked"))
        own = sums.select(F.lit(axis).alias("axis"), F.col(f"_{axis}").alias("value"), "target", "raked")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("gap", F.when(F.col("target") > 0, F.abs(F.col("raked") / F.col("target") - 1)).otherwise(F.when(F.col("raked") > 0, 1.0).otherwise(0.0)))


def _raked(docs: DataFrame, targets: dict[str, dict[str, float]] | None, topic_of: Column | None) -> DataFrame:
    """The cells with the targets of their axes, raked."""
    keys = [f"_{a}" for a in AXES]
    cells = _facts(docs, topic_of).groupBy(*keys).agg(F.sum("_tokens").cast("double").alias("tokens")).where("tokens > 0")
    cells = saved(cells, "cells")
    n = cells.count()
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    for axis in AXES:
        sums = cells.groupBy(f"_{axis}").agg(F.sum("tokens").alias("_s"))
        given = (targets or {}).get(axis)
        if given is None:
            sums = sums.withColumn("_w", F.pow("_s", F.lit(TEMPER)))
        else:
            table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
            sums = sums.withColumn("_w", F.coalesce(F.try_element_at(table, F.col(f"_{axis}")), F.lit(0.0)).cast("double"))
        whole = sums.agg(F.coalesce(F.sum("_w"), F.lit(0.0))).first()[0]
        scale = total / whole if whole else 0.0
        cells = cells.join(sums.select(f"_{axis}", (F.col("_w") * scale).alias(f"_target_{axis}")), f"_{axis}")
    cells = saved(cells.withColumn("raked", F.col("tokens")), "raked", n)
    gap, stuck = float("inf"), 0
    for _ in range(MOST_ROUNDS):
        for axis in AXES:
            sums = cells.groupBy(f"_{axis}").agg(F.sum("raked").alias("_s"))
            cells = cells.join(sums, f"_{axis}").withColumn(
                "raked", F.when(F.col("_s") > 0, F.col("raked") * F.col(f"_target_{axis}") / F.col("_s")).otherwise(F.lit(0.0))
            ).drop("_s")
        cells = saved(cells, "raked", n)
        before, gap = gap, _gaps(cells).agg(F.max("gap")).first()[0] or 0.0
        stuck = stuck + 1 if gap >= before else 0
        if gap <= TOLERANCE or stuck == 3:  # targets that cannot be met together leave the gap as it is
            break
    return cells


def cell_probabilities(
    docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None
) -> DataFrame:
    """The cells' probabilities: _source, _lang, _topic, probability."""
    cells = raked_cells(docs, targets, topic_of).withColumn("wish", F.col("raked") / F.col("tokens"))
    scale = 1.0
    for _ in range(MOST_ROUNDS):
        full = F.col("wish") * scale >= 1
        total, held, free = cells.agg(
            F.coalesce(F.sum("tokens"), F.lit(0.0)),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("raked"))), F.lit(0.0)),
        ).first()
        before, scale = scale, max((budget * total - held) / free if free > 0 else scale, 0.0)
        if abs(scale - before) <= TOLERANCE * max(scale, before):
            break
    return cells.select(*[f"_{a}" for a in AXES], F.least(F.lit(1.0), F.col("wish") * scale).alias("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that only depends on the doc_id; a null counts as empty."""
    code = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(code, 1, 12), 16, 10).cast("double") / float(1 << 48)


def drawn(
    docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None
) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, source, lang and whatever else), each whole as the struct _doc, with
    _topic, _tokens, _probability and _kept. Columns of any name stand in _doc without getting in the way.

    A null source or lang counts as empty, a null text as an empty one; rows without tokens weigh nothing
    and are kept. Repeated rows are drawn alike. An empty table gives an empty result.
    """
    cells = cell_probabilities(docs, budget, targets, topic_of).withColumnRenamed("probability", "_probability")
    rows = _facts(docs, topic_of, F.struct("*").alias("_doc"), F.col("doc_id").alias("_id")).join(cells, [f"_{a}" for a in AXES], "left")
    rows = rows.withColumn("_probability", F.when(F.col("_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("_probability", F.lit(0.0))))
    return rows.select("_doc", "_topic", "_tokens", "_probability", (draw(F.col("_id")) < F.col("_probability")).alias("_kept"))


def mixed(
    docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, topic_of: Column | None = None
) -> DataFrame:
    """The rows of :func:`drawn` with the columns of ``docs`` followed by _topic, _tokens, _probability and
    _kept. Where ``docs`` has a column of such a name, the new one has further underscores before its own."""
    taken = {c.lower() for c in docs.columns}
    own = []
    for name in ("_topic", "_tokens", "_probability", "_kept"):
        free = name
        while free in taken:
            free = f"_{free}"
        own.append(F.col(name).alias(free))
    return drawn(docs, budget, targets, topic_of).select("_doc.*", *own)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select(
        "doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


def _op2_sql() -> str:
    text = "coalesce(text, '')"
    ctes = [
        f"""facts AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
        CASE WHEN contains({text}, 'icense') OR contains({text}, 'rights reserved') OR contains({text}, 'Copyright') THEN 'legal'
             WHEN contains({text}, '@') OR contains({text}, 'http') THEN 'contact'
             WHEN contains({text}, ' | ') THEN 'list' ELSE 'prose' END AS topic,
        CASE WHEN {text} = '' THEN 0 ELSE length({text}) - length(replace(replace(replace(replace({text}, ' ', ''), chr(10), ''), chr(9), ''), chr(13), '')) + 1 END AS n
        FROM documents)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS double) AS tokens, CAST(sum(n) AS double) AS raked FROM facts GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for a in AXES:
        ctes.append(
            f"t_{a} AS MATERIALIZED (SELECT {a}, pow(s, {TEMPER}) * (SELECT sum(tokens) FROM c0) / sum(pow(s, {TEMPER})) OVER () AS target"
            f" FROM (SELECT {a}, sum(tokens) AS s FROM c0 GROUP BY {a}))"
        )
    k = 0
    for _ in range(SQL_ROUNDS):
        for a in AXES:
            ctes.append(
                f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, raked * target / sum(raked) OVER (PARTITION BY c.{a}) AS raked"
                f" FROM c{k} c JOIN t_{a} t ON c.{a} = t.{a})"
            )
            k += 1
    ctes.append("s0 AS MATERIALIZED (SELECT 1.0::double AS scale)")
    for j in range(SQL_SCALINGS):
        ctes.append(
            f"s{j + 1} AS MATERIALIZED (SELECT greatest(0, ({BUDGET} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE raked / tokens * scale >= 1), 0))"
            f" / sum(raked) FILTER (WHERE raked / tokens * scale < 1)) AS scale FROM c{k}, s{j})"
        )
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, f.topic, CAST(n AS bigint) AS n_tokens, round(p, 6) AS probability,
       CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS varchar), '')), 1, 12) AS bigint) / {float(1 << 48)} < p AS kept
FROM (SELECT f.*, CASE WHEN n = 0 THEN 1.0 ELSE coalesce(least(1.0, raked / tokens * (SELECT scale FROM s{SQL_SCALINGS})), 0.0) END AS p
      FROM facts f LEFT JOIN c{k} c ON f.source = c.source AND f.lang = c.lang AND f.topic = c.topic) f"""
    )


OP2_SQL = _op2_sql()
