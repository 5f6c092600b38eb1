"""Scoring of paragraphs through a pluggable scorer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Names of the five scores.
LABELS = {1: "Sin preocupación fiscal", 2: "Leve preocupación", 3: "Neutral o técnico", 4: "Alta preocupación", 5: "Alarma fiscal"}
#: Rows scored in one call.
BATCH = 100

Scorer = Callable[[list[str]], list["int | None"]]


def prompt(text: Column, context: str, template: str) -> Column:
    """Context and template with the text in the place of ``{text}``; braces inside the text are safe."""
    before, _, after = template.partition("{text}")
    return F.concat(F.lit(context), F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))


def parse_reply(reply: Column) -> Column:
    """The score of a reply: one digit from 1 to 5, else null."""
    t = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike("^[1-5]$"), t.try_cast("int"))


def label(score: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[score]


def keyword_scorer(texts: list[str]) -> list[int | None]:
    """Deterministic stand-in for a language model: counts of alarming against reassuring words."""
    bad = ("riesgo", "deterioro", "incumpl", "desviaci", "insosten", "déficit", "erosion", "adverso")
    good = ("cumplimiento", "consolidación", "transparen", "prudente", "estable", "superávit")
    out: list[int | None] = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        low = t.lower()
        d = sum(low.count(w) for w in bad) - sum(low.count(w) for w in good)
        out.append(max(1, min(5, 3 + (d > 0) + (d > 2) - (d < 0) - (d < -2))))
    return out


def retrying(scorer: Scorer, tries: int = 5, first_wait: float = 2.0, longest_wait: float = 30.0, per_minute: float | None = None, sleep: Callable[[float], None] = time.sleep) -> Scorer:
    """``scorer`` with further tries after a failure, waiting twice as long each time, and at most so many calls a minute in one task.

    The last failure is raised.
    """

    def call(texts: list[str]) -> list[int | None]:
        wait = first_wait
        for k in range(tries):
            if per_minute:
                sleep(60.0 / per_minute)
            try:
                return scorer(texts)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(wait)
                wait = min(2 * wait, longest_wait)
        return []

    return call


def score_rows(df: DataFrame, scorer: Scorer = keyword_scorer, text_col: str = "text", score_col: str = "fiscal_risk_score") -> DataFrame:
    """Rows with their score and risk index; rows already scored keep theirs.

    Each reply stays with its own row; the scorer is called for batches inside
    the tasks and must be picklable.
    """
    have = score_col in df.columns
    base = df if have else df.withColumn(score_col, F.lit(None).cast("int"))
    schema = StructType([f if f.name != score_col else StructField(score_col, IntegerType()) for f in base.schema])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            todo = f.index[f[score_col].isna()]
            got: list = []
            for k in range(0, len(todo), BATCH):
                texts = ["" if t is None or t != t else t for t in f.loc[todo[k : k + BATCH], text_col]]
                got += scorer(texts)
            col = f[score_col].astype("Int64")
            col.loc[todo] = pd.array(got, dtype="Int64")
            yield f.assign(**{score_col: col})

    out = base.mapInPandas(run, schema)
    return out.withColumn("risk_index", tone_index(F.col(score_col)))


def tone_index(score: Column) -> Column:
    """From 1 (score 1) over 0 (score 3) to -1 (score 5)."""
    return (F.lit(3) - score) / 2


def pending(df: DataFrame, score_col: str = "fiscal_risk_score") -> DataFrame:
    """Rows still to be scored."""
    return df.where(F.col(score_col).isNull())
