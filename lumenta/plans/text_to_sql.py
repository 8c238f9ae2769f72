"""Questions to SQL by any model that is handed in: a bounded loop of asking, admitting and repairing."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lumenta.plans.admission import Admission, admit

ATTEMPTS, MOST_TABLES, MOST_COLUMNS, REFUSAL = 3, 40, 40, "CANNOT_ANSWER"


@dataclass
class Answer:
    sql: str | None = None
    admission: Admission | None = None
    attempts: list[str] = field(default_factory=list)
    declined: str | None = None


def schema_context(views: dict[str, DataFrame]) -> str:
    lines = []
    for name in sorted(views)[:MOST_TABLES]:
        columns = views[name].dtypes
        more = f", and {len(columns) - MOST_COLUMNS} more" if len(columns) > MOST_COLUMNS else ""
        lines.append(f"{name}({', '.join(f'{c} {t}' for c, t in columns[:MOST_COLUMNS])}{more})")
    if len(views) > MOST_TABLES:
        lines.append(f"-- {len(views) - MOST_TABLES} more tables are not shown")
    return "\n".join(lines)


def extract_sql(reply: str) -> str | None:
    """The statement in a fence, or else what starts at a line with WITH or SELECT."""
    if m := re.search(r"```(?:sql)?\s*\n?(.*?)```", reply, re.DOTALL | re.IGNORECASE):
        return m[1].strip() or None
    m = re.search(r"^\s*((?:with|select)\b.*)", reply, re.DOTALL | re.IGNORECASE | re.MULTILINE)
    return m[1].strip() if m else None


def ask(spark: SparkSession, question: str, views: dict[str, DataFrame], model: Callable[[str], str] | None = None, attempts: int = ATTEMPTS) -> Answer:
    """An admitted statement, or why none was given. Without a model the question is declined."""
    if model is None:
        return Answer(declined="no model is configured")
    out, prompt = Answer(), f"Tables:\n{schema_context(views)}\n\nQuestion: {question}\nReply with one read-only SQL statement, or {REFUSAL}."
    for _ in range(attempts):
        reply = model(prompt)
        if REFUSAL in reply:
            return Answer(attempts=[*out.attempts, reply], declined="the model can't answer from these tables")
        sql = extract_sql(reply)
        out.attempts.append(sql or reply)
        own = admit(spark, sql, views) if sql else None
        if own is not None and own.ok:
            return Answer(sql, own, out.attempts)
        why = "\n".join(f"- {f.rule}: {f.message} {f.hint or ''}" for f in own.findings) if own else "- no statement found"
        prompt = f"{prompt}\n\nThis was rejected:\n{sql or reply}\nbecause:\n{why}\nReply with a corrected statement."
    out.declined = f"no admissible statement in {attempts} attempts"
    return out
