"""Column expressions for prompts and completions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template, values: dict[str, object]) -> Column:
    """Replace every ``{name}`` by its value (a column or a literal)."""
    parts = [(k, v if isinstance(v, Column) else F.lit(str(v))) for k, v in values.items()]
    return reduce(
        lambda text, kv: F.replace(text, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))),
        parts, _c(template),
    )


def drop_lines(text, word: str) -> Column:
    """Remove the lines that contain a word."""
    lines = F.split(_c(text), "\n")
    return F.array_join(F.filter(lines, lambda x: F.instr(x, word) == 0), "\n")


def numbered_items(text) -> Column:
    """Items of a numbered list, as an array in text order."""
    return F.regexp_extract_all(_c(text), F.lit(r"\d+\.\s([^\n]+)"), 1)


def numbered_list(items) -> Column:
    """``1. a`` newline ``2. b`` ... of an array."""
    lines = F.transform(_c(items), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.array_join(lines, "\n")


def braces(text) -> Column:
    """From the first ``{`` to the last ``}``, across lines; '' if there is none."""
    return F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)


def parse_reply(text) -> Column:
    """Struct (score, reasoning) of a JSON object; NULL score when unusable.

    The score may be any number or a quoted number.
    """
    obj = F.from_json(_c(text), "score STRING, reasoning STRING")
    score = obj["score"].try_cast("double")
    return F.struct(F.when(~F.isnan(score), score).alias("score"), obj["reasoning"].alias("reasoning"))
