"""Column expressions: hashing, numeric clean-up, feature names, method strings.

Everything here is a JVM-side expression, so it stays inside whole-stage codegen
where Spark supports it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60  # 15 hex digits of an md5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_hash(seed, *cols) -> Column:
    """Seeded 60-bit hash with the same value in every engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def stable_uniform(seed, *cols) -> Column:
    """Seeded uniform draw in [0, 1)."""
    return stable_hash(seed, *cols).cast("double") / F.lit(float(1 << HASH_BITS))


def nan_to_null(c) -> Column:
    c = _c(c).cast("double")
    return F.when(~F.isnan(c), c)


def zero_if_missing(c) -> Column:
    """NaN or NULL becomes 0 (the fill value is always 0, quirk Q7)."""
    c = _c(c).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def zscore(c, mean: float, scale: float) -> Column:
    """Standardize with fitted constants; a zero spread divides by one."""
    return (_c(c).cast("double") - F.lit(float(mean))) / F.lit(float(scale) if scale else 1.0)


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def years_since(year: int, c) -> Column:
    return F.lit(year) - _c(c)


def whole_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, rounded towards minus infinity."""
    seconds = F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))
    return F.floor(seconds / F.lit(86400.0)).cast("bigint")


def feature_name(concept, category) -> Column:
    return F.concat_ws("_", _c(concept), _c(category).cast("string"))


def concept_of(feature) -> Column:
    """The part of a feature name before its first underscore."""
    return F.split_part(_c(feature), F.lit("_"), F.lit(1))


def is_one_hot(feature) -> Column:
    return F.instr(_c(feature), "_") > 0


def dot(cols: list[str], weights, intercept: float = 0.0) -> Column:
    """Linear margin over wide columns with literal weights."""
    terms = [F.col(c) * F.lit(float(w)) for c, w in zip(cols, weights, strict=True) if float(w) != 0.0]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def digamma_int(n) -> Column:
    """Digamma of a positive count: shift up by 8, then the asymptotic series."""
    n = _c(n).cast("double")
    shifted = n + F.lit(8.0)
    inv2 = F.lit(1.0) / (shifted * shifted)
    series = F.log(shifted) - F.lit(0.5) / shifted - inv2 * (
        F.lit(1.0 / 12) - inv2 * (F.lit(1.0 / 120) - inv2 * (F.lit(1.0 / 252) - inv2 * F.lit(1.0 / 240)))
    )
    return reduce(lambda acc, i: acc - F.lit(1.0) / (n + F.lit(float(i))), range(8), series)


METHOD_FIELDS = ["method", "llm_model", "decoding", "context", "examples"]


def method_fields(fs_method) -> dict[str, Column]:
    """The five fields of ``method[:model:decoding:context:examples]``; absent → ''."""
    parts = F.split(_c(fs_method), ":")
    return {
        name: F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))
        for i, name in enumerate(METHOD_FIELDS)
    }


def variant_name(decoding, context, examples, expls, lo, hi, suffix=None) -> Column:
    """Name of a score variant built from its flags and its score range.

    Explanations win over plain examples; the default range [0, 1] is not named.
    """
    flag = lambda cond, text: F.when(_c(cond), F.lit(text))
    parts = [
        _c(decoding),
        flag(context, "context"),
        F.when(_c(expls), F.lit("expls")).when(_c(examples), F.lit("examples")),
    ]
    if suffix is not None:
        parts.append(_c(suffix))
    plain = (_c(lo) == 0) & (_c(hi) == 1)
    parts.append(F.when(~plain, F.concat_ws("_", _c(lo).cast("string"), _c(hi).cast("string"))))
    return F.concat_ws("_", *parts)


def lookup(mapping: dict[str, object], key, default=None) -> Column:
    """Code → display value through a literal map (the maps are short fixed tables)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.element_at(F.create_map(*pairs), _c(key))
    return value if default is None else F.coalesce(value, _c(default))
