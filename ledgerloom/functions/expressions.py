"""Column expressions: derived fields, intervals and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def home_status(focus: Column, jurisdiction: Column, general: str, homeless: str) -> Column:
    """general before not_defined before home; general is never away."""
    return F.when(focus == general, "general").when(jurisdiction == homeless, "not_defined").when(focus == jurisdiction, "home").otherwise("away")


def in_range(code: Column, low: int = 1, high: int = 5) -> Column:
    return F.coalesce(code.between(low, high), F.lit(False))


def default_if_empty(value: Column, default: str) -> Column:
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, name in cases[1:]:
        out = out.when(condition, name)
    return out.otherwise(default)


def last_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """The name of the last condition that holds, as where later assignments overwrite earlier ones."""
    return first_match(cases[::-1], default)


def overlap_state(refusal: Column, failure: Column) -> Column:
    """Refusal and failure are independent: both, either or neither."""
    return first_match([(refusal & failure, "both"), (refusal, "refusal_only"), (failure, "failure_only")], "neither")


def genuine_refusal(substantive: Column, quality: Column) -> Column:
    return substantive.isin("explicit", "implicit") & quality.isin("coherent", "partly_coherent")


def capability_failure(fidelity: Column, quality: Column, technical: Column, version: str = "2.4") -> Column:
    """Rule 2.2 leaves technical failures out."""
    found = (fidelity == "wrong_language") | (quality == "incoherent_garbled")
    return found if version == "2.2" else found | (technical != "none")


def argmax_name(scores: dict[str, Column], least: float, default: str) -> Column:
    """Name of the largest score that is at least ``least``; the first named wins ties."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return first_match([((c == top) & (c >= least), name) for name, c in scores.items()], default)


def percent_points(value: Column) -> Column:
    return value * 100


def row_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by NUL."""
    return F.sha2(F.concat_ws("\0", *fields), 256)


def short_id(*fields: Column, digits: int = 24) -> Column:
    return F.substring(row_hash(*fields), 1, digits)


def key_string(*fields: Column) -> Column:
    return F.concat_ws("‖", *fields)


def uniform(seed: str, *fields: Column) -> Column:
    """A number in [0, 1) from a hash of seed and fields: the same in every engine and run."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *fields), 256), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def wilson(events: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the score interval; null where n is 0."""
    p, z2 = F.try_divide(events.cast("double"), n), z * z
    d = 1 + F.try_divide(F.lit(z2), n)
    mid = (p + F.try_divide(F.lit(z2), 2 * n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n)) / d
    return mid - half, mid + half


def logit_interval(p: Column, se: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval on the logit scale, mapped back; null at 0 and 1."""
    inside = (p > 0) & (p < 1)
    eta, step = F.ln(p / (1 - p)), z * se / (p * (1 - p))
    return F.when(inside, 1 / (1 + F.exp(-(eta - step)))), F.when(inside, 1 / (1 + F.exp(-(eta + step))))


def union_probability(*ps: Column) -> Column:
    """Probability of at least one of independent draws: one minus the product of the others' complements."""
    miss = F.lit(1.0)
    for p in ps:
        miss = miss * (1 - p)
    return 1 - miss


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def beta_yield(events: Column, n: Column, more: int) -> list[Column]:
    """Jeffreys posterior of a rate (mean, sd), and the events to expect of ``more`` further trials with their standard
    deviation (beta-binomial)."""
    a, b = events + 0.5, n - events + 0.5
    spread = a * b / (F.pow(a + b, 2) * (a + b + 1))
    return [(a / (a + b)).alias("mean"), F.sqrt(spread).alias("sd"), (more * a / (a + b)).alias("expected"), F.sqrt(more * spread * (a + b + more)).alias("predictive_sd")]


def exact_sum(x: Column) -> Column:
    """The sum of doubles as decimals of 18 places, so that no order of rows changes it; a plain sum where one has no
    such decimal."""
    d = x.try_cast("decimal(38,18)")
    return F.when(F.count(x) == F.count(d), F.try_sum(d).cast("double")).otherwise(F.sum(x))


def with_prefix(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in df.columns})


def latent_label_draw(*_: Column) -> Column:
    """Draws of latent labels from a prevalence are switched off on purpose: they aren't identified by these data."""
    raise NotImplementedError("latent label draws are disabled")
