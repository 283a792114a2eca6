"""Contracts on tables and joins: violations are rows, and joins check the cardinality they declare."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A table or join isn't what was declared."""


@dataclass
class Contract:
    """Required columns, key, allowed values, and conditions that each row must meet."""

    columns: list[str] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    enums: dict[str, list[str]] = field(default_factory=dict)
    checks: dict[str, Column] = field(default_factory=dict)
    rows: int | None = None

    def violations(self, df: DataFrame) -> DataFrame:
        """(check, detail, n): empty when all holds. Row checks share one pass."""
        spark = df.sparkSession
        missing = [c for c in [*self.columns, *self.key, *self.enums] if c not in df.columns]
        if missing:
            return spark.createDataFrame([("columns", c, 1) for c in sorted(set(missing))], "check string, detail string, n long")
        tests = {f"enum:{c}": F.col(c).isNotNull() & ~F.col(c).isin(allowed) for c, allowed in self.enums.items()} | {f"row:{n}": ~F.coalesce(c, F.lit(False)) for n, c in self.checks.items()}
        parts = []
        if tests or self.rows is not None:
            counts = df.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(n) for n, t in tests.items()])
            names = list(tests)
            stack = ", ".join([f"'{n}', '', `{n}`" for n in names] + ([f"'rows', cast(rows as string), abs(rows - {self.rows})"] if self.rows is not None else []))
            parts.append(counts.selectExpr(f"stack({len(names) + (self.rows is not None)}, {stack}) as (check, detail, n)").filter("n > 0"))
        if self.key:
            repeated = df.groupBy(*self.key).agg(F.count("*").alias("n")).filter("n > 1")
            parts.append(repeated.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("key").alias("check"), F.lit(", ".join(self.key)).alias("detail"), "n"))
        empty = spark.createDataFrame([], "check string, detail string, n long")
        return reduce(DataFrame.unionByName, parts, empty)

    def enforce(self, df: DataFrame) -> DataFrame:
        if found := self.violations(df).collect():
            raise ContractError("; ".join(f"{r.check} {r.detail}: {r.n}" for r in found))
        return df


def repeated_keys(df: DataFrame, key: list[str]) -> int:
    return df.groupBy(*key).count().filter("count > 1").count()


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """A join that fails, with counts, where a side that must be unique isn't."""
    for side, df, unique in (("left", left, validate[0] == "1"), ("right", right, validate[-1] == "1")):
        if unique and (n := repeated_keys(df, on)):
            raise ContractError(f"{side} side of a {validate} join: {n} keys repeat over {on}")
    return left.join(right, on, how)


def match_report(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys by where they are: both, left_only or right_only."""
    a, b = left.select(*on).distinct().withColumn("_l", F.lit(1)), right.select(*on).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full").withColumn("side", side).drop("_l", "_r")


def exact_key_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A one-to-one join of two tables with exactly the same keys; else it fails with both counts."""
    alone = {s: a.join(b, on, "left_anti").limit(1).count() for s, a, b in (("left", left, right), ("right", right, left))}
    if any(alone.values()):
        raise ContractError(f"keys without a partner: {alone}")
    return checked_join(left, right, on, "inner", "1:1")


def disjoint(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    return left.join(right, on, "left_semi").isEmpty()


def same_set(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def drift(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value is new, gone or another, null-safe."""
    a, b = old.select(*key, F.col(value).alias("old")), new.select(*key, F.col(value).alias("new"))
    return a.join(b, key, "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def forbid_columns(df: DataFrame, names: set[str]) -> DataFrame:
    if found := sorted(c for c in df.columns if c.lower() in names):
        raise ContractError(f"columns that must not leave: {found}")
    return df


def forbidden_fields(df: DataFrame, words: list[str]) -> list[tuple[str, str]]:
    """(path, word) of every column and nested field (of structs, arrays and maps) whose name holds a forbidden word, in
    any case."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType

    def walk(kind: DataType, path: str):
        if isinstance(kind, StructType):
            for f in kind.fields:
                at = f"{path}.{f.name}".lstrip(".")
                yield from ((at, w) for w in words if w.lower() in f.name.lower())
                yield from walk(f.dataType, at)
        elif isinstance(kind, ArrayType):
            yield from walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            yield from walk(kind.valueType, f"{path}{{}}")

    return sorted(walk(df.schema, ""))


def forbidden_keys(df: DataFrame, payload: str, words: list[str]) -> DataFrame:
    """(word, key, n): rows whose JSON payload has a key, at any depth, that holds a forbidden word, in any case."""
    keys = F.array_distinct(F.regexp_extract_all(F.col(payload), F.lit(r'"((?:[^"\\\\]|\\\\.)*)"\s*:'), F.lit(1)))
    found = df.select(F.explode(keys).alias("key")).withColumn("word", F.explode(F.array(*[F.lit(w.lower()) for w in words])))
    return found.filter(F.contains(F.lower("key"), F.col("word"))).groupBy("word", "key").agg(F.count("*").alias("n"))


def refuse_forbidden(df: DataFrame, words: list[str], payloads: list[str] = ()) -> DataFrame:
    """df, if neither its fields nor the keys of its JSON payloads hold a forbidden word."""
    if bad := forbidden_fields(df, words):
        raise ContractError(f"forbidden fields: {', '.join(p for p, _ in bad)}")
    for payload in payloads:
        if row := forbidden_keys(df, payload, words).orderBy("word", "key").first():
            raise ContractError(f"forbidden key {row.key} in {payload} of {row.n} rows")
    return df
