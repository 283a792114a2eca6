"""Sources and sinks of ledgers and tables: JSON lines of several kinds, contract-checked Parquet, sinks that
replace or upsert."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.contracts import Contract, ContractError


def read_ledger(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with a declared schema. Lines that don't parse are dropped, or with ``strict`` fail the read."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = declared.add("_corrupt_record", "string") if "_corrupt_record" not in declared.names else declared
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(row.alias("r")).filter(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")


def bad_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, line, text) of each file's first line that isn't JSON of the schema, lines counted from 1. Files are read
    in splits by many tasks: each split counts its lines and finds its first bad one, and what stands before a split
    is the sum of the counts of those before it. Blank lines count but aren't bad."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = (F.trim("value") != "") & (row["_corrupt_record"].isNotNull() | row.isNull())
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min(F.when(bad, F.struct("at", "value"))).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    found = splits.withColumn("line", before + F.col("bad.at") - F.col("first") + 1).filter("bad is not null")
    return found.groupBy("file").agg(F.min(F.struct("line", F.col("bad.value").alias("text"))).alias("b")).select("file", "b.line", "b.text")


def read_strict(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines of which all must parse; otherwise an error that names the file, the line and its text."""
    if first := bad_lines(spark, path, schema).orderBy("file", "line").first():
        raise ContractError(f"{first.file}:{first.line}: not a row of {schema}: {first.text[:200]}")
    return read_ledger(spark, path, schema)


def read_ledger_without(spark: SparkSession, path: str, schema: str, text: str = '"error"') -> DataFrame:
    """JSON lines but for those that hold ``text`` anywhere, judged before parsing."""
    return spark.read.text(path).filter(~F.col("value").contains(text)).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_present(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The paths that exist, asked of the file system that Spark reads."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = [p for p in paths if fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))]
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def read_judges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory with one folder a judge; its name, with ``__`` for ``/``, becomes a column."""
    folder = F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).json(f"{path}/*").withColumn("judge_model", F.replace(folder, F.lit("__"), F.lit("/")))


def read_prompts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document with a list of prompts, a row for each."""
    return spark.read.schema(f"prompts array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("prompts").alias("p")).select("p.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, plain or gzip, under a declared schema; a line that doesn't fit fails the read."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.csv(path, header=True, compression=compression)


def read_registry(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """Union by name of (format, path, schema) entries, with the format each row came in: jsonl, csv or parquet."""
    out = None
    for kind, path, schema in entries:
        df = {"jsonl": lambda: read_ledger(spark, path, schema), "csv": lambda: read_csv(spark, path, schema), "parquet": lambda: spark.read.schema(schema).parquet(path)}[kind]()  # noqa: B023
        df = df.withColumn("source_format", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ContractError("the registry is empty")
    return out


def read_config_list(spark: SparkSession, path: str, field: str, kind: str = "string") -> DataFrame:
    """One row for each entry of a list in a JSON configuration document (a deny list, a roster)."""
    return spark.read.schema(f"`{field}` array<{kind}>").json(path, multiLine=True).select(F.explode(field).alias(field))


#: A plain value of a YAML line: in single quotes, in double quotes, or bare, and a comment.
_SCALAR = re.compile(r"""\s*(?:'((?:[^']|'')*)'|"([^"]*)"|([^#\s'"{\[&*](?:[^#]|(?<=\S)#)*?))?\s*(?:(?<!\S)#.*)?""")
_FIELD = re.compile(r"(- +)?([\w.-]+):(?: +(.*))?")
_FOLDED = (">", "|", ">-", "|-")


def yaml_entries(text: str) -> list[tuple[str, int, str | None, str | None]]:
    """(list, entry, key, value) of the top-level lists and maps of one document; see read_yaml_lists."""

    def plain(x: str) -> str | None:
        if not (m := _SCALAR.fullmatch(x)):
            raise ContractError(f"not a plain value: {x}")
        return m[1].replace("''", "'") if m[1] is not None else m[2] if m[2] is not None else m[3]

    rows, name, entry, first, folded = [], None, 0, None, None
    for number, line in enumerate(text.split("\n"), 1):
        body, indent = line.strip(), len(line) - len(line.lstrip())
        if folded is not None and (indent > folded or not body):
            if body:
                rows[-1] = (*rows[-1][:3], f"{rows[-1][3]} {body}".strip())
            continue
        folded = None
        if not body or body[0] == "#" or body == "---":
            continue
        field = _FIELD.fullmatch(body)
        if indent == 0 and field and not field[1]:
            name, entry, first = field[2], 0, None
            if (m := re.fullmatch(r"\[(.*)\] *(?:#.*)?", field[3] or "")) and m[1].strip():
                rows += [(name, i, None, plain(x)) for i, x in enumerate(m[1].split(","), 1)]
            continue
        if name is None:
            raise ContractError(f"line {number} isn't understood: {line}")
        first = indent if first is None else first
        if not field and not body.startswith("- "):
            raise ContractError(f"line {number} isn't understood: {line}")
        starts = body.startswith("- ") or indent == first
        entry += starts
        if not field:
            rows.append((name, entry, None, plain(body[2:])))
        elif field[3] in _FOLDED:
            rows.append((name, entry, field[2], ""))
            folded = indent
        elif (value := plain(field[3] or "")) is None and starts and not field[1]:
            rows.append((name, entry, None, field[2]))  # a map's key, with what it holds below
        else:
            rows.append((name, entry, field[2], value))
    return rows


def read_yaml_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list, entry, key, value) of the top-level lists and maps of configuration files in YAML's block form, entries
    counted from 1. An entry that is a plain value, or a map's key with more below it, has it as value under a null
    key; ``key: value`` lines of an entry give a row each. Comments and quotes go, text folded after > or | is joined
    by spaces, a list in brackets on one line is read too, single settings are passed over. A line of any other form
    fails: a deny list that is read in part would be worse.

    Such files are small: one row holds one file."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for text in pdf["value"] for r in yaml_entries(text)]
            yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("list", "entry", "key", "value"))})

    return spark.read.text(path, wholetext=True).mapInPandas(parsed, "list string, entry int, key string, value string")


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Writes a version beside the others, then points to it: the pointer is a small file that one rename replaces, so
    readers see the old version or the new, whenever the writer dies. The version before stays for those who read
    it; older ones go."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path
    fs = where(path).getFileSystem(conf)
    before = snapshot_version(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    new = where(f"{path}/.pointer-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(new, where(f"{path}/pointer.txt"), how)
    for found in fs.listStatus(where(path)):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            fs.delete(found.getPath(), True)


def snapshot_version(spark: SparkSession, path: str) -> str | None:
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer.txt")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.text(str(pointer.toString())).first()[0]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names now; what was read stays this version."""
    if (version := snapshot_version(spark, path)) is None:
        raise ContractError(f"{path} holds no snapshot")
    return spark.read.parquet(f"{path}/{version}")


def write_metadata(spark: SparkSession, path: str, **fields: object) -> None:
    """One JSON document of a table's metadata."""
    import json

    spark.createDataFrame([(json.dumps(fields, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_checked(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    return contract.enforce(spark.read.parquet(path))


def wide_to_vector(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The columns that begin with the prefix, in the order of their numbers, as one array."""
    names = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c.removeprefix(prefix)))
    return df.select(key, F.array(*[F.col(c).cast("double") for c in names]).alias("vector"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by Spark; for manifests of release files, which are small."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a JSON array of all rows, in order, NaN as null; for tables made for a browser."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    item = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("_json"))
    return df.select(*clean).select(item.alias("i")).agg(F.array_sort(F.collect_list("i")).alias("l")).select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["_json"]), ","), F.lit("]")).alias("json"))


def freeze(df: DataFrame, path: str, inputs: str) -> None:
    """Writes a table once, under a manifest of its inputs' hash; a second call with the same inputs does nothing,
    with others it fails."""
    spark = df.sparkSession
    manifest = f"{path}/_manifest"
    where = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        if (was := spark.read.text(manifest).first()[0]) != inputs:
            raise ContractError(f"{path} is frozen from other inputs: {was}")
        return
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(inputs,)], "value string").coalesce(1).write.text(manifest)
