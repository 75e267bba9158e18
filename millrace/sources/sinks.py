"""Sinks: SQL literals and files, Parquet, JSON, JDBC, and a guarded reset."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 1000


def sql_literal(df: DataFrame, c: str) -> Column:
    """A column as SQL literals: NULL, TRUE, bare numbers, quoted text with doubled quotes, ISO times.

    Doubles are written through a decimal, without an exponent.
    """
    kind, x = df.schema[c].dataType.typeName(), F.col(c)
    if kind == "boolean":
        text = F.upper(x.cast("string"))
    elif kind in ("short", "integer", "long", "byte", "decimal"):
        text = x.cast("string")
    elif kind in ("float", "double"):
        text = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif kind in ("timestamp", "timestamp_ntz"):
        text = F.concat(F.lit("'"), F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))
    elif kind == "date":
        text = F.concat(F.lit("'"), x.cast("string"), F.lit("'"))
    elif kind in ("array", "struct", "map", "variant"):
        text = F.concat(F.lit("'"), F.replace(F.to_json(x), F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def value_rows(df: DataFrame) -> DataFrame:
    """(values): one ``(a, b, ...)`` for each row."""
    return df.select(F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(df, c) for c in df.columns]), F.lit(")")).alias("values"))


def insert_statements(df: DataFrame, table: str, batch: int = BATCH) -> DataFrame:
    """(sql): INSERT statements of at most ``batch`` rows, grouped within each partition, so nothing is shuffled."""
    head = f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, df.columns))}) VALUES"

    def group(frames):
        import pandas as pd

        for f in frames:
            rows = f["values"].tolist()
            parts = [rows[i : i + batch] for i in range(0, len(rows), batch)]
            yield pd.DataFrame({"sql": [f"{head}\n" + ",\n".join(p) + ";" for p in parts]})

    return value_rows(df).mapInPandas(group, "sql string")


#: What stands before and after the statements of one table, so that it loads in one transaction without key checks.
_BEGIN, _COMMIT = "BEGIN;\nSET session_replication_role = 'replica';\n", "SET session_replication_role = 'origin';\nCOMMIT;\n"
#: The file that loads the others.
LOADER = "load.sql"


def write_sql(df: DataFrame, table: str, path: str, batch: int = BATCH) -> None:
    """INSERT statements as text files, a file for each partition, and one that loads them all in one transaction.

    ``load.sql`` is written last, so a folder without it is not whole; it names the files it includes.
    """
    insert_statements(df, table, batch).write.mode("overwrite").text(path)
    store, at, _ = _file(path)
    names = sorted(s.getPath().getName() for s in store.listStatus(at))
    parts = [f"\\ir {n}\n" for n in names if n.startswith("part-")]
    write_text("".join([_BEGIN, *parts, _COMMIT]), f"{path}/{LOADER}")


def write_parquet(df: DataFrame, path: str, expected: DataFrame | None = None, mode: str = "append") -> None:
    """Append rows (or overwrite: the form of TRUNCATE) after a check of their columns."""
    if expected is not None and expected.columns != df.columns:
        raise ValueError(f"columns {df.columns} are not {expected.columns}")
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = BATCH, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def reset(spark: SparkSession, directory: str, order: tuple[str, ...], confirm: bool = False) -> list[str]:
    """Empty tables, children first. Needs ``confirm`` and refuses paths that name production."""
    if not confirm:
        raise PermissionError("reset needs confirm=True")
    if "prod" in directory.lower():
        raise PermissionError(f"{directory} looks like production")
    done = []
    for name in reversed(order):
        path = f"{directory}/{name}.parquet"
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        done.append(name)
    return done


# ---- profile documents


def _file(path: str):
    """The path in the store that Spark would use for it."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, spark.sparkContext._jvm


def write_text(text: str, path: str) -> None:
    """A small text as one file: on this machine, or where a path with a scheme leads."""
    if "://" not in path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    store, at, _ = _file(path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str) -> str:
    if "://" not in path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    store, at, jvm = _file(path)
    stream = store.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def save_profile(profile: dict, path: str) -> None:
    """A profile document as YAML or JSON, by the path's ending."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        write_text(yaml.safe_dump(profile, sort_keys=True), path)
    else:
        write_text(json.dumps(profile, indent=2, sort_keys=True, default=str), path)


def load_profile(path: str) -> dict:
    """The document; another version than 1.0 is refused."""
    text = read_text(path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        plain = yaml.safe_load(text)
    else:
        plain = json.loads(text)
    if plain.get("version") != "1.0":
        raise ValueError(f"unknown version {plain.get('version')!r}")
    return plain


def rows_as_json(df: DataFrame, most: int) -> DataFrame:
    """(rows): a small result as one sorted JSON array; a result of more than ``most`` rows fails instead of being cut."""
    kept = df.limit(most + 1).agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("x"))
    text = F.when(F.size("x") == 0, F.lit("[]")).otherwise(F.to_json("x", {"ignoreNullFields": "false"}))
    return kept.select(F.when(F.size("x") <= most, text).otherwise(F.raise_error(F.lit(f"more than {most} rows"))).alias("rows"))


def export_collection(named: dict[str, DataFrame], most: int = 10_000) -> DataFrame:
    """(document): one JSON text with the rows of every named small result (of ``most`` rows at most), for use elsewhere."""
    out = None
    for name, df in named.items():
        one = rows_as_json(df, most).select(F.concat(F.lit(f'"{name}":'), "rows").alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("part")), ","), F.lit("}")).alias("document"))


def import_collection(spark: SparkSession, document: str) -> dict[str, list[dict]]:
    """The results of ``export_collection`` by name."""
    return json.loads(document)
