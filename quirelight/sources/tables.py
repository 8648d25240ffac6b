"""Reading relations, decoding wire records, and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wire types by the Spark type that decodes them; all others stay text.
WIRE_TYPES = {
    "bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double",
    "numeric": "decimal(38,10)", "money": "decimal(38,10)", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
}


def scan(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """A Parquet relation with the columns named; blanks around names do not count, none or "*" means all."""
    df = spark.read.parquet(path)
    names = [c.strip() for c in cols or ["*"]]
    return df if names == ["*"] else df.select(*names)


def scan_table(spark: SparkSession, name: str, cols: list[str] | None = None) -> DataFrame:
    """A relation of the catalog, by its (namespaced) name."""
    df = spark.table(name)
    return df.select(*cols) if cols else df


def list_objects(spark: SparkSession, folder: str, prefix: str = "", limit: int = 100, offset: int = 0, descending: bool = False) -> DataFrame:
    """Name, size and time of the files below folder whose name begins with prefix, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").startswith(prefix))
    order = F.col("name").desc() if descending else F.col("name").asc()
    return named.select("name", "length", "modificationTime", "path").orderBy(order, "path").offset(offset).limit(limit)


def decoded(col: Column, wire_type: str) -> Column:
    """A text column by its wire type; what does not fit the type is null, unknown types stay text."""
    if wire_type.startswith("_"):
        inner = F.regexp_extract(col, r"^\{(.*)\}$", 1)
        items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
        bare = F.transform(items, lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
        return F.when(col.rlike(r"^\{.*\}$"), F.transform(bare, lambda x: decoded(x, wire_type[1:])))
    if wire_type == "bool":
        return F.when(col.isin("t", "true"), True).when(col.isin("f", "false"), False)
    if wire_type in ("json", "jsonb"):
        return F.try_parse_json(col)
    if wire_type == "timestamp":
        col = F.regexp_replace(col, "^(\\S+) ", "$1T")
    return col.try_cast(WIRE_TYPES[wire_type]) if wire_type in WIRE_TYPES else col


def decode_columns(df: DataFrame, types: dict[str, str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Text columns decoded by their wire types, but for those whose type is in skip."""
    return df.withColumns({c: decoded(F.col(c), t) for c, t in types.items() if t not in skip})


def read_json_column(df: DataFrame, col: str, schema: str, default: Column, out: str | None = None) -> DataFrame:
    """A JSON text column parsed; missing or malformed values are the default."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    usable = parsed.isNotNull() & F.try_parse_json(F.col(col)).isNotNull()
    return df.withColumn(out or col, F.when(usable, parsed).otherwise(default))


def to_json_column(df: DataFrame, cols: list[str], out: str = "json") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*cols)))


def append_rows(target: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """target and rows over the union of their columns; columns that rows lack are null, or their default."""
    missing = {c: F.lit(v).cast(target.schema[c].dataType) for c, v in (defaults or {}).items() if c not in rows.columns}
    return target.unionByName(rows.withColumns(missing), allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, on: list[str], ignore: bool = False) -> DataFrame:
    """target with rows merged by key: the new row wins, or with ignore the old one. Keys are unique on each side.

    Two joins on the key and no window: unchanged rows pass by an anti join.
    """
    if ignore:
        return target.unionByName(rows.join(target.select(*on), on, "left_anti").select(target.columns))
    return target.join(rows.select(*on), on, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def patch(target: DataFrame, patches: DataFrame, key: list[str], allowed: list[str], dry_run: bool = False) -> DataFrame:
    """target with the non-null values of patches put in, for allowed columns only.

    dry_run: only the rows that would change, with old and new values.
    """
    unknown = sorted(set(patches.columns) - set(key) - set(allowed))
    if unknown:
        raise ValueError(f"columns that may not be edited: {unknown}")
    edits = [c for c in patches.columns if c not in key]
    p = patches.select(*key, *[F.col(c).alias(f"__new_{c}") for c in edits])
    if dry_run:
        changed = reduce(Column.__or__, [F.col(f"__new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in edits])
        pairs = [x for c in edits for x in (F.col(c).alias(f"old_{c}"), F.coalesce(f"__new_{c}", c).alias(f"new_{c}"))]
        return target.join(p, key).where(changed).select(*key, *pairs)
    new = {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in edits}
    return target.join(p, key, "left").withColumns(new).select(target.columns)


def delete_where(target: DataFrame, cond: Column) -> DataFrame:
    """The rows for which cond is not true."""
    return target.where(~F.coalesce(cond, F.lit(False)))


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on), on, "left_anti")


def max_affected(df: DataFrame, n: int) -> DataFrame:
    """df, or an error if it has more than n rows; at most n + 1 are read for that."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"more than {n} rows affected")
    return df


def csv_column(df: DataFrame, out: str = "csv") -> DataFrame:
    """Each row as one line of CSV."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias(out))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


