"""Label and one-hot encoding.

Short dictionaries live in the plan as literals. A dictionary of medium,
checked size is broadcast. Beyond that it stays a distributed table whose
codes come from a distributed ordering, and encoding is a shuffle join.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.errors import DataError
from prepforge.functions.columns import clean, quoted
from prepforge.operators.longform import ITEM, typed_values
from prepforge.operators.ordering import ordered_totals
from prepforge.session import scratch_path

MAX_LITERALS = 64          # dictionaries up to this size become expressions
MAX_LISTED = 10_000        # up to this size they may be held by the driver and broadcast,
MAX_LISTED_BYTES = 2 ** 23     # if all values together also stay below this
MAX_ONEHOT_COLUMNS = 2_000


@dataclass
class Categories:
    """Ascending distinct values of a column, held as a list or as a table."""

    type_json: str
    values: list | None = None
    table: str | None = None

    @property
    def dtype(self) -> T.DataType:
        return T._parse_datatype_json_string(self.type_json)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Columns value, code; broadcast only when the size is known to be small."""
        if self.values is None:
            return spark.read.parquet(self.table)
        schema = T.StructType([T.StructField("value", self.dtype), T.StructField("code", T.LongType())])
        rows = [(v, i) for i, v in enumerate(self.values)]
        return F.broadcast(spark.createDataFrame(rows, schema))

    def listed(self) -> list:
        """All values in order, read from the table where there is one."""
        if self.values is not None:
            return self.values
        spark = SparkSession.active()
        return [r["value"] for r in spark.read.parquet(self.table).orderBy("code").select("value").toLocalIterator()]

    def literals(self) -> Column:
        return F.array(*[F.lit(v).cast(self.dtype) for v in self.values])

    def to_dict(self) -> dict:
        write = {datetime.date: datetime.date.isoformat, datetime.datetime: datetime.datetime.isoformat,
                 decimal.Decimal: str, bytes: bytes.hex, bytearray: bytearray.hex}
        values = self.values and [write.get(type(v), lambda x: x)(v) for v in self.values]
        return {"type_json": self.type_json, "values": values, "table": self.table}

    @staticmethod
    def from_dict(data: dict) -> "Categories":
        out = Categories(data["type_json"], data.get("values"), data.get("table"))
        read = {"date": datetime.date.fromisoformat, "decimal": decimal.Decimal,
                "binary": lambda v: bytearray(bytes.fromhex(v)),
                "timestamp": datetime.datetime.fromisoformat,
                "timestamp_ntz": datetime.datetime.fromisoformat}.get(out.dtype.typeName())
        if read:
            out.values = out.values and [read(v) for v in out.values]
        return out


def fit_categories(df: DataFrame, columns: list[str],
                   max_listed: int = MAX_LISTED) -> dict[str, Categories]:
    """Distinct non-null values of each column, sorted."""
    if not columns:
        return {}
    exprs = []
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        width = (F.max(F.octet_length(quoted(c))) if isinstance(dtype, (T.StringType, T.BinaryType))
                 else F.lit(dtype_width(dtype)))
        exprs += [F.approx_count_distinct(clean(df, c)).alias(f"n{i}"), width.alias(f"w{i}")]
    sizes = df.agg(*exprs).first()
    short = [c for i, c in enumerate(columns) if sizes[f"n{i}"] <= max_listed
             and sizes[f"n{i}"] * (sizes[f"w{i}"] or 0) <= MAX_LISTED_BYTES]
    found: dict[str, Categories] = {}
    if short:
        long, slot_of = typed_values(df, short)
        slots = sorted(set(slot_of.values()))
        seen: dict[str, list] = {c: [] for c in short}
        for row in long.groupBy(ITEM, *slots).agg(F.lit(1)).collect():
            value = row[slot_of[short[row[ITEM]]]]
            if value is not None:
                seen[short[row[ITEM]]].append(value)
        for c in short:
            found[c] = Categories(df.schema[c].dataType.json(), values=sorted(seen[c]))
    for c in columns:
        if c not in found:
            found[c] = _code_table(df, c)
    return {c: found[c] for c in columns}


def dtype_width(dtype: T.DataType) -> int:
    """Bytes of a fixed-width value; a nested value has no bound."""
    nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))
    return MAX_LISTED_BYTES + 1 if nested else 16


def _code_table(df: DataFrame, column: str) -> Categories:
    counted = (
        df.select(clean(df, column).alias("value")).where("value IS NOT NULL")
        .groupBy("value").agg(F.count(F.lit(1)).alias("rows"), F.lit(1).cast("bigint").alias("one"))
    )
    coded = ordered_totals(counted, [F.col("value")], ["one"])
    path = scratch_path(df.sparkSession, "categories")
    coded.select("value", F.col("one_before").alias("code"), "rows").write.parquet(path)
    return Categories(df.schema[column].dataType.json(), table=path)


def _fail(what: str, column: str, value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit("NULL"))
    return F.raise_error(F.concat(F.lit(f"{what} in column '{column}': "), text))


def with_code(df: DataFrame, column: str, categories: Categories, name: str,
              unseen: str = "error") -> DataFrame:
    """Adds the 0-based rank of the value among the categories."""
    value = clean(df, column)
    miss = (_fail("unseen category", column, value).cast("bigint")
            if unseen == "error" else F.lit(None).cast("bigint"))
    if categories.values is not None and len(categories.values) <= MAX_LITERALS:
        if not categories.values:
            return df.withColumn(name, miss)
        place = F.nullif(F.array_position(categories.literals(), value), F.lit(0))
        return df.withColumn(name, F.coalesce((place - 1).cast("bigint"), miss))
    lookup = categories.frame(df.sparkSession).select(
        F.col("value").alias("__value"), F.col("code").alias("__found"))
    # a value that fills many rows, NULL too, is split by the engine while the join runs
    joined = df.withColumn("__value", value).join(lookup, "__value", "left")
    return joined.select(*[quoted(c) for c in df.columns], F.coalesce("__found", miss).alias(name))


class LabelEncoder:
    """Value to its 0-based rank in ascending order, and back."""

    kind = "label"

    def __init__(self) -> None:
        self.column: str | None = None
        self.categories: Categories | None = None

    def fit(self, df: DataFrame, column: str, max_listed: int = MAX_LISTED) -> "LabelEncoder":
        return self.adopt(column, fit_categories(df, [column], max_listed)[column])

    def adopt(self, column: str, categories: Categories) -> "LabelEncoder":
        self.column, self.categories = column, categories
        return self

    def _ready(self) -> Categories:
        if self.categories is None:
            raise DataError("encoder is not fitted; call fit() first")
        return self.categories

    def transform(self, df: DataFrame) -> DataFrame:
        """The column replaced by its code; an unseen value or NULL raises."""
        order = df.columns
        coded = with_code(df, self.column, self._ready(), "__label")
        return coded.select(*[
            F.col("__label").alias(c) if c == self.column else quoted(c) for c in order])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """The column of codes replaced by the values; an unknown or fractional code raises."""
        found = self._ready()
        code = clean(df, self.column)
        if not isinstance(df.schema[self.column].dataType, T.IntegralType):
            whole = code.try_cast("bigint")
            code = F.when(whole == code.try_cast("double"), whole)
        if found.values is not None and len(found.values) <= MAX_LITERALS:
            known = code.between(0, len(found.values) - 1)
            value = F.when(known, F.get(found.literals(), code.cast("int")))
            value = value.otherwise(_fail("unknown code", self.column, quoted(self.column)).cast(found.dtype))
            return df.select(*[
                value.alias(c) if c == self.column else quoted(c) for c in df.columns])
        lookup = found.frame(df.sparkSession).select(
            F.col("value").alias("__value"), F.col("code").alias("__key"))
        joined = df.join(lookup, code == F.col("__key"), "left")
        value = F.coalesce("__value", _fail("unknown code", self.column, quoted(self.column)).cast(found.dtype))
        return joined.select(*[
            value.alias(c) if c == self.column else quoted(c) for c in df.columns])

    def fit_transform(self, df: DataFrame, column: str) -> DataFrame:
        return self.fit(df, column).transform(df)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "column": self.column, "categories": self._ready().to_dict()}

    @staticmethod
    def from_dict(data: dict) -> "LabelEncoder":
        return LabelEncoder().adopt(data["column"], Categories.from_dict(data["categories"]))


class OneHotEncoder:
    """One 0/1 column per category, none dropped, in ascending order."""

    kind = "onehot"

    def __init__(self, handle_unknown: str = "error") -> None:
        if handle_unknown not in ("error", "ignore"):
            raise DataError(f"unknown setting for unseen values: {handle_unknown}")
        self.handle_unknown = handle_unknown
        self.columns: list[str] = []
        self.categories: dict[str, Categories] = {}

    def fit(self, df: DataFrame, columns: list[str] | str,
            max_listed: int = MAX_LISTED) -> "OneHotEncoder":
        names = [columns] if isinstance(columns, str) else list(columns)
        return self.adopt(fit_categories(df, names, max_listed))

    def adopt(self, categories: dict[str, Categories]) -> "OneHotEncoder":
        self.columns, self.categories = list(categories), dict(categories)
        return self

    def _ready(self) -> dict[str, Categories]:
        if not self.categories:
            raise DataError("encoder is not fitted; call fit() first")
        return self.categories

    def get_feature_names(self, input_features: list[str] | None = None) -> list[str]:
        """``<name>_<category>`` of every slot; the columns are x0, x1, ... unless names are given."""
        names = input_features or [f"x{i}" for i in range(len(self.columns))]
        return [f"{name}_{v}" for name, c in zip(names, self.columns) for v in self._ready()[c].listed()]

    def transform(self, df: DataFrame) -> DataFrame:
        """Source columns go, the 0/1 columns are appended at the end."""
        out, flags = df, []
        for i, c in enumerate(self.columns):
            found = self._ready()[c]
            if found.values is None or len(found.values) > MAX_ONEHOT_COLUMNS:
                raise DataError(f"column '{c}' has too many categories for single columns; "
                                "use transform_vector()")
            code = f"__code_{i}"
            out = with_code(out, c, found, code, unseen=self.handle_unknown)
            flags += [F.coalesce((F.col(code) == j).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
                      for j, v in enumerate(found.values)]
        keep = [quoted(c) for c in df.columns if c not in self.columns]
        return out.select(*keep, *flags)

    def transform_vector(self, df: DataFrame, column: str, output: str) -> DataFrame:
        """One sparse vector column; works for any number of categories."""
        from pyspark.ml.feature import OneHotEncoder as VectorEncoder

        found = self._ready()[column]
        size = (len(found.values) if found.values is not None
                else found.frame(df.sparkSession).count())
        coded = with_code(df, column, found, "__code_v", unseen=self.handle_unknown)
        # one spare slot stands for "unseen"; it is the last one and is dropped
        coded = coded.withColumn("__code_v", F.coalesce(F.col("__code_v"), F.lit(size)).cast("double"))
        spark = df.sparkSession
        sizes = spark.range(size, size + 1).select(F.col("id").cast("double").alias("__code_v"))
        model = VectorEncoder(inputCols=["__code_v"], outputCols=[output], dropLast=True).fit(sizes)
        return model.transform(coded).drop("__code_v")

    def fit_transform(self, df: DataFrame, columns: list[str] | str) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def to_dict(self) -> dict:
        return {"kind": self.kind, "handle_unknown": self.handle_unknown,
                "categories": {c: v.to_dict() for c, v in self._ready().items()}}

    @staticmethod
    def from_dict(data: dict) -> "OneHotEncoder":
        return OneHotEncoder(data["handle_unknown"]).adopt(
            {c: Categories.from_dict(v) for c, v in data["categories"].items()})
