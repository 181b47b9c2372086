"""Catalog inspection: the tables of a namespace, their columns, keys and example values."""

from __future__ import annotations

from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.limits import Limits


def quote(name: str) -> str:
    """An identifier in back-ticks."""
    return "`" + name.replace("`", "``") + "`"


_registered: WeakKeyDictionary = WeakKeyDictionary()  # of each session, the namespace whose views it has


@dataclass
class Namespace:
    """A read-only database: named views over Parquet, and the keys that Parquet does not carry."""

    spark: SparkSession
    views: dict[str, DataFrame]
    primary: dict[str, list[str]] = field(default_factory=dict)
    foreign: list[tuple[str, str, str, str]] = field(default_factory=list)  # table, column, referenced table, column

    def register(self) -> None:
        """Makes the views the session's, unless they were the last that any namespace made so."""
        if _registered.get(self.spark) is not self:
            for name, df in self.views.items():
                df.createOrReplaceTempView(name)
            _registered[self.spark] = self

    def find(self, table: str) -> str | None:
        wanted = table.lower()
        return next((n for n in self.views if n.lower() == wanted), None)

    def tables(self, limit: int = Limits.tables) -> list[str]:
        """Visible tables in binary order of their names."""
        return sorted(self.views)[:limit]

    def schema_map(self) -> dict[str, list[str]]:
        """Lower-cased tables with their lower-cased columns in order."""
        return {n.lower(): [c.lower() for c in df.columns] for n, df in sorted(self.views.items())}

    def columns(self, tables: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
        """A row for each column, and an error row for each unknown table: position, type, nullable, key place, reference."""
        rows = []
        for asked in tables if tables is not None else self.tables(limits.tables):
            name = self.find(asked)
            if name is None:
                rows.append((asked, None, None, None, None, None, None, "unknown_table"))
                continue
            keys = self.primary.get(name, [])
            refs = {c: f"{rt}.{rc}" for t, c, rt, rc in self.foreign[: limits.foreign_keys] if t == name}
            for i, f in enumerate(self.views[name].schema.fields[: limits.columns]):
                rows.append((name, i, f.name, f.dataType.simpleString(), f.nullable, keys.index(f.name) + 1 if f.name in keys else 0, refs.get(f.name), None))
        schema = "table_name string, position int, column_name string, type string, nullable boolean, key_place int, references string, error string"
        return self.spark.createDataFrame(rows, schema)

    def values(self, table: str, column: str, limit: int = Limits.inspect_values) -> DataFrame:
        """Distinct values in order, one more than the limit so that a caller sees whether there are more."""
        name = self.find(table)
        if name is None:
            raise LookupError("unknown_table")
        found = next((c for c in self.views[name].columns if c.lower() == column.lower()), None)
        if found is None:
            raise LookupError("unknown_column")
        return self.views[name].select(F.col(quote(found)).alias("value")).distinct().orderBy("value").limit(limit + 1)

    def render(self, only: set[str] | None = None, examples: int = 2, chars: int = 40) -> DataFrame:
        """(table_name, ddl): CREATE TABLE text with examples of each column, its first and last non-empty texts."""
        out = []
        for name in self.tables():
            if only is not None and name.lower() not in only:
                continue
            df = self.views[name]
            text = {c: F.substring(F.col(quote(c)).cast("string"), 1, chars) for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))}
            lows = df.agg(*(F.array_sort(F.array_compact(F.array(F.min(F.when(v != "", v)), F.max(F.when(v != "", v))))).alias(c) for c, v in text.items()))
            lines = []
            for f in df.schema.fields:
                key = " PRIMARY KEY" if self.primary.get(name) == [f.name] else ""
                base = f"  {quote(f.name)} {f.dataType.simpleString().upper()}{key}"
                if f.name in text and examples:
                    shown = F.array_join(F.slice(F.array_distinct(F.col(quote(f.name))), 1, examples), ", ")
                    lines.append(F.concat(F.lit(base + " -- "), shown))
                else:
                    lines.append(F.lit(base))
            keys = self.primary.get(name, [])
            if len(keys) > 1:
                lines.append(F.lit("  PRIMARY KEY (" + ", ".join(map(quote, keys)) + ")"))
            groups: dict[str, list[tuple[str, str]]] = {}
            for t, c, rt, rc in self.foreign:
                if t == name:
                    groups.setdefault(rt, []).append((c, rc))
            for rt, pairs in groups.items():
                left, right = ", ".join(quote(c) for c, _ in pairs), ", ".join(quote(c) for _, c in pairs)
                lines.append(F.lit(f"  FOREIGN KEY ({left}) REFERENCES {quote(rt)} ({right})"))
            ddl = F.concat(F.lit(f"CREATE TABLE {quote(name)} (\n"), F.concat_ws(",\n", *lines), F.lit("\n)"))
            out.append(lows.select(F.lit(name).alias("table_name"), ddl.alias("ddl")))
        if not out:
            return self.spark.createDataFrame([], "table_name string, ddl string")
        result = out[0]
        for df in out[1:]:
            result = result.unionByName(df)
        return result


#: Keys of the star schema.
PRIMARY = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


def namespace(spark: SparkSession, sf_dir: str, tables: list[str]) -> Namespace:
    """The Parquet tables of a folder as a namespace."""
    views = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in tables}
    return Namespace(spark, views, {k: v for k, v in PRIMARY.items() if k in views}, [x for x in FOREIGN if x[0] in views])
