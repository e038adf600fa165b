"""Relations by name: schema files, Parquet tables, and column names as schema files write them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a column is shared: by exclusive or (`[x]`), or by addition (`x`).
BOOLEAN, ARITHMETIC = "B", "A"
_RELATION = re.compile(r"^\s*(\w+)\s*\(([^()]*)\)\s*$")


def bare(name: str) -> str:
    """The column's plain name: `R.[x]`, `R.x`, `[x]` and `x` are all `x`."""
    return re.sub(r"^\w+\.(?=\[|\w)", "", name.strip()).strip("[]")


def relation_schema(columns: list[str], kinds: list[str]) -> T.StructType:
    """BIGINT columns that carry their sharing in the field's metadata."""
    if len(columns) != len(kinds) or not columns:
        raise ValueError(f"{len(columns)} columns but {len(kinds)} sharing kinds")
    if bad := set(kinds) - {BOOLEAN, ARITHMETIC}:
        raise ValueError(f"unknown sharing kinds {sorted(bad)}")
    return T.StructType([T.StructField(bare(c), T.LongType(), False, {"sharing": k}) for c, k in zip(columns, kinds, strict=True)])


def parse_schemas(text: str) -> dict[str, T.StructType]:
    """Relations of a schema file: a line `# B, A` of sharing kinds, then `name(column, column)`."""
    found: dict[str, T.StructType] = {}
    kinds: list[str] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        if line.lstrip().startswith("#"):
            kinds = [k.strip() for k in line.lstrip()[1:].split(",")]
        elif (m := _RELATION.match(line)) and kinds is not None:
            if m[1] in found:
                raise ValueError(f"line {number}: relation {m[1]} is there already")
            found[m[1]] = relation_schema([c.strip() for c in m[2].split(",")], kinds)
            kinds = None
        else:
            raise ValueError(f"line {number} is neither sharing kinds nor a relation: {line!r}")
    return found


@dataclass
class Catalog:
    """A named set of relations, each also a temporary view of the session."""

    spark: SparkSession
    relations: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.relations:
            raise ValueError(f"relation {name} is there already")
        self.relations[name] = df
        df.createOrReplaceTempView(name)
        return df

    def add_parquet(self, name: str, path: str) -> DataFrame:
        return self.add(name, self.spark.read.parquet(path))

    def add_schemas(self, text: str) -> None:
        """Empty relations with the schemas of a schema file."""
        for name, schema in parse_schemas(text).items():
            self.add(name, self.spark.createDataFrame([], schema))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.relations:
            raise KeyError(f"no relation {name}; there are {', '.join(sorted(self.relations)) or 'none'}")
        return self.relations[name]

    def column(self, relation: str, name: str) -> Column:
        """A column by any of its names; a prefix must be this relation's."""
        if "." in name and name.split(".", 1)[0] != relation:
            raise KeyError(f"{name} is not of relation {relation}")
        if bare(name) not in self[relation].columns:
            raise KeyError(f"relation {relation} has no column {bare(name)}")
        return F.col(f"`{bare(name)}`")


def sharing(df: DataFrame) -> dict[str, str]:
    """Each column's sharing kind, where it has one."""
    return {f.name: f.metadata["sharing"] for f in df.schema if "sharing" in f.metadata}
