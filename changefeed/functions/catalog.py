"""Named expressions with parameters: SQL functions of the session, scalar or giving rows, loaded from a catalog.

A function's body is Spark SQL over its parameters. The analyzer checks it when it is loaded, binds and casts the
arguments of each call by position, and inlines the body into the plan, so a call costs what its expression costs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_]\w*")


def _named(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is not a name")
    return f"`{name}`"


@dataclass(frozen=True)
class SqlFunction:
    """A function: parameters (name -> type, in order), what it returns (a type, or column -> type for rows) and its body.

    The body is an expression, or a query for a function that returns rows. ``defaults`` are SQL literals of trailing parameters.
    """

    name: str
    parameters: Mapping[str, str]
    returns: str | Mapping[str, str]
    body: str
    defaults: Mapping[str, str] = field(default_factory=dict)

    @property
    def gives_rows(self) -> bool:
        return not isinstance(self.returns, str)

    def definition(self) -> str:
        parameters = ", ".join(f"{_named(p)} {t}" + (f" DEFAULT {self.defaults[p]}" if p in self.defaults else "") for p, t in self.parameters.items())
        returns = f"TABLE ({', '.join(f'{_named(c)} {t}' for c, t in self.returns.items())})" if self.gives_rows else self.returns
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {_named(self.name)}({parameters}) RETURNS {returns} RETURN {self.body}"


class FunctionCatalog:
    """Functions by name."""

    def __init__(self, functions: Iterable[SqlFunction] = ()) -> None:
        self._functions = {f.name: f for f in functions}

    @classmethod
    def from_dicts(cls, catalog: Mapping[str, Mapping[str, object]]) -> FunctionCatalog:
        """Functions from plain dictionaries, as a catalog file would hold them."""
        return cls(SqlFunction(name, dict(f.get("parameters") or {}), f["returns"], str(f["body"]), dict(f.get("defaults") or {})) for name, f in catalog.items())

    def load(self, spark: SparkSession) -> None:
        """Define all functions in the session; one that cannot be analyzed is an error here, not at its first call."""
        for f in self._functions.values():
            spark.sql(f.definition())

    def _checked(self, name: str, n: int, rows: bool) -> SqlFunction:
        if name not in self._functions:
            raise KeyError(f"unknown function {name!r}; known: {', '.join(sorted(self._functions))}")
        f = self._functions[name]
        if f.gives_rows != rows:
            raise TypeError(f"function {name!r} {'gives rows' if f.gives_rows else 'gives one value'}")
        if not len(f.parameters) - len(f.defaults) <= n <= len(f.parameters):
            raise TypeError(f"function {name!r} takes {', '.join(f.parameters)}; {n} arguments given")
        return f

    def call(self, name: str, *args: Column | str) -> Column:
        """A scalar function of columns."""
        return F.call_function(self._checked(name, len(args), False).name, *[F.col(a) if isinstance(a, str) else a for a in args])

    def spread(self, df: DataFrame, name: str, *columns: str, keep: bool = False) -> DataFrame:
        """The rows of ``df``, each with the rows that a function gives for its columns; without any it drops out, or is kept with nulls."""
        f = self._checked(name, len(columns), True)
        given = ", ".join("t.`{}`".format(c.replace("`", "``")) for c in columns)
        join = "LEFT JOIN LATERAL" if keep else "JOIN LATERAL"
        return df.sparkSession.sql(f"SELECT * FROM {{df}} AS t {join} {_named(f.name)}({given})" + (" ON true" if keep else ""), df=df)
