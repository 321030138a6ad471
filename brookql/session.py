"""The engine's front door: define streams and tables, run statements over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookql.plans.catalog import Catalog, Source
from brookql.plans.parser import parse_select
from brookql.plans.planner import Plan, Planner


class Engine:
    """A catalog of sources, user functions and options, and the statements run over them.

    options: unnamed_prefix (names of unnamed expressions), strict (unknown columns are
    errors), strict_schema (values that do not fit a declared type are row errors),
    keyed_state (a dict for get_keyed_state), rule_id, rule_start.
    """

    def __init__(self, spark: SparkSession, **options) -> None:
        self.spark, self.options = spark, options
        self.catalog = Catalog(spark)
        self.udfs: dict = {}

    def define(self, ddl: str, df: DataFrame | None = None, order: tuple[str, ...] = (), stream: bool = False) -> Source:
        return self.catalog.define(ddl, df, order, stream)

    def register(self, name: str, df: DataFrame, order: tuple[str, ...] = (), table: bool = False, **options: str) -> Source:
        return self.catalog.register(name, df, order, table, **options)

    def function(self, name: str, f) -> None:
        """Make a Spark user-defined function (pandas UDFs are the fast ones) callable by name."""
        self.udfs[name.lower()] = f

    def plan(self, sql: str, **options) -> Plan:
        """The statement's rows and its failed rows."""
        return Planner(self.catalog, self.options | options, self.udfs).plan(parse_select(sql))

    def sql(self, sql: str, **options) -> DataFrame:
        return self.plan(sql, **options).rows
