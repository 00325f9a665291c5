"""Catalogs, schemas and tables by three-part names.

Without a connector for a named catalog, ``catalog.schema.table`` lives in the
session catalog as ``catalog_schema.table``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

def _loaded(spark, catalog: str) -> bool:
    return spark.conf.get(f"spark.sql.catalog.{catalog}", None) is not None


def database(spark, catalog: str, schema: str) -> str:
    return f"{catalog}.{schema}" if _loaded(spark, catalog) else f"{catalog}_{schema}"


def table_name(spark, name: str) -> str:
    """The session name of ``catalog.schema.table``; shorter names stay as they are."""
    parts = name.split(".")
    return f"{database(spark, parts[0], parts[1])}.{parts[2]}" if len(parts) == 3 else name


def show_catalogs(spark) -> DataFrame:
    """Catalogs that are loaded or configured for this session."""
    prefix = "spark.sql.catalog."
    configured = {name[len(prefix):] for name in spark.conf.getAll if name.startswith(prefix)}
    names = {c.name for c in spark.catalog.listCatalogs()} | {n for n in configured if "." not in n}
    return spark.createDataFrame([(n,) for n in sorted(names)], "catalog string")


def show_schemas(spark, catalog: str | None = None) -> DataFrame:
    if catalog is None:
        return spark.sql("SHOW SCHEMAS")
    if _loaded(spark, catalog):
        return spark.sql(f"SHOW SCHEMAS IN {catalog}")
    prefix = f"{catalog}_"
    listed = spark.sql("SHOW SCHEMAS")
    return listed.filter(listed.namespace.startswith(prefix)).selectExpr(
        f"substring(namespace, {len(prefix) + 1}) AS namespace")


def create_schema(spark, name: str, if_not_exists: bool = False, location: str | None = None) -> None:
    """``name`` is ``catalog.schema``; an existing schema raises unless told otherwise."""
    guard = "IF NOT EXISTS " if if_not_exists else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA {guard}{database(spark, *name.split('.'))}{place}")


def create_table(spark, name: str, columns: str, if_not_exists: bool = False, fmt: str = "parquet",
                 location: str | None = None) -> None:
    """``columns`` is a DDL list; ``location`` makes the table external."""
    guard = "IF NOT EXISTS " if if_not_exists else ""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {guard}{table_name(spark, name)} ({columns}) USING {fmt}{place}")


def use(spark, name: str) -> None:
    """Make ``catalog.schema`` the default for unqualified table names."""
    catalog, schema = name.split(".")
    if _loaded(spark, catalog):
        spark.catalog.setCurrentCatalog(catalog)
        spark.catalog.setCurrentDatabase(schema)
    else:
        spark.catalog.setCurrentDatabase(f"{catalog}_{schema}")


def add_columns(spark, name: str, columns: str) -> None:
    """Widen a table without rewriting it; old rows read NULL."""
    spark.sql(f"ALTER TABLE {table_name(spark, name)} ADD COLUMNS ({columns})")
