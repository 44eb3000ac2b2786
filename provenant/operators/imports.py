"""Import edges between modules of one project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions import text as T


def internal_imports(imports: DataFrame) -> DataFrame:
    """module, import of imports that lead to a module of the project.

    A resolved import is internal if it is a module's name, or if one of the
    two is the end of the other after a / or a dot; of several modules the
    smallest is taken. A module does not import itself. Both ends are cut at
    every boundary, so suffixes are met by equality, not by comparing all
    modules.
    """
    modules = imports.select(F.col("module").alias("internal")).distinct()
    rows = imports.where("import is not null").select("module", T.resolved_import(F.col("module"), F.col("import")).alias("name")).distinct()
    ends = lambda c: F.expr(f"transform(filter(sequence(1, length({c})), i -> i = 1 or substring({c}, i - 1, 1) in ('/', '.')), i -> substring({c}, i))")
    exact = rows.join(modules, F.col("name") == F.col("internal")).select("module", "name", "internal")
    open_ = rows.join(modules, F.col("name") == F.col("internal"), "left_anti")
    of_modules = modules.select("internal", F.explode(ends("internal")).alias("end")).where("end <> ''")
    shorter = open_.join(of_modules, F.col("name") == F.col("end")).select("module", "name", "internal")
    of_names = open_.where("name <> ''").select("module", "name", F.explode(ends("name")).alias("end"))
    longer = of_names.join(modules, F.col("end") == F.col("internal")).select("module", "name", "internal")
    found = shorter.union(longer).groupBy("module", "name").agg(F.min("internal").alias("internal"))
    return exact.union(found).where("internal <> module").select("module", F.col("internal").alias("import")).distinct()


def relative_imports(imports: DataFrame) -> DataFrame:
    return imports.where("import like '.%'").select("module", "import", T.resolved_import(F.col("module"), F.col("import")).alias("resolved"))
