"""What the corpus operators share: shipping the package, the shared folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ringspan.session import cut, few_tasks, new_path, settle, shared_dir

__all__ = ["SPACE", "cut", "few_tasks", "fresh", "new_path", "settle", "shared_dir", "ship"]

#: Fixed value: the white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"

_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, once per application (as --py-files would), and put
    the session's settings right."""
    settle(spark)
    sc = spark.sparkContext
    if getattr(sc, "_ringspan_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "ringspan_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    sc.addPyFile(path)
    sc._ringspan_shipped = True


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
