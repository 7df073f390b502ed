"""Takes this package along to Python workers that were not started in its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package, and the pipeline beside it, to the session's Python files, once a context. Spark hands them to every executor."""
    context = spark.sparkContext
    if getattr(context, "_platen_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="platen-code-"), "platen.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, "platen")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
        if os.path.exists(extra := os.path.join(top, "corpus_pipeline.py")):
            out.write(extra, "corpus_pipeline.py")
    context.addPyFile(path)
    context._platen_shipped = True
