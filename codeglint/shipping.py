"""The package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that wouldn't find it: where its folder is neither the working folder nor on PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    found = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    app = spark.sparkContext.applicationId
    if root in found or app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="codeglint-")) / "codeglint.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "codeglint").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


@contextmanager
def by_value(module: ModuleType) -> Iterator[None]:
    """What is pickled inside takes the module's classes along: processes that Spark starts on the driver for streams don't see shipped files."""
    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)
