"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark) -> None:
    """Send the package's sources with the application, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_skygrid_core_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="skygrid"), "skygrid_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    sc._skygrid_core_shipped = True
