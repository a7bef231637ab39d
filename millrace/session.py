"""Session helpers: shared working folder, materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under; ``conf`` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).config(map=base | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all run on this machine, as in tests."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_millrace_dir", None)
    if not given:
        master = sc.getConf().get("spark.master") or "local"
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = sc._millrace_dir = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
    return given.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, so that they can import it wherever they run."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(sc, "_millrace_shipped", False) or not package.is_dir():
        return
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    folder = Path(folder if folder.startswith("/") else tempfile.gettempdir()) / "millrace"  # only the driver reads it there
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"millrace-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(path))
    sc._millrace_shipped = True


def scratch(spark: SparkSession, tag: str) -> str:
    """The path of a new folder in the shared one, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Cuts the lineage at the price of one write; the table survives the loss of any executor
    and is removed when the JVM ends.
    """
    path = scratch(df.sparkSession, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table of ``root``."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
