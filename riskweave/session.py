"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str, app: str = "riskweave", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    if not master.startswith("local"):
        ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, where it is not installed on them."""
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="riskweave-ship-")) / "riskweave"
    spark.sparkContext.addPyFile(
        shutil.make_archive(str(target), "zip", package.parent, package.name)
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Every instant is handled in UTC; local hours come from an explicit zone column."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (local tests) is a
    scratch folder made.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = spark.conf.get("riskweave.local.checkpoint", None)
        if not root:
            root = tempfile.mkdtemp(prefix="riskweave-checkpoint-")
            spark.conf.set("riskweave.local.checkpoint", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root
