"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "chronofact", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators assume.

    ``master`` is left to ``spark-submit`` on a cluster. AQE coalesces and
    splits shuffle partitions at run time, so ``spark.sql.shuffle.partitions``
    only has to be an upper guess for the data at hand.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster sets ``spark.checkpoint.dir``; without it there is no folder that
    all executors see, which is an error. Only a local master, as in tests,
    gets a temporary folder, recorded in the session and removed at exit.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="chronofact-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CHECKPOINT_CONF, path)
    return path.rstrip("/")


_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch scopes", default=())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_dir`, noted in every open :func:`scratch_scope`."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.paths.append(path)
    return path


@dataclass
class Scratch:
    """The temporary tables made in a scope. Results that read them are lazy, so the caller says when they may go."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)

    def release(self, keep: Iterable[str] = ()) -> None:
        """Delete the tables but those in ``keep``; whoever still reads a deleted one fails."""
        kept = set(keep)
        for path in [p for p in self.paths if p not in kept]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            self.paths.remove(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Collects the temporary tables that operators make inside; after the result is written, ``release()`` deletes them."""
    scope = Scratch(spark)
    token = _scopes.set((*_scopes.get(), scope))
    try:
        yield scope
    finally:
        _scopes.reset(token)
