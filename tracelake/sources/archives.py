"""Python data sources for trace archives: ``npz`` (one recording per file) and ``tarpairs`` (members key.png / key.json in tar files).

Both are registered with ``register(spark)`` and read with ``spark.read.format("npz").load(path)``. One file is one partition: files are
listed on the driver (a glob or a folder, sorted), opened by the tasks, and only the members asked for are decoded."""

from __future__ import annotations

import glob
import io
import json
import os
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRACE = "trace string, path string, actions array<array<smallint>>, initial_state binary, skip int, level int, weapon string, split string, label string, uid string, meta map<string,string>"
PAIR = "key string, shard string, payload binary, meta string"
KNOWN = ("actions", "initial_state", "skip", "level", "weapon", "split", "label", "uid")
DEFAULT_SKIP = 3


def find(path: str, suffix: str) -> list[str]:
    """Files of a glob, or below a folder (recursively), in order."""
    if os.path.isdir(path):
        hits = [os.path.join(at, f) for at, _, files in os.walk(path) for f in files if f.endswith(suffix)]
    else:
        hits = glob.glob(path, recursive=True)
    return sorted(hits)


class FilePart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in find(self.options["path"], ".npz")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        import numpy as np

        with np.load(part.path, allow_pickle=False) as z:
            has = set(z.files)
            text = lambda k: str(z[k]) if k in has and str(z[k]) else None
            number = lambda k, d=None: int(z[k]) if k in has and int(z[k]) >= 0 else d
            name = os.path.basename(part.path)
            meta = {k: str(z[k]) for k in sorted(has) if k not in KNOWN and z[k].ndim == 0}
            state = z["initial_state"].tobytes() if "initial_state" in has else None
            if state is not None and z["initial_state"].dtype.kind == "S":
                state = bytes(z["initial_state"][()])
            yield (name, part.path, z["actions"].astype(int).tolist() if "actions" in has else None, state, number("skip", DEFAULT_SKIP), number("level"), text("weapon"), text("split"), text("label"), text("uid") or name[: -len(".npz")], meta)


class NpzSource(DataSource):
    """Recordings: -1 and empty text become null, an absent ``skip`` 3, unknown scalars go to ``meta``, the uid is the file's stem unless given."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return TRACE

    def reader(self, schema) -> NpzReader:
        return NpzReader(dict(self.options))


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in find(self.options["path"], ".tar")]

    def read(self, part: FilePart) -> Iterator[tuple]:
        members = set(self.options["members"].split(",")) if self.options.get("members") else None
        half: dict[str, dict[str, bytes]] = {}
        done: set[str] = set()
        with tarfile.open(part.path) as tar:
            for m in tar:
                if not m.isfile():
                    continue
                key, _, suffix = m.name.rpartition(".")
                if suffix not in ("png", "json", "bin") or key in done or (members is not None and key not in members):
                    continue
                got = half.setdefault(key, {})
                skip = self.options.get("payload") == "false"
                got["meta" if suffix == "json" else "payload"] = None if skip else tar.extractfile(m).read()
                if len(got) == 2:
                    done.add(key)
                    half.pop(key)
                    yield key, os.path.basename(part.path), got["payload"], None if skip else got["meta"].decode()
        if half:
            raise ValueError(f"{part.path}: members without their other half: {sorted(half)[:5]}")
        if members is not None and self.options.get("strict") == "true" and done != members:
            raise ValueError(f"{part.path}: missing members {sorted(members - done)[:5]}")


class TarPairs(DataSource):
    """Pairs of members; the first complete pair of a key wins, leftovers are an error. Option ``members``: only these keys (with ``strict`` all must be there);
    ``payload`` = false: keys and shards only, without reading what the members hold."""

    @classmethod
    def name(cls) -> str:
        return "tarpairs"

    def schema(self) -> str:
        return PAIR

    def reader(self, schema) -> TarReader:
        return TarReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from tracelake.plans.ship import ship

    ship(spark)
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(TarPairs)


def with_split(traces: DataFrame) -> DataFrame:
    """Recordings whose missing split is derived from the file's name, as for those written before there was one."""
    from tracelake.functions.identity import effective_split, trace_name

    return traces.withColumn("split", effective_split(F.col("split"), trace_name(F.col("trace"))))


def write_npz(path: str, **values) -> None:
    """One recording, written beside its place and renamed into it. Names of known columns can't be given as extra data."""
    import numpy as np

    extra = values.pop("meta", {})
    if bad := set(extra) & {*KNOWN, "path", "trace"}:
        raise ValueError(f"reserved names: {sorted(bad)}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    buf = io.BytesIO()
    np.savez_compressed(buf, **values, **extra)
    with open(path + ".part", "wb") as f:
        f.write(buf.getvalue())
    os.replace(path + ".part", path)


def write_tar(path: str, pairs: list[tuple[str, bytes, dict]]) -> None:
    with tarfile.open(path + ".part", "w") as tar:
        for key, payload, meta in pairs:
            for suffix, body in (("png", payload), ("json", json.dumps(meta, sort_keys=True).encode())):
                info = tarfile.TarInfo(f"{key}.{suffix}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    os.replace(path + ".part", path)
