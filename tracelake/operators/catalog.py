"""The catalog: six tables as Parquet, registered and selected with explicit checks (Parquet knows no constraints).

One writer at a time. A registration checks against what is there, then appends; the tables of a registration are written under its own key in overwrite mode, so a
repeated registration after a failure leaves one copy, and the shard row comes last and makes the rest visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracelake.operators.expectations import already_there, duplicates, enforce, failing, require

SCHEMAS = {
    "shards": "id bigint, path string, sha256 string, level int, task string, weapon string, encoder_sha256 string, ordinal int, episodes int, frames bigint",
    "episodes": "fingerprint string, fingerprint_kind string, uid string, source_trace string, action_steps int",
    "shard_episodes": "shard_id bigint, fingerprint string, ordinal int",
    "episode_boundaries": "fingerprint string, observation_steps int, boss_observation_index int, source_uri string, source_sha256 string",
    "collections": "name string, level int, task string, encoder_sha256 string, manifest_path string, manifest_sha256 string, episodes int",
    "collection_episodes": "collection_name string, fingerprint string, ordinal int",
}
TASKS = ("boss", "kill", "full")


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table of the catalog, empty if nothing was registered. Rows of shards and collections whose own row is missing aren't visible."""
        try:
            t = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/*")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])
        if name == "shard_episodes":
            return t.join(self.table("shards").select(F.col("id").alias("shard_id")), "shard_id", "left_semi")
        if name == "collection_episodes":
            return t.join(self.table("collections").select(F.col("name").alias("collection_name")), "collection_name", "left_semi")
        return t

    def _write(self, df: DataFrame, name: str, key: str) -> None:
        cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/{name}/{key}")

    def next_ordinal(self, level: int, task: str, weapon: str, encoder: str) -> int:
        t = self.table("shards").where((F.col("level") == level) & (F.col("task") == task) & (F.col("weapon") == weapon) & (F.col("encoder_sha256") == encoder))
        return t.agg(F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).collect()[0][0]

    def register_shard(self, shard: dict, episodes: DataFrame) -> int:
        """Register a shard and its episodes (fingerprint, fingerprint_kind, uid, source_trace, action_steps, ordinal); returns its id."""
        require(1 <= shard["level"] <= 8 and shard["task"] in TASKS and shard["ordinal"] >= 0, "not a shard's level, task or ordinal")
        require(shard["episodes"] > 0 and shard["frames"] >= 0, "a shard holds episodes and frames")
        require(episodes.count() == shard["episodes"], "the number of episodes is not the declared one")
        mine = self.table("shards")
        same = (F.col("path") == shard["path"]) | (F.col("sha256") == shard["sha256"])
        place = (F.col("level") == shard["level"]) & (F.col("task") == shard["task"]) & (F.col("weapon") == shard["weapon"]) & (F.col("encoder_sha256") == shard["encoder_sha256"]) & (F.col("ordinal") == shard["ordinal"])
        enforce({
            "shard is registered": mine.where(same | place), "fingerprint is in another shard": already_there(episodes, self.table("shard_episodes"), ["fingerprint"]),
            "fingerprint twice": duplicates(episodes, ["fingerprint"]), "uid twice": duplicates(episodes, ["uid"]), "place twice": duplicates(episodes, ["ordinal"]),
            "no action steps": failing(episodes, F.col("action_steps") > 0)})
        sid = mine.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).collect()[0][0]
        self._write(episodes, "episodes", f"shard={sid}")
        self._write(episodes.withColumn("shard_id", F.lit(sid).cast("bigint")), "shard_episodes", f"shard={sid}")
        self._write(self.spark.createDataFrame([{**shard, "id": sid}], SCHEMAS["shards"]), "shards", f"shard={sid}")
        return sid

    def register_boundaries(self, boundaries: DataFrame, key: str) -> None:
        enforce({"boundary out of range": failing(boundaries, (F.col("observation_steps") > 1) & (F.col("boss_observation_index").between(0, F.col("observation_steps") - 1))),
                 "boundary is registered": already_there(boundaries, self.table("episode_boundaries"), ["fingerprint"])})
        self._write(boundaries, "episode_boundaries", f"key={key}")

    def register_collection(self, collection: dict, members: DataFrame) -> None:
        """An immutable collection: a name that exists is an error; so are members that aren't in the catalog, and a wrong count."""
        require(members.count() == collection["episodes"], "the number of members is not the declared one")
        enforce({"collection exists": self.table("collections").where(F.col("name") == collection["name"]), "unknown member": members.join(self.table("episodes"), "fingerprint", "left_anti"),
                 "member twice": duplicates(members, ["fingerprint"]), "place twice": duplicates(members, ["ordinal"])})
        self._write(members.withColumn("collection_name", F.lit(collection["name"])), "collection_episodes", f"collection={collection['name']}")
        self._write(self.spark.createDataFrame([collection], SCHEMAS["collections"]), "collections", f"collection={collection['name']}")

    def select_shards(self, level: int, task: str, weapon: str, encoder: str, budget: int | None = None) -> DataFrame:
        return select_shards(self.table("shards").where((F.col("level") == level) & (F.col("task") == task) & (F.col("weapon") == weapon) & (F.col("encoder_sha256") == encoder)), budget)


def select_shards(shards: DataFrame, budget: int | None = None) -> DataFrame:
    """Shards of one taxonomy in order of ordinal: the smallest prefix whose episodes reach the budget (all without one); too few is an error."""
    if budget is None:
        return shards.orderBy("ordinal")
    run = shards.withColumn("running", F.sum("episodes").over(Window.partitionBy("level", "task", "weapon", "encoder_sha256").orderBy("ordinal")))
    got = run.where(F.col("running") - F.col("episodes") < budget)
    require((got.agg(F.sum("episodes")).collect()[0][0] or 0) >= budget, f"fewer than {budget} episodes")
    return got.drop("running").orderBy("ordinal")


def members(shards: DataFrame, shard_episodes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Shards with their episodes, in order of shard and place: the three-way join behind exports."""
    return shards.alias("s").join(shard_episodes.alias("m"), F.col("s.id") == F.col("m.shard_id")).join(episodes.alias("e"), F.col("m.fingerprint") == F.col("e.fingerprint")).select(
        F.col("s.id").alias("shard_id"), F.col("s.ordinal").alias("shard_ordinal"), F.col("m.ordinal").alias("ordinal"), "e.fingerprint", "e.uid", "e.source_trace", "e.action_steps")


VIEWS = ("start_to_boss", "boss_fight", "full")


def view_bounds(view, actions, boundary):
    """Columns obs_from, obs_to, act_from, act_to (half-open) of a view of an episode of A actions with its boundary at observation b; an unknown view or a
    boundary outside [0, A] is an error. Observations are one more than actions in every view."""
    bad = F.raise_error(F.lit("no such view or boundary"))
    ok = view.isin(*VIEWS) & boundary.between(0, actions)
    at = lambda first, fight, full: F.when(~F.coalesce(ok, F.lit(False)), bad.cast("int")).when(view == "start_to_boss", first).when(view == "boss_fight", fight).otherwise(full)
    zero = F.lit(0)
    return [at(zero, boundary, zero).alias("obs_from"), at(boundary + 1, actions + 1, actions + 1).alias("obs_to"), at(zero, boundary, zero).alias("act_from"), at(boundary, actions, actions).alias("act_to")]


def sliced(df: DataFrame, view, observations: str, actions: str, boundary: str) -> DataFrame:
    """Aligned slices of the array columns for a view."""
    a, b = F.size(actions), F.col(boundary)
    t = df.select("*", *view_bounds(view, a, b))
    return t.withColumn(observations, F.slice(observations, F.col("obs_from") + 1, F.col("obs_to") - F.col("obs_from"))).withColumn(actions, F.slice(actions, F.col("act_from") + 1, F.greatest(F.col("act_to") - F.col("act_from"), F.lit(0))))
