"""Plans that are kept: actions as JSON lines in a folder for each plan, headers and their states as rows that are only added to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: a key that only plans of the former schema have.
FORMER_KEY = "game_id"
_STATE = "plan_id long, dest_id long, mode string, status string, summary string, at timestamp"


def save(actions: DataFrame, root: str, plan_id: int, dest_id: int, mode: str, status: str = "pending", now: Column | None = None) -> None:
    """Writes the actions (kind and any columns), then the header, so a plan with a header is whole. summary: the number of actions of each kind as JSON; now: another clock."""
    root = root.rstrip("/")
    path = f"{root}/actions/plan_id={plan_id}"
    actions.select(F.to_json(F.struct(*actions.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    kinds = actions.sparkSession.read.text(path).groupBy(F.get_json_object("value", "$.kind").alias("kind")).agg(F.count("*").alias("n"))
    summary = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))))  # a handful of kinds
    kinds.where("kind IS NOT NULL").agg(summary.alias("summary")).select(*_header(plan_id, dest_id, mode, status), "summary", _clock(now)).write.mode("append").parquet(f"{root}/states")


def _clock(now: Column | None) -> Column:
    return (F.current_timestamp() if now is None else now.cast("timestamp")).alias("at")


def _header(plan_id: int, dest_id: int, mode: str, status: str) -> list:
    return [F.lit(plan_id).cast("long").alias("plan_id"), F.lit(dest_id).cast("long").alias("dest_id"), F.lit(mode).alias("mode"), F.lit(status).alias("status")]


def saved_plans(spark: SparkSession, root: str) -> DataFrame:
    """plan_id, dest_id, mode, status, summary, created_at: the latest state of each plan. Lists show the newest first (order by plan_id desc)."""
    rows = spark.read.schema(_STATE).parquet(f"{root.rstrip('/')}/states")
    return rows.groupBy("plan_id").agg(*(F.max_by(c, "at").alias(c) for c in ("dest_id", "mode", "status", "summary")), F.min("at").alias("created_at"))


def newest_plans(plans: DataFrame, n: int, destinations: DataFrame | None = None) -> DataFrame:
    """saved_plans with place: the n newest of each destination, 1 is the newest. Each task keeps n of its own before the shuffle. destinations: dest_id, only these."""
    own = plans if destinations is None else plans.join(destinations.select("dest_id").distinct(), "dest_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("dest_id").orderBy(F.desc("plan_id")))
    return own.withColumn("place", place).where(F.col("place") <= n)


def set_status(spark: SparkSession, root: str, plan_id: int, status: str, now: Column | None = None) -> None:
    """Adds a state to a plan (applied, cancelled, partial); a plan that isn't there gets none. now: another clock."""
    last = saved_plans(spark, root).where(F.col("plan_id") == plan_id)
    last.select("plan_id", "dest_id", "mode", F.lit(status).alias("status"), "summary", _clock(now)).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/states")


def load(spark: SparkSession, root: str, plan_id: int, schema: StructType | str) -> DataFrame:
    """The actions of a plan. A plan of the former schema raises ValueError: its preview has to be made again."""
    rows = spark.read.text(f"{root.rstrip('/')}/actions/plan_id={plan_id}")
    if not rows.where(F.array_contains(F.json_object_keys("value"), FORMER_KEY)).isEmpty():
        raise ValueError(f"plan {plan_id} is of a former schema; preview it again")
    return rows.select(F.from_json("value", schema).alias("a")).select("a.*")


def approved(plan: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """The actions that were approved."""
    return plan.join(approvals.select(*keys).distinct(), keys, "left_semi")


def resolve_all(plan: DataFrame, resolution: str) -> DataFrame:
    """One resolution for all name conflicts; other actions keep theirs. plan: status, resolution."""
    return plan.withColumn("resolution", F.when(F.col("status") == "dupe_filename", resolution).otherwise(F.col("resolution")))
