"""History of changing attributes: a bitemporal ledger of observations with valid and recorded times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.segments import with_blocks
from tessera.shared import Scratch, epoch_us, small

_OBS = ("market_id", "at", "received", "obs_id", "title", "status", "closes")
_LEDGER = (*_OBS, "first", "now_title", "now_status", "begins", "valid_to", "recorded_at")
_ROWS = (
    "market_id long, at long, received long, obs_id long, title string, status string, closes long, first long, now_title string, now_status string, "
    "begins boolean, valid_to long, recorded_at long, batch int"
)
_CLOSED = "market_id long, at long, of int, superseded_at long, batch int"


def observations(snapshots: DataFrame) -> DataFrame:
    """Snapshots in comparable form. Titles: outer blanks removed, runs of blanks reduced to one, case kept;
    statuses: lower case without outer blanks; close times: whole minutes; times in microseconds.

    Rows without market_id or captured_at place nothing in time and are left out; a null received_at counts as
    the earliest. An empty title is a value; only null is "not reported". Extra columns are ignored.
    """
    title = F.trim(F.regexp_replace("title", r"[\s ]+", " "))
    minute = (F.floor(epoch_us("close_time") / 60_000_000)).cast("long")
    return snapshots.filter("market_id is not null and captured_at is not null").select(
        F.col("market_id").cast("long").alias("market_id"), epoch_us("captured_at").alias("at"),
        F.coalesce(epoch_us("received_at"), F.lit(-(1 << 62))).alias("received"), F.coalesce(F.col("obs_id"), F.lit(-1)).cast("long").alias("obs_id"),
        title.alias("title"), F.lower(F.trim("status")).alias("status"), minute.alias("closes"),
    )


def _latest(obs: DataFrame) -> DataFrame:
    """Of the rows with one market and time, the one received last; equal ones by obs_id, then by their values. ``first`` is when the
    first of them was received."""
    rest = F.struct("received", "obs_id", "title", "status", "closes")
    first = F.col("first") if "first" in obs.columns else F.col("received")
    return obs.groupBy("market_id", "at").agg(F.max(rest).alias("r"), F.min(first).alias("first")).select("market_id", "at", "r.*", "first")


def timeline(obs: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Sweep over each market's observations in order of ``at``: the values held (title and status carried on
    where not reported), whether a version begins, where the interval ends (null: open), and ``recorded_at``: when the last of
    what says so was received (the observation, those its title and status come from, the first that ends it).

    A market with more than ``hot_rows`` observations is swept in blocks; what each block ends with is carried
    into the next, so no task sorts more than a block.
    """
    rows, hot_keys = with_blocks(obs, "market_id", "at", hot_rows)
    if hot_keys:  # repeated observations are reduced before anything is moved
        rows, hot_keys = with_blocks(_latest(obs), "market_id", "at", hot_rows)
        here = Window.partitionBy("market_id", "blk").orderBy("at")
    else:  # one shuffle by market serves the reduction and every window
        rows = _latest(obs.repartition("market_id")).withColumn("blk", F.lit(0))
        here = Window.partitionBy("market_id").orderBy("at")
    past = here.rowsBetween(Window.unboundedPreceding, 0)
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("received").alias("r")))

    swept = rows.select(
        "*", F.last(told("title"), True).over(past).alias("_t"), F.last(told("status"), True).over(past).alias("_s"),
        F.lead(F.struct("at", "first")).over(here).alias("_next"), F.row_number().over(here).alias("_rn"),
    )
    if hot_keys:
        hot = small(rows.filter("blk > 0").select("market_id").distinct())
        ends = rows.join(hot, "market_id", "left_semi").groupBy("market_id", "blk").agg(
            F.max_by(told("title"), F.when(F.col("title").isNotNull(), F.col("at"))).alias("t"), F.max_by(told("status"), F.when(F.col("status").isNotNull(), F.col("at"))).alias("s"),
            F.max_by(F.struct("closes"), "at").alias("c"), F.min(F.struct("at", "first")).alias("start"),
        )
        by = Window.partitionBy("market_id").orderBy("blk")
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(
            "market_id", "blk", F.last("t", True).over(before).alias("_ct"), F.last("s", True).over(before).alias("_cs"),
            F.lag("c").over(by).alias("_cc"), F.lead("start").over(by).alias("_cnext"),
        )
        swept = swept.join(small(carried), ["market_id", "blk"], "left")
    else:
        none = F.lit(None)
        swept = swept.withColumns({"_ct": none.cast("struct<v:string,r:bigint>"), "_cs": none.cast("struct<v:string,r:bigint>"), "_cc": none.cast("struct<closes:bigint>"), "_cnext": none.cast("struct<at:bigint,first:bigint>")})
    swept = swept.withColumns({"_t": F.coalesce("_t", "_ct"), "_s": F.coalesce("_s", "_cs"), "_next": F.coalesce("_next", "_cnext")})
    swept = swept.withColumn("now_title", F.col("_t.v")).withColumn("now_status", F.col("_s.v"))
    prior: dict[str, Column] = {c: F.lag(c).over(here) for c in ("now_title", "now_status", "closes")}
    first = (F.col("_rn") == 1) & F.col("_cc").isNull()
    at_block = F.col("_rn") == 1
    same = (
        F.when(at_block, F.col("now_title").eqNullSafe(F.col("_ct.v"))).otherwise(F.col("now_title").eqNullSafe(prior["now_title"]))
        & F.when(at_block, F.col("now_status").eqNullSafe(F.col("_cs.v"))).otherwise(F.col("now_status").eqNullSafe(prior["now_status"]))
        & F.when(at_block, F.col("closes").eqNullSafe(F.col("_cc.closes"))).otherwise(F.col("closes").eqNullSafe(prior["closes"]))
    )
    recorded = F.greatest("received", "_t.r", "_s.r", "_next.first")
    return swept.withColumns({"begins": first | ~same, "valid_to": F.col("_next.at"), "recorded_at": recorded}).select(*_LEDGER)


class BitemporalLedger:
    """Rows (observation, values held, valid from ``at`` until ``valid_to``) with the time they were recorded, and closings, which
    say when a row was superseded. Both are only ever appended to, a folder a batch under ``path``; nothing is overwritten or
    removed, and a ledger opened again on the same path goes on where it was. A batch counts once its closings are written.

    The rows in force are a function of all observations recorded, however they were divided into batches. A state that was
    superseded within a batch leaves no row.
    """

    def __init__(self, spark, hot_rows: int = 100_000, path: str | None = None):
        self.spark, self.scratch, self.hot_rows = spark, Scratch(spark, "ledger"), hot_rows
        self.path = (path or self.scratch.root).rstrip("/")

    def batches(self) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/closings/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return len(found) if found is not None else 0

    def _read(self, what: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{what}/batch={k}" for k in range(self.batches())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def in_force(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows not superseded, of all markets or of those in ``keys`` (market_id)."""
        rows, closed = self._read("rows", _ROWS), self._read("closings", _CLOSED).select("market_id", "at", F.col("of").alias("batch"))
        if keys is not None:
            rows, closed = rows.join(keys, "market_id", "left_semi"), closed.join(keys, "market_id", "left_semi")
        return rows.join(closed, ["market_id", "at", "batch"], "left_anti")

    def apply(self, updates: DataFrame) -> None:
        """Record a batch of observations (see :func:`observations`), late ones included.

        The markets they touch are swept anew over their rows in force and the updates: an update inside an interval
        splits it. Rows the sweep gives back unchanged stay as they are; for the others a closing is appended, and the new
        row beside it.
        """
        k, updates = self.batches(), updates.select(*_OBS)
        if not k:
            self._append(timeline(updates, self.hot_rows), "rows", k)
            self._append(self.spark.createDataFrame([], _CLOSED).drop("batch"), "closings", k)
            return
        touched = self.scratch.write(self.in_force(updates.select("market_id").distinct()), "touched")
        known = touched.select(*_OBS, "first").unionByName(updates.withColumn("first", F.col("received")))
        new = F.struct(*[c for c in _LEDGER if c not in ("market_id", "at")])
        fresh = timeline(known, self.hot_rows).select("market_id", "at", new.alias("new"))
        both = touched.select("market_id", "at", new.alias("old"), F.col("batch").alias("of")).join(fresh, ["market_id", "at"], "full")
        changes = self.scratch.write(both.filter(~F.col("old").eqNullSafe(F.col("new"))), "sweep")
        self._append(changes.select("market_id", "at", "new.*"), "rows", k)
        self._append(changes.filter("of is not null").select("market_id", "at", "of", F.col("new.recorded_at").alias("superseded_at")), "closings", k)
        self.scratch.drop(changes, touched)

    def _append(self, df: DataFrame, what: str, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/batch={k}")  # what a run that failed left behind is replaced

    def ledger(self) -> DataFrame:
        """All rows ever recorded; ``superseded_at`` is null for those in force."""
        closed = self._read("closings", _CLOSED).select("market_id", "at", F.col("of").alias("batch"), "superseded_at")
        return self._read("rows", _ROWS).join(closed, ["market_id", "at", "batch"], "left")

    def versions(self) -> DataFrame:
        """(market_id, valid_from, valid_to, title, status, closes_minute, recorded_at): the versions in force."""
        by = Window.partitionBy("market_id").orderBy("at")
        starts = self.in_force().filter("begins")
        return starts.select(
            "market_id", F.col("at").alias("valid_from"), F.lead("at").over(by).alias("valid_to"), F.col("now_title").alias("title"),
            F.col("now_status").alias("status"), F.col("closes").alias("closes_minute"), "recorded_at",
        )


def history(snapshots: DataFrame, batches: int = 3, hot_rows: int = 100_000, path: str | None = None) -> BitemporalLedger:
    """A ledger built from all snapshots in ``batches`` parts by time of receipt, as they would have arrived.

    The first part is half of the rows, the others share the rest. Empty input gives an empty ledger.
    """
    book = BitemporalLedger(snapshots.sparkSession, hot_rows, path)
    obs = observations(snapshots)
    cuts = [0.5 + 0.5 * i / (batches - 1) for i in range(batches - 1)] if batches > 1 else []
    bounds = sorted(set(obs.agg(F.percentile_approx("received", cuts, 10_000)).first()[0] or [])) if cuts else []
    low = None
    for high in [*bounds, None]:
        part = obs if low is None else obs.filter(F.col("received") > low)
        part = part if high is None else part.filter(F.col("received") <= high)
        if low is None or not part.isEmpty():
            book.apply(part)
        low = high
    return book
