"""Encoders kept up to date under inserted and deleted rows.

Input is a changelog: rows with a `diff` (+1 inserted, -1 deleted, or any multiplicity), an epoch at a
time. Output is a changelog too: the encoded rows that came or went. All output so far, summed up, is
what a fit and transform of the live rows gives.

Each encoder of each chain has a state that an epoch's changes are merged into: moments, counts of
values, counts of tokens, or counts of rows that have something at a position. The later encoders of a
chain get as their changes what the ones before make of the rows' changes; and if metadata of those
before are others now, also the codes that live rows lose and get by it. Only then, live rows are read:
one pass encodes each under the old and the new metadata, and rows whose code differs are put out.
Rounded metadata, and new values while a vector's width lasts, therefore keep updates as cheap as the
rows that they bring, whatever the number of live rows.

Live rows and counts are logs: an epoch appends its changes, and the parts of a log are joined so that
each is a multiple of the next. Of a vocabulary, the places are written again in epochs that add or
remove values.

The state of each epoch is below `path`, written before the epoch's output is handed over, and named by
the epoch: an epoch that is repeated after a failure starts from the one before it and gives the same
again. What the state before that needed is removed.

Cases: an epoch without changes gives none; diffs of equal rows are added up, and null diffs are
ignored. Nulls are ignored by fitting. Rows taken away that were never there are an error of the input
that isn't looked for. An epoch whose predecessor is missing raises ValueError, as do columns named
diff or e0, e1, ...
"""

from __future__ import annotations

import copy
import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featureflow.functions.capacity import resized
from featureflow.functions.storage import drop, exists, remove, written
from featureflow.functions.text import tokens
from featureflow.operators.base import Encoder
from featureflow.operators.categorical import Numbering, OneHotEncoder, numbered
from featureflow.operators.scalers import MinMaxScaler, StandardScaler
from featureflow.operators.text import CountVectorizer, TfidfTransformer, present
from featureflow.plans.compose import flat

#: Parts that a log has at most before some are joined, and how many times the next one's rows a part has then.
PARTS, TIMES = 8, 2


@dataclass
class Moments:
    """Count, mean and squared deviations of a multiset; `add` takes another one, of negative count to take rows away."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def add(self, n: int, mean: float, m2: float) -> Moments:
        total = self.n + n
        if total == 0:
            return Moments()  # nothing is left, so neither is an error of rounding
        if self.n == 0:
            return Moments(n, mean, m2)
        if n == 0:
            return Moments(self.n, self.mean, self.m2)
        delta = mean - self.mean
        return Moments(total, self.mean + delta * (n / total), self.m2 + m2 + delta * delta * self.n * n / total)


def moments(changes: DataFrame, x: Column, about: float | None = None) -> tuple[Moments, Moments]:
    """Moments of the rows that came and of those that went, with multiplicities.

    Sums are taken about a number near the values (their mean by a pass of its own, if none is known),
    so that large values of small spread lose no digits.
    """
    x = x.cast("double")
    if about is None:
        w = F.when(x.isNotNull(), F.abs("diff"))
        about = changes.agg(F.sum(w * x) / F.nullif(F.sum(w), F.lit(0))).first()[0] or 0.0
    if not math.isfinite(about):
        about = 0.0
    parts = []
    for sign in (1, -1):
        w = F.when(x.isNotNull() & (F.col("diff") * sign > 0), F.col("diff") * sign)
        d = x - F.lit(about)
        parts += [F.sum(w), F.sum(w * d), F.sum(w * d * d)]
    row = changes.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    out = []
    for i in (0, 3):
        n, first, second = row[i] or 0, row[i + 1] or 0.0, row[i + 2] or 0.0
        m2 = second - first * first / n if n else 0.0
        out.append(Moments(n, about + first / n if n else 0.0, m2 if m2 != m2 else max(0.0, m2)))
    return out[0], out[1]


def summed(rows: DataFrame, by: str = "diff") -> DataFrame:
    """Changes of equal rows added up, without those that come to nothing."""
    keys = [c for c in rows.columns if c != by]
    return rows.groupBy(*keys).agg(F.sum(by).alias(by)).filter(F.col(by) != 0)


@dataclass
class State:
    """Of one encoder: numbers in `stats`, a log's parts [path, rows], and the path of a vocabulary's places."""

    stats: dict[str, Any] = field(default_factory=dict)
    log: list[list] = field(default_factory=list)
    places: str | None = None
    leaving: str | None = None  # places of values whose last rows this epoch takes away: they go with the code they came with


@dataclass
class Epoch:
    """What an epoch leaves: the live rows' log, states by chain and stage, and paths that only the epoch before needs."""

    rows: list[list] = field(default_factory=list)
    states: list[list[State]] = field(default_factory=list)
    obsolete: list[str] = field(default_factory=list)


class IncrementalEncoder:
    """config: (column, encoder) entries as for MultiColumnEncoder, columns by name.

    Columns of the input are `columns` (types as in Spark's DDL) and diff; output rows have the
    input's columns, e0, e1, ... and diff.
    """

    def __init__(self, spark: SparkSession, config: list[tuple[str, Encoder]], columns: str, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(columns)
        self.names = self.schema.fieldNames()
        if clash := {"diff", *(f"e{i}" for i in range(len(config)))} & set(self.names):
            raise ValueError(f"columns named {sorted(clash)} are the output's own")
        self.chains = [(column, flat(encoder)) for column, encoder in config]

    # --- logs --------------------------------------------------------------------------------

    def _read(self, log: list[list], schema: T.StructType | None = None) -> DataFrame:
        paths = [p for p, _ in log]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _append(self, log: list[list], part: DataFrame, at: str, by: str, obsolete: list[str]) -> tuple[list[list], DataFrame]:
        """The log with a part written at `at`, its last parts joined where there are many; and the part."""
        part.write.mode("overwrite").parquet(at)
        part = self.spark.read.schema(part.schema).parquet(at)
        log = [*log, [at, part.count()]]
        if len(log) > PARTS:
            k = len(log) - 1
            while k > 0 and log[k - 1][1] <= TIMES * sum(n for _, n in log[k:]):
                k -= 1
            if k == len(log) - 1:
                k -= 1
            joined = summed(self._read(log[k:], part.schema), by)
            joined.write.mode("overwrite").parquet(f"{at}-joined")
            obsolete += [p for p, _ in log[k:]]
            log = [*log[:k], [f"{at}-joined", self.spark.read.schema(part.schema).parquet(f"{at}-joined").count()]]
        return log, part

    # --- states ------------------------------------------------------------------------------

    def _merge(self, e: Encoder, state: State, changes: DataFrame, at: str, obsolete: list[str]) -> State:
        """The state after changes (value, diff) of an encoder's input."""
        if isinstance(e, StandardScaler):
            return self._merge_moments(state, changes)
        if isinstance(e, MinMaxScaler):
            return self._merge_range(state, changes, at, obsolete)
        if isinstance(e, CountVectorizer):
            return self._merge_places(state, changes.select(F.explode(tokens(F.col("value"))).alias("value"), "diff"), at, obsolete)
        if isinstance(e, Numbering):
            return self._merge_places(state, changes, at, obsolete)
        if isinstance(e, TfidfTransformer):
            came = changes.filter("value IS NOT NULL").agg(F.sum("diff")).first()[0] or 0
            log, _ = self._append(state.log, present(changes).filter("have <> 0"), f"{at}/have", "have", obsolete)
            return State({"n": state.stats.get("n", 0) + came}, log)
        return state  # without metadata

    def _merge_moments(self, state: State, changes: DataFrame) -> State:
        now = Moments(**state.stats) if state.stats else Moments()
        came, went = moments(changes, F.col("value"), now.mean if now.n else None)
        now = now.add(came.n, came.mean, came.m2).add(-went.n, went.mean, -went.m2)
        return State(asdict(Moments(now.n, now.mean, now.m2 if now.m2 != now.m2 else max(0.0, now.m2))))

    def _counts(self, changes: DataFrame) -> DataFrame:
        return changes.filter("value IS NOT NULL").groupBy("value").agg(F.sum("diff").cast("long").alias("count")).filter("count <> 0")

    def _merge_range(self, state: State, changes: DataFrame, at: str, obsolete: list[str]) -> State:
        log, part = self._append(state.log, self._counts(changes.withColumn("value", F.col("value").cast("double"))), f"{at}/counts", "count", obsolete)
        up, down = F.when(F.col("count") > 0, F.col("value")), F.when(F.col("count") < 0, F.col("value"))
        came_low, came_high, gone_low, gone_high = part.agg(F.min(up), F.max(up), F.min(down), F.max(down)).first()
        low, high = state.stats.get("min"), state.stats.get("max")
        numbers = [x for x in (came_low, came_high, gone_low, gone_high, low, high) if x is not None]
        inside = gone_low is None or (low is not None and gone_low > low and gone_high < high)
        if not inside or any(x != x for x in numbers):  # an end has lost rows: what is left decides
            live = summed(self._read(log, part.schema), "count").filter("count > 0")
            low, high = live.agg(F.min("value"), F.max("value")).first()
        else:
            low = min((x for x in (low, came_low) if x is not None), default=None)
            high = max((x for x in (high, came_high) if x is not None), default=None)
        return State({"min": low, "max": high}, log)

    def _merge_places(self, state: State, changes: DataFrame, at: str, obsolete: list[str]) -> State:
        """Counts of values, and places of the live ones: these keep theirs, new ones take free places in their order, and all are numbered anew when the width shrinks."""
        log, part = self._append(state.log, self._counts(changes), f"{at}/counts", "count", obsolete)
        stats = state.stats or {"n": 0, "width": 1, "version": 0, "gaps": False}
        if not log[-1][1] and log[-1][0].endswith("counts"):
            return State(stats, log, state.places)  # no counts have changed
        # What the changed values had before: a look into the log, which isn't written again for it.
        touched = part.select("value")
        before = summed(self._read(state.log, part.schema).join(F.broadcast(touched) if part.count() <= 100_000 else touched, "value", "left_semi"), "count") if state.log else part.limit(0)
        both = part.join(before.withColumnRenamed("count", "had"), "value", "left").select("value", F.coalesce("had", F.lit(0)).alias("had"), (F.coalesce("had", F.lit(0)) + F.col("count")).alias("has"))
        moved = written(both.filter("(had <= 0) <> (has <= 0)").select("value", (F.col("has") > 0).alias("new")), "moved")
        n_new, n_gone = (moved.agg(F.count_if("new"), F.count_if(~F.col("new"))).first())
        if not n_new and not n_gone:
            drop(moved)
            return State(stats, log, state.places)
        n = stats["n"] + n_new - n_gone
        width = resized(n, stats["width"])
        shrinks = width < stats["width"]
        new = moved.filter("new").select("value")
        kept = self.spark.read.parquet(state.places).join(moved.filter("NOT new"), "value", "left_anti") if state.places else None
        if kept is None or shrinks:
            live = new if kept is None else kept.select("value").unionByName(new)
            placed, gaps = numbered(live, n), False
        elif not n_new:
            placed, gaps = kept, True
        else:
            ranked = numbered(new, n_new)
            if stats["gaps"] or n_gone:
                free = self.spark.range(n).select(F.col("id").cast("int").alias("value")).join(kept.select(F.col("pos").alias("value")), "value", "left_anti")
                free = numbered(free, n).withColumnsRenamed({"value": "free", "pos": "rank"})
                ranked = ranked.join(free, F.col("pos") == F.col("rank")).select("value", F.col("free").alias("pos"))
            else:
                ranked = ranked.withColumn("pos", (F.col("pos") + stats["n"]).cast("int"))
            placed, gaps = kept.unionByName(ranked), stats["gaps"] or n_gone > 0
        placed.write.mode("overwrite").parquet(f"{at}/places")
        leaving = None
        if n_gone and not shrinks:
            leaving = f"{at}/leaving"
            self.spark.read.parquet(state.places).join(moved.filter("NOT new"), "value", "left_semi").write.mode("overwrite").parquet(leaving)
        drop(moved)
        if state.places:
            obsolete.append(state.places)
        return State({"n": n, "width": width, "version": stats["version"] + shrinks, "gaps": gaps}, log, f"{at}/places", leaving)

    def _published(self, e: Encoder, state: State) -> Any:
        """What decides the code of a row that was there before and after."""
        if isinstance(e, (StandardScaler, MinMaxScaler)):
            return [repr(x) for x in self._with(e, state).meta]
        if isinstance(e, (OneHotEncoder, CountVectorizer)):
            return [state.stats.get("version"), state.stats.get("width")]
        if isinstance(e, Numbering):
            return state.stats.get("version")
        if isinstance(e, TfidfTransformer):
            return [state.stats.get("n"), state.log]
        return None

    def _with(self, e: Encoder, state: State, now: bool = False) -> Encoder:
        """A copy of the encoder with the metadata of a state; now: for the rows of the state's own epoch."""
        e = copy.copy(e)
        if isinstance(e, StandardScaler):
            n = state.stats.get("n", 0)
            e.learn({"mean": state.stats["mean"] if n else None, "var": state.stats["m2"] / n if n else None})
        elif isinstance(e, MinMaxScaler):
            e.learn({"min": state.stats.get("min"), "max": state.stats.get("max")})
        elif isinstance(e, (Numbering, CountVectorizer)):
            text = isinstance(e, CountVectorizer)
            none = self.spark.createDataFrame([], "value string, pos int") if text else None
            table = self.spark.read.parquet(state.places) if state.places else none
            if now and state.leaving:
                table = table.unionByName(self.spark.read.parquet(state.leaving))
            if table is None:
                raise ValueError("there are no values yet")
            e.take(table, state.stats.get("n", 0))
            e.kept_width = state.stats.get("width", 1)
        elif isinstance(e, TfidfTransformer):
            have = self._read(state.log) if state.log else self.spark.createDataFrame([], "pos int, have long")
            e.take(summed(have, "have"), state.stats.get("n", 0))
        return e

    # --- epochs ------------------------------------------------------------------------------

    def _load(self, epoch: int) -> Epoch:
        if epoch < 0:
            return Epoch(states=[[State() for _ in stages] for _, stages in self.chains])
        at = f"{self.path}/meta/epoch={epoch}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            raise ValueError(f"epoch {epoch} has not been processed, so epoch {epoch + 1} can't be")
        found = json.loads(self.spark.read.text(at, wholetext=True).first()[0])
        return Epoch(found["rows"], [[State(**s) for s in chain] for chain in found["states"]], found["obsolete"])

    def _chain(self, rows: DataFrame, column: str, stages: list[Encoder], to: str) -> DataFrame:
        x = F.col(f"`{column}`")
        for e in stages:
            rows, x = e.encode(rows, x)
        return rows.withColumn(to, x)

    def process(self, epoch: int, changes: DataFrame) -> DataFrame:
        """Take the changes of an epoch (numbered from 0, one after another) and give the changes of the encoded rows, to be read before the next epoch is processed."""
        old = self._load(epoch - 1)
        at = f"{self.path}/epoch={epoch}"
        obsolete: list[str] = []
        changes = summed(changes.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], F.col("diff").cast("long").alias("diff")))
        log, changes = self._append(old.rows, changes, f"{at}/rows", "diff", obsolete)
        before = self._read(old.rows, changes.schema) if old.rows else None
        states, chains = [], []
        for i, (column, stages) in enumerate(self.chains):
            was: list[Encoder] = []
            now: list[Encoder] = []
            mine: list[State] = []
            same = True
            for depth, (e, state) in enumerate(zip(stages, old.states[i], strict=True)):
                moved = self._moved(before, changes, column, was, now, same)
                merged = self._merge(e, state, moved, f"{at}/{i}-{depth}", obsolete)
                mine.append(merged)
                same = same and self._published(e, state) == self._published(e, merged)
                if before is not None:
                    was.append(self._ready(e, state))
                now.append(self._ready(e, merged, now=True))
            states.append(mine)
            chains.append((column, was, now, same))
        meta = json.dumps({"rows": log, "states": [[asdict(s) for s in chain] for chain in states], "obsolete": obsolete})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/epoch={epoch}")
        for path in old.obsolete:  # what the last epoch but one left, which only the last one's output needs
            remove(self.spark, path)
        out = changes
        for i, (column, _, now, _) in enumerate(chains):
            out = self._chain(out, column, now, f"e{i}")
        codes = [f"e{i}" for i in range(len(chains))]
        out = out.select(*self.names, *codes, "diff")
        if before is None or all(same for *_, same in chains):
            return out
        return out.unionByName(self._differing(before, chains, codes))

    def _ready(self, e: Encoder, state: State, now: bool = False) -> Encoder:
        if isinstance(e, Numbering) and not state.places:
            return _Nothing(isinstance(e, OneHotEncoder))
        return self._with(e, state, now)

    def _moved(self, before: DataFrame | None, changes: DataFrame, column: str, was: list[Encoder], now: list[Encoder], same: bool) -> DataFrame:
        """Changes (value, diff) of what the encoders so far make of a column."""
        out = self._chain(changes, column, now, "_x").select(F.col("_x").alias("value"), "diff")
        if before is None or same:
            return out
        both = self._chain(self._chain(before, column, was, "_x"), column, now, "_y").filter(~F.col("_x").eqNullSafe(F.col("_y")))
        sides = F.array(F.struct(F.col("_x").alias("value"), (-F.col("diff")).alias("diff")), F.struct(F.col("_y").alias("value"), F.col("diff").alias("diff")))
        return out.unionByName(both.select(F.inline(sides)))

    def _differing(self, before: DataFrame, chains: list[tuple], codes: list[str]) -> DataFrame:
        """Live rows whose codes differ: under the old metadata taken away, under the new put in, in one pass."""
        rows = before
        for i, (column, was, now, same) in enumerate(chains):
            rows = self._chain(rows, column, now, f"_n{i}")
            rows = rows.withColumn(f"_o{i}", F.col(f"_n{i}")) if same else self._chain(rows, column, was, f"_o{i}")
        differ = F.lit(False)
        for i, (*_, same) in enumerate(chains):
            if not same:
                differ = differ | ~F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
        side = lambda p, sign: F.struct(*[F.col(f"`{c}`") for c in self.names], *[F.col(f"_{p}{i}").alias(c) for i, c in enumerate(codes)], (F.col("diff") * sign).alias("diff"))
        return rows.filter(differ).select(F.inline(F.array(side("o", -1), side("n", 1))))

    def stream(self, source: DataFrame, sink: Any, checkpoint: str) -> Any:
        """Run over a streaming DataFrame of changes; sink(output, epoch) gets each micro-batch's output. Returns the query, which ends when the source's present data are taken."""
        return source.writeStream.foreachBatch(lambda batch, i: sink(self.process(i, batch), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Nothing(Encoder):
    """An encoder that numbers values, before there are any."""

    def __init__(self, vector: bool):
        self.vector = vector

    def encode(self, df: DataFrame, x: Column) -> tuple[DataFrame, Column]:
        return df, F.array(F.lit(0.0)) if self.vector else F.lit(-1.0)
