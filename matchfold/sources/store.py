"""Versioned Parquet state (S4, S5 sink, S8, S9, S10).

Layout under ``root`` (a shared folder, by default below ``spark.checkpoint.dir``)::

    data/<update>/<attribute>/     rows that an update wrote to a mapping table: a layer
    data/<update>/index/           its entries of the cluster index
    data/<update>/arrivals/        what it folded: (stream, arrival)
    commits/v00000001.json         a version: last id, and the layers that make it up

A version is a list of layers: an update writes the rows it inserts or changes, nothing of
what it leaves as it is, and a new version points to the layers of the one before and to its
own.  A table is its oldest layer without the values of the later ones, and these.  When the
later ones come to more than ``fold_share`` times the oldest, or are many, the table is written
as one layer again, so reading stays bounded and each row is rewritten a bounded number of
times on average.  No path is ever written twice, so readers of old versions are not hurt.

Commits are exclusive: a version's file appears whole or not at all, and only once.  Of two
updates from one base the second to commit finds the version taken, and folds its batch again
into the new head.  A commit records what it folded (files, or batch numbers), not a mark up
to which: late arrivals count, replays do not.

With ``buckets=B`` layers are bucketed tables (on ``value``, the index on its ``slot``), known
to the session catalog as external tables.  Joins on ``value`` -- the batch lookup, the match,
layers among each other -- read the stored side without shuffling it, and a filter on a few
values reads only their buckets.  Use B equal to ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchfold.operators.cluster_index import ENTRY_COLUMNS, ENTRY_DDL, ClusterIndex, entries
from matchfold.operators.joins import LARGE_BATCH, sized
from matchfold.operators.materialise import scratch
from matchfold.operators.seed import insert_if_absent
from matchfold.operators.state import MAPPING_COLUMNS, MappingState, empty_mapping
from matchfold.operators.update import update_mappings
from matchfold.schema import ATTRIBUTES

LAYER_DDL = "value STRING, prev_match_id BIGINT, match_id BIGINT, source STRING, datetime TIMESTAMP_NTZ, old_prev BIGINT"
ARRIVAL_DDL = "stream STRING, arrival STRING"


class CommitConflict(RuntimeError):
    """Another update has committed this version."""


def layered(layers: list[DataFrame], large: bool = False) -> DataFrame:
    """The table that layers (oldest first) make up: each value's row is that of its newest layer.
    ``large``: the later ones hold too many values to broadcast."""
    base, later = layers[0], layers[1:]
    if not later:
        return base.select(*MAPPING_COLUMNS)
    newer = later[0].select(*MAPPING_COLUMNS)
    if len(later) > 1:
        both = reduce(DataFrame.unionByName, [x.select(*MAPPING_COLUMNS, F.lit(i).alias("_layer")) for i, x in enumerate(later)])
        newest = both.groupBy("value").agg(F.max_by(F.struct(*MAPPING_COLUMNS[1:]), F.col("_layer")).alias("_r"))
        newer = newest.select("value", "_r.*")
    return base.join(sized(newer.select("value"), large), "value", "left_anti").select(*MAPPING_COLUMNS).unionByName(newer)


class _Attempt:
    """Writes of one update, in a folder of its own; what no commit points to is swept later."""

    def __init__(self, store: "StateStore", base: dict):
        self.store, self.base, self.id = store, base, uuid.uuid4().hex[:16]
        self.tables = {a: list(base["tables"][a]) for a in ATTRIBUTES}
        self.index, self.arrivals = list(base["index"]), list(base["arrivals"])
        self.written: dict[str, DataFrame] = {}

    def __call__(self, attr: str, delta: DataFrame, rows: int):
        """The sink of the fold: one more layer of the attribute's table."""
        name = f"data/{self.id}/{attr}"
        self.delta = self.store._write(name, delta, LAYER_DDL, "value")
        self.written[attr] = self.delta
        self.tables[attr].append([name, rows])
        self.attr = attr
        return self

    def table(self, old: DataFrame, old_size: int | None) -> DataFrame:
        return self.store._table(self.tables[self.attr])

    def write_index(self) -> None:
        if self.written:
            new = reduce(DataFrame.unionByName, [entries(a, d) for a, d in self.written.items()])
            name = f"data/{self.id}/index"
            self.store._write(name, new, ENTRY_DDL, "slot")
            self.index.append([name, sum(r for a in self.written for n, r in self.tables[a] if n.startswith(f"data/{self.id}/"))])

    def fold_layers(self) -> None:
        """Tables, index and ledger whose later layers outweigh the oldest, or are many, become one layer."""
        s = self.store
        for a, layers in self.tables.items():
            if s._heavy(layers):
                name = f"data/{self.id}/{a}-folded"
                whole = s._table(layers).withColumn("old_prev", F.lit(None).cast("long"))
                s._write(name, whole, LAYER_DDL, "value")
                self.tables[a] = [[name, s._layer(name, LAYER_DDL, "value").count()]]
        if s._heavy(self.index):
            name = f"data/{self.id}/index-folded"
            s._write(name, s._index(self.index).whole(), ENTRY_DDL, "slot")
            self.index = [[name, s._layer(name, ENTRY_DDL, "slot").count()]]
        if len(self.arrivals) > 8 * s.max_layers:
            name = f"data/{self.id}/arrivals-folded"
            s._ledger(self.arrivals).write.parquet(f"{s.root}/{name}")
            self.arrivals = [name]


class StateStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, max_layers: int = 8, fold_share: float = 1.0, attempts: int = 10):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.max_layers, self.fold_share, self.attempts = max_layers, fold_share, attempts
        self._tag = hashlib.sha1(self.root.encode()).hexdigest()[:12]

    # --- files ---------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions (names only, no Spark job)."""
        found = self._fs().globStatus(self._path("commits/v*.json"))
        return sorted(int(f.getPath().getName()[1:-5]) for f in found or [])

    def _read_commit(self, version: int) -> dict:
        jvm, stream = self.spark.sparkContext._jvm, self._fs().open(self._path(f"commits/v{version:08d}.json"))
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _head(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if version is not None:
            return self._read_commit(version) if version in found else None
        return self._read_commit(found[-1]) if found else None

    def _commit(self, commit: dict) -> None:
        """Make a version visible; ``CommitConflict`` if it exists already."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        final, fs = self._path(f"commits/v{commit['version']:08d}.json"), self._fs()
        draft = self._path(f"commits/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename would replace an existing file; a link does not
                files = [jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (final, draft)]
                jvm.java.nio.file.Files.createLink(*files)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise CommitConflict(f"version {commit['version']} exists under {self.root}") from None
            raise
        finally:
            fs.delete(draft, False)

    # --- layers --------------------------------------------------------------------

    def _table_name(self, name: str) -> str:
        return f"matchfold_{self._tag}_{name.replace('data/', '').replace('/', '_').replace('-', '_')}"

    def _layer(self, name: str, ddl: str, by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self.buckets:
            return self.spark.read.schema(ddl).parquet(path)
        table = self._table_name(name)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet CLUSTERED BY ({by}) INTO {int(self.buckets)} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _write(self, name: str, df: DataFrame, ddl: str, by: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df = df.select(*[x.split()[0] for x in ddl.split(", ")])
        if not self.buckets:
            df.write.parquet(path)
        else:
            laid_out = df.repartition(self.buckets, by)  # elided when df is already laid out so
            laid_out.write.format("parquet").bucketBy(self.buckets, by).sortBy(by).option("path", path).saveAsTable(self._table_name(name))
        return self._layer(name, ddl, by)

    def _table(self, layers: list) -> DataFrame:
        large = sum(rows for _, rows in layers[1:]) > LARGE_BATCH
        return layered([self._layer(n, LAYER_DDL, "value") for n, _ in layers], large) if layers else empty_mapping(self.spark)

    def _index(self, layers: list) -> ClusterIndex:
        return ClusterIndex([self._layer(n, ENTRY_DDL, "slot").select(*ENTRY_COLUMNS) for n, _ in layers])

    def _ledger(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ARRIVAL_DDL)
        return self.spark.read.schema(ARRIVAL_DDL).parquet(*[f"{self.root}/{n}" for n in names])

    def _heavy(self, layers: list) -> bool:
        return len(layers) > self.max_layers or len(layers) > 1 and sum(r for _, r in layers[1:]) > self.fold_share * layers[0][1]

    # --- versions ------------------------------------------------------------------

    def latest(self) -> tuple[int, int, int | None] | None:
        """(version, last_id, batch_id) of the newest committed version."""
        head = self._head()
        return (head["version"], head["last_id"], head["batch_id"]) if head else None

    def exists(self) -> bool:
        return bool(self.versions())

    def _state(self, commit: dict) -> MappingState:
        self.buckets = commit["buckets"] or None  # the layout is a property of the stored data
        meta = {"batch_id": commit["batch_id"], "root": self.root}
        tables = {a: self._table(commit["tables"][a]) for a in ATTRIBUTES}
        return MappingState(tables, commit["last_id"], commit["version"], meta, dict(commit["sizes"]), self._index(commit["index"]))

    def load(self, version: int | None = None) -> MappingState:
        commit = self._head(version)
        if commit is None:
            raise FileNotFoundError(f"version {version if version is not None else '(latest)'} not committed under {self.root}")
        return self._state(commit)

    def _empty(self, version: int, last_id: int) -> dict:
        return {
            "version": version, "last_id": last_id, "batch_id": None, "buckets": self.buckets, "sizes": {a: 0 for a in ATTRIBUTES},
            "tables": {a: [] for a in ATTRIBUTES}, "index": [], "arrivals": [],
        }

    def create(self, reset: bool = False) -> MappingState:
        """An empty first version; ``reset`` starts a new empty version."""
        head = self._head()
        if head is not None and not reset:
            return self._state(head)
        if head is not None:
            self.buckets = head["buckets"] or None
        # ids are never reused, so a reset keeps the high-water mark
        commit = self._empty(0, 0) if head is None else self._empty(head["version"] + 1, head["last_id"])
        try:
            self._commit(commit)
        except CommitConflict:
            return self.create(reset)
        return self._state(commit)

    def folded(self, arrivals: DataFrame, stream: str | None = None) -> DataFrame:
        """Those of ``arrivals`` (a column ``arrival``) that the newest version has folded."""
        head = self._head() or self._empty(0, 0)
        known = self._ledger(head["arrivals"]).where(F.col("stream") == (stream or "")).select("arrival")
        return arrivals.join(known, "arrival", "left_semi")

    def update(
        self, batch: DataFrame, batch_id: int | None = None, trace: dict | None = None, stream: str | None = None, arrivals: DataFrame | None = None
    ) -> MappingState:
        """Fold a normalised batch into the newest version and commit the result.

        ``(stream, arrival)`` identifies what is folded: ``arrivals`` lists the arrivals
        (files, say) that the batch consists of; without it the batch is the arrival
        ``batch=<batch_id>``.  A batch whose arrivals the stream has all folded before is
        skipped (at-least-once replay), in whatever order they come.  If another update commits
        meanwhile, the batch is folded again into what that one made."""
        if arrivals is None and batch_id is not None:
            arrivals = self.spark.createDataFrame([(f"batch={batch_id}",)], "arrival string")

        def change(base: MappingState, sink: _Attempt) -> MappingState | None:
            if arrivals is not None:
                if arrivals.join(self.folded(arrivals, stream), "arrival", "left_anti").isEmpty():
                    return None
                name = f"data/{sink.id}/arrivals"
                arrivals.select(F.lit(stream or "").alias("stream"), "arrival").distinct().write.parquet(f"{self.root}/{name}")
                sink.arrivals.append(name)
            if trace is not None:
                trace.clear()
            return update_mappings(base, batch, sink=sink, trace=trace)

        return self._change(change, batch_id, keep_scratch=trace is not None)

    def seed(self, seeds: dict[str, DataFrame]) -> MappingState:
        """Insert into the stored tables the seeds whose value is absent (one row per value: the
        newest, by datetime, source and ids); stored rows stay untouched."""

        def change(base: MappingState, sink: _Attempt) -> MappingState:
            sizes, last_id = dict(base.sizes), base.last_id
            for attr, rows in seeds.items():
                new = insert_if_absent(empty_mapping(self.spark), rows).drop("created").join(sized(base.tables[attr].select("value"), base.size(attr) > LARGE_BATCH), "value", "left_anti")
                stored = self._write(f"data/{sink.id}/{attr}", new.withColumn("old_prev", F.lit(None).cast("long")), LAYER_DDL, "value")
                n, top = stored.agg(F.count("*"), F.max(F.greatest("match_id", "prev_match_id"))).first()
                if n:
                    sink.tables[attr].append([f"data/{sink.id}/{attr}", n])
                    sink.written[attr] = stored
                    sizes[attr], last_id = sizes[attr] + n, max(last_id, top)
            return MappingState(base.tables, last_id, sizes=sizes)

        return self._change(change, None)

    def _change(self, change, batch_id: int | None, keep_scratch: bool = False) -> MappingState:
        for _ in range(self.attempts):
            base = self._head() or None
            if base is None:
                self.create()
                base = self._head()
            state, sink = self._state(base), _Attempt(self, base)
            with scratch(self.spark, keep=keep_scratch):
                new = change(state, sink)
                if new is None:
                    return state
                sink.write_index()
                sink.fold_layers()
                commit = {
                    "version": base["version"] + 1, "last_id": new.last_id, "batch_id": batch_id, "buckets": self.buckets, "sizes": new.sizes,
                    "tables": sink.tables, "index": sink.index, "arrivals": sink.arrivals,
                }
                try:
                    self._commit(commit)
                except CommitConflict:
                    continue
            return self._state(commit)
        raise CommitConflict(f"{self.attempts} updates committed first under {self.root}")

    def sweep(self, keep: int = 10, grace_seconds: float = 24 * 3600) -> int:
        """Drop versions older than the newest ``keep`` and every layer (with its catalog table) that no
        kept version points to.  Folders younger than ``grace_seconds`` stay: an update may be
        writing them.  Returns the number of layer folders removed."""
        fs, found = self._fs(), self.versions()
        for v in found[:-keep]:
            fs.delete(self._path(f"commits/v{v:08d}.json"), False)
        used = set()
        for v in found[-keep:]:
            c = self._read_commit(v)
            used.update(n for layers in (*c["tables"].values(), c["index"]) for n, _ in layers)
            used.update(c["arrivals"])
        removed, now = 0, time.time() * 1000
        for f in fs.globStatus(self._path("data/*/*")) or []:
            name = "/".join(f.getPath().toString().split("/")[-3:])
            if name not in used and now - f.getModificationTime() >= grace_seconds * 1000:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(name)}")
                fs.delete(f.getPath(), True)
                removed += 1
        return removed
