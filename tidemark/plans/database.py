"""Databases: a manifest per version, tables as immutable Parquet files with row versions."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as Types

from tidemark.errors import ConstraintViolation, SchemaError, StorageError, ValidationError
from tidemark.functions.codec import encode, truncate
from tidemark.operators import constraints
from tidemark.plans.versions import dead_at, visible_at
from tidemark.sources import rows as stored
from tidemark.sources.files import Files
from tidemark.sql import tree as T

ROW_ID, XMIN, XMAX = "_row_id", "_xmin", "_xmax"
HIDDEN = (ROW_ID, XMIN, XMAX)
DEFAULT_OPTIONS = {"defaultmaxshardsize": "20971520", "storagebackend": "text", "textencoding": "utf-8", "numberformat": "invariant"}


def spark_type(column: T.Column) -> Types.DataType:
    plain = {"CHAR": Types.StringType(), "VARCHAR": Types.StringType(), "INT": Types.IntegerType(), "TINYINT": Types.ByteType(), "BIGINT": Types.LongType(), "BIT": Types.BooleanType()}
    return Types.DecimalType(column.width, column.scale) if column.type == "DECIMAL" else plain[column.type]


@dataclass
class Table:
    name: str
    columns: list[T.Column]
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign_keys: list[T.ForeignKey] = field(default_factory=list)
    indexes: list[T.CreateIndex] = field(default_factory=list)
    max_shard_size: int | None = None
    #: Its files, below the database.
    parts: list[str] = field(default_factory=list)
    #: The first version whose rows are all there still; vacuum drops what only older ones see.
    oldest: int = 0
    next_row_id: int = 0
    active: int = 0
    deleted: int = 0
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def keyed(self) -> bool:
        return bool(self.primary_key or self.unique or self.foreign_keys)

    def column(self, name: str) -> T.Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SchemaError(f"Unknown column '{name}' in table '{self.name}'")

    def schema(self) -> Types.StructType:
        hidden = [Types.StructField(h, Types.LongType()) for h in HIDDEN]
        return Types.StructType(hidden + [Types.StructField(c.name, spark_type(c), metadata={"type": c.type, "width": c.width, "scale": c.scale}) for c in self.columns])

    @staticmethod
    def from_json(x: dict) -> Table:
        made = {"columns": T.Column, "foreign_keys": T.ForeignKey}
        out = Table(**{k: [made[k](**y) for y in v] if k in made else v for k, v in x.items() if k != "indexes"})
        out.indexes = [T.CreateIndex(i["name"], i["table"], tuple(i["columns"]), i["unique"]) for i in x["indexes"]]
        return out


class Database:
    """A folder with numbered manifests; the highest number is the current version.

    A change writes new Parquet files and then the next manifest. Readers keep
    the version they opened; a writer that finds its number taken starts over
    with an error, so no change is half seen.
    """

    _locks: dict[str, threading.RLock] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        if not self.files.exists(f"{self.path}/versions"):
            raise StorageError(f"There is no database at {path}", path)
        self.lock = self._locks.setdefault(self.path, threading.RLock())
        self.cached: dict[str, DataFrame] = {}

    @staticmethod
    def create(spark: SparkSession, path: str, name: str, options: dict[str, str] | None = None) -> Database:
        files, path = Files(spark), path.rstrip("/")
        backend = (options or {}).get("storagebackend", "text").lower()
        if backend not in ("text", "binary"):
            raise ValidationError(f"Unknown storage backend '{backend}'")
        if files.exists(f"{path}/versions"):
            raise ValidationError(f"There is a database at {path} already")
        files.make(f"{path}/versions")
        files.create(f"{path}/versions/{0:020d}.json", json.dumps({"name": name, "version": 0, "options": DEFAULT_OPTIONS | (options or {}), "tables": {}}))
        return Database(spark, path)

    # Manifests

    def manifest(self, version: int | None = None) -> dict:
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        name = names[-1] if version is None else f"{version:020d}.json"
        if name not in names:
            raise StorageError(f"The database has no version {version}", self.path)
        return json.loads(self.files.read(f"{self.path}/versions/{name}"))

    def views(self) -> dict[str, str]:
        return self.manifest().get("views", {})

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def tables(self, version: int | None = None) -> dict[str, Table]:
        return {k: Table.from_json(v) for k, v in self.manifest(version)["tables"].items()}

    def table(self, name: str, version: int | None = None) -> Table:
        found = self.tables(version).get(name.lower())
        if found is None:
            raise SchemaError(f"Unknown table '{name}'")
        return found

    def _publish(self, version: int, *changed: Table, views: dict[str, str] | None = None) -> None:
        new = self.manifest()
        if new["version"] != version - 1:
            raise StorageError("Another writer has changed the database")
        new["version"] = version
        new["tables"] |= {t.name.lower(): asdict(t) for t in changed}
        if views is not None:
            new["views"] = views
        if not self.files.create(f"{self.path}/versions/{version:020d}.json", json.dumps(new)):
            raise StorageError("Another writer has changed the database")
        for t in changed:
            if (old := self.cached.pop(t.name.lower(), None)) is not None:
                old.unpersist()

    # Reading

    def versions(self, table: Table) -> DataFrame:
        """All row versions of a table, with the hidden columns."""
        return self._read_parts(table, table.parts)

    def _read_parts(self, table: Table, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*[f"{self.path}/{p}" for p in parts])

    def rows(self, name: str, snapshot: int | None = None, hidden: bool = False) -> DataFrame:
        """The rows of a table that a snapshot sees, by default the current one.

        A snapshot is read through its own manifest, so with the files and the
        columns of then; one that vacuum has taken rows from is an error.
        """
        if snapshot is None and not hidden and name.lower() in self.cached:
            return self.cached[name.lower()]
        table = self.table(name, snapshot)
        if snapshot is not None and snapshot < (oldest := self.table(name).oldest):
            raise StorageError(f"Version {snapshot} of '{name}' has expired: it was vacuumed at version {oldest}", self.path)
        seen = self.versions(table).where((F.col(XMAX) == 0) if snapshot is None else visible_at(snapshot, XMIN, XMAX))
        return seen if hidden else seen.drop(*HIDDEN)

    def by_row_id(self, name: str, ids: list[int]) -> DataFrame:
        """Rows with these ids; the ids reach the scan, where the files' statistics rule out those without any."""
        return self.rows(name, hidden=True).where(F.col(ROW_ID).isin(*ids)).drop(*HIDDEN)

    def export(self, name: str, target: str) -> None:
        """All row versions in the stored format of the backend."""
        table = self.table(name)
        rows = self.versions(table).withColumnRenamed(XMIN, "_xmin").withColumn("_active", F.col(XMAX) == 0)
        rows = rows.withColumns({c.name: F.col(f"`{c.name}`").cast("int").cast("string") for c in table.columns if c.type == "BIT"})
        if self._backend() == "binary":
            stored.write_binary(rows, target, table.columns, versions=True)
        else:
            stored.write_text_rows(rows, target, table.columns)

    def import_rows(self, name: str, source: str) -> tuple[int, list[str]]:
        """Append the active rows of files in the stored format of the backend; they get row ids and versions of their own."""
        table = self.table(name)
        rows = stored.read_binary(self.spark, source, table.columns, versions=True) if self._backend() == "binary" else stored.read_text_rows(self.spark, source, table.columns)
        return self.append(name, rows.where("_active").select([F.col(f"`{c.name}`") for c in table.columns]))

    def _backend(self) -> str:
        return self.manifest()["options"]["storagebackend"].lower()

    def cache(self) -> None:
        """Keep all tables in memory, spilling to disk."""
        for name in self.tables():
            self.cached[name] = self.rows(name).cache()

    def describe(self) -> DataFrame:
        """A row per column: table, column, type, active, deleted."""
        rows = [(t.name, c.name, c.type + (f"({c.width},{c.scale})" if c.type == "DECIMAL" else f"({c.width})" if c.width else ""), t.active, t.deleted) for t in self.tables().values() for c in t.columns]
        return self.spark.createDataFrame(rows, "table string, column string, type string, active long, deleted long")

    # Schema

    def create_table(self, s: T.CreateTable) -> None:
        with self.lock:
            tables = self.tables()
            if s.name.lower() in tables:
                raise SchemaError(f"Table '{s.name}' exists already")
            if not s.columns:
                raise ValidationError("A table needs a column")
            table = Table(s.name, list(s.columns), list(s.primary_key), [list(u) for u in s.unique], list(s.foreign_keys), max_shard_size=s.max_shard_size)
            seen = [c.name.lower() for c in s.columns]
            if len(set(seen)) < len(seen) or set(seen) & set(HIDDEN):
                raise SchemaError(f"Table '{s.name}' has two columns of one name, or a name that is taken")
            for name in [*s.primary_key, *(n for u in s.unique for n in u), *(f.column for f in s.foreign_keys)]:
                table.column(name)
            for f in s.foreign_keys:
                parent = table if f.table.lower() == s.name.lower() else tables.get(f.table.lower())
                if parent is None:
                    raise SchemaError(f"Foreign key refers to unknown table '{f.table}'")
                parent.column(f.referenced)
            self._publish(self.version + 1, table)

    def create_view(self, name: str, text: str) -> None:
        with self.lock:
            if name.lower() in self.tables() or name.lower() in self.views():
                raise SchemaError(f"There is a table or view '{name}' already")
            self._publish(self.version + 1, views=self.views() | {name.lower(): text})

    def drop_view(self, name: str) -> None:
        with self.lock:
            views = self.views()
            if name.lower() not in views:
                raise SchemaError(f"Unknown view '{name}'")
            self._publish(self.version + 1, views={k: v for k, v in views.items() if k != name.lower()})

    def alter(self, s: T.AlterTable) -> None:
        """Add a column (null in the rows there are), drop one, or rename one, which rewrites the files."""
        with self.lock:
            table = self.table(s.table)
            have = {c.name.lower() for c in table.columns} | set(HIDDEN)
            new = s.column.name if s.kind == "add" else s.to
            if new and new.lower() in have:
                raise SchemaError(f"Table '{table.name}' has a column '{new}' already")
            if s.kind == "add":
                old, table.columns = self.versions(table).withColumn(new, F.lit(None).cast(spark_type(s.column))), [*table.columns, s.column]
            else:
                gone = table.column(s.column)
                keyed = {n.lower() for names in (table.primary_key, *table.unique, [f.column for f in table.foreign_keys], *(i.columns for i in table.indexes)) for n in names}
                if gone.name.lower() in keyed | self._referenced(table):
                    raise ValidationError(f"'{table.name}.{gone.name}' belongs to a key or an index")
                if s.kind == "drop" and len(table.columns) == 1:
                    raise ValidationError("A table needs a column")
                old = self.versions(table)
                old = old.drop(gone.name) if s.kind == "drop" else old.withColumnRenamed(gone.name, s.to)
                table.columns = [replace(c, name=s.to) if c is gone else c for c in table.columns if s.kind == "rename" or c is not gone]
            # A new column's old values, or a dropped one's, must not come back under a name that is used again.
            table.parts = self._write(table, old) if table.parts else []
            self._publish(self.version + 1, table)

    def create_index(self, s: T.CreateIndex) -> None:
        """Record an index; rebalancing sorts the files by its columns, so that their statistics prune."""
        with self.lock:
            table = self.table(s.table)
            if not table.keyed:
                raise ValidationError(f"Table '{s.table}' needs a key or a unique column to be indexed")
            if any(i.name.lower() == s.name.lower() for i in table.indexes):
                raise SchemaError(f"Index '{s.name}' exists already")
            for name in s.columns:
                table.column(name)
            if s.unique:
                self._require_unique(self.rows(s.table), list(s.columns), f"Duplicate key in unique index '{s.name}'")
                table.unique.append(list(s.columns))
            table.indexes.append(s)
            self._publish(self.version + 1, table)

    # Values

    def _converted(self, table: Table, values: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
        """Text columns as the table's types; texts too long are cut, other values that don't fit are errors."""
        out, bad, cut = [], [], []
        for name in names:
            column, raw = table.column(name), F.col(f"`{name}`")
            if column.type in ("CHAR", "VARCHAR"):
                fitted = truncate(raw, column.width)
                out.append(fitted.alias(column.name))
                cut.append(F.max(F.when(fitted != raw, F.struct(F.length(encode(raw)).alias("a"), F.length(encode(fitted)).alias("b")))).alias(f"cut_{column.name}"))
                continue
            text = F.when(raw == "", None).otherwise(raw)
            value = F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False) if column.type == "BIT" else text.try_cast(spark_type(column))
            out.append(value.alias(column.name))
            bad.append(F.max(F.when(text.isNotNull() & value.isNull(), text)).alias(f"bad_{column.name}"))
        rest = [F.col(f"`{c}`") for c in values.columns if c not in names]
        warnings = []
        if found := values.agg(*bad, *cut, F.count("*").alias("rows")).first():
            for name, value in found.asDict().items():
                if value is not None and name.startswith("bad_"):
                    raise ValidationError(f"'{value}' doesn't fit column '{table.name}.{name[4:]}'")
                if value is not None and name.startswith("cut_"):
                    warnings.append(f"Truncated column '{table.name}.{name[4:]}' from {value['a']} to {value['b']} characters.")
        return values.select(*rest, *out), warnings

    @staticmethod
    def _require_unique(rows: DataFrame, key: list[str], message: str) -> None:
        if found := constraints.repeated_keys(rows.dropna(how="all", subset=key), key).limit(1).collect():
            raise ConstraintViolation(f"{message}: {', '.join(str(found[0][k]) for k in key)}")

    def _check(self, table: Table, new: DataFrame, others: DataFrame, touched: set[str] | None = None) -> None:
        """Constraints of a table to whose visible rows ``others`` the rows ``new`` come; touched: only those on these columns.

        New keys are compared among themselves, and then looked up in the others:
        the work on the table is one scan of its key columns, without a shuffle of it
        where the new keys are few enough to send around.
        """
        touches = lambda names: touched is None or bool(touched & {n.lower() for n in names})
        keys = [(table.primary_key, f"Duplicate primary key in '{table.name}'")] if table.primary_key else []
        for key, message in [*keys, *((u, f"Duplicate unique value in '{table.name}'") for u in table.unique)]:
            if touches(key):
                self._require_unique(new, key, message)
                if found := constraints.taken(new, others, key).limit(1).collect():
                    raise ConstraintViolation(f"{message}: {', '.join(str(found[0][k]) for k in key)}")
        for f in table.foreign_keys:
            if touches([f.column]):
                own = f.table.lower() == table.name.lower()
                parent = new.unionByName(others) if own else self.rows(f.table)
                lost = constraints.orphans(new, parent, f.column, f.referenced).limit(1).collect()
                if lost:
                    raise ConstraintViolation(f"Foreign key '{table.name}.{f.column}' has no '{f.table}' row: {lost[0][f.column]}")

    def _check_children(self, table: Table, going: DataFrame, staying: DataFrame) -> None:
        """No child row may refer to a key that goes and isn't there any more."""
        for child in self.tables().values():
            for f in child.foreign_keys:
                if f.table.lower() != table.name.lower():
                    continue
                rows = staying if child.name.lower() == table.name.lower() else self.rows(child.name)
                gone = constraints.lacking(going, staying, f.referenced)
                if found := constraints.still_referenced(gone, rows, f.referenced, f.column).limit(1).collect():
                    raise ConstraintViolation(f"Cannot delete from '{table.name}': '{child.name}' refers to {found[0][f.referenced]}")

    # Changes

    def _shard_rows(self, table: Table) -> int:
        """How many rows a file of the table's shard size holds, by the widths of its columns."""
        size = table.max_shard_size or int(self.manifest()["options"]["defaultmaxshardsize"])
        return max(1, size // (sum(c.width or 8 for c in table.columns) + 24))

    def _order(self, table: Table) -> list[Column]:
        """What files are sorted by: the first index, else the primary key, else the row id."""
        names = list(table.indexes[0].columns) if table.indexes else table.primary_key or [ROW_ID]
        return [F.col(f"`{n}`") for n in names]

    def _write(self, table: Table, rows: DataFrame) -> list[str]:
        """New files, none beyond the shard size: their names."""
        folder = f"data/{table.name.lower()}/{uuid.uuid4().hex}"
        fields = [F.col(f"`{f.name}`").alias(f.name) for f in table.schema()]
        rows.select(fields).write.option("maxRecordsPerFile", self._shard_rows(table)).parquet(f"{self.path}/{folder}")
        return [f"{folder}/{n}" for n in self.files.names(f"{self.path}/{folder}") if n.endswith(".parquet")]

    def insert(self, s: T.Insert) -> tuple[int, list[str]]:
        """Rows of literals; columns left out, and values missing at the end of a row, are null."""
        names = [self.table(s.table).column(n).name for n in s.columns]
        if len(set(names)) < len(names):
            raise ValidationError("A column is named twice")
        padded = [tuple((list(r) + [None] * len(names))[: len(names)]) for r in s.rows]
        values = self.spark.createDataFrame(padded, Types.StructType([Types.StructField(n, Types.StringType()) for n in names]))
        return self.append(s.table, values)

    def append(self, name: str, values: DataFrame, stamp: tuple[str, int] | None = None) -> tuple[int, list[str]]:
        """Rows of a DataFrame, whose columns are converted as texts are; any size.

        A stamp is a stream and the number of its batch; one that isn't beyond
        the stream's last number has been appended before.
        """
        with self.lock:
            table = self.table(name)
            if stamp and stamp[1] <= table.streams.get(stamp[0], -1):
                return 0, []
            version = self.version + 1
            texts = values.select([F.col(f"`{c}`").cast("string").alias(table.column(c).name) for c in values.columns])
            # Written once, then checked and numbered as written, as the input may not give the same rows again.
            staging = f"{self.path}/data/{table.name.lower()}/staging-{uuid.uuid4().hex}"
            try:
                typed, warnings = self._converted(table, staged(texts, staging), texts.columns)
                for c in table.columns:
                    if c.name not in typed.columns:
                        typed = typed.withColumn(c.name, F.lit(None).cast(spark_type(c)))
                stamped = numbered(typed, table.next_row_id).withColumns({XMIN: F.lit(version).cast("long"), XMAX: F.lit(0).cast("long")})
                parts = self._write(table, stamped)
            finally:
                self.files.delete(staging)
            added = self._read_parts(table, parts)
            try:
                if table.keyed:
                    self._check(table, added, self.rows(name, hidden=True))
            except ConstraintViolation:
                self._forget(parts)
                raise
            n = added.count()
            table.parts += parts
            table.next_row_id, table.active = table.next_row_id + n, table.active + n
            table.streams |= dict([stamp]) if stamp else {}
            self._publish(version, table)
            return n, warnings

    def _forget(self, parts: list[str]) -> None:
        for folder in {p.rsplit("/", 1)[0] for p in parts}:
            self.files.delete(f"{self.path}/{folder}")

    def _hit(self, table: Table, where: tuple, matches) -> tuple[Column, list[str], int]:
        """The condition for live matching rows, the files that hold any, and how many rows; the driver gets a row per file."""
        old = self.versions(table)
        hit = (F.col(XMAX) == 0) & matches(table, where, old) if where else F.col(XMAX) == 0
        if not table.parts:
            return hit, [], 0
        found = old.where(hit).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()
        tail = {"/".join(p.split("/")[-2:]): p for p in table.parts}
        return hit, [tail["/".join(r["file"].split("/")[-2:])] for r in found], sum(r["n"] for r in found)

    def update(self, s: T.Update, matches) -> tuple[int, list[str]]:
        """Close the matching row versions and add new ones; checked before anything is published. Only files with a match are rewritten."""
        with self.lock:
            table = self.table(s.table)
            version = self.version + 1
            names = [table.column(c).name for c, _ in s.changes]
            literals = self.spark.createDataFrame([tuple(v for _, v in s.changes)], Types.StructType([Types.StructField(n, Types.StringType()) for n in names]))
            typed, warnings = self._converted(table, literals, names)
            new = typed.first()
            hit, files, n = self._hit(table, s.where, matches)
            if not n:
                return 0, warnings
            old = self._read_parts(table, files)
            changed = old.where(hit).withColumns({n: F.lit(new[n]).cast(spark_type(table.column(n))) for n in names}).withColumns({XMIN: F.lit(version).cast("long"), XMAX: F.lit(0).cast("long")})
            closed = old.withColumn(XMAX, F.when(hit, F.lit(version)).otherwise(F.col(XMAX)).cast("long"))
            touched, staying = {x.lower() for x in names}, self.versions(table).where((F.col(XMAX) == 0) & ~hit)
            self._check(table, changed, staying, touched)
            if touched & self._referenced(table):
                self._check_children(table, old.where(hit), staying.unionByName(changed))
            table.parts = [p for p in table.parts if p not in set(files)] + self._write(table, closed.unionByName(changed))
            table.deleted += n
            self._publish(version, table)
            return n, warnings

    def _referenced(self, table: Table) -> set[str]:
        return {f.referenced.lower() for t in self.tables().values() for f in t.foreign_keys if f.table.lower() == table.name.lower()}

    def delete(self, s: T.Delete, matches) -> int:
        """Close the matching row versions, in the files that hold any; they stay for older snapshots until vacuum."""
        with self.lock:
            table = self.table(s.table)
            version = self.version + 1
            hit, files, n = self._hit(table, s.where, matches)
            if not n:
                return 0
            old = self._read_parts(table, files)
            self._check_children(table, old.where(hit), self.versions(table).where((F.col(XMAX) == 0) & ~hit))
            kept = [p for p in table.parts if p not in set(files)]
            table.parts = kept + self._write(table, old.withColumn(XMAX, F.when(hit, F.lit(version)).otherwise(F.col(XMAX)).cast("long")))
            table.active, table.deleted = table.active - n, table.deleted + n
            self._publish(version, table)
            return n

    def vacuum(self, name: str) -> int:
        """Drop row versions that no later snapshot sees, and files that the new version doesn't name; returns how many rows.

        Older snapshots of the table expire: reading them is an error from now on.
        """
        with self.lock:
            table = self.table(name)
            version = self.version + 1
            dead = dead_at(version - 1, XMAX)
            _, files, n = self._hit_dead(table, dead)
            kept = [p for p in table.parts if p not in set(files)]
            if n:
                table.parts = kept + self._write(table, self._read_parts(table, files).where(~dead))
                table.deleted = max(0, table.deleted - n)
            table.oldest = version
            self._publish(version, table)
            used = {p.split("/")[2] for p in table.parts}
            root = f"{self.path}/data/{name.lower()}"
            for folder in self.files.names(root):
                if folder not in used:
                    self.files.delete(f"{root}/{folder}")
                else:
                    for file in self.files.names(f"{root}/{folder}"):
                        if file.endswith(".parquet") and f"data/{name.lower()}/{folder}/{file}" not in table.parts:
                            self.files.delete(f"{root}/{folder}/{file}")
            return n

    def _hit_dead(self, table: Table, dead: Column) -> tuple[Column, list[str], int]:
        if not table.parts:
            return dead, [], 0
        found = self.versions(table).where(dead).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()
        tail = {"/".join(p.split("/")[-2:]): p for p in table.parts}
        return dead, [tail["/".join(r["file"].split("/")[-2:])] for r in found], sum(r["n"] for r in found)

    def rebalance(self, name: str) -> int:
        """Rewrite a table into files near its shard size, each a range of its first index or key; returns the active rows.

        Lookups by those columns then read the files whose statistics allow a match.
        """
        with self.lock:
            table = self.table(name)
            if not table.parts:
                return 0
            shards = max(1, -(-(table.active + table.deleted) // self._shard_rows(table)))
            order = self._order(table)
            table.parts = self._write(table, self.versions(table).repartitionByRange(shards, *order).sortWithinPartitions(*order))
            self._publish(self.version + 1, table)
            return table.active


def staged(rows: DataFrame, path: str) -> DataFrame:
    """rows written and read back, with the partition and the place in it of each."""
    schema = Types.StructType([*rows.schema.fields, Types.StructField("_part", Types.IntegerType()), Types.StructField("_place", Types.LongType())])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.withColumns({"_part": F.spark_partition_id(), "_place": place}).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def numbered(rows: DataFrame, base: int) -> DataFrame:
    """Dense row ids from base on: the place within a written partition, after the counts of those before."""
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(ROW_ID, F.col("_before") + F.col("_place") + base).drop("_part", "_place", "_before")
