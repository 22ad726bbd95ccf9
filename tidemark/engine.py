"""The engine: statements, queries and scripts against databases."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.errors import EngineError, ValidationError
from tidemark.plans.database import Database, Table
from tidemark.plans.scratch import Scratch
from tidemark.plans.tables import read_table
from tidemark.sql import tree as T
from tidemark.sql.parser import parse
from tidemark.sql.planner import TYPED, Planner, Profile
from tidemark.sql.script import statements

# The sample database: schema and rows are fixed values.
SAMPLE = r"""
CREATE TABLE User (Id CHAR(10) PRIMARY KEY, Username CHAR(50), Email CHAR(100), CreatedAt CHAR(24));
CREATE TABLE Page (Id CHAR(10) PRIMARY KEY, Title CHAR(200), Slug CHAR(200), CreatedById CHAR(10), CreatedAt CHAR(24), UpdatedAt CHAR(24), FOREIGN KEY (CreatedById) REFERENCES User(Id));
CREATE TABLE PageContent (Id CHAR(10) PRIMARY KEY, PageId CHAR(10), Content VARCHAR(5000), Version INT, CreatedById CHAR(10), CreatedAt CHAR(24), FOREIGN KEY (PageId) REFERENCES Page(Id), FOREIGN KEY (CreatedById) REFERENCES User(Id));
CREATE TABLE Image (Id CHAR(10) PRIMARY KEY, Filename CHAR(255), MimeType CHAR(50), UploadedById CHAR(10), CreatedAt CHAR(24), FOREIGN KEY (UploadedById) REFERENCES User(Id));
CREATE TABLE PageImage (Id CHAR(10) PRIMARY KEY, PageId CHAR(10), ImageId CHAR(10), Caption CHAR(200), FOREIGN KEY (PageId) REFERENCES Page(Id), FOREIGN KEY (ImageId) REFERENCES Image(Id));
CREATE INDEX IX_User_Username ON User(Username);
CREATE INDEX IX_Page_Slug ON Page(Slug);
CREATE INDEX IX_Page_CreatedById ON Page(CreatedById);
CREATE INDEX IX_PageContent_PageId ON PageContent(PageId);
CREATE INDEX IX_Image_UploadedById ON Image(UploadedById);
CREATE INDEX IX_PageImage_PageId ON PageImage(PageId);
CREATE INDEX IX_PageImage_ImageId ON PageImage(ImageId);
INSERT INTO User (Id, Username, Email, CreatedAt) VALUES ('1', 'admin', 'admin@wiki.local', '2026-03-17T12:00:00Z'), ('2', 'editor', 'editor@wiki.local', '2026-03-17T12:01:00Z');
INSERT INTO Page (Id, Title, Slug, CreatedById, CreatedAt, UpdatedAt) VALUES ('1', 'Home', 'home', '1', '2026-03-17T12:00:00Z', '2026-03-17T12:00:00Z'), ('2', 'About', 'about', '1', '2026-03-17T12:05:00Z', '2026-03-17T12:05:00Z');
INSERT INTO PageContent (Id, PageId, Content, Version, CreatedById, CreatedAt) VALUES ('1', '1', 'Welcome.\n\nThis is the home page.', 1, '1', '2026-03-17T12:00:00Z'), ('2', '2', 'About this wiki.', 1, '1', '2026-03-17T12:05:00Z');
"""


@dataclass
class Result:
    """What a statement did: rows changed, the rows it returns, warnings."""

    affected: int = 0
    rows: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


@dataclass
class ScriptResult:
    executed: int = 0
    warnings: list[str] = field(default_factory=list)
    results: list[DataFrame] = field(default_factory=list)


class Engine:
    """Runs statements against the database at a path, one version at a time."""

    def __init__(self, spark: SparkSession, profile: Profile = TYPED):
        self.spark, self.profile = spark, profile
        self.open_: dict[str, Database] = {}
        self.scratch: Scratch | None = None

    def open(self, path: str) -> Database:
        path = path.rstrip("/")
        if path not in self.open_:
            self.open_[path] = Database(self.spark, path)
        return self.open_[path]

    def execute(self, sql: str, path: str, snapshot: int | None = None) -> Result:
        """Any statement. CREATE DATABASE makes a database of that name below path."""
        return self._run(parse(sql), path, snapshot)

    def query(self, sql: str, path: str, snapshot: int | None = None) -> DataFrame:
        """The rows of a SELECT, as of a version of the database if one is given."""
        s = parse(sql)
        if not isinstance(s, T.Query):
            raise ValidationError("Only SELECT returns rows")
        return self._run(s, path, snapshot).rows

    def query_tables(self, sql: str, folder: str) -> DataFrame:
        """The rows of a SELECT over the Parquet tables of a folder."""
        s = parse(sql)
        if not isinstance(s, T.Query):
            raise ValidationError("Only SELECT returns rows")
        return self._planner(lambda name: read_table(self.spark, folder, name.lower())).plan(s)

    def _planner(self, load) -> Planner:
        def keep(df: DataFrame) -> DataFrame:
            if self.scratch is None:
                self.scratch = Scratch(self.spark, "query")
            return self.scratch.table(df, "round")

        return Planner(load, self.profile, keep)

    def _load(self, db: Database, snapshot: int | None):
        """Tables and views of a database by name."""

        def load(name: str) -> DataFrame:
            view = db.views().get(name.lower())
            return self._planner(load).plan(parse(view)) if view else db.rows(name, snapshot)

        return load

    def _run(self, s: T.Statement, path: str, snapshot: int | None = None) -> Result:
        if isinstance(s, T.CreateDatabase):
            made = f"{path.rstrip('/')}/{s.name}"
            self.open_[made] = Database.create(self.spark, made, s.name, s.options)
            return Result()
        db = self.open(path)
        if isinstance(s, T.Query):
            # Files are immutable and the version is read once, so NOLOCK has nothing to skip.
            return Result(rows=self._planner(self._load(db, snapshot)).plan(s))
        if isinstance(s, T.CreateView):
            self._planner(self._load(db, None)).plan(s.query)  # a query that can't be planned is no view
            db.create_view(s.name, s.text)
            return Result()
        if isinstance(s, T.DropView):
            db.drop_view(s.name)
            return Result()
        if isinstance(s, T.AlterTable):
            db.alter(s)
            return Result()
        if isinstance(s, T.CreateTable):
            db.create_table(s)
            return Result()
        if isinstance(s, T.CreateIndex):
            db.create_index(s)
            return Result()
        if isinstance(s, T.Insert):
            return Result(*self._pair(db.insert(s)))
        if isinstance(s, T.Update):
            return Result(*self._pair(db.update(s, self._matches)))
        return Result(db.delete(s, self._matches))

    @staticmethod
    def _pair(found: tuple[int, list[str]]):
        return found[0], None, found[1]

    def _matches(self, table: Table, where: tuple, rows: DataFrame) -> Column:
        visible = rows.select([F.col(f"`{c.name}`") for c in table.columns])
        return Planner(lambda name: visible, self.profile).condition(where, visible, table.name)

    def script(self, text: str, path: str) -> ScriptResult:
        """Statements in order; the first error ends the script, and what ran before stays."""
        out = ScriptResult()
        for sql in statements(text):
            s = parse(sql)
            result = self._run(s, path)
            if isinstance(s, T.CreateDatabase):
                path = f"{path.rstrip('/')}/{s.name}"
            out.executed += 1
            out.warnings += result.warnings
            if result.rows is not None:
                out.results.append(result.rows)
        return out

    def build_sample(self, path: str, name: str = "WikiDb") -> ScriptResult:
        """A small wiki: five tables, seven indexes, two users, pages and contents."""
        return self.script(f"CREATE DATABASE {name};\n{SAMPLE}", path)

    def load_into_memory(self, path: str) -> Database:
        """Keep the tables of a database cached; changes still go to its files."""
        db = self.open(path)
        db.cache()
        return db

    def rebalance(self, path: str, table: str) -> int:
        return self.open(path).rebalance(table)

    def rows_by_id(self, path: str, table: str, ids: list[int]) -> DataFrame:
        """The current rows with these row ids; files whose range of ids holds none are passed over."""
        return self.open(path).by_row_id(table, ids)

    def export(self, path: str, table: str, target: str) -> None:
        """Write a table's rows in the stored format of the database's backend (text or binary)."""
        self.open(path).export(table, target)

    def import_rows(self, path: str, table: str, source: str) -> tuple[int, list[str]]:
        """Append rows of files in the stored format of the database's backend."""
        return self.open(path).import_rows(table, source)

    def vacuum(self, path: str, table: str) -> int:
        return self.open(path).vacuum(table)

    def inspect(self, path: str) -> DataFrame:
        return self.open(path).describe()


__all__ = ["Engine", "EngineError", "Result", "ScriptResult"]
