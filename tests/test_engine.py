import pytest

from tidemark import cli
from tidemark.engine import Engine
from tidemark.errors import ConstraintViolation, SchemaError, StorageError, ValidationError
from tidemark.sql.planner import COMPAT


@pytest.fixture()
def db(spark, tmp_path):
    engine = Engine(spark)
    engine.execute("CREATE DATABASE D", str(tmp_path))
    return engine, f"{tmp_path}/D"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_crud_snapshots_and_vacuum(db):
    engine, path = db
    engine.script("CREATE TABLE Product (Id CHAR(5), Name CHAR(20), Price INT); INSERT INTO Product (Id, Name, Price) VALUES ('1', 'A', 10), ('2', 'B', 20)", path)
    before = engine.open(path).version
    assert engine.execute("UPDATE Product SET Price = 149 WHERE Id = '2'", path).affected == 1
    assert engine.execute("DELETE FROM Product WHERE Id = '1'", path).affected == 1
    assert rows(engine.query("SELECT * FROM Product", path)) == [("2", "B", 149)]
    assert rows(engine.query("SELECT Id, Price FROM Product", path, before)) == [("1", 10), ("2", 20)]
    assert engine.vacuum(path, "Product") == 2 and engine.rebalance(path, "Product") == 1
    assert rows(engine.query("SELECT Id FROM Product", path)) == [("2",)]
    assert engine.inspect(path).where("active = 1 and deleted = 0").count() == 3


def test_constraints_leave_data_unchanged(db):
    engine, path = db
    engine.script("CREATE TABLE U (Id CHAR(5) PRIMARY KEY, Email CHAR(20) UNIQUE); CREATE TABLE P (Id CHAR(5) PRIMARY KEY, By CHAR(5), FOREIGN KEY (By) REFERENCES U(Id)); INSERT INTO U (Id, Email) VALUES ('1', 'a'), ('2', 'b'); INSERT INTO P (Id, By) VALUES ('x', '1')".replace(" By ", " Author ").replace("(By)", "(Author)").replace(", By)", ", Author)"), path)
    for sql in (
        "INSERT INTO U (Id, Email) VALUES ('1', 'c')", "INSERT INTO U (Id, Email) VALUES ('3', 'a')", "INSERT INTO U (Id) VALUES ('4'), ('4')", "INSERT INTO P (Id, Author) VALUES ('y', '9')",
        "DELETE FROM U WHERE Id = '1'", "UPDATE U SET Id = '2' WHERE Id = '1'", "UPDATE U SET Id = '7' WHERE Id = '1'", "UPDATE P SET Author = '9'",
    ):
        with pytest.raises(ConstraintViolation):
            engine.execute(sql, path)
    assert rows(engine.query("SELECT * FROM U", path)) == [("1", "a"), ("2", "b")]
    assert engine.execute("DELETE FROM U WHERE Id = '2'", path).affected == 1


def test_values_and_schema_errors(db):
    engine, path = db
    engine.script("CREATE TABLE T (Id CHAR(5), N TINYINT, B BIT, D DECIMAL(6,2))", path)
    assert engine.execute("INSERT INTO T (Id, N, B, D) VALUES ('abcdefgh', 5, 1, '9.99'), ('x')", path).warnings == ["Truncated column 'T.Id' from 8 to 5 characters."]
    assert {(r.Id, r.N, r.B, str(r.D)) for r in engine.query("SELECT * FROM T", path).collect()} == {("abcde", 5, True, "9.99"), ("x", None, None, "None")}
    with pytest.raises(ValidationError):
        engine.execute("INSERT INTO T (N) VALUES ('many')", path)
    for sql in ("SELECT Nope FROM T", "SELECT a FROM Nope", "CREATE TABLE T (a INT)", "CREATE TABLE V (a INT, FOREIGN KEY (a) REFERENCES W(b))"):
        with pytest.raises(SchemaError):
            engine.execute(sql, path).rows
    with pytest.raises(ValidationError):
        engine.execute("CREATE INDEX I ON T (Id)", path)
    with pytest.raises(StorageError):
        engine.open(path + "-none")


def test_query_scenarios(db):
    engine, path = db
    engine.script(
        """CREATE TABLE U (Id CHAR(5) PRIMARY KEY, Name CHAR(20)); CREATE TABLE O (Id CHAR(5) PRIMARY KEY, UserId CHAR(5), FOREIGN KEY (UserId) REFERENCES U(Id));
        CREATE TABLE G (Id CHAR(5) PRIMARY KEY, GKey CHAR(5), Amount INT);
        INSERT INTO U (Id, Name) VALUES ('1', 'Alice'), ('2', 'Bob'); INSERT INTO O (Id, UserId) VALUES ('a', '1'), ('b', '1');
        INSERT INTO G (Id, GKey, Amount) VALUES ('1', 'A', 10), ('2', 'A', 20), ('3', 'B', 5)""",
        path,
    )
    q = lambda sql: rows(engine.query(sql, path))
    assert q("SELECT u.Id, o.Id AS OrderId FROM U u INNER JOIN O o ON o.UserId = u.Id") == [("1", "a"), ("1", "b")]
    assert [tuple(r) for r in engine.query("SELECT u.Id, o.Id AS OrderId FROM U u LEFT JOIN O o ON u.Id = o.UserId ORDER BY u.Id DESC, o.Id", path).collect()] == [("2", None), ("1", "a"), ("1", "b")]
    assert q("SELECT * FROM U u INNER JOIN O o ON u.Id = o.UserId WHERE o.Id = 'a'") == [("1", "Alice")]
    assert q("SELECT GKey, COUNT(*) AS Cnt, SUM(Amount) AS S FROM G GROUP BY GKey HAVING COUNT(*) > 1") == [("A", 2, 30)]
    assert q("SELECT Id FROM U WHERE Id IN (SELECT UserId FROM O)") == [("1",)]
    assert q("SELECT Id FROM U u WHERE EXISTS (SELECT 1 FROM O o WHERE o.UserId = u.Id)") == [("1",)]
    assert q("SELECT Id FROM U u WHERE NOT EXISTS (SELECT 1 FROM O o WHERE o.UserId = u.Id)") == [("2",)]
    assert q("SELECT Id, (SELECT COUNT(*) FROM O o WHERE o.UserId = u.Id) AS N FROM U u") == [("1", 2), ("2", 0)]
    assert q("SELECT COUNT(*), MAX(Amount) FROM G") == [(3, 20)]
    with pytest.raises(ValidationError):
        engine.query("SELECT Id, COUNT(*) FROM G", path)


def test_compat_profile(spark, db):
    engine, path = db
    engine.script("CREATE TABLE R (Id CHAR(5) PRIMARY KEY, K CHAR(10), V CHAR(10)); INSERT INTO R (Id, K, V) VALUES ('1', 'b', '10'), ('2', 'B', '9'), ('3', '', 'x'), ('4', '_', '2')", path)
    old = Engine(spark, COMPAT)
    q = lambda sql: [tuple(r) for r in old.query(sql, path).collect()]
    assert sorted(q("SELECT Id FROM R WHERE K = 'B'")) == [("1",), ("2",)]
    assert q("SELECT Id FROM R ORDER BY V")[:3] == [("1",), ("4",), ("2",)]
    assert q("SELECT Id FROM R ORDER BY K, Id")[-1] == ("4",)
    assert {x[0] for x in q("SELECT Nope, Id FROM R")} == {None}
    assert sorted(q("SELECT K, SUM(V) AS S, AVG(V) AS A, MIN(V) AS M FROM R GROUP BY K")) == [("", "0", "0", "0"), ("B", "9", "9", "9"), ("_", "2", "2", "2"), ("b", "10", "10", "10")]
    assert len(q("SELECT COUNT(*) FROM R")) == 4
    assert sorted(q("SELECT Id, (SELECT MAX(V) FROM R x WHERE x.K = y.K) AS M FROM R y")) == [("1", "9"), ("2", "9"), ("3", "x"), ("4", "2")]


def test_snapshots_expire_and_vacuum_deletes_files(db, tmp_path):
    engine, path = db
    engine.script("CREATE TABLE T (K INT PRIMARY KEY, V INT); INSERT INTO T (K, V) VALUES (1, 1), (2, 2), (3, 3)", path)
    before = engine.open(path).version
    engine.execute("DELETE FROM T WHERE K = 2", path)
    assert len(rows(engine.query("SELECT K FROM T", path, before))) == 3
    folders = lambda: {f.parent for f in (tmp_path / "D/data/t").glob("*/*.parquet")}
    assert len(folders()) == 2 and engine.vacuum(path, "T") == 1
    with pytest.raises(StorageError, match="expired"):
        engine.query("SELECT K FROM T", path, before)
    files = {str(f.relative_to(tmp_path / "D")) for f in (tmp_path / "D/data/t").glob("*/*.parquet")}
    assert files == set(engine.open(path).table("T").parts)
    assert rows(engine.query("SELECT K FROM T", path)) == [(1,), (3,)] == rows(engine.query("SELECT K FROM T", path, engine.open(path).version))
    with pytest.raises(StorageError):
        engine.query("SELECT K FROM T", path, 999)


def test_changes_rewrite_only_the_files_they_hit(db, spark):
    engine, path = db
    engine.script("CREATE TABLE T (K BIGINT PRIMARY KEY, V INT, Note CHAR(8)) WITH (maxShardSize=4000)", path)
    db_ = engine.open(path)
    db_.append("T", spark.range(2000).selectExpr("id AS K", "id % 7 AS V"))
    assert len(db_.table("T").parts) >= 10  # no file beyond the shard size
    engine.rebalance(path, "T")
    before = set(db_.table("T").parts)
    assert engine.execute("UPDATE T SET V = 99 WHERE K = 1234", path).affected == 1
    after = set(db_.table("T").parts)
    assert len(before) >= 10 and len(before - after) == 1
    assert rows(engine.query("SELECT V FROM T WHERE K = 1234", path)) == [(99,)] and engine.query("SELECT K FROM T", path).count() == 2000
    # Every file is a range of the key, so a lookup's files can be told by their statistics.
    ranges = sorted((r.lo, r.hi) for r in db_.rows("T", hidden=True).selectExpr("K", "_metadata.file_path AS f").groupBy("f").agg({"K": "min"}).withColumnRenamed("min(K)", "lo").join(db_.rows("T", hidden=True).selectExpr("K AS k2", "_metadata.file_path AS f").groupBy("f").agg({"k2": "max"}).withColumnRenamed("max(k2)", "hi"), "f").collect() if (r.lo, r.hi) != (1234, 1234))
    assert sum(a[1] >= b[0] for a, b in zip(ranges, ranges[1:])) <= 1
    plan = engine.query("SELECT V FROM T WHERE K = 77", path)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(K,77)" in plan
    assert sorted(r.K for r in engine.rows_by_id(path, "T", [0, 5]).collect()) == [0, 5]
    with pytest.raises(ConstraintViolation):
        engine.execute("INSERT INTO T (K) VALUES (5000), (77)", path)
    assert engine.execute("DELETE FROM T WHERE V = 99 OR K BETWEEN 10 AND 12", path).affected == 4


def test_literals_groups_and_having(db):
    engine, path = db
    engine.script("CREATE TABLE A (K INT PRIMARY KEY, V DECIMAL(6,2)); CREATE TABLE B (K INT PRIMARY KEY, W INT); INSERT INTO A (K, V) VALUES (1, '0.10'), (2, '0.20'), (3, NULL); INSERT INTO B (K, W) VALUES (1, 5), (2, -5)", path)
    q = lambda sql: rows(engine.query(sql, path))
    for sql in ("SELECT K FROM A WHERE K = 'x'", "SELECT K FROM A WHERE V > 'much'", "SELECT COUNT(*) FROM A HAVING COUNT(*) > 'x'", "SELECT K FROM A INNER JOIN B ON A.K = B.K GROUP BY K", "SELECT K FROM A WHERE K = 1 OR K IN (SELECT K FROM B)", "SELECT K FROM A HAVING COUNT(*) > 1", "UPDATE A SET V = 1 WHERE K IN (SELECT K FROM B)"):
        with pytest.raises(ValidationError):
            engine.execute(sql, path)
    assert q("SELECT K FROM A WHERE V = '0.1'") == [(1,)] and q("SELECT K FROM A WHERE K = 1.5") == [] and q("SELECT W FROM B WHERE W < -4.5") == [(-5,)]
    assert q("SELECT COUNT(*) FROM A HAVING COUNT(*) > 100") == [] and q("SELECT COUNT(*) FROM A HAVING COUNT(*) >= 3") == [(3,)]
    assert q("SELECT A.K AS x, B.K AS y, COUNT(*) AS n FROM A LEFT JOIN B ON A.K = B.K GROUP BY A.K, B.K HAVING COUNT(*) = 1 ") == sorted([(1, 1, 1), (2, 2, 1), (3, None, 1)], key=repr)
    assert q("SELECT K FROM A WHERE K NOT IN (SELECT W FROM B WHERE W > 100)") == [(1,), (2,), (3,)]
    assert q("SELECT K FROM A WHERE V IS NULL OR NOT V < 0.2") == [(2,), (3,)]
    assert [tuple(r) for r in engine.query("SELECT K AS x FROM A UNION ALL SELECT W FROM B ORDER BY x DESC LIMIT 2 OFFSET 1", path).collect()] == [(3,), (2,)]


def test_views_and_altered_tables(db):
    engine, path = db
    engine.script("CREATE TABLE T (K INT PRIMARY KEY, V CHAR(9), W INT); INSERT INTO T (K, V, W) VALUES (1, 'it''s', 4), (2, 'b', 5); CREATE VIEW Its AS SELECT K, W FROM T WHERE V = 'it''s'", path)
    before = engine.open(path).version
    assert rows(engine.query("SELECT * FROM Its", path)) == [(1, 4)]
    engine.script("ALTER TABLE T DROP COLUMN W; ALTER TABLE T ADD COLUMN W CHAR(3); ALTER TABLE T RENAME COLUMN V TO U; UPDATE T SET W = 'new' WHERE U = 'b'; DROP VIEW Its", path)
    assert sorted(map(tuple, engine.query("SELECT * FROM T", path).collect())) == [(1, "it's", None), (2, "b", "new")]
    assert rows(engine.query("SELECT * FROM T", path, before)) == [(1, "it's", 4), (2, "b", 5)]
    for sql, error in (("ALTER TABLE T DROP COLUMN K", ValidationError), ("ALTER TABLE T ADD U INT", SchemaError), ("SELECT * FROM Its", SchemaError), ("DROP VIEW Its", SchemaError)):
        with pytest.raises(error):
            engine.execute(sql, path)


@pytest.mark.parametrize("backend", ["text", "binary"])
def test_export_and_import_by_backend(spark, tmp_path, backend):
    engine = Engine(spark)
    engine.execute(f"CREATE DATABASE D WITH (storageBackend={backend})", str(tmp_path))
    path = f"{tmp_path}/D"
    engine.script("CREATE TABLE T (K INT PRIMARY KEY, V CHAR(9), B BIT); INSERT INTO T (K, V, B) VALUES (1, 'a b', 1), (2, 'c', 0), (3, 'gone', 0); DELETE FROM T WHERE K = 3; CREATE TABLE C (K INT, V CHAR(9), B BIT)", path)
    engine.export(path, "T", f"{tmp_path}/out")
    engine.import_rows(path, "C", f"{tmp_path}/out")
    got = rows(engine.query("SELECT * FROM C", path))
    assert got == [(1, "a b", True), (2, "c", False)]


def test_sample_cli_and_memory(spark, tmp_path, capsys):
    engine = Engine(spark)
    assert engine.build_sample(str(tmp_path)).executed == 16
    path = f"{tmp_path}/WikiDb"
    engine.load_into_memory(path)
    assert [engine.query(f"SELECT * FROM {t}", path).count() for t in ("User", "Page", "PageContent", "Image")] == [2, 2, 2, 0]
    assert cli.main(["query", "--db", path, "SELECT Slug FROM Page WHERE Slug = 'home'"], spark) == 0 and "home" in capsys.readouterr().out
    codes = [cli.main([c, "--db", path, x], spark) for c, x in (("exec", "SELEC"), ("query", "SELECT x FROM Page"), ("exec", "DELETE FROM User WHERE Id = '1'"), ("query", "DELETE FROM Page"), ("rebalance", "Page"))]
    assert codes == [2, 3, 3, 4, 0] and cli.main(["inspect", "--db", f"{path}x"], spark) == 5 and cli.main(["nope"], spark) == 1
