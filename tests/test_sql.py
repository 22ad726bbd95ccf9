import pytest

from tidemark.errors import ParseError, ValidationError
from tidemark.sql import tree as T
from tidemark.sql.parser import parse
from tidemark.sql.script import batches


def test_select_with_everything():
    s = parse("SELECT u.Id, COUNT(*) AS N FROM U u LEFT OUTER JOIN O o ON u.Id = o.UserId WHERE u.A = 'x' AND B = 3 GROUP BY u.Id HAVING COUNT(*) > 1 ORDER BY N DESC, Id;")
    assert s.items == (T.Item(T.Name("Id", "u")), T.Item(T.Aggregate("COUNT", None), "N"))
    assert s.joins == (T.Join("left", T.Source("O", "o"), T.Name("Id", "u"), T.Name("UserId", "o")),)
    assert s.where == (T.Equals(T.Name("A", "u"), "x"), T.Equals(T.Name("B"), "3"))
    assert s.order_by == ((T.Name("N"), True), (T.Name("Id"), False))


@pytest.mark.parametrize("sql", ["CREATE", "SELECT a FROM t LIMIT x", "SELECT a FROM t WHERE a='x' OR", "DELETE FROM t WHERE", "SELECT a + 1 FROM t", "CREATE TABLE T (a VARCHAR(0))", "SELECT a FROM t WHERE a = 'x", "SELECT a FROM t WHERE a >"])
def test_parse_errors(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_reserved_word_as_column():
    with pytest.raises(ValidationError):
        parse("SELECT FROM")


def test_bracketed_names_escapes_and_comments():
    assert parse("CREATE TABLE T ([My Column] CHAR(10))").columns == (T.Column("My Column", "CHAR", 10),)
    assert parse(r"INSERT INTO T (a) VALUES ('it''s\n') -- end").rows == (("it's\n",),)


def test_subqueries():
    s = parse("SELECT Id, (SELECT COUNT(*) FROM C c WHERE c.P = p.Id) AS N FROM P p WITH (NOLOCK) WHERE Id IN (SELECT P FROM C WHERE k = '1' AND j = '2') AND NOT EXISTS (SELECT 1 FROM D WHERE D.x = p.Id)")
    assert s.no_lock and isinstance(s.items[1].value, T.ScalarQuery)
    assert s.where[0].where == (T.Equals(T.Name("k"), "1"), T.Equals(T.Name("j"), "2")) and s.where[1].negated


def test_create_table_constraints():
    s = parse("CREATE TABLE T (a INT PRIMARY KEY, b CHAR(3) UNIQUE, d DECIMAL(10,2), UNIQUE (a, b), FOREIGN KEY (b) REFERENCES P(x)) WITH (maxShardSize=100)")
    assert s.primary_key == ("a",) and s.unique == (("b",), ("a", "b")) and s.foreign_keys == (T.ForeignKey("b", "P", "x"),) and s.max_shard_size == 100


def test_scripts():
    assert batches("CREATE TABLE A (x INT);\nGO\nCREATE TABLE B (x INT);\n") == [["CREATE TABLE A (x INT)"], ["CREATE TABLE B (x INT)"]]
    assert batches("a; /* ; \n GO \n */ b ';\nGO\n' -- c;\ngo 3\nd") == [["a", "b ';\nGO\n'"], ["d"]]
