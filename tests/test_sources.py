import pytest
from hypothesis import given, strategies as st

from tidemark.functions.codec import decode, decode_text, encode, encode_text, truncate, truncate_encoded
from tidemark.sources import rows as R
from tidemark.sql.tree import Column

FIXED = [Column("Id", "CHAR", 6), Column("N", "INT"), Column("B", "BIT"), Column("D", "DECIMAL", 8, 2)]
VARIABLE = [Column("Id", "CHAR", 6), Column("Body", "VARCHAR", 12)]


@given(st.text(alphabet="ab\\\n\r\t|:'", max_size=30), st.integers(1, 12))
def test_codec_round_trip_and_truncation(s, width):
    assert decode_text(encode_text(s)) == s
    cut = truncate_encoded(encode_text(s), width)
    assert len(cut) <= width and s.startswith(decode_text(cut)) and len(cut) >= min(width - 1, len(encode_text(s)))


def test_codec_columns(spark):
    texts = ["Line1\nLine2\tTab\\Esc", "a\nb", "", "\\\\\\", "abcdefgh", "\\n", "a\0b\\\\\0", "\\\\n\\", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", encode(df.t).alias("e"), decode(encode(df.t)).alias("d"), truncate(df.t, 2).alias("c")).collect()
    for r in got:
        if r.t is not None:
            assert r.e == encode_text(r.t) and r.d == r.t and r.c == decode_text(truncate_encoded(encode_text(r.t), 2))


@pytest.mark.parametrize("columns", [FIXED, VARIABLE])
def test_text_round_trip(spark, tmp_path, columns):
    data = [(True, 1, 3, 0, "a\nb", "7", "1", "1.50"), (False, 2, 3, 4, "x\\", "-12", "0", "")] if columns is FIXED else [(True, 1, 3, 0, "a|b", "9:x|\t"), (False, 2, 3, 4, "", "0123456789abcdef")]
    df = spark.createDataFrame(data, R._schema(columns))
    R.write_text_rows(df, f"{tmp_path}/t", columns)
    back = [tuple(r) for r in R.read_text_rows(spark, f"{tmp_path}/t", columns).orderBy("_row_id").collect()]
    want = data if columns is FIXED else [data[0], (*data[1][:5], "0123456789ab")]
    assert back == want


def test_text_layout_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("abcdefgh", "5", "x", "1")], "Id string, N string, B string, D string")
    R.write_fixed(df, f"{tmp_path}/f", FIXED)
    assert spark.read.text(f"{tmp_path}/f").first()[0] == "A|abcdef|          5|0|         1"
    for bad, word in (("X|abc", "A| or D|"), ("A", "too short")):
        spark.createDataFrame([(bad,)], "value string").write.mode("overwrite").text(f"{tmp_path}/bad")
        for columns in (FIXED, VARIABLE):
            with pytest.raises(Exception, match=word.replace("|", r"\|")):
                R.read_text_rows(spark, f"{tmp_path}/bad", columns).collect()


def test_binary_round_trip(spark, tmp_path):
    data = [(True, 1, 3, 0, "a\nb", "7", "1", "1.5"), (False, 2, 3, 4, "x", "zz", "0", "3")]
    df = spark.createDataFrame(data, R._schema(FIXED))
    R.write_binary(df, f"{tmp_path}/b.bin", FIXED, versions=True)
    assert (tmp_path / "b.bin").stat().st_size == 2 * R.record_size(FIXED, True)
    back = sorted(tuple(r) for r in R.read_binary(spark, f"{tmp_path}/b.bin", FIXED, versions=True).collect())
    assert back == sorted([data[0], (False, 2, 3, 4, "x", "0", "0", "3")])
