from pyspark.sql import functions as F

from lodestrand.functions import text as tx


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_tokens_of_mixed_scripts(spark):
    expected = ["aile", "x_1", "校", "园", "卡", "校园", "园卡", "ok"]
    assert value(spark, tx.tokenize, "éAile x_1 校园卡 OK") == expected
    assert tx.python_tokens("éAile x_1 校园卡 OK") == expected
    assert value(spark, tx.tokenize, "") == []


def test_informative_terms(spark):
    assert value(spark, lambda c: tx.informative_terms(tx.tokenize(c)), "a ok 如何") == ["ok"]


def test_exact_facts(spark):
    assert value(spark, tx.exact_facts, "code ZX-900 at 08:30, 12:61 no") == ["08:30", "zx-900"]
    assert value(spark, tx.exact_facts, "编号ZX-900") == []
    assert value(spark, tx.exact_facts, "12--A1") == ["12", "a1"] or value(spark, tx.exact_facts, "12--A1") == ["a1"]


def test_rewrite(spark):
    r = value(spark, tx.rewrite_query, " 请问，一卡通  丢掉了 ")
    assert (r.query, r.changed, r.reason) == ("校园卡 遗失", True, "一卡通→校园卡；丢掉了→遗失")
    assert value(spark, tx.rewrite_query, "图书馆").changed is False


def test_missing_fact(spark):
    df = spark.createDataFrame([("多少钱", "20 元"), ("多少钱", "贵"), ("好", "")], "q string, e string")
    assert [r.x for r in df.select(tx.missing_precise_fact(F.col("q"), F.col("e")).alias("x")).collect()] == [None, "费用或金额", None]


def test_weekday_and_services(spark):
    assert value(spark, tx.normalize_weekday, " Sunday ") == "周日"
    assert value(spark, tx.normalize_weekday, "someday") is None
    assert value(spark, tx.extract_weekday, "on 星期天") == "周日"
    assert value(spark, tx.extract_service_code, "教务处") == "registrar"
    assert value(spark, tx.extract_campus, "东区") == "east"
    assert value(spark, tx.static_clauses, "图书馆现在开门吗？怎么借书") == "怎么借书"
    assert value(spark, tx.static_clauses, "现在开门吗") == "现在开门吗"


def test_upload_names(spark):
    names = ["a.md", " ", "x.", "a/b.md", "a\x07.md", "a.exe", "a.md.txt", "con.md", "ok.PDF"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [r.x for r in df.select(tx.display_name_error(tx.strip(F.col("t"))).alias("x")).collect()]
    assert got == [None, "name_length", "name_end", "name_illegal", "name_control", "unsupported_type", "double_extension", "reserved_name", None]


def test_decode(spark):
    rows = [(bytearray(b"\xef\xbb\xbfhello"), "txt"), (bytearray(b"# t\nx"), "md"), (bytearray(b"\xff\xfe"), "txt"), (bytearray(b"%PDF-1"), "md"), (bytearray(b"a\x00b"), "txt"), (bytearray(b"  "), "txt")]
    df = spark.createDataFrame(rows, "b binary, e string")
    got = [(r.x.text, r.x.error) for r in df.select(tx.decode_text(F.col("b"), F.col("e"), F.lit("T")).alias("x")).collect()]
    assert got == [("# T\n\nhello", None), ("# t\nx", None), (None, "not_utf8"), (None, "binary_content"), (None, "binary_content"), (None, "empty_text")]


def test_decoding_leaves_the_text_rules_to_uploads(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 1_000_001),), (bytearray(b"a\x01"),), (bytearray(b" "),), (bytearray(b"\xff"),), (None,)], "b binary")
    whole = df.select(tx.decode_bytes(F.col("b"), F.lit("txt"), F.lit("T")).alias("x"), tx.decode_text(F.col("b"), F.lit("txt"), F.lit("T")).alias("y")).collect()
    assert [(r.x.text, r.x.error) for r in whole] == [("# T\n\n" + "x" * 1_000_001, None), ("# T\n\na\x01", None), ("# T\n\n", None), (None, "not_utf8"), (None, None)]
    assert [(r.y.text, r.y.error) for r in whole] == [(None, "text_too_long"), (None, "control_characters"), (None, "empty_text"), (None, "not_utf8"), (None, "not_utf8")]
