from quartzbar.functions.keys import entity_key


def test_spellings(spark):
    df = spark.createDataFrame([(x,) for x in (" abc/usdt", "ABC-USDT ", "abc_usdt", "ABCUSDT", "Abc Usdt", None)], "s string")
    assert {r[0] for r in df.select(entity_key(df.s)).collect()} == {"ABCUSDT", None}
