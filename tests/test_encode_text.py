from kiln.functions import text as tx
from kiln.operators import dedup, encode


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, "c", None), (5, "b", 2.0)],
                               "id long, c string, t double")
    oh = encode.onehot(df, "c")
    assert [c for c in oh.columns if c.startswith("c_")] == ["c_b", "c_c"]
    lab = {r["id"]: r["c"] for r in encode.label(df, "c").collect()}
    assert lab == {1: 1, 2: 0, 3: None, 4: 2, 5: 1}
    assert {r["id"]: r["c"] for r in encode.binary(df, "c").collect()}[3] == -1
    te = {r["id"]: r["c"] for r in encode.target(df, "c", "t").collect()}
    assert te[1] == 1.5 and te[3] is None
    fr = {r["id"]: r["c"] for r in encode.frequency(df, "c").collect()}
    assert fr[1] == 0.5 and fr[3] is None
    dic = encode.code_dictionary(df, "c")
    back = encode.inverse_label(encode.label(df, "c"), "c", dic, "c", "orig")
    assert {r["id"]: r["orig"] for r in back.collect()} == {1: "b", 2: "a", 3: None, 4: "c", 5: "b"}


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "Café, the  BEST!"), (2, None), (3, "no digits")], "id long, t string")
    rows = {r["id"]: r for r in df.select(
        "id", tx.remove_punct(df.t).alias("p"), tx.lowercase(df.t).alias("l"),
        tx.remove_stopwords(df.t).alias("s"), tx.regex_extract(df.t, r"(\d+)").alias("r")).collect()}
    assert rows[1]["p"] == "Café the  BEST" and rows[1]["l"] == "café, the  best!"
    assert rows[1]["s"] == "Café, BEST!" and rows[2]["s"] is None and rows[3]["r"] is None


def test_types_and_dates(spark):
    df = spark.createDataFrame([(" 1e3 ", "2024-02-03"), ("abc", "2024-13-01"), (None, None)], "n string, d string")
    out = df.select(tx.to_numeric(df.n).alias("n"), tx.to_datetime(df.d).alias("d")).collect()
    assert out[0]["n"] == 1000.0 and out[1]["n"] is None and out[1]["d"] is None
    ok = spark.createDataFrame([("2024-02-03",)], "d string")
    assert tx.datetime_part(ok, "d", "weekday", "wd").first()["wd"] == 5  # Saturday; Monday = 0


def test_exact_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "x", 1), (1, "x", 1), (2, None, 2), (5, None, 2)], "ord long, k1 string, k2 int")
    got = sorted(r["ord"] for r in dedup.deduplicate(df, "exact", ["k1", "k2"], order_by=["ord"]).collect())
    assert got == [1, 2]


def test_spelling_correction_uses_corpus(spark):
    from kiln.operators.spell import correct_spelling
    docs = ["the quick brown fox"] * 3 + ["teh quikc brwn fox!", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, t string")
    out = {r["id"]: r["t"] for r in correct_spelling(df, "t", min_count=3, key="id").collect()}
    assert out[3] == "the quick brown fox!" and out[4] is None and out[0] == docs[0]
