import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderlake.functions.text import scrub
from orderlake.operators.scrub import TokenScrubber, scrub_many
from orderlake.operators.typed import MAX_EXPRESSIONS, scrub_tokens
from orderlake.plans import anonymize as anon
from orderlake.schema import INGEST_KEY


def in_order(value, tokens, replacement):
    for token in tokens:
        if token:
            value = value.replace(token, replacement)
    return value


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.text("abé", max_size=4), max_size=12),
    st.sampled_from(["ba", "", "a", "é-a", "zz"]),
    st.lists(st.text("abé", max_size=20), max_size=6),
)
def test_equals_a_chain_of_replacements(tokens, replacement, values):
    clean = TokenScrubber(tokens, replacement)
    assert [clean(v) for v in values] == [in_order(v, tokens, replacement) for v in values]
    assert clean(None) is None


def test_frame_equals_the_expressions(spark):
    """A replacement that makes a later token, one that remakes an earlier one, overlaps, nulls, an empty token."""
    tokens = ["aab", "ba", "", "aa", "b", "aab", "é", "a.b", "\n"]
    values = ["aabba", "baab", "", None, "aaab", "a.b é\n", "xyz", "b" * 50_000 + "aab" * 1000, "aabba"]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, c string, other string")
    got = {r["i"]: r for r in scrub_many(df, ["c"], tokens, "ab").collect()}
    want = {r["i"]: r["c"] for r in df.select("i", scrub(F.col("c"), tokens, "ab").alias("c")).collect()}
    assert {i: r["c"] for i, r in got.items()} == want
    assert [got[i]["other"] for i in range(len(values))] == values
    assert scrub_many(df.limit(0), ["c"], tokens, "ab").collect() == []


def test_ten_thousand_tokens(spark):
    draw = random.Random(5)
    tokens = ["".join(draw.choices("abcdef ", k=draw.randint(3, 9))) for _ in range(10_000)]
    values = ["".join(draw.choices("abcdef ", k=draw.randint(0, 60))) for _ in range(500)] + [None]
    df = spark.createDataFrame([(str(i), v, v) for i, v in enumerate(values)], f"{INGEST_KEY} string, Email string, note string")
    out = scrub_tokens(df, tokens)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 5_000
    got = {int(r[INGEST_KEY]): r for r in out.collect()}
    for i, value in enumerate(values):
        assert got[i]["Email"] == (None if value is None else in_order(value, tokens, "sample-scan"))
        assert got[i]["note"] == value


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab ", min_size=1, max_size=6), min_size=1, max_size=20))
def test_both_ways_agree(spark, values):
    df = spark.createDataFrame([(v, v) for v in values], "Customer_Name string, Shipping_City string")
    few = ["ab", "ba", "a  "]
    many = few + [f"unseen {i}" for i in range(MAX_EXPRESSIONS)]
    assert scrub_tokens(df, few).collect() == scrub_tokens(df, many).collect()


def test_job_takes_tokens_from_a_file(spark, tmp_path):
    from orderlake import __main__ as jobs
    from orderlake.sources.csv_lines import read_order_lines

    source, tokens = tmp_path / "in.csv", tmp_path / "tokens.txt"
    source.write_text("Order_Number,Customer_Name,Shipping_City\n1,Ann,Firm 7 Town\n2,Bob,Firm 12 Firm 7\n")
    tokens.write_text("".join(f"Firm {i}\n" for i in range(100)) + "\n  \n")
    jobs.main(["anonymize", str(source), f"{tmp_path}/public", f"{tmp_path}/private", "--scrub-file", str(tokens)])
    cities = {r["Order_Number"]: r["Shipping_City"] for r in read_order_lines(spark, f"{tmp_path}/public").collect()}
    assert cities == {"1": "sample-scan Town", "2": "sample-scan2 sample-scan"}


def test_audit_knows_the_many_tokens(spark):
    from orderlake.plans import audit
    from tests.test_anonymize import lines

    df = lines(spark, [("1", "Ann", "a@x.y", "1 Way", "", "97214")]).withColumn("Shipping_City", F.lit("Firm 3 Town"))
    tokens = [f"Firm {i}" for i in range(40)]
    ids = anon.draw_identities(df)
    ids.collect()
    fixed = spark.createDataFrame(ids.collect(), ids.schema)
    after = anon.apply_identities(df, fixed, tokens)
    assert after.first()["Shipping_City"] == "sample-scan Town"
    assert all(r["passed"] for r in audit.audit(df, after, fixed, tokens).collect())
