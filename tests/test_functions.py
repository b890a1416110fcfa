from decimal import Decimal

from pyspark.sql import functions as F

from orderlake.functions.pages import has_sufficient_text
from orderlake.functions.products import (
    Catalog,
    Family,
    canonical_code,
    canonical_description,
    category_of,
    pack_tier,
)
from orderlake.functions.text import join_present, scrub, split_tokens, strip, zip_prefix
from orderlake.functions.values import clean_order_number, to_date, to_money, to_number


def test_order_numbers(column):
    cases = {
        "12440.0": "12440", "00123": "123", " 7 ": "7", "12440.7": "12440", "-5": "-5",
        "1e3": "1000", "+8": "8", ".5": "0", "-0.9": "0", "0": "0", "007.": "7",
        "abc": "", "nan": "", "inf": "", "": "", "  ": "", "1_000": "", "1,000": "",
        "1e400": "", "1.0d": "", " 42 ": "42", "123456789012345": "123456789012345",
        "1e20": "100000000000000000000", None: "",
    }
    got = column(list(cases), lambda df: clean_order_number(F.col("c")))
    assert dict(zip(cases, got)) == cases


def test_amounts(column):
    cases = {
        "149.99": Decimal("149.9900"), " 12 ": Decimal(12), "-30.00": Decimal(-30),
        "1e3": Decimal(1000), "$5": None, "1,234.00": None, "1.0d": None, "": None,
        "nan": None, "inf": None, None: None, "1e99": None,
    }
    assert column(list(cases), lambda df: to_money(F.col("c"))) == list(cases.values())


def test_numbers(column):
    cases = {"2": 2.0, "1e99": 1e99, "1e999": None, "NaN": None, "x": None, "": None}
    assert column(list(cases), lambda df: to_number(F.col("c"))) == list(cases.values())


def test_dates(column):
    texts = ["4/25/2024", "06/12/2024", "2024-04-27", "4/25/24", "25/04/2024", "illegible", "", None]
    one = column(texts, lambda df: to_date(F.col("c")).cast("string"))
    assert one == ["2024-04-25", "2024-06-12", None, None, None, None, None, None]
    two = column(texts, lambda df: to_date(F.col("c"), ("M/d/yyyy", "yyyy-MM-dd")).cast("string"))
    assert two[2] == "2024-04-27"


def test_tiers(column):
    cases = {
        "CARM-5": "5", "HBAR-2-5": "5", "MG-10": "1", "GUMM3 ": "3", "X": "1", "": "1",
        "CHOC-2": "1", "CARM-3X": "3", "GLM 5": "5", None: "1",
    }
    assert column(list(cases), lambda df: pack_tier(F.col("c"))) == list(cases.values())


def test_canonical_codes(column):
    cases = {
        ("CARA-3", "x"): "CARM-3", ("CARD", ""): "CARM-1", ("", "Car sampler"): "SAMP",
        ("MG-10", ""): "GUMM-1", ("XMG", ""): "ASST", ("HBAR-2-5", ""): "CHOC-5",
        ("gummie-3", None): "GUMM-3", (None, None): "ASST", ("", "mushroom 5"): "CHOC-1",
        (None, "mg"): "ASST", ("smpl-5", ""): "SAMP", ("galactic1", ""): "GUMM-1",
    }
    got = column(
        list(cases), lambda df: canonical_code(F.col("c"), F.col("d")), "c string, d string"
    )
    assert dict(zip(cases, got)) == cases


def test_descriptions_and_categories(column):
    codes = ["CARM-5", "SAMP", "CHOC-1", "ASST", "nope", "", None]
    got = column(codes, lambda df: canonical_description(F.col("c")))
    assert got[:4] == [
        "Signature Caramels — 5-Pack", "Sampler Pack", "Dark Chocolate Bar — 1-Pack",
        "Assorted Selection",
    ]
    categories = column(codes, lambda df: category_of(F.col("c")))
    assert categories == ["Caramels", "Sampler", "Chocolate", "Assorted", "Other", "Other", "Other"]


def test_own_catalog(column):
    own = Catalog(
        families=(Family("TEA", "Teas", "Loose Tea", contains=("TEA",)),
                  Family("MISC", "Rest", "Anything", tiered=False)),
        tier_labels={"1": "Tin", "2": "Box"},
    )
    got = column(["green tea-2", "pen"], lambda df: canonical_code(F.col("c"), F.lit(""), own))
    assert got == ["TEA-2", "MISC"]


def test_text_helpers(column):
    assert column(["97214-1234", "7102", "", None, "ab"], lambda df: zip_prefix(F.col("c"))) == [
        "972", "710", "", "", ""]
    assert column([" \t x y　\n"], lambda df: strip(F.col("c"))) == ["x y"]
    assert column(["ACME Acme ACMEACME"], lambda df: scrub(F.col("c"), ["ACME"], "z")) == ["z Acme zz"]
    assert column(["a.b"], lambda df: scrub(F.col("c"), ["."], "z")) == ["azb"]
    assert column([("a", "", "b")], lambda df: join_present(" ", [F.col(x) for x in "cde"]),
                  "c string, d string, e string") == ["a b"]
    assert split_tokens(" a, ,b c,") == ["a", "b c"]


def test_sufficient_text(column):
    pad = " and some further words to make it long enough to count"
    cases = {
        "order customer total" + pad: True,
        "order customer" + pad: False,
        "order customer $5" + pad: True,
        "order customer 1/2/24" + pad: True,
        "order customer a@b.c" + pad: True,
        "order $5 1/2/24 a@b.c" + pad: False,
        "order customer total": False,
        "order customer total" + " " * 60: False,
        "order customer total " + "\n" * 60 + "x": False,
        "ORDER Customer\nTOTAL" + pad: True,
        "": False,
        None: False,
    }
    got = column(list(cases), lambda df: has_sufficient_text(F.col("c")))
    assert dict(zip(cases, got)) == cases


def test_numbers_are_whole_and_finite(column):
    got = column(["123\n", "-1e400", "1e400", "-5", "7 "], lambda df: to_number(df.c))
    assert got == [123.0, None, None, -5.0, 7.0]
    assert column(["123\n", "123", "1\n2"], lambda df: clean_order_number(df.c)) == ["123", "123", ""]
