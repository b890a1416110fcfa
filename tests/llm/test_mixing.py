"""Curriculum mixing, the pipeline, and the queries that SQL can express."""

from collections import defaultdict

import pytest

import corpus_pipeline
from checks.compare import _bag, connect
from orderlake.llm.curriculum import mixed_documents, plan_columns
from orderlake.llm.oracles import ORACLES
from orderlake.llm.queries import QUERIES
from tests.conftest import SF_DIR

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    result = connect(SF_DIR).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _bag(df.columns, got) == _bag(columns, result.fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}", "x") for i in range(200)]
    rows += [(300, None, "s1", "x"), (301, "", "s2", "x"), (302, "some words here", None, "x"), (None, "no id", "s0", "x")]
    rows += [(303, "tail", "", "x"), (304, None, "empty", "x"), (5, "w " * 6, "s1", "x"), (5, "w " * 6, "s1", "x")]
    return spark.createDataFrame(rows, f"{DOCS}, target string")


def test_targets_are_met(odd):
    rows = plan_columns(odd).collect()
    assert len(rows) == 208
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
    total = sum(r.size for r in rows)
    for found in by_source.values():
        assert found[0].source_size == sum(r.size for r in found)
        assert abs(sum(r.taken for r in found) - found[0].target) <= 0.5
        assert found[0].target <= 2 * found[0].source_size
    assert sum(found[0].target for found in by_source.values()) == pytest.approx(1.5 * total)
    order = sorted((s for s in by_source if s is not None)) + [None]
    open_ = [(by_source[s][0].target / (5, 2, 1)[i % 3]) for i, s in enumerate(order) if by_source[s][0].target < 2 * by_source[s][0].source_size]
    assert max(open_) == pytest.approx(min(open_))


def test_plan_is_in_training_order(spark, odd, tmp_path):
    plan = plan_columns(odd)
    places = [r.position for r in plan.collect()]
    taken = [p for p in places if p is not None]
    assert taken == sorted(taken) and places[: len(taken)] == taken and len(taken) < len(places)
    # Part files hold ranges one after the other, so a reader of them in order trains in order.
    many = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(4000)], DOCS)
    plan_columns(many).write.parquet(f"{tmp_path}/plan")
    parts = sorted((tmp_path / "plan").glob("part-*"))
    read = [r.position for part in parts for r in spark.read.parquet(str(part)).collect() if r.position is not None]
    assert read == sorted(read) and len(read) > 2000


def test_reruns_agree(odd):
    one, two = (sorted(map(str, plan_columns(d).collect())) for d in (odd, odd.repartition(7)))
    assert one == two


def test_mixed_documents(odd):
    plan = plan_columns(odd).collect()
    rows = mixed_documents(odd).collect()
    words = lambda t: len((t or "").split())
    assert sum(words(r.text) for r in rows) == sum(r.taken for r in plan)
    assert rows[0].asDict().keys() == {"doc_id", "text", "source"}
    half = len(rows) // 2
    share = lambda part, s: sum(words(r.text) for r in part if r.source == s)
    # Sources come in the order "", "empty", "s0", … with tilts 0.5, 0, -0.5 repeating.
    assert share(rows[:half], "s1") > 1.2 * share(rows[half:], "s1")
    assert share(rows[:half], "s0") < 0.85 * share(rows[half:], "s0")


def test_mixing_nothing(odd):
    assert plan_columns(odd.where("false")).count() == 0
    assert mixed_documents(odd.where("text is null")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, before, SF_DIR).collect()
        after = spark.createDataFrame(rows, docs.schema)
        assert after.columns == docs.columns and 0 < len(rows)
        if name != "mixing":
            assert len(rows) <= before.count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR).collect()
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, again))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF_DIR).collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, 1.0, "c"), (2, "", "a", 0, 2.0, "c"), (3, "plain words " * 40, "a", 480, 3.0, "c")]
    rows += [(3, "plain words " * 40, "a", 480, 3.0, "c"), (None, "nothing known", None, None, None, None)]
    schema = "doc_id long, text string, source string, n_chars long, score double, chunk string"
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0
    assert corpus_pipeline.packing(spark, docs, SF_DIR).count() == 5
