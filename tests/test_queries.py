import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from veilwright.operators import detect
from veilwright.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ("d03_cn_id", "d12_core_findings", "d13_markdown_fences", "p02_apply_policy", "a01_merge_model_findings", "a02_merge_exact_terms", "a04_redacted_texts", "a14_grouped_metrics", "f15_mask_box", "s13_package_preflight", "k08_output_names")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("others", [0, 10_001])
def test_terms_equal_their_sql_whatever_their_number(spark, tmp_path, others):
    texts = ["alpha beta gamma delta", "alpha", " alpha beta ", "alphabet soup", "", None, "x\nbeta  gamma delta\ty", "xalpha beta gammay"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, "other alpha beta gamma"), (None, texts[0]), (None, "alpha"), (1, "alpha")]
    terms = ["alpha", "alpha beta", "beta gamma delta", "alpha beta gamma", "  gamma delta\t", " beta ", "", None, "a beta gam", "soup", " "]
    items = [(i, t) for i, t in enumerate(terms)] + [(0, "alpha"), (3, "alpha beta gamma"), (None, "alpha")] + [(100 + i, f"zz{i}") for i in range(others)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["j13_texts_and_terms"](spark, str(tmp_path)).collect()]
    expected = con.execute(catalog.ORACLES["j13_texts_and_terms"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, expected)) and expected


def test_merged_logits_of_all_order_lines(spark, duck):
    got = catalog.QUERIES["d17_merged_logits"](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(catalog.ORACLES["d17_merged_logits"]).df())
    assert len(got) == duck.execute("select count(distinct (l_orderkey % 1000, l_linenumber)) from lineitem").fetchone()[0]


def test_rendered_texts_are_all_that_pass(spark, duck):
    """Against the redacted texts of the SQL, rescanned one by one: what still holds a finding is held back."""
    redacted = duck.execute(catalog._with(f"SELECT doc_id, redacted FROM ({catalog._REDACTED}) WHERE error_code IS NULL")).fetchall()
    texts = duck.execute(catalog._with("SELECT doc_id, text FROM p")).fetchall()
    assert len({i for i, _ in texts}) == len(texts)
    got = {r.doc_id: r.redacted for r in catalog.QUERIES["k02_rendered"](spark, SF).collect()}
    again = spark.createDataFrame(redacted, "doc_id long, text string")
    left = {r.doc_id for r in detect.exploded(detect.detect_rules(again)).select("doc_id").distinct().collect()}
    assert got == {i: t for i, t in redacted if i not in left}
    assert {i for i in got if i < 1_000_000_000} and {i % 8 for i in got if i >= 1_000_000_000} > {4}


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in glob.glob("veilwright/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), path


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
