"""SQL functions, streams, the entry module, and that the library doesn't need the text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

from sylvan.functions import register
from sylvan.sources.pages import extract
from sylvan.streaming.pages import counted, read_pages

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "<p class=k>a <b>b</b></p>")], "page_id long, html string").createOrReplaceTempView("p")
    row = spark.sql("SELECT html_text(html) t, html_md(html) m, html_formatted(html) f, html_attr(html, 'p', 'class') a, html_attr(html, 'i', 'x') n FROM p").first()
    assert tuple(row) == ("a b", "a **b**", "a b", "k", None)
    assert [tuple(r) for r in spark.sql("SELECT page_id, s.* FROM p, LATERAL html_select(html, 'p > b') s").collect()] == [(1, 1, 6, "b", "b")]
    assert spark.sql("SELECT kind FROM p, LATERAL parse_html(html) WHERE depth = 0").first().kind == "document"


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>a<p>b") for i in range(5)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/in")
    stream = extract(read_pages(spark, f"{tmp_path}/in"), "p", ["text"])
    query = stream.writeStream.format("memory").queryName("found").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT doc_id, sel_ord, text FROM found").collect()
    assert sorted(map(tuple, rows)) == [(i, k, t) for i in range(5) for k, t in ((1, "a"), (2, "b"))]
    assert counted(stream.selectExpr("*", "current_timestamp() AS at"), "at").isStreaming


def test_library_stands_without_the_text_operators():
    code = (
        "import sys; sys.modules['sylvan.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql()\n"
        "assert 'nav_links' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(o) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "sylvan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sylvan.llm" not in path.read_text(), path


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from sylvan.queries import ORACLES, QUERIES

    own = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        own.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    some = ("nav_links", "para_text", "b_reconstruct", "char_count", "sel_li_adjacent", "sel_not_complex", "sel_has", "add_union", "find_restricted_repeats", "edit_strip", "markdown_table", "rename")
    for name in some:
        want, got = own.sql(ORACLES[name]).df(), QUERIES[name](spark, str(DATA)).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns), name
        rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
        assert rows(want) == rows(got), name
