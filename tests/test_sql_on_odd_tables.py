"""Queries against their SQL on small tables made to hold what large ones hold now and then."""

import duckdb
import pytest

from folio.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture
def same(spark, tmp_path):
    def check(name, texts):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        found = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall()
        got = [tuple(r) for r in found.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        return got

    return check


def test_a_share_of_lines_that_floats_miss(same):
    """Seven tenths of 90 lines are 63; as a float product they are a hair less."""
    wide, small = ["widest"] * 62, ["tiny"] * 29
    got = same("q_para_like", {1: " ".join(wide + small), 2: " ".join([*wide, "another", *small[1:]])})
    assert sorted(got) == [(1, "p1b0", False), (2, "p1b0", True)]


@pytest.mark.parametrize("name", ["q_restore", "q_render_action"])
def test_lines_with_more_than_a_hundred_numbers(same, name):
    many = " ".join(f"n{i}" for i in range(120))
    got = same(name, {1: "\n".join([many] * 12), 2: "\n".join(["one 1 of"] * 12), 3: "\n".join([" ".join(["7"] * n) for n in (99, 100, 101)])})
    assert len(got) == 27


def test_a_chunk_whose_only_item_is_lost(same):
    """Of a document of one block, the sixth line, no planted loss may make a file go missing."""
    assert same("q_validate_files", {1: "\n" * 5 + "the only line here", 10: "a line of text"}) == [(10, 1, "10_c01")]
