"""Queries over texts of which some are empty, blank or null, against their SQL."""

import subprocess
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folio.operators import segments
from folio.plans import registry
from tests.test_oracle import rows

TEXTS = ["", None, "   ", "\n", " . .", "The a\nb\nThe c", "x\nThe d", "no line", "", "", None, "  \nThe e\n"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into d values (?, ?, 'en', 's', ?)", [(i, t, len(t or "")) for i, t in enumerate(TEXTS)])
    c.execute(f"copy d to '{path}/documents.parquet' (format parquet)")
    return path


@pytest.mark.parametrize("name", ["resolve_chapters", "safe_file_names", "split_chapters_regex"])
def test_query_over_empty_texts(spark, folder, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = c.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    # The test's rows() shows a null as an empty text.
    assert rows(got) == rows(want) and got.isna().sum().to_dict() == want.isna().sum().to_dict()


def test_the_split_by_a_column_runs_where_the_package_is_absent(tmp_path):
    code = "import pickle, sys; print(len(pickle.load(sys.stdin.buffer)('a\\nb\\na', '^a')))"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(segments._regex_cuts), cwd=tmp_path, env={}, capture_output=True, check=False)
    assert done.stdout.split() == [b"2"], done.stderr.decode()


@pytest.mark.parametrize("regex", ["^The ", "x*", "(", None])
def test_a_kept_empty_text_is_one_chapter(spark, regex):
    regex = regex or F.lit("x*")
    books = spark.createDataFrame([(1, ""), (2, None)], "book_id long, full_text string")
    got = segments.split_chapters_regex(books, regex, keep_empty=True)
    assert list(map(tuple, got.collect())) == [(1, 0, "全文", "")]
    assert segments.split_chapters_regex(books, regex).count() == 0
