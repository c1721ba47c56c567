"""The registered queries against their SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.llm import oracle, queries


def test_registered_once_each():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, data_dir, name):
    connection = duckdb.connect()
    for path in Path(data_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    rows = queries.QUERIES[name](spark, data_dir)
    columns = sorted(rows.columns)
    answer = connection.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in places) for r in answer.fetchall())
    assert Counter(tuple(r) for r in rows.select(*columns).collect()) == expected


HELPERS = (
    "_host _path _list _text _lines _keys _gone _html _best _suffix _length _digest _runs _hash _doc stays "
    "digest component prefix rule_host _own_0 _own_1 a.b"
).split()


@pytest.mark.parametrize("name", ["filter_urls", "extract_text", "find_contamination", "without_near_duplicates"])
def test_columns_called_like_helpers_stay(spark, name):
    """Every other column keeps its values, whatever it is called."""
    from pyspark.sql import functions as F

    from tidemark.llm import decontaminate, html_extract, near_dedup, url_filter

    texts = [f"word{k} " + " ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(k, t, f"http://a.com/{k}", f"<p>shared</p><p>{t}</p>") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, url string, html string")
    marked = [F.concat(F.lit(h), F.col("doc_id")).alias(h) for h in HELPERS]
    used = {"filter_urls": ["url"], "extract_text": ["url", "html"]}.get(name, ["doc_id", "text"])
    given = table.select(*used, *marked, F.col("doc_id").alias("nr"))
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    work = {
        "filter_urls": lambda d: url_filter.filter_urls(d, rules),
        "extract_text": html_extract.extract_text,
        "find_contamination": lambda d: decontaminate.find_contamination(d, items),
        "without_near_duplicates": near_dedup.without_near_duplicates,
    }[name]
    found = work(given)
    assert set(HELPERS) <= set(found.columns)
    got = found.collect()
    assert len(got) == 4
    for r in got:
        assert all(r[h] == f"{h}{r.nr}" for h in HELPERS)
