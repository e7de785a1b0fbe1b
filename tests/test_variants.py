"""Ragged JSON against Python's parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.variants import elements, field, shape, typed

TEXTS = [
    None, "", "{", '{"k": 1}', '{"k": "2.5"}', '{"k": "x"}', '{"k": {"v": 3}}', '{"k": null}', "[]", "[1, [2], {}]", '{"tags": ["a", 1, null]}', '{"tags": {"x": 1, "y": [2]}}',
    '{"tags": 7}', "3", '"text"', "null", '{"k": 1e3, "tags": []}', '{"a b": {"k": 1}}', '{"k": true}', "{'k': 1}", '{"k": 1} trailing', '{"é": "漢字"}',
]


def value(text):
    try:
        return True, json.JSONDecoder().raw_decode(text)[0]  # what follows a whole value isn't read
    except (TypeError, ValueError):
        return False, None


def number(x):
    if isinstance(x, bool):
        return float(x)
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, props string").repartition(3)


def test_typed_columns(df):
    got = {r.id: r for r in typed(df, "props", {"k": ("$.k", "double"), "deep": ("$.k.v", "int"), "first": ("$[0]", "int")}).collect()}
    for i, text in enumerate(TEXTS):
        fine, v = value(text)
        k = v.get("k") if isinstance(v, dict) else None
        assert got[i].k == number(k), text
        assert got[i].deep == (k["v"] if isinstance(k, dict) else None) and got[i].first == (v[0] if isinstance(v, list) and v else None)
        assert got[i].is_bad == (text is not None and not fine), text
    with pytest.raises(ValueError, match="id"):
        typed(df, "props", {"id": ("$.k", "int")})


def test_elements_of_arrays_and_maps(df):
    got = elements(df, "props", "$.tags").select("id", "pos", "key", F.to_json("value").alias("v")).collect()
    want = []
    for i, text in enumerate(TEXTS):
        v = value(text)[1]
        tags = v.get("tags") if isinstance(v, dict) else None
        want += [(i, p, None, x) for p, x in enumerate(tags)] if isinstance(tags, list) else [(i, p, k, x) for p, (k, x) in enumerate(tags.items())] if isinstance(tags, dict) else []
    assert sorted(((r.id, r.pos, r.key, json.loads(r.v)) for r in got), key=repr) == sorted(want, key=repr)
    outer = elements(df, "props", "$.tags", keep_empty=True)
    assert outer.select("id").distinct().count() == len(TEXTS)


def test_shapes_merge(spark):
    rng = random.Random(1)
    rows = [("a", json.dumps({"k": rng.randrange(9), "s": "x"})) for _ in range(50)] + [("a", '{"k": 1.5, "t": [1, 2]}'), ("b", '{"k": "text"}'), ("b", '{"k": 1}'), ("b", "{"), ("b", None)]
    got = {r.g: r for r in shape(spark.createDataFrame(rows, "g string, props string").repartition(4), "props", "g").collect()}
    assert (got["a"].n, got["a"].n_bad, got["b"].n, got["b"].n_bad) == (51, 0, 4, 1)
    assert got["a"].shape == "OBJECT<k: DECIMAL(21,1), s: STRING, t: ARRAY<BIGINT>>" and got["b"].shape == "OBJECT<k: VARIANT>"
    assert shape(spark.createDataFrame([], "g string, props string"), "props", "g").count() == 0


def test_field_of_a_variant_column(spark):
    r = spark.sql("""SELECT parse_json('{"a": [{"b": 5}]}') AS v""").select(field("v", "$.a[0].b", "long").alias("x"), field("v", "$.a[1].b", "long").alias("y")).first()
    assert (r.x, r.y) == (5, None)
