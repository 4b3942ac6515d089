"""Large JSON objects read by byte ranges."""

import gzip
import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from convprep.sources.messages import read_keyed_records

SCHEMA = "struct<body:string,kind:string,tags:array<struct<t:string>>>"


@contextmanager
def _ranges(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in names]
    for c, v in zip(names, (size, "1b"), strict=True):
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in zip(names, before, strict=True):
            spark.conf.set(c, v)


def _rows(spark, path):
    out = read_keyed_records(spark, path, SCHEMA, "body")
    return sorted(((r["id"], r["text"], r["kind"], None if r["tags"] is None else [t["t"] for t in r["tags"]])
                   for r in out.collect()), key=str)


def _expected(obj):
    rows = [(k, v or {}) for k, v in obj.items()]
    return sorted(((k, v.get("body"), v.get("kind"), [t["t"] for t in v["tags"]] if "tags" in v else None) for k, v in rows), key=str)


def _record(rng):
    chars = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "\n", " ", "é", "你", "\\\\\"", "}{", '"}']
    text = lambda: "".join(rng.choices(chars, k=rng.randrange(0, 12)))
    rec = {"body": text(), "kind": text()}
    if rng.random() < 0.4:
        rec["tags"] = [{"t": text()} for _ in range(rng.randrange(3))]
    return rng.choice([rec, rec, rec, {}, None])


@pytest.mark.parametrize("indent", [None, 2])
def test_any_text_in_tiny_ranges(spark, tmp_dir, indent):
    rng = random.Random(indent or 0)
    objects = [{f"k{i}}}\"{{\\": _record(rng) for i in range(n)} for n in (0, 1, 40)]
    expected = []
    for i, obj in enumerate(objects):
        with open(f"{tmp_dir}/f{i}.json", "w", encoding="utf-8") as f:
            f.write(json.dumps(obj, indent=indent, ensure_ascii=i == 1) + ("\n" if i else ""))
        expected += _expected(obj)
    with _ranges(spark, "97b"):
        got = _rows(spark, tmp_dir)
    assert got == sorted(expected, key=str)


def test_compressed_marked_and_empty_files(spark, tmp_dir):
    with gzip.open(f"{tmp_dir}/a.json.gz", "wt") as f:
        json.dump({"a": {"body": "}"}}, f)
    with open(f"{tmp_dir}/b.json", "w", encoding="utf-8-sig") as f:
        json.dump({"b": {"body": "x"}, "n": None}, f)
    open(f"{tmp_dir}/c.json", "w").close()
    assert _rows(spark, tmp_dir) == [("a", "}", None, None), ("b", "x", None, None), ("n", None, None, None)]


@pytest.mark.parametrize("text", [
    '{"a": {"body": "x"}', '{"a": {"body": "x"}\n', '{"a": {"body": "x"}, "b": null', '{"a": {"body": "x', '{"a": {"body": "x"}}}',
    '{"a": {"body": "x"}} {"b": {"body": "y"}}', '[{"body": "x"}]', '{"a": {"body": "x"},}', '{"a": {"body" "x"}}',
    '{"a": {"body": "x"}} tail', '{"a": {"body": "x"} "b": {"body": "y"}}',
])
def test_broken_files_stop_the_run(spark, tmp_dir, text):
    with open(f"{tmp_dir}/bad.json", "w") as f:
        f.write(text)
    with pytest.raises(Exception):
        print(read_keyed_records(spark, f"{tmp_dir}/bad.json", SCHEMA, "body").collect())


def test_a_large_file_is_read_by_several_tasks(spark, tmp_dir):
    path = f"{tmp_dir}/large.json"
    n, body = 10_000, 'words "quoted" and {braces} ' * 36
    with open(path, "w") as f:
        f.write("{" + ",\n".join(f'"id{i}": ' + json.dumps({"body": f"{i} {body}", "kind": "k"}) for i in range(n)) + "}\n")
    with _ranges(spark, "2m"):
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 4
        out = read_keyed_records(spark, path, SCHEMA, "body")
        good = out.where((F.concat(F.lit("id"), F.substring_index("text", " ", 1)) == F.col("id")) & (F.length("text") > len(body)))
        assert good.agg(F.count_distinct("id")).first()[0] == n == out.count()
