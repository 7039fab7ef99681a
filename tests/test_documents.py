"""One JSON document cut at any byte equals the whole-file reader."""

import json
import os
import random
import tempfile

import pytest

from gradebook.sources import documents as doc

NASTY = ['a "quoted" } ] { [', "back\\slash\\", 'ends with \\"', "é, ü, {", "", "a,b,,c", "\\", '"']
SCHEMAS = {"images": "id long, name string, tags array<string>, box struct<x:double,y:double>",
           "annotations": "id long, note string", "captions": "id long"}


def _document(rng, n):
    return {"info": {"images": [{"id": -1}], "deep": {"er": [{"id": -2}, [1]]}, "s": NASTY[0]},
            "version": 'x": [{',
            "images": [{"id": i, "name": rng.choice(NASTY), "tags": [rng.choice(NASTY), None],
                        "box": {"x": i / 2, "y": 1.0}} for i in range(n)],
            "empty": [], "numbers": [1, "two", None],
            "annotations": [{"id": i, "note": rng.choice(NASTY) * rng.randrange(1, 30)}
                            for i in range(n)]}


def _path(text):
    path = os.path.join(tempfile.mkdtemp(prefix="gb-doc-"), "d.json")
    with open(path, "w") as f:
        f.write(text)
    return path


def _check(spark, value, text):
    got = doc.read_sections(spark, _path(text), SCHEMAS)
    for name in SCHEMAS:
        rows = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in got[name].collect())
        want = [{**{c: None for c in got[name].columns}, **r} for r in value.get(name, [])]
        assert rows == sorted(json.dumps(r, sort_keys=True) for r in want), name


@pytest.mark.parametrize("cut", [None, 37, 400])
def test_sections_at_any_cut(spark, cut):
    value = _document(random.Random(5), 25)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    try:
        if cut:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        _check(spark, value, json.dumps(value))
        if cut != 37:
            _check(spark, value, json.dumps(value, indent=2, ensure_ascii=False))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_documents(spark):
    for text in ("", "{}", '{"images": []}'):
        _check(spark, {}, text)


def test_a_document_in_parts(spark):
    """A folder of parts in path order is one document; records and strings cross no part."""
    path = tempfile.mkdtemp(prefix="gb-doc-")
    parts = {"0-head/a": '{"info": [1, {"id": 9}],\n"images": [', "1-rows/p0": '{"id": 1, "name": "]"},\n',
             "1-rows/p1": '{"id": 2, "name": "{\\""},\nnull],\n"annotations": [', "2/p": '{"id": 3}',
             "3-end/p": "]}\n"}
    for name, text in parts.items():
        os.makedirs(os.path.dirname(os.path.join(path, name)), exist_ok=True)
        with open(os.path.join(path, name), "w") as f:
            f.write(text)
    got = doc.read_sections(spark, path, SCHEMAS)
    assert sorted((r.id, r.name) for r in got["images"].collect()) == [(1, "]"), (2, '{"')]
    assert [r.id for r in got["annotations"].collect()] == [3]


def test_the_plan_writes_its_document_in_parts(spark):
    from gradebook.plans import library_plans

    sizes, read = [], library_plans.doc.read_sections

    def sized(spark, path, schemas):
        sizes.extend(n for n in os.listdir(path))
        return read(spark, path, schemas)
    library_plans.doc.read_sections = sized
    try:
        rows = library_plans.document_sections(spark, "/root/testdata/sf0.001")
        assert rows.where("section = 'annotations'").count() > 5000
    finally:
        library_plans.doc.read_sections = read
    assert len([n for n in sizes if n.endswith("-records")]) == 3
