import json
import os
import random

import pytest

from zonewatch.sources import readers
from zonewatch.sources.documents import Marks, Scan, read_elements


def document(rng, n):
    odd = ['plain', 'a } b', '"quoted" \\ }{', '{"x": [', '\\', 'é\n}', '', '": {']
    thing = lambda i: {"id": i, "file_name": rng.choice(odd), "more": {"a}": {"b": [1, {}]}, "rle": rng.choice(odd)}}
    return {"info": {"version": "1.0", "by": {"who": "}"}}, "note": "x", "images": [thing(i) for i in range(n)], "empty": [],
            "annotations": [{**thing(i), "image_id": i, "bbox": [1.5, 2.0, float(i), 0.25]} for i in range(2 * n)],
            "categories": [thing(i) for i in range(2)], "last": "annotations"}


@pytest.mark.parametrize("size,indent", [(90, None), (700, 2), (100_000, None)])
def test_any_cut(spark, tmp_path, size, indent):
    """Whatever the ranges are, also shorter than an element, the elements are those of the documents."""
    rng, want = random.Random(size), []
    for k in range(3):
        doc = document(rng, [0, 2, 9][k])
        (tmp_path / f"d{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=k == 1) + "\n" * k, encoding="utf-8")
        for key, values in doc.items():
            want += [(f"d{k}.json", key, v) for v in ([values] if isinstance(values, dict) else values if isinstance(values, list) else [])]
    settings = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = [(os.path.basename(r["path"]), r["key"], json.loads(r["element"])) for r in read_elements(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1], json.dumps(r[2], sort_keys=True)))
    assert order(got) == order(want)


def test_split_reader_is_the_whole_reader(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(document(random.Random(1), 30)))
    for a, b in zip(readers.read_coco(spark, str(tmp_path), "S"), readers.read_coco(spark, str(tmp_path), "S", split=False)):
        assert a.schema.simpleString() == b.schema.simpleString()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


def test_a_stretch_in_array_steps_is_the_text_step_by_step():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(['"', '\\\\', '\\"', "{", "}", ":", " ", "k", ","]) for _ in range(rng.randint(1, 60))) + "}"
        inside, depth, escaped, want = bool(rng.randint(0, 1)), 0, False, []
        scan, whole = Scan(inside, depth), Scan(inside, depth)
        for i, c in enumerate(text):
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = not inside
            elif c in "{}" and not inside:
                depth += 1 if c == "{" else -1
                want.append((i, 1 if c == "{" else -1, depth))
        got = whole.stretch(Marks(text.encode()))
        assert list(zip(*(x.tolist() for x in got))) == want and (whole.inside, whole.depth) == (inside, depth)
        for piece in text.split("}")[:-1]:
            scan.stretch(Marks((piece + "}").encode()))
        assert (scan.inside, scan.depth, scan.keys) == (whole.inside, whole.depth, whole.keys)


def test_elements_are_parsed_once(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(document(random.Random(1), 30)))
    images, marks, _ = readers.read_coco(spark, str(tmp_path), "S")
    plan = marks.join(images, ["source", "image_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 2  # one for each kind
