import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framewright.functions.json_schema import SchemaError
from framewright.model import Dataset
from framewright.operators.quality import assert_datasets_equal, full_check, invalid_images
from framewright.sources import readers, writers
from framewright.sources.common import header_size
from framewright.synthetic import dummy_dataset


def png(path, w, h):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + b"\0" * (3 * w) for _ in range(h))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def small(spark):
    return dummy_dataset(spark, 6, 20, split_names=["train", "valid"], confidence=True, attributes={"attributes.color": ["red", "blue"]})


def boxes(ds):
    return sorted((r["relative_path"], r["category_str"], *(round(r[c], 3) for c in ("box_x_min", "box_y_min", "box_width", "box_height"))) for r in ds.annotations.join(ds.images.select(F.col("id").alias("i"), "relative_path"), F.col("image_id") == F.col("i")).collect())


def test_coco_round_trip(spark, small, tmp_path):
    files = writers.to_coco(small, str(tmp_path))
    assert len(files) == 2
    back = readers.from_coco(spark, files[0])
    want = small.get_split("train")
    assert boxes(back) == boxes(want)
    assert back.label_map == small.label_map
    assert "confidence" in back.annotations.columns
    for fmt in ("XYXY", "cxcywh"):
        out = writers.to_coco(want, str(tmp_path / f"{fmt}.json"), fmt=fmt)
        assert boxes(readers.from_coco(spark, out[0], box_format=fmt)) == boxes(want)
    with pytest.raises(FileExistsError):
        writers.to_coco(small, str(tmp_path))


def test_coco_without_parts(spark, tmp_path):
    image = {"id": 1, "file_name": "a.jpg", "width": 10, "height": 10}
    p = tmp_path / "instances_val.json"
    p.write_text(json.dumps({"images": [image]}))
    ds = readers.from_coco(spark, str(p))
    assert ds.len_annot() == 0 and ds.label_map == {} and ds.images.first()["split"] == "valid"
    p.write_text(json.dumps({"images": [image], "annotations": [{"id": 0, "image_id": 1, "bbox": [3.0, 4.0]}]}))
    point = readers.from_coco_keypoints(spark, str(p)).annotations.first()
    assert (point["box_x_min"], point["box_y_min"], point["box_width"], point["category_str"]) == (3.0, 4.0, 0.0, "head")
    p.write_text(json.dumps({"images": [image], "categories": [{"id": 1, "name": "x"}], "annotations": [{"id": 0, "image_id": 1, "category_id": 1, "iscrowd": 1, "bbox": [1, 2, 3, 4]}, {"id": 1, "image_id": 1, "category_id": None, "iscrowd": 0, "bbox": [1, 2, 3, 4]}, {"id": 2, "image_id": 1, "category_id": 1, "iscrowd": 0, "bbox": [1, 2, 3, 4]}]}))
    with pytest.raises(ValueError, match="no category"):
        readers.from_coco(spark, str(p))


def test_image_json_round_trip(spark, small, tmp_path):
    writers.to_image_json(small, str(tmp_path))
    back = readers.from_image_json(spark, str(tmp_path))
    assert sorted(b[1:] for b in boxes(back)) == sorted(b[1:] for b in boxes(small))
    assert "attributes.color" in back.annotations.columns
    assert {r[0] for r in back.images.select("split").distinct().collect()} == {"train", "valid"}


def test_image_json_schema(spark, tmp_path):
    doc = {"image": {"id": 3, "file_name": "a.jpg", "width": 9, "height": 9, "tags": {"time": "day"}}, "type": "instances", "annotations": [{"id": 0, "category_id": 2, "category_str": "person", "bbox": [1, 2, 3, 4], "attributes": {"colors": ["red"], "occluded": True}}, {"id": 1, "category_id": 2, "category_str": "person", "bbox": [1, 2]}]}
    d = tmp_path / "Annotations"
    d.mkdir()
    (d / "a.json").write_text(json.dumps(doc))
    ds = readers.from_image_json(spark, str(tmp_path), use_schema=True)
    got = {r["id"]: r for r in ds.annotations.collect()}
    assert got[0]["attributes.colors.red"] is True and got[1]["attributes.colors.red"] is False and got[0]["attributes.occluded"] is True
    assert got[1]["box_width"] == 0 and len(ds.booleanized["attributes.colors"]) == 13
    content = json.loads(writers.image_json_rows(ds).first()["content"])
    assert content["annotations"][0]["attributes"] == {"colors": ["red"], "occluded": True} and "attributes" not in content["annotations"][1]
    doc["annotations"][0]["attributes"]["colors"] = ["mauve"]
    (d / "a.json").write_text(json.dumps(doc))
    with pytest.raises(SchemaError):
        readers.from_image_json(spark, str(tmp_path), use_schema=True)


def test_darknet_round_trips(spark, small, tmp_path):
    info = small.images.select("relative_path", "id", "width", "height")
    for version in (4, 5, 7):
        out = str(tmp_path / f"v{version}")
        writers.to_darknet(small, out, version, copy_images=None)
        folder = "data/" if version < 5 else "images/"
        moved = info.withColumn("relative_path", F.concat(F.lit(folder), "relative_path"))
        ds = readers.from_darknet(spark, out, f"{out}/data.yaml" if version > 4 else None, ids_map=f"{out}/ids_map.json", image_info=moved)
        assert [b[1:] for b in boxes(ds)] == [b[1:] for b in boxes(small)], version
        assert {r[0] for r in ds.images.select("split").distinct().collect()} == {"train", "valid"}
    assert readers.label_path("a/images/b/images/c.jpg") == "a/images/b/labels/c.txt"


def test_darknet_headers_and_json(spark, tmp_path):
    png(str(tmp_path / "a.png"), 40, 20)
    png(str(tmp_path / "b.png"), 10, 10)
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.25 0.5\n")
    ds = readers.from_darknet_generic(spark, str(tmp_path), names=["x"])
    r = ds.annotations.first()
    assert (r["box_x_min"], r["box_y_min"], r["box_width"], r["box_height"], r["category_str"]) == (15, 5, 10, 10, "x")
    frames = [{"filename": f"{tmp_path}/a.png", "objects": [{"class_id": 0, "name": "x", "relative_coordinates": {"center_x": 0.5, "center_y": 0.5, "width": 0.5, "height": 0.5}, "confidence": 0.7}]}]
    (tmp_path / "out.json").write_text(json.dumps(frames))
    info = ds.images.select("relative_path", "id", "width", "height")
    pred = readers.from_darknet_json(spark, str(tmp_path), str(tmp_path / "out.json"), image_info=info)
    assert len(pred) == 2 and pred.annotations.first()["confidence"] == 0.7
    assert readers.from_folder(spark, str(tmp_path)).images.count() == 2
    assert readers.from_files(spark, str(tmp_path), ["a*.png"]).images.count() == 1
    (tmp_path / "c.png").write_bytes(b"nothing")
    bad = invalid_images(readers.from_folder(spark, str(tmp_path)))
    assert [tuple(x)[1:] for x in bad.collect()] == [("c.png", "unreadable file")]
    assert header_size(b"GIF89a" + struct.pack("<HH", 7, 8)) == (7, 8) and header_size(b"x") is None


def test_pascal_voc(spark, tmp_path):
    (tmp_path / "Annotations").mkdir()
    (tmp_path / "ImageSets/Main").mkdir(parents=True)
    box = lambda a, b, c, d: f"<bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{d}</ymax></bndbox>"
    for n in ("one", "two"):
        obj = f"<object><name>person</name>{box(1, 2, 11, 22)}<difficult>1</difficult><occluded>0</occluded><truncated>0</truncated><pose>Left</pose><part><name>head</name>{box(1, 2, 5, 6)}</part></object><object><name>cat</name>{box(0, 0, 4, 4)}</object>"
        (tmp_path / f"Annotations/{n}.xml").write_text(f"<annotation><filename>{n}.jpg</filename><folder>f</folder>{obj if n == 'one' else ''}<size><width>50</width><height>40</height><depth>3</depth></size><segmented>0</segmented></annotation>")
    (tmp_path / "ImageSets/Main/train.txt").write_text("one\n")
    ds = readers.from_pascal_voc(spark, str(tmp_path))
    assert [r["relative_path"] for r in ds.images.collect()] == ["one.jpg"]
    got = {r["category_str"]: r for r in ds.annotations.collect()}
    assert got["person"]["difficult"] is True and got["person"]["box_width"] == 10 and got["head"]["body_id"] == got["person"]["id"] and got["cat"]["body_id"] is None
    assert ds.label_map == {0: "cat", 1: "head", 2: "person"}


def test_mot_and_crowd_human(spark, tmp_path):
    info = spark.createDataFrame([(1, "1.jpg", 100, 100), (2, "x.jpg", 100, 100)], "id bigint, relative_path string, width int, height int")
    (tmp_path / "gt.txt").write_text("1,5,1.0,2.0,3.0,4.0,1,1,1.0\n1,6,1.0,2.0,3.0,4.0,0,1,1.0\n")
    ds = readers.from_mot(spark, str(tmp_path / "gt.txt"), image_info=info)
    assert ds.len_annot() == 1 and "confidence" not in ds.annotations.columns and ds.annotations.first()["object_id"] == 5
    line = {"ID": "x", "gtboxes": [{"fbox": [-5, 0, 20, 10], "vbox": [0, 0, 10, 10], "hbox": [1, 1, 2, 2], "tag": "person", "extra": {"box_id": 0, "occ": 0}, "head_attr": {"ignore": 0, "occ": 0}}, {"fbox": [0, 0, 1, 1], "vbox": [0, 0, 1, 1], "hbox": [1, 1, 2, 2], "tag": "mask", "extra": {"ignore": 1}}]}
    (tmp_path / "a.odgt").write_text(json.dumps(line) + "\n")
    ds = readers.from_crowd_human(spark, str(tmp_path / "a.odgt"), ".", visible_box=False, image_info=info)
    got = {r["category_str"]: r for r in ds.annotations.collect()}
    assert set(got) == {"person", "head"} and got["person"]["visible_share"] == 0.5 and got["person"]["box_x_min"] == 0 and got["head"]["unsure"] == 0


def test_archive(spark, small, tmp_path):
    writers.to_parquet(small, str(tmp_path / "a"))
    back = writers.from_parquet(spark, str(tmp_path / "a"))
    assert_datasets_equal(small, back)
    assert back.dataset_name == "dummy" and back.label_map == small.label_map
    with pytest.raises(OSError):
        writers.to_parquet(small, str(tmp_path / "a"))
    with pytest.raises(AssertionError):
        assert_datasets_equal(small, back.filter_images("id > 0"))
    full_check(small, check_images=False)
    docs = [json.loads(r["content"]) for r in writers.sample_documents(small).collect()]
    assert len(docs) == 6 and all("attr->color" in x for d in docs for x in d.get("groundtruth", []))


def test_command_line(spark, small, tmp_path):
    from framewright import cli

    writers.to_image_json(small, str(tmp_path / "in"))
    cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--watch", "--once"])
    docs = [json.load(open(os.path.join(r, f))) for r, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".json")]
    assert len(docs) == 6 and sum(len(d.get("groundtruth", [])) for d in docs) == 20
    part = small.filter_images("id < 2")
    cli.push(part, small, str(tmp_path / "out2"))
    assert sum(f.endswith(".json") for _, _, fs in os.walk(tmp_path / "out2") for f in fs) == 2


SCHEMA = {
    "type": "object",
    "properties": {
        "a": {"type": "integer"}, "b": {"type": "string", "default": "x"}, "c": {"type": "array", "items": {"type": "string"}}, "need": {"type": "integer", "default": 4},
        "o": {"type": "object", "properties": {"set": {"type": "array", "uniqueItems": True, "items": {"enum": ["u", "v"]}}, "list": {"type": "array", "items": {"enum": ["u", "v"]}}, "flag": {"type": "boolean"}}, "required": ["flag"]},
    },
    "required": ["need"],
}


def test_schema_helpers(spark, tmp_path):
    from framewright.functions import json_schema as J

    assert J.enum_arrays(SCHEMA) == {"o.set": ["u", "v"]} and J.enum_arrays(SCHEMA, ignore_pattern="s.*") == {}
    known = J.defaults_and_types(SCHEMA)
    assert known["a"] == ("bigint", None) and known["b"] == ("string", "x") and known["c"] == ("array<string>", []) and known["need"] == ("bigint", None)
    assert known["o.set"] == ("array<string>", []) and known["o.flag"] == ("boolean", None)
    df = spark.createDataFrame([(1, None, None, None), (2, "y", ["q"], 7)], "id bigint, b string, c array<string>, a int")
    assert [tuple(r) for r in J.fill_defaults(SCHEMA, df).orderBy("id").collect()] == [(1, "x", [], None), (2, "y", ["q"], 7)]
    assert J.schema_tree(SCHEMA)["o"] == {"set": "o.set", "list": "o.list", "flag": "o.flag"}
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    assert J.load_schema(str(tmp_path / "s.json")) == SCHEMA and J.load_schema("default") is J.DEFAULT_SCHEMA


def test_schema_by_url(tmp_path):
    import functools
    import http.server
    import threading

    from framewright.functions import json_schema as J

    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *a: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert J.load_schema(f"http://127.0.0.1:{server.server_port}/s.json") == SCHEMA
    server.shutdown()


def test_sizes_of_more_kinds():
    import struct

    from framewright.sources.common import header_size

    tiff = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480)
    big = b"MM\x00*" + struct.pack(">I", 8) + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 640, 0) + struct.pack(">HHII", 257, 4, 1, 480)
    assert header_size(tiff) == header_size(big) == (640, 480) and header_size(tiff[:20]) is None
    assert header_size(b"P6\n# a note\n7 9\n255\n") == (7, 9) and header_size(b"P5 3 4 255 ") == (3, 4) and header_size(b"P9 3 4") is None


def picture(width, height):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + b"\x40" * width * 3 for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_image_checks(spark, tmp_path):
    from framewright.operators.quality import remove_invalid_images

    root = tmp_path / "images"
    root.mkdir()
    (root / "a.png").write_bytes(picture(4, 3))
    (root / "cut.png").write_bytes(picture(400, 300)[:60])
    (root / "b.png").write_bytes(picture(5, 3))
    os.symlink(root / "a.png", root / "link.png")
    rows = [(1, 4, 3, "a.png"), (2, 4, 3, "b.png"), (3, 400, 300, "cut.png"), (4, 4, 3, "link.png"), (5, 4, 3, "none.png"), (6, 4, 3, "/abs.png"), (7, 0, 3, "a.png")]
    ds = Dataset.build(spark.createDataFrame(rows, "id bigint, width int, height int, relative_path string"), None, {}, str(root))
    reasons = lambda **how: {r["id"]: r["reason"] for r in invalid_images(ds, **how).collect()}
    plain = {2: "other size", 5: "missing file", 6: "absolute path", 7: "other size"}
    assert reasons() == plain
    assert reasons(load_images=True) == plain | {3: "corrupted file", 7: "invalid width"}
    assert reasons(check_symlink=True) == {i: "not a symlink" for i in (1, 2, 3, 5, 7)} | {6: "absolute path"}
    assert sorted(r["id"] for r in remove_invalid_images(ds, load_images=True).images.collect()) == [1, 4]


def test_writer_options(spark, tmp_path):
    images = spark.createDataFrame([(1, 4, 3, "train/x/a.png", "train", "odd"), (2, 4, 3, "b.jpg", "train", None)], "id bigint, width int, height int, relative_path string, split string, strange string")
    notes = spark.createDataFrame([(1, 1, 0, 1.0, 1.0, 1.0, 1.0, "w")], "id bigint, image_id bigint, category_id int, box_x_min double, box_y_min double, box_width double, box_height double, extra string")
    root = tmp_path / "images"
    (root / "train/x").mkdir(parents=True)
    (root / "train/x/a.png").write_bytes(picture(4, 3))
    (root / "b.jpg").write_bytes(b"\xff\xd8 no picture")
    ds = Dataset.build(images, notes, {0: "a"}, str(root))
    with pytest.warns(RuntimeWarning, match="strange"):
        writers.to_image_json(ds, str(tmp_path / "out"), "copy", use_schema=True, flatten_paths=True)
    doc = json.loads((tmp_path / "out/Annotations/train/x_a.json").read_text())
    assert "strange" not in doc["image"] and "extra" not in doc["annotations"][0] and doc["image"]["file_name"] == "x_a.png"
    assert sorted(os.listdir(tmp_path / "out/Images/train")) == ["b.jpg", "x_a.png"]
    (tmp_path / "out/Annotations/train/x_a.json").write_text("mine")
    (tmp_path / "out/Images/train/b.jpg").write_bytes(b"mine")
    with pytest.raises(FileExistsError):
        writers.to_image_json(ds, str(tmp_path / "out"))
    writers.to_image_json(ds, str(tmp_path / "out"), "link", overwrite=True, overwrite_labels=False, overwrite_images=False, flatten_paths=True)
    assert (tmp_path / "out/Annotations/train/x_a.json").read_text() == "mine" and (tmp_path / "out/Images/train/b.jpg").read_bytes() == b"mine"
    writers.to_image_json(ds, str(tmp_path / "out"), "link", overwrite=True, flatten_paths=True)
    assert os.path.islink(tmp_path / "out/Images/train/b.jpg") and (tmp_path / "out/Images/train/x_a.png").read_bytes() == picture(4, 3)
    import importlib.util

    if importlib.util.find_spec("PIL") is None:
        with pytest.raises(RuntimeError, match="Pillow"):
            writers.to_coco(ds, str(tmp_path / "coco"), "copy", to_jpg=True)
    one = writers.to_coco(ds.filter_images("id = 2"), str(tmp_path / "coco2"), "copy", to_jpg=True)
    assert json.loads(open(one[0]).read())["images"][0]["file_name"] == "b.jpg" and os.path.exists(tmp_path / "coco2/data/b.jpg")


def test_dataset_regression_fixture(spark, tmp_path, dataset_regression):
    images = spark.createDataFrame([(1, 4, 3, "a.png")], "id bigint, width int, height int, relative_path string")
    (tmp_path / "a.png").write_bytes(picture(4, 3))
    ds = Dataset.build(images, None, {}, str(tmp_path))
    with pytest.raises(pytest.fail.Exception, match="has been stored"):
        dataset_regression.check(ds, "one", str(tmp_path / "kept"), check_images=True)
    dataset_regression.check(ds, "one", str(tmp_path / "kept"), check_images=True)
    (tmp_path / "a.png").write_bytes(picture(4, 4))
    with pytest.raises(AssertionError):
        dataset_regression.check(ds, "one", str(tmp_path / "kept"), check_images=True)


def no_sources(monkeypatch):
    """Spark's own file sources are not to be used, as they list every file on the driver."""
    from pyspark.sql import DataFrameReader

    for name in ("text", "json", "load"):
        monkeypatch.setattr(DataFrameReader, name, lambda *_, **__: pytest.fail("files listed on the driver"))


def test_label_files_are_opened_where_they_are_read(spark, tmp_path, monkeypatch):
    """Of many label files, those of hidden names too, none is listed."""
    (tmp_path / "labels" / "in").mkdir(parents=True)
    (tmp_path / "labels" / "in" / "_a.txt").write_text("1 0.5 0.5 0.5 0.5\r\n\n0 0.25 0.25 0.5 0.5\n")
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "b.txt").write_text("1 0.5 0.5 1 1")
    info = spark.createDataFrame([(7, "images/in/_a.jpg", 8, 4), (8, "images/b.jpg", 2, 2), (9, "images/none.jpg", 2, 2)], "id bigint, relative_path string, width int, height int")
    no_sources(monkeypatch)
    ds = readers.from_darknet_generic(spark, str(tmp_path), names=["x", "y"], image_info=info)
    assert boxes(ds) == [("images/b.jpg", "y", 0.0, 0.0, 2.0, 2.0), ("images/in/_a.jpg", "x", 0.0, 0.0, 4.0, 2.0), ("images/in/_a.jpg", "y", 2.0, 1.0, 4.0, 2.0)]
    assert ds.images.count() == 3


def test_darknet_lists_come_from_the_images(spark, small, tmp_path, monkeypatch):
    """The lists of images are made without the lines of the label files being made again."""
    made = []
    files_from = writers._files_from
    monkeypatch.setattr(writers, "_files_from", lambda *a: (files_from(*a), made.append(1)))
    monkeypatch.setattr(writers, "darknet_lines", lambda ds, f=writers.darknet_lines: (lambda rows, dense: (rows.withColumn("split", F.when(F.rand() >= 0, F.lit("lost"))), dense))(*f(ds)))
    writers.to_darknet(small, str(tmp_path), 4, copy_images=None)
    assert made == [1] and (tmp_path / "train.txt").exists() and not (tmp_path / "lost.txt").exists()
    listed = [x for n in ("train", "val") for x in (tmp_path / f"{n}.txt").read_text().split()]
    assert sorted(listed) == sorted(f"data/{r[0]}" for r in small.images.select("relative_path").collect())


def test_image_json_files_are_read_once(spark, tmp_path, monkeypatch):
    for n, (place, name) in enumerate((("train", "a b%+.json"), ("train/deep", "c.json"))):
        (tmp_path / "Annotations" / place).mkdir(parents=True, exist_ok=True)
        doc = {"image": {"id": n, "file_name": name.replace(".json", ".jpg"), "width": 9, "height": 9}, "type": "instances", "annotations": [{"id": n, "category_id": 1, "category_str": "x", "bbox": [1, 2, 3, 4]}]}
        (tmp_path / "Annotations" / place / name).write_text("\ufeff" * n + json.dumps(doc, indent=1))
    (tmp_path / "Annotations" / "train" / "empty.json").write_text("\n")
    no_sources(monkeypatch)
    # what is kept is read as parquet, which is a method of its own
    ds = readers.from_image_json(spark, str(tmp_path))
    assert boxes(ds) == [("train/a b%+.jpg", "x", 1.0, 2.0, 3.0, 4.0), ("train/deep/c.jpg", "x", 1.0, 2.0, 3.0, 4.0)]
    (tmp_path / "Annotations" / "train" / "bad.json").write_text("{")
    with pytest.raises(ValueError, match="bad.json"):
        readers.from_image_json(spark, str(tmp_path))


def test_voc_files_are_read_once(spark, tmp_path, monkeypatch):
    one = lambda name, x: f"<?xml version='1.0'?><!-- <annotation></annotation> --><annotation verified='yes'><filename>{name}</filename><size><width>9</width><height>8</height><depth>3</depth></size><object><name>cat</name><difficult>1</difficult><bndbox><xmin>{x}</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object></annotation>"
    (tmp_path / "a.xml").write_text(one("a.jpg", 1))
    (tmp_path / "b.xml").write_text(one("b.jpg", 2))
    no_sources(monkeypatch)
    ds = readers.from_pascal_voc_generic(spark, str(tmp_path), "images")
    assert boxes(ds) == [("a.jpg", "cat", 1.0, 2.0, 4.0, 4.0), ("b.jpg", "cat", 2.0, 2.0, 3.0, 4.0)]
    assert all(r["difficult"] for r in ds.annotations.collect()) and ds.images.first()["height"] == 8


def test_files_are_made_apart_and_moved(spark, tmp_path):
    """No name beside the file's own is made in its folder, so the longest names there can be are written, and nothing else is left."""
    names = [f"data/{'x' * 246}{i:05}.txt"[: 5 + 255] for i in range(40)]
    rows = spark.createDataFrame([(n, None if i == 3 else f"é{i}\n") for i, n in enumerate(names)], "path string, content string").coalesce(1)
    writers._files_from(rows, str(tmp_path))
    writers._files_from(rows.withColumn("content", F.lit("new")).limit(2), str(tmp_path), keep=True)
    assert [p.name for p in tmp_path.iterdir()] == ["data"] and sorted(f"data/{p.name}" for p in (tmp_path / "data").iterdir()) == sorted(names)
    assert [(tmp_path / n).read_text(encoding="utf-8") for n in names] == ["" if i == 3 else f"é{i}\n" for i in range(40)]


def test_darknet_lists_are_read_at_once(spark, small, rows, tmp_path, monkeypatch):
    """Lists without common images are read in one pass, and give what they give one by one."""
    out = str(tmp_path / "d")
    split = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("eval")), (F.col("id") % 3 + 1).cast("int"))
    ds = Dataset.build(small.images.withColumn("split", split), small.annotations.drop("split"), small.label_map)
    writers.to_darknet(ds, out, 4, copy_images=None)
    info = ds.images.select("id", "width", "height", F.concat(F.lit("data/"), "relative_path").alias("relative_path"))
    read = lambda: readers.from_darknet(spark, out, ids_map=f"{out}/ids_map.json", image_info=info)
    with monkeypatch.context() as m:
        m.setattr(readers, "_lists_at_once", lambda *_: None)
        want = read()
    with monkeypatch.context() as m:
        m.setattr(readers, "merge", lambda *_: pytest.fail("lists are joined one by one"))
        got = read()
    assert (got.images.columns, got.annotations.columns, got.label_map, got.images_root, got.dataset_name) == (want.images.columns, want.annotations.columns, want.label_map, want.images_root, want.dataset_name)
    assert rows(got.images) == rows(want.images) and rows(got.annotations) == rows(want.annotations) and len(rows(got.annotations)) == small.len_annot()
    with open(f"{out}/train.txt", "a") as f:
        f.write(open(f"{out}/test.txt").read())
    assert len(read().images.collect()) > len(rows(got.images))
