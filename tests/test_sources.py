import json

from assayer.sources import files


def test_media_files(spark, tmp_path):
    for name in ("a.PNG", "b.mp4", "c.txt", "sub/d.jpg"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * 5)
    flat = files.media_files(spark, str(tmp_path)).collect()
    assert {(r.file, r.kind, r.size) for r in flat} == {("a.PNG", "image", 5), ("b.mp4", "video", 5)}
    assert files.media_files(spark, str(tmp_path), True).count() == 3


def test_manifests_and_captions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "concept_type": "style", "items": [{"file": "x.png", "enabled": False}]}))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "x.txt").write_text("  a caption\n")
    got = {r.path[-6:]: r for r in files.manifests(spark, str(tmp_path / "*.json")).collect()}
    assert got["a.json"].concept_type == "style" and got["a.json"]["items"][0].file == "x.png"
    assert got["b.json"].concept_type == "identity" and got["b.json"]["items"] == []
    assert [(r.stem, r.caption.strip()) for r in files.captions(spark, str(tmp_path / "*.txt")).collect()] == [("x", "a caption")]


def test_links_overlay_children(spark, tmp_path):
    (tmp_path / "links.json").write_text(json.dumps({"a": "/elsewhere", "": "/x", "z": ""}))
    linked = files.links(spark, str(tmp_path / "links.json"))
    children = spark.createDataFrame([("a", "/here"), ("b", "/b"), ("_c", "/c")], "slug string, folder string")
    assert sorted(map(tuple, files.datasets(children, linked).collect())) == [("a", "/elsewhere", True), ("b", "/b", False)]


def test_artefact_headers(spark, tmp_path):
    head = json.dumps({"__metadata__": {"kind": "image", "n": 3}}).encode()
    (tmp_path / "good.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + b"data")
    (tmp_path / "bad.safetensors").write_bytes(b"\xff" * 30)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "no.safetensors").write_bytes(b"")
    got = {r.name: r for r in files.artefacts(spark, str(tmp_path)).collect()}
    assert got["good.safetensors"].metadata == {"kind": "image", "n": "3"} and got["good.safetensors"].error is None
    assert got["bad.safetensors"].error and set(got) == {"good.safetensors", "bad.safetensors"} and got["good.safetensors"].likely_empty


def test_sections(spark):
    text = ["# note", "one:", "  base: 'a/b'", "  paths: |", "    x", "    y", "two:", "  base: c"]
    df = spark.createDataFrame([("d", k, x) for k, x in enumerate(text)], "doc string, line_no long, line string")
    got = [tuple(r)[1:] for r in files.sections(spark, df).collect()]
    assert got == [("one", "base", "a/b"), ("one", "paths", "x"), ("one", "paths", "y"), ("two", "base", "c")]
