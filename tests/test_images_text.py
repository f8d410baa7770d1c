"""Image and text columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import fields, images, labels, text
from feedloom.sources import corpus, sinks
from feedloom.session import fresh_dir


def picture(height, width, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def array_of(row):
    return np.frombuffer(row.data, dtype=row.dtype).reshape(row.shape)


@pytest.fixture()
def image_dir(tmp_path):
    made = {}
    for label, (h, w) in {1: (6, 8), 2: (64, 64), 3: (200, 300)}.items():
        (tmp_path / f"label={label}").mkdir()
        made[label] = picture(h, w, label)
        (tmp_path / f"label={label}" / "p.png").write_bytes(images.encode_png(made[label]))
    return tmp_path, made


def filtered_png(pixels, kind):
    """PNG of an RGB picture with one row filter throughout."""
    import struct
    import zlib

    h, w, _ = pixels.shape
    flat = pixels.reshape(h, w * 3).astype(int)
    lines = bytearray()
    for y in range(h):
        lines.append(kind)
        for x in range(w * 3):
            left = flat[y, x - 3] if x >= 3 else 0
            up = flat[y - 1, x] if y else 0
            corner = flat[y - 1, x - 3] if y and x >= 3 else 0
            if kind == 4:
                p = left + up - corner
                near = min((abs(p - left), abs(p - up), abs(p - corner)))
                guess = left if near == abs(p - left) else up if near == abs(p - up) else corner
            else:
                guess = [0, left, up, (left + up) // 2][kind]
            lines.append((flat[y, x] - guess) % 256)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    p = picture(7, 9, kind)
    assert (images.decode_png(filtered_png(p, kind)) == p).all()


def test_gray_is_expanded():
    gray = picture(5, 5)[:, :, 0]
    out = images.decode_png(images.encode_png(gray))
    assert out.shape == (5, 5, 3) and all((out[:, :, c] == gray).all() for c in range(3))


def test_resize_keeps_constants_and_gradients():
    flat = np.full((64, 64, 3), 77, dtype=np.uint8)
    assert (images.resize_planes(flat) == 77).all()
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :, None] * 4, 64, axis=0).repeat(3, axis=2)
    grown = images.resize_planes(ramp)
    assert grown.shape == (3, 224, 224) and (np.diff(grown[0].astype(int), axis=1) >= 0).all()
    shrunk = images.resize_planes(np.full((300, 500, 3), 9, dtype=np.uint8), 224, 224)
    assert (shrunk == 9).all()
    same = picture(224, 224)
    assert (images.resize_planes(same) == same.transpose(2, 0, 1)).all()


def test_resize_of_two_pixels_by_hand():
    two = np.array([[[0] * 3, [100] * 3]], dtype=np.uint8)
    assert images.resize_planes(two, 1, 4)[0].tolist() == [[0, 25, 75, 100]]


def test_decode_job_with_a_broken_image(spark):
    good = picture(10, 12)
    rows = [(1, bytearray(images.encode_png(good))), (2, bytearray(images.encode_png(good)[:60])), (3, None), (4, bytearray(b"GIF89a"))]
    df = spark.createDataFrame(rows, "id long, jpg binary")
    usable, failed = images.split_errors(images.decode_images(df, "jpg"), "image")
    (row,) = usable.collect()
    assert row.id == 1 and (array_of(row.image) == good).all()
    assert {r.id for r in failed.collect()} == {2, 3, 4}
    small = images.decode_resize_images(df.where("id = 1"), "jpg", partitions=2).first().image
    assert small.shape == [3, 224, 224]
    floats = images.normalise_tensors(usable, "image", "x").first().x
    assert floats.dtype == "float32" and np.allclose(array_of(floats), good / 255.0)


def test_large_results_leave_in_pieces(spark):
    png = bytearray(images.encode_png(picture(16, 16)))
    df = spark.createDataFrame([(i, png) for i in range(300)], "id long, jpg binary").coalesce(1)
    out = images.decode_resize_images(df, "jpg").select("id", F.octet_length("image.data").alias("n"))
    assert {(r.id, r.n) for r in out.collect()} == {(i, 150_528) for i in range(300)}


def test_image_source_and_file_bytes_agree(spark, image_dir):
    where, made = image_dir
    decoded = images.from_image_source(corpus.read_labelled_images(spark, str(where)))
    for row in decoded.collect():
        assert (array_of(row.tensor) == made[row.label]).all()
    raw = fields.image_bytes(corpus.read_corpus(spark, "images", str(where)), "image")
    for row in images.decode_images(raw.select("label", "image_bytes"), "image_bytes").collect():
        assert (array_of(row.image) == made[row.label]).all()


def test_bytes_or_path(spark, image_dir):
    where, made = image_dir
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(where))
    path = files.first().path
    schema = "id long, image struct<bytes: binary, path: string>"
    df = spark.createDataFrame([(1, (bytearray(b"inline"), None)), (2, (None, path)), (3, (bytearray(b""), path)), (4, (None, None))], schema)
    got = {r.id: r.image_bytes for r in fields.image_bytes(df, "image", files=files).collect()}
    content = files.where(F.col("path") == path).first().content
    assert (bytes(got[1]), got[2], got[3], got[4]) == (b"inline", content, content, None)


def test_encode_round_trip_and_image_layouts(spark, image_dir):
    where, made = image_dir
    raw = fields.image_bytes(corpus.read_image_files(spark, str(where)), "image").select(
        (F.col("label").cast("long") - 1).alias("__id__"), F.col("image_bytes").alias("image"), "label"
    )
    again = images.encode_images(images.decode_images(raw, "image", "rgb"), "rgb").select("__id__", F.col("encoded").alias("image"), "label")
    paths = sinks.write_formats(again, fresh_dir(spark, "img"), "images", tar_rows=2)
    for row in images.decode_images(corpus.read_layout(spark, "tar", paths["tar"], "images"), "jpg").collect():
        assert (array_of(row.image) == made[int(row["__key__"]) + 1]).all()
    for row in images.decode_images(corpus.read_layout(spark, "indexed", paths["indexed"]), "image", "rgb").collect():
        assert (array_of(row.rgb) == made[row.label]).all()


def test_pair_layouts(spark):
    rows = [(i, bytearray(images.encode_png(picture(4, 4, i))), f"caption {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "__id__ long, jpg binary, txt string")
    paths = sinks.write_formats(df, fresh_dir(spark, "pair"), "image+text", tar_rows=2)
    tar = corpus.read_layout(spark, "tar", paths["tar"], "image+text").collect()
    idx = corpus.read_layout(spark, "indexed", paths["indexed"]).collect()
    want = sorted((t, bytes(j)) for _, j, t in rows)
    assert sorted((r.txt, bytes(r.jpg)) for r in tar) == sorted((r.txt, bytes(r.jpg)) for r in idx) == want


def test_decode_stays_above_the_shuffle(spark):
    """Encoded bytes cross the exchange, pictures do not."""
    from feedloom.operators.shuffle import shuffled_partitions

    df = spark.createDataFrame([(i, bytearray(images.encode_png(picture(4, 4)))) for i in range(8)], "__id__ long, jpg binary")
    job = images.decode_resize_images(shuffled_partitions(df, "__id__", 1, partitions=3), "jpg")
    plan = job._jdf.queryExecution().executedPlan().toString().splitlines()
    place = {what: next(i for i, line in enumerate(plan) if what in line) for what in ("MapInArrow", "Exchange rangepartitioning")}
    assert place["MapInArrow"] < place["Exchange rangepartitioning"]
    assert sum("Exchange" in line for line in plan) == 1


def test_char_tokens(spark):
    rows = [(0, ""), (1, "abc"), (2, "😀é"), (3, "z" * 200)]
    df = spark.createDataFrame(rows, "id long, text string").select(
        "id", text.char_tokens("text").alias("t"), text.token_count("text").alias("n"), text.sequence_count("text").alias("s")
    )
    whole = {i: [ord(c) % 50257 for c in t] for i, t in rows}
    for row in df.collect():
        assert row.t == whole[row.id] and row.n == len(row.t) and row.s == max(1, -(-len(row.t) // 128))
    cut = {}
    for row in text.token_sequences(df, "t").orderBy("id", "chunk").collect():
        assert len(row.t) == 128
        cut.setdefault(row.id, []).extend(row.t)
    for i, tokens in whole.items():
        assert cut[i] == tokens + [0] * (128 * max(1, -(-len(tokens) // 128)) - len(tokens))


def test_keys_keep_long_ids(spark):
    df = spark.createDataFrame([(7,), (123_456_789_012,)], "i long").select(text.sample_key("i").alias("k"))
    assert [r.k for r in df.collect()] == ["00000007", "123456789012"]


def test_meta_text(spark):
    df = spark.createDataFrame([("raw", ("a", 1), {"x": 1}, 5)], "s string, st struct<p: string, q: int>, m map<string,int>, n int")
    row = df.select(*[text.meta_text(f.name, f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(row) == ("raw", '{"p":"a","q":1}', '{"x":1}', "5")


def test_field_resolution(spark):
    df = spark.createDataFrame([("cap", bytearray(b"png"), bytearray(b"hi"))], "image string, img binary, txt binary")
    assert fields.image_column(df) == "img"
    assert df.select(fields.text_column(df).alias("t")).first().t == "hi"
    with pytest.raises(ValueError):
        fields.text_column(df.select("img"))


def test_bands(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (79.9,), (80.0,), (float("nan"),), (None,)], "v double")
    assert [r.b for r in df.select(labels.band(F.col("v"), [0, 50, 80]).alias("b")).collect()] == [-1, 0, 1, 1, 2, None, None]
