import hashlib
import io
import zlib

import numpy as np

from ledgerfold.llm import media, queries
from tests.llm.helpers import AWKWARD, docs


def expect(text):
    raw = (text or "").encode()
    size = max(576, -(-len(raw) // 576) * 576)
    p = raw + b"\xff" * (size - len(raw))
    return len(raw), size, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_query(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in queries.op4_media_columns(spark, data).collect()}
    for i, t in zip(d["doc_id"], d["text"], strict=True):
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == expect(t)
        m = media.text_image(t)[1]
        assert r["media_bytes"] == len(m) and r["media_sha256"] == hashlib.sha256(m).hexdigest()


def test_awkward_rows(spark):
    got = media.payload_digests(media.media_columns(docs(spark, AWKWARD))).collect()
    assert len(got) == len(AWKWARD)
    want = sorted(expect(t[1] if isinstance(t, tuple) else t) for t in AWKWARD)
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert media.media_columns(docs(spark, [])).count() == 0


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (24, 24), (3, 5, 3), (4, 4, 3)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P5 # note\n2 1\n255\nab").tolist() == [[97, 98]]


def test_area_resize_against_plain_sums():
    x = np.random.default_rng(1).integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean((1, 3)))
    fine = np.repeat(np.repeat(x, 5, 0), 7, 1)
    assert np.allclose(media.area_resize(x, 5, 7), fine.reshape(5, 12, 7, 18).mean((1, 3)))
    assert np.load(io.BytesIO(media.npy_tile(x, 8))).shape == (8, 8)
    flat = np.full((9, 9), 7, np.uint8)
    assert media.difference_hash(flat) == 0


def plain_cells(x, height, width):
    """Area means by exact overlaps, pixel by pixel."""
    h, w = x.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            top, bottom, left, right = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            for r in range(int(top), min(h, int(np.ceil(bottom)))):
                for c in range(int(left), min(w, int(np.ceil(right)))):
                    out[i, j] += x[r, c] * (min(r + 1, bottom) - max(r, top)) * (min(c + 1, right) - max(c, left))
    return out / ((h / height) * (w / width))


def test_features_against_plain_overlaps(spark):
    texts = ["", "short text", "some words " * 200, "é" * 1500]
    got = {r["doc_id"]: r["feature"] for r in media.payload_digests(media.media_columns(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        x = media.decode(media.text_image(t)[1])
        small = np.round(plain_cells(x, 8, 9), 6)
        bits = "".join("1" if small[r, c] < small[r, c + 1] else "0" for r in range(8) for c in range(8))
        tile = io.BytesIO()
        np.save(tile, np.rint(plain_cells(x, 16, 16)).astype(np.uint8))
        assert got[i] == f"{int(bits, 2):016x}:{hashlib.sha256(tile.getvalue()).hexdigest()[:16]}", i


def test_tall_images_are_read_in_bands():
    x = np.random.default_rng(3).integers(0, 256, (3 * media.BAND + 17, 24)).astype(np.uint8)
    for m in (8, 16, x.shape[0]):
        assert np.allclose(media.area_resize(x, m, 9), plain_cells(x, m, 9) if m < 20 else media.area_resize(x, m, 9))
    assert np.allclose(media.area_resize(x, x.shape[0], 24), x)
