"""Media columns: texts stored as lossless WebP images, and image columns decoded to pixel arrays.

All work is row by row in one pass without a shuffle; an Arrow batch bounds a worker's memory.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import webp, webp_writer
from loamwork.llm.common import documents, id_text, map_rows

#: Bytes of payload are a multiple of this: a row of as many grey pixels.
ROW_BYTES = 192


def payload_of(text: str) -> bytes:
    """UTF-8, filled up with bytes 32 to a positive multiple of ROW_BYTES."""
    raw = text.encode()
    return raw + b" " * (max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES) - len(raw))


def image_of(payload: bytes) -> np.ndarray:
    """A grey pixel for each byte, 192 in a row, or more where the format's height would not do; then the last row is
    filled with transparent pixels, and there is an alpha sample."""
    grey = np.frombuffer(payload, np.uint8)
    width = ROW_BYTES * -(-len(grey) // (ROW_BYTES * webp.MAX_SIDE))
    if width > webp.MAX_SIDE:
        raise webp.WebpError(f"no image holds {len(grey)} bytes")
    rows = -(-len(grey) // width)
    if rows * width == len(grey):
        return np.broadcast_to(grey.reshape(rows, width, 1), (rows, width, 3))
    out = np.zeros((rows * width, 4), dtype=np.uint8)
    out[: len(grey), :3] = grey[:, None]
    out[: len(grey), 3] = 255
    return out.reshape(rows, width, 4)


def samples_of(pixels: np.ndarray) -> bytes:
    """The payload back from decoded pixels."""
    flat = pixels.reshape(-1, 4)
    filled = int((flat[-pixels.shape[1] :, 3] == 0).sum())
    return flat[: len(flat) - filled, 1].tobytes()


def feature_of(pixels: np.ndarray) -> str:
    """Size, the samples' mean and spread in thousandths, and a 64-bit difference hash of 8 x 9 block means (filling included)."""
    height, width = pixels.shape[:2]
    grey = np.ascontiguousarray(pixels[:, :, 1]).ravel().astype(np.int64)
    edges = np.arange(73) * len(grey) // 72
    grid = (np.add.reduceat(grey, edges[:-1]) / np.diff(edges)).reshape(8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    mean = grey.sum() / len(grey)
    spread = (max(0.0, (grey * grey).sum() / len(grey) - mean * mean)) ** 0.5
    return f"{width}x{height};mean={int(mean * 1000 + 0.5)};std={int(spread * 1000 + 0.5)};dhash={np.packbits(bits).tobytes().hex()}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (before filling) and media (a lossless WebP file) of each text; a null text is empty.

    Repeated rows each give a row; an empty table gives none; other columns are ignored.  A text of over
    16,320 x 16,384 bytes (267 MB), which no one image holds, raises; a row of Spark's holds 2 GB at most.
    """

    def store(ids: list[int], texts: list[str]) -> dict:
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "media": [webp_writer.encode(image_of(payload_of(t))) for t in texts]}

    return map_rows(id_text(docs), ["doc_id", "text"], store, "doc_id long, n_bytes long, media binary")


def decode_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, width, height, pixels (red, green, blue, alpha in rows; binary) and error of each file of a media column.

    A null file gives nulls; a file that is not a lossless WebP stream gives nulls and the reason in error.
    """

    def read(keys: list, files: list) -> dict:
        out: dict[str, list] = {"key": keys, "width": [], "height": [], "pixels": [], "error": []}
        for data in files:
            pixels, error = None, None
            if data is not None:
                try:
                    pixels = webp.decode(data)
                except webp.WebpError as e:
                    error = str(e)
            out["width"].append(None if pixels is None else pixels.shape[1])
            out["height"].append(None if pixels is None else pixels.shape[0])
            out["pixels"].append(None if pixels is None else pixels.tobytes())
            out["error"].append(error)
        return out

    got = df.selectExpr(f"cast(`{key}` as long) as key", f"`{media}` as media")
    return map_rows(got, ["key", "media"], read, "key long, width long, height long, pixels binary, error string").withColumnRenamed("key", key)


def media_digest(docs: DataFrame) -> DataFrame:
    """store_texts() and decode_media() in one step, with what is read back as digests and a feature string.

    Null is the empty text, which is stored as 192 bytes 32.  Equal texts give equal rows but for doc_id, null or not;
    repeated rows each give a row; an empty table gives none; other columns are ignored.
    """

    def digest(ids: list[int], texts: list[str]) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        done: dict[str, tuple] = {}  # a batch's equal texts once
        for doc_id, text in zip(ids, texts):
            if text not in done:
                media = webp_writer.encode(image_of(payload_of(text)))
                pixels = webp.decode(media)
                payload = samples_of(pixels)
                done[text] = (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pixels))
            for k, v in zip(out, (doc_id, *done[text])):
                out[k].append(v)
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(id_text(docs), ["doc_id", "text"], digest, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(documents(spark, sf_dir))
