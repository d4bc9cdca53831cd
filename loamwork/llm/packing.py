"""Packing by power-of-two decomposition.

Each document's token sequence is cut into pieces whose lengths are powers of two: as many of the
longest length as fit, then one piece for each further binary digit of what is left, longest first.
A piece is a training sequence of its own; sequences of equal length form a bucket, from which batches
are drawn.  So no sequence crosses documents and none needs padding.

The work is one pass over the documents without a shuffle: the bucket is a column, and
``write_buckets`` lays the pieces out by it.  Memory is bounded by one Arrow batch and the word memo.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import documents, id_text, map_rows
from loamwork.llm.memo import Memo


class ByteBpe:
    """Token ids of a byte-level BPE, equal to those of the tokenizers library for ``json_path``.

    The vocabulary is also there as ranks, for which a faster encoder is installed.  A space with a
    non-space on either side always starts a pre-token, so the units between such spaces encode
    independently and are remembered.  Texts with other runs of white space are encoded whole, and texts
    that hold the string of a special token go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._library = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._first = Memo(lambda unit: self._unit("", unit), half=20_000)
        self._later = Memo(lambda unit: self._unit(" ", unit))

    def _unit(self, lead: str, unit: str):
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return False  # the neighbouring spaces belong together
        return self._pack(self._fast.encode_ordinary(lead + unit))

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self._special):
            return self._pack(self._library.encode(text, add_special_tokens=False).ids)
        first, *later = text.split(" ")
        units = [self._first[first], *map(self._later.__getitem__, later)]
        if False in units:
            return self._pack(self._fast.encode_ordinary(text))
        return b"".join(units)


@functools.lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str) -> ByteBpe:
    return ByteBpe(json_path, ranks_path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two of at most ``longest``, in falling order."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, longest: int = 2048, end_id: int = 1, json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, bucket, ids_crc32, doc_tokens, sequence_id, offset and,
    with keep_ids, ids (binary, little-endian unsigned 32-bit).

    ``longest`` must be a power of two.  A null or empty text is one piece that holds the end id alone.  Rows
    that repeat a doc_id are documents of their own.  An empty table gives no rows.  Other columns are ignored.
    sequence_id is unique within the result; it is not the same from one run to another if the files are read
    in other splits.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([end_id], "<u4").tobytes()

    def cut(ids_of: list[int], texts: list[str]) -> dict:
        encode = _encoder(json_path, ranks_path).encode
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []))}
        for doc_id, text in zip(ids_of, texts):
            packed = memoryview(encode(text) + end)
            total, start = len(packed) // 4, 0
            for length in binary_lengths(total, longest):
                piece = packed[4 * start : 4 * (start + length)]
                for k, v in (("doc_id", doc_id), ("start", start), ("length", length), ("bucket", length.bit_length() - 1), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", total)):
                    out[k].append(v)
                if keep_ids:
                    out["ids"].append(bytes(piece))
                start += length
        return out

    schema = "doc_id long, start long, length long, bucket long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return map_rows(id_text(docs), ["doc_id", "text"], cut, schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Lay the pieces out in one folder for each length, as a loader of equal-length batches reads them."""
    pieces.write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), keep_ids=False)
