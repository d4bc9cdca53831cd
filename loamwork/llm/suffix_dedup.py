"""Exact removal of repeated 50-byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.  Only the order
of suffixes up to their first 50 bytes matters, so suffixes are sorted to that depth, one suffix bucket at a time.

Buckets.  Each 50-byte string belongs to the bucket of its *anchor*: the least-hashed 20-byte string inside it, the
leftmost of equals.  Equal strings have equal anchors at equal places, so a bucket holds all equals of its suffixes,
and anchors of one hash line its suffixes up.  Anchors lie about 16 bytes apart, and all suffixes of one anchor
travel as one context of at most 80 bytes.

Sorting a bucket.  Contexts are laid out with their anchors in one column, and the columns of a difference cover
modulo 32 are the cover sample: the 34-byte strings that start there are ranked first.  A suffix is then ordered by
its anchor, its first 16 bytes, the rank of the first sample column at or after its start, and its last 16 bytes; ties
on the first 16 bytes, which are long ones in a repeated text, are thus decided by the precomputed ranks, without
comparing further bytes.  As the cover meets every residue within 16 columns, these cover all 50 bytes.

Filtering.  A first exchange finds the anchors that more than one document has; only their contexts are sorted.
Whole copies of a smaller document go without sorting.  In each Arrow batch, of the contexts that agree in all bytes
only the smallest document's is sent on, and the others are marked there and then; marks and the owners of anchors
known to be shared are dealt over all buckets.  So a passage that a third of all documents share costs a bucket one
context for each batch.  Filters of a fixed size keep documents without marks out of the exchanges of texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import bounded_batches, documents, map_rows, shared_checkpoint
from loamwork.llm.rowfilter import filter_of, map_filtered
from loamwork.llm.shingles import mix

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
SLICE = 1 << 20
HEAD = 16  # bytes compared at either end of a suffix
SAMPLE = LENGTH - HEAD  # length of the ranked strings of the cover sample
PERIOD = 32
ANCHOR_COLUMN = PERIOD
COLUMNS = ANCHOR_COLUMN + LENGTH + 6
KEY = ["doc_id", "mark"]
BYTES_A_BUCKET = 12_000_000
#: Contexts laid out at once.
CHUNK = 20_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(977).integers(1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_tables: list[np.ndarray] = []


def difference_cover(period: int) -> list[int]:
    """Residues, chosen greedily, such that every residue is a difference of two of them."""
    cover, met = [0], {0}
    while len(met) < period:
        gain = lambda d: len({(d - c) % period for c in cover} | {(c - d) % period for c in cover} | met)
        best = max(range(1, period), key=lambda d: (gain(d), -d))
        met |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)
#: For each residue, how far the next column of the cover is.
TO_COVER = [min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)]
if max(TO_COVER) > HEAD:
    COVER = sorted({*COVER, *(r for r in range(0, PERIOD, HEAD))})
    TO_COVER = [min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)]


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        n = SLICE + LENGTH
        for base in (_BASE, _INVERSE):
            _tables.append(np.concatenate(([_U(1)], np.cumprod(np.full(n, base, dtype=np.uint64)))))
    return _tables[0], _tables[1]


def anchor_runs(raw: bytes):
    """(first start, last start, anchor place, anchor key) of each run of 50-byte strings with one anchor."""
    power, inverse = _powers()
    out = []
    b = np.frombuffer(raw, np.uint8)
    low = _U((1 << 21) - 1)
    for s in range(0, max(0, len(b) - LENGTH + 1), SLICE):
        part = b[s : s + SLICE + LENGTH - 1]
        n = len(part)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * power[:n], out=total[1:])
        h = mix((total[GRAM:] - total[: n - GRAM + 1]) * inverse[: n - GRAM + 1])
        m = h & ~low | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: len(m) - (WINDOW - 16)], m[WINDOW - 16 :])  # spans of 16 to one of WINDOW
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        out.append((first + s, last + s, at[first] + s, h[at[first]]))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _short(keys: np.ndarray) -> np.ndarray:
    """The lowest 32 bits.  Within a bucket few keys share them, and such a pair only costs a context too many."""
    return keys.astype(np.uint32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(40)) % _U(buckets)).astype(np.int64)


def _batches_of(column_names: list[str], out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: out[c] for c in column_names}, schema=schema)


_POSTINGS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("known", pa.bool_())])
_ANSWERS = pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_TOUCHED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("keys", pa.binary())])
_CONTEXTS = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("runs", pa.binary())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("runs", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _postings(rows: DataFrame, buckets: int) -> DataFrame:
    """Anchor keys of each batch by bucket.  A key that one document of the batch has comes with it; a key of several
    documents comes once, as known to be shared, and its owners go to a bucket of the batch's choice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids, marks = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("doc_id", "mark"))
            texts = batch.column("text").to_pylist()
            least: dict[str, int] = {}
            for k, t in enumerate(texts):
                if t not in least or ids[k] < ids[least[t]]:
                    least[t] = k
            keys, owners = [], []
            for k in sorted(least.values()):
                own = np.unique(anchor_runs(texts[k].encode())[3])
                keys.append(own)
                owners.append(np.full(len(own), k))
            if not keys or not sum(map(len, keys)):
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            same = key[1:] == key[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            first = np.concatenate(([True], ~same))
            out: dict[str, list] = {c: [] for c in _POSTINGS.names}
            bucket = _bucket(key, buckets)
            salt = int(mix(np.array([number * 1_000_003 + int(ids[0])], dtype=np.int64).view(np.uint64))[0] % _U(buckets))

            def put(b: int, at: np.ndarray, known: bool, with_owner: bool) -> None:
                at = at[np.argsort(owner[at], kind="stable")]
                used, counts = np.unique(owner[at], return_counts=True) if with_owner else (np.empty(0, np.int64), np.empty(0))
                values = (b, task << 32 | number, ids[used].tobytes(), marks[used].tobytes(), counts.astype(np.uint32).tobytes(), _short(key[at]).tobytes(), known)
                for c, v in zip(out, values):
                    out[c].append(v)

            alone, shared = np.flatnonzero(~several), np.flatnonzero(several)
            for choice, with_owner in ((alone, True), (shared[first[shared]], False)):
                choice = choice[np.argsort(bucket[choice], kind="stable")]
                for part in np.split(choice, np.flatnonzero(np.diff(bucket[choice])) + 1):
                    if len(part):
                        put(int(bucket[part[0]]), part, not with_owner, with_owner)
            if len(shared):
                put(salt, shared, True, True)
            yield _batches_of(_POSTINGS.names, out, _POSTINGS)

    return rows.select("doc_id", "mark", "text").mapInArrow(run, _ddl(_POSTINGS))


def _by_owner(ids: np.ndarray, marks: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((marks, ids))
    ids, marks, keys = ids[order], marks[order], keys[order]
    starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))) if len(ids) else np.empty(0, np.int64)
    parts = [p.tobytes() for p in np.split(keys, starts[1:])] if len(ids) else []
    return pa.RecordBatch.from_pydict({"doc_id": ids[starts], "mark": marks[starts], "keys": parts}, schema=_TOUCHED)


def _shared_anchors(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each batch with postings in the bucket, its documents' anchor keys that other documents have too."""
    answers: dict[str, list] = {c: [] for c in _ANSWERS.names}
    number, ids, marks, keys, batch_of, known = 0, [], [], [], [], []
    for batch in batches:
        for origin, i, m, n, k, sure in zip(*(batch.column(c).to_pylist() for c in ("batch", "ids", "marks", "counts", "keys", "known"))):
            if sure and i:
                for c, v in zip(answers, (origin, i, m, n, k)):
                    answers[c].append(v)
                continue
            k = np.frombuffer(k, np.uint32)
            if sure:
                known.append(k)
                continue
            counts = np.frombuffer(n, np.uint32)
            ids.append(np.repeat(np.frombuffer(i, np.int64), counts))
            marks.append(np.repeat(np.frombuffer(m, np.int64), counts))
            keys.append(k)
            batch_of.append(origin)
            number += 1
    if keys:
        blob = np.repeat(np.arange(number), list(map(len, keys)))
        ids, marks, keys = map(np.concatenate, (ids, marks, keys))
        sure = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint32)
        order = np.lexsort((ids, keys))
        k, i = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        several = i[starts] != i[np.append(starts[1:], len(i)) - 1]
        keep = np.sort(order[np.repeat(several, np.diff(np.append(starts, len(k)))) | np.isin(k, sure)])
        ids, marks, keys, blob = ids[keep], marks[keep], keys[keep], blob[keep]
        new = np.ones(len(keep), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (blob[1:] != blob[:-1])
        owners = np.flatnonzero(new)
        counts = np.diff(np.append(owners, len(keep))).astype(np.uint32)
        for part in np.split(np.arange(len(owners)), np.flatnonzero(np.diff(blob[owners])) + 1):
            if len(part):
                at = owners[part]
                own = slice(at[0], at[-1] + int(counts[part[-1]]))
                for c, v in zip(answers, (batch_of[blob[at[0]]], ids[at].tobytes(), marks[at].tobytes(), counts[part].tobytes(), keys[own].tobytes())):
                    answers[c].append(v)
    yield _batches_of(_ANSWERS.names, answers, _ANSWERS)


def _by_document(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a batch, from the answers of all buckets."""
    ids, marks, keys = [], [], []
    for batch in batches:
        for i, m, n, k in zip(*(batch.column(c).to_pylist() for c in _ANSWERS.names[1:])):
            counts = np.frombuffer(n, np.uint32)
            ids.append(np.repeat(np.frombuffer(i, np.int64), counts))
            marks.append(np.repeat(np.frombuffer(m, np.int64), counts))
            keys.append(np.frombuffer(k, np.uint32))
    ids, marks, keys = map(np.concatenate, (ids, marks, keys))
    order = np.lexsort((marks, ids))
    ids, marks, keys = ids[order], marks[order], keys[order]
    starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])))) if len(ids) else np.empty(0, np.int64)
    parts = [p.tobytes() for p in np.split(keys, starts[1:])] if len(ids) else []
    yield pa.RecordBatch.from_pydict({"doc_id": ids[starts], "mark": marks[starts], "keys": parts}, schema=_TOUCHED)


def _contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """Contexts of shared anchors by bucket: for each document its doc_id, mark and number of contexts, for each context
    its first start, number of starts and anchor's place, and all bytes compressed; or runs: doc_id, mark, first start
    and number of starts already known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for number, batch in enumerate(batches):
            ids, marks = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in ("doc_id", "mark"))
            heads, cuts = [], []
            for k, (z, shared) in enumerate(zip(batch.column("z").to_pylist(), batch.column("keys").to_pylist())):
                raw = unpack.decompress(z)
                first, last, at, key = anchor_runs(raw)
                hit = np.isin(_short(key), np.frombuffer(b"".join(shared), np.uint32))
                first, last, at, key = first[hit], last[hit], at[hit], key[hit]
                heads.append(np.stack([np.full(len(first), k), first, last - first + 1, at - first, key.view(np.int64)], axis=1))
                cuts += [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())]
            if not cuts:
                continue
            head = np.concatenate(heads)
            # of contexts that agree in all bytes, those of the smallest document go on; the others' starts go
            own = ids[head[:, 0]].tolist()
            least: dict[tuple[int, bytes], int] = {}
            names = list(zip(head[:, 3].tolist(), cuts))
            for doc_id, name in zip(own, names):
                if least.get(name, doc_id) >= doc_id:
                    least[name] = doc_id
            goes = np.array([least[name] < doc_id for doc_id, name in zip(own, names)])
            out: dict[str, list] = {c: [] for c in _CONTEXTS.names}
            kept = np.flatnonzero(~goes)
            bucket = _bucket(head[:, 4].view(np.uint64), buckets)
            kept = kept[np.argsort(bucket[kept], kind="stable")]
            for part in np.split(kept, np.flatnonzero(np.diff(bucket[kept])) + 1):
                used, counts = np.unique(head[part, 0], return_counts=True)
                sizes = np.stack([head[part, 2], head[part, 3]]).astype(np.uint8)
                values = (int(bucket[part[0]]), ids[used].tobytes(), marks[used].tobytes(), counts.astype(np.uint32).tobytes(), head[part, 1].astype(np.uint32).tobytes(), sizes.tobytes(), pack.compress(b"".join(cuts[p] for p in part)), None)
                for c, v in zip(out, values):
                    out[c].append(v)
            if goes.any():
                salt = int(mix(np.array([number * 1_000_003 + int(ids[0])], dtype=np.int64).view(np.uint64))[0] % _U(buckets))
                runs = np.stack([ids[head[goes, 0]], marks[head[goes, 0]], head[goes, 1], head[goes, 2]], axis=1)
                for c, v in zip(out, (salt, *[None] * 6, pack.compress(runs.tobytes()))):
                    out[c].append(v)
            yield _batches_of(_CONTEXTS.names, out, _CONTEXTS)

    return rows.select("doc_id", "mark", "z", "keys").mapInArrow(run, _ddl(_CONTEXTS))


def _word(m: np.ndarray, column: int) -> np.ndarray:
    """Eight bytes from a column on as a number in the bytes' order."""
    return np.ascontiguousarray(m[:, column : column + 8]).view(">u8").ravel().astype(np.uint64)


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """The rank of each row in the order of the columns, the first most significant; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(head: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(context, start within it) of the suffixes whose 50 bytes a smaller document of the bucket has as well."""
    n = len(head)
    lengths = head[:, 3] + LENGTH - 1
    ends = np.cumsum(lengths)
    m = np.zeros((n, COLUMNS), dtype=np.uint8)
    begin = ANCHOR_COLUMN - head[:, 4]  # the column of a context's first byte
    for k in range(0, n, CHUNK):
        own = slice(k, k + CHUNK)
        row = np.repeat(np.arange(k, min(n, k + CHUNK)), lengths[own])
        low, high = int(ends[k] - lengths[k]), int(ends[own][-1])
        inside = np.arange(low, high) - np.repeat(ends[own] - lengths[own], lengths[own])
        m[row, begin[row] + inside] = np.frombuffer(data, np.uint8, high - low, low)
    anchor = _ranks([_word(m, ANCHOR_COLUMN), _word(m, ANCHOR_COLUMN + 8), _word(m, ANCHOR_COLUMN + GRAM - 8)])
    ranks: dict[int, np.ndarray] = {}

    def cover_rank(column: int) -> np.ndarray:
        """Ranks of the strings of SAMPLE bytes that start in a column of the cover sample, computed when first asked for."""
        if column not in ranks:
            words = [_word(m, column + k) for k in range(0, SAMPLE - 7, 8)] + [_word(m, column + SAMPLE - 8)]
            ranks[column] = _ranks([anchor, *words])
        return ranks[column]

    found_row, found_start = [], []
    for column in range(ANCHOR_COLUMN - WINDOW + 1, ANCHOR_COLUMN + 1):
        rows = np.flatnonzero((begin <= column) & (column < begin + head[:, 3]))
        if len(rows) < 2:
            continue
        sample = cover_rank(column + TO_COVER[column % PERIOD])[rows]
        part = m[rows]
        ends = [_word(part, column), _word(part, column + 8), _word(part, column + LENGTH - 16), _word(part, column + LENGTH - 8)]
        keys = [anchor[rows], ends[0], ends[1], sample, ends[2], ends[3]]
        order = np.lexsort((head[rows, 0], *keys[::-1]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        doc = head[rows[order], 0]
        smallest = doc[new][np.cumsum(new) - 1]
        gone = rows[order[doc > smallest]]
        found_row.append(gone)
        found_start.append(column - begin[gone])
    if not found_row:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_start)


def _as_runs(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Runs of starts by document, neighbours joined."""
    order = np.lexsort((starts, marks, docs))
    docs, marks, starts, counts = docs[order], marks[order], starts[order], counts[order]
    new = np.ones(len(docs), dtype=bool)
    if len(docs):
        new[1:] = (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] != starts[:-1] + counts[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts, at) if len(at) else counts
    docs, marks, starts = docs[at], marks[at], starts[at]
    own = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])))) if len(at) else at
    pairs = np.stack([starts, total], axis=1)
    return pa.RecordBatch.from_pydict({"doc_id": docs[own], "mark": marks[own], "runs": [p.tobytes() for p in np.split(pairs, own[1:])] if len(at) else []}, schema=_RUNS)


def _sorted_bucket(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    heads, data = [], []
    for batch in batches:
        for i, m, n, f, w, d, r in zip(*(batch.column(c).to_pylist() for c in _CONTEXTS.names[1:])):
            if r is not None:
                yield _as_runs(*np.frombuffer(unpack.decompress(r), np.int64).reshape(-1, 4).T)
                continue
            counts = np.frombuffer(n, np.uint32)
            starts, places = np.frombuffer(w, np.uint8).reshape(2, -1).astype(np.int64)
            heads.append(np.stack([np.repeat(np.frombuffer(i, np.int64), counts), np.repeat(np.frombuffer(m, np.int64), counts), np.frombuffer(f, np.uint32).astype(np.int64), starts, places], axis=1))
            data.append(unpack.decompress(d))
    if heads:
        head = np.concatenate(heads)
        row, start = repeated_starts(head, b"".join(data))
        yield _as_runs(head[row, 0], head[row, 1], head[row, 2] + start, np.ones(len(row), dtype=np.int64))


def _squeezed(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, mark and z, the text's bytes compressed, of the rows that pass a filter: what moves in an exchange."""

    def squeeze(ids: list[int], marks: list[int], texts: list[str]) -> dict:
        tool = zstandard.ZstdCompressor(level=3)
        return {"doc_id": ids, "mark": marks, "z": [tool.compress(t.encode()) for t in texts]}

    return map_filtered(rows, KEY, bits, True, ["doc_id", "mark", "text"], squeeze, "doc_id long, mark long, z binary")


def _result(doc_ids: list, texts: list, copies: list, runs: list) -> dict:
    """texts: the text itself, or its bytes compressed."""
    unpack = zstandard.ZstdDecompressor()
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    for doc_id, text, copy, mine in zip(doc_ids, texts, copies, runs):
        raw = text.encode() if isinstance(text, str) else unpack.decompress(text)
        kept, removed, spans = raw, 0, 0
        if copy and len(raw) >= LENGTH:
            kept, removed, spans = b"", len(raw), 1
        elif mine:
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            pairs = np.frombuffer(b"".join(mine), np.int64).reshape(-1, 2)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = int(gone.sum())
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        for k, v in zip(out, (doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept)):
            out[k].append(v)
    return out


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_bytes, kept (the bytes left) of each row.

    Texts are UTF-8 bytes; null is empty.  A text under 50 bytes loses nothing.  Rows that repeat a doc_id do not
    remove from each other.  A row without a doc_id neither loses nor removes anything.  An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = every.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, math.ceil(size / BYTES_A_BUCKET))
    # whole copies of a smaller document
    whole = rows.select("doc_id", "mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_sha"))
    least = whole.groupBy("_sha").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).filter("_least < _most")
    copies = shared_checkpoint(whole.join(least, "_sha").filter("doc_id > _least").select("doc_id", "mark").distinct())
    answers = _postings(rows, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared_anchors, _ddl(_ANSWERS))
    found = answers.groupBy("batch").applyInArrow(_by_document, _ddl(_TOUCHED))
    touched = shared_checkpoint(found.groupBy(*KEY).agg(F.collect_list("keys").alias("keys")).join(copies, KEY, "left_anti"))
    contexts = _contexts(_squeezed(rows, filter_of(touched, KEY)).join(touched, KEY), buckets)
    runs = contexts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_sorted_bucket, _ddl(_RUNS))
    runs = shared_checkpoint(runs.groupBy("doc_id", "mark").agg(F.collect_list("runs").alias("runs")))
    marked = runs.select("doc_id", "mark", "runs", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "mark", F.lit(None).cast("array<binary>").alias("runs"), F.lit(True).alias("copy")))
    bits = filter_of(marked, KEY)
    joined = _squeezed(every, bits).join(marked, KEY, "left")
    drop = (lambda d: d) if keep_bytes else (lambda d: {k: v for k, v in d.items() if k != "kept"})
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    plain = map_filtered(every, KEY, bits, False, ["doc_id", "text"], lambda ids, texts: drop(_result(ids, texts, [False] * len(ids), [None] * len(ids))), schema)
    return plain.union(map_rows(joined, ["doc_id", "z", "copy", "runs"], lambda *a: drop(_result(*a)), schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), keep_bytes=False)
