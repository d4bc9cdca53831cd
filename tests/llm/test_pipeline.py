"""The pipeline's stages against brute force, each on what the one before kept."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loamwork.llm import mixing, packing, secrets, toxicity
from loamwork.llm.common import documents
from tests.llm.test_operators import known, linked


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        kept[name] = rows
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            model = toxicity.fit(documents(spark, sf), documents(spark, sf, "labels"))
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if model.score(r["text"]) < 0.7)
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c in linked([(r["doc_id"], r["text"]) for r in before])})
        if name == "secrets":
            text = {r["doc_id"]: r["text"] for r in rows}
            assert len(rows) == len(before) and all(not known(t) for t in text.values())
            assert all(text[r["doc_id"]] == r["text"] or known(r["text"]) or "[SECRET]" in text[r["doc_id"]] for r in before)
        if name == "mixing":
            n = Counter(r["doc_id"] for r in rows)
            assert n == Counter(drawn(before)) and max(n.values()) > 1
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(texts[r["doc_id"]] == r["text"] for r in rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    copies, want = Counter(r["doc_id"] for r in kept["mixing"]), Counter()
    for r in {r["doc_id"]: r for r in kept["mixing"]}.values():
        ids, start = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.binary_lengths(len(ids), 2048):
            want[r["doc_id"], start, ids[start : start + n].tobytes()] += copies[r["doc_id"]]
            start += n
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in kept["packing"]) == want


def drawn(rows):
    """doc_ids as often as their draws say, by plain Python."""
    sizes = Counter(r["source"] if r["source"] in mixing.WEIGHTS else None for r in rows)
    share = {s: mixing.WEIGHTS.get(s, mixing.REST) for s in sizes}
    for r in rows:
        s = r["source"] if r["source"] in mixing.WEIGHTS else None
        steps = mixing.poisson_steps(share[s] / sum(share.values()) * len(rows) / sizes[s])
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        yield from [r["doc_id"]] * sum(u >= step for step in steps)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts and repeated rows pass every stage but where its rule takes them; an empty table stays empty."""
    rows = [(1, None, None, None, None), (None, "", "en", "src0", 0), (2, " \t", "en", "src1", 2), (3, "one two three four five six", "en", None, 27), (3, "one two three four five six", "en", None, 27), (None, "password: abcdefgh", "xx", "src0", 18)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)
    assert sorted(map(str, stages["toxicity"](spark, frame, sf).collect())) == sorted(map(str, frame.collect()))
    near = stages["near_duplicates"](spark, frame, sf).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in near) == sorted((str(a), str(b)) for a, b, *_ in rows[:4] + rows[5:])
    clean = stages["secrets"](spark, frame, sf).collect()
    assert len(clean) == 6 and {r["text"] for r in clean} == {None, "", " \t", rows[3][1], "[SECRET]"}
    assert len(stages["packing"](spark, frame, sf).collect()) >= 6
    mixed = stages["mixing"](spark, frame, sf)
    assert mixed.columns == corpus_pipeline.COLUMNS and {r["text"] for r in mixed.collect()} <= {r[1] for r in rows}
    for name in ("near_duplicates", "secrets", "mixing", "packing", "toxicity"):
        assert stages[name](spark, frame.limit(0), sf).count() == 0, name


def test_packed_ids(spark):
    docs = spark.createDataFrame([(1, "some words to pack", "en", "s", 18), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    assert mixing.SEED and secrets.KINDS and zlib.crc32(b"")== 0
