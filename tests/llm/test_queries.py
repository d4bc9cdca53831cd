"""Each registered query, over tables of odd and planted rows, against brute force in every column of its contract."""

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamwork.llm import media, queries, toxicity, webp_writer
from loamwork.llm.common import documents
from tests.llm.test_operators import known, linked, near_copies, removal, shingle_tuples

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def planted():
    rng = np.random.default_rng(21)
    rows = [(1, None, "de", "src0"), (2, "", None, None), (3, "½ ② 12 Ⅷ", "en", "src1"), (4, " \t\n ", "en", "src0"), (5, "漢字 é 😀 <|endoftext|> it's", "fr", "src2")]
    rows += [(10 + i, t, "en", f"src{i % 4}") for i, t in near_copies(24, 5)]
    rows += [(100 + k, f"the {'good' if k % 5 else 'moron zorkle idiot'} word{k} and the rest of it", "en" if k % 2 else "de", "src0") for k in range(60)]
    rows += [(200 + k, f"key {''.join(rng.choice(list(LETTERS), 40))} password: hunter{k}22 and {'ab' * 14} AKIA{k:016d}", "en", "src3") for k in range(20)]
    rows += [(300, rows[10][1], "en", "src0"), (301, "long " * 9000, "en", "src9"), (302, "x" * 70_000, "en", "src9"), (303, rows[-1][1], "en", "src0")]
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(*r, len(r[1] or "")) for r in planted()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int("moron" in (r[1] or "")), "x") for r in rows if 100 <= r[0] < 160]
    spark.createDataFrame(labels, "doc_id long, toxic int, other string").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in planted()}


def run(spark, table, n):
    name, query = next((k, q) for k, q in queries.queries().items() if k.startswith(f"op{n}_"))
    return query(spark, table).collect()


def remainder(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_op1(spark, table, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    got = run(spark, table, 1)
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {(i, len(t.encode()), want[i], want[i] > 2048) for i, t in texts.items()}


def test_op2(spark, table, texts):
    got = run(spark, table, 2)
    copies = {}
    for r in got:
        copies.setdefault(r["doc_id"], []).append(r["copy"])
        assert (r["text"] or "") == texts[r["doc_id"]]
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values()) and len(got) > 0


def test_op3(spark, table, texts):
    got = run(spark, table, 3)
    model = toxicity.fit(documents(spark, table), documents(spark, table, "labels"))
    assert {(r["doc_id"], r["held_out"]) for r in got} == {(i, remainder(i, 3) == 1) for i in texts}
    for r in got:
        hits = model.lexicons.find(texts[r["doc_id"]])[0]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.bias + sum(model.weights[h] for h in hits), -30, 30))))
        assert r["predicted"] == int(r["score"] >= 0.7)
    assert all(r["predicted"] == int("moron" in texts[r["doc_id"]]) for r in got if 100 <= r["doc_id"] < 160)


def test_op4(spark, table, texts):
    got = run(spark, table, 4)
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        stored = webp_writer.encode(media.image_of(payload))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        grey = np.frombuffer(payload, np.uint8)
        assert f";mean={int(grey.mean() * 1000 + 0.5)};" in r["feature"]
        by_text.setdefault(raw, set()).add(tuple(r[k] for k in r.asDict() if k != "doc_id"))
    assert all(len(v) == 1 for v in by_text.values())


def test_op5(spark, table, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, table, 5)
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    seen = {i: np.zeros(len(v), int) for i, v in ids.items()}
    sequences = {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((v == 1).all() for v in seen.values())
    assert all(len(v) == 1 and v[0][0] == 0 and v[0][1] <= 2048 and v[0][1] & v[0][1] - 1 == 0 for v in sequences.values())
    assert {(r["doc_id"], r["start"], r["sequence_id"]) for r in got} == {(r["doc_id"], r["start"], r["sequence_id"]) for r in run(spark, table, 5)}


def test_op6(spark, table, texts):
    got = run(spark, table, 6)
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(removal(list(texts.items())))
    assert {(r["doc_id"], r["n_bytes"]) for r in got} == {(i, len(t.encode())) for i, t in texts.items()}


def test_op7(spark, table, texts):
    got = {r["doc_id"]: r for r in run(spark, table, 7)}
    ids = sorted(texts, reverse=True)

    def likeness(a, b):
        if not a or not b:
            return float(a == b)
        same = sum(x == y for x, y in zip(re.findall("..", a), re.findall("..", b)))
        return max(0.0, (same / 256 - 2**-8) / (1 - 2**-8))

    prints = {}
    for k, i in enumerate(ids):
        t, following = texts[i], ids[(k + 1) % len(ids)]
        half = len(t) // 2
        e = t[: len(t) - half] + texts[following][:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], got[following]["fingerprint"]))
        for text, own in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert len(own) == (512 if shingle_tuples(text) else 0)
            prints.setdefault(frozenset(shingle_tuples(text)), set()).add(own)
    assert all(len(v) == 1 for v in prints.values())  # one set, one fingerprint: full and densified bins alike


def test_op8(spark, table, texts):
    got = run(spark, table, 8)
    assert {(r["doc_id"], r["held_out"]) for r in got} == {(i, remainder(i, 5) == 0) for i in texts}
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]])) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got} <= {"und", "en", "de", "fr"}


def test_op9(spark, table, texts):
    names = ["assign", "access", "hex"]
    for r in run(spark, table, 9):
        base = known(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("random:")] == listed
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), [*names, "random"].index(s.split(":")[0])))


def test_op10(spark, table, texts):
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, table, 10)) == sorted(linked(list(texts.items())))


def test_results_hold_integers(spark, table):
    for name, query in queries.queries().items():
        kinds = dict(query(spark, table).dtypes)
        assert kinds["doc_id"] == "bigint", name
    assert json.dumps(sorted(queries.oracle_sql())) == '["op2_mixing"]'
