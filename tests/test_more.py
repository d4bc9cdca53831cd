"""Loaders, data sets, image files, masks, clean-up and scalars on small tables; queries without SQL against brute force."""

import json
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.functions import scalars as X
from loamwork.functions import text as T
from loamwork.operators import assets as A
from loamwork.operators import cleanup as L
from loamwork.operators import datasets as N
from loamwork.operators import sample as S
from loamwork.operators.formats import FORMATS
from loamwork.plans import catalog, registry  # noqa: F401
from loamwork.sources import io as I
from loamwork.sources import loaders as O


# --- queries without SQL --------------------------------------------------------------------------------------
def plain(pattern):
    return re.compile(pattern.replace(r"\z", r"\Z").replace(r"\x{00A9}", "©").replace(r"\x{00BB}", "»").replace(r"\x{2665}", "♥"))


def without_boilerplate(s):
    for p in T.BOILERPLATE:
        s = plain(p).sub("", s)
    s = re.sub(T.BOILERPLATE_ONCE, "", s, count=1, flags=re.I)
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", s)).strip()


SAMPLES = [
    "Plain text.", "We use cookies here.\n\nKept", "a\nMenu\nb\nSkip to content\nc", "x arXivLabs is a framework that allows collaborators y ARXIVLABS is a framework that allows collaborators",
    "Story\n\n\n\nRelated articles and all after", "top © 2020 firm\n\nnext   words", "comments (12) gone", "made with much LOVE here\n\nend", "Privacy policy and\nterms of use and more\n\nok", "", "Share on twitter\n\nhome",
]


def test_boilerplate(spark):
    got = spark.createDataFrame([(k, s) for k, s in enumerate(SAMPLES)], "k int, s string").select("k", T.remove_boilerplate(F.col("s")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: without_boilerplate(s) for k, s in enumerate(SAMPLES)}
    assert "ARXIVLABS" in got[3]["t"]


def test_templates_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in catalog.table(spark, sf, "documents").collect()}
    run = lambda name: [r.asDict() for r in registry.queries()[name](spark, sf).collect()]
    raw, instruct, turns = run("template_raw_extract"), run("template_instruct"), run("template_conversation")
    assert raw and instruct and turns
    for r in raw:
        assert r["text"] == without_boilerplate(docs[int(r["id"])])
    for r in instruct:
        assert r["output"] == without_boilerplate(docs[int(r["id"])])[:1000] and r["input"] == "" and r["instruction"].startswith("Summarize ")
    for r in turns:
        user, answer = json.loads(r["messages"])
        assert (user["role"], answer["role"]) == ("user", "assistant") and answer["content"] == without_boilerplate(docs[int(r["id"])])[:1000]
    for r in run("template_qa"):
        text = without_boilerplate(docs[int(r["id"])])
        long = [p.strip() for p in re.split(r"\n\n+", text) if len(p.strip()) > 50]
        assert r["output"] == (long[0] if long else text[:500] + "..." * (len(text) > 500))


def test_split_xorshift(spark, sf):
    got = {r["doc_id"]: r["split"] for r in registry.queries()["split_xorshift"](spark, sf).collect()}
    state, order = catalog.SEED, sorted(got)

    def draw():
        nonlocal state
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        return state / 2**32

    for i in range(len(order) - 1, 0, -1):
        j = int(draw() * (i + 1))
        order[i], order[j] = order[j], order[i]
    n = len(order)
    want = {d: "train" if k < int(n * 0.8) else "validation" if k < int(n * 0.8) + int(n * 0.1) else "test" for k, d in enumerate(order)}
    assert got == want


# --- places ---------------------------------------------------------------------------------------------------
def test_places_by_number(spark):
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 17 == 0 else float(v)) for k, v in enumerate(rng.integers(0, 40, 300))]
    got = S.place_by_number(spark.createDataFrame(rows, "k int, v double"), F.col("v"), then=[F.col("k")], major=F.col("k") % 2).collect()
    order = sorted(rows, key=lambda r: (r[0] % 2, r[1] is not None, r[1] or 0, r[0]))
    assert {r["k"]: r["_place"] for r in got} == {k: at for at, (k, _) in enumerate(order)}
    assert S.place_by_number(spark.createDataFrame([], "v double"), F.col("v")).count() == 0
    with pytest.raises(ValueError):
        S.split(spark.range(3), F.col("id"), by=["id"], numeric=True)


# --- sources --------------------------------------------------------------------------------------------------
def test_loaders(spark, tmp_path):
    (tmp_path / "task").mkdir()
    (tmp_path / "task/data.json").write_text('\n  [{"a": 1}, {"a": 2}]')
    (tmp_path / "task/scraped_data.jsonl").write_text('{"url": "u"}\n')
    (tmp_path / "task/asset_manifest.json").write_text('[{"assets": [{"id": "x"}, {"id": "y"}]}]')
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 3}\n')
    (tmp_path / "naive.csv").write_text('a,b\n1,"x\na,b\n2,y\n')
    assert sorted(r["a"] for r in O.auto_load(spark, str(tmp_path / "task")).collect()) == [1, 2]
    task = O.load_task(spark, str(tmp_path / "task"))
    assert {k: v.count() for k, v in task.items()} == {"data": 2, "pages": 1, "assets": 2}
    numbered = [(r["line"], r["record"], r["error"]) for r in O.read_numbered(spark, str(tmp_path / "lines.jsonl")).orderBy("line").collect()]
    assert numbered == [(1, '{"a": 1}', None), (3, None, "Line 3: not JSON"), (4, '{"a": 3}', None)]
    naive = I.read_any(spark, str(tmp_path / "naive.csv"), dialect="naive")
    assert sorted(tuple(r) for r in naive.collect()) == [("1", '"x'), ("2", "y"), ("a", "b")]
    rows, about = O.preview(spark, str(tmp_path / "task"), 1)
    assert rows.count() == 1 and about >= 1
    assert O.record_at(spark.range(5), 3, "id").first()["id"] == 3
    union = O.union_of_keys(spark.createDataFrame([('{"b": 1}',), ('{"a": "x", "b": null}',)], "t string"), "t")
    assert union.columns == ["a", "b"] and sorted(map(str, union.collect())) == ["Row(a='x', b=None)", "Row(a=None, b='1')"]
    with pytest.raises(ValueError):
        I.synthetic(spark, "nothing", 3)


# --- files and formats ----------------------------------------------------------------------------------------
def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + bytes(5)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 33, 77) + bytes(20)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 5, 6) + bytes(20), b"BM" + bytes(16) + struct.pack("<ii", 9, -8) + bytes(10)
    webp = b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + bytes(8)
    rows = [(k, bytearray(b) if b is not None else None) for k, b in enumerate((png, jpeg, gif, bmp, webp, b"no", None))]
    got = spark.createDataFrame(rows, "k int, b binary").select("k", A.image_size(F.col("b")).alias("s")).orderBy("k").select("s.*").collect()
    assert [tuple(r) for r in got] == [("png", 640, 480), ("jpeg", 77, 33), ("gif", 5, 6), ("bmp", 9, 8), ("webp", 100, 50), (None, None, None), (None, None, None)]


def test_masks_and_polygons(spark):
    square = np.zeros((10, 20), np.uint8)
    square[2:8, 5:15] = 1
    corners = np.array(N.polygon_of(square)).reshape(-1, 2)
    assert len(corners) >= 4 and corners[:, 0].min() == 0.25 and corners[:, 0].max() == 0.7 and corners[:, 1].min() == 0.2 and corners[:, 1].max() == 0.7
    assert N.polygon_of(np.zeros((4, 4))) == []
    rows = [(1, "a.png", "cat", bytearray(square.tobytes()), 20, 10), (2, "a.png", "dog", bytearray(200), 20, 10), (3, "b.png", "cat", None, 20, 10)]
    frame = N.mask_polygons(spark.createDataFrame(rows, "id int, image string, label string, mask binary, width int, height int"))
    lines = {r["image"]: r["labels"] for r in N.yolo_seg(frame, "id").collect()}
    assert list(lines) == ["a.png"] and lines["a.png"].startswith("0 0.") and len(lines["a.png"].split()) % 2 == 1
    seg = [(1, "a", "cat", [0.0, 0.0, 2.0, 3.0], "m1", 5.0), (2, "a", "dog", [0.0, 0.0, 2.0, 3.0], "m2", None)]
    _, _, notes = N.coco_seg(spark.createDataFrame(seg, "id int, image string, label string, bbox array<double>, mask_file string, area double"), "id")
    assert [(r["mask_file"], r["area"]) for r in notes.orderBy("id").collect()] == [("m1", 5.0), ("m2", 6.0)]


def test_folders_and_chats(spark):
    rows = [(1, "in/x.PNG", "big cat", "n"), (2, "other/x.PNG", "big cat", "n"), (3, "x.txt", "dog", "n"), (4, "y.wav", "dog", None)]
    frame = spark.createDataFrame(rows, "id int, image string, label string, note string")
    assert sorted(r["file_name"] for r in N.image_folder(frame).collect()) == ["big_cat/x.PNG", "big_cat/x_1.PNG"]
    assert [r["file_name"] for r in N.audio_folder(frame.withColumnRenamed("image", "audio")).collect()] == ["dog/y.wav"]
    speech = spark.createDataFrame([("a.wav", "t", 1.0), ("b.wav", " ", 1.0), ("c.txt", "t", 1.0), ("d.mp3", "t", 1.0)], "audio string, text string, duration double")
    known = spark.createDataFrame([("a.wav",)], "path string")
    assert N.speech_text(speech).count() == 2 and N.speech_text(speech, known).count() == 1
    chats = spark.createDataFrame([(1, [("human", "hi"), ("gpt", " ")]), (2, [])], "id int, messages array<struct<role:string,content:string>>")
    assert [(r["id"], [tuple(m) for m in r["messages"]]) for r in N.chat_messages(chats, "id", system="S").orderBy("id").collect()] == [(1, [("system", "S"), ("user", "hi")]), (2, [("system", "S")])]
    turns = spark.createDataFrame([("i", [("system", "s"), ("user", "q"), ("assistant", "a")])], "image string, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in N.llava_turns(turns).first()["conversations"]] == [("system", "s"), ("human", "<image>\nq"), ("gpt", "a")]
    assert all(FORMATS.has(n) for n in ("coco-seg", "yolo-seg", "imagefolder", "audiofolder", "speech-text", "datasetdict", "parquet"))


def test_data_sets(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    counts = {r["split"]: r["rows"] for r in N.write_dataset(rows, str(tmp_path / "d"), S.hash_order(F.col("id"), 1), (0.8, 0.1, 0.1)).collect()}
    assert counts == {"train": 80, "validation": 10, "test": 10} and N.read_dataset(spark, str(tmp_path / "d"), "test").count() == 10
    info = json.loads(spark.read.text(str(tmp_path / "d/dataset_info")).first()[0])
    assert info["splits"]["train"]["num_examples"] == 80 and info["size_category"] == "n<1K"
    with pytest.raises(ValueError):
        N.write_dataset(rows, str(tmp_path / "e"), F.col("id"), kind="odd")


# --- clean-up and scalars -------------------------------------------------------------------------------------
def test_clean_up(spark):
    rows = [(1, "http://a.b/x", "t" * 200, "f1"), (2, "http://a.b/x/?utm_source=1", "u" * 200, "f1"), (3, "http://a.b/y", "", "f1"), (4, "http://a.b/z", "v" * 20, "f1"), (5, "http://a.b/w", "w" * 300, "gone")]
    frame = spark.createDataFrame(rows, "id int, url string, text string, file string")
    known = spark.createDataFrame([("f1",)], "path string")
    data, stats = L.run_cleanup(frame, [F.col("id")], dedupe=True, dedupe_fields=["url"], required=["text"], validate=True, files=["file"], known_files=known, least=100, threshold=8.0, empty=True)
    assert [r["id"] for r in data.collect()] == [1] and data.columns == frame.columns
    assert [(r["stage"], r["seen"], r["removed"]) for r in stats.orderBy("at").collect()] == [("dedupe", 5, 1), ("validate", 4, 1), ("validate-files", 3, 1), ("quality", 2, 1), ("filter-empty", 1, 0)]
    data, stats = L.run_cleanup(frame, [F.col("id")])
    assert data.count() == 5 and stats.count() == 0
    assert L.json_schema(frame)["required"] == ["id", "url", "text", "file"] and L.json_schema(frame.limit(0))["required"] == []
    with pytest.raises(ValueError):
        L.validate_and_transform(frame, {"id": "colour"})


def test_scalars(spark):
    def hashed(s):
        h = 0
        for k in range(0, len(s.encode("utf-16-be")), 2):
            h = ((h * 31 + int.from_bytes(s.encode("utf-16-be")[k : k + 2], "big")) + 2**31) % 2**32 - 2**31
        digits, n = "", abs(h)
        while n or not digits:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        return "-" * (h < 0) + digits

    texts = ["", "a", "hello world", "é漢😀" * 9, "z" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.prompt_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: hashed(t) for t in texts}
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    results = F.array(F.struct(F.lit("T").alias("title"), F.lit("U").alias("url"), F.lit("C").alias("content")))
    assert "[1] T\nURL: U\nC" in value(X.search_context(results)) and value(X.search_context(F.slice(results, F.lit(1), F.lit(0)))) == ""
    sizes = lambda *n: F.array(*[F.lit(k) for k in n])
    assert [value(X.batch_size(sizes(*n))) for n in ((100,) * 10, (3000,) * 4, (9000, 1), (5000, 5000, 5000))] == [10, 2, 1, 1]
    assert value(X.language_supported(F.lit("de"), {"m": ["en"]}, "m")) is False and value(X.language_supported(F.lit("de"), {}, "m")) is True
    assert value(X.resolve_language(F.lit(" ESPAÑOL "))) == "es" and value(X.resolve_language(F.lit("none"))) is None
    qa = value(X.contextual_qa(F.lit("IMG_1.jpg"), F.lit(""), F.lit(""), F.lit("http://a.b/c")))
    assert [tuple(x) for x in qa] == [("What is shown in this image?", "An image from a.b.")]
    assert value(X.contextual_qa(F.lit("red-rose12.jpg"), F.lit("Site | page"), F.lit(""), F.lit("")))[1]["answer"] == "This shows red rose."
    assert zlib.crc32(b"") == 0
