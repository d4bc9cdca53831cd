"""Behaviours that the tables do not show: ragged and odd rows, by hand."""

import json
import struct
import zipfile
from itertools import islice

import pytest
from pyspark.sql import functions as F

from loamwork.functions import paths as P
from loamwork.functions import text as T
from loamwork.functions import urls as U
from loamwork.operators import dedupe as D
from loamwork.operators import formats as C
from loamwork.operators import models as M
from loamwork.operators import pages as G
from loamwork.operators import predicate as V
from loamwork.operators import profile as A
from loamwork.operators import sample as S
from loamwork.plans import steps
from loamwork.sources import html as H
from loamwork.sources import io as I
from loamwork.streaming import ingest


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    return df.select(column).first()[0]


def test_paths_and_field_maps(spark):
    df = spark.createDataFrame([(({"c": 1}, ["x", "y"]),)], "a struct<b:map<string,int>,t:array<string>>")
    assert df.select(P.field(df, "a.t[1]"), P.field(df, "a.t[9]"), P.field(df, "a.none.more")).first()[:] == ("y", None, None)
    assert values(P.apply_field_map(df, {"o": "<{{a.t[0]}}> {{missing}}!"})) == [("<x> !",)]
    assert P.apply_field_map(df, {}).columns == ["a"]
    assert P.parse_field_map("a:{{b}},c:x:y") == {"a": "{{b}}", "c": "x:y"}
    assert values(P.set_field(df.select("a"), "n.m", F.lit(1)).select("n.m")) == [(1,)]
    assert P.flatten(df).columns == ["a.b", "a.t"]


def test_criteria_are_two_valued(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, s string")
    ids = lambda t: sorted(r[0] for r in V.filter_by_expression(df, t).collect())
    assert ids({"not": {"field": "s", "equals": "ab"}}) == [2, 3]
    assert ids({"field": "s", "exists": False}) == [2]
    assert ids({"and": []}) == [1, 2, 3] and ids({"or": []}) == []
    assert ids({"field": "s", "lessThan": 1}) == [3]  # a blank counts as 0
    with pytest.raises(ValueError):
        V.criterion(F.col("s"), {"like": "x"})


def test_validators(spark):
    df = spark.createDataFrame([(0, "a@b.c", "http://x", "2020-01-01", "5"), (1, "bad", "nope", "no", "x"), (2, None, "", None, "50")], "i int, e string, u string, d string, n string")
    i = F.col("i")
    assert [r["index"] for r in V.validate_emails(df, i, ["e"]).collect()] == [1]
    assert [r["index"] for r in V.validate_urls(df, i, ["u"]).collect()] == [1]
    assert [r["index"] for r in V.validate_dates(df, i, ["d"]).collect()] == [1]
    assert sorted((r["index"], r["message"]) for r in V.validate_ranges(df, i, {"n": (0, 10)}).collect()) == [(1, "Value is not a number"), (2, "Value is above maximum 10")]
    assert [r["index"] for r in V.validate_required(df, i, ["e"]).collect()] == [2]
    counts, _ = V.report(df, V.validate_required(df, i, ["e"]))
    assert values(counts) == [(3, 1, 2)]


def test_dedupe_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "x", None), (1, "x", None), (2, "y", "z"), (4, None, None), (5, None, None)], "id int, k string, v string")
    once = D.dedupe_exact(df, [F.col("id")], ["k"])
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 4]
    assert D.dedupe_exact(once, [F.col("id")], ["k"]).count() == 3


def test_url_forms(spark):
    df = spark.createDataFrame([("https://WWW.Ex.com/A/b/?utm_source=x&b=2&a=1#t",), ("not a url/",), (None,)], "u string")
    got = values(df.select(U.clean_url(F.col("u")), U.search_key(F.col("u")), U.link_key(F.col("u"))))
    assert got[0] == ("https://www.ex.com/a/b?a=1&b=2", "ex.com/a/b?utm_source=x&b=2&a=1", "ex.com/a/b")
    assert got[1] == ("not a url/", "not a url", "not a url")


def test_merge_rank(spark):
    hits = spark.createDataFrame([(0, "http://a/x", "t", "s", "p", 0.5), (1, "https://www.a/x/", "longer", "s2", "q", 0.95), (2, "http://b", "b", "s", "p", 0.2)], "_row int, url string, title string, snippet string, provider string, score double")
    got = {r["url"]: (r["title"], r["provider"], r["score"]) for r in D.merge_rank(hits).collect()}
    assert got == {"http://a/x": ("longer", "p+q", 1.0), "http://b": ("b", "p", 0.2)}


def test_quality_of_odd_texts(spark):
    q = one(spark, T.quality_metrics(F.col("t")), t="a  b\n\n\n\nc 漢")
    assert q["format_score"] == 5 and q["length_score"] == 3
    assert one(spark, T.length_score(F.col("t"), 10), t="abcd")["score"] == 2
    assert one(spark, T.utf16_length(F.col("t")), t="a😀") == 3
    assert one(spark, T.remove_boilerplate(F.col("t")), t="Keep.\n\nWe use cookies to track.\n\nAlso this.\n\nYou may also like x\n\ny") == "Keep.\n\nAlso this."
    assert one(spark, T.question_pair(F.col("a"), F.col("t")), a="Cats | Site", t="short")["instruction"] == "What is Cats?"
    assert json.loads(one(spark, T.repair_json(F.col("t")), t="```json\n{“a”: [1,2,],}\n```")) == {"a": [1, 2]}
    assert one(spark, T.claims(F.col("t")), t="it. The sky is blue today! no. 12345678901 ok") == ["The sky is blue today", " 12345678901 ok"]
    assert one(spark, T.fuzzy_label(F.col("t"), ["Cat", "Dog"]), t="dig") == "Dog"


def test_samples(spark):
    numbers = list(islice(S.xorshift(0), 3))
    assert numbers == [0, 0, 0] and sorted(S.xorshift_permutation(50, 7).tolist()) == list(range(50))
    df = spark.range(101)
    for ratios in ((0.8, 0.1, 0.1), (1.0, 0.0, 0.0)):
        n = {r["split"]: r["count"] for r in S.split(df, S.hash_order(F.col("id"), 1), ratios).groupBy("split").count().collect()}
        assert sum(n.values()) == 101 and n["train"] == int(101 * ratios[0])
    assert S.parse_ratios("80:10:10") == (0.8, 0.1, 0.1)
    with pytest.raises(ValueError):
        S.check_ratios((0.5, 0.1, 0.1))
    assert S.split(df.limit(0), S.hash_order(F.col("id"), 1)).count() == 0


def test_formats(spark):
    rows = spark.createDataFrame([("q", None, "a"), ("", "i", "a"), ("q2", "i", "b")], "instruction string, input string, output string")
    assert sorted(values(C.alpaca(rows))) == [("q", "", "a"), ("q2", "i", "b")]
    chat = spark.createDataFrame([(1, 1, "gpt", "b"), (1, 0, "human", "a")], "conv_id int, turn int, role string, text string")
    assert [tuple(m) for m in C.chatml(chat, system="s").first()["messages"]] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    images = spark.createDataFrame([("u",)], "image string").withColumns({"question": F.lit("q?"), "answer": F.lit("a")})
    assert C.llava(images).first()["conversations"][0]["value"] == "<image>\nq?"
    names = spark.createDataFrame([(1, "a/x.png", "k"), (2, "b/x.png", "k"), (3, "b/x.png", "j")], "id int, p string, label string")
    assert [r["file_name"] for r in C.class_folder(names, "p", "label", "id").orderBy("id").collect()] == ["x.png", "x_1.png", "x.png"]
    r = C.Registry()
    r.register("a", "text", C.raw)
    assert r.has("a") and r.by_category("text") == ["a"] and r.count() == 1 and r.unregister("a") and not r.unregister("a")
    with pytest.raises(KeyError):
        r.get("a")


def test_pages_and_assets(spark):
    assets = spark.createDataFrame([("1", "logo.png", "http://h/logo.png", 90000, None), ("2", "cat.jpg", "http://h/c/cat.jpg", 90000, "a cat")], "id string, name string, url string, size long, alt string")
    assert [r[0] for r in assets.select(G.junk_asset(F.col("name"), F.col("url"), F.col("size"), F.col("alt"))).collect()] == [True, False]
    found = assets.select("id", F.col("url").alias("local_path"), F.expr("array(named_struct('label','c','bbox',array(1D,2D,3D,4D),'confidence',0.4D))").alias("objects"))
    assert G.object_detection(found, 0.3).count() == 2 and G.object_detection(found, 0.5).count() == 0


def test_html(spark):
    page = "<html><title>T</title><h2>Head</h2><p>Para one of text</p><p> </p><a href='/x'>l</a><img src='i.png' alt='A'><script>no no no no no</script></html>"
    df = spark.createDataFrame([(1, "http://h/p", page), (2, None, None)], "page_id long, url string, html string")
    assert [r["type"] for r in H.html_records(df).orderBy("page_id", "ordinal").collect()] == ["link", "image", "heading", "paragraph"]
    first = H.extract_pages(df).orderBy("page_id").first()
    assert first["links"] == ["http://h/x"] and first["title"] == "T" and "no no" not in first["text"]


def test_models(spark):
    assert M.evaluate("2+2*3") == 8.0 and M.evaluate("sqrt(16)") == 4.0 and M.evaluate("1/0") is None and M.evaluate("__import__('os')") is None
    df = spark.createDataFrame([("2+2=5",), ("7/0=1",), ("none",), (None,)], "t string")
    assert M.math_filter(df, "t").count() == 3

    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [len(t) for t in texts]

    texts = spark.createDataFrame([("a",), ("bad",), ("a",), (None,)], "t string")
    got = M.call_distinct(texts, "t", scorer, "int", "n", fallback=-1)
    assert sorted(values(got), key=str) == sorted([("a", 1), ("bad", -1), ("a", 1), (None, None)], key=str)
    both = M.translate(texts.filter("t = 'a'").limit(1), ["t"], ["de", "fr"], lambda lang, ts: [f"{lang}:{t}" for t in ts])
    assert sorted(r["t"] for r in both.collect()) == ["de:a", "fr:a"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a,b"\n\n2, c \n')
    assert values(I.read_any(spark, str(tmp_path / "a.csv"))) == [("1", "a,b"), ("2", "c")]
    assert values(I.read_any(spark, str(tmp_path / "a.csv"), dialect="naive"))[0] == ("1", '"a')
    (tmp_path / "a.txt").write_text("one\n\n two \n")
    assert values(I.read_any(spark, str(tmp_path / "a.txt"))) == [(1, "one"), (2, "two")]
    (tmp_path / "a.json").write_text('[{"a":1},{"b":"x"}]')
    assert I.read_any(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "data.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert I.resolve_folder(spark, str(tmp_path / "d")).endswith("data.jsonl")
    df = I.read_any(spark, str(tmp_path / "d" / "data.jsonl"))
    for kind in ("jsonl", "csv", "parquet", "json"):
        I.write_any(df, str(tmp_path / f"out.{kind}"))
        assert I.read_any(spark, str(tmp_path / f"out.{kind}")).count() == 2
    with pytest.raises(ValueError):
        I.kind_of("x.doc")
    assert I.synthetic(spark, "person", 5, 1).collect() == I.synthetic(spark, "person", 5, 1).collect()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>h</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert values(I.read_any(spark, str(tmp_path / "a.xlsx"))) == [("v", None)]
    nulls = spark.createDataFrame([(None, None, [1])], "s string, n int, a array<int>")
    assert values(I.for_columnar(nulls)) == [("", 0, "[1]")] and values(I.for_columnar(nulls, True)) == [(None, None, "[1]")]
    png = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n"),), (bytearray(b"RIFF" + struct.pack("<I", 9) + b"WEBP"),)], "c binary")
    assert [r[0] for r in png.select(I.magic_kind(F.col("c"))).collect()] == ["png", "webp"]


def test_profiles(spark):
    df = spark.createDataFrame([(1.5, 3, "a"), (2.25, 2**40, None)], "f double, n long, s string")
    assert A.number_kind(df, "f") == "float32" and A.number_kind(df, "n") == "int64"
    assert A.features_of(df.schema)["s"] == {"_type": "Value", "dtype": "string"}
    assert "| train | 2 |" in A.dataset_card(df, "x") and A.size_category(5) == "n<1K"
    assert A.quality_distribution(spark.createDataFrame([], "s int"), "s").count() == 5


def test_steps(spark, tmp_path):
    config = {"steps": [{"type": "generate", "options": {"kind": "product", "count": 20}}, {"type": "clean"}, {"type": "filter", "options": {"where": {"field": "price", "greaterThan": -1}}}, {"type": "map", "options": {"fields": {"instruction": "Sell a {{name}}", "output": "{{price}}"}}}, {"type": "format", "options": {"format": "alpaca"}}, {"type": "export", "options": {"output": str(tmp_path / "o.jsonl")}}]}
    assert steps.run(spark, json.dumps(config)).count() == 20 and I.read_any(spark, str(tmp_path / "o.jsonl")).count() == 20
    for bad in ({"steps": []}, {"steps": [{"type": "fly"}]}):
        with pytest.raises(ValueError):
            steps.parse(json.dumps(bad))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": k % 3, "ts": f"2024-01-01T00:{k:02d}:00", "value": 1.0}) for k in range(6)))
    from pyspark.sql.types import StructType

    events = ingest.stream(spark, str(tmp_path / "in"), StructType.fromDDL("id int, ts timestamp, value double"))
    q = ingest.once(events, ["id"], "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 3
