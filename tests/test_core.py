from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import text, urls
from strandline.operators import dedup, graph, quality, resolve
from strandline.sources import readers, writers
from strandline.streaming import queue


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(
    "raw,want",
    [("Caf&eacute; “Bank”", "cafe bank"), ("The Ministry’s  Board.", "the ministry board"), ("A–B (XY) Ltd!", "a b ltd"), (None, ""), ("  ", ""), ("Tab\tand\nline", "tab and line"),
     ("AT&T", "at t"), ("AT&amp;T", "at t"), ("U.N. Water", "u n water"), ("A/B Board", "a b board"), ("Caf&eacute; Trust", "cafe trust"), ("Caf&#233; Tr&#xFC;st", "cafe trust"), ("Energy Regulatory Authority (ERA)", "energy regulatory authority"),
     ("Board (North)West", "board west"), ("Grain-Marketing Board", "grain marketing board"), ("“Power” Company’s.", "power company"), ("a &unknown; b", "a unknown b"), ("&#0;&#xD800;", "0 xd800")],
)
def test_match_form(spark, raw, want):
    assert one(spark, text.match_form, raw) == want


@pytest.mark.parametrize("raw,want", [("Energy Authority (zera)", "ZERA"), ("ZERA report", "ZERA"), ("plain name", None), ("(Bank) x", "BANK")])
def test_acronym(spark, raw, want):
    assert one(spark, text.acronym_in, raw) == want


@pytest.mark.parametrize("n,count", [(0, 1), (1, 1), (4000, 1), (4001, 2), (7800, 2), (7801, 3), (8100, 3)])
def test_chunks(spark, n, count):
    got = one(spark, text.chunks, "x" * n)
    assert len(got) == count and got[-1]["chunk"] == ("x" * n)[(count - 1) * 3800 :][:4000]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("HTTPS://User@Ex.example:8080/A/?b=1&utm_source=x#f", "https://ex.example/A?b=1"), ("http://ex.example", "http://ex.example/"), ("ftp://x.example/", ""), ("no url", ""), (None, None),
    ],
)
def test_identity(spark, raw, want):
    assert (one(spark, urls.identity, raw) or None) == (want or None)


@pytest.mark.parametrize("raw,want", [("Ex.example//A//b/", "https://ex.example/a/b"), ("http://ex.example:80/?ref=1&q=2&flag", "http://ex.example/?q=2&flag"), ("", ""), ("mailto:x@y.example", "mailto:x@y.example")])
def test_fetchable(spark, raw, want):
    assert one(spark, urls.fetchable, raw) == want


@pytest.mark.parametrize(
    "content,want",
    [(None, "empty"), (" ", "empty"), ("Access Denied here " + "x" * 300, "block_page"), ("error 404 " + "y" * 300, "error_page"), ("home about contact", "navigation"), ("welcome " + "z" * 120, "soft_404"), ("z" * 199, "thin"), ("z" * 200, "substantive")],
)
def test_quality(spark, content, want):
    assert one(spark, quality.extraction_quality, content) == want


def test_markup(spark):
    html = "<html><head><title>t</title></head><body><script>x<y</script><p>One</p><!-- no --><p>Two &amp; three</p></body></html>"
    assert one(spark, text.markup_text, html) == "One Two & three"


def test_evidence_merge_rules(spark):
    rows = [(1, "http://a.example/x", None, "q1", None, None, "Same  text", None), (2, "http://a.example/x/", "http://o.example", "q2", "N", "7", "other", None), (3, "http://b.example/", None, "q1", None, None, "Same text", None), (4, None, None, "q", None, None, "t", None)]
    df = spark.createDataFrame(rows, "evidence_id int, url string, original_url string, query string, entity_name string, entity_id string, content string, snippet string")
    merged = dedup.merge_by_url(df, "evidence_id")
    by = {r["url_key"]: r for r in merged.collect()}
    assert by["http://a.example/x"]["queries"] == "q1|q2" and by["http://a.example/x"]["entity_name"] == "N" and by["http://a.example/x"]["original_url"] == "http://o.example"
    assert sorted(r["n_urls"] for r in dedup.merge_by_content(merged).collect()) == [2]


def test_resolution_order(spark):
    nodes = spark.createDataFrame([("u1", "Alpha Water Board", ["AWB"]), ("u2", "Beta Fund", ["Twin"]), ("u3", "Gamma Fund", ["Twin"])], "uid string, entity string, aliases array<string>")
    m = spark.createDataFrame([("alpha water board.",), ("awb",), ("Twin",), ("Nobody",), ("",), ("Beta Fund (ZZ)",)], "mention string")
    got = {r["mention"]: (r["state"], r["uid"]) for r in resolve.resolve(m, nodes).collect()}
    assert got["alpha water board."] == ("RESOLVED", "u1") and got["awb"] == ("RESOLVED", "u1") and got["Twin"][0] == "AMBIGUOUS" and got["Nobody"][0] == "NEW_ENTITY" and got[""][0] == "NEW_ENTITY" and got["Beta Fund (ZZ)"] == ("RESOLVED", "u2")


def test_fuzzy_equals_brute_force(spark):
    from difflib import SequenceMatcher

    names = ["northern water board", "northern watr board", "southern water board", "gas company limited", "gas compny limited"]
    nodes = spark.createDataFrame([(f"u{i}", n, []) for i, n in enumerate(names)], "uid string, entity string, aliases array<string>")
    got = {(r["mention"], r["uid"]) for r in resolve.fuzzy(spark.createDataFrame([(n,) for n in names], "mention string"), nodes).collect()}
    assert got == {(a, f"u{j}") for a in names for j, b in enumerate(names) if SequenceMatcher(None, a, b).ratio() >= 0.85}


def test_registry_numbers(spark):
    df = spark.createDataFrame([(5, "B"), (9000, "A"), (7, "b!"), (20000, "C")], "seq long, name string")
    assert {(r["entity_id"], r["canonical_name"]) for r in resolve.registry(df).collect()} == {("ENTITY-000001", "B"), ("ENTITY-000002", "A"), ("ENTITY-000003", "C")}


def test_provenance_merge(spark):
    s = "id string, s array<string>"
    got = {r["id"]: (r["outcome"], r["sources"]) for r in graph.merge_provenance(spark.createDataFrame([("a", ["1"]), ("b", ["1"]), ("c", ["1"])], s), spark.createDataFrame([("a", ["2"]), ("b", ["1"]), ("d", ["9"])], s), "id", "s").collect()}
    assert got == {"a": ("updated", ["2", "1"]), "b": ("unchanged", ["1"]), "c": ("kept", ["1"]), "d": ("created", ["9"])}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Entity,Name,Type,Alias,Metadata,Source IDs,Status\n 1 ,A,person,"[""x"",""""]","{""k"":""v""}","a, b",NEW\n2,B,person,y,plain,,\n')
    rows = {r["entity_id"]: r for r in readers.sheet(spark, str(tmp_path / "s.csv")).collect()}
    assert rows["1"]["aliases"] == ["x"] and rows["1"]["source_count"] == 2 and rows["2"]["metadata"] == {"value": "plain"} and rows["2"]["source_count"] == 0
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps([{"entity_id": "1", "source_ids": ["a"]}]))
    (tmp_path / "j" / "b.json").write_text(json.dumps({"entities": [{"entity_id": "2"}]}))
    assert {(r["entity_id"], r["source_count"]) for r in readers.snapshot(spark, str(tmp_path / "j")).collect()} == {("1", 1), ("2", 0)}
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "x.md").write_text("---\ntitle: 'T'\nentity: E\n---\n\n# H\nSee [[A]] and [B](u) and [[A]].")
    note = readers.notes(spark, str(tmp_path / "n")).collect()[0]
    assert (note["title"], note["entity"], sorted(note["links"])) == ("T", "E", ["A", "B"])
    nodes = spark.createDataFrame([("u", "E|,\"", ["a", "b"], None, None, None, None, None, "s\nt", [], [], ["x"])], "uid string, entity string, aliases array<string>, entity_type string, subtype string, country string, sector string, status string, summary string, relationships array<string>, associations array<string>, sources array<string>")
    writers.bundle(nodes, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out/csv")).collect()[0]
    assert back["entity"] == 'E|,"' and back["aliases"] == "a|b" and back["summary"] == "s\nt"
    with pytest.raises(ValueError):
        writers.bundle(nodes.withColumn("summary", F.lit(" ")), str(tmp_path / "bad"))


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "id string, t string").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("id string, t string").parquet(src)
        queue.ingest(stream, out, str(tmp_path / "ck"), "id", "t").awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    spark.createDataFrame([("c", "z"), ("a", "x"), ("a", "new")], "id string, t string").write.mode("append").parquet(src)
    queue.ingest(spark.readStream.schema("id string, t string").parquet(src), out, str(tmp_path / "ck"), "id", "t").awaitTermination(60)
    assert sorted((r["id"], r["t"]) for r in spark.read.parquet(out).collect()) == [("a", "new"), ("a", "x"), ("b", "y"), ("c", "z")]


def test_last_state(spark):
    from datetime import datetime

    t = lambda d: datetime(2026, 1, d)
    df = spark.createDataFrame([("k", "PROCESSING", t(2)), ("k", "PENDING", t(1)), ("k", "COMPLETED", t(2))], "key string, state string, ts timestamp")
    assert [tuple(r)[:2] for r in queue.last_states(df).collect()] == [("k", "COMPLETED")]


def test_mentions(spark):
    from strandline.plans.text_queries import mentions

    claims = [(1, "The Port Board met José Núñez."), (2, "Совет Порта and Port Board agreed – at last"), (3, "Cafe\u0301 Rio, caf\u00e9 Rio"), (4, None), (5, "港湾局が発表")]
    got = {(r["mention"], r["n"], r["claims"], r["first_seq"]) for r in mentions(spark.createDataFrame(claims, "seq long, claim_text string")).collect()}
    assert got == {("The Port Board", 1, 1, 1), ("José Núñez", 1, 1, 1), ("Совет Порта", 1, 1, 2), ("Port Board", 1, 1, 2), ("Cafe\u0301 Rio", 1, 1, 3), ("Rio", 1, 1, 3)}


def test_numbers_within_slices(spark):
    from strandline.seq import numbered

    rows = [(k, i) for i in range(60) for k in ("a", None) if i % 3 or k]
    got = {(r["k"], r["i"]): r["n"] for r in numbered(spark.createDataFrame(rows, "k string, i long"), ["k"], "i", "n", 7).collect()}
    assert got == {(k, i): n for key in ("a", None) for n, (k, i) in enumerate([r for r in rows if r[0] == key], 1)}


def test_titles(spark):
    want = {"josé nÚÑEZ-o'dálaigh": "José Núñez-O'Dálaigh", "совет ПОРТА 3a": "Совет Порта 3A", "cafe\u0301 RIO": "Cafe\u0301 Rio", "港湾局 x": "港湾局 X", "": "", "- 7": "- 7"}
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r["s"]: r["t"] for r in rows.select("s", text.title_case(F.col("s")).alias("t")).collect()} == want


def test_fuzzy_loses_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(8)
    names = ["nmsrc", "nmrc"]
    for _ in range(120):
        x = "".join(rng.choice("abc ") for _ in range(rng.randint(4, 24)))
        names.append(x)
        for _ in range(2):
            y = list(x)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "d"])
            names.append("".join(y))
    names = sorted({f for n in names if len(f := " ".join(n.split())) > 3})
    nodes = spark.createDataFrame([(f"u{i}", n, []) for i, n in enumerate(names)], "uid string, entity string, aliases array<string>")
    got = {(r["mention"], r["uid"]) for r in resolve.fuzzy(spark.createDataFrame([(n,) for n in names], "mention string"), nodes).collect()}
    assert got == {(a, f"u{j}") for a in names for j, b in enumerate(names) if SequenceMatcher(None, a, b).ratio() >= 0.85}
