from pyspark.sql import functions as F
from threadmill.sources import readers
from threadmill.streaming import log


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("F-5", "Visa", "set & <tled>"), ("x", "", "")], "id string, type string, label string")
    rows = [("F-5", "x", "REQUIRES", 'a "b"; c', 2, 0.5, True), ("x", "F-5", "R", "", None, None, False)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, sources string, n_sources long, weight double, kept boolean")
    text = "\n".join(r.line for r in sorted(readers.graphml_lines(nodes, edges).collect(), key=lambda r: r.part))
    (tmp_path / "g.graphml").write_text(text)
    n, e = readers.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.dtypes == nodes.dtypes and e.dtypes == edges.dtypes
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in nodes.collect()} and {tuple(r) for r in e.collect()} == set(rows)
    keys = '<graphml><key id="d10" for="edge" attr.name="late" attr.type="long"/><key id="d2" for="all" attr.name="x" attr.type="string"/><graph>'
    (tmp_path / "h.graphml").write_text(keys + '<node id="a"><data key="d2">  v</data></node><node id="b"/><edge source="a" target="b">\n <data key="d10"> 7 </data></edge></graph></graphml>')
    n, e = readers.read_graphml(spark, str(tmp_path / "h.graphml"))
    assert n.columns == ["id", "x"] and e.columns == ["src", "dst", "x", "late"]
    assert {r.id: (r.x or "").strip() for r in n.collect()} == {"a": "v", "b": ""} and [tuple(r) for r in e.collect()] == [("a", "b", None, 7)]
    readers.write_graph(nodes, edges, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/nodes")).count() == 2 and spark.read.parquet(str(tmp_path / "p/edges")).count() == 2


def test_corpus_and_logs(spark, tmp_path):
    docs = spark.createDataFrame([("a/b: c", "see (F5) and (E 7) and (F-6)")], "title string, body string")
    readers.write_corpus(docs, str(tmp_path / "c"))
    r = spark.read.parquet(str(tmp_path / "c")).first()
    assert (r.file, r.body) == ("a_b__c.md", "see (F-5) and (E-7) and (F-6)")
    rows = spark.createDataFrame([("q1", 3)], "q string, n int")
    for _ in range(2):
        readers.append_log(rows, str(tmp_path / "log"))
        readers.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "report")).count() == 1


def test_cache_on_disk(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.select("k", F.lit(len(asked)).alias("v"))

    todo = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    at = str(tmp_path / "cache")
    assert {(r.k, r.v) for r in readers.kept_in_cache(todo("a", "b"), at, "k", compute).collect()} == {("a", 1), ("b", 1)}
    assert {(r.k, r.v) for r in readers.kept_in_cache(todo("b", "c"), at, "k", compute).collect()} == {("b", 1), ("c", 2)}
    assert {(r.k, r.v) for r in readers.kept_in_cache(todo("a"), at, "k", compute, force=True).collect()} == {("a", 3)}
    assert asked == [["a", "b"], ["c"], ["a"]]


def test_items_that_fail(spark):
    items = spark.createDataFrame([("good", bytearray(b"text")), ("bad", bytearray(b"\xff"))], "name string, content binary")
    fine, skipped = readers.try_items(items, lambda b: b.decode())
    assert [(r.name, r.text) for r in fine.collect()] == [("good", "text")]
    bad = skipped.first()
    assert bad.name == "bad" and bad.reason.startswith("UnicodeDecodeError")


def test_log_stream(spark, tmp_path):
    rows = [("2024-01-01T00:01:00", "local", False), ("2024-01-01T00:02:00", "path", True), ("2024-01-01T00:03:00", "local", True), ("2024-01-01T00:21:00", "local", False)]
    spark.createDataFrame(rows, "ts string, route string, refused boolean").coalesce(1).write.json(str(tmp_path / "in"))
    q = log.log_counts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.window.start.minute, r.route, r.n, r.n_refused) for r in spark.table("counts").collect()) == [(0, "local", 2, 1), (0, "path", 1, 1), (20, "local", 1, 0)]


def test_articles_in_order(spark, tmp_path):
    """Nested items in the order of the document; other titles left out; a broken block is a row of its own."""
    text = """<law><art><no>1</no><title><![CDATA[stay]]></title><own><![CDATA[One <img src="x"/> says]]></own>
      <par><ptext>p1</ptext><item><itext>i1</itext><sub><stext>s1</stext></sub><sub><stext> s2 </stext></sub></item><item><itext>i2</itext></item></par>
      <par><ptext><![CDATA[p2\n\nmore]]></ptext></par></art>
      <art><no>2</no><title>fines</title><own>none</own></art><art><no>3</no><title>stay</title><own>alone</own></art>
      <art><no>4</no><title>stay</own></art></law>"""
    (tmp_path / "law.xml").write_text(text)
    got, skipped = readers.read_nested_articles(spark, str(tmp_path / "law.xml"), "art", ["no", "title"], "own", [("par", "ptext"), ("item", "itext"), ("sub", "stext")], ("title", "stay"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "stay", "One says p1 i1 s1 s2 i2 p2 more"), ("3", "stay", "alone")]
    assert [r.reason for r in skipped.collect()] == ["not well formed"]


def test_cache_by_content(spark, tmp_path):
    """Order and partitions don't matter, any changed row does; a killed write leaves what was there."""
    made = []

    def compute(df):
        made.append(df.count())
        return df.groupBy("a").count()

    rows = [("x", 1), ("y", None), ("y", None), ("", 2)]
    frame = lambda rs: spark.createDataFrame(rs, "a string, b int")
    at = str(tmp_path / "c")
    first = {tuple(r) for r in readers.cached_by_content(frame(rows), at, compute).collect()}
    assert {tuple(r) for r in readers.cached_by_content(frame(rows[::-1]).repartition(3), at, compute).collect()} == first and made == [4]
    for other in (rows[:3], [*rows[:3], (None, 2)], [("x", 1), ("x", 1), *rows[1:]], [("x", 2), ("y", None), ("y", None), ("", 1)]):
        readers.cached_by_content(frame(other), at, compute)
    assert len(made) == 5

    def killed(df):
        return df.select(F.raise_error(F.lit("killed")).cast("int").alias("b"))

    readers.published(frame(rows), str(tmp_path / "t"))
    try:
        readers.published(killed(frame(rows)), str(tmp_path / "t"))
        raise AssertionError
    except Exception as e:
        assert "killed" in str(e)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
