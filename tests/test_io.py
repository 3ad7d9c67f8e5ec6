"""Sources, sinks, streaming resume and duplicate-history resolution."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pricelens.operators.cleaning import resolve_duplicate_histories
from pricelens.sources.cpi import load_cpi
from pricelens.sources.landed import catalog_rows, chart_points, ingest_status
from pricelens.sources.sinks import cache_or_compute, metrics_document, write_append, write_quarantine
from pricelens.sources.tables import read_optional
from pricelens.streaming.ingest import start_page_ingest


def _tmp():
    return tempfile.mkdtemp(prefix="pricelens-test-")


def test_cpi_loader_tolerant_headers(spark):
    d = _tmp()
    with open(os.path.join(d, "cpi.csv"), "w") as f:
        f.write(" Year , Annual \n2021,270.0\n2022,290.5\nbad,1\n")
    got = {(r.year, r.value) for r in load_cpi(spark, d).collect()}
    assert got == {(2021, 270.0), (2022, 290.5)}
    assert load_cpi(spark, os.path.join(d, "missing.csv"), required=False).count() == 0


def test_optional_source_and_cache(spark):
    d = _tmp()
    df = read_optional(spark, os.path.join(d, "nope"), spark.range(1).schema)
    assert df.count() == 0 and df.columns == ["id"]
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)
    p = os.path.join(d, "stage")
    assert cache_or_compute(spark, p, compute).count() == 5
    assert cache_or_compute(spark, p, compute).count() == 5
    assert len(calls) == 1


def test_append_fixed_schema_and_quarantine(spark):
    d = _tmp()
    schema = spark.createDataFrame([], "a string, b bigint").schema
    write_append(spark.createDataFrame([(1, "x")], "b int, a string"), os.path.join(d, "t"), schema)
    write_append(spark.createDataFrame([("y", 2)], "a string, b int"), os.path.join(d, "t"), schema)
    assert {tuple(r) for r in spark.read.parquet(os.path.join(d, "t")).collect()} == {("x", 1), ("y", 2)}
    tagged = spark.createDataFrame([(1, None), (2, "hardware")], "id int, exclusion_reason string")
    assert write_quarantine(tagged, os.path.join(d, "inc"), os.path.join(d, "exc")) == (1, 1)
    none = spark.createDataFrame([(1, None)], "id int, exclusion_reason string")
    write_quarantine(none, os.path.join(d, "inc2"), os.path.join(d, "exc2"))
    assert not os.path.exists(os.path.join(d, "exc2"))


def test_metrics_document(spark):
    m = metrics_document(spark, {"eval": {"h1_12": {"n": 10, "rmse": 1.5}}, "n_items": 3})
    r = m.first()
    assert r.n_items == 3 and r.eval.h1_12.rmse == 1.5


def test_chart_parsing_and_status(spark):
    pages = spark.createDataFrame([
        ("a", 200, '<script>VGPC.chart_data = {"used": [[1262304000000, 1250], [1, 0], [1, 2, 3]], "zz": [[1, 5]]};</script>'),
        ("b", 200, "<html>nothing</html>"),
        ("c", 500, None),
        ("d", 200, '<script>VGPC.chart_data = {"new": [[1262304000000, 0]]};</script>'),
        ("e", 200, '<script>VGPC.chart_data = {broken;</script>'),
    ], "page_id string, http_status int, html string")
    pts = [tuple(r) for r in chart_points(pages).collect()]
    assert len(pts) == 1 and pts[0][1] == "loose" and str(pts[0][2]) == "2010-01-01" and pts[0][3] == 12.5
    st = {r.page_id: r.status for r in ingest_status(pages).collect()}
    assert st == {"b": "no_data", "c": "fetch_error", "d": "empty", "e": "no_data"}


def test_catalog_rows(spark):
    body = json.dumps({"products": [{"productName": "Zelda", "consoleUri": "wii", "productUri": "zelda"}], "cursor": "2"})
    rows = catalog_rows(spark.createDataFrame([("Wii", body)], "console string, body string")).collect()
    assert rows[0].title == "Zelda" and rows[0].url.endswith("/game/wii/zelda")


def test_streaming_resume(spark):
    d = _tmp()
    landed, out, status, ck = (os.path.join(d, x) for x in ("landed", "points", "status", "ck"))
    os.makedirs(landed)

    def land(name, rows):
        with open(os.path.join(landed, name), "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")
    page = '<script>VGPC.chart_data = {"used": [[1262304000000, 1000]]};</script>'
    land("f1.json", [{"page_id": "p1", "http_status": 200, "html": page}, {"page_id": "p2", "http_status": 404}])
    start_page_ingest(spark, landed, out, status, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    land("f2.json", [{"page_id": "p3", "http_status": 200, "html": page}])
    start_page_ingest(spark, landed, out, status, ck).awaitTermination()
    ids = sorted(r.page_id for r in spark.read.parquet(out).collect())
    assert ids == ["p1", "p3"]                      # f1 not processed twice
    assert [r.status for r in spark.read.parquet(status).collect()] == ["fetch_error"]


def test_duplicate_histories(spark):
    df = spark.createDataFrame([
        (1, "2020-01-01=1.00", 60, "exact", 100.0, "Zelda"),
        (2, "2020-01-01=1.00", 60, "fuzzy", 90.0, "Zelda x"),
        (3, "2020-01-01=1.00", 5, "exact", 100.0, "Z"),      # too few records: not eligible
        (4, "2020-02-01=2.00", 60, None, None, "Other"),
    ], "item_id int, price_history string, price_record_count int, match_type string, match_score double, title string")
    got = {r.item_id: r.exclusion_reason for r in resolve_duplicate_histories(df, 50).collect()}
    assert got == {1: None, 2: "duplicate_price_history", 3: None, 4: None}


def test_sales_table_rows(spark):
    from pricelens.sources.landed import sales_table_rows
    html = ('<div id="nav"><table><tr><td>1</td><td></td><td><a href="/game/9/">Menu</a></td>'
            '<td></td><td></td><td>9m</td><td></td><td></td></tr></table></div>'
            '<div id="generalBody"><table>'
            '<tr><th>Pos</th></tr>'
            '<tr><td>1</td><td></td><td><a href="/game/1/"><b>Zelda</b></a></td><td></td><td></td>'
            '<td>1.25m</td><td>N/A</td><td>x</td></tr>'
            '<tr><td>2</td><td></td><td><a href="https://x.org/game/2/">Mario</a></td><td></td><td></td>'
            '<td><0.01</td><td>0.30m</td><td>x</td></tr>'
            '<tr><td>3</td><td></td><td><a href="/news/3/">News</a></td><td></td><td></td><td>1m</td><td></td><td></td></tr>'
            '<tr><td>4</td><td></td><td><a href="/game/4/"> </a></td><td></td><td></td><td>1m</td><td></td><td></td></tr>'
            '<tr><td>5</td><td><a href="/game/5/">Short</a></td></tr>'
            '</table></div>')
    rows = sales_table_rows(spark.createDataFrame([("Wii", html)], "console string, html string"),
                            base_url="https://s.org").collect()
    got = sorted((r.title, r.sales_url, r.units_global_m, r.units_na_m) for r in rows)
    assert got == [("Mario", "https://x.org/game/2/", None, 0.3), ("Zelda", "https://s.org/game/1/", 1.25, None)]


def test_top_k_hot_group_matches_window(spark):
    from pyspark.sql import Window
    from pricelens.operators.topk import top_k_per_group
    rows = [("hot", f"t{i:05d}", i) for i in range(3000)] + [("cold", f"c{i}", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, title string, id int")
    got = {(r.g, r.title, r.rank) for r in top_k_per_group(df, ["g"], ["title", "id"], 10, salt_key=["id"]).collect()}
    w = Window.partitionBy("g").orderBy("title", "id")
    ref = {(r.g, r.title, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).where("rn <= 10").collect()}
    assert got == ref and len(got) == 15


def test_sales_table_in_real_markup(spark):
    """Attributes in any order and quotes, nested and later containers, character references."""
    from pricelens.sources.landed import decode_entities, sales_table_rows
    row = ("<tr><td>1</td><td>x</td><td><a class=t href='{href}' title=\"y\">{title}</a></td><td>a</td><td>b</td>"
           "<td>{g}</td><td>{na}</td><td>c</td></tr>")
    inside = row.format(href="/game/1/a?x=1&amp;y=2", title="Mario &amp; Luigi&#39;s <b>Caf&#xE9;</b>", g="1.50m", na="0.50m")
    later = row.format(href="/game/2/b", title="Elsewhere", g="9.00m", na="9.00m")
    pages = [
        f"<html><DIV class=\"x\" id=\"generalBody\" style='a'><div>menu</div><table>{inside}</table></DIV><div>{later}</div></html>",
        f"<div id='generalBody'><table>{inside}</table><div><div>deep</div></div></div>{later}",
        f"<div id=generalBody>{inside}</div><div id=\"generalBodyTwo\">{later}</div>",
        f"<div id=\"generalBodyTwo\">{later}</div>",
        f"<div data-id=\"generalBody\">{later}</div>",
    ]
    df = spark.createDataFrame([("Wii", p) for p in pages], "console string, html string")
    got = [tuple(r) for r in sales_table_rows(df, base_url="https://s.example").collect()]
    assert got == [("Mario & Luigi's Café", "https://s.example/game/1/a?x=1&y=2", "Wii", 1.5, 0.5)] * 3
    refs = [("&lt;&#60;&#x3c;&amp;lt;", "<<<&lt;"), ("&#128512;&unknown;&#99999999;", "\U0001f600&unknown;&#99999999;"), ("", ""), (None, None)]
    df = spark.createDataFrame(refs, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", decode_entities(F.col("t")).alias("got")).collect())


def test_overwrite_refuses_its_own_input(spark):
    from pricelens.sources.sinks import write_overwrite
    d = _tmp()
    write_overwrite(spark.range(3), os.path.join(d, "a"))
    same = spark.read.parquet(os.path.join(d, "a"))
    try:
        write_overwrite(same, os.path.join(d, "a"))
        raise AssertionError("not refused")
    except ValueError:
        pass
    write_overwrite(same, os.path.join(d, "ab"))
    assert spark.read.parquet(os.path.join(d, "a")).count() == spark.read.parquet(os.path.join(d, "ab")).count() == 3


def test_fixed_schema_readers(spark):
    from pricelens.sources.landed import read_game_documents
    from pricelens.sources.tables import read_csv
    d = _tmp()
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("title,console,n\nA,Wii,1\n\"B, C\",Wii U,\n")
    schema = spark.createDataFrame([], "title string, console string, n int").schema
    assert [tuple(r)[:3] for r in read_csv(spark, os.path.join(d, "t.csv"), schema).collect()] == [("A", "Wii", 1), ("B, C", "Wii U", None)]
    with open(os.path.join(d, "g.json"), "w") as f:
        f.write(json.dumps({"id": 7, "name": "X", "genres": [{"name": "RPG"}], "other": 1}) + "\n{broken\n")
    good, dead = read_game_documents(spark, os.path.join(d, "g.json"))
    rows = good.collect()
    assert rows[0].id == 7 and rows[0].genres[0].name == "RPG" and len(rows) == 1
    assert [tuple(r) for r in dead.collect()] == [("{broken", "malformed")]
