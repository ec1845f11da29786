"""Steps that failed, or grew faster than their input, on larger copies of the tables."""

from pyspark.sql import functions as F

from terracol.operators import graph as G
from terracol.operators import joins as J
from terracol.operators import nearest as N
from terracol.operators import raster as R


def at(df):
    return {(r["row"], r["col"]) for r in df.collect()}


def test_edges_are_not_broadcast(spark):
    """An edge's copies are many times the table it comes from, so the planner's estimate of their size doesn't hold."""
    pixels = spark.range(400).selectExpr("int(id / 20) AS row", "int(id % 20) AS col", "id % 20 * 0.5D AS lon", "int(id / 20) * 0.5D AS lat")
    edges = spark.createDataFrame([(1, 0.1, 0.1, 7.3, 8.2)], "line int, x0 double, y0 double, x1 double, y1 double")
    once = J.road_pixels(pixels, edges, 20, 20, (0.5, 0.5))
    assert "BroadcastHashJoin" not in once._jdf.queryExecution().toString()
    many = J.road_pixels(pixels, edges.crossJoin(spark.range(50)), 20, 20, (0.5, 0.5))
    assert at(many) == at(once) and many.count() == once.count() > 15


def test_circle_far_from_the_origin(spark):
    cells = spark.createDataFrame([(90_000, 3), (90_001, 3), (1, 2_000_000_000), (0, -2_000_000_000)], "row int, col int")
    assert at(R.circle_mask(cells, 90_000, 3, 0.5)) == {(90_000, 3)}
    assert at(R.circle_mask(cells, 10, 50, 9.5)) == set()


def test_places_are_asked_once(spark, monkeypatch):
    """3,000 rows on 30 places ask for 30 answers among 20 places, each with the row that asking them all gives."""
    left = spark.range(3000).selectExpr("id AS idx", "(id * 7) % 30 * 0.5D AS lx", "(id * 7) % 30 % 4 * 1.0D AS ly")
    right = spark.range(2000).selectExpr("1999 - id AS k", "id % 20 * 0.75D AS rx", "id % 20 % 3 * 1.0D AS ry")
    seen, answer = [], N._answer

    def watched(asked, dealt, *more):
        seen.append((asked.count(), dealt.count()))
        return answer(asked, dealt, *more)

    monkeypatch.setattr(N, "_answer", watched)
    got = J.nearest(left, right, "idx", ["k"])
    assert got.columns == ["idx", "lx", "ly", "k", "rx", "ry", "d2"] and seen == [(30, 20)]
    places = [r.asDict() for r in right.groupBy("rx", "ry").agg(F.min("k").alias("k")).collect()]
    want = {(x, y): min(((x - p["rx"]) ** 2 + (y - p["ry"]) ** 2, p["k"]) for p in places) for x, y in left.select("lx", "ly").distinct().collect()}
    rows = got.collect()
    assert len(rows) == 3000 and all((r["d2"], r["k"]) == want[r["lx"], r["ly"]] for r in rows)


def test_first_points_of_places_lead(spark, monkeypatch):
    points = spark.range(4000).selectExpr("id AS idx", "(id * 13) % 40 * 0.3D AS x", "0.0D AS y")
    seen, settle = [], J._settle
    monkeypatch.setattr(J, "_settle", lambda open_, *more: seen.append(open_.count()) or settle(open_, *more))
    got = {r["idx"] for r in J.leading_points(points, 0.7).collect()}
    want = {}
    for idx, x in ((i, i * 13 % 40 * 0.3) for i in range(4000)):
        if all(abs(x - u) >= 0.7 for u in want.values()):
            want[idx] = x
    assert got == set(want) and max(seen) <= 40


def test_near_places_are_not_broadcast(spark):
    left = spark.range(300).selectExpr("id", "id * 0.1D AS lx", "0.0D AS ly")
    right = spark.range(1000).selectExpr("id % 3 * 9.0D AS rx", "0.0D AS ry")
    near = J.near_any(left, right, 0.35)
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().toString()
    assert {r["id"] for r in near.collect()} == {i for i in range(300) if any(abs(i * 0.1 - u) < 0.35 for u in (0.0, 9.0, 18.0))}


def test_routes_are_walked_once(spark):
    """Pairs of equal ends: the last one's segment is on the path, as if all were walked."""
    cells = spark.range(100).selectExpr("int(id / 10) AS row", "int(id % 10) AS col")
    pairs = spark.range(60).selectExpr("id AS pair_id", "id * 7 % 5 AS seg_id", "id * 1.0D AS pci", "int(id % 4) AS r0", "0 AS c0", "int(id % 3) + 6 AS r1", "9 AS c1")
    last = G.last_of_routes(pairs)
    assert last.count() == 12
    every, few = (G.segment_burn(G.shortest_paths(cells, p), pairs) for p in (pairs, last))
    assert all(sorted(a.collect()) == sorted(b.collect()) for a, b in zip(every, few, strict=True))


def test_line_values_by_place(spark, tmp_path):
    """Many vertices of one place count once: a cell takes the first of the nearest."""
    from terracol.plans import queries as Q

    rows = [(k, k % 3) for k in [*range(40), *range(900, 940), *range(1800, 1840)]]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    found = Q.j8_line_pixel_values(spark, str(tmp_path))
    place = lambda k: ((k * 7) % 90, k % 100)
    got = {(r["row"], r["col"]): r["value"] for r in found.collect()}
    for (row, col), value in got.items():
        d2, k = min(((row - place(k)[0]) ** 2 + (col - place(k)[1]) ** 2, k) for k, _ in rows)
        assert value == (k % 101 if d2 <= 3.5**2 else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) > 300 and "min_by(value" in plan


def test_a_long_row_of_squares_is_joined_in_few_rounds(spark, monkeypatch):
    """60 squares in a row, in the order of their first cells, hang together."""
    monkeypatch.setattr(G, "TILE", 4)
    rounds, keep = [], G.materialised
    monkeypatch.setattr(G, "materialised", lambda df: rounds.append(1) or keep(df))
    cells = spark.range(240).selectExpr("int(id) AS row", "0 AS col", "1.0D AS label").unionByName(spark.range(3).selectExpr("int(id) * 2 + 10 AS row", "2 AS col", "1.0D AS label"))
    got = G.connected_components(cells, True, by="label").groupBy("component").count().collect()
    assert sorted(r["count"] for r in got) == [1, 1, 1, 240] and len(rounds) <= 3 + 4 * 8


def test_page_lines_are_found_once(spark):
    """Both passes of op3 read the written lines: no pattern is left in the last one's plan."""
    from terracol.llm import line_dedup

    pages = spark.createDataFrame([(i, f"http://h{i % 2}/x", f"<p>same</p><script>no</script><p>own {i}</p>") for i in range(8)], "page_id long, url string, html string")
    out = line_dedup.line_report(pages)
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r)[:4] for r in out.orderBy("page_id").collect()] == [(i, f"h{i % 2}", 4, 1) for i in range(8)]


def test_the_flow_scales_its_pixels_once(spark):
    """Every step of the flow reads the written layers: no later plan crops and scales the image again."""
    from terracol.plans import pipeline as P

    pixels = spark.range(1600).selectExpr("int(id / 40) AS row", "int(id % 40) AS col", "id % 40 * 0.001D AS lon", "int(id / 40) * 0.001D AS lat", "array(id + 1D) AS bands")
    points = spark.range(30).selectExpr("id AS idx", "id * 0.0011D AS lon", "id * 0.0009D AS lat", "id % 5 + 1D AS pci", "1 AS seg_id")
    scene = P.Scene(pixels, pixels.select("row", "col"), points, 40, 40)
    out = P.pavement_pipeline(scene, (-1.0, 1.0, -1.0, 1.0), crop=8, overlap=0.25)["patches"]
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    top = max(r["bands"][0] for r in rows)
    assert rows and 0.5 < top <= 1.0 and all(r["label"] > 0 or r["bands"][0] == 0 for r in rows)


def test_folders_do_not_follow_the_table(spark, tmp_path, monkeypatch):
    """A strip of 400 zones is stored in few folders of larger ones, and gives the same rows."""
    from terracol.sources import tables as S

    monkeypatch.setattr(S, "MOST_FOLDERS", 40)
    pixels = spark.range(6400).selectExpr("int(id / 4) AS row", "int(id % 4) AS col", "id % 2 AS data_source", "id AS value")
    path = str(tmp_path / "pixels")
    S.write_pixel_table(pixels, path, zone_bits=2)
    folders = [p for p in (tmp_path / "pixels").glob("data_source=*/zone_*")]
    assert 8 <= len(folders) <= 44
    assert {r["value"] for r in S.scan_pixel_table(spark, path, 1).collect()} == set(range(1, 6400, 2))
    got = S.scan_pixel_table(spark, path, 0, (700, 790, 1, 4)).collect()
    assert {r["value"] for r in got} == {r * 4 + c for r in range(700, 790) for c in range(1, 4) if (r * 4 + c) % 2 == 0}


def test_rows_far_from_all_places_are_not_sent(spark):
    """A semi-join sorts what may be near a place: of 100,000 rows on a line the 30 around two places."""
    left = spark.range(100_000).selectExpr("id", "id * 0.1D AS lx", "0.0D AS ly")
    right = spark.createDataFrame([(5.0, 0.0), (7.0, 0.05)], "rx double, ry double")
    near = J.near_any(left, right, 0.35)
    assert {r["id"] for r in near.collect()} == {i for i in range(100_000) if min(abs(i * 0.1 - 5.0), ((i * 0.1 - 7.0) ** 2 + 0.05**2) ** 0.5) < 0.35}
    sent = [int(line.split("=")[1]) for line in _sent(near)]
    assert sent and max(sent) < 200
    assert J.near_any(left, right.limit(0), 0.35).count() == 0 and J.near_any(left.limit(0), right, 0.35).count() == 0


def _sent(df):
    """Rows written by the exchanges of a plan that has run."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        elif name == "ShuffleExchangeExec":
            out.append(f"rows={node.metrics().apply('shuffleRecordsWritten').value()}")
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_pairs_of_places_are_measured_once(spark, monkeypatch):
    """400 rows on 7 places: distances of places, all pairs of rows, also where a place's rows make several lists."""
    left = spark.range(400).selectExpr("id AS i", "id % 7 * 0.3D AS lx", "0.0D AS ly").unionByName(spark.sql("SELECT 900L AS i, cast(null AS double) AS lx, 0.0D AS ly UNION ALL SELECT cast(null AS long), 0.3D, 0.0D"))
    right = spark.range(300).selectExpr("id AS j", "id % 5 * 0.3D AS rx", "0.1D AS ry")
    seen, measure = [], J.within

    def watched(a, b, *more, **named):
        seen.append((a.count(), b.count()))
        return measure(a, b, *more, **named)

    monkeypatch.setattr(J, "within", watched)
    monkeypatch.setattr(J, "PLACE_ROWS", 16)
    got = [tuple(r) for r in J.range_pairs(left, right, 0.4, "i", "j").collect()]
    at = [(i, i % 7) for i in range(400)] + [(None, 1)]
    want = {(i, j) for i, p in at for j in range(300) if (((p - j % 5) * 0.3) ** 2 + 0.01) ** 0.5 < 0.4}
    assert seen == [(7, 5)] and len(got) == len(want) and set(got) == want
    assert J.range_pairs(left.limit(0), right, 0.4, "i", "j").count() == 0


def test_pairs_are_handed_on_a_list_at_a_time(spark, monkeypatch):
    """The first pair of two lists comes before their other pairs are made: a task holds one row's pairs, not all of them."""
    monkeypatch.setattr(J, "PLACE_ROWS", 64)
    left = spark.range(256).selectExpr("id AS i", "0.0D AS lx", "0.0D AS ly")
    right = spark.range(256).selectExpr("id AS j", "0.1D AS rx", "0.0D AS ry")
    pairs = J.range_pairs(left, right, 0.4, "i", "j")
    assert pairs.count() == 256 * 256
    first = pairs.limit(1)
    assert len(first.collect()) == 1
    plan, made = [first._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        elif name == "GenerateExec":
            made.append(node.metrics().apply("numOutputRows").value())
            continue
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert len(made) == 1 and 1 <= made[0] <= 256
