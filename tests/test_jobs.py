"""Answers, scores, merges, search and streams, with hand-made rows."""

from __future__ import annotations

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenmill.operators import answers as A
from screenmill.operators import browse as B
from screenmill.operators import knn as K
from screenmill.operators import merge as G
from screenmill.operators import metrics as M
from screenmill.operators import scoring as S
from screenmill.operators import spatial as P
from screenmill.sources.buckets import BucketTable
from screenmill.streaming import events as E


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"cells": [{"action": "a", "category": "c", "determination": {"significance": "SIGNIFICANT", "confidence": 1.5, "mitigation": ["Avoidance", "x"]}}]}', [("significant", 1.0, ["Avoidance"], False)]),
        ('```json\n[{"action": "a", "determination": {"significance": "huge", "confidence": "x"}}]\n```', [("none", 0.5, [], True)]),
        ('sure: {"cells": [{"determination": {"confidence": 0.596}}]} done', [("none", 0.6, [], False)]),
        ("garbage", []),
        ("", []),
        (None, []),
    ],
)
def test_parse_cells(spark, text, want):
    rows = A.parse_cells(spark.createDataFrame([(1, text)], "project_id int, text string")).collect()
    assert [(r.significance, r.confidence, r.mitigation, r.needs_review) for r in rows] == want


def test_ground_truth_and_projects(spark):
    rows = A.parse_ground_truth(spark.createDataFrame([(1, 'x [{"category_name": " Wetlands ", "significance": "Moderate", "mitigation": ["avoidance", "Avoidance"]}] y')], "evaluation_id int, text string")).collect()
    assert [(r.category_name, r.significance, r.mitigation) for r in rows] == [("wetlands", "moderate", ["avoidance"])]
    p = A.with_actions(A.parse_projects(spark.createDataFrame([(1, "nope", "1, 2")], "project_id int, text string, coordinates string"))).first()
    assert (p.project_type, p.location, p.actions[0]) == ("unknown", "1, 2", "unknown — site preparation")


def test_all_negative_project_scores(spark):
    cells = spark.createDataFrame([("p", 0, "noise", "none")], "project_id string, pos int, category string, significance string")
    truth = spark.createDataFrame([], "project_id string, category_name string, first_pos int, significance string, mitigation array<string>, evidence string")
    s = S.scores(S.category_labels(cells, truth)).first()
    assert (s.category_f1, s.significance_accuracy, s.overall_score) == (1.0, 0.0, 0.4)


def test_fuzzy_match_prefers_exact_then_overlap(spark):
    truth = spark.createDataFrame([("p", "Air Quality Impacts", 1, "moderate"), ("p", "Water and Air", 0, "minimal"), ("p", "Traffic noise", 2, "none")], "project_id string, category_name string, first_pos int, significance string").withColumn("evidence", F.lit(""))
    got = {r.category: r.category_name for r in S.match_categories(truth).collect()}
    assert (got["air_quality"], got["noise"], got["wetlands"]) == ("Air Quality Impacts", "Traffic noise", None)


def test_upsert_null_safe_and_idempotent(spark):
    t = spark.createDataFrame([(1, None, "a", 10), (1, 2, "b", 11)], "k int, j int, v string, id int")
    u = spark.createDataFrame([(1, None, "A", 99), (3, 1, "c", 98)], "k int, j int, v string, id int")
    once = G.upsert(t, u, ["k", "j"], keep=["id"])
    rows = sorted(map(tuple, once.collect()), key=repr)
    assert rows == [(1, 2, "b", 11), (1, None, "A", 10), (3, 1, "c", 98)]
    assert sorted(map(tuple, G.upsert(once, u, ["k", "j"], keep=["id"]).collect()), key=repr) == rows


def test_transition_status_and_filters(spark):
    rows = spark.createDataFrame([(1, "ready"), (2, "embedding")], "id int, status string")
    got = {r.id: (r.status, r.transitioned) for r in G.transition(rows, rows, ["ready", "failed"], "pending").collect()}
    assert got == {1: ("pending", True), 2: ("embedding", False)}
    with pytest.raises(ValueError, match="unknown filter"):
        B.filtered(rows, {"colour": 1})


def test_knn_zero_vectors_and_ties(spark):
    chunks = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "chunk_id int, embedding array<double>")
    rows = K.knn(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>"), chunks, 5).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.similarity, 6)) for r in rows] == [(1, 1.0), (2, 1.0)]


def test_cost_of_unknown_model(spark):
    price = M.pricing_table(spark, [("m", "p", "M", 1.0, 5.0)])
    rows = M.with_cost(spark.createDataFrame([("m", 1000, 500), ("x", 1, 1)], "model string, input_tokens int, output_tokens int"), price).collect()
    assert {r.model: (r.label, round(r.cost_usd, 6)) for r in rows} == {"m": ("M", 0.0035), "x": ("x", 0.0)}


def test_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, run_id long, event string, agent string, duration_ms long, model string, input_tokens long, output_tokens long, cost_usd double"
    rows = spark.range(200).selectExpr("timestamp_seconds(id * 60) AS ts", "id % 5 AS run_id", "if(id % 2 = 0, 'agent_complete', 'agent_cost') AS event", "concat('a', id % 3) AS agent", "id AS duration_ms", "'m' AS model", "id AS input_tokens", "id AS output_tokens", "0.5D AS cost_usd")
    rows.write.parquet(str(tmp_path / "in"))
    stream = E.stream_agent_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes", "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(spark.table("totals")) == key(E.agent_totals(rows, "1 hour"))


def test_knn_in_small_tiles_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 6)).astype(float)
    scopes = rng.integers(0, 3, 300).tolist()
    chunks = spark.createDataFrame([(k, v.tolist(), s) for k, (v, s) in enumerate(zip(vectors, scopes, strict=True))], "chunk_id long, embedding array<double>, scope int")
    queries = chunks.filter("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    norm = np.linalg.norm(vectors, axis=1)
    for scope in (None, "scope"):
        got = sorted((r.query_id, r["rank"], r.chunk_id) for r in K.knn_pairs(queries, chunks, 5, scope, query_rows=16, chunk_rows=50, tile=8).collect())
        want = []
        for q in range(40):
            hits = [(-round(float(vectors[q] @ vectors[c] / (norm[q] * norm[c])), 9), c) for c in range(300) if norm[q] and norm[c] and (scope is None or scopes[q] == scopes[c])]
            want += [(q, n + 1, c) for n, (_, c) in enumerate(sorted(hits)[:5])]
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
        sims = lambda rows: [round(float(vectors[q] @ vectors[c] / (norm[q] * norm[c])), 9) for q, _, c in rows]
        assert sims(got) == sims(sorted(want))


def test_features_within_at_high_latitudes_and_the_date_line(spark):
    rng = np.random.default_rng(5)
    for lat, lon in ((80.0, 20.0), (-89.99, 0.0), (0.0, 179.999), (51.0, -180.0)):
        sites = [(k, lat + float(rng.uniform(-0.004, 0.004)), lon) for k in range(5)]
        places = [(k, lat + float(rng.uniform(-0.012, 0.012)), (lon + float(rng.uniform(-0.1, 0.1) if abs(lat) < 85 else rng.uniform(-180, 180)) + 180) % 360 - 180) for k in range(300)]

        def metres(a, b):
            p, q = math.radians(a[1]), math.radians(b[1])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
            return 2 * P.EARTH_M * math.asin(min(1.0, math.sqrt(h)))

        want = {(s[0], f[0]) for s in sites for f in places if metres(s, f) <= 1000}
        got = P.features_within(spark.createDataFrame(sites, "project_id int, lat double, lon double"), spark.createDataFrame(places, "feature_id int, lat double, lon double"), 1000.0)
        assert want and {(r.project_id, r.feature_id) for r in got.collect()} == want


def test_a_town_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 40)
    rng = np.random.default_rng(7)
    town = lambda n: [(float(a), float(b)) for a, b in np.concatenate([rng.normal((40.0, -75.0), 0.001, (n // 2, 2)), rng.uniform((39.8, -75.2), (40.2, -74.8), (n - n // 2, 2))])]
    sites, places = [(k, *p) for k, p in enumerate(town(120))] + [(500, None, 1.0)], [(k, *p) for k, p in enumerate(town(400))] + [(900, None, None)]
    a, b = spark.createDataFrame(sites, "project_id int, lat double, lon double"), spark.createDataFrame(places, "feature_id int, lat double, lon double").repartition(5)
    want = sorted((s[0], f[0]) for s in sites[:-1] for f in places[:-1] if abs(s[1] - f[1]) <= 0.009 and abs(s[2] - f[2]) <= 0.009)
    got = P.features_in_box(a, b, 0.009)
    assert sorted((r.project_id, r.feature_id) for r in got.collect()) == want
    assert got.columns == ["project_id", "site_lat", "site_lon", "feature_id", "lat", "lon"]
    near = P.features_within(a, b, 700.0)
    metres = lambda s, f: 2 * P.EARTH_M * math.asin(math.sqrt(math.sin(math.radians(f[1] - s[1]) / 2) ** 2 + math.cos(math.radians(s[1])) * math.cos(math.radians(f[1])) * math.sin(math.radians(f[2] - s[2]) / 2) ** 2))
    assert sorted((r.project_id, r.feature_id) for r in near.collect()) == sorted((s[0], f[0]) for s in sites[:-1] for f in places[:-1] if metres(s, f) <= 700)
    assert P.features_in_box(a.limit(0), b).count() == 0


def test_places_meet_once_however_many_sites_and_features_lie_there(spark, monkeypatch):
    towns, spots = [(40.0, -75.0), (40.003, -75.0), (41.0, -75.0)], [(40.001, -75.001), (40.004, -75.0), (10.0, 10.0)]
    sites = [(k, *towns[k % 3]) for k in range(60)] + [(100, None, 1.0)]
    things = [(k, *spots[k % 3], None if k == 3 else f"k{k % 4}", float(k)) for k in range(45)]
    a, b = spark.createDataFrame(sites, "project_id int, lat double, lon double"), spark.createDataFrame(things, "feature_id int, lat double, lon double, kind string, v double")
    met, inner = [], P.met_in_cells
    monkeypatch.setattr(P, "met_in_cells", lambda left, right: met.append((left.select("site_lat", "site_lon").distinct().count(), left.select("project_id").distinct().count(), right.count())) or inner(left, right))
    near = lambda s: [f for f in things if s[1] and abs(f[1] - s[1]) <= 0.009 and abs(f[2] - s[2]) <= 0.009]
    got = P.for_sites(a, P.summary_in_box(a, b, "kind", 0.009))
    want = sorted((s[0], len(near(s)), sorted({f[3] for f in near(s)} - {None}), sorted(f[0] for f in near(s))) for s in sites if near(s))
    assert sorted((r.project_id, r["count"], r.types, r.features) for r in got.collect()) == want
    within = P.summary_within(a, b, "kind", 1000.0).collect()
    assert sorted((r.project_id, r.n, r.n_kinds) for r in within) == [(s, n, len(kinds)) for s, n, kinds, _ in want]
    readings = b.select("lat", "lon", "v", F.lit("o").alias("param"), F.lit("2020-01-01").cast("date").alias("date"), F.col("v").alias("arithmetic_mean"), F.when(F.col("v") % 3 == 0, "Y").otherwise("N").alias("validity_indicator"), F.when(F.col("v") < 0, 1).alias("aqi"))
    air = P.air_baseline(a, readings, "2020-01-03", 5, 0.009).collect()
    valid = lambda s: [f[4] for f in near(s) if f[4] % 3 == 0]
    assert sorted((r.project_id, r["mean"], r["max"], r.mean_aqi, r.samples) for r in air) == [(s[0], round(sum(valid(s)) / len(valid(s)), 2) if valid(s) else None, max(valid(s), default=None), None, len(valid(s))) for s in sites if near(s)]
    assert [m[:2] for m in met] == [(3, 3)] * 3 and all(m[2] == 3 for m in met)


def test_alike_polygons_are_one_shape(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    zones = spark.createDataFrame([(k, ring(float(k % 2)), f"Z{k % 3}", "T" if k == 4 else "F") for k in range(10)], "zone int, ring array<struct<x:double,y:double>>, fld_zone string, sfha_tf string")
    sites = spark.createDataFrame([(k, 0.5, 0.5 + k % 3) for k in range(30)], "project_id int, lat double, lon double")
    hit, members = P.places_in_shapes(sites, zones)
    assert hit.count() == 2 and members.count() == 10  # not 20 sites in 5 zones each
    assert {(r.project_id, r.zone) for r in P.sites_in_polygons(sites, zones).collect()} == {(k, z) for k in range(30) for z in range(10) if k % 3 == z % 2}
    assert {tuple(map(str, r)) for r in P.flood_status(sites, zones).collect()} == {(str(k), str(k % 3 == 0), str(["Z0", "Z1", "Z2"] if k % 3 < 2 else [])) for k in range(30)}


def test_of_alike_soil_components_the_first_key_counts(spark):
    sites = spark.createDataFrame([(1, 0.5, 0.5)], "project_id int, lat double, lon double")
    units = spark.createDataFrame([("m", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "mukey string, ring array<struct<x:double,y:double>>")
    for keys in ((10, 9, 11), (9, 10, 11), (11, 10, 9)):
        parts = spark.createDataFrame([("m", str(k), "loam", str(k - 8), 40, "Yes") for k in keys] + [("m", "1", "clay", "7", 30, "Yes"), ("m", "2", "silt", "6", 90, "No")], "mukey string, cokey string, compname string, nirrcapcl string, comppct_r int, majcompflag string")
        assert [tuple(r) for r in P.dominant_soil(sites, units, parts.coalesce(1)).collect()] == [(1, "m", "loam", "1", "Prime Farmland", True)]


def test_polygons_of_any_size_are_copied_four_times_at_most(spark):
    sites = spark.createDataFrame([(k, -60 + k * 1.37, -170 + k * 3.1) for k in range(100)], "project_id int, lat double, lon double")
    boxes = [(0, -100.0, 10.0, 60.0), (1, -20.003, 0.001, 0.02), (2, -179.0, -80.0, 150.0), (3, 5.0, 5.0, 1.0)]
    ring = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    polygons = spark.createDataFrame([(k, ring(x, y, n)) for k, x, y, n in boxes], "zone int, ring array<struct<x:double,y:double>>")
    got = {(r.project_id, r.zone) for r in P.sites_in_polygons(sites, polygons).collect()}
    assert got == {(k, z) for k in range(100) for z, x, y, n in boxes if x < -170 + k * 3.1 < x + n and y < -60 + k * 1.37 < y + n}


def star(rng, x, y, size, n):
    """A ring of n points round a place, in and out."""
    at = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = size * rng.uniform(0.3, 1.0, n)
    return [(float(a), float(b)) for a, b in zip(x + far * np.cos(at), y + far * np.sin(at), strict=True)]


def parity(sites, rings):
    """By all edges of all rings, for all sites at once."""
    inside = np.zeros(len(sites), bool)
    x, y = np.array([(s[2], s[1]) for s in sites]).T
    for ring in rings:
        if len(ring) > 2:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if ay != by:
                    inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def test_polygons_with_holes_and_parts(spark):
    rng = np.random.default_rng(8)
    sites = [(k, *map(float, rng.uniform(-3, 3, 2))) for k in range(400)] + [(400, None, 1.0)]
    comb = [(0.0, 0.0)] + [(k / 500, 2.0 if k % 2 else 0.1) for k in range(1, 1000)] + [(2.0, 0.0)]
    areas = {
        0: [star(rng, 0, 0, 2.5, 3000), star(rng, 0, 0, 0.7, 50), star(rng, 0.1, 0, 0.2, 5)],
        1: [star(rng, -1, 1, 1.0, 40), star(rng, 2, -2, 0.8, 40)],
        2: [comb],
        3: [[(0.0, 0.0), (1.0, 1.0)]],
        4: None,
        5: [[(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0), (-3.0, -3.0)], []],
    }
    polygons = spark.createDataFrame([(k, r, "clash") for k, r in areas.items()], "zone int, rings array<array<struct<x:double,y:double>>>, e string")
    got = {(r.project_id, r.zone) for r in P.sites_in_polygons(spark.createDataFrame(sites, "project_id int, lat double, lon double"), polygons).collect()}
    placed = sites[:400]
    assert got == {(placed[k][0], z) for z, rings in areas.items() for k in np.flatnonzero(parity(placed, rings or []))}
    assert {z for _, z in got} == {0, 1, 2, 5}


def test_ring_of_a_hundred_thousand_points(spark):
    rng = np.random.default_rng(9)
    ring = star(rng, 10, 10, 5, 100_000)
    sites = [(k, *map(float, rng.uniform(5, 15, 2))) for k in range(2000)]
    polygons = spark.createDataFrame([(1, ring)], "zone int, ring array<struct<x:double,y:double>>")
    got = {r.project_id for r in P.sites_in_polygons(spark.createDataFrame(sites, "project_id int, lat double, lon double"), polygons).collect()}
    assert got == {sites[k][0] for k in np.flatnonzero(parity(sites, [ring]))} and 100 < len(got) < 1900


def test_sources_loaded_again_keep_their_id(spark):
    kinds = "id string, source_type string, cfr_title int, cfr_part string, effective_date string, filename string, status string, status_message string, chunks_total int"
    target = spark.createDataFrame([("a", "ecfr", 40, "1500", None, "old.xml", "failed", "why", 7), ("b", "pdf", None, None, None, "b.pdf", "ready", None, 3)], kinds)
    updates = spark.createDataFrame([("x", "ecfr", 40, "1500", None, "new.xml"), ("y", "ecfr", 40, "1501", "2020-01-01", "n.xml")], "id string, source_type string, cfr_title int, cfr_part string, effective_date string, filename string")
    got = {r.id: (r.filename, r.status, r.status_message, r.chunks_total) for r in G.upsert_sources(target, updates).collect()}
    assert got == {"a": ("new.xml", "pending", None, None), "b": ("b.pdf", "ready", None, 3), "y": ("n.xml", "pending", None, None)}


def test_change_of_dimension(spark):
    evaluations = spark.createDataFrame([(1, "ready", None), (2, "failed", "why")], "id int, status string, status_message string")
    chunks = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    failed, left = G.reset_on_dimension_change(evaluations, chunks, 3)
    assert {r.id: (r.status, r.status_message) for r in failed.collect()} == {1: ("failed", "embedding dim changed from 2 to 3; reingest required"), 2: ("failed", "why")} and left.count() == 0
    same, kept = G.reset_on_dimension_change(evaluations, chunks, 2)
    assert sorted(r.status for r in same.collect()) == ["failed", "ready"] and kept.count() == 1
    assert G.reset_on_dimension_change(evaluations, chunks.limit(0), 2)[0].count() == 2


def test_keyed_merges(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "evaluation_id int, categories string")
    assert sorted(map(tuple, G.upsert_ground_truth(truth, spark.createDataFrame([(2, "B"), (3, "c")], truth.schema)).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    scores = spark.createDataFrame([("p", 0.5)], "project_id string, overall_score double")
    assert sorted(map(tuple, G.upsert_scores(scores, spark.createDataFrame([("p", 0.7)], scores.schema)).collect())) == [("p", 0.7)]
    assert [r.is_current for r in G.backfill_current(spark.createDataFrame([(1, None), (2, False)], "id int, is_current boolean")).collect()] == [True, True]


def test_source_scopes(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id int")
    sources = spark.createDataFrame([(10, 1, "ready"), (11, 1, "pending"), (12, None, "ready"), (13, 2, "failed")], "id int, project_id int, status string")
    assert {r.project_id: (r.source_ids, r.sees_all) for r in B.source_scopes(projects, sources).collect()} == {1: ([10], False), 2: ([], True)}
    assert sorted(map(tuple, B.scoped_sources(projects, sources).collect())) == [(1, 10), (2, 10), (2, 12)]


def test_ingest_stream(spark, tmp_path):
    part = lambda n: f'<DIV5 TYPE="PART" N="{n}"><HEAD>P</HEAD>' + "".join(f'<DIV8 TYPE="SECTION" N="{n}.{k}"><HEAD>§ {n}.{k} H</HEAD><P>{"word " * 30}</P></DIV8>' for k in range(3)) + "</DIV5>"
    (tmp_path / "in").mkdir()
    for name, text in (("a", part(1500)), ("b", part(1501)), ("copy", part(1500)), ("bad", "<DIV5")):
        (tmp_path / "in" / f"{name}.xml").write_text(text)

    def run():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "in"))
        E.start_ingest(files, str(tmp_path / "kept"), str(tmp_path / "check"), least=40, most=100, buckets=4, most_folders=2).awaitTermination(120)
        return state()

    def state():
        chunks, status, digests = (BucketTable(spark, str(tmp_path / "kept" / x)) for x in ("chunks", "status", "digests"))
        assert all(n <= 3 for t in (chunks, status, digests) for n in t.folders().values())
        return sorted((len(r.sources), r.token_count) for r in chunks.read().collect()), sorted((r.sections_count, r.chunks_count, r.status, r.status_message or "") for r in status.read().collect())

    once = run()
    assert once == ([(3, 90), (3, 90)], [(0, 0, "failed", "no sections found"), (3, 1, "ready", ""), (3, 1, "ready", "")])
    (tmp_path / "in" / "late.xml").write_text(part(1502))
    twice = run()
    assert len(twice[0]) == 3
    # the same content under another name days later, and a batch that is repeated: nothing changes, nothing is written
    manifests = sorted(str(p) for p in (tmp_path / "kept").glob("*/manifests/*"))
    (tmp_path / "in" / "again.xml").write_text(part(1501))
    os.utime(tmp_path / "in" / "again.xml", (2e9, 2e9))
    assert run() == twice
    batch = spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")
    E.ingest(batch, str(tmp_path / "kept"), least=40, most=100)
    assert state() == twice and sorted(str(p) for p in (tmp_path / "kept").glob("*/manifests/*")) == manifests


def test_ingest_reads_a_batch_once(spark, tmp_path):
    part = lambda n: f'<DIV5 TYPE="PART" N="{n}"><HEAD>P</HEAD><DIV8 TYPE="SECTION" N="{n}.1"><HEAD>§ {n}.1 H</HEAD><P>words of {n}</P></DIV8></DIV5>'
    files = spark.createDataFrame([("b", part(1)), ("a", part(1)), (None, part(1)), (None, part(2)), ("bad", "<DIV5"), ("none", None)], "path string, text string").coalesce(1)
    (tmp_path / "reads").mkdir()
    folder = str(tmp_path / "reads")

    def read(batches):
        for rows in batches:
            for _ in range(len(rows)):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield rows

    batch = files.mapInPandas(read, files.schema).select("path", F.col("text").cast("binary").alias("content"))
    E.ingest(batch, str(tmp_path / "kept"), buckets=4)
    assert len(os.listdir(folder)) == 6
    status, digests = (BucketTable(spark, str(tmp_path / "kept" / x)) for x in ("status", "digests"))
    assert sorted((r.path or "", r.status, r.chunks_count) for r in status.read().collect()) == [("", "ready", 1), ("a", "ready", 1), ("bad", "failed", 0)]
    assert sorted(r.path or "" for r in digests.read().collect()) == ["", "a", "bad"]
