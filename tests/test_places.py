"""The place connector against a local service that answers 429, 503, 500, rubbish and 200; appends that count once."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from demandry.sources import places, tables

NEAR = [
    {"type": "node", "id": 1, "lat": 7.001, "lon": 80.0, "tags": {"amenity": "school"}},
    {"type": "way", "id": 2, "center": {"lat": 7.006, "lon": 80.0}, "tags": {"amenity": "cafe", "tourism": "hotel"}},
    {"type": "node", "id": 3, "tags": {"amenity": "school"}},
    {"type": "node", "id": 4, "lat": 7.0, "lon": 80.0, "tags": {"amenity": "bench", "level": 2}},
]
#: What the service answers to the points of a latitude, request by request; 200 from then on.
SCRIPT = {"7.000000": [], "8.000000": [429, 503], "9.000000": [503] * 9, "10.000000": [500, 404], "11.000000": ["rubbish", "[]"], "12.000000": [502, 504, 429, 500]}


@pytest.fixture
def service():
    asked, agents = Counter(), set()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            lat = query.split("around:2000,")[1].split(",")[0]
            agents.add(self.headers["User-Agent"])
            script = SCRIPT.get(lat, [])
            step, asked[lat] = asked[lat], asked[lat] + 1
            answer = script[step] if step < len(script) else 200
            body = answer if isinstance(answer, str) else json.dumps({"elements": NEAR if lat == "7.000000" else []})
            self.send_response(200 if isinstance(answer, str) else answer)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/a", asked, agents
    server.shutdown()
    server.server_close()


def test_pauses_double_and_have_jitter(service):
    slept = []
    client = places.Client(service[0], interval=0, sleep=slept.append, jitter=lambda: 0.5)
    query = lambda lat: places.radius_query(lat, 80.0)
    assert client.ask(query(8.0))[1:] == (3, "HTTP 503") and slept == [4.5, 8.5]
    slept.clear()
    assert client.ask(query(9.0)) == (None, 5, "HTTP 503") and slept == [4.5, 8.5, 16.5, 32.5]
    slept.clear()
    assert client.ask(query(10.0))[1:] == (3, "HTTP 404") and slept == []
    assert client.ask(query(11.0))[1:] == (3, "ValueError") and slept == [4.0, 8.0]
    slept.clear()
    nobody = places.Client("http://127.0.0.1:9/", interval=0, sleep=slept.append)
    assert nobody.ask("x") == (None, 5, "URLError") and slept == [4.0, 8.0, 16.0, 32.0]


def test_requests_keep_their_distance(service):
    slept = []
    client = places.Client(service[0], interval=50.0, sleep=slept.append)
    client.ask(places.radius_query(7.0, 80.0))
    assert slept == []
    client.ask(places.radius_query(7.0, 80.0))
    assert len(slept) == 1 and 40 < slept[0] <= 50


POINTS = [("a", 7.0, 80.0), ("b", 8.0, 80.0), ("c", 9.0, 80.0), ("d", 10.0, 80.0), ("e", 11.0, 80.0), ("f", 12.0, 80.0), ("g", None, 80.0), ("h", 13.0, 80.0)]


def test_source_rows_attempts_and_log(spark, service, tmp_path):
    endpoint, asked, agents = service
    points = spark.createDataFrame(POINTS, "outlet_id string, lat double, lon double")
    rows = places.ask(points, str(tmp_path / "todo"), endpoints=f"{endpoint},{endpoint}b,{endpoint}c", pause=0.001, interval=0)
    assert rows.rdd.getNumPartitions() == 3
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = {r.outlet_id: r for r in rows.collect()}
    assert {k: (r.status, r.attempts, r.error) for k, r in got.items()} == {
        "a": ("ok", 1, None), "b": ("ok", 3, "HTTP 503"), "c": ("failed", 5, "HTTP 503"), "d": ("ok", 3, "HTTP 404"), "e": ("ok", 3, "ValueError"),
        "f": ("ok", 5, "HTTP 500"), "g": ("skipped_null_coords", 0, None), "h": ("ok", 1, None),
    }
    assert asked == {"7.000000": 1, "8.000000": 3, "9.000000": 5, "10.000000": 3, "11.000000": 3, "12.000000": 5, "13.000000": 1} and agents == {"demandry"}
    assert {r.endpoint for r in got.values()} == {endpoint, f"{endpoint}b", f"{endpoint}c"}
    assert got["a"].n_elements == 4 and got["a"].elements[1].elat == 7.006 and got["a"].elements[3].tags["level"] == "2"
    assert sorted((r.outlet_id, r.status, r.n_elements) for r in places.audit_log(rows).collect()) == [("a", "ok", 4), ("b", "ok", 0), ("c", "failed", None), ("d", "ok", 0), ("e", "ok", 0), ("f", "ok", 0), ("g", "skipped_null_coords", None), ("h", "ok", 0)]
    docs = places.place_documents(rows)
    for r in docs.collect():
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / f"{r.outlet_id}.json").write_text(r.doc)
    read = {r.outlet_id: r.counts for r in tables.read_poi(spark, str(tmp_path / "docs")).collect()}
    assert set(read) == {"a", "b", "d", "e", "f", "h"} and len(read["b"]) == 8
    assert read["a"]["school"] == {"500": 1, "1000": 1, "2000": 1} and read["a"]["restaurant"] == read["a"]["tourism"] == {"500": 0, "1000": 1, "2000": 1}
    assert read["a"]["hospital"] == {"500": 0, "1000": 0, "2000": 0}


def test_a_stopped_run_repeats_nothing(spark, service, tmp_path):
    endpoint, asked, _ = service
    points = spark.createDataFrame([(f"p{k}", 20.0 + k, 80.0) for k in range(24)], "outlet_id string, lat double, lon double")
    folder, calls = str(tmp_path / "places"), []

    def fetch(part, todo):
        calls.append(todo)
        rows = places.ask(part, todo, endpoints=endpoint, pause=0.001, interval=0)
        if len(calls) == 3:
            # Stopped within the third batch: its rows are written, the commit isn't.
            rows.write.mode("overwrite").parquet(f"{folder}/rows/batch=run-2")
            raise KeyboardInterrupt
        return rows

    with pytest.raises(KeyboardInterrupt):
        places.collect_places(points, folder, "run", fetch, batches=4)
    half = {r.outlet_id for r in places.read_batches(spark, folder, places.ROW).collect()}
    assert 0 < len(half) < 24 and sorted(places.committed(spark, folder)) == ["run-0", "run-1"]
    before = Counter(asked)
    rows = places.collect_places(points, folder, "run", fetch, batches=4).collect()
    assert Counter(r.outlet_id for r in rows) == Counter(f"p{k}" for k in range(24))
    assert all(asked[f"{20 + int(p[1:])}.000000"] == before[f"{20 + int(p[1:])}.000000"] == 1 for p in half)
    n = sum(asked.values())
    assert len(places.collect_places(points, folder, "run", fetch, batches=4).collect()) == 24 and sum(asked.values()) == n
    # A later run asks for what is new or has failed only.
    more = points.unionByName(spark.createDataFrame([("new", 50.0, 80.0), ("lost", 9.0, 80.0)], "outlet_id string, lat double, lon double"))
    places.collect_places(more, folder, "later", fetch, batches=2)
    assert sum(asked.values()) == n + 1 + 5
    places.collect_places(more, folder, "last", fetch, batches=2)
    assert {r.status for r in places.read_batches(spark, folder, places.ROW).where("outlet_id = 'lost'").collect()} == {"failed", "ok"}


def test_batches_count_once(spark, tmp_path):
    df, folder = spark.range(5), str(tmp_path / "log")
    assert places.read_batches(spark, folder, df.schema).count() == 0
    assert places.append_batch(df, folder, "b1") and not places.append_batch(spark.range(9), folder, "b1")
    spark.range(100).write.parquet(f"{folder}/rows/batch=b2")
    got = places.read_batches(spark, folder, df.schema)
    assert sorted((r.id, r.batch) for r in got.collect()) == [(k, "b1") for k in range(5)]
    assert places.append_batch(df, folder, "b2") and places.read_batches(spark, folder, df.schema).count() == 10
