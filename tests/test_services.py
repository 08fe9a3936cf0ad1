"""The data sources of outside services against stand-ins that fail now and then."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quire.sources.services import Conversions, Points, point_id


class Stand(BaseHTTPRequestHandler):
    """Conversions and collections in memory; every third request is answered by 503."""

    def log_message(self, *a):
        pass

    def answer(self, code, body=b""):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def handle_one(self, method):
        s, body = self.server, self.rfile.read(int(self.headers.get("Content-Length") or 0))
        with s.lock:
            s.n += 1
            if s.n % 3 == 0 and s.flaky:
                return self.answer(503)
            parts = self.path.strip("/").split("/")
            if parts[0] == "tasks":
                key = parts[1]
                if method == "PUT":
                    s.submitted[key] += 1
                    s.tasks.setdefault(key, [body, 2])
                    return self.answer(415 if body.startswith(b"bad") else 202)
                if parts[2:]:
                    return self.answer(200, s.tasks[key][0].upper())
                s.tasks[key][1] -= 1
                state = "failed" if b"fail" in s.tasks[key][0] else "running" if s.tasks[key][1] > 0 else "done"
                return self.answer(200, json.dumps({"state": state}).encode())
            if len(parts) == 2:
                s.collections.setdefault(parts[1], {"about": json.loads(body), "points": {}})
                return self.answer(200)
            points = s.collections[parts[1]]["points"]
            if parts[-1] == "delete":
                rule = json.loads(body)
                for i, p in list(points.items()):
                    if all(p["payload"][k] == v for k, v in rule["must"].items()) and not any(p["payload"][k] == v for k, v in rule["must_not"].items()):
                        del points[i]
                return self.answer(200)
            new = json.loads(body)["points"]
            if s.dies and any(p["payload"]["chunk_index"] == s.dies for p in new):
                return self.answer(400)  # the job ends here
            for p in new:
                s.puts[p["id"]] += 1
                points[p["id"]] = p
            return self.answer(200)

    def do_GET(self):
        self.handle_one("GET")

    def do_PUT(self):
        self.handle_one("PUT")

    def do_POST(self):
        self.handle_one("POST")


@pytest.fixture
def stand():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stand)
    server.n, server.flaky, server.dies, server.lock = 0, True, 0, threading.Lock()
    server.tasks, server.submitted, server.collections, server.puts = {}, Counter(), {}, Counter()
    server.url = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_conversions(spark, stand, tmp_path):
    for i in range(20):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"f{i:02d}.PDF").write_bytes({4: b"bad", 5: b"fail", 6: b"text 7"}.get(i, b"text %d" % i))
    (tmp_path / "other.txt").write_bytes(b"no")
    spark.dataSource.register(Conversions)
    read = spark.read.format("conversions").option("service", stand.url).option("suffix", ".pdf").option("wait", "0.01").option("outage", "5").option("files", "3")
    got = {r.path.split("/")[-1]: r for r in read.load(str(tmp_path)).collect()}
    assert len(got) == 20 and {k: r.result for k, r in got.items() if r.problem is None} == {f"f{i:02d}.PDF": f"TEXT {7 if i == 6 else i}" for i in range(20) if i not in (4, 5)}
    assert "415" in got["f04.PDF"].problem and "failed" in got["f05.PDF"].problem and any(r.tries > 4 for r in got.values())
    assert len(stand.tasks) == 19  # equal contents are one task
    again = read.load(str(tmp_path)).count()
    assert again == 20 and len(stand.tasks) == 19


def test_outage_ends_the_job(spark, stand, tmp_path):
    (tmp_path / "f.pdf").write_bytes(b"text")
    stand.shutdown()
    stand.server_close()
    spark.dataSource.register(Conversions)
    with pytest.raises(Exception, match="tasks/"):
        spark.read.format("conversions").option("service", stand.url).option("wait", "0.01").option("outage", "0.05").load(str(tmp_path)).collect()


def rows(revision, n):
    return [(f"k{i % 3}", f"p{i % 7}", revision, i, [float(i), 1.0], f"text {i}") for i in range(n)]


def write(spark, stand, data, parts=4):
    df = spark.createDataFrame(data, "source_key string, logical_path string, revision string, chunk_index int, vector array<double>, content string").repartition(parts)
    df.write.format("points").option("service", stand.url).option("collection", "c").option("size", "2").option("wait", "0.01").option("outage", "5").mode("append").save()


def test_points_are_replaced_when_all_are_written(spark, stand):
    spark.dataSource.register(Points)
    write(spark, stand, rows("r1", 300))
    first = dict(stand.collections["c"]["points"])
    assert stand.collections["c"]["about"] == {"size": 2, "distance": "Cosine"}
    assert set(first) == {point_id(k, p, r, i) for k, p, r, i, *_ in rows("r1", 300)}
    stand.dies = 150  # in the midst of the next revision
    with pytest.raises(Exception, match="400"):
        write(spark, stand, rows("r2", 300))
    points = stand.collections["c"]["points"]
    assert set(first) <= set(points)  # what was there is still there
    stand.dies = 0
    write(spark, stand, rows("r2", 300))
    want = {point_id(k, p, r, i): [float(i), 1.0] for k, p, r, i, *_ in rows("r2", 300)}
    assert {i: p["vector"] for i, p in points.items()} == want and max(stand.puts.values()) >= 2
    write(spark, stand, rows("r2", 300), parts=2)
    assert {i: p["vector"] for i, p in points.items()} == want
    write(spark, stand, rows("r3", 3)[:1])  # another revision of one source leaves the others
    assert Counter(p["payload"]["source_key"] for p in points.values()) == {"k0": 1, "k1": 100, "k2": 100}


def test_wrong_rows_end_the_job(spark, stand):
    spark.dataSource.register(Points)
    with pytest.raises(Exception, match="2 numbers"):
        write(spark, stand, [("k", "p", "r", 0, [1.0], "t")])
    with pytest.raises(Exception, match="two revisions"):
        write(spark, stand, [("k", "p", "r1", 0, [1.0, 2.0], "t"), ("k", "p", "r2", 1, [1.0, 2.0], "t")], parts=1)
