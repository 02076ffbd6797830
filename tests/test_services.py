import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest

from samplewright.operators import backends, raster, report, services
from samplewright.sources import images

PNG = base64.b64encode(images.encode_png(np.zeros((2, 2, 3), np.uint8))).decode()


class Fake(BaseHTTPRequestHandler):
    def answer(self, body):
        prompt = body.get("prompt", "")
        if prompt.isdigit():
            self.send_response(int(prompt))
            self.end_headers()
            return
        made = {"address": {"image": "http://x/y.png"}, "junk": {"image": base64.b64encode(b"text").decode()}}.get(prompt, {"image": PNG})
        if self.path.startswith("/tasks"):
            made = {"id": "t1", "state": "cancelled" if self.path.endswith("cancel") else "queued" if self.path == "/tasks" else "done"} | ({"url": "https://evil.example/v"} if prompt == "evil" else {})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(made).encode())

    def do_POST(self):
        self.answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

    def do_GET(self):
        self.answer({})

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield services.Service(f"http://127.0.0.1:{server.server_port}", timeout_s=5)
    server.shutdown()


def test_answers_are_classified(service):
    batch = pd.DataFrame({"request_key": list("abcdefg"), "payload": [json.dumps({"prompt": p}) for p in ("ok", "401", "429", "500", "404", "address", "junk")]})
    out = services.replacement_sender(service)(batch)
    assert out["status"].tolist() == ["succeeded", "refused", "limited", "unknown", "refused", "unknown", "unknown"]
    assert services.Service("http://127.0.0.1:9", timeout_s=1).post({})[0] == "unknown"
    assert services.Service("http://other.example").post({}) == ("refused", "untrusted address")
    with pytest.raises(ValueError):
        services.secret("plain")


def test_video_tasks(spark, tmp_path, service):
    tasks = backends.VideoTasks(backends.Ledger(spark, str(tmp_path)), *services.video_functions(service))
    requests = spark.createDataFrame([("a", json.dumps({"prompt": "x"})), ("b", json.dumps({"prompt": "evil"}))], "request_key string, payload string")
    sent = tasks.submit(requests)
    assert {r["request_key"]: r["status"] for r in sent.collect()} == {"a": "running", "b": "failed"}
    assert {r["request_key"]: r["status"] for r in tasks.status(sent).collect()} == {"a": "succeeded", "b": "failed"}
    assert {r["request_key"]: r["status"] for r in tasks.cancel(sent).collect()} == {"a": "cancelled", "b": "failed"}


def test_render_command():
    assert services.render_command("a", "b", [("trim", {"start": 1, "end": 2}), ("speed", {"factor": 2}), ("mute", {})]) == ["ffmpeg", "-y", "-v", "error", "-ss", "1", "-to", "2", "-i", "a", "-vf", "setpts=PTS/2", "-an", "b"]


def test_outlines():
    mask = np.zeros((8, 9), bool)
    mask[2:6, 3:8] = True
    assert sorted(map(tuple, raster.simplify(raster.outline(mask)).tolist())) == [(3, 2), (3, 6), (8, 2), (8, 6)]
    rng = np.random.default_rng(1)
    for _ in range(20):
        blob = raster.dilate(rng.random((1, 14, 15)) < 0.02, 3)[0]
        blob = backends._largest(blob) if blob.any() else blob
        ring = raster.outline(blob)
        if not len(ring):
            continue
        x, y = ring[:, 0], ring[:, 1]
        enclosed = abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2
        outside = np.pad(~blob, 1, constant_values=True)
        seed = np.zeros_like(outside)
        seed[0, 0] = True
        while True:
            wide = np.pad(seed, 1)  # the outside also connects over corners, as the inside does not
            grown = np.any([wide[i : i + seed.shape[0], j : j + seed.shape[1]] for i in range(3) for j in range(3)], axis=0) & outside
            if (grown == seed).all():
                break
            seed = grown
        filled = ~seed[1:-1, 1:-1]
        assert enclosed == filled.sum()


def test_gaps_over_block_ends(spark):
    frames = [1, 2, 9, 10, 11, 25, 30, 31]
    df = spark.createDataFrame([("t", f) for f in frames] + [(None, 1), ("t", None)], "track_id string, frame bigint")
    want = [(a + 1, b - 1) for a, b in zip(frames, frames[1:]) if b - a > 1]
    for block in (3, 10, 1000):
        assert sorted((r[1], r[2]) for r in report.track_gaps(df, block).collect()) == want
