"""Contents behind addresses, from a server on this machine."""

import http.server
import json
import threading
import urllib.parse
from collections import Counter

import pytest

from cadenza.operators import audits, ingest
from cadenza.sources import web


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = urllib.parse.unquote(self.path)
            asked[path] += 1
            code, body, more = 200, b"ID3 sound", {}
            if path.startswith("/none"):
                code = 404
            elif path.startswith("/busy") and asked[path] < 3:
                code, more = 503, {"Retry-After": "0"}
            elif path.startswith("/down"):
                code, more = 500, {"Retry-After": "0"}
            elif path.startswith("/text"):
                body = b"no sound"
            elif path.startswith("/api/"):
                word = path[5:]
                body = b"<html>" if word == "odd" else json.dumps({"items": [{"id": 7, "word": word, "more": 1}] if word != "none" else []}).encode()
            self.send_response(code)
            for k, v in more.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as held:
        threading.Thread(target=held.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{held.server_port}", asked
        held.shutdown()


def test_fetching(spark, server):
    root, asked = server
    rows = spark.createDataFrame([(p, f"{root}/{p}" if p else None) for p in ("a", "none", "busy", "down", "")], "word string, url string")
    got = {r["word"]: r for r in web.fetched(rows, retries=2, timeout=5).collect()}
    assert {w: r["outcome"].split(":")[0] for w, r in got.items()} == {"a": "downloaded", "none": "missing", "busy": "downloaded", "down": "failed", "": "missing"}
    assert bytes(got["a"]["content"]) == b"ID3 sound" and got["a"]["length"] == 9 and got["none"]["content"] is None
    assert asked["/busy"] == 3 and asked["/down"] == 3 and asked["/none"] == 1
    counts = {r["status"]: r["n"] for r in audits.status_counts(spark.createDataFrame([(r["outcome"],) for r in got.values()], "status string")).collect()}
    assert counts == {"downloaded": 2, "missing": 2, "failed": 1}


def test_patience(server):
    root, _ = server
    waits = []
    assert web.ask(f"{root}/text", lambda c: "no sound" if c != b"ID3 sound" else None, 3, 5, waits.append) == ("failed: no sound", None)
    assert [int(w) for w in waits] == [1, 2, 4] and web.pause(20, 30) == 30 and web.pause(1, 60, "0.5") == 0.5
    assert web.ask("http://127.0.0.1:1/", lambda c: None, 0, 1)[0].startswith("failed: ")


def test_inventory_of_a_service(spark, server):
    root, _ = server
    words = spark.createDataFrame([("1", "妈 妈"), ("2", "none"), ("3", "odd")], "id string, word string")
    got = {r["hsk_id"]: r for r in ingest.inventory(words, web.responses(words, f"{root}/api/{{word}}", retries=0, timeout=5)).collect()}
    assert got["1"]["count"] == 1 and got["1"]["pronunciations"][0]["word"] == "妈 妈" and got["1"]["pronunciations"][0]["id"] == "7"
    assert got["2"]["count"] == 0 and got["2"]["error"] is None and got["3"]["error"] == "the answer is no JSON"
