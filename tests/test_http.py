"""Fetching from a server of the test's own."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomery.sinks import vaults as sinks
from loomery.sources import http


class Handler(BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        code = {"/missing": 404, "/busy": 429, "/moved": 302, "/broken": 500}.get(self.path, 500 if self.path == "/twice" and n < 2 else 200)
        body = b"x" * 5000 if self.path == "/large" else "<p>g\u00fc".encode("latin-1") if self.path == "/latin" else b"<p>ok"
        self.send_response(code)
        if code == 302:
            self.send_header("Location", "/page")
        self.send_header("Content-Type", "text/html; charset=latin-1" if self.path == "/latin" else "image/png" if "png" in self.path else "text/html")
        self.send_header("Content-Length", str(len(body) if code == 200 else 0))
        self.end_headers()
        if code == 200:
            self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    one = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}"
    one.shutdown()


def test_get(server):
    assert http.get(f"{server}/moved").final_url == f"{server}/page"
    assert http.get(f"{server}/twice", pause=0.01).status == "ok" and Handler.asked["/twice"] == 2
    assert http.get(f"{server}/broken", tries=2, pause=0.01).status == "failed" and Handler.asked["/broken"] == 2
    assert [http.get(f"{server}/{x}").status for x in ("missing", "busy")] == ["missing", "limited"] and Handler.asked["/missing"] == 1
    assert http.get(f"{server}/large", most=100).status == "too large" and http.get("no url", tries=1).status == "failed"


def test_fetch_pages_and_images(spark, server):
    rows = spark.createDataFrame([(1, f"{server}/page"), (2, f"{server}/latin"), (3, f"{server}/missing"), (4, None)], "page_id long, url string")
    got = {r.page_id: r for r in http.pages_of(http.fetch(rows, pause=0.01)).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["ok", "ok", "missing", "failed"] and got[2].html == "<p>gü" and got[3].html is None
    images = spark.createDataFrame([(1, 1, f"{server}/a.png"), (1, 2, f"{server}/a.png"), (1, 3, f"{server}/large"), (1, 4, f"{server}/missing")], "page_id long, ord int, absolute string")
    found = http.harvest(images, most=1000, pause=0.01)
    local = {r.absolute.rpartition("/")[2]: r.local for r in found.collect()}
    assert len(local) == 3 and local["a.png"].startswith("figures/a_") and local["a.png"].endswith(".png") and local["missing"] == f"{server}/missing"
    c = http.harvest_counts(found).first()
    assert (c.downloaded, c.skipped, c.failed, len(c.warnings)) == (1, 1, 1, 2)
    assert http.fetch(rows.limit(0)).count() == 0


def test_copies_and_merged_vaults(spark, tmp_path):
    source = tmp_path / "b.pdf"
    source.write_bytes(b"%PDF-")
    path = sinks.copy_once(spark, f"file://{source}", f"file://{tmp_path}/home")
    source.write_bytes(b"new")
    assert sinks.copy_once(spark, f"file://{source}", f"file://{tmp_path}/home") == path and (tmp_path / "home/b.pdf").read_bytes() == b"%PDF-"
    files = spark.createDataFrame([("pages/x.md", "two"), ("pages/x.md", "one"), ("a b/ü.md", None)], "path string, text string")
    nodes = spark.createDataFrame([("x", "X", "concept", 1)], "slug string, title string, type string, seq long")
    edges = spark.createDataFrame([("x", "y", "near", "c", 1)], "`from` string, `to` string, predicate string, context string, seq long")
    sinks.write_vault(files, nodes, edges, str(tmp_path / "vault"))
    assert (tmp_path / "vault/pages/x.md").read_text() == "two" and (tmp_path / "vault/a b/ü.md").read_text() == "" and '"slug":"x"' in (tmp_path / "vault/graph.json").read_text()
    sinks.write_root(nodes, edges, spark.createDataFrame([("report",)], "text string"), f"file://{tmp_path}/root")
    assert (tmp_path / "root/CONNECTIONS.md").read_text() == "report"
