import hashlib
import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cuadra.sources.documents import answers_by_halves
from cuadra.sources.remote import Endpoint, remote_answers, request_body


@pytest.fixture
def server():
    seen, state = [], {"now": 0, "most": 0, "times": {}}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            asked = json.loads(body)["input"][0]["content"][0]["text"]
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["times"][asked] = state["times"].get(asked, 0) + 1
                seen.append((self.path, dict(self.headers), body))
            time.sleep(0.05)
            status, answer = 200, json.dumps({"ok": True, "output_text": f" {asked.upper()} "})
            if asked == "busy" and state["times"][asked] < 3:
                status, answer = 503, "later"
            elif asked == "large":
                status, answer = 413, "too large"
            elif asked in ("not json", "[]", "refused", "empty"):
                answer = {"not json": "<html>", "[]": "[]", "refused": '{"ok": false, "error": "no credit"}', "empty": '{"output_text": " "}'}[asked]
            elif asked == "always busy":
                status, answer = 503, "later"
            with lock:
                state["now"] -= 1
            self.send_response(status)
            self.end_headers()
            self.wfile.write(answer.encode())

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/", seen, state
    httpd.shutdown()


def _units(spark, endpoint, texts):
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc string, unit_no int, t string")
    content = F.array(F.struct(F.lit("input_text").alias("type"), F.col("t").alias("text"), F.lit(None).cast("string").alias("filename")))
    return df.select("doc", "unit_no", request_body(endpoint, "m", 100, content, F.lit("ñ 1.pdf")).alias("body"), F.lit("ñ 1.pdf").alias("source"))


def test_requests_are_signed_and_errors_named(spark, server):
    url, seen, state = server
    endpoint = Endpoint(url, "v1/ask", "me", "secret", task=" auto ", client="7")
    texts = ["héllo", "busy", "large", "not json", "[]", "refused", "empty", "always busy"]
    units = _units(spark, endpoint, texts).union(spark.sql("select 'd', 99, cast(null as string), ''"))
    got = {r.unit_no: r for r in remote_answers(units, endpoint, pause=0.01, attempts=3).collect()}
    assert {texts[k]: (r.text, r.kind, r.status, r.attempts) for k, r in got.items() if k < 99} == {
        "héllo": ("HÉLLO", None, None, 1), "busy": ("BUSY", None, None, 3), "large": (None, "http", 413, 1), "not json": (None, "not_json", None, 1), "[]": (None, "bad_format", None, 1),
        "refused": (None, "refused", None, 1), "empty": (None, "empty", None, 1), "always busy": (None, "http", 503, 3),
    }
    assert got[99].kind == "bad_format" and got[2].error == "HTTP 413: too large" and got[5].error == "no credit"
    path, headers, body = next(s for s in seen if "héllo" in s[2])
    assert path == "/v1/ask" and json.loads(body) == {"model": "m", "max_output_tokens": 100, "input": [{"role": "user", "content": [{"type": "input_text", "text": "héllo"}]}], "task": "AUTO", "opcion": "AUTO", "idcliente": "7", **dict.fromkeys(["source_filename", "archivo_nombre", "filename", "archivoNombre", "file_name"], "ñ 1.pdf")}
    assert headers["X-Ia-Signature" if "X-Ia-Signature" in headers else "X-IA-Signature"] == hmac.new(b"secret", f"{headers.get('X-IA-Timestamp') or headers['X-Ia-Timestamp']}.{headers.get('X-IA-Nonce') or headers['X-Ia-Nonce']}.{body}".encode(), hashlib.sha256).hexdigest()
    low = {k.lower(): v.encode("latin-1").decode() for k, v in headers.items()}
    assert low["x-ia-task"] == low["x-ia-opcion"] == "AUTO" and low["x-ia-idcliente"] == "7" and low["x-ia-source-filename"] == "ñ 1.pdf" and len(low["x-ia-nonce"]) == 32
    assert len({s[1].get("X-IA-Nonce") or s[1]["X-Ia-Nonce"] for s in seen}) == len(seen)


def test_requests_at_once_are_bounded(spark, server):
    url, _, state = server
    endpoint = Endpoint(url, "/", "me", "s")
    assert remote_answers(_units(spark, endpoint, [f"t{k}" for k in range(40)]).repartition(9), endpoint, concurrent=4, per_task=2).where("text is not null").count() == 40
    assert 2 <= state["most"] <= 4 and set(state["times"].values()) == {1}


def test_no_server_and_no_time(spark):
    endpoint = Endpoint("http://127.0.0.1:9", "/", "me", "s")
    got = remote_answers(_units(spark, endpoint, ["a"]), endpoint, pause=0.01, attempts=2).first()
    assert (got.kind, got.attempts) == ("unavailable", 2)
    got = remote_answers(_units(spark, endpoint, ["a"]), endpoint, pause=5, deadline=0.5, attempts=50).first()
    assert got.kind == "deadline" and got.attempts < 5
    for bad in (("", "/", "a", "b"), ("http://x", "/", " ", "b"), ("http://x", "/", "a", "")):
        with pytest.raises(ValueError):
            Endpoint(*bad)


@pytest.mark.parametrize("most", [0, 3, 7, 1000])
def test_halves_cover_each_page_once(spark, most):
    asked = []

    def ask(ranges):
        asked.extend(tuple(r) for r in ranges.collect())
        large = F.expr(f"last - first + 1 > {most}")
        return ranges.select("doc", "first", "last", F.when(~large, F.lit("ok")).alias("text"), F.when(large, "413").alias("error"))

    got, folders = answers_by_halves(spark.createDataFrame([("a", 1, 13), ("b", 1, 1), ("c", 5, 8)], "doc string, first int, last int"), ask)
    rows = got.collect()
    assert sorted((r.doc, p) for r in rows for p in range(r.first, r.last + 1)) == sorted([*[("a", p) for p in range(1, 14)], ("b", 1), *[("c", p) for p in range(5, 9)]])
    assert all((r.text == "ok") == (r.last - r.first + 1 <= most) and (r.text or r.first == r.last) for r in rows)
    assert len(asked) == len(set(asked)) and len(folders) == max(r.round for r in rows) <= 5
