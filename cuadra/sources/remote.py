"""Answers of a remote model: signed requests from the tasks, a bounded number at once, with a deadline, retries and named errors."""

from __future__ import annotations

import json
import random
import secrets
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import request_names
from .documents import signature

#: Fixed: the seconds that one request may take, and the answers of a server that may be different next time.
SECONDS, PASSING = 300, {429, 500, 502, 503, 504}
#: Kinds of errors: the server's status, no connection, an answer that isn't JSON or no object, ``ok: false``, no text, no time left.
KINDS = ("http", "unavailable", "not_json", "bad_format", "refused", "empty", "deadline")
ANSWERS = "doc string, unit_no int, text string, error string, kind string, status int, attempts int"


@dataclass(frozen=True)
class Endpoint:
    """Where to ask, and as whom; all by the caller."""

    url: str
    route: str
    client_id: str
    secret: str
    task: str = ""
    client: str = ""

    def __post_init__(self) -> None:
        if not self.url.strip() or not self.client_id.strip() or not self.secret.strip():
            raise ValueError("a URL, a client's id and its secret are needed")

    @property
    def address(self) -> str:
        return f"{self.url.strip().rstrip('/')}/{self.route.strip().lstrip('/')}"

    def headers(self, body: str, source: str, timestamp: str, nonce: str) -> dict[str, str]:
        """Fixed: names of the headers. Blank ones are left out."""
        task = self.task.strip().upper()
        found = {
            "Content-Type": "application/json; charset=utf-8",
            "X-IA-Client-Id": self.client_id,
            "X-IA-Timestamp": timestamp,
            "X-IA-Nonce": nonce,
            "X-IA-Signature": signature(self.secret, timestamp, nonce, body),
            "X-IA-Task": task,
            "X-IA-Opcion": task,
            "X-IA-IdCliente": self.client.strip(),
            "X-IA-Source-Filename": source,
            "X-IA-Archivo-Nombre": source,
        }
        return {k: v.encode().decode("latin-1") for k, v in found.items() if v}  # headers are bytes; texts go as UTF-8


class AnswerError(Exception):
    def __init__(self, kind: str, message: str, status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status


def request_body(endpoint: Endpoint, model: str, most_tokens: int, content: Column, source: Column, text: Column | None = None) -> Column:
    """The compact JSON of a request for ``content``, an array of blocks; the task, client and file go under all their names."""
    question = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    pairs = [("model", F.lit(model)), ("max_output_tokens", F.lit(most_tokens)), ("input", question), *([("text", text)] if text is not None else []), *request_names(F.lit(endpoint.task), F.lit(endpoint.client), source)]
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


def read_answer(body: str) -> str:
    """The text of a server's answer."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise AnswerError("not_json", "the answer is no JSON") from e
    if not isinstance(data, dict):
        raise AnswerError("bad_format", "the answer is no object")
    if data.get("ok") is False:
        raise AnswerError("refused", str(data.get("error") or "no detail"))
    text = str(data.get("output_text") or "").strip()
    if not text:
        raise AnswerError("empty", "the model's answer is empty")
    return text


def _ask(endpoint: Endpoint, body: str, source: str, seconds: float) -> str:
    headers = endpoint.headers(body, source, str(int(time.time())), secrets.token_hex(16))
    request = urllib.request.Request(endpoint.address, body.encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=seconds) as got:
            return read_answer(got.read().decode("utf-8", "replace"))
    except urllib.error.HTTPError as e:
        raise AnswerError("http", f"HTTP {e.code}: {e.read().decode('utf-8', 'replace')}", e.code) from e
    except (OSError, ValueError) as e:
        raise AnswerError("unavailable", f"not available: {e}") from e


def _answer(endpoint: Endpoint, body: str | None, source: str | None, deadline: float, attempts: int, pause: float) -> tuple:
    """text, error, kind, status, attempts."""
    if body is None:
        return None, "no request", "bad_format", None, 0
    ends, last = time.monotonic() + deadline, AnswerError("deadline", "no time was left")
    for k in range(1, attempts + 1):
        left = ends - time.monotonic()
        if left <= 0:
            return None, f"no time was left; before: {last}", "deadline", last.status, k - 1
        try:
            return _ask(endpoint, body, (source or "").strip(), min(SECONDS, left)), None, None, None, k
        except AnswerError as e:
            last = e
            if k == attempts or not (e.kind == "unavailable" or e.status in PASSING):
                return None, str(e), e.kind, e.status, k
        wait = pause * 2 ** (k - 1) * random.uniform(0.5, 1.0)
        time.sleep(max(0.0, min(wait, ends - time.monotonic())))
    raise AssertionError("unreachable")


def remote_answers(units: DataFrame, endpoint: Endpoint, concurrent: int = 8, per_task: int = 4, deadline: float = 900, attempts: int = 4, pause: float = 1.0) -> DataFrame:
    """``units`` (doc, unit_no, body, source) to doc, unit_no, text, error, kind, status, attempts.

    At most ``concurrent`` requests are under way in the whole job: units are dealt to so many tasks as have ``per_task`` each. A
    unit has ``deadline`` seconds and ``attempts``, with a pause that doubles, for what may pass (no connection, a busy server); other
    errors stay at once. Errors stay with their unit; a null body is one. A task that Spark runs again asks again, so write the
    result before it is used twice.
    """
    at_once = max(1, min(per_task, concurrent))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = batch.to_pylist()
                got = list(pool.map(lambda r: _answer(endpoint, r["body"], r["source"], deadline, attempts, pause), rows))
                columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)] if got else [pa.array([], pa.string())] * 3 + [pa.array([], pa.int32())] * 2
                yield pa.RecordBatch.from_arrays([batch["doc"], batch["unit_no"].cast(pa.int32()), *columns], ["doc", "unit_no", "text", "error", "kind", "status", "attempts"])

    dealt = units.select("doc", "unit_no", "body", "source").repartition(max(1, concurrent // at_once), "doc", "unit_no")
    return dealt.mapInArrow(task, ANSWERS)
