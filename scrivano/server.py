"""A small JSON server over the operators, on this machine's own address alone.

POST /api/registers, /api/infer, /api/enforce, /api/score, /api/feedback and /api/rewrite; an unknown path is 404, what a
request lacks is 502 with the reason, any other error is 500. GET serves files of a folder, none outside it.
"""

from __future__ import annotations

import json
import mimetypes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scrivano import config, schemas
from scrivano.operators import rewrite, rules, score
from scrivano.sources import corpus


class Refused(Exception):
    """A request that can't be met; the reason is what the client is told."""


class Api:
    """The answers to requests, as plain dictionaries."""

    def __init__(self, spark: SparkSession, where: config.Folders, backends: list[rewrite.Backend] | None = None):
        self.spark, self.where, self.backends = spark, where, backends or []

    def _prints(self):
        try:
            return self.spark.read.schema(schemas.PROFILE).json(f"{self.where.profiles}/fingerprint")
        except Exception as e:
            raise Refused("there are no fingerprints") from e

    def _draft(self, asked: dict):
        if not isinstance(asked.get("text"), str):
            raise Refused("a text is needed")
        return self.spark.createDataFrame([(1, asked["text"], asked.get("register") or "editorial")], "key int, text string, register string")

    def registers(self, asked: dict) -> dict:
        return {"registers": [r.asDict() for r in score.registers_info(self._prints()).collect()]}

    def infer(self, asked: dict) -> dict:
        return score.infer(self._draft(asked), self._prints(), "key").drop("key").first().asDict()

    def enforce(self, asked: dict) -> dict:
        row = rules.enforce(self._draft(asked)).first()
        return {"text": row.enforced, "applied": row.applied, "flags": row.flags}

    def score(self, asked: dict) -> dict:
        drafts, prints = self._draft(asked), self._prints()
        try:
            score.require(drafts, prints)
        except score.ProfileNotFound as e:
            raise Refused(str(e)) from e
        row = score.score(drafts, prints).first()
        return {"fidelity": round(row.fidelity, 1), "confidence": row.confidence, "model_ism_signals": row.signals}

    def rewrite(self, asked: dict) -> dict:
        if not self.backends:
            raise Refused("no model is set")
        row = rewrite.rewrite(self._draft(asked), self.backends).first()
        if row.rewritten is None:
            raise Refused(row.error or "no model answered")
        return {"text": row.rewritten, "backend": row.backend}

    def feedback(self, asked: dict) -> dict:
        if asked.get("verdict") not in rewrite.VERDICTS:
            raise Refused(f"a verdict is one of {', '.join(rewrite.VERDICTS)}")
        given = self.spark.createDataFrame([(asked.get("register"), asked["verdict"], asked.get("note"))], "register string, verdict string, note string")
        path = f"{self.where.corpus}/feedback.jsonl"
        corpus.append_feedback(rewrite.feedback_rows(given), path)
        counts = rewrite.feedback_counts(corpus.read_jsonl(self.spark, path, schemas.FEEDBACK)).where(F.col("register").eqNullSafe(F.lit(asked.get("register")))).first()
        return counts.asDict()

    def answer(self, path: str, body: bytes) -> tuple[int, dict]:
        name = path.removeprefix("/api/")
        if not path.startswith("/api/") or name not in ("registers", "infer", "enforce", "score", "rewrite", "feedback"):
            return 404, {"error": "not found"}
        try:
            asked = json.loads(body or b"{}")
            if not isinstance(asked, dict):
                raise Refused("an object is needed")
            return 200, getattr(self, name)(asked)
        except Refused as e:
            return 502, {"error": str(e)}
        except Exception as e:  # noqa: BLE001  the client is told, the server goes on
            return 500, {"error": str(e)}


def static(folder: str | None, path: str) -> Path | None:
    """The file of a path inside the folder; / is index.html."""
    if not folder:
        return None
    root = Path(folder).resolve()
    found = (root / (path.split("?")[0].lstrip("/") or "index.html")).resolve()
    return found if found.is_relative_to(root) and found.is_file() else None


def build(api: Api, port: int, web: str | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            status, said = api.answer(self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.send(status, "application/json", json.dumps(said).encode())

        def do_GET(self) -> None:
            found = static(web, self.path)
            if found:
                self.send(200, mimetypes.guess_type(found.name)[0] or "application/octet-stream", found.read_bytes())
            else:
                self.send(404, "application/json", b'{"error": "not found"}')

        def log_message(self, *_) -> None:
            pass  # texts and names stay out of logs

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(spark: SparkSession, where: config.Folders, port: int, web: str | None = None) -> None:
    with build(Api(spark, where), port, web) as server:
        server.serve_forever()
