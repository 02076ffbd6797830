"""Adapters to HTTP services, for use behind the ledger of :mod:`samplewright.operators.backends`.

A call gives rows ``request_key, status, result``. The status says whether repeating it could do harm: ``refused`` and ``limited`` were not
carried out, ``unknown`` may have been.
"""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

import pandas as pd

#: Most bytes read of an answer.
MOST_BYTES = 256 * 1024 * 1024


def secret(reference: str) -> str:
    """A credential from ``env:NAME`` or ``file:PATH``; plain values are refused so that none gets into a plan."""
    if reference.startswith("env:"):
        return os.environ[reference[4:]]
    if reference.startswith("file:"):
        with open(reference[5:], encoding="utf-8") as f:
            return f.read().strip()
    raise ValueError("credentials are references: env:NAME or file:PATH")


def trusted(url: str, hosts: tuple[str, ...]) -> bool:
    """HTTPS on a listed host, or plain HTTP on this machine."""
    parts = urllib.parse.urlsplit(url)
    return parts.hostname in ("127.0.0.1", "localhost") or (parts.scheme == "https" and parts.hostname in hosts)


def media_kind(data: bytes) -> str | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


@dataclass(frozen=True)
class Service:
    """Where a service is and how it is called."""

    url: str
    hosts: tuple[str, ...] = ()
    credential: str | None = None
    timeout_s: float = 60.0

    def post(self, body: dict, path: str = "", method: str = "POST", key: str | None = None) -> tuple[str, dict | str]:
        """Status and answer of one call."""
        url = self.url.rstrip("/") + path
        if not trusted(url, self.hosts):
            return "refused", "untrusted address"
        headers = {"Content-Type": "application/json"} | ({"Idempotency-Key": key} if key else {}) | ({"Authorization": f"Bearer {secret(self.credential)}"} if self.credential else {})
        request = urllib.request.Request(url, json.dumps(body).encode() if method == "POST" else None, headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                data = answer.read(MOST_BYTES + 1)
        except urllib.error.HTTPError as e:
            known = {401: "refused", 403: "refused", 429: "limited"}
            return known.get(e.code, "unknown" if e.code >= 500 else "refused"), f"http {e.code}"
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            return "unknown", str(e)
        if len(data) > MOST_BYTES:
            return "unknown", "answer too large"
        try:
            return "succeeded", json.loads(data)
        except ValueError:
            return "unknown", "answer is not JSON"


def replacement_sender(service: Service):
    """Sends payloads ``{"image": base64, "mask": base64, "prompt": ..., "seed": ...}`` and takes an image back as base64.

    An address instead of an image is refused, and so is what is no image.
    """

    def send(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, payload in zip(batch["request_key"], batch["payload"], strict=True):
            status, answer = service.post(json.loads(payload), key=key)
            if status == "succeeded":
                image = answer.get("image", "") if isinstance(answer, dict) else ""
                try:
                    kind = None if image.startswith("http") else media_kind(base64.b64decode(image, validate=True))
                except ValueError:
                    kind = None
                status, answer = ("succeeded", image) if kind else ("unknown", "answer holds no image")
            out.append((key, status, answer if isinstance(answer, str) else json.dumps(answer)))
        return pd.DataFrame(out, columns=["request_key", "status", "result"])

    return send


def video_functions(service: Service, hosts: tuple[str, ...] = ()):
    """Submit, status and cancel functions of a provider with ``POST /tasks``, ``GET /tasks/ID`` and ``POST /tasks/ID/cancel``.

    A finished task's address is passed on only if its host is trusted.
    """
    names = {"queued": "running", "running": "running", "processing": "running", "done": "succeeded", "succeeded": "succeeded", "failed": "failed", "error": "failed", "cancelled": "cancelled"}

    def read(status: str, answer, before: str) -> tuple[str, str]:
        if status != "succeeded" or not isinstance(answer, dict):
            return (status if before == "" else "running"), before or str(answer)
        state = names.get(str(answer.get("state", "")).lower(), "unknown")
        if answer.get("url") and not trusted(answer["url"], hosts):
            return "failed", "untrusted result address"
        return state, json.dumps({"task": answer.get("id"), "url": answer.get("url")})

    def table(rows) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=["request_key", "status", "result"])

    def submit(batch: pd.DataFrame) -> pd.DataFrame:
        return table((k, *read(*service.post(json.loads(p), "/tasks", key=k), "")) for k, p in zip(batch["request_key"], batch["payload"], strict=True))

    def follow(path: str, method: str):
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            return table((k, *read(*service.post({}, path.format(json.loads(r)["task"]), method), r)) for k, r in zip(batch["request_key"], batch["result"], strict=True))

        return run

    return submit, follow("/tasks/{}", "GET"), follow("/tasks/{}/cancel", "POST")


def render_command(source: str, target: str, operations: list[tuple[str, dict]]) -> list[str]:
    """The ffmpeg call of the local render operations: reframe, speed, trim, grade, mute. The binary must be on the workers."""
    video, audio, head = [], [], []
    for name, p in operations:
        if name == "trim":
            head += ["-ss", f"{float(p['start']):g}", "-to", f"{float(p['end']):g}"]
        elif name == "speed":
            video.append(f"setpts=PTS/{float(p['factor']):g}")
            audio.append(f"atempo={float(p['factor']):g}")
        elif name == "reframe":
            w, h = (int(x) for x in p["size"])
            video.append(f"scale={w}:{h}:force_original_aspect_ratio=decrease,pad={w}:{h}:(ow-iw)/2:(oh-ih)/2")
        elif name == "grade":
            video.append(f"eq=brightness={float(p.get('brightness', 0)):g}:saturation={float(p.get('saturation', 1)):g}")
        elif name == "mute":
            audio = ["mute"]
        else:
            raise ValueError(f"unknown render operation {name!r}")
    silent = "mute" in audio
    return ["ffmpeg", "-y", "-v", "error", *head, "-i", source, *(["-vf", ",".join(video)] if video else []), *(["-an"] if silent else ["-af", ",".join(audio)] if audio else []), target]
