"""Problem 8: personal information inside free text, found, typed and replaced.

A character-level bidirectional LSTM reads overlapping windows of the whole text, a CRF layer decodes
each window, and the windows are reconciled over the document: every character takes its tag from the window in which
it stands furthest from an edge, and runs of tags become places. The network is evaluated in numpy, many windows at a time;
its weights were trained in numpy from labelled spans (:mod:`pii_train`) and lie beside this module.

An exact check of each place follows. It moves the ends of a place to the ends of the token the
network pointed at (a whole email address, number or word) and drops places that cannot be of their kind,
such as a phone number of three digits. It finds nothing by itself.

Defined cases: null and empty texts have no places and stay as they are; positions count code points; texts of any length are
read whole; repeated ids are read row by row; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samplewright.session import parallel

KINDS = ("email", "phone", "id_number", "address", "person")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
#: Characters a window decides, and context on either side of them.
CORE, MARGIN = 208, 32
#: Windows evaluated together, and characters taken at once, by one Python worker.
WINDOWS, CHARS = 512, 600_000
PAD, LINE, SPACE, SYMBOL, LETTER, HAN, STOP = range(7)
FIRST_ASCII, FIRST_HAN = 7, 7 + 94


def allowed() -> np.ndarray:
    """Which tag may follow which: an inside tag only its own kind."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            for i, before in enumerate(TAGS):
                ok[i, j] = before[1:] == tag[1:]
    return ok


def code_table(han: str) -> np.ndarray:
    """Network input of every code point: letters without accents, punctuation in its ASCII form, common Han characters by themselves."""
    table = np.full(0x110000, SYMBOL, np.uint16)
    for point in range(0x3000 * 2):
        c = chr(point)
        kind = unicodedata.category(c)
        plain = unicodedata.normalize("NFKD", c)[:1] if kind[0] != "C" else c
        if c in "\n\r":
            table[point] = LINE
        elif c.isspace():
            table[point] = SPACE
        elif "!" <= plain <= "~":
            table[point] = FIRST_ASCII + ord(plain) - 33
        elif kind[0] == "L":
            table[point] = LETTER
    for point in range(0x3400, 0xD7B0):
        table[point] = HAN if point < 0xA000 else LETTER
    for point in range(0xFF01, 0xFF5F):
        table[point] = FIRST_ASCII + point - 0xFF01
    for group, plain in (("“”„«»", '"'), ("‘’‚", "'"), ("–—‐‑−", "-"), ("、", ",")):
        for c in group:
            table[ord(c)] = FIRST_ASCII + ord(plain) - 33
    table[0x3000], table[ord("。")] = SPACE, STOP
    for i, c in enumerate(han):
        table[ord(c)] = FIRST_HAN + i
    return table


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Tagger:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.table = code_table(str(weights["han"]))
        size = weights["u_f"].shape[0]
        # sigmoid(x) = (tanh(x / 2) + 1) / 2: with the gate columns halved, one tanh serves all four gates. States are kept
        # at twice their value, which the halved recurrent and output weights take back.
        half = np.r_[np.full(3 * size, 0.5), np.ones(size)].astype(np.float32)
        self.size = size
        self.input = {d: np.ascontiguousarray((weights["e"] @ weights[f"w_{d}"] + weights[f"b_{d}"]) * half) for d in "fb"}
        self.recurrent = {d: np.ascontiguousarray(weights[f"u_{d}"] * half * np.float32(0.5)) for d in "fb"}
        self.out, self.bias = weights["o"] * np.float32(0.5), weights["c"]
        self.step = np.where(allowed(), weights["t"], np.float32(-1e4)).astype(np.float32)
        self.first = weights["s"]

    def _run(self, codes: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """Twice the hidden states of one direction, step by step; ``codes`` is time by window."""
        size, table, u = self.size, self.input[d], self.recurrent[d]
        h = np.zeros((codes.shape[1], size), np.float32)
        c, product = np.zeros_like(h), np.empty_like(h)
        z = np.empty((codes.shape[1], 4 * size), np.float32)
        x = np.empty_like(z)
        gates = z[:, : 3 * size]
        take, keep, give, new = (z[:, k * size : (k + 1) * size] for k in range(4))
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            np.matmul(h, u, out=z)
            np.take(table, codes[t], axis=0, out=x, mode="clip")
            z += x
            np.tanh(z, out=z)
            gates += 1
            c *= keep
            c += np.multiply(take, new, out=product)
            c *= 0.5
            np.multiply(give, np.tanh(c, out=product), out=h)
            yield t, h

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Scores, time by window by tag."""
        scores = np.empty((*codes.shape, len(TAGS)), np.float32)
        for t, h in self._run(codes, "f"):
            np.matmul(h, self.out[: self.size], out=scores[t])
        for t, h in self._run(codes, "b"):
            scores[t] += h @ self.out[self.size :]
        return scores + self.bias

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of each window, time by window.

        A window in which even the best run of other tags, each step at its best lead over O, gains nothing on O is O
        throughout, which is exact, and is not decoded.
        """
        tags = np.zeros(scores.shape[:2], np.int8)
        over = self.step - self.step[0, 0]
        enter, leave, inner = over[0, 1:].max(), over[1:, 0].max(), over[1:, 1:].max()
        lead = scores[..., 1:].max(-1) - scores[..., 0]
        run = (scores[0, :, 1:] - scores[0, :, :1] + self.first[1:] - self.first[0]).max(-1)
        worst = run + leave
        for t in range(1, len(scores)):
            run = np.maximum(run + inner, enter) + lead[t]
            np.maximum(worst, run + (leave if t < len(scores) - 1 else 0), out=worst)
        todo = np.flatnonzero(worst > 0)
        if not len(todo):
            return tags
        scores = np.ascontiguousarray(scores[:, todo].transpose(0, 2, 1))  # time, tag, window
        best = scores[0] + self.first[:, None]
        back = np.zeros(scores.shape, np.int8)
        for t in range(1, len(scores)):
            top = best[0] + self.step[0][:, None]
            for i in range(1, len(TAGS)):
                path = best[i] + self.step[i][:, None]
                back[t][path > top] = i
                np.maximum(top, path, out=top)
            best = top + scores[t]
        at = best.argmax(0)
        rows = np.arange(len(todo))
        for t in range(len(scores) - 1, -1, -1):
            tags[t, todo] = at
            at = back[t, at, rows]
        return tags

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """A tag for every code point of every text."""
        codes = [self.table[points(x)] for x in texts]
        begin, total = [], MARGIN
        for c in codes:
            begin.append(total)
            total += len(c) + MARGIN
        flat = np.zeros(total + MARGIN + CORE, np.uint16)
        for b, c in zip(begin, codes, strict=True):
            flat[b : b + len(c)] = c
        # Windows of like length are evaluated together, so the short rest of a text is not padded to a whole window.
        windows = sorted((min(CORE, len(c) - s), i, s) for i, c in enumerate(codes) for s in range(0, len(c), CORE))
        out = [np.zeros(len(c), np.int8) for c in codes]
        for a in range(0, len(windows), WINDOWS):
            batch = windows[a : a + WINDOWS]
            starts = np.array([begin[i] + s - MARGIN for _, i, s in batch])
            window = flat[starts + np.arange(batch[-1][0] + 2 * MARGIN)[:, None]]
            # A shorter window of the batch may reach into the next text, which it must not read.
            window[np.arange(len(window))[:, None] >= np.array([begin[i] + len(codes[i]) + MARGIN for _, i, _ in batch]) - starts] = PAD
            tags = self.decode(self.emissions(window))[MARGIN:-MARGIN]
            for w in np.flatnonzero(tags.any(0)):
                size, i, s = batch[w]
                out[i][s : s + size] = tags[:size, w]
        return out


def weights_of(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k] for k in f.files}


@functools.cache
def tagger(path: str = WEIGHTS) -> Tagger:
    return Tagger(weights_of(path))


def runs(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Places of a tag sequence. A kind that goes on over a window's edge is one place."""
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    starts = (kind > 0) & ((kind != np.r_[0, kind[:-1]]) | (tags % 2 == 1))
    found = []
    for s in np.flatnonzero(starts):
        e = s + 1
        while e < len(tags) and kind[e] == kind[s] and not starts[e]:
            e += 1
        found.append((int(s), int(e), KINDS[kind[s] - 1]))
    return found


_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_TOKEN = {
    "email": re.compile(rf"[A-Z0-9À-ÿ._+%-]+{_AT}[A-Z0-9À-ÿ-]+(?:{_DOT}[A-Z0-9À-ÿ-]+)+", re.IGNORECASE),
    "phone": re.compile(r"(?:\+|\b|(?=\())(?:\(?\d+\)?[\s./-]{0,2}\(?){1,8}\d+(?:\s?(?:ext|x|Durchwahl)\.?\s?\d+)?\b", re.IGNORECASE),
    "id_number": re.compile(r"\b[A-Z]{0,3}\s?\d[\dA-Z]*(?:[\s.-][\dA-Z]+)*\b"),
}
_INSIDE = {"email": lambda c: c.isalnum() or c in "._+%-@[]()" or c.isspace(), "phone": lambda c: c.isalnum() or c in "+()./-" or c.isspace(), "id_number": lambda c: c.isalnum() or c in ".-" or c.isspace()}
_DIALLED = re.compile(r"[+(]{0,2}\d[\d\s().\-/]*\d(?:\s?(?:ext|x|Durchwahl)\.?\s?\d+)?", re.IGNORECASE)
_EDGE = " \t\r\n 　,;:!?\"'“”„‘’«»<>|=，。；：、！？“”"
_NEAR = 12
#: A street number and name up to the kind of street, where a word follows without a comma; and a whole name before initials and another surname.
_STREET = re.compile(r"(?:Flat\s\d+,\s)?\d+\s\S+\s(?:Street|St\.|Road|Rd\.|Avenue|Ave|Lane|Close|Terrace|Drive|Blvd|Way|Court)(?=[^\S\r\n][^\W\d])")
_HAN_NAME = re.compile("[\u3400-\u9fff·]{2,6}")
_TWO_NAMES = re.compile(r"([^\W\d][\w'’-]+\s[^\W\d][\w'’-]+)\s((?:[^\W\d]\.\s?)+[^\W\d][\w'’-]+)")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _word_ends(text: str, start: int, end: int) -> tuple[int, int]:
    """Grow to whole words (letters and marks of one alphabet, hyphens and apostrophes between them)."""
    inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() and not "㐀" <= text[i] <= "鿿" or text[i] in "-’'" and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum())
    while start > 0 and inner(start) and inner(start - 1):
        start -= 1
    while end < len(text) and inner(end - 1) and inner(end):
        end += 1
    return start, end


def _overlap(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The token of the kind's form that shares most characters with the place.

    It is sought in the stretch around the place that has no character foreign to the form, however long that is.
    """
    inside = _INSIDE[kind]
    low = start
    while low and inside(text[low - 1]):
        low -= 1
    high = end
    while high < len(text) and inside(text[high]):
        high += 1
    best, shared = None, 0
    for m in _TOKEN[kind].finditer(text, low, high):
        common = min(end, m.end()) - max(start, m.start())
        if common > shared:
            best, shared = (m.start(), m.end()), common
    return best


def check(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The place with exact ends, or None if it cannot be of its kind."""
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    if start >= end:
        return None
    if kind == "email":
        token = _overlap(text, start, end, kind)
        if token:
            start, end = token
            while text[start] in ".-":
                start += 1
            while text[end - 1] in ".-_":
                end -= 1
            return start, end
        return None
    if kind in ("phone", "id_number"):
        token = _overlap(text, start, end, kind)
        if token and abs(token[0] - start) <= _NEAR and abs(token[1] - end) <= _NEAR:
            inside = text[start:end]
            # Growing must not swallow a neighbouring number: only a broken number is grown.
            grown = (token[0] if token[0] < start and (text[start - 1].isalnum() or text[start - 1] in "+(") else start, token[1] if token[1] > end and text[end].isalnum() else end)
            start, end = grown if _digits(inside) else (start, end)
        start, end = _word_ends(text, start, end)
        if kind == "phone":
            parts = [m.span() for m in _DIALLED.finditer(text, start, end)]
            start, end = max(parts, key=lambda p: p[1] - p[0], default=(start, end))
        while start < end and text[end - 1] in ".-/([":
            end -= 1
        if text[start:end].count(")") > text[start:end].count("("):
            if start and text[start - 1] == "(":
                start -= 1
            elif text[end - 1] == ")":
                end -= 1
        if text[start:end].count("(") > text[start:end].count(")"):
            if text[start] == "(" and end < len(text) and text[end] == ")":
                start += 1
            elif text[start] == "(":
                start += 1
        number = _digits(text[start:end])
        return (start, end) if (7 if kind == "phone" else 5) <= number <= 20 else None
    start, end = _word_ends(text, start, end)
    if kind == "address":
        if street := _STREET.match(text, start, end):
            end = street.end()
        while end > start and text[end - 1] in ".-(" and not re.search(r"\b(?:St|Rd|Str|Ave|Blvd)\.$", text[start:end], re.IGNORECASE):
            end -= 1
        if end < len(text) and text[end] == "." and re.search(r"\b(?:St|Rd)$", text[start:end]):
            end += 1
        return (start, end) if _digits(text[start:end]) and any(c.isalpha() for c in text[start:end]) else None
    while end > start and text[end - 1] in ".-(/":
        end -= 1
    if _HAN_NAME.fullmatch(text, start, end):
        return start, end
    words = [w for w in re.split(r"[\s,.]+", text[start:end]) if w]
    return (start, end) if len(words) >= 2 and max(map(len, words)) >= 2 and not _digits(text[start:end]) else None


def _apart(text: str, found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Two names side by side without a mark between them, taken as one, come out as two."""
    for start, end, kind in found:
        two = _TWO_NAMES.fullmatch(text, start, end) if kind == "person" else None
        if two:
            yield from ((*two.span(1), kind), (*two.span(2), kind))
        else:
            yield start, end, kind


def places(texts: list[str | None], model: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """Checked places ``(start, end, kind)`` of each text, in order and apart from each other."""
    model = model or tagger()
    found = []
    for text, tags in zip(texts, model.tag([t or "" for t in texts]), strict=True):
        own: list[tuple[int, int, str]] = []
        for start, end, kind in _apart(text, runs(tags)) if text else ():
            exact = check(text, start, end, kind)
            if exact and (not own or exact[0] >= own[-1][1]):
                own.append((*exact, kind))
        found.append(own)
    return found


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with ``[KIND]`` in each place and otherwise unchanged."""
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def _runs_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)


def find(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos`` of every place."""
    kind_of_id = documents.schema["doc_id"].dataType.simpleString()

    arrays = weights_of(weights)  # read here and sent with the task: executors need not have the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Tagger(arrays)
            texts = batch.column(1).to_pylist()
            for a, b in _runs_of(texts):
                found = places(texts[a:b], model)
                row = pa.array([a + i for i, own in enumerate(found) for _ in own], pa.int64())
                flat = [p for own in found for p in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([p[2] for p in flat], pa.string()), pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.int32())], ["doc_id", "kind", "start_pos", "end_pos"])

    return parallel(documents.select("doc_id", "text").filter("text <> ''")).mapInArrow(run, f"doc_id {kind_of_id}, kind string, start_pos int, end_pos int")


def redact(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``doc_id, text, n_places``: every row with placeholders in its text; null stays null."""
    kind_of_id = documents.schema["doc_id"].dataType.simpleString()

    arrays = weights_of(weights)  # read here and sent with the task: executors need not have the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Tagger(arrays)
            texts = batch.column(1).to_pylist()
            for a, b in _runs_of(texts):
                found = places(texts[a:b], model)
                clean = [t if not own else replaced(t, own) for t, own in zip(texts[a:b], found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(clean, pa.string()), pa.array([len(own) for own in found], pa.int32())], ["doc_id", "text", "n_places"])

    return parallel(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind_of_id}, text string, n_places int")
