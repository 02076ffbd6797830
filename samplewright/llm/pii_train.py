"""Training of the tagger of :mod:`pii`, in numpy, from labelled spans.

    OMP_NUM_THREADS=1 python -m samplewright.llm.pii_train DOCUMENTS.parquet... [--seconds 900] [--start WEIGHTS.npz]

The tables have no labels, so spans are labelled here by the forms and name parts that occur in
them (``labelled``); this is used for training and for the held-out figure only, never by a query. Training
windows are cut around labelled spans and at random; in most of them the spans are
replaced by invented ones (``invented``), so that the network learns form and surroundings, not names. WRITTEN of the windows are cut
from sentences that are made up (:mod:`pii_texts`) with names, numbers and addresses of many countries, and with numbers and names of things that are no places.
At most ROWS documents are read.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys
import time
import unicodedata
from collections import Counter

import numpy as np

from samplewright.llm import pii_texts
from samplewright.llm.pii import FIRST_HAN, HAN, KINDS, PAD, TAGS, WEIGHTS, Tagger, allowed, code_table, places, points

#: Bound on the labelled sample, size of the network, window length, windows of a step in each process, Han characters told apart.
ROWS, HIDDEN, EMBED, LENGTH, BATCH, HAN_COUNT = 20_000, 64, 32, 128, 64, 300

#: Share of the windows that are cut from made-up sentences.
WRITTEN = 0.4

FIRST = "Bram Rafael Dario Tobin Leocadie Zoë Ilsa Joris Björn Íñigo Solène Ulrike Ottilie Lucian Odalys Farah Yvaine Mirela Begoña Wanda Yusuf Henrik Xenia Petra Imke Clémence Sanne Sunniva Callum Anselm Amparo Maren Teodor Kofi Viggo Ruta Zelda Jürgen Noor Anaïs".split()
SUR_A = "tov mirn gorm vel ostr rusk wend fer yarl sarv kestr dunv brask thal cald norr zim lumb pell ursk jarn ister hald quen elsk".split()
SUR_B = "ard ast dry emann ier orsky oukis rin ström wick aldi enby ik ovan quist mere ález ette".split()
PLACE_A = "Amber Birken Copper Ember Falken Fenn Harrow Heron Larch Mill Moss Quill Rook Sable Tallow Thorn Willow Wren".split()
PLACE_B = "brook combe field gate hollow mere moor ridge stead wick".split()
TOWNS = "Eastfenn Villarrubio Nordhagen Lüttgrund Obertann Brackwater Sierrapuente Pellworth Montclairval Valmorin".split()

_S = r"[  ]"
_F = rf"(?:{'|'.join(FIRST)})(?:-(?:{'|'.join(FIRST)}))?"
_N = rf"(?:{'|'.join(SUR_A)})(?:{'|'.join(SUR_B)})"
_N = rf"{_N}(?:-{_N})?"
_I = rf"[A-ZÀ-Þ]\.(?:{_S}?[A-ZÀ-Þ]\.)?"
_X = rf"(?:{'|'.join(PLACE_A)})(?:{'|'.join(PLACE_B)})"
_TOWN = r"[A-ZÄÖÜ][a-zà-ÿ]+"
_D = r"(?:\.|\[dot\]|{s}\(dot\){s})".format(s=_S)
_FORMS = [
    ("email", rf"(?<![A-Za-z\d._+-])[a-z\d_+-]+(?:\.[a-z\d_+-]+)*(?:{_S}?@{_S}?|\[at\]|{_S}\(at\){_S})[a-z]{{3,}}(?:{_D}[a-z]+)*{_D}(?:example|test|invalid|com|net|org)(?![A-Za-z\d])"),
    ("address", rf"(?<![A-Za-zÀ-ÿ\d])(?:Flat{_S}\d+,{_S})?\d+{_S}{_X}{_S}(?:Street|St\.|Road|Rd\.|Avenue|Ave|Lane|Close|Terrace|Drive|Way|Court|Blvd)(?:,{_S}Apt{_S}\w+)?(?:(?:,{_S}|\r?\n){_TOWN}{_S}\d{{5}})?"),
    ("address", rf"(?:\b{_X}(?:str\.|straße|weg|gasse|allee|platz)|\b{_X}e?r{_S}(?:Straße|Weg|Allee|Platz)|\b(?:Am|An{_S}der|Im){_S}{_X}){_S}\d+(?:{_S}?[a-d]\b)?(?:(?:,{_S}|\r?\n)\d{{5}}{_S}{_TOWN})?"),
    ("address", rf"(?<![A-Za-zÀ-ÿ\d])\d+(?:{_S}(?:bis|ter))?,?{_S}(?:rue|avenue|chemin|boulevard|bd|place|quai|allée)(?:{_S}d[eu])?{_S}{_X}(?:(?:,{_S}|\r?\n)\d{{5}}{_S}{_TOWN})?"),
    ("address", rf"(?<![A-Za-zÀ-ÿ\d])(?:Calle|C/|Avenida{_S}de|Avenida|Plaza|Paseo|Camino){_S}{_X},?{_S}\d+(?:,{_S}\d+º{_S}[A-Z]\b)?(?:(?:,{_S}|\r?\n)\d{{5}}{_S}{_TOWN})?"),
    ("id_number", rf"(?<![A-Za-zÀ-ÿ\d_.,-])(?:(?:000|666)([- ])\d\d\1\d{{4}}|QQ(?:\d{{6}}|{_S}\d\d{_S}\d\d{_S}\d\d{_S})[A-D]|XQ\d{{7}}|[0O]\d{{4}}[A-Z]{{2}}\d\d|0\d{{10}}|0\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|9\d{{14}}|9(?:{_S}\d\d){{3}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d|\d{{8}}-?[IOU]|\d\d\.\d{{3}}\.\d{{3}}-[IOU]|99\d{{4}}(?:19|20)\d{{9}}[\dX])(?![A-Za-zÀ-ÿ\d_])"),
    ("phone", rf"(?<![A-Za-zÀ-ÿ\d_.,/-])(?:\+1([-{_S[1:-1]}])\d{{3}}\1\d{{3}}\1\d{{4}}|\+1\d{{10}}|1{_S}\(\d{{3}}\){_S}\d{{3}}{_S}\d{{4}}|\(\d{{3}}\){_S}\d{{3,4}}-\d{{4}}|\d{{3}}([-.])555\2\d{{4}}|\d{{3}}{_S}555{_S}\d{{4}}(?:{_S}ext\.{_S}\d+)?|\+44{_S}20{_S}\d{{4}}{_S}\d{{4}}|020{_S}\d{{4}}{_S}\d{{4}}|0044{_S}20{_S}\d{{8}}|\+33{_S}1(?:{_S}\d\d){{4}}|01(?:{_S}\d\d){{4}}|01(?:\.\d\d){{4}}|0199(?:{_S}\d\d){{3}}|\+49{_S}\(0\)30{_S}\d{{5}}-\d{{3}}|\+49{_S}30{_S}\d{{8}}|0049-30-\d{{5}}-\d{{3}}|030/\d{{8}}|030{_S}\d{{5}}{_S}\d{{3}})(?![\d])"),
    ("person", rf"(?<![A-Za-zÀ-ÿ\d.-])(?:{_N},{_S}{_F}(?:{_S}{_I})?|{_F}{_S}(?:{_I}{_S})?{_N}|{_I}{_S}{_N})(?![A-Za-zÀ-ÿ\d])"),
]
_COMPILED = [(k, re.compile(p, re.IGNORECASE if k in ("email", "person") else 0)) for k, p in _FORMS]


def labelled(text: str) -> list[tuple[int, int, str]]:
    """Spans by the known forms, the first form winning where two overlap."""
    taken: list[tuple[int, int, str]] = []
    for kind, form in _COMPILED:
        for m in form.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e, _ in taken) and not (kind == "email" and "@" in m[0] and text[m.start() - 1 : m.start()] == "@"):
                taken.append((m.start(), m.end(), kind))
    return sorted(taken)


def _word(rng: random.Random) -> str:
    """An invented name part of one to three syllables."""
    onset, vowel, coda = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t th tr v w y z".split(), "a e i o u ai ei ia ou ö ü é á í ó ä ø".split(), "n r l s t m rd nd ng ck sk th ff x w ń ł".split() + [""] * 6
    return "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(rng.choice((1, 2, 2, 3)))).capitalize()


def _fill(form: str, rng: random.Random) -> str:
    """``9`` becomes a digit, ``A`` a capital letter."""
    return "".join(rng.choice("0123456789") if c == "9" else rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in form)


_PHONES = "+1 999 999 9999|+1-999-999-9999|+19999999999|1 (999) 999 9999|(999) 999-9999|(020) 9999-9999|999-999-9999|999.999.9999|999 999 9999|999 999 9999 ext. 99|+44 20 9999 9999|+44 9999 999999|020 9999 9999|0044 20 99999999|+33 1 99 99 99 99|01 99 99 99 99|01.99.99.99.99|0199 99 99 99|+49 (0)30 99999-999|+49 30 99999999|+49 999 9999999|0049-30-99999-999|030/99999999|030 99999 999|+34 999 99 99 99|+86 139 9999 9999|+39 06 9999 9999".split("|")
_IDS = "999-99-9999|999 99 9999|000-99-9999|666 99 9999|AA999999A|AA 99 99 99 A|AA9999999|A9999AA99|O9999AA99|99999999999|09 999 999 999|9 99 99 99 999 999 99|999999999999999|99999999-A|99.999.999-A|99999999A|999999999999999999|99999919991231999A|999999200001019999|A99999999".split("|")


def invented(kind: str, rng: random.Random) -> str:
    """A made-up place of a kind, every other one in the forms of :mod:`pii_texts`."""
    if rng.random() < 0.5:
        return pii_texts.place(kind, rng)
    first = lambda: rng.choice(FIRST) if rng.random() < 0.35 else _word(rng)
    sur = lambda: (rng.choice(SUR_A) + rng.choice(SUR_B)).capitalize() if rng.random() < 0.35 else _word(rng) + rng.choice(("", "", "son", "ski", "er", "ez", "in"))
    if kind == "person":
        f = first() if rng.random() < 0.85 else f"{first()}-{first()}"
        s = sur() if rng.random() < 0.85 else f"{sur()}-{sur()}"
        letter = rng.choice("ABCDEFGHIJKLMNOPRSTUVWXYZÉÍÖ") + "."
        gap = rng.choice((" ", " ", " ", " ", " "))
        name = rng.choices((f"{f}{gap}{s}", f"{s}, {f}", f"{letter}{gap}{s}", f"{f} {letter}{gap}{s}", f"{s}, {f} {letter}", f"{letter} {rng.choice('ABCDEHJKLMPRST')}. {s}", f"{s}, {letter}", f"{s} {f}"), (60, 14, 10, 7, 2, 2, 2, 3))[0]
        return name.upper() if rng.random() < 0.05 else name
    if kind == "email":
        ascii_only = lambda w: unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode().lower() or "x"
        f, s = ascii_only(first()), ascii_only(sur())
        local = rng.choice((f"{f}.{s}", f"{f}_{s}", f"{f[0]}{s}", f"{s}{rng.randint(1, 99)}", f"{s}-{f[:2]}", f"{f}+{rng.choice(('labels', 'news', 'x'))}", f"{f}-{s}", f"{f}.{s}-{s[:4]}", f"{rng.choice(('qa.team', 'no.reply', 'masks', 'info', 'annotation-desk'))}{rng.randint(1, 99)}"))
        domain = [rng.choice((ascii_only(_word(rng)) + ascii_only(_word(rng)), "example", "gatekeepers", "lumenyard", "mail-" + ascii_only(_word(rng)))), rng.choice(("example", "test", "invalid", "com", "net", "org", "de", "fr", "es", "io"))]
        if rng.random() < 0.15:
            domain.insert(0, rng.choice(("mail", "mx", "post")))
        at, dot = rng.choices((("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")), (75, 8, 8, 9))[0]
        mail = local + at + dot.join(domain)
        return mail.upper() if rng.random() < 0.07 else mail
    if kind == "phone":
        form = rng.choice(_PHONES)
        return _fill(form.replace(" ", " ") if rng.random() < 0.08 else form, rng)
    if kind == "id_number":
        return _fill(rng.choice(_IDS), rng)
    x = rng.choice(PLACE_A) + rng.choice(PLACE_B) if rng.random() < 0.5 else _word(rng) + rng.choice(("", "", "ton", "ford", "hill", "tal", "berg"))
    town, number = rng.choice(TOWNS) if rng.random() < 0.5 else _word(rng), rng.randint(1, 260)
    sep = rng.choice((", ", ", ", "\n"))
    postcode = f"{rng.choice('00123456789')}{rng.randint(0, 9999):04d}"
    style = rng.random()
    if style < 0.45:
        a = f"{number} {x} {rng.choice(('Street', 'St.', 'Road', 'Avenue', 'Ave', 'Lane', 'Close', 'Terrace', 'Blvd', 'Drive'))}"
        a = f"Flat {rng.randint(1, 30)}, {a}" if rng.random() < 0.2 else f"{a}, Apt {rng.randint(1, 30)}{rng.choice('ABC')}" if rng.random() < 0.25 else a
        return f"{a}, {town} {postcode}" if rng.random() < 0.4 else a
    if style < 0.65:
        a = rng.choice((f"{x}str.", f"{x}straße", f"{x}weg", f"{x}er Straße", f"Am {x}", f"{x}gasse", f"{x}allee")) + f" {number}" + rng.choice(("", "", "", "a", " b"))
        return f"{a}{sep}{postcode} {town}" if rng.random() < 0.4 else a
    if style < 0.83:
        a = f"{number}{rng.choice(('', '', '', ' bis', ' ter'))}{rng.choice((',', ''))} {rng.choice(('rue', 'avenue de', 'chemin', 'bd', 'rue de', 'boulevard', 'rue du'))} {x}"
        return f"{a}{sep}{postcode} {town}" if rng.random() < 0.4 else a
    a = rng.choice((f"Calle {x} {number}", f"C/ {x}, {number}", f"Avenida de {x} {number}", f"Plaza {x} {number}", f"Paseo {x} {number}"))
    a += f", {rng.randint(1, 9)}º {rng.choice('ABCD')}" if rng.random() < 0.25 else ""
    return f"{a}{sep}{postcode} {town}" if rng.random() < 0.4 else a


def window(text: str, spans: list[tuple[int, int, str]], rng: random.Random, swap: bool = True) -> tuple[str, list[int]]:
    """A window of LENGTH characters and its tags, most often around a span, its spans mostly replaced unless ``swap`` is false."""
    if spans and rng.random() < 0.75:
        s, e, _ = rng.choice(spans)
        at = rng.randint(max(0, e - LENGTH + 8), s) if s > max(0, e - LENGTH + 8) else s
    else:
        at = rng.randint(0, max(0, len(text) - LENGTH // 2))
    if at < LENGTH // 2 and rng.random() < 0.5:
        at = 0
    pieces, tags, done = [], [], at
    swap = swap and rng.random() < 0.7
    for s, e, kind in spans:
        if e <= at or s >= at + 2 * LENGTH:
            continue
        cut = max(0, at - s)
        if s > done:
            pieces.append(text[done:s])
            tags += [0] * (s - done)
        body = text[s:e]
        if swap and not cut and rng.random() < 0.8:
            body = invented(kind, rng)
        first = 1 + 2 * KINDS.index(kind)
        own = [first, *[first + 1] * (len(body) - 1)][cut:]
        pieces.append(body[cut:])
        tags += own
        done = max(done, e)
    end = max(done, at + LENGTH)
    pieces.append(text[done:end])
    joined = "".join(pieces)
    tags += [0] * (len(joined) - len(tags))
    left = 0 if at else rng.randint(0, 24)  # the margin before a text's beginning
    joined, tags = joined[: LENGTH - left], tags[: LENGTH - left]
    return left * "\0" + joined + "\0" * (LENGTH - left - len(joined)), [0] * left + tags + [0] * (LENGTH - left - len(tags))


def initial(han: str, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    size = FIRST_HAN + len(han)
    w = {"han": np.array(han), "e": r.normal(0, 0.3, (size, EMBED))}
    for d in "fb":
        w[f"w_{d}"] = r.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        w[f"u_{d}"] = r.normal(0, 0.7 * HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"b_{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    w |= {"o": r.normal(0, 0.1, (2 * HIDDEN, len(TAGS))), "c": np.zeros(len(TAGS)), "t": np.zeros((len(TAGS), len(TAGS))), "s": np.zeros(len(TAGS))}
    return {k: v if k == "han" else v.astype(np.float32) for k, v in w.items()}


def _forward(w: dict, codes: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    steps, n = codes.shape
    p = w["e"] @ w[f"w_{d}"] + w[f"b_{d}"]
    u = w[f"u_{d}"]
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = p[codes[t]] + h @ u
        g = np.empty_like(z)
        g[:, : 3 * HIDDEN] = 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN]) + 0.5
        g[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
        old_h, old_c = h, c
        c = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * g[:, 3 * HIDDEN :]
        tc = np.tanh(c)
        h = g[:, 2 * HIDDEN : 3 * HIDDEN] * tc
        hs[t] = h
        kept.append((t, g, old_h, old_c, tc))
    return hs, kept


def _backward(w: dict, codes: np.ndarray, d: str, dhs: np.ndarray, kept: list, grad: dict) -> None:
    n, size = codes.shape[1], HIDDEN
    u_t = np.ascontiguousarray(w[f"u_{d}"].T)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    dz_all = np.empty((len(codes), n, 4 * size), np.float32)
    hs = np.empty((len(codes), n, size), np.float32)
    for t, g, old_h, old_c, tc in reversed(kept):
        i, f, o, a = (g[:, k * size : (k + 1) * size] for k in range(4))
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :size] = dc * a * i * (1 - i)
        dz[:, size : 2 * size] = dc * old_c * f * (1 - f)
        dz[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
        dz[:, 3 * size :] = dc * i * (1 - a * a)
        hs[t] = old_h
        dh = dz @ u_t
        dc = dc * f
    flat = dz_all.reshape(-1, 4 * size)
    grad[f"u_{d}"] = hs.reshape(-1, size).T @ flat
    by_code = np.zeros((len(w["e"]), 4 * size), np.float32)
    order = np.argsort(codes.ravel(), kind="stable")
    sorted_codes = codes.ravel()[order]
    cuts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
    by_code[sorted_codes[cuts]] = np.add.reduceat(flat[order], cuts, axis=0)
    grad[f"b_{d}"] = by_code.sum(0)
    grad[f"w_{d}"] = w["e"].T @ by_code
    grad["e"] = grad.get("e", 0) + by_code @ w[f"w_{d}"].T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def gradient(w: dict, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Loss per character (negative log-likelihood of the CRF) and its gradient; time by window."""
    steps, n = codes.shape
    hf, kf = _forward(w, codes, "f")
    hb, kb = _forward(w, codes, "b")
    both = np.concatenate([hf, hb], -1)
    e = both @ w["o"] + w["c"]
    trans = np.where(allowed(), w["t"], np.float32(-1e4)).astype(np.float32)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + w["s"]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    gold = np.take_along_axis(e, tags[..., None], -1).sum((0, 2)) + w["s"][tags[0]] + trans[tags[:-1], tags[1:]].sum(0)
    marginal = np.exp(alpha + beta - z[None, :, None])
    scale = 1.0 / (steps * n)
    dt = np.zeros_like(trans)
    for t in range(1, steps):
        dt += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(dt, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    de = marginal
    ds = de[0].sum(0) - np.bincount(tags[0], minlength=len(TAGS))
    np.put_along_axis(de, tags[..., None], np.take_along_axis(de, tags[..., None], -1) - 1, -1)
    de = (de * scale).astype(np.float32)
    grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, len(TAGS)), "c": de.sum((0, 1)), "t": np.where(allowed(), dt, 0) * scale, "s": ds * scale}
    dhs = de @ w["o"].T
    _backward(w, codes, "f", dhs[..., :HIDDEN], kf, grad)
    _backward(w, codes, "b", dhs[..., HIDDEN:], kb, grad)
    return float((z - gold).sum() * scale), grad


def _work(pipe, texts: list[str], spans: list, table: np.ndarray, seed: int) -> None:
    """A training process: gradients of its own windows for the weights it is sent."""
    rng = random.Random(seed)
    with_spans = [i for i, s in enumerate(spans) if s]
    while (w := pipe.recv()) is not None:
        made = []
        for _ in range(BATCH):
            if rng.random() < WRITTEN:
                made.append(window(*pii_texts.passage(rng), rng, swap=False))
            else:
                i = rng.choice(with_spans) if rng.random() < 0.65 else rng.randrange(len(texts))
                made.append(window(texts[i], spans[i], rng))
        codes = np.stack([table[points(t)] for t, _ in made], 1).astype(np.int64)
        pipe.send(gradient(w, codes, np.array([g for _, g in made], np.int64).T))


def extended(w: dict[str, np.ndarray], han: str) -> dict[str, np.ndarray]:
    """Weights that tell further Han characters apart, which begin as what they were: any Han character."""
    new = "".join(c for c in dict.fromkeys(han) if c not in str(w["han"]))
    return {k: v if k == "han" else v.astype(np.float32) for k, v in w.items()} | {"han": np.array(str(w["han"]) + new), "e": np.concatenate([w["e"], np.repeat(w["e"][[HAN]], len(new), 0)]).astype(np.float32)}


def train(texts: list[str], seconds: float, seed: int = 0, rate: float = 6e-3, processes: int = 8, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Adam over the windows of all processes until the time is used, from ``start`` if given; the rate falls to nothing by then."""
    spans = [labelled(t) for t in texts]
    han = "".join(c for c, _ in Counter(c for t in texts for c in t if "㐀" <= c <= "鿿").most_common(HAN_COUNT))
    w = extended(start, pii_texts.HAN) if start else initial("".join(dict.fromkeys(han + pii_texts.HAN)), seed)
    table = code_table(str(w["han"]))
    table[0] = PAD
    context = multiprocessing.get_context("fork")
    pipes = []
    for i in range(processes):
        ours, theirs = context.Pipe()
        context.Process(target=_work, args=(theirs, texts, spans, table, seed * 1000 + i), daemon=True).start()
        pipes.append(ours)
    m, v = ({k: np.zeros_like(x) for k, x in w.items() if k != "han"} for _ in range(2))
    began, step, shown = time.time(), 0, 0.0
    while (past := (time.time() - began) / seconds) < 1:
        for pipe in pipes:
            pipe.send(w)
        parts = [pipe.recv() for pipe in pipes]
        loss = sum(p[0] for p in parts) / processes
        grad = {k: sum(p[1][k] for p in parts) / processes for k in parts[0][1]}
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        step += 1
        now = rate * min(1, step / 50) * (1 - past)
        for k, g in grad.items():
            g = g * min(1, 0.25 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            w[k] = (w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        shown = loss if step == 1 else 0.98 * shown + 0.02 * loss
        if step % 200 == 0:
            print(f"step {step} loss {shown:.6f} at {past:.2f}", flush=True)
    for pipe in pipes:
        pipe.send(None)
    return w


def score(w: dict[str, np.ndarray], texts: list[str], show: int = 0) -> dict[str, tuple[float, float]]:
    """Precision and recall of exact places per kind against the labels."""
    hit, found, true = Counter(), Counter(), Counter()
    for i in range(0, len(texts), 500):
        for text, own in zip(texts[i : i + 500], places(texts[i : i + 500], Tagger(w)), strict=True):
            a, b = set(own), set(labelled(text))
            for kind in KINDS:
                x, y = {p for p in a if p[2] == kind}, {p for p in b if p[2] == kind}
                hit[kind] += len(x & y)
                found[kind] += len(x)
                true[kind] += len(y)
            for s, e, k in sorted(a ^ b):
                if show > 0:
                    show -= 1
                    print("found" if (s, e, k) in a else "missed", k, repr(text[max(0, s - 30) : s]), repr(text[s:e]), repr(text[e : e + 20]))
    return {k: (hit[k] / max(1, found[k]), hit[k] / max(1, true[k])) for k in KINDS}


def main(args: list[str]) -> None:
    import pandas as pd

    seconds = float(args[args.index("--seconds") + 1]) if "--seconds" in args else 900.0
    out = args[args.index("--out") + 1] if "--out" in args else WEIGHTS
    start = dict(np.load(args[args.index("--start") + 1])) if "--start" in args else None
    files = [a for i, a in enumerate(args) if not a.startswith("--") and (i == 0 or args[i - 1] not in ("--seconds", "--out", "--start"))]
    texts = list(dict.fromkeys(t for f in files for t in pd.read_parquet(f, columns=["text"])["text"].dropna() if t))[:ROWS]
    random.Random(1).shuffle(texts)
    held = len(texts) // 10
    w = train(texts[held:], seconds, rate=2e-3 if start else 6e-3, start=start)
    np.savez_compressed(out, **{k: x if k == "han" else x.astype(np.float16) for k, x in w.items()})
    print({k: (round(p, 4), round(r, 4)) for k, (p, r) in score(w, texts[:held], 40).items()})


if __name__ == "__main__":
    main(sys.argv[1:])
