"""Secret scan (operator 4): fixed patterns, and a character network over candidates.

Three fixed patterns give the base spans. Beside them every run of LEAST_RUN or more
token characters is a candidate, whatever it is made of and whether or not a base span
holds it; a small convolutional network in numpy reads it with its surroundings, a
long one in overlapping pieces of which the best counts, and scores it. The network is
trained here, on labelled findings written by a seeded generator. Its scores are
calibrated on findings of another generator, whose settings and most of whose formats
training has not seen, each judged by its best piece, and the threshold is the one that keeps the wanted recall there at the
fewest errors. What is found and is not a base span itself becomes a span of its own.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; positions are code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Callable
from functools import lru_cache
from pydoc_data.topics import topics
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from .common import LOWER, map_texts

#: Fixed by the contract, with the least lengths of the second group, the match and the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "cnn")

#: Candidates of the method: runs of token characters this long.
LEAST_RUN = 12
#: Characters that the network sees before a candidate, of its start and after it.
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Characters from the start of a long candidate's piece to the next.
STRIDE = 24
CLASSES, FILTERS, KERNEL, HIDDEN = 48, 32, 5, 32

TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*map(ord, string.ascii_letters + string.digits + "+/_=-")]] = True
HEX_BYTE = np.zeros(256, bool)
HEX_BYTE[[*map(ord, "0123456789abcdef")]] = True


def class_table() -> np.ndarray:
    """Character class of each byte: letters fold to 26 classes, capitals add one bit elsewhere."""
    table = np.full(256, 2, np.uint8)
    table[0] = 0
    for i, c in enumerate(string.ascii_lowercase):
        table[ord(c)] = table[ord(c.upper())] = 3 + i
    for c in string.digits:
        table[ord(c)] = 29 + int(c)
    for i, c in enumerate(" \n=:\"'/_-"):
        table[ord(c)] = 39 + i
    table[128:] = 1
    return table


CLASS = class_table()
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
#: Class and capital of each byte in one number.
KIND = CLASS.astype(np.int64) + CLASSES * UPPER


def window(data: bytes, start: int, end: int) -> bytes:
    """Surroundings and start of a candidate in a fixed width; zero bytes where the text or it ends."""
    return data[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0") + data[start : min(end, start + INSIDE)].ljust(INSIDE, b"\0") + data[end : end + AFTER].ljust(AFTER, b"\0")


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate as it is read: whole, or in overlapping pieces up to its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


class Network(NamedTuple):
    kernel: np.ndarray  # KERNEL, 2 inputs' rows, FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float
    shift: float
    threshold: float


#: Positions that each pooled segment covers: before, inside, after.
SEGMENTS = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, WIDTH))


def planes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)


def convolve(net: Network, x: np.ndarray) -> np.ndarray:
    """Rectified convolution over character classes and capitals, as sums of looked-up rows."""
    rows = KIND[x]
    tables = np.concatenate([net.kernel[:, :CLASSES], net.kernel[:, :CLASSES] + net.kernel[:, CLASSES:]], axis=1)
    pad = KERNEL // 2
    total = np.empty((*x.shape, FILTERS), np.float32)
    total[:] = net.bias
    for k in range(KERNEL):
        a, b = max(0, pad - k), min(WIDTH, WIDTH + pad - k)
        total[:, a:b] += np.take(tables[k], rows[:, a + k - pad : b + k - pad], axis=0, mode="clip")
    return np.maximum(total, 0, out=total)


def pooled(active: np.ndarray) -> np.ndarray:
    """Maximum and mean of each filter in each segment."""
    return np.concatenate([f(active[:, a:b], axis=1) for a, b in SEGMENTS for f in (np.max, np.mean)], axis=1)


def logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.maximum(pooled(convolve(net, x)) @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias


def probabilities(net: Network, windows: list[bytes]) -> np.ndarray:
    """Calibrated probabilities, in blocks of bounded size."""
    if not windows:
        return np.zeros(0)
    x = planes(windows)
    z = np.concatenate([logits(net, x[i : i + 64]) for i in range(0, len(x), 64)])
    return 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -60, 60)))


ALNUM = string.ascii_letters + string.digits


def some(r: random.Random, alphabet: str, least: int, most: int = 0) -> str:
    return "".join(r.choices(alphabet, k=r.randint(least, max(least, most))))


def word(r: random.Random) -> str:
    return some(r, string.ascii_lowercase, 2, 9)


#: Syllables of the second generator's words.
PARTS = ("an ar bel ca co de di en er es fi gra ha in ion ka la le lo ma men mi na ne no o per qui ra re ri ro sa si ta te ti tion tra u ver vo").split()


def spoken(r: random.Random) -> str:
    return "".join(r.choices(PARTS, k=r.randint(1, 5)))


@lru_cache(1)
def english_words() -> list[str]:
    """Words and identifiers of Python's own manual, a text that neither generator writes."""
    return sorted({w for page in topics.values() for w in re.findall(r"[a-z]{2,14}", page.lower())})


def english(r: random.Random) -> str:
    return r.choice(english_words())


def either(r: random.Random) -> str:
    return r.choice([english, spoken, word])(r)


def uuid(r: random.Random) -> str:
    return "-".join(some(r, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12))


#: What syllables of European languages begin with, turn on and end in.
ONSETS = ["", *"b bl br c ch d dr f fl g gl gr h j k kl l m n p pf ph pl pr qu r s sch schl sh sp st str t th tr v w wh z zw".split()]
NUCLEI = "a e e i o u ai au ea ee ei eu ie io oo ou ue".split()
CODAS = ["", "", *"b ch cht ck ct d f g gh l ld ll lt m mpf n nd ng ns nt p pf r rd rn rs rt s sch ss st t th tz x".split()]


def syllabic(r: random.Random) -> str:
    """A word of syllables; half its endings come from a few that it may repeat."""
    one = lambda: r.choice(ONSETS) + r.choice(NUCLEI) + r.choice(CODAS)
    ends = [one() for _ in range(3)]
    return "".join(one() if r.random() < 0.5 else r.choice(ends) for _ in range(r.randint(3, 9)))


class Setting(NamedTuple):
    """How a generator writes: makers of values with their label, what leads up to them, words, and ends."""

    secret: list
    plain: list
    secret_lead: list[str]
    plain_lead: list[str]
    word: Callable[[random.Random], str]
    end: list[str]


TRAINING = Setting(
    [
        lambda r: r.choice(["ghp_", "gho_", "ghs_"]) + some(r, ALNUM, 36),
        lambda r: r.choice(["sk_live_", "rk_live_", "sk-"]) + some(r, ALNUM, 24, 48),
        lambda r: f"xoxb-{some(r, string.digits, 11, 12)}-{some(r, ALNUM, 24)}",
        lambda r: "AIza" + some(r, ALNUM + "_-", 35),
        lambda r: "eyJ" + some(r, ALNUM + "_-", 30, 90),
        lambda r: some(r, ALNUM + "+/", 38, 60) + "==",
        lambda r: some(r, r.choice(["0123456789ABCDEF", "0123456789abcdef"]), 32, 64),
        # Keys of one kind of character or a few, short ones as often as long ones.
        *(lambda r, a=a: some(r, a, 16, r.choice([22, 30, 46])) for a in [ALNUM, ALNUM, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters]),
        *(lambda r, a=a: some(r, a, 20, r.choice([24, 30, 42])) for a in [string.ascii_lowercase, string.ascii_uppercase] * 3),
    ],
    [
        lambda r: "-".join(either(r) for _ in range(r.randint(3, 9))) + r.choice(["", f"-{r.randrange(9999)}"]),
        lambda r: "/" * r.randint(0, 1) + "/".join(either(r) for _ in range(r.randint(3, 14))) + r.choice(["", str(r.randrange(999))]),
        lambda r: some(r, string.digits, 12, 24),
        *[lambda r: some(r, string.digits, 16), lambda r: some(r, string.digits, 16, 22)] * 2,
        lambda r: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
        lambda r: "-".join(some(r, string.digits, 3, 4) for _ in range(r.randint(4, 6))),
        lambda r: "_".join(english(r) for _ in range(r.randint(2, 5))) + r.choice(["", str(r.randrange(999))]),
        lambda r: "_".join(english(r) for _ in range(r.randint(2, 4))).upper(),
        lambda r: "-".join(english(r) for _ in range(r.randint(3, 8))),
        lambda r: "/".join(english(r) for _ in range(r.randint(3, 9))),
        lambda r: "".join(english(r) for _ in range(r.randint(2, 5))) + r.choice(["", str(r.randrange(99))]),
        lambda r: english(r) + "".join(english(r).capitalize() for _ in range(r.randint(2, 6))),
        lambda r: "".join(english(r).capitalize() for _ in range(r.randint(2, 6))),
        lambda r: english(r) + "".join(english(r).capitalize() for _ in range(r.randint(2, 6))),
        lambda r: "".join(english(r) for _ in range(r.randint(2, 5))).upper(),
        lambda r: "".join(spoken(r) for _ in range(r.randint(3, 6))),
        lambda r: "".join(spoken(r) for _ in range(r.randint(3, 6))).capitalize(),
        lambda r: "".join(spoken(r) for _ in range(r.randint(3, 6))).upper(),
        lambda r: "-".join(spoken(r) for _ in range(r.randint(2, 5))),
        *[syllabic, lambda r: syllabic(r).upper()] * 2,
        lambda r: syllabic(r).capitalize(),
        # Letters under 15 are words, whatever they spell.
        lambda r: r.choice([str.lower, str.upper, str.capitalize])(some(r, string.ascii_lowercase, 12, 14)),
        lambda r: f"{word(r)}/{word(r)}-{r.randrange(99)}/{word(r)}",
        lambda r: r.choice("=-_/+") * r.randint(12, 90),
        *[uuid, lambda r: uuid(r).upper()] * 2,
    ],
    ["key = ", "auth: ", "Bearer ", "client_id=", '"credential": "', "access_key: ", "export AUTH=", "", "", ""],
    ["see ", "at ", "version ", "https://", "isbn ", "", "", "", "page: ", "key ", "id = ", '"id": "', "card: "],
    either,
    ['"', "\n", " ", "'", ";", ".", ", "],
)

CALIBRATION = Setting(
    [
        lambda r: "glpat-" + some(r, ALNUM + "_-", 20),
        lambda r: "npm_" + some(r, ALNUM, 36),
        lambda r: "pk_test_" + some(r, ALNUM, 24, 32),
        lambda r: f"SG_{some(r, ALNUM, 22)}_{some(r, ALNUM, 43)}",
        lambda r: "AC" + some(r, "0123456789abcdef", 32),
        lambda r: some(r, ALNUM, 20, 64),
        lambda r: some(r, ALNUM + "+/", 64),
        lambda r: some(r, string.ascii_letters, 24, 40),
        lambda r: some(r, string.ascii_lowercase + string.digits, 24, 50),
        lambda r: f"{some(r, ALNUM, 24)}-us{r.randint(1, 20)}",
        lambda r: some(r, string.ascii_lowercase, 24, 32),
        lambda r: some(r, string.ascii_uppercase, 20, 32),
    ],
    [
        lambda r: "".join(spoken(r) for _ in range(r.randint(4, 8))),
        lambda r: "/".join(spoken(r) for _ in range(r.randint(4, 9))),
        lambda r: f"{spoken(r)}-{spoken(r)}-{spoken(r)}_{r.randrange(10**6)}",
        lambda r: some(r, string.digits, 13),
        lambda r: "-".join(some(r, string.digits, 4) for _ in range(4)),
        lambda r: "+" + some(r, string.digits, 12),
        lambda r: "".join(spoken(r).capitalize() for _ in range(5)),
        lambda r: "*-=_"[r.randrange(4)] * 40,
        lambda r: "".join(spoken(r) for _ in range(5)).capitalize(),
        lambda r: "".join(spoken(r) for _ in range(6)).upper(),
        lambda r: f"v{r.randrange(9)}-{r.randrange(99)}-{spoken(r)}{spoken(r)}{spoken(r)}",
        lambda r: "urn-" + uuid(r),
        lambda r: some(r, string.digits, 18),
        lambda r: uuid(r).upper(),
        lambda r: some(r, string.digits, 16),
        syllabic,
    ],
    ["the value is ", "use ", "login:", "https://example/?k=", "X-Auth: ", "(", ""],
    ["the value is ", "go to ", "ref:", "https://example/", "No. ", "(", ""],
    spoken,
    [" ", "\n", ")", "&", '"'],
)


def findings(n: int, seed: int, setting: Setting = TRAINING) -> tuple[list[list[bytes]], np.ndarray]:
    """Labelled findings, each as all its pieces: credentials in typical settings, and look-alikes that are none.

    A credential that ends a path is one whose last piece tells.
    """
    r = random.Random(seed)
    prose = lambda: " ".join(setting.word(r) for _ in range(r.randint(2, 6)))
    found, labels = [], []
    while len(labels) < n:
        y = r.random() < 0.5
        value = r.choice(setting.secret if y else setting.plain)(r)
        before = f"{prose()} {r.choice(setting.secret_lead if y else setting.plain_lead)}"
        path = "/".join(word(r) for _ in range(r.randint(2, 12))) + "/" if y and r.random() < 0.15 else ""
        if len(value) < LEAST_RUN:
            continue
        data = (before + path + value + r.choice(setting.end) + prose()).encode()
        read = pieces(len(before), len(before) + len(path + value))
        found.append([window(data, *p) for p in (read[-1:] if path else read)])
        labels.append(y)
    return found, np.array(labels, np.float32)


def best_of(scores: np.ndarray, found: list[list[bytes]]) -> np.ndarray:
    """Of each finding's pieces the highest score."""
    sizes = np.array([len(f) for f in found])
    return np.maximum.reduceat(scores, np.cumsum(sizes) - sizes)


@lru_cache(4)
def trained(n: int = 12000, seed: int = 7, recall: float = 0.96, epochs: int = 6) -> Network:
    """Train on ``n`` findings, calibrate on a third as many of the other generator, set the threshold for the recall."""
    rng = np.random.default_rng(seed)
    found, y = findings(n, seed)
    x = planes([f[k] for f, k in zip(found, rng.integers(0, [len(f) for f in found]))])
    size = 2 * len(SEGMENTS) * FILTERS
    w = {"kernel": rng.normal(0, 0.2, (KERNEL, CLASSES + 1, FILTERS)), "bias": np.zeros(FILTERS), "hidden": rng.normal(0, size**-0.5, (size, HIDDEN)), "hidden_bias": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out_bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, steps = 0, epochs * -(-n // 40)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 40):
            rows = order[at : at + 40]
            g = gradients(Network(**w, scale=1, shift=0, threshold=0), x[rows], y[rows])
            step += 1
            for k, v in g.items():
                a, b = m[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                w[k] -= 0.005 * (1 - step / (steps + 1)) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Network(**w, scale=1.0, shift=0.0, threshold=0.0)
    held, truth = findings(n // 3, seed + 1, CALIBRATION)
    z = best_of(logits(net, planes([w for f in held for w in f])), held)
    scale, shift = 1.0, 0.0
    for _ in range(200):  # Platt: a logistic fit of the held-out scores
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -60, 60)))
        scale -= 0.05 * float(((p - truth) * z).mean())
        shift -= 0.05 * float((p - truth).mean())
    return net._replace(scale=scale, shift=shift, threshold=threshold(scale * z + shift, truth > 0, recall))


def threshold(z: np.ndarray, truth: np.ndarray, recall: float) -> float:
    """Of the thresholds that keep the recall, those with the fewest false findings; halfway between their ends."""
    yes = np.sort(z[truth])
    high = yes[int(len(yes) * (1 - recall))]
    low = z[~truth & (z < high)].max(initial=-20.0)
    return float(1 / (1 + np.exp(-(high + low) / 2)))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    active = convolve(net, x)
    feats = pooled(active)
    raw = feats @ net.hidden + net.hidden_bias
    h = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -60, 60)))
    d = (p - y) / len(y)
    dh = np.outer(d, net.out) * (raw > 0)
    df = (dh @ net.hidden.T).reshape(len(y), len(SEGMENTS), 2, FILTERS)
    da = np.zeros_like(active)
    for k, (a, b) in enumerate(SEGMENTS):
        top = active[:, a:b].argmax(axis=1)[:, None]
        part = np.repeat(df[:, k, 1][:, None] / (b - a), b - a, axis=1)
        np.put_along_axis(part, top, np.take_along_axis(part, top, 1) + df[:, k, 0][:, None], 1)
        da[:, a:b] = part
    da *= active > 0
    classes, upper = CLASS[x], UPPER[x]
    kernel = np.zeros_like(net.kernel)
    pad = KERNEL // 2
    for k in range(KERNEL):
        a, b = max(0, pad - k), min(WIDTH, WIDTH + pad - k)
        src = slice(a + k - pad, b + k - pad)
        flat = da[:, a:b].reshape(-1, FILTERS)
        one_hot = np.zeros((len(flat), CLASSES + 1), np.float32)
        one_hot[np.arange(len(flat)), classes[:, src].ravel()] = 1
        one_hot[:, CLASSES] = upper[:, src].ravel()
        kernel[k] = one_hot.T @ flat
    return {"kernel": kernel, "bias": da.sum((0, 1)), "hidden": feats.T @ dh, "hidden_bias": dh.sum(0), "out": h.T @ d, "out_bias": np.array([d.sum()], np.float32)}


def runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that are ``least`` long."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: str, lowered: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The contract's spans as (start, end, kind)."""
    found = [(a, b, "hex") for a, b in hexes]
    if any(k in lowered for k in (b"passw", b"secret", b"token", b"api")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\0".join(raw), np.uint8)
    starts = np.cumsum([0] + [len(b) + 1 for b in raw])
    per: list[tuple[list, list]] = [([], []) for _ in texts]
    points = np.cumsum((joined & 0xC0) != 0x80, dtype=np.int64) if len(joined) else joined
    firsts = [int(points[s] - 1) if s < len(points) else 0 for s in starts]

    def place(a: int, b: int) -> tuple[int, int, int]:
        """The text that bytes a to b of the joined texts lie in, and their code points."""
        k = int(np.searchsorted(starts, a, side="right")) - 1
        return k, int(points[a]) - 1 - firsts[k], int(points[b - 1]) - firsts[k]

    for a, b in zip(*runs(HEX_BYTE[joined], LEAST["hex"])):
        k, x, y = place(a, b)
        per[k][0].append((x, y))
    base = [base_spans(t, r.translate(LOWER), p[0]) for t, r, p in zip(texts, raw, per)]
    a, b = runs(TOKEN_BYTE[joined], LEAST_RUN)
    spots, windows = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        k, s, e = place(x, y)
        for p, q in pieces(x - int(starts[k]), y - int(starts[k])):
            spots.append((k, s, e))
            windows.append(window(raw[k], p, q))
    known = {(k, s, e) for k, x in enumerate(base) for s, e, _ in x}
    for k, s, e in dict.fromkeys(spot for spot, p in zip(spots, probabilities(net, windows)) if p >= net.threshold):
        if (k, s, e) not in known:
            per[k][1].append((s, e, "cnn"))
    return [(x, sorted(x + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else x) for x, (_, more) in zip(base, per)]


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, recall: float = 0.96) -> DataFrame:
    """One row per document with its base spans' digest and all spans."""
    net = trained(recall=recall)

    def rows(ids, texts):
        found = scan(texts, net)
        counts = [[sum([s[2] == kind for s in base]) for base, _ in found] for kind in KINDS[:3]]
        return [ids, *counts, [hashlib.sha256(told(base).encode()).hexdigest() for base, _ in found], [told(spans) for _, spans in found]]

    return map_texts(docs, rows, SCHEMA)


def redact(docs: DataFrame, recall: float = 0.96, mark: str = "<secret>") -> DataFrame:
    """doc_id and the text with every span, overlapping ones joined, replaced by the mark."""
    net = trained(recall=recall)

    def rows(ids, texts):
        out = []
        for text, (_, spans) in zip(texts, scan(texts, net)):
            parts, at = [], 0
            for a, b, _ in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        return [ids, out]

    return map_texts(docs, rows, "doc_id long, text string")
