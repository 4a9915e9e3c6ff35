"""Personal data in text: strong patterns, and a character-level BiLSTM-CRF that adds what they miss.

The tagger is trained in NumPy from labelled spans: pattern spans of a bounded sample of the documents, together with
the same data respelled in forms that the patterns do not know. Texts are tagged in overlapping windows; where windows
overlap their emissions are blended by the distance to the window's edge, and one Viterbi pass over each connected
stretch decides globally. A window without a digit or an at-sign (or a spelled-out one) cannot hold a span, since every
kind is required to contain one; such windows are skipped, which changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from peakloom.llm.common import whole_text

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # start, kind, stop

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the patterns: they match the same and take time in proportion to the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<]at[\])}>]|(?<=\x20)at\x20(?=[A-Za-z0-9-]+\x20dot\x20)", re.IGNORECASE)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[Span]:
    """Spans of the strong patterns, leftmost and non-overlapping within a kind; failing matches are dropped."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1)
        if host and start < at:
            last = host.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a part of over 20 digits is no number worth converting
            if all(len(p) < 20 and int(p) <= 255 or not p.strip("0") for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


# --- the tagger ---------------------------------------------------------------------------------------------------

SYMBOLS, HIDDEN, TAGS = 100, 16, 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
FORBIDDEN = -1e4


def symbol_codes(text: str) -> np.ndarray:
    """Printable ASCII has its own symbol; line breaks, other letters and the rest share three."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 31, np.where(code == 10, 96, np.where(code >= 128, 97, 98)))


def _allowed() -> np.ndarray:
    """Transitions: an inner tag follows only the first or inner tag of its kind."""
    mask = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inner = 2 + 2 * k
        mask[:, inner] = FORBIDDEN
        mask[inner - 1, inner] = mask[inner, inner] = 0
    return mask


ALLOWED = _allowed()
START = np.array([0.0] + [0.0, FORBIDDEN] * len(KINDS))


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.3, (2, SYMBOLS, 4 * HIDDEN)), "inner": rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)),
        "bias": np.zeros((2, 4 * HIDDEN)), "out": rng.normal(0, 0.3, (2, HIDDEN, TAGS)), "out_bias": np.zeros(TAGS),
        "moves": np.zeros((TAGS, TAGS)),
    }
    p["bias"][:, HIDDEN : 2 * HIDDEN] = 1
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):  # noqa: ANN201
    """Both directions at once over windows (rows x steps): emissions, and what training needs."""
    rows, steps = x.shape
    both = np.stack([x, x[:, ::-1]])
    gates_in = p["embed"][np.arange(2)[:, None, None], both.transpose(0, 2, 1)] + p["bias"][:, None, None, :]
    h = np.zeros((2, rows, HIDDEN), np.float32)
    c = np.zeros_like(h)
    states = np.empty((steps, 2, rows, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        z = gates_in[:, t] + h @ p["inner"]
        s = _sigmoid(z[..., : 3 * HIDDEN])
        i, f, o, g = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], np.tanh(z[..., 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, i, f, o, g, tc))
        h = o * tc
        states[t] = h
    emissions = states[:, 0] @ p["out"][0] + states[::-1, 1] @ p["out"][1] + p["out_bias"]
    return emissions.transpose(1, 0, 2), both, states, saved


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the CRF per window, and its slopes by back-propagation through time."""
    rows, steps = x.shape
    e, both, states, saved = lstm(p, x, keep=True)
    e = e.astype(float)
    moves = p["moves"] + ALLOWED
    ahead, back = np.empty((steps, rows, TAGS)), np.zeros((steps, rows, TAGS))
    ahead[0] = START + e[:, 0]
    for t in range(1, steps):
        ahead[t] = e[:, t] + _log_sum(ahead[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(moves + (e[:, t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    one = np.eye(TAGS)
    d_e = np.exp(ahead + back - total[:, None]).transpose(1, 0, 2) - one[tags]
    pair = ahead[:-1, :, :, None] + moves + (e.transpose(1, 0, 2)[1:] + back[1:])[:, :, None, :] - total[:, None, None]
    d_moves = np.exp(pair).sum(axis=(0, 1))
    np.add.at(d_moves, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    at = np.arange(steps)
    gold = e[np.arange(rows)[:, None], at, tags].sum(1) + START[tags[:, 0]] + moves[tags[:, :-1], tags[:, 1:]].sum(1)
    d_e = (d_e / rows).astype(np.float32).transpose(1, 0, 2)
    by_state = np.stack([d_e @ p["out"][0].T, d_e[::-1] @ p["out"][1].T], axis=1)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"][0] = np.einsum("trh,trk->hk", states[:, 0], d_e)
    g["out"][1] = np.einsum("trh,trk->hk", states[::-1, 1], d_e)
    g["out_bias"], g["moves"] = d_e.sum(axis=(0, 1)), (d_moves / rows).astype(np.float32)
    d_gates = np.empty((steps, 2, rows, 4 * HIDDEN), np.float32)
    d_h, d_c = np.zeros((2, rows, HIDDEN), np.float32), np.zeros((2, rows, HIDDEN), np.float32)
    inner = p["inner"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, c_new, tc = saved[t]
        d_h = d_h + by_state[t]
        d_c = d_c + d_h * o * (1 - tc**2)
        z = d_gates[t]
        z[..., :HIDDEN] = d_c * c_new * i * (1 - i)
        z[..., HIDDEN : 2 * HIDDEN] = d_c * before * f * (1 - f)
        z[..., 2 * HIDDEN : 3 * HIDDEN] = d_h * tc * o * (1 - o)
        z[..., 3 * HIDDEN :] = d_c * i * (1 - c_new**2)
        g["inner"] += h.transpose(0, 2, 1) @ z
        d_c, d_h = d_c * f, z @ inner
    g["bias"] = d_gates.sum(axis=(0, 2))
    for d in range(2):
        np.add.at(g["embed"][d], both[d].T, d_gates[:, d])
    return float((total - gold).mean()), g


def train(windows: np.ndarray, tags: np.ndarray, steps: int = 500, batch: int = 64, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on random batches of labelled windows."""
    rng, p = np.random.default_rng(seed), initial()
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(windows), batch)
        _, g = gradients(p, windows[rows], tags[rows])
        scale = min(1.0, 5 / (1e-9 + float(np.sqrt(sum((x**2).sum() for x in g.values())))))
        for k in p:
            x = g[k] * scale
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            p[k] -= 0.02 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return p


def _email_forms(text: str) -> list[str]:
    user, _, host = text.partition("@")
    user, dotted, spelled = user.strip("."), host.replace(".", "[dot]"), host.replace(".", " dot ")
    return [
        f"{user}(at){host}", f"{user}[at]{host}", f"{user} (at) {host}", f"{user} [at] {host}", f"{user} at {spelled}", f"{user}[at]{dotted}",
        f"{user}(at){host.replace('.', '(dot)')}", f"{user} @ {host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user.replace('.', ' dot ')} at {spelled}",
        f"{user}{{at}}{host}", f"{user} AT {host.replace('.', ' DOT ')}", f"{user} <at> {host}",
    ]


def _ip_forms(text: str) -> list[str]:
    return [text.replace(".", sign) for sign in ("[.]", "(.)", " . ", "[dot]", " dot ", "{.}")]


def _card_forms(text: str) -> list[str]:
    digits = _digits(text)
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    other = [digits[:4], digits[4:10], digits[10:]] if len(digits) == 15 else fours
    return [sign.join(fours) for sign in (".", "_", "/", "  ")] + [sign.join(other) for sign in (".", "_", " - ", " . ")]


def _phone_forms(text: str) -> list[str]:
    digits = _digits(text)
    d, code = digits[-10:].rjust(10, "5"), digits[:-10].lstrip("0") or "1"
    return [
        f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{code} {d[:3]} {d[3:6]} {d[6:]}",
        f"0{d[:2]} {d[2:9]}", f"0{d[:3]} {d[3:6]} {d[6:]}", f"({code}) {d[:3]}-{d[3:6]}-{d[6:]}", f"{code}-{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d[:3]}-{d[3:]}",
        f"00{code}.{d[:3]}.{d[3:6]}.{d[6:]}", f"({d[:3]}){d[3:6]}-{d[6:]}", f"0{d[:3]}/{d[3:]}", f"{d[:3]} {d[3:6]} {d[6:]}",
    ]


#: The same data in forms that the patterns do not take, by kind.
FORMS = [_email_forms, _ip_forms, _card_forms, _phone_forms]


def _look_alike(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data: versions, dates, times, prices, keys, book numbers, series."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    year, month, day = f"20{number(2)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
    return [
        f"version {number(1)}.{number(1)}", f"{number(1)}.{number(2)}.{number(1)}", f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}",
        f"{year}-{month}-{day} {number(2)}:{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", number(int(rng.integers(1, 14))), f"{number(2)}:{number(2)}",
        "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)), f"CC BY {number(1)}.0", f"@{chr(97 + int(rng.integers(26)))}home",
        f"AKIA{number(12)}", f"{number(3)},{number(3)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"pp. {number(3)}-{number(3)}",
        f"{number(4)} {number(4)} {number(4)}", f"looked at {number(2)} dots", f"no. {number(6)}-{number(3)}", f"{number(1)}.{number(8)}",
        f"{number(4)}-{number(4)}-{number(4)}", f"met at noon", f"{number(2)} {number(2)} {number(2)} {number(2)}", f"{number(3)}.{number(3)}.{number(3)}",
    ][rng.integers(24)]


def _made_up(kind: int, rng: np.random.Generator) -> str:
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    if kind == 0:
        return f"{word()}.{number(2)}@{word()}.{['com', 'org', 'net', 'de'][rng.integers(4)]}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = number(15)
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{rng.integers(1, 99)} ({number(3)}) {number(3)}-{number(4)}"


def labelled_windows(
    texts: list[str], windows: int = 4000, seed: int = 7, left_out: frozenset[tuple[int, int]] = frozenset()
) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: spans of the sample as they stand or respelled, made-up ones in between, and windows of look-alikes
    without a span. ``left_out``: (kind, form) pairs that are not shown, to measure how the tagger does on unseen forms."""
    rng = np.random.default_rng(seed)
    spans = [(k, t[a:b]) for t in texts for a, k, b in pattern_spans(t)]
    plain = [t for t in texts if len(t) > 40] or ["the text around a number is made of words, as here and there in any other document"]
    x, y = np.zeros((windows, WINDOW), np.int64), np.zeros((windows, WINDOW), np.int64)
    for row in range(windows):
        text = plain[rng.integers(len(plain))]
        at = int(rng.integers(0, max(1, len(text) - WINDOW)))
        around = re.sub(r"[0-9@+]", "", text[at : at + 2 * WINDOW]).replace("\n", " ").ljust(2 * WINDOW, " ")
        cut = int(rng.integers(0, WINDOW - 10))
        choice = rng.random()
        kind = -1
        if choice < 0.65:
            kind, value = spans[rng.integers(len(spans))] if spans and rng.random() < 0.5 else (k := int(rng.integers(4)), _made_up(k, rng))
            if rng.random() < 0.7:
                shown = [f for n, f in enumerate(FORMS[kind](value)) if (kind, n) not in left_out]
                value = shown[rng.integers(len(shown))]
        elif choice < 0.95:
            value = _look_alike(rng)
        else:
            value = ""
        gap = " " if rng.random() < 0.9 else ""
        whole = f"{around[:cut].rstrip()}{gap}"
        start = len(whole)
        line = (whole + value + gap + around[cut:].lstrip())[:WINDOW].ljust(WINDOW)
        x[row] = symbol_codes(line)
        if kind >= 0:
            stop = min(start + len(value), WINDOW)
            y[row, start:stop] = 2 + 2 * kind
            if start < WINDOW:
                y[row, start] = 1 + 2 * kind
    return x, y


def decode(p: dict[str, np.ndarray], stretches: list[np.ndarray]) -> list[np.ndarray]:
    """Best tag sequences of emission stretches of any length; stretches of similar length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
    sizes: dict[int, list[int]] = {}
    for n, e in enumerate(stretches):
        sizes.setdefault(len(e).bit_length(), []).append(n)
    moves = p["moves"] + ALLOWED
    for group in sizes.values():
        steps = max(len(stretches[n]) for n in group)
        e = np.zeros((len(group), steps, TAGS))
        for r, n in enumerate(group):
            e[r, : len(stretches[n])] = stretches[n]
        live = np.array([len(stretches[n]) for n in group])
        score = START + e[:, 0]
        came = np.zeros((steps, len(group), TAGS), np.int8)
        for t in range(1, steps):
            paths = score[:, :, None] + moves
            best = paths.argmax(axis=1)
            came[t] = np.where((t < live)[:, None], best, np.arange(TAGS))
            score = np.where((t < live)[:, None], np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + e[:, t], score)
        tag = score.argmax(axis=1)
        path = np.zeros((steps, len(group)), np.int64)
        for t in range(steps - 1, -1, -1):
            path[t] = tag
            tag = came[t][np.arange(len(group)), tag]
        for r, n in enumerate(group):
            out[n] = path[: live[r], r]
    return out


_EDGE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
# What a span of a kind must be, in whatever form: an address has its two marks, numbers the digits of their kind.
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]+(?:\x20dot\x20[A-Za-z0-9]+)*\x20?(?:@|[\[({<]at[\])}>]|(?<=\x20)at(?=\x20))\x20?"
    r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
_QUAD = re.compile(r"([0-9]{1,3})(\x20?(?:[\[({](?:\.|dot)[\])}]|\.|dot)\x20?)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_GROUPS = re.compile(r"[0-9]+(?:[\x20._/-]{1,3}[0-9]+)+")
_CALL = re.compile(r"(?:\([0-9]{1,4}\)|[0-9]{1,5})(?:[\x20./-]{0,2}(?:\([0-9]{1,4}\)|[0-9]+))+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}.*|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}.*|97[89][-\x20].*")


def _valid(kind: int, text: str, start: int, stop: int) -> bool:
    """Whether a tagged span can be of its kind and ends where its token does; among look-alikes the tagger decides."""
    value = text[start:stop]
    before, after = text[max(start - 2, 0) : start], text[stop : stop + 2]
    if before[-1:].isalnum() or before.endswith("+") or after[:1].isalnum():
        return False
    # a number that goes on behind a sign is longer than the span
    if kind and (re.fullmatch(r"[0-9][-./_]", before) or re.fullmatch(r"[-./_][0-9]", after)):
        return False
    if kind == 0:
        return _ADDRESS.fullmatch(value) is not None
    if kind == 1:
        quad = _QUAD.fullmatch(value)
        return quad is not None and quad.group(2) != "." and all(int(quad.group(n)) <= 255 for n in (1, 3, 4, 5))
    digits = _digits(value)
    if kind == 2:
        return 14 <= len(digits) <= 19 and _GROUPS.fullmatch(value) is not None and luhn(digits)
    groups = re.findall(r"[0-9]+", value)
    # without a trunk or country zero or an area in brackets, groups as in numbers of ten digits
    dialled = value[0] in "0(" or (len(digits) - 10 in range(4) and [len(g) for g in groups][-3:] == [3, 3, 4])
    return 9 <= len(digits) <= 15 and len(groups) > 1 and dialled and _CALL.fullmatch(value) is not None and _DATE.fullmatch(value) is None


_FORM = [_ADDRESS, _QUAD, _GROUPS, _CALL]
#: Characters on both sides of a tagged stretch in which its token may begin and end.
REACH = 48


def _token(kind: int, text: str, start: int, stop: int) -> tuple[int, int] | None:
    """The token of the kind's form that a tagged stretch marks by half or more: the tagger says where and what, the form
    where it begins and ends."""
    low = max(start - REACH, 0)
    for m in _FORM[kind].finditer(text, low, min(stop + REACH, len(text))):
        a, b = m.span()
        if 2 * (min(b, stop) - max(a, start)) >= b - a and _valid(kind, text, a, b):
            return a, b
    return None


def tagged_spans(p: dict[str, np.ndarray], texts: list[str]) -> list[list[Span]]:
    """Spans that the tagger finds in each text."""
    chosen, owners, codes = [], [], []
    for n, text in enumerate(texts):
        places = sorted({k for m in _TRIGGER.finditer(text) for k in ((m.start() // STRIDE) - 1, m.start() // STRIDE) if k >= 0})
        if places:
            code = np.concatenate([symbol_codes(text), np.zeros(WINDOW, np.int64)])
            for k in places:
                chosen.append((n, k * STRIDE))
                owners.append(n)
                codes.append(code[k * STRIDE : k * STRIDE + WINDOW])
    found: list[list[Span]] = [[] for _ in texts]
    if not chosen:
        return found
    emissions = np.concatenate([lstm(p, np.stack(codes[a : a + 1024]))[0] for a in range(0, len(codes), 1024)])
    stretches, places, w = [], [], 0
    while w < len(chosen):
        n, start = chosen[w]
        last = w
        while last + 1 < len(chosen) and chosen[last + 1][0] == n and chosen[last + 1][1] < chosen[last][1] + WINDOW:
            last += 1
        size = chosen[last][1] + WINDOW - start
        total, weight = np.zeros((size, TAGS)), np.zeros(size)
        for i in range(w, last + 1):
            a = chosen[i][1] - start
            total[a : a + WINDOW] += emissions[i] * _EDGE[:, None]
            weight[a : a + WINDOW] += _EDGE
        inside = min(size, len(texts[n]) - start)
        stretches.append((total / weight[:, None])[:inside])
        places.append((n, start))
        w = last + 1
    for (n, start), tags in zip(places, decode(p, stretches)):
        first = np.flatnonzero(tags % 2 == 1)
        for a in first.tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            kind = int(tags[a]) // 2
            token = _token(kind, texts[n], start + a, start + b)
            if token and not any(token[0] < s[2] and s[0] < token[1] for s in found[n]):
                found[n].append((token[0], kind, token[1]))
    return found


#: Pieces that a text gives to the training, and their length.
MOST_PIECES, PIECE = 8, 4 * WINDOW


def _training_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few pieces of each text around its pattern spans, evenly chosen, or its beginning."""
    for batch in batches:
        hashes, out = [], []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
            spans = pattern_spans(text)
            picked = spans[:: -(-len(spans) // MOST_PIECES)] if spans else [(PIECE // 2, 0, 0)]
            for start, _, _ in picked:
                hashes.append(h)
                out.append(text[max(start - PIECE // 2, 0) : start + PIECE // 2])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.string())], ["h", "piece"])


def find(df: DataFrame, max_texts: int = 400, steps: int = 500) -> DataFrame:
    """One row per input row: doc_id, base and spans, arrays of (start, kind, stop) sorted by start and kind.

    ``base`` are the spans of the patterns, ``spans`` all of them; a tagged span that overlaps a pattern's is dropped.
    Positions are code points, ends exclusive. The tagger is trained on at most ``max_texts`` texts with a digit or an
    at-sign, chosen by hash, in ``steps`` batches. Null text counts as empty and has no spans. Equal texts get equal results; an empty table
    gives no rows; other columns are ignored.
    """
    rows = df.select("doc_id", whole_text().alias("text"))
    hashed = rows.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    # numbers are ordered, not texts; then each chosen text comes once, however many copies it has
    chosen = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(max_texts).collect()]
    few = hashed.filter(F.col("h") <= max(chosen)) if chosen else hashed.limit(0)
    # a text gives a bounded number of short pieces, however long it is
    pieces = few.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(_training_pieces, "h long, piece string")
    texts = [r.piece for r in pieces.orderBy("h", "piece").collect()]
    shared = df.sparkSession.sparkContext.broadcast(train(*labelled_windows(texts), steps=steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                base = [pattern_spans(t) for t in texts]
                every = []
                for own, more in zip(base, tagged_spans(p, texts)):
                    clear = [s for s in more if all(s[2] <= b[0] or b[2] <= s[0] for b in own)] if own else more
                    every.append(sorted(own + clear))
                lists = [
                    pa.array([[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in spans] for spans in side], pa.list_(item))
                    for side in (base, every)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "base", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("stop", T.LongType())]))
    shape = T.StructType([df.schema["doc_id"], T.StructField("base", spans), T.StructField("spans", spans)])
    return rows.mapInArrow(run, shape)
