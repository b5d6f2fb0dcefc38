"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions trained in numpy.

* **Rules** find e-mail, address (ip), card and phone spans, leftmost and not overlapping within a kind. They are written so that long runs
  of digits or name characters cost linear time; the tests hold them against the plain patterns.
* **Training.** Windows around digits and @ signs, labelled with the rules' spans, at most ``WINDOWS`` of them, chosen by a hash of the
  window; equal windows count once. A quarter of the labelled spans is written in another way first (a space or a bracketed "at" for the @, a
  missing plus sign, dots or spaces between digits), so that the network learns more than the rules. Character classes go through a
  bidirectional LSTM; emissions and learned transitions form a CRF over O and B/I of the four kinds, trained by its exact likelihood.
* **Decoding.** Every digit, @ and bracketed or spelled "at" of a text lies in windows of ``WIDTH`` that overlap by half; text without any
  holds none of the four kinds. The first window of a stretch begins before the word in front of it, however long, the last one ends behind the word
  after it. Each window is decoded by Viterbi; a span cut off by a window's edge is in the window beside it, or, if it is longer than what they
  share, is joined from its parts.
* **Reconciliation.** Over the whole text the spans of all windows compete: the set without overlaps that has the largest total score is
  taken, by one pass over all ends. Rule spans stay as they are; a decoded span is added where it overlaps none and has what its kind
  needs (Luhn digits of a card, four numbers of an address, ...).

Defined results: a null text counts as empty and has no spans; offsets count code points, ends are exclusive; every row gives one row, an empty
table none; without any labelled window only rules apply; other columns do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from assay.llm.common import bounded_batches, documents, map_texts, register, small_batches, whole

KINDS = ("email", "ip", "card", "phone")
WIDTH, MARGIN = 96, 24
WINDOWS = 2_400
HIDDEN = 16
EPOCHS = 6
SEED = 11
FIGURES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"[(\[]\s?at\s?[)\]]|\bat\b(?=[^\n]{1,40}\bdot\b)", re.IGNORECASE)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            out.append((0, start, found.end()))
            last = found.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- windows ---------------------------------------------------------------------------------------------------------

CLASSES = 21
CLASS_OF = np.full(128, 19, np.uint8)
CLASS_OF[list(range(97, 123))], CLASS_OF[list(range(65, 91))], CLASS_OF[list(range(48, 58))] = 1, 2, 3
for _i, _c in enumerate("@.-_+() "):
    CLASS_OF[ord(_c)] = 4 + _i
CLASS_OF[[9, 10, 11, 12, 13]] = 12
for _i, _c in enumerate("%:/,"):
    CLASS_OF[ord(_c)] = 13 + _i
CLASS_OF[[34, 39]], CLASS_OF[61] = 17, 18


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, CLASS_OF[np.minimum(points, 127)], 20).astype(np.uint8)


def word_before(text: str, at: int, least: int) -> int:
    """Where the word before a place begins, but not before ``least``; a space between them does not part them."""
    i = at - 1 if at > least and text[at - 1] == " " else at
    while i > least and text[i - 1] in LOCAL:
        i -= 1
    return i


def word_after(text: str, at: int, most: int) -> int:
    """Where the word after the sign at a place ends."""
    i = at + 1
    while i < most and text[i] in ")] ":
        i += 1
    while i < most and text[i] in LOCAL:
        i += 1
    return i


def window_starts(text: str, classes: np.ndarray) -> list[int]:
    """Starts of the windows: they cover every digit, @ and spelled "at" with a margin and the words beside them, and overlap by half."""
    seeds = np.flatnonzero((classes == 3) | (classes == 4))
    low = text.lower()
    if "at" in low and ("(" in text or "[" in text or "dot" in low):
        seeds = np.unique(np.r_[seeds, [x for m in SPELLED.finditer(text) for x in (m.start(), m.end() - 1)]]).astype(np.int64)
    if not len(seeds):
        return []
    cuts = np.flatnonzero(np.diff(seeds) > 2 * MARGIN)
    starts, end = [], 0
    for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(seeds) - 1]):
        first, last = int(seeds[a]), int(seeds[b])
        before = int(seeds[b + 1]) if b + 1 < len(seeds) else len(classes)
        low = max(0, min(first - MARGIN, word_before(text, first, end) - 4))
        high = min(len(classes), max(last + MARGIN, word_after(text, last, before) + 3) + 1)
        starts += list(range(low, max(low + 1, high - WIDTH // 2), WIDTH // 2))
        end = last + 1
    return starts


def windows_of(classes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.r_[classes, np.zeros(WIDTH, np.uint8)]
    return padded[np.array(starts, dtype=np.int64)[:, None] + np.arange(WIDTH)] if starts else np.zeros((0, WIDTH), np.uint8)


def rewritten(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """A quarter of the spans written in another way, chosen by a hash; offsets follow."""
    out, moved, end = [], [], 0
    taken: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[1], -s[2])):  # of overlapping spans the first labels the text
        if not taken or span[1] >= taken[-1][2]:
            taken.append(span)
    size = 0
    for kind, a, b in taken:
        value = text[a:b]
        choice = xxhash.xxh32_intdigest(value.encode()) % 16
        if choice < 4:
            if kind == 0:
                at, dot = ("AT", "DOT") if xxhash.xxh32_intdigest(value.encode(), 1) % 4 == 0 else ("at", "dot")
                value = value.replace("@", (" @ ", f" ({at}) ", f"[{at}]", f" {at} ")[choice])
                value = value.replace(".", f" {dot} ") if choice == 3 else value
            elif kind == 1:
                value = value.replace(".", ("[.]", " . ", "[.]", " . ")[choice])
            elif kind == 2:
                digits = digits_of(value)
                value = (".", " ", "-", "  ")[choice].join(digits[i:i + 4] for i in range(0, len(digits), 4))
            else:
                value = value.lstrip("+") if choice < 2 else value.replace("+", "00", 1)
        out.append(text[end:a])
        size += a - end
        moved.append((kind, size, size + len(value)))
        out.append(value)
        size += len(value)
        end = b
    return "".join(out) + text[end:], moved


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length + WIDTH, np.uint8)
    for kind, a, b in spans:
        tags[a], tags[a + 1:b] = 1 + 2 * kind, 2 + 2 * kind
    return tags


# --- network ---------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)
FORBIDDEN = np.zeros((TAGS + 1, TAGS), np.float32)  # the last row: the window's start; a window may begin inside a span
for _k in range(len(KINDS)):
    FORBIDDEN[[i for i in range(TAGS) if i not in (1 + 2 * _k, 2 + 2 * _k)], 2 + 2 * _k] = -1e4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(x: np.ndarray, p: dict, side: str, keep: bool):
    """Hidden states (time, batch, hidden) of class windows (time, batch), and what the backward pass needs."""
    steps, batch = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    w, u = p[side + "w"], p[side + "u"]
    states, saved = np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        z = w[x[t]] + h @ u
        gates = sigmoid(z[:, :3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
        if keep:
            saved.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        states[t] = h
    return states, saved


def lstm_back(x: np.ndarray, grad: np.ndarray, p: dict, side: str, saved: list) -> dict:
    w_grad, u_grad = np.zeros_like(p[side + "w"]), np.zeros_like(p[side + "u"])
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g = saved[t]
        tc = np.tanh(f * c + i * g)
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(w_grad, x[t], dz)
        u_grad += h.T @ dz
        dh, dc = dz @ p[side + "u"].T, dc * f
    return {side + "w": w_grad, side + "u": u_grad}


def emissions(x: np.ndarray, p: dict, keep: bool = False):
    """Emissions (time, batch, tags) of windows (batch, time)."""
    forward = np.ascontiguousarray(x.T)
    a, saved_a = lstm(forward, p, "f", keep)
    b, saved_b = lstm(forward[::-1], p, "b", keep)
    both = np.concatenate([a, b[::-1]], axis=2)
    return both @ p["v"] + p["d"], (forward, both, saved_a, saved_b)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def step_gradients(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict]:
    """Negative log likelihood of a batch of labelled windows, and its gradients."""
    e, (forward, both, saved_a, saved_b) = emissions(x, p, True)
    steps, batch = y.shape[1], len(y)
    move, start = p["t"][:TAGS], p["t"][TAGS]
    alpha = np.empty_like(e)
    alpha[0] = start + e[0]
    for t in range(1, steps):
        alpha[t] = log_sum(alpha[t - 1][:, :, None] + move, 1) + e[t]
    beta = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = log_sum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - total[None, :, None])
    rows = np.arange(batch)
    t_grad = np.zeros_like(p["t"])
    gold = start[y[:, 0]].sum() + e[0][rows, y[:, 0]].sum()
    t_grad[TAGS] = marginal[0].sum(0)
    np.add.at(t_grad[TAGS], y[:, 0], -1)
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None])
        t_grad[:TAGS] += pair.sum(0)
        np.add.at(t_grad, (y[:, t - 1], y[:, t]), -1)
        gold += move[y[:, t - 1], y[:, t]].sum() + e[t][rows, y[:, t]].sum()
    d_e = marginal
    d_e[np.arange(steps)[:, None], rows[None, :], y.T] -= 1
    grads = {"v": np.einsum("tbh,tbk->hk", both, d_e), "d": d_e.sum((0, 1)), "t": t_grad}
    d_both = d_e @ p["v"].T
    grads |= lstm_back(forward, d_both[:, :, :HIDDEN], p, "f", saved_a)
    grads |= lstm_back(forward[::-1], d_both[::-1, :, HIDDEN:], p, "b", saved_b)
    return float(total.sum() - gold) / batch, {k: g / batch for k, g in grads.items()}


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02) -> dict:
    """Parameters fitted by Adam; the same for the same windows in the same order."""
    rng = np.random.default_rng(SEED)
    p = {s + "w": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)) for s in "fb"} | {s + "u": rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)) for s in "fb"}
    p |= {"v": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "d": np.zeros(TAGS), "t": np.zeros((TAGS + 1, TAGS))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    for s in "fb":
        p[s + "w"][:, HIDDEN:2 * HIDDEN] += 1  # remember at first
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    n, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            take = order[i:i + batch]
            _, grads = step_gradients(x[take], y[take].astype(np.int64), p)
            n += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (1 - n / (total + 1)) * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v[k] / (1 - 0.99 ** n)) + 1e-8)).astype(np.float32)
    return p


def viterbi(e: np.ndarray, p: dict) -> np.ndarray:
    """Best tags (batch, time) under emissions (time, batch, tags) and the transitions that tags allow."""
    move, start = p["t"][:TAGS] + FORBIDDEN[:TAGS], p["t"][TAGS]
    steps, batch, _ = e.shape
    back = np.empty((steps, batch, TAGS), np.uint8)
    best = start + e[0]
    for t in range(1, steps):
        reach = best[:, :, None] + move
        back[t] = reach.argmax(1)
        best = reach.max(1) + e[t]
    tags = np.empty((batch, steps), np.uint8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, np.arange(batch), tags[:, t]]
    return tags


@dataclass(frozen=True)
class Scored:
    kind: int
    start: int
    end: int
    score: float


def window_spans(tags: np.ndarray, e: np.ndarray, start: int, length: int, before: Scored | None = None) -> tuple[list[Scored], Scored | None]:
    """Spans of one decoded window of a text of ``length``, and the one that its end cuts off.

    What the window's start cuts off goes on from ``before``, the cut span of the window that begins half a width earlier, or is left to that window.
    """
    out, rest, t = [], None, 0
    while t < WIDTH:
        tag = int(tags[t])
        if not tag:
            t += 1
            continue
        kind, end = (tag - 1) // 2, t + 1
        while end < WIDTH and tags[end] == 2 + 2 * kind:
            end += 1
        steps = np.arange(t, end)
        score = float((e[steps, tags[t:end]] - e[steps, 0]).sum())
        begin = start + t
        if t == 0 and start > 0:
            known = before is not None and before.kind == kind and before.start < start < before.end
            begin, score = (before.start, before.score + score) if known else (-1, score)
        elif tag % 2 == 0:
            begin = -1
        if begin >= 0 and start + end <= length:
            if end == WIDTH and start + WIDTH < length:
                rest = Scored(kind, begin, start + end, score)
            else:
                out.append(Scored(kind, begin, start + end, score))
        t = end
    return out, rest


def reconciled(spans: list[Scored]) -> list[Scored]:
    """Of all windows' spans the set without overlaps that has the largest total score."""
    best: dict[tuple[int, int, int], Scored] = {}
    for s in spans:
        key = (s.kind, s.start, s.end)
        if s.score > 0 and (key not in best or s.score > best[key].score):
            best[key] = s
    order = sorted(best.values(), key=lambda s: (s.end, s.start, s.kind))
    ends = [s.end for s in order]
    total, chosen = [0.0], [None]
    for i, s in enumerate(order):
        j = bisect.bisect_right(ends, s.start, 0, i)
        take = total[j] + s.score
        total.append(max(take, total[-1]))
        chosen.append((j, s) if take > total[-2] else None)
    out, i = [], len(order)
    while i:
        if chosen[i] is None:
            i -= 1
        else:
            i, s = chosen[i]
            out.append(s)
    return out[::-1]


def plausible(kind: int, value: str) -> bool:
    """Whether a decoded span has what its kind needs."""
    digits = digits_of(value)
    if kind == 0:
        return re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[]\s?at\s?[)\]]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|\sdot\s)\s?[A-Za-z0-9-]+)+", value, re.IGNORECASE) is not None
    if kind == 1:
        numbers = re.findall("[0-9]+", value)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers) and re.fullmatch(r"[0-9.\[\]\s]+", value) is not None
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9 .-]+[0-9]", value) is not None
    return 10 <= len(digits) <= 15 and re.fullmatch(r"(?:00)?[0-9][0-9().\s-]+[0-9]", value) is not None and re.search(r"[0-9][().\s-]+[0-9]", value) is not None


def decoded(texts: list[str], p: dict, chunk: int = 1024) -> list[list[Scored]]:
    """Reconciled spans of every text."""
    places, blocks, lengths = [], [], []
    for i, text in enumerate(texts):
        classes = classes_of(text)
        starts = window_starts(text, classes)
        places += [(i, s) for s in starts]
        blocks.append(windows_of(classes, starts))
        lengths.append(len(classes))
    found: list[list[Scored]] = [[] for _ in texts]
    windows = np.concatenate(blocks) if blocks else np.zeros((0, WIDTH), np.uint8)
    last: tuple[int, int, Scored | None] = (-1, 0, None)
    for a in range(0, len(windows), chunk):
        e, _ = emissions(windows[a:a + chunk], p)
        tags = viterbi(e, p)
        for k in np.flatnonzero(tags.any(1)):
            i, start = places[a + k]
            whole_spans, cut = window_spans(tags[k], e[:, k], start, lengths[i], last[2] if last[:2] == (i, start - WIDTH // 2) else None)
            found[i] += whole_spans
            last = (i, start, cut)
    return [reconciled(spans) for spans in found]


def may_hold(text: bytes) -> bool:
    """Whether a text has a digit, an @ or a spelled "at": else it holds none of the kinds."""
    text = text.lower()
    return any(mark in text for mark in (b"@", b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9", b"(at", b"[at", b"( at", b"[ at", b" dot "))


def figures(texts: list[bytes], p: dict | None) -> list[list]:
    """The columns of ``FIGURES``."""
    rows: list = [None] * len(texts)
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0)
    wanted = [i for i, t in enumerate(texts) if may_hold(t)]
    plain = {i: texts[i].decode("utf-8", "replace") for i in wanted}
    more = dict(zip(wanted, decoded([plain[i] for i in wanted], p))) if p is not None else {}
    for i in range(len(texts)):
        if i not in plain:
            rows[i] = nothing
            continue
        base = rule_spans(plain[i])
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        added = []
        for s in more.get(i, []):
            before = bisect.bisect_left(starts, s.end)
            if (not before or reach[before - 1] <= s.start) and plausible(s.kind, plain[i][s.start:s.end]):
                added.append((s.kind, s.start, s.end))
        counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
        written = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)) for spans in (base, base + added)]
        rows[i] = (*counts, hashlib.sha256(written[0].encode()).hexdigest(), written[1], len(added), len(base) + len(added))
    return [list(column) for column in zip(*rows)]


def labelled_windows(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Training windows and their tags: at most ``WINDOWS``, the smallest by a hash of the window, equal ones once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t", 4_000_000):
            rows = []
            for data in batch.column("t").to_pylist():
                text, spans = rewritten(plain := data.decode("utf-8", "replace"), rule_spans(plain))
                classes = classes_of(text)
                tags = tags_of(len(classes), spans)
                starts = window_starts(text, classes)
                for start, window in zip(starts, windows_of(classes, starts)):
                    own = tags[start:start + WIDTH]
                    # Windows without a span are many; one in four teaches what is none.
                    mark = xxhash.xxh3_64_intdigest(window.tobytes()) >> 1
                    if own.any() or mark % 4 == 0:
                        rows.append((mark, window.tobytes(), own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                                             names=["mark", "x", "y"])

    text = whole(F.col(text_col).cast("string"))
    source = docs.select(text.alias("s")).where(F.col("s").rlike("[0-9@]")).select(F.col("s").cast("binary").alias("t"))
    bounded_batches(docs.sparkSession)
    rows = source.mapInArrow(make, "mark long, x binary, y binary").groupBy("mark").agg(F.min(F.struct("x", "y")).alias("w")).orderBy("mark").limit(WINDOWS).select("w.x", "w.y").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(-1, WIDTH)
    return x, np.frombuffer(b"".join(bytes(r.y) for r in rows), np.uint8).reshape(-1, WIDTH)


def personal_data(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Train on the documents' own labelled windows, then columns ``keep`` and the figures of every document."""
    x, y = labelled_windows(docs, text_col)
    p = train(x, y) if len(x) else None
    return map_texts(docs, keep, FIGURES, lambda texts: figures(texts, p), text_col)


@register("op4_personal_data")
def op4_personal_data(spark: SparkSession, root: str) -> DataFrame:
    return personal_data(documents(spark, root), ["doc_id"])
