"""Personal data in texts: plain rules, and a linear-chain conditional random field over word shapes that adds what they miss.

Rules find emails, IP addresses, cards and phones by fixed patterns, leftmost and without overlap within a kind; a match
that fails its check is dropped and isn't tried again. So a card behind an address ("10.0.0.1 4111111111111111") or
a phone before a card is lost to them, as is a phone without + or an email of letters beyond ASCII.

The field labels tokens - runs of letters, runs of digits, single other characters - as beginning or
inside of a kind, or outside. Its features are the shapes of a token and its neighbours (case, lengths, characters, white
space), short words beside it, and counts over the run of numbers and the chunk that it stands in. It is trained by gradient
steps on the likelihood of a small labelled table (`labelled_table`, made by a rule; any table of text and spans will do, of
MAX_LABELLED rows at most), and decoded by Viterbi for all windows of a batch side by side. Windows reach CONTEXT characters
around each digit and @, as every kind holds one of them. A span of the field is added where it
passes the kind's check and overlaps no other span; spans of the rules always stay.

Every step over a text takes time and memory in proportion to it, also for one long word or number.

Defined results: null is the empty text; a text without digit or @ has no span; offsets are code points. Ids may be
null or repeated, each row is judged by itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship
from .words import U, mix, text_parts

KINDS = ("email", "ip", "card", "phone")
MAX_LABELLED, STEPS, CONTEXT, PART = 5000, 60, 48, 1 << 20
#: O, then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)

# Fixed patterns of the task, anchored where a longer match can't begin earlier.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HIT = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_EMAIL_LIKE = re.compile(r"[\w.%+-]+ ?@ ?[\w-]+(?:\.[\w-]+)+")
_IP_LIKE = re.compile(r"[0-9]+(?: ?\. ?[0-9]+){3}")
_CARD_LIKE = re.compile(r"[0-9](?:[ .-]?[0-9])+")
_PHONE_LIKE = re.compile(r"[+(]{0,2}[0-9][ ()./0-9-]*[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(text: str) -> bool:
    return all(len(p := part.strip().lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def _card_fits(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_fits(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """From each @ to both sides: the time doesn't grow with the square of a word."""
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield "email", begin, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind and start."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _card_fits(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if _phone_fits(m[0])]
    return out


# Tokens and features.


class Tokens(NamedTuple):
    """Tokens of several windows one after another; offsets has each window's first token, and the number of tokens."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    run: np.ndarray
    chunk: np.ndarray
    offsets: np.ndarray


_SHAPES: dict[str, int] = {}


def _code(name: str) -> int:
    """The number of a shape; a process holds a few thousand of them."""
    got = _SHAPES.get(name)
    if got is None:
        got = crc32(name.encode())
        if len(_SHAPES) < 1 << 16:
            _SHAPES[name] = got
    return got


def _shape(token: str, gap: str) -> str:
    if "0" <= token[0] <= "9":
        small = "s" if len(token) <= 3 and int(token) <= 255 else ""
        return f"{gap}9{min(len(token), 20)}{small}"
    if token[0].isalpha():
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
        return f"{gap}{case}{len(token) if len(token) < 4 else 4 if len(token) < 8 else 8}"
    return f"{gap}{token}"


def tokens_of(windows: list[str]) -> Tokens:
    start, end, shape, word, runs, chunks, offsets = [], [], [], [], [], [], [0]
    for text in windows:
        last, run, chunk = 0, [], []
        first = len(start)
        for m in _TOKEN.finditer(text):
            token, (a, b) = m[0], m.span()
            gap = "" if a == last and a else "n" if "\n" in text[last:a] else "_"
            number = "0" <= token[0] <= "9"
            if gap or not chunk:
                chunk = [0, 0, 0]
            if not (number or token in "+-()./") or a - last > 1 or gap == "n" or not run:
                run = [0]
            if number:
                run[0] += len(token)
                chunk[0] += len(token)
            chunk[1] += token == "@"
            chunk[2] += token == "."
            start.append(a)
            end.append(b)
            shape.append(_code(_shape(token, gap)))
            word.append(_code("w" + token.lower()) if b - a <= 10 and not number else 0)
            runs.append(run)
            chunks.append(chunk)
            last = b
        offsets.append(offsets[-1] + len(start) - first)
    run = np.array([min(r[0], 20) for r in runs], np.uint64)
    chunk = np.array([min(c[0], 20) + 32 * min(c[1], 2) + 128 * min(c[2], 5) for c in chunks], np.uint64)
    return Tokens(*(np.array(x, np.int64) for x in (start, end)), *(np.array(x, np.uint64) for x in (shape, word)), run, chunk, np.array(offsets))


#: Which of shape (s), word (w), run (r) and chunk (c) at which places beside a token make a feature.
TEMPLATES = (
    "s0", "s-1", "s1", "s-2", "s2", "s-1 s0", "s0 s1", "s-1 s0 s1", "s-2 s-1 s0", "s0 s1 s2", "s-2 s-1 s0 s1 s2", "w0", "w-1", "w1", "w-2", "w-3",
    "r0", "r0 s0", "c0", "c0 s0", "r0 c0 s-1", "s-4 s-3 s-2 s-1 s0", "s0 s1 s2 s3 s4",
)


def features(t: Tokens) -> np.ndarray:
    """A key of 64 bits for each token and template. Beyond a window's ends all is 0."""
    n = len(t.start)
    window = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
    columns = {"s": t.shape, "w": t.word, "r": t.run, "c": t.chunk}
    out = np.empty((n, len(TEMPLATES)), U)
    for k, template in enumerate(TEMPLATES):
        key = np.full(n, k + 1, U)
        for part in template.split():
            by, values = int(part[1:]), columns[part[0]] + U(1)
            at = np.arange(n) + by
            inside = (at >= 0) & (at < n)
            at[~inside] = 0
            inside &= window[at] == window if n else inside
            key = mix(key * U(0x9E3779B97F4A7C15) + np.where(inside, values[at], U(0)))
        out[:, k] = key
    return out


class Model(NamedTuple):
    """Sorted feature keys, their weights by label (the last row, of zeros, is for all others), and weights of pairs of labels."""

    keys: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def rows(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(keys.shape, np.int64)

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), LABELS))
        for column in self.rows(features(t)).T:
            out += self.weights[column]
        return out


def allowed() -> np.ndarray:
    """0 where a label may follow another, minus a large number where inside follows neither beginning nor inside of its kind."""
    out = np.zeros((LABELS + 1, LABELS))  # the last row: before the first token
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


def _steps(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows from the longest to the shortest, their first tokens, and how many are longer than t."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    active = np.searchsorted(-length[order], -np.arange(longest), "left")
    return order, offsets[:-1][order], active


def viterbi(scores: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The best labels of all tokens: step t goes over the t-th token of all windows that have one."""
    _, first, active = _steps(offsets)
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    back = np.zeros((len(scores), LABELS), np.int8)
    best = np.zeros((len(first), LABELS))
    for t, m in enumerate(active):
        at = first[:m] + t
        if t == 0:
            best[:m] = model.first + scores[at]
            continue
        paths = best[:m, :, None] + model.pairs
        back[at] = paths.argmax(axis=1)
        best[:m] = np.take_along_axis(paths, back[at].astype(np.int64)[:, None], 1)[:, 0] + scores[at]
    state = best.argmax(axis=1).astype(np.int8)  # of the windows that end at t, unchanged since
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        labels[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return labels


def train(texts: list[str], spans: list[list[Span]], steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-3) -> Model:
    """Adaptive gradient steps on the mean log-likelihood of the labels."""
    t = tokens_of(texts)
    want = np.zeros(len(t.start), np.int64)
    for w, found in enumerate(spans):
        a, b = t.offsets[w : w + 2]
        for kind, begin, end in found:
            inside = a + np.flatnonzero((t.start[a:b] >= begin) & (t.end[a:b] <= end))
            want[inside] = 2 + 2 * KINDS.index(kind)
            want[inside[:1]] -= 1
    bar = allowed()
    if not len(want):
        return Model(np.zeros(0, U), np.zeros((1, LABELS)), bar[:-1], bar[-1])
    key, count = np.unique(features(t), return_counts=True)
    key = key[count > 1]
    model = Model(key, np.zeros((len(key) + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    at = model.rows(features(t))
    _, first, active = _steps(t.offsets)
    begins = np.zeros(len(want), bool)
    begins[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
    squares = [np.full(x.shape, 1e-8) for x in model[1:]]
    # what the labels have of each weight
    seen = np.zeros_like(model.weights)
    for column in at.T:
        np.add.at(seen, (column, want), 1)
    seen_pairs = np.zeros((LABELS, LABELS))
    follows = np.flatnonzero(~begins)
    np.add.at(seen_pairs, (want[follows - 1], want[follows]), 1)
    seen_first = np.bincount(want[begins], minlength=LABELS).astype(float)
    for _ in range(steps):
        scores = np.zeros((len(want), LABELS))
        for column in at.T:
            scores += model.weights[column]
        each, pairs = _expected(scores, first, active, model, bar)
        gradients = (_by_row(at, each, len(key) + 1), pairs, each[begins].sum(axis=0))
        for x, g, s, have in zip(model[1:], gradients, squares, (seen, seen_pairs, seen_first), strict=True):
            g = (g - have) / len(texts) + ridge * x
            s += g * g
            x -= rate * g / np.sqrt(s)
        model.weights[-1] = 0
    return Model(key, model.weights, model.pairs + bar[:-1], model.first + bar[-1])


def _by_row(at: np.ndarray, each: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at.ravel(), np.repeat(each[:, k], at.shape[1]), n) for k in range(LABELS)], axis=1)


def _expected(scores: np.ndarray, first: np.ndarray, active: np.ndarray, model: Model, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each token's labels and expected counts of pairs, by the forward-backward recursion."""
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    pairs, totals = np.zeros((LABELS, LABELS)), model.pairs + bar[:-1]
    for t, m in enumerate(active):
        at = first[:m] + t
        forward[at] = (model.first + bar[-1] if t == 0 else _log_sum(forward[at - 1][:, :, None] + totals, 1)) + scores[at]
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        backward[at] = _log_sum(totals + (scores[at + 1] + backward[at + 1])[:, None, :], 2)
    both = forward + backward
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        whole = _log_sum(both[at], 1)
        pairs += np.exp(forward[at - 1][:, :, None] + totals + (scores[at] + backward[at])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return np.exp(both - _log_sum(both, 1)[:, None]), pairs


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# The labelled table.


def labelled_examples(n: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Invented lines with the places of personal data in them, and with numbers that are none: dates, prices, versions, keys."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    word = lambda: "".join(pick("etaoinshrdlucmfépgwöybvñkç") for _ in range(rng.randint(1, 9)))

    def card() -> str:
        body = pick("3456") + digits(pick((12, 14, 14, 14, 14, 17)))
        number = next(body + d for d in "0123456789" if luhn(body + d))
        cut = pick(("", "", " ", "-", "."))
        return cut.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)}{a}{b}{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}"))

    def email() -> str:
        name = pick((word() + "." + digits(2), word(), word() + "." + word(), word() + "_" + word(), word() + digits(3)))
        return pick(("{}@{}.{}", "{}@{}.{}", "{}@{}.{}", "{} @ {}.{}")).format(name, word() + pick(("", "", digits(1), "." + word())), pick(("com", "org", "example.com", "de", "fr")))

    def address() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def none() -> str:
        year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
        return pick(
            (
                f"{year}-{month:02}-{day:02}", f"{day}/{month}/{year}", f"{month:02}.{day:02}.{year}", f"{day:02}:{month:02}", f"{year}-{year + 5}", f"${digits(2)},{digits(3)}.{digits(2)}",
                f"v{day}.{month}.{digits(1)}", f"version {month}", f"{month}.0.", f"CC BY-NC {month}.0.", f'token = "{digits(6)}a{digits(4)}f{digits(8)}e{digits(3)}"', f"password={digits(2)}b{digits(5)}ce{digits(4)}", f"AKIA{digits(2)}KX{digits(4)}QWZ",
                f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{digits(rng.randint(1, 9))}", f"{digits(4)} {digits(3)}", f"{digits(3)} % of {digits(5)}", f"@{word()}", f"order {digits(12)}", f"id {digits(11)}", f"10.{digits(4)}/{word()}.{digits(6)}", f"{digits(2)}-{digits(4)}",
                f"{digits(5)}-{digits(4)}", f"{digits(4)}x{digits(4)}", f"{year}{month:02}{day:02}{digits(6)}", f"{word()}@{word()}", f"{digits(2)} {digits(3)} {digits(4)} {digits(2)}",
            )
        )

    makers = {"card": card, "phone": phone, "email": email, "ip": address}
    before = {"card": ("card", "visa", "card no.", "card:"), "phone": ("call", "phone", "tel.", "phone:", "mobile"), "email": ("mail", "email:", "write to", "contact"), "ip": ("host", "ip", "from", "address:")}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 5)):
            some = rng.random()
            if some < 0.45:
                kind = pick(KINDS)
                for _ in range(pick((1, 1, 1, 2))):
                    if rng.random() < 0.2:
                        text += pick(before[kind]) + " "
                    piece = makers[kind]()
                    spans.append((kind, len(text), len(text) + len(piece)))
                    text += piece + pick((" ", " ", " ", " ", ". ", ", ", ") ", "\n"))
                    kind = pick(KINDS)
            elif some < 0.75:
                text += none() + pick((" ", " ", ". ", ", ", "\n"))
            else:
                text += " ".join(pick((word, word, lambda: word().title()))() for _ in range(rng.randint(1, 6))) + pick((" ", " ", ". ", "\n"))
        out.append((text, spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """text, spans: array of kind, start, stop. Small; made by labelled_examples."""
    return spark.createDataFrame(labelled_examples(), "text string, spans array<struct<kind string, start int, stop int>>")


@cache
def _fitted(rows: tuple) -> Model:
    return train([t for t, _ in rows], [list(s) for _, s in rows])


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The field trained on at most max_labelled rows, the first by a hash of their text."""
    rows = labelled.where("text is not null").orderBy(F.xxhash64("text"), "text").limit(max_labelled).select("text", "spans").collect()
    return _fitted(tuple((r.text, tuple((s.kind, s.start, s.stop) for s in r.spans or ())) for r in rows))


# Texts.


def windows_of(text: str) -> list[tuple[int, int]]:
    """CONTEXT characters around each run of digits and @; those that touch are one."""
    out: list[tuple[int, int]] = []
    for m in _HIT.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _fits(kind: str, text: str) -> bool:
    if kind == "email":
        return bool(_EMAIL_LIKE.fullmatch(text))
    if kind == "ip":
        return bool(_IP_LIKE.fullmatch(text)) and _parts_fit(text)
    if kind == "card":
        return bool(_CARD_LIKE.fullmatch(text)) and _card_fits(text)
    return bool(_PHONE_LIKE.fullmatch(text)) and _phone_fits(text)


def labelled_spans(windows: list[str], model: Model) -> list[list[Span]]:
    """What the field labels in each window."""
    t = tokens_of(windows)
    labels = viterbi(model.scores(t), t.offsets, model)
    out: list[list[Span]] = [[] for _ in windows]
    window = np.repeat(np.arange(len(windows)), np.diff(t.offsets))
    last = (-1, -1)  # the window and the place of the last token that was labelled
    for at in np.flatnonzero(labels):
        w, label = int(window[at]), int(labels[at])
        kind = KINDS[(label - 1) // 2]
        if label % 2 == 0 and last == (w, at - 1) and out[w]:
            out[w][-1] = kind, out[w][-1][1], int(t.end[at])
        else:
            out[w].append((kind, int(t.start[at]), int(t.end[at])))
        last = w, at
    return out


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the spans of the rules, and all spans; both by kind and start."""
    places = [(i, a, b) for i, text in enumerate(texts) for a, b in windows_of(text)]
    added: dict[int, list[Span]] = {}
    for (i, a, _), spans in zip(places, labelled_spans([texts[i][a:b] for i, a, b in places], model), strict=True):
        added.setdefault(i, []).extend((kind, a + s, a + e) for kind, s, e in spans if _fits(kind, texts[i][a + s : a + e]))
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text)
        taken = sorted((s, e) for _, s, e in base)
        starts, ends = np.array([s for s, _ in taken]), np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
        new = [x for x in added.get(i, ()) if not (k := int(np.searchsorted(starts, x[2]))) or ends[k - 1] <= x[1]]
        out.append((base, sorted(base + new, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for a, b in text_parts(batch.column(1), PART):
            part = batch.slice(a, b - a)
            hit = np.asarray(pc.fill_null(pc.match_substring_regex(part.column(1), "[0-9@]"), False))
            got = iter(find(part.column(1).filter(pa.array(hit)).to_pylist(), model))
            both = [next(got) if h else ([], []) for h in hit]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in x[k]] for x in both], kind) for k in (0, 1))], names=["_id", "base", "spans"])


def personal_data(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, spans: arrays of kind, start, stop; base is what the rules find, spans all."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # weights of the features of MAX_LABELLED rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return rows.mapInArrow(lambda it: _found(it, shared.value), f"_id {rows.schema['_id'].dataType.simpleString()}, base {span}, spans {span}").withColumnRenamed("_id", id_col)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op13_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the rules' spans; all spans, and how many the field added."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit(labelled_table(spark)))
    counts = (_counted("base", k).alias(f"n_{k}") for k in KINDS)
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), added)

