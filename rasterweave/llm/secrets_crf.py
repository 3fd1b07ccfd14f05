"""Secrets in text: base patterns, and a linear-chain conditional random field beside them.

Tokens are tagged outside, begin or inside. A tag's score has the token's shape, the words
beside it and features of the whole file; Viterbi decoding gives the best sequence of tags.
All but the file's part belongs to a token or its neighbour, so it is computed once for each
distinct token of a worker. A text in which no token's score makes up for what the steps into
and out of a span can gain is proven to have no tagged token without decoding; every other text
is decoded from its first to its last token.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.llm.tokens import TokenTable, bounded_batches, fresh, hash64

O, B, I = 0, 1, 2  # noqa: E741
#: Hash slots of features, and documents that background windows of the training set come from (a bounded sample by hash of the id).
SLOTS, SAMPLE = 1 << 14, 400
#: Tokens of a training window.
WINDOW = 40
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the lengths that their matches need.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20

_TOKEN = re.compile(r"[\w+/.\-]+={0,2}|[^\w\s+/.\-]+")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the matches of the base patterns that are long enough, by start and kind; code points."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii():
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]  # runs are maximal, so the least length can stand in the pattern
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@functools.cache
def _plain(n: int, capital: bool) -> list[str]:
    """Features of an ordinary word."""
    return [f"kinds 1{capital:d}00 {min(12, int(2 * math.log2(n)))}", "plain"]


def _shape(token: str) -> list[str]:
    """Features of a token alone."""
    n = len(token)
    if n > 1 and token.isalpha() and (token.islower() or token[0].isupper() and token[1:].islower()):
        return _plain(n, token[0].isupper())
    lower = sum(c.islower() for c in token)
    upper = sum(c.isupper() for c in token)
    digit = sum(c.isdigit() for c in token)
    kinds = f"{lower > 0:d}{upper > 0:d}{digit > 0:d}{n > lower + upper + digit:d}"
    size = min(12, int(2 * math.log2(n))) if n else 0
    if n < 6 or not digit and not (upper > 1 and lower) and token[-1] != "=":
        return [f"kinds {kinds} {size}", "plain"] if n > 1 else ["one"]
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(token, token[1:], strict=False))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(token).values())
    bare = token.strip("=")
    of = "num" if re.fullmatch(r"[\d.,/-]+", bare) else "hex" if re.fullmatch(r"[0-9a-f]+", bare, re.I) and not (lower and upper) else "b64" if re.fullmatch(r"[A-Za-z0-9+/]+", bare) else "id" if re.fullmatch(r"[\w-]+", bare) and bare.isascii() else "odd"
    dense = int(8 * turns / n)
    return [
        f"kinds {kinds} {size}", f"of {of} {size}", f"turns {of} {dense}", f"entropy {int(2 * entropy)} {of}", f"digits {int(6 * digit / n)} {of}",
        f"start {token[:4]}", f"mixed {of} {size} {min(dense, 3)} {int(2 * entropy)}", f"ends {token[-1] == '='}", f"any {size} {min(dense, 3)} {int(2 * entropy)}",
    ]


def _word(token: str) -> str:
    """What a neighbour sees of a token."""
    low = token.lower()
    return low if len(low) <= 14 and (low.isalpha() or not any(c.isdigit() for c in low)) else f"~{min(6, len(low) // 6)}"


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the tokens' own features, one after another; where each token's begin; its slot as the word before and as the word after."""
    own = [_shape(t) for t in tokens]
    flat = hash64((f for fs in own for f in fs), 11)
    words = [_word(t) for t in tokens]
    starts = np.concatenate([[0], np.cumsum([len(fs) for fs in own])[:-1]]).astype(np.int64)
    slot = lambda h: (h & np.uint64(SLOTS - 1)).astype(np.int64)
    return slot(flat), starts, slot(hash64(words, 12)), slot(hash64(words, 13))


def file_slot(text: str) -> int:
    """The slot of the file's features: how much of it is assignments and quotes, how much digits."""
    n = max(1, len(text))
    marks = text.count("=") + text.count(":") + text.count('"')
    return int(hash64([f"file {min(5, int(math.log2(1 + 2000 * marks / n) / 2))}"], 14)[0] & np.uint64(SLOTS - 1))


class CRF:
    """weights[SLOTS, 3] of features and tags; steps[3, 3] of a tag after another."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        rest = steps - steps[O, O]
        #: What the step to a token of a span can gain at most on staying outside, and what the step out of the span can.
        self.into, self.out = float(max(rest[O, B], rest[B, B], rest[B, I], rest[I, I], rest[I, B])), float(max(0.0, rest[B, O], rest[I, O]))

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Of each token: the scores of the tags for itself, for the token after it and for the token before it."""
        flat, starts, before, after = features(tokens)
        w = self.weights
        return np.concatenate([np.add.reduceat(w[flat], starts), w[before], w[after]], 1)

    def scores(self, rows: np.ndarray, file: int) -> np.ndarray:
        """Scores of the tags of each token of a text."""
        s = rows[:, :3] + self.weights[file]
        s[1:] += rows[:-1, 3:6]
        s[:-1] += rows[1:, 6:]
        return s

    def silent(self, s: np.ndarray) -> bool:
        """Whether all tokens are outside for certain: no token's score makes up for what steps can gain. The first token has no step to it."""
        over = np.maximum(s[:, B], s[:, I]) - s[:, O] + self.out
        return bool(over[0] <= 0 and (over[1:] + self.into <= 0).all())

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best sequence of tags; a span starts with begin."""
        oo, ob = float(self.steps[O, O]), float(self.steps[O, B])
        bo, bb, bi = (float(x) for x in self.steps[B])
        io, ib, ii = (float(x) for x in self.steps[I])
        rows = s.tolist()
        o, b, i = rows[0][O], rows[0][B], -math.inf
        back: list[tuple[int, int, int]] = []
        for eo, eb, ei in rows[1:]:
            co, cb, ci = (o + oo, O), (o + ob, O), (b + bi, B)
            if b + bo > co[0]:
                co = (b + bo, B)
            if i + io > co[0]:
                co = (i + io, I)
            if b + bb > cb[0]:
                cb = (b + bb, B)
            if i + ib > cb[0]:
                cb = (i + ib, I)
            if i + ii > ci[0]:
                ci = (i + ii, I)
            back.append((co[1], cb[1], ci[1]))
            o, b, i = co[0] + eo, cb[0] + eb, ci[0] + ei
        tag = max((O, B, I), key=lambda t: (o, b, i)[t])
        tags = [tag]
        for step in reversed(back):
            tag = step[tag]
            tags.append(tag)
        return tags[::-1]


def spans(text: str | None, crf: CRF, table: TokenTable) -> list[Span]:
    """All spans of a text by start and kind: those of the base patterns, and tagged ones that touch none of them. Null has none."""
    if not text:
        return []
    out = base_spans(text)
    tokens = _TOKEN.findall(text)
    if not tokens:
        return out
    s = crf.scores(table.of(tokens), file_slot(text))
    if crf.silent(s):
        return out
    tags = crf.viterbi(s)
    if not any(tags):
        return out
    found: list[list[int]] = []
    for m, tag in zip(_TOKEN.finditer(text), tags, strict=True):
        if tag == B:
            found.append([m.start(), m.end()])
        elif tag == I:
            found[-1][1] = m.end()
    more = [(a, b, "crf") for a, b in found if not any(x < b and a < y for x, y, _ in out)]
    return sorted(out + more, key=lambda x: (x[0], KINDS.index(x[2])))


def _batches(data: list, size: int, rng) -> Iterator[tuple]:
    for at in range(0, len(data), size):
        some = [data[i] for i in rng[at : at + size]]
        n = max(len(x[2]) for x in some)
        yield some, n


def fit(windows: list[tuple[list[str], str, list[int]]], epochs: int = 10, rate: float = 0.2, decay: float = 2e-4, seed: int = 5) -> CRF:
    """Maximum likelihood by AdaGrad. windows: (tokens, the text for the file's features, tags)."""
    order = np.random.default_rng(seed)
    w, steps = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    steps[O, I] = -30.0
    gw, gs = np.full((SLOTS, 3), 1e-2), np.full((3, 3), 1e-2)
    data = []
    for tokens, text, tags in windows:
        flat, starts, before, after = features(tokens)
        n = len(tokens)
        own = np.repeat(np.arange(n), np.diff([*starts, len(flat)]))
        slots = np.concatenate([flat, np.full(n, file_slot(text)), before[:-1], after[1:]])
        place = np.concatenate([own, np.arange(n), np.arange(1, n), np.arange(n - 1)])
        data.append((slots, place, np.array(tags)))
    for _ in range(epochs):
        for some, n in _batches(data, 32, order.permutation(len(data))):
            k = len(some)
            e = np.zeros((k, n, 3))
            for j, (slots, place, _) in enumerate(some):
                np.add.at(e[j], place, w[slots])
            size = np.array([len(x[2]) for x in some])
            inside = np.arange(n) < size[:, None]
            alpha, beta = np.zeros((k, n, 3)), np.zeros((k, n, 3))
            alpha[:, 0] = e[:, 0] + np.array([0, 0, -30.0])
            for t in range(1, n):
                x = alpha[:, t - 1, :, None] + steps
                top = x.max(1)
                alpha[:, t] = np.where(inside[:, t, None], e[:, t] + top + np.log(np.exp(x - top[:, None]).sum(1)), alpha[:, t - 1])
            for t in range(n - 2, -1, -1):
                x = steps + (e[:, t + 1] + beta[:, t + 1])[:, None]
                top = x.max(2)
                beta[:, t] = np.where(inside[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
            last = alpha[np.arange(k), size - 1]
            z = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
            p = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + steps + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None]) * inside[:, 1:, None, None]
            ds = pair.sum((0, 1))
            dw = np.zeros((SLOTS, 3))
            touched = []
            for j, (slots, place, tags) in enumerate(some):
                d = p[j, : len(tags)].copy()
                d[np.arange(len(tags)), tags] -= 1
                np.add.at(dw, slots, d[place])
                np.subtract.at(ds, (tags[:-1], tags[1:]), 1)
                touched.append(slots)
            at = np.unique(np.concatenate(touched))
            g = dw[at] / k + decay * w[at]
            gw[at] += g * g
            w[at] -= rate * g / np.sqrt(gw[at])
            ds = ds / k + decay * steps
            ds[O, I] = 0
            gs += ds * ds
            steps -= rate * ds / np.sqrt(gs)
    return CRF(w.astype(np.float32), steps)


def _many(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _UP + _LOW + _DIGITS
#: Makers of secrets of the usual kinds, by name.
FORMATS = {
    "hex": lambda r: _many(r, _DIGITS + "abcdef", r.choice([16, 18, 20, 24, 32, 40, 64])),
    "upper hex": lambda r: _many(r, _DIGITS + "ABCDEF", r.choice([16, 20, 32, 40])),
    "alnum": lambda r: _many(r, _ALNUM, r.randrange(16, 48)),
    "upper": lambda r: _many(r, _UP + _DIGITS, r.randrange(16, 40)),
    "lower": lambda r: _many(r, _LOW + _DIGITS, r.randrange(18, 44)),
    "base64": lambda r: _many(r, _ALNUM + "+/", r.choice([24, 40, 43])) + r.choice(["", "=", "=="]),
    "prefixed": lambda r: f"{_many(r, r.choice([_LOW, _UP]), r.randrange(2, 6))}{r.choice('_-')}{_many(r, _ALNUM, r.randrange(18, 44))}",
    "prefixed twice": lambda r: f"{_many(r, _LOW, r.randrange(2, 5))}{(s := r.choice('_-'))}{_many(r, _LOW + _DIGITS, r.randrange(2, 6))}{s}{_many(r, _ALNUM, r.randrange(20, 40))}",
    "joined": lambda r: ".".join(_many(r, _ALNUM + "-_", r.randrange(18, 34)) for _ in range(3)),
    "dashed": lambda r: "-".join(_many(r, _ALNUM, r.randrange(8, 24)) for _ in range(r.randrange(2, 5))),
    "access": lambda r: f"AKIA{_many(r, _UP + _DIGITS, 16)}",
    "ghp": lambda r: f"ghp_{_many(r, _ALNUM, 36)}",
    "sk": lambda r: f"sk-{_many(r, _ALNUM, r.randrange(24, 48))}",
    "sk live": lambda r: f"sk_live_{_many(r, _ALNUM, 24)}",
    "xoxb": lambda r: f"xoxb-{_many(r, _DIGITS, 11)}-{_many(r, _ALNUM, 24)}",
    "aiza": lambda r: f"AIza{_many(r, _ALNUM + '-_', 35)}",
    "jwt": lambda r: f"eyJ{_many(r, _ALNUM, 20)}.eyJ{_many(r, _ALNUM, 30)}.{_many(r, _ALNUM + '-_', 30)}",
    "glpat": lambda r: f"glpat-{_many(r, _ALNUM, 20)}",
}


def _secret(r: random.Random, formats: tuple[str, ...] = tuple(FORMATS)) -> str:
    """A made-up secret of one of the formats."""
    return FORMATS[r.choice(formats)](r)


def _harmless(r: random.Random) -> str:
    """What has digits or odd shapes and is no secret."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("aeioubdfgklmnprst") for _ in range(r.randrange(3, 9)))
    return r.choice([
        lambda: d(r.randrange(1, 5)), lambda: d(r.randrange(6, 20)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"+{d(2)}-{d(3)}-{d(7)}", lambda: f"{name()}@{name()}.com",
        lambda: f"https://{name()}.example.com/{name()}/{name()}-{d(4)}.html", lambda: f"/usr/{name()}/{name()}{d(2)}", lambda: f"{name()}{name().title()}{name().title()}", lambda: f"{name()}_{name()}_{d(2)}",
        lambda: f"{name().upper()}{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: f"{name()}-{name()}-{name()}", lambda: name().upper() + name().upper(), lambda: f"10.{d(2)}.{d(1)}.{d(3)}", lambda: "=" * r.randrange(3, 20),
        lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)), lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{name()}{d(1)}", lambda: f"#{d(3)}{r.choice('abcdef')}{d(2)}",
        lambda: f"ISBN-{d(3)}-{d(10)}", lambda: name() * 3, lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"DE{d(20)}",
    ])()


def _open_question(token: str) -> bool:
    """Whether a token is long and has both letters and digits."""
    return len(token) >= 16 and any(map(str.isdigit, token)) and any(map(str.isalpha, token))


def training_windows(texts: list[str], seed: int = 17, made: int = 1200, formats: tuple[str, ...] = tuple(FORMATS)) -> list[tuple[list[str], str, list[int]]]:
    """Windows of texts tagged by the base patterns, and made windows of their words with made secrets of the formats and harmless strings among them.

    A text's window that has a token which could be a secret the patterns miss is left out: it would be learned as harmless.
    """
    r = random.Random(seed)
    out = []
    pool = ["the", "of", "and", "a", "to", "in"]
    for text in texts:
        found = base_spans(text)
        tokens, tags = [], []
        for m in _TOKEN.finditer(text):
            hit = next((s for s in found if s[0] < m.end() and m.start() < s[1]), None)
            value = hit is not None and (hit[2] != "assign" or m.end() >= hit[1] and not m[0].lower().startswith(_KEYS))
            tokens.append(m[0])
            tags.append(O if not value else I if tags and tags[-1] != O and m.start() > 0 and not text[m.start() - 1].isspace() else B)
        if not tokens:
            continue
        pool += [t for t in tokens[:20] if not _open_question(t)]
        hits = [i for i, t in enumerate(tags) if t]
        at = sorted({max(0, h - WINDOW // 2) for h in hits[:3]} | {r.randrange(max(1, len(tokens) - WINDOW + 1)) for _ in range(2)})
        for a in at:
            tail = tags[a : a + WINDOW]
            if any(not tag and _open_question(t) for t, tag in zip(tokens[a : a + WINDOW], tail, strict=True)):
                continue
            if tail[0] == I:
                tail[0] = B
            out.append((tokens[a : a + WINDOW], text, tail))
    names = ["key", "Bearer", "authorization:", "pwd=", "passphrase:", "access_key=", "client_secret=", "credentials:", "private", "AWS_SECRET_ACCESS_KEY=", "token", "secret=", "apikey=", "auth=", "password:", "signature=", "pass=", "session", "jwt:"]
    for k in range(made):
        line, tags = [], []
        for _ in range(r.randrange(12, WINDOW - 8)):
            line.append(r.choice(pool))
            tags.append(O)
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(line) + 1)
            line[at:at], tags[at:at] = (made_tokens := _TOKEN.findall(_harmless(r))), [O] * len(made_tokens)
        if k % 3:
            at = r.randrange(len(line) + 1)
            lead = _TOKEN.findall(r.choice(names)) + r.choice([[], ['"'], ["'"]]) if r.random() < 0.8 else []
            own = _TOKEN.findall(_secret(r, formats))
            tail = [lead[-1]] if lead and lead[-1] in "\"'" else []
            line[at:at] = lead + own + tail
            tags[at:at] = [O] * len(lead) + [B] + [I] * (len(own) - 1) + [O] * len(tail)
        out.append((line, " ".join(line), tags))
    return out


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> CRF:
    """Fit on windows of sample documents at most, the least by a hash of id and text, and on made windows. Rows that repeat both count once."""
    n = docs.count()
    part = min(1.0, 1.5 * sample / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("secret sample"), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.select(draw.alias("_draw"), F.col(f"`{text_col}`").alias("_text")).where((F.col("_draw") < part) & F.col("_text").isNotNull())
    rows = drawn.groupBy("_draw").agg(F.min("_text").alias("_text")).orderBy("_draw").limit(sample).collect() if n else []
    return fit(training_windows([r["_text"] for r in rows]))


def scanner(spark: SparkSession, crf: CRF):
    """A function from a text column to array<struct(start, end, kind)>: the spans in order (code points, end exclusive; null or empty: none).

    The broadcast is the model, as large as its slots. A text is one row of a pandas UDF.
    """
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((crf.weights, crf.steps))

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = CRF(*sent.value)
        table = TokenTable(own.rows)
        for part in parts:
            yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in spans(text, own, table)] for text in part], dtype=object)
        table.done()

    return scan


def redact(docs: DataFrame, scan, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in the place of each span that no earlier span covers; overlapping spans become one mark."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans_ in zip(texts, found, strict=True):
            if text is None or spans_ is None or not len(spans_):
                out.append(text)
                continue
            parts, at = [], 0
            for s in spans_:
                a, b = s["start"], s["end"]
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    found = fresh(docs, "_found")
    return docs.withColumn(found, scan(F.col(text_col))).withColumn(text_col, cut(F.col(text_col), F.col(found))).drop(found)
