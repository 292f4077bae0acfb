"""Personal data: exact patterns, plus a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: outside, then begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The patterns of the contract. Possessive and split so that no input makes them backtrack.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The labelled table: kind in angle brackets before each span, closed by </>. Own invention.
LABELLED = [
    "write to <email>ann.lee@mail.example.org</> today", "contact <email>bob7@corp.example.net</>, please", "mail: <email>x_y+z@a-b.co.uk</>", "email <email>sales@localhost</> for help",
    "<email>first.last@example</> replied", "e-mail <email>team@intranet</> about 3 things", "the handle @sam2 is taken", "see notes@ 5 pm", "rate 3 @ 20 each", "from <email>.55@mail4.example.com</> we heard",
    "host <ip>10.0.0.7</> is up", "server <ip>192.168.1.254</>, port 80", "ping <ip>8.8.4.4</> and <ip>1.1.1.1</>", "address <ip>172.16.31.9:8080</> refused", "version 1.2.3 is out", "release 10.4.2 of 2021",
    "section 3.1.4.2.9 says", "build 400.500.600.700 failed", "pi is 3.14159", "costs 12.50 or 9.99", "card <card>4539 1488 0343 6467</> expires", "paid with <card>4111111111111111</> in May", "visa <card>4012-8888-8888-1881</> ok",
    "number <card>378282246310005</> charged", "order 1234567890123456 shipped", "id 9999888877776666 unknown", "serial 20210930112233445 found", "sum 1000000 and 2500000", "call <phone>+1 (212) 555-0100</> now",
    "phone <phone>+44 20 7946 0958</> or mail", "tel <phone>(415) 555-0132</> anytime", "call <phone>415-555-0199</> today", "phone: <phone>555-0142</>", "tel. <phone>030 1234567</>", "fax <phone>+49 30 901820</> works",
    "ring <phone>+33 1 70 18 99 00</> at noon", "mobile <phone>0171 5550123</> please", "call <phone>212 555 0187</> later", "in 2019 and 2020 we", "on 12-05-2021 at 10:30", "room 204 floor 3", "pages 100-120 of 300", "score 3-2 after 90 minutes",
    "token = 9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "key a1b2c3d4 used", "route 66 and 101", "zip 10115 Berlin", "the 7th of 12", "between 1990-1999", "call 3 people at 5", "isbn 978-3-16-148410-0", "call <phone>+1 (487) 555-7209</> heat", "from 1 (one) to 20 (twenty)", "about 50% of 1,200",
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in code points, by start, then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, done := m.end()))
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    for run in _DOTTED.finditer(text):
        for m in _IP.finditer(run[0]):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((run.start() + m.start(), 1, run.start() + m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_SPACE = " \t\n\r\f\v"
_TOKEN_END = re.compile(r"[^ \t\n\r\f\v]*+")
_MARK = re.compile("[0-9@]")
_SHAPED = re.compile(r"[0-9]++|[^\W\d_]++|.", re.S)
#: What a shape sees of a token: characters and pieces.
SEEN, PIECES = 200, 24
#: Parts of a token that goes beyond that.
_PART = re.compile(r"[A-Za-z0-9._%+()@-]++")


def tokens(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign. All others are outside by construction of the field.

    A word that a shape doesn't see whole, such as JSON without blanks, is split at all signs that personal
    data don't hold, and its parts are judged one by one.
    """
    out, done = [], 0
    m = _MARK.search(text)
    while m:
        start = max(done, 1 + max(text.rfind(c, done, m.start()) for c in _SPACE))
        done = _TOKEN_END.match(text, m.start()).end()
        if done - start > SEEN or done - start > PIECES < len(_SHAPED.findall(text, start, done)):
            out.extend(p.span() for p in _PART.finditer(text, start, done) if _MARK.search(p[0]))
        else:
            out.append((start, done))
        m = _MARK.search(text, done)
    return out


def runs(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Neighbouring words: between two runs stands a word that is outside, which parts the chain exactly."""
    out: list[list[tuple[int, int]]] = []
    for s, e in spans:
        if out and s - out[-1][-1][1] <= 2 and text[out[-1][-1][1] : s].strip(_SPACE) == "":
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
    return out


def shape(word: str) -> tuple[str, str]:
    """Runs of letters as a, of digits as d, other signs kept; then the same with the digits counted."""
    plain, sized, last = [], [], ""
    for m in _SHAPED.finditer(word[:SEEN]):
        c = m[0]
        kind = "d" if "0" <= c[0] <= "9" else "a" if c[0].isalpha() else c
        if kind == last and kind not in "da":
            continue
        plain.append(kind)
        sized.append(f"d{min(len(c), 20)}" if kind == "d" else kind)
        last = kind
    return "".join(plain[:PIECES]), "".join(sized[:PIECES])


def features(text: str, run: list[tuple[int, int]]) -> list[list[str]]:
    # The word right before, however far: no run ends between the two, so each place is passed once.
    end = run[0][0]
    while end and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    begin = end
    while begin and text[begin - 1].isalpha():
        begin -= 1
    cue = "cue=" + text[begin:end].lower()
    out = []
    for k, (s, e) in enumerate(run):
        word = text[s:e].strip(".,;:!?\"'")
        plain, sized = shape(word)
        digits = re.sub("[^0-9]", "", word[:SEEN])
        near = [f"pre={shape(text[run[k - 1][0] : run[k - 1][1]])[1]}"] if k else [cue, f"{cue}|{sized}", "pre=start"]
        post = f"post={shape(text[run[k + 1][0] : run[k + 1][1]])[1]}" if k + 1 < len(run) else "post=end"
        good = "luhn" if 14 <= len(digits) <= 19 and luhn(digits) else "plain"
        small = "bytes" if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?", word) and max(map(int, re.findall("[0-9]+", word)[:4])) < 256 else "other"
        out.append(["bias", f"s={plain}", f"n={sized}", f"digits={min(len(digits), 20)}", good, small, *near, post])
    return out


@dataclass
class Field:
    """Weights by feature and label, and from label to label; the chain starts and ends outside."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for i, row in enumerate(rows):
            known = [self.index[f] for f in row if f in self.index]
            out[i] = self.emit[known].sum(0)
        return out


def forbidden() -> np.ndarray:
    """Inside may follow begin or inside of its own kind only."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for b, to in enumerate(LABELS):
        for a, at in enumerate(LABELS):
            if to[0] == "I" and at[2:] != to[2:]:
                out[a, b] = -1e4
    return out


def read_labelled(rows: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for row in rows:
        text, spans, opened = "", [], None
        for part in re.split(r"(<[a-z]*>|</>)", row):
            if part == "</>":
                spans.append((*opened, len(text)))
            elif re.fullmatch("<[a-z]*>", part):
                opened = (part[1:-1], len(text))
            else:
                text += part
        out.append((text, [(s, e, k) for k, s, e in spans]))
    return out


def train(rows: list[str] = LABELLED, epochs: int = 60, rate: float = 0.5, l2: float = 0.01) -> Field:
    """Adagrad on the log-likelihood by forward and backward sums, run by run; no randomness."""
    data = []
    for text, spans in read_labelled(rows):
        for run in runs(text, tokens(text)):
            y = []
            for s, e in run:
                own = next(((a, k) for a, b, k in spans if s < b and a < e), None)
                y.append(0 if own is None else LABELS.index(("B-" if s <= own[0] else "I-") + own[1]))
            data.append((features(text, run), np.array(y)))
    m = Field({f: i for i, f in enumerate(sorted({f for x, _ in data for r in x for f in r}))})
    n = len(LABELS)
    m.emit, ban = np.zeros((len(m.index), n)), forbidden()
    seen_e, seen_m = np.full(m.emit.shape, 1e-6), np.full((n, n), 1e-6)
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for _ in range(epochs):
        for x, y in data:
            score, move = m.scores(x), m.move + ban
            t = len(x)
            fore, back = np.zeros((t, n)), np.zeros((t, n))
            fore[0], back[-1] = score[0] + move[0], move[:, 0]
            for i in range(1, t):
                fore[i] = score[i] + lse(fore[i - 1][:, None] + move, 0)
            for i in range(t - 2, -1, -1):
                back[i] = lse(move + score[i + 1] + back[i + 1], 1)
            z = lse(fore[-1] + back[-1], 0)
            gap = -np.exp(fore + back - z)
            gap[np.arange(t), y] += 1
            step = np.zeros((n, n))
            path = [0, *y, 0]
            for a, b in zip(path, path[1:], strict=False):
                step[a, b] += 1
            step[0] -= np.exp(move[0] + score[0] + back[0] - z)
            step[:, 0] -= np.exp(fore[-1] + move[:, 0] - z)
            for i in range(1, t):
                step -= np.exp(fore[i - 1][:, None] + move + score[i] + back[i] - z)
            step -= l2 * m.move
            seen_m += step**2
            m.move += rate * step / np.sqrt(seen_m)
            for i, row in enumerate(x):
                ids = [m.index[f] for f in row]
                g = gap[i] - l2 * m.emit[ids]
                seen_e[ids] += g**2
                m.emit[ids] += rate * g / np.sqrt(seen_e[ids])
    return m


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label paths of equally long runs together: (runs, words, labels) -> (runs, words)."""
    n, t, _ = score.shape
    back = np.zeros((n, t, score.shape[2]), np.int8)
    now = score[:, 0] + move[0]
    for i in range(1, t):
        way = now[:, :, None] + move[None]
        back[:, i] = way.argmax(1)
        now = way.max(1) + score[:, i]
    out = np.zeros((n, t), np.int64)
    out[:, -1] = (now + move[:, 0]).argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


def extra(texts: list[str], m: Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text: (start, kind, end). Runs of all texts are decoded together by length."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by: dict[int, list[tuple[int, list[tuple[int, int]], np.ndarray]]] = {}
    for i, text in enumerate(texts):
        for run in runs(text, tokens(text)):
            by.setdefault(len(run), []).append((i, run, m.scores(features(text, run))))
    move = m.move + forbidden()
    for _, group in sorted(by.items()):
        for (i, run, _), labels in zip(group, viterbi(np.stack([g[2] for g in group]), move), strict=True):
            k = 0
            while k < len(run):
                last = k
                if labels[k]:
                    while last + 1 < len(run) and LABELS[labels[last + 1]][0] == "I":
                        last += 1
                    s, e = run[k][0], run[last][1]
                    while e > s and texts[i][e - 1] in ".,;:!?\"'":
                        e -= 1
                    if e > s:
                        out[i].append((s, KINDS.index(LABELS[labels[k]][2:]), e))
                k = last + 1
    return out


def find(texts: list[str], m: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text: base spans stay, the field adds those that touch none of them."""
    out = []
    for text, more in zip(texts, extra(texts, m), strict=True):
        own = base(text) if _MARK.search(text) else []
        free, at, reach = [], 0, 0
        for s, k, e in sorted(more):
            while at < len(own) and own[at][0] < e:
                reach = max(reach, own[at][2])
                at += 1
            if s >= reach:
                free.append((s, k, e))
        out.append((own, sorted(own + free)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def report(docs: DataFrame, m: Field | None = None) -> DataFrame:
    """docs (any columns) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; a row for each input row.

    The counts and the digest are of base spans; spans has all. A null text is empty.
    """
    m = m or train()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = find(part.text.tolist(), m)
            counts = np.array([[sum(k == x for _, k, _ in own) for x in range(4)] for own, _ in found], np.int64).reshape(-1, 4)
            yield pd.DataFrame({"doc_id": part.doc_id} | {f"n_{k}": counts[:, i] for i, k in enumerate(KINDS)} | {
                "base_sha256": [hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found],
                "spans": [written(every) for _, every in found],
                "n_added": [len(every) - len(own) for own, every in found],
            })

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, m: Field | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns, every span of the text replaced by its kind in brackets; null stays null."""
    m = m or train()

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for x, (_, spans) in zip(part, find([x or "" for x in part], m), strict=True):
                pieces, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        pieces += [x[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append(x if not spans else "".join(pieces) + x[at:])
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, run(F.col(text)))
