"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans to theirs.

Tokens are runs of secret characters ([A-Za-z0-9+/_.=-]) or runs of other visible characters. Each is tagged as secret
begin, inside or outside, from its shape and length, the neighbouring words, and features of the whole text; the best tags
are found by Viterbi. A token can only be begin or inside if it is a candidate: it has a digit and at least MIN_MIXED
characters, or at least MIN_LONG characters, or is one of the REACH tokens after one with a word such as `password`, and has
MIN_NEAR characters. All others are outside by construction. So the chain over all tokens falls apart at every token that is
outside: the best tags of a run of candidates next to each other don't depend on other runs, and decoding only these runs gives
what Viterbi gives on the whole chain.

The field is trained on texts with planted secrets, made by a rule, and on at most SAMPLE_ROWS different texts of the corpus,
RUNS_PER_TEXT runs of each at most, chosen by hashes, whose labels are the fixed patterns' matches.

A span that the field finds is added unless the fixed patterns' spans cover all of it.

Nulls, empties, ties: a null text is empty and has no span. Spans are ordered by start, then by kind in the order assign,
access, hex, crf; equal rows get equal spans. All work is in proportion to a text's length. Other columns are kept as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, prepare, spare_memory

# fixed values: the patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MORE_KEYWORDS = ("bearer", "authorization", "credential", "private_key", "pwd")

#: Bounds of the corpus's share in the training: texts, and runs of each.
SAMPLE_ROWS, RUNS_PER_TEXT = 1000, 8
MIN_MIXED, MIN_LONG, MIN_NEAR, REACH = 8, 24, 6, 4
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]+")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]*")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LONG)
_DIGITS = re.compile(r"[0-9]+")
_ANY_KEYWORD = re.compile("|".join((*KEYWORDS, *MORE_KEYWORDS)), re.IGNORECASE | re.ASCII)
_SECRET_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, leftmost and without overlap in each kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(found)


def _value_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where the secrets themselves are: of assignments the value only."""
    return [(ASSIGN.match(text, s).start(2), e) if k == 0 else (s, e) for s, k, e in spans]


Token = tuple[int, int]


def tokens_of(text: str) -> list[Token]:
    """Bounds of all tokens, in order."""
    return [m.span() for m in _TOKEN.finditer(text)]


def candidates(text: str) -> tuple[list[Token], list[int]]:
    """All tokens of a text and the numbers of those that may belong to a secret, in order; no tokens if there are none."""
    spans = {m.start() for m in _LONG.finditer(text)}
    end = 0
    for m in _DIGITS.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in _SECRET_CHARS:
            start -= 1
        end = _RUN.match(text, at).end()
        if end - start >= MIN_MIXED:
            spans.add(start)
    low = text.lower()
    near = any(k in low for k in (*KEYWORDS, *MORE_KEYWORDS))
    if not spans and not near:
        return [], []
    tokens = tokens_of(text)
    starts = [s for s, _ in tokens]
    found = {bisect_right(starts, s) - 1 for s in spans}
    if near:
        last = -1
        for m in _ANY_KEYWORD.finditer(text):
            k = bisect_right(starts, m.end() - 1) - 1
            if k != last:
                found.update(j for j in range(k + 1, min(k + 1 + REACH, len(tokens))) if text[tokens[j][0]] in _SECRET_CHARS and tokens[j][1] - tokens[j][0] >= MIN_NEAR)
                last = k
    return tokens, sorted(found)


_CLASSES = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "X" * 26 + "x" * 26 + "d" * 10 + "++_.=-")
_SAME = re.compile(r"(.)\1+")


def _word(text: str, tokens: list[Token], k: int) -> str:
    if not 0 <= k < len(tokens):
        return "none"
    w = text[slice(*tokens[k])].lower()
    if w[0] not in _SECRET_CHARS or w in ("=", "-", ".", "=="):
        return w[:3]
    return next((k for k in (*KEYWORDS, *MORE_KEYWORDS) if k in w), "digits" if any(c.isdigit() for c in w) else "word")


def text_features(text: str) -> list[str]:
    """Features of the whole text, as of a file: size, share of code characters, lines."""
    n = max(1, len(text))
    code = sum(text.count(c) for c in "={};_")
    return [f"size={int(math.log10(n))}", f"code={min(4, int(200 * code / n))}", f"lines={min(5, int(math.log2(1 + text.count(chr(10)))))}"]


def token_features(text: str, tokens: list[Token], at: int, whole: list[str]) -> list[str]:
    """Features of one token: of itself, of its neighbours, of the whole text."""
    token = text[slice(*tokens[at])]
    shape = _SAME.sub(r"\1", token.translate(_CLASSES))
    kinds = "".join(c for c in "Xxd+_.=-" if c in shape)
    words = [_word(text, tokens, at - k) for k in (1, 2, 3)]
    hexa = all(c in "0123456789abcdef" for c in token)
    digits = sum(c.isdigit() for c in token) / len(token)
    distinct = len(set(token)) / math.sqrt(len(token))
    size = min(8, int(2 * math.log2(len(token))) - 5)
    return [
        "bias", f"kinds={kinds}", f"shape={shape[:6]}", f"size={size}", f"hex={hexa}/{size}", f"digits={int(5 * digits)}", f"distinct={int(2 * distinct)}",
        *(f"before{k}={w}" for k, w in enumerate(words)), f"after={_word(text, tokens, at + 1)}", f"key={any(w in (*KEYWORDS, *MORE_KEYWORDS) for w in words)}/{kinds}",
        *whole,
    ]


def runs_of(numbers: list[int]) -> list[list[int]]:
    """Numbers of candidates in runs of tokens next to each other."""
    out: list[list[int]] = []
    for k in numbers:
        if out and k == out[-1][-1] + 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


class Field:
    """Weights of features (name -> three scores) and of transitions; begin follows anything, inside only begin or inside."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((3, 3))
        self.barred = np.zeros((3, 3))
        self.barred[O, I] = -1e9

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(3)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in features])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        moves = self.moves + self.barred
        best, back = scores[0] + moves[O], []
        for row in scores[1:]:
            through = best[:, None] + moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        tags = [int((best + moves[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tags of each token, and expected moves (from and to the outside at both ends too)."""
        moves, n = self.moves + self.barred, len(scores)
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        ahead[0] = scores[0] + moves[O]
        for k in range(1, n):
            ahead[k] = scores[k] + np.logaddexp.reduce(ahead[k - 1][:, None] + moves, axis=0)
        behind[-1] = moves[:, O]
        for k in range(n - 2, -1, -1):
            behind[k] = np.logaddexp.reduce(moves + scores[k + 1] + behind[k + 1], axis=1)
        total = np.logaddexp.reduce(ahead[-1] + behind[-1])
        tags = np.exp(ahead + behind - total)
        pairs = np.zeros((3, 3))
        pairs[O] += tags[0]
        pairs[:, O] += tags[-1]
        for k in range(1, n):
            pairs += np.exp(ahead[k - 1][:, None] + moves + scores[k] + behind[k] - total)
        return tags, pairs

    def fit(self, runs: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.4, l2: float = 1e-4) -> None:
        """Adaptive stochastic gradient steps on the conditional log-likelihood."""
        names = {f: k for k, f in enumerate(sorted({f for fs, _ in runs for x in fs for f in x}))}
        w, g2, m2 = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-2), np.full((3, 3), 1e-2)
        coded = [([np.array([names[f] for f in x]) for x in fs], np.array(tags)) for fs, tags in runs]
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            for k in rng.permutation(len(coded)):
                places, tags = coded[k]
                expected, pairs = self.marginals(np.array([w[p].sum(axis=0) for p in places]))
                for p, e, t in zip(places, expected, tags, strict=True):
                    g = -e
                    g[t] += 1
                    step = g - l2 * w[p]
                    g2[p] += step * step
                    w[p] += rate * step / np.sqrt(g2[p])
                for a, b in zip([O, *tags], [*tags, O], strict=True):
                    pairs[a, b] -= 1
                m2 += pairs * pairs
                self.moves -= rate * pairs / np.sqrt(m2)
        self.weights = {f: w[k] for f, k in names.items() if np.abs(w[k]).max() > 1e-3}


def planted(n: int = 400) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts made by a rule, with the places of their secrets: keys behind key words, and look-alikes that are none."""
    rng = np.random.default_rng(5)
    low, up, dec = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b: "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(a, b)))
    prose = lambda: " ".join(some(low, 2, 9) for _ in range(rng.integers(4, 12)))
    out = []
    for k in range(n):
        lead = str(rng.choice(["password", "secret", "api_key", "token", "Bearer", "pwd", "passwd", "credential"])) + str(rng.choice([" = ", ": ", "=", ' = "', " is ", " "]))
        value = [some(low + up + dec, 16, 44), some("0123456789abcdef", 24, 48), "AKIA" + some(up + dec, 14, 20), some(low + up + dec + "+/", 20, 60), some(low + dec + "-_", 12, 30) + some(dec, 2, 5)][k % 5]
        other = [some(dec, 3, 5) + "-" + some(dec, 3, 4) + "-" + some(dec, 4, 5), some(low, 4, 9) + "." + some(dec, 2, 4), "2024-0" + some(dec, 1, 2) + "-1" + some(dec, 1, 2), some(low, 24, 32), "www." + some(low, 6, 12) + ".example/" + some(low, 4, 8) + some(dec, 1, 3), some(low, 6, 10) + "_" + some(dec, 1, 3)][k % 6]
        head, tail = prose() + " ", " " + prose()
        if k % 2:
            head += lead
            out.append((head + value + tail, [(len(head), len(head) + len(value))]))
        else:
            out.append((head + other + tail, []))
    return out


Run = tuple[list[list[str]], list[int]]


def labelled_runs(text: str, secrets: list[Token], most: int | None = None) -> list[Run]:
    """Features and tags of a text's runs of candidates; of more than `most` runs those with the least hashes."""
    whole = text_features(text)
    tokens, numbers = candidates(text)
    runs, out = runs_of(numbers), []
    if most is not None and len(runs) > most:
        runs = sorted(runs, key=lambda r: (zlib.crc32(b"%d" % r[0]), r[0]))[:most]
    spans = sorted(secrets)
    for run in runs:
        tags, last = [], -1
        for at in run:
            s, e = tokens[at]
            k = bisect_right(spans, (e - 1, math.inf)) - 1  # the last that starts before the token's end
            k = k if k >= 0 and s < spans[k][1] else -1
            tags.append(O if k < 0 else I if k == last else B)
            last = k
        out.append(([token_features(text, tokens, at, whole) for at in run], tags))
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, runs_per_text: int = RUNS_PER_TEXT) -> Field:
    """Fit on planted() and on at most sample_rows texts of docs, labelled by the fixed patterns."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    order = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    rows = rows.where(F.col("text").rlike("[0-9]"))
    share = 2 * sample_rows / max(1, rows.count())  # what is sorted stays in proportion to the sample
    some = rows.select("text", order.alias("order_")).where(F.col("order_") < share)
    picked = some.groupBy("order_").agg(F.first("text").alias("text")).orderBy("order_").limit(sample_rows)
    prepare(docs.sparkSession)

    def labelled(batches: Batches) -> Batches:
        for batch in batches:
            found = [r for t in batch.column(0).to_pylist() for r in labelled_runs(t, _value_spans(t, base_spans(t)), runs_per_text)]
            yield pa.record_batch([pa.array([["\t".join(x) for x in fs] for fs, _ in found], pa.list_(pa.string())), pa.array([t for _, t in found], pa.list_(pa.int64()))], ["features", "tags"])

    sample = picked.select("text").mapInArrow(labelled, "features array<string>, tags array<long>").collect()
    runs = [([x.split("\t") for x in r["features"]], list(r["tags"])) for r in sample]
    runs.sort(key=lambda r: (r[0], r[1]))
    for text, spans in planted():
        runs += labelled_runs(text, spans)
    field = Field()
    field.fit(runs)
    return field


def joint(spans: list[Token]) -> list[Token]:
    """The union of spans, as spans apart from each other."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def find(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a text; the field adds those that the fixed patterns' spans don't cover."""
    text = text or ""
    base = base_spans(text)
    tokens, numbers = candidates(text)
    if not numbers:
        return base
    whole, added = text_features(text), []
    for run in runs_of(numbers):
        tags = field.viterbi(field.emissions([token_features(text, tokens, at, whole) for at in run]))
        for at, t in zip(run, tags, strict=True):
            if t == B:
                added.append(list(tokens[at]))
            elif t == I:
                added[-1][1] = tokens[at][1]
    covered = joint([(s, e) for s, _, e in base])
    starts, out = [s for s, _ in covered], []
    for s, e in added:
        k = bisect_right(starts, s) - 1
        if k < 0 or e > covered[k][1]:
            out.append((s, 3, e))
    return sorted(base + out)


def scan(docs: DataFrame, field: Field, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """docs with a column of spans, array<struct<kind, start, end>> in code points, end exclusive; it replaces one of that name."""
    docs = docs.drop(spans)
    spark: SparkSession = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(field)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{spans}` array<struct<kind:string,start:bigint,end:bigint>>"])

    def found(batches: Batches) -> Batches:
        for batch in batches:
            spare_memory()
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, held.value)] for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, spans])

    return docs.mapInArrow(found, schema)


def redacted(text: str, field: Field, mask: str = "[SECRET]") -> str:
    """The text with every secret replaced: of assignments the value, of all other spans the whole."""
    out, last = [], 0
    for s, e in joint(_value_spans(text, find(text, field))):
        out += [text[last:s], mask]
        last = e
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with the secrets in text replaced, in all their columns."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(field)
    at = docs.columns.index(text)

    def replace(batches: Batches) -> Batches:
        for batch in batches:
            spare_memory()
            columns = list(batch.columns)
            columns[at] = pa.array([t if t is None else redacted(t, held.value) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch(columns, batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
