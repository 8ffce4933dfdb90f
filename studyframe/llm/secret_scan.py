"""Operator 6: secrets in texts, by rules and a character convolutional network.

Base rules (kinds assign, access, hex) are exact patterns; their findings always stay.
The network looks at every candidate (a run of 16 or more characters of the kind that
keys are made of, holding a digit and a letter) with its surrounding context (of a long
one at overlapping windows over all of it, the highest of which counts) and adds the candidates that it takes for secrets as kind ``model``, unless a base finding
overlaps them.

It is trained on labelled findings: candidates of the corpus that strict rules settle
as secret (assign, access) or harmless (paths, dates, versions, words), all of them, equal ones
once, and findings made up from key formats and common look-alikes. What one machine should not
hold is dealt by a hash into shards: tasks learn an epoch from a shard each, their networks are
averaged, and the next epoch starts from the average. A held-out part of all findings calibrates
the probability and sets the threshold: the largest one that keeps the wanted recall, of the
corpus's secrets and of the ones made up each, so that a large corpus, whose secrets stand in
assignments, does not crowd out the keys that do not.

Nulls: a null text is empty; a null id passes through. Repeated rows are scanned each;
other columns are not carried by ``scan`` and all are kept by ``redact``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .arrowtext import per_slice, release, strings
from .neural import Adam, calibrate, respond, sigmoid

# The base patterns and their least lengths (of the value, the match, the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so short ones need no match of their own
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "model")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SIDE, HEAD = 24, 20  # characters of context on either side; half of those of the candidate
WINDOW = 2 * SIDE + 2 * HEAD
STEP = 10  # between overlapping windows of a longer candidate
WIDTH, FILTERS = 4, 24
#: Corpus findings of a shard and characters of their excerpts, about.
SHARD, SHARD_CHARS = 8_000, 4 << 20

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


def base_spans(text: str) -> list[Span]:
    """Findings of the base rules by start, then kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that hold a digit and a letter."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            out.append((m.start(), m.end()))
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols of a candidate's first ``2 * HEAD`` characters and their context at fixed places; other characters share one symbol."""
    end = min(end, start + 2 * HEAD)
    before, after = text[max(0, start - SIDE):start], text[end:end + SIDE]
    shown = before.rjust(SIDE, "\0") + text[start:end].ljust(2 * HEAD, "\0") + after.ljust(SIDE, "\0")
    return np.minimum(np.frombuffer(shown.encode("utf-32-le"), np.uint32), 128).astype(np.int16)


def window_starts(start: int, end: int) -> list[int]:
    """Starts of overlapping windows over all of a candidate; any run of ``2 * HEAD - STEP + 1`` characters is whole in one."""
    return [*range(start, end - 2 * HEAD, STEP), max(start, end - 2 * HEAD)]


# ---- the network ------------------------------------------------------------------

def _responses(state: dict, windows: np.ndarray) -> np.ndarray:
    n = len(windows)
    # windows are laid end to end with a gap, so one pass responds to all of them
    flat = np.zeros((n, WINDOW + WIDTH - 1), np.int16)
    flat[:, :WINDOW] = windows
    r = respond(state["taps"], np.append(flat.ravel(), np.zeros(WIDTH - 1, np.int16)))
    return r.reshape(n, WINDOW + WIDTH - 1, -1)[:, :WINDOW]


def _pools(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum over context and over candidate, apart, and where it is."""
    inside = np.s_[:, SIDE:SIDE + 2 * HEAD]
    around = np.concatenate([r[:, :SIDE], r[:, SIDE + 2 * HEAD:]], axis=1)
    a, b = r[inside].argmax(1), around.argmax(1)
    best = np.concatenate([np.take_along_axis(r[inside], a[:, None], 1)[:, 0], np.take_along_axis(around, b[:, None], 1)[:, 0]], 1)
    return best, np.concatenate([a + SIDE, np.where(b < SIDE, b, b + 2 * HEAD)], 1)


def logits(state: dict, windows: np.ndarray) -> np.ndarray:
    if not len(windows):
        return np.zeros(0)
    out = []
    for k in range(0, len(windows), 512):
        best, _ = _pools(_responses(state, windows[k:k + 512]))
        out.append(np.tanh(best + state["shift"]) @ state["weights"] + state["bias"][0])
    return np.concatenate(out).astype(np.float64)


def best_logits(state: dict, findings: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Highest logit over the windows of each (text, start, end), and the first window start that has it.

    A bounded number of windows is held at once.
    """
    best, at = np.full(len(findings), -np.inf), np.zeros(len(findings), np.int64)
    owner, starts, seen = [], [], []

    def judge() -> None:
        for k, s, x in zip(owner, starts, logits(state, np.stack(seen))):
            if x > best[k]:
                best[k], at[k] = x, s
        for held in (owner, starts, seen):
            held.clear()

    for k, (t, a, b) in enumerate(findings):
        for s in window_starts(a, b):
            owner.append(k)
            starts.append(s)
            seen.append(window(t, s, b))
            if len(seen) == 4096:
                judge()
    if seen:
        judge()
    return best, at


def probabilities(model: dict, findings: list[tuple[str, int, int]]) -> np.ndarray:
    """Calibrated probability that each (text, start, end) is, or holds, a secret."""
    return sigmoid(model["scale"] * best_logits(model, findings)[0] + model["offset"])


def _gradients(state: dict, windows: np.ndarray, labels: np.ndarray) -> dict:
    best, place = _pools(_responses(state, windows))
    pooled = np.tanh(best + state["shift"])
    err = (sigmoid(pooled @ state["weights"] + state["bias"][0]) - labels) / len(labels)
    g = err[:, None] * state["weights"] * (1 - pooled ** 2)
    taps = np.zeros_like(state["taps"])
    padded = np.pad(windows, ((0, 0), (0, WIDTH - 1)))
    f = np.broadcast_to(np.tile(np.arange(FILTERS), 2), place.shape)
    for k in range(WIDTH):
        np.add.at(taps[k], (np.take_along_axis(padded, place + k, 1), f), g.astype(np.float32))
    return {"taps": taps, "shift": g.sum(0), "weights": pooled.T @ err + 1e-4 * state["weights"], "bias": np.array([err.sum()])}


def _made_findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label) made up from key formats and look-alikes."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def pick(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def words(k: int, sep: str) -> str:
        return sep.join(pick(lower, int(rng.integers(3, 9))) for _ in range(k))

    secret = (
        lambda: "ghp_" + pick(lower + upper + digits, 36), lambda: "sk-" + pick(lower + upper + digits, 32),
        lambda: "sk_live_" + pick(lower + upper + digits, 24), lambda: pick(lower + upper + digits + "+/", 40),
        lambda: pick(lower + upper + digits, 32), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(lower + upper + digits, 24),
        lambda: "AIza" + pick(lower + upper + digits + "-_", 35), lambda: pick(digits + "abcdef", 40),
        lambda: "eyJ" + pick(lower + upper + digits + "-_", 60))
    harmless = (
        lambda: words(3, "-") + "-" + pick(digits, 4), lambda: words(3, "_") + pick(digits, 2), lambda: "/" + words(3, "/") + "/" + pick(digits, 3),
        lambda: pick(digits, 4) + "-" + pick(digits, 2) + "-" + pick(digits, 2) + "T" + pick(digits, 6) + "Z",
        lambda: "".join(w.capitalize() for w in words(3, " ").split()) + pick(digits, 2), lambda: "v" + pick(digits, 1) + "-" + words(2, "-") + "-linux-x86_64",
        lambda: "ISBN-" + pick(digits, 13), lambda: words(1, "") + "=" + pick(digits, 2) + "/" + words(2, "_"), lambda: "=" * 14 + words(1, "") + pick(digits, 1))
    before = ("key: ", "Authorization: Bearer ", "export KEY=", "", "use ", "\"value\": \"", "with ", "id ", "see ", "at ")
    out = []
    for i in range(n):
        label = i % 2
        value = (secret if label else harmless)[int(rng.integers(0, 9))]()
        lead = words(int(rng.integers(1, 5)), " ") + " " + before[int(rng.integers(0, len(before)))]
        out.append((lead + value + " " + words(3, " "), len(lead), len(lead) + len(value), label))
    return out


def _long_findings(seed: int, n: int) -> list[tuple[str, int, int, int]]:
    """Made-up findings whose candidate goes on before and after the key or look-alike, as in paths and query values."""
    rng = np.random.default_rng(seed + 1)
    made, out = _made_findings(seed + 1, n), []
    look = [t[a:b] for t, a, b, y in made if not y and (t[a:b].startswith("/") or "-" in t[a:b] or "_" in t[a:b])]

    def run() -> str:
        parts = (look[int(rng.integers(0, len(look)))].strip("/") for _ in range(int(rng.integers(1, 4))))
        return "/".join(parts)

    for t, a, b, y in made if look else []:
        value = run() + "/=_-"[int(rng.integers(0, 4))] + t[a:b] + "/=_-"[int(rng.integers(0, 4))] + run()
        out.append((t[:a] + value + t[b:], a, a + len(value), y))
    return out


# Rules for harmless candidates: times and book numbers as a whole; else all parts are words, versions or short numbers.
_WHOLE = re.compile(r"\d{4}-?\d\d-?\d\dT?\d{0,6}Z?|ISBN-?\d{10,13}", re.A)
_SEPARATORS = re.compile(r"[-_/+=]+")
_PART = re.compile(r"((?:[A-Z]?[a-z]{1,12}|[A-Z]{2,10})|(?:[A-Z][a-z]{2,12}){2,6})\d{0,4}|[vVrR]?\d{1,8}|x86|x64|[a-z]", re.A)
_VOWEL = re.compile(r"[aeiouy]", re.I)


def settled_harmless(run: str) -> bool:
    """Whether the rules settle a candidate as harmless: paths, dates, versions and names made of words and short numbers.

    Keys run on without words, so a part of them fails; what fails is not settled, but not a secret by that either.
    """
    if _WHOLE.fullmatch(run):
        return True
    for part in _SEPARATORS.split(run):
        m = _PART.fullmatch(part) if part else None
        if part and (m is None or (m.group(1) and len(m.group(1)) > 4 and not _VOWEL.search(m.group(1)))):
            return False
    return True


def labelled_findings(text: str) -> list[tuple[str, int, int, int]]:
    """Candidates of a text that strict rules settle: assignments and access keys are secrets, words and dates are none.

    All others, such as keys outside assignments, stay unlabelled.
    """
    spans = [s for s in base_spans(text) if s[2] < 2]
    out = []
    for a, b in candidates(text):
        sure = any(s < b and a < e for s, e, _ in spans)
        if sure or (not HEX.search(text, a, b) and settled_harmless(text[a:b])):
            out.append((text[max(0, a - SIDE):b + SIDE], min(a, SIDE), min(a, SIDE) + b - a, int(sure)))
    return out


Finding = tuple[str, int, int, int]  # excerpt, start, end, label


class Lessons:
    """Findings, the first ``corpus`` of them from the corpus, made ready to learn from: two thirds are learnt, the rest is held out."""

    def __init__(self, findings: list[Finding], corpus: int = 0):
        self.findings, self.corpus = findings, corpus
        self.windows = np.stack([window(t, a, b) for t, a, b, _ in findings])
        self.long = np.array([b - a > 2 * HEAD for _, a, b, _ in findings])
        self.y = np.array([f[3] for f in findings], np.float64)
        self.held = np.arange(len(self.y)) % 3 == 2
        self.ours = np.flatnonzero(~self.held)

    def epoch(self, state: dict, adam: Adam, rng: np.random.Generator, first: bool) -> None:
        # of a longer candidate, the window that is most like a secret is learnt from
        own = self.ours[:0] if first else self.ours[self.long[self.ours]]
        for k, at in zip(own, best_logits(state, [self.findings[k][:3] for k in own])[1]):
            self.windows[k] = window(self.findings[k][0], int(at), self.findings[k][2])
        order = rng.permutation(self.ours)
        for k in range(0, len(order), 64):
            own = order[k:k + 64]
            seen = self.windows[own].copy()
            hide = rng.random(len(own)) < 0.5  # half of them without context, so that the key itself counts
            seen[hide, :SIDE] = seen[hide, SIDE + 2 * HEAD:] = 0
            adam.step(_gradients(state, seen, self.y[own]))

    def held_logits(self, state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, labels, whether made up) of what is held out."""
        return best_logits(state, [f[:3] for f, h in zip(self.findings, self.held) if h])[0], self.y[self.held], np.flatnonzero(self.held) >= self.corpus


def _new_state(rng: np.random.Generator) -> dict:
    return {"taps": rng.normal(0, 0.2, (WIDTH, 129, FILTERS)).astype(np.float32), "shift": np.zeros(2 * FILTERS),
            "weights": rng.normal(0, 0.2, 2 * FILTERS), "bias": np.zeros(1)}


def _with_threshold(state: dict, raw: np.ndarray, y: np.ndarray, made: np.ndarray, recall: float) -> dict:
    """The state with calibration and threshold, from held-out logits and labels."""
    scale, shift = calibrate(raw, y)
    p, threshold = sigmoid(scale * raw + shift), 1.0
    for kind in (False, True):
        positive = np.sort(p[(y == 1) & (made == kind)])
        # the largest threshold that still finds the wanted share of held-out secrets; without any, nothing is taken below 1
        if len(positive):
            threshold = min(threshold, float(positive[int(np.floor((1 - recall) * len(positive)))]))
    return state | {"scale": scale, "offset": shift, "threshold": threshold}


def train(findings: list[Finding], recall: float = 0.95, epochs: int = 15, seed: int = 5, corpus: int = 0) -> dict:
    """Fit on two thirds; the rest calibrates and sets the threshold for the wanted recall."""
    rng = np.random.default_rng(seed)
    lessons, state = Lessons(findings, corpus), _new_state(rng)
    adam = Adam(state, 0.01)
    for epoch in range(epochs):
        lessons.epoch(state, adam, rng, not epoch)
    return _with_threshold(state, *lessons.held_logits(state), recall)


def train_shards(corpus: DataFrame, shards: int, made: list[Finding], recall: float = 0.95, epochs: int = 15, seed: int = 5) -> dict:
    """The same from all findings of a table (excerpt, a, b, label, h), dealt into shards by their hash.

    Each shard is taught together with the findings made up, so that no shard is without either
    label. Only networks (0.2 MB a shard and epoch) and held-out logits (9 bytes each) leave the tasks.
    """
    spark = corpus.sparkSession
    dealt = corpus.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(shards)))

    def lessons_of(part: pd.DataFrame) -> Lessons:
        rows = sorted(zip(part["label"].tolist(), part["h"].tolist(), part["excerpt"], part["a"].tolist(), part["b"].tolist()))
        return Lessons([(t, a, b, y) for y, _, t, a, b in rows] + made, len(rows))

    state = _new_state(np.random.default_rng(seed))
    names = list(state)
    moments = [{k: np.zeros_like(v) for k, v in state.items()} for _ in range(2)]
    steps = 0.0
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((state, moments, steps))

        # sent and collected within the epoch
        def learn(part: pd.DataFrame) -> pd.DataFrame:
            own, (m, v), t = shared.value
            own = {k: x.copy() for k, x in own.items()}
            adam = Adam(own, 0.01)
            adam.m, adam.v, adam.t = {k: x.copy() for k, x in m.items()}, {k: x.copy() for k, x in v.items()}, t
            lessons, shard = lessons_of(part), int(part["shard"].iloc[0])
            lessons.epoch(own, adam, np.random.default_rng([seed, epoch, shard]), not epoch)
            learnt = np.concatenate([np.ravel(x[k]).astype(np.float32) for x in (own, adam.m, adam.v) for k in names])
            out = pd.DataFrame([(shard, len(part), float(adam.t), learnt.tobytes())], columns=["shard", "n", "t", "learnt"])
            release()
            return out

        # one network a shard
        got = sorted(dealt.groupBy("shard").applyInPandas(learn, "shard long, n long, t double, learnt binary").collect())
        shared.unpersist()
        share = np.array([r["n"] for r in got], float) / sum(r["n"] for r in got)
        mean = sum(w * np.frombuffer(r["learnt"], np.float32).astype(float) for w, r in zip(share, got))
        steps = float(sum(w * r["t"] for w, r in zip(share, got)))
        at, parts = 0, []
        for _ in range(3):
            part = {}
            for k in names:
                part[k] = mean[at:at + state[k].size].reshape(state[k].shape).astype(state[k].dtype)
                at += state[k].size
            parts.append(part)
        state, moments = parts[0], parts[1:]
    final = spark.sparkContext.broadcast(state)

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        raw, y, invented = lessons_of(part).held_logits(final.value)
        return pd.DataFrame([(int(part["shard"].iloc[0]), raw.astype("<f8").tobytes(), (y + 2 * invented).astype(np.uint8).tobytes())], columns=["shard", "raw", "kind"])

    got = sorted(dealt.groupBy("shard").applyInPandas(judge, "shard long, raw binary, kind binary").collect())
    final.unpersist()
    kind = np.concatenate([np.frombuffer(r["kind"], np.uint8) for r in got])
    return _with_threshold(state, np.concatenate([np.frombuffer(r["raw"], "<f8") for r in got]), (kind % 2).astype(float), kind >= 2, recall)


def fit_secrets(docs: DataFrame, text_col: str = "text", made: int = 3000, recall: float = 0.95, seed: int = 5) -> dict:
    """Train on all labelled findings of the texts, equal ones once, and on ``made`` ones made up.

    Only excerpts around candidates leave the tasks; those of one shard come to the driver, more are learnt in tasks.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [f for t in strings(batch.column(0)) for f in labelled_findings(t)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2, 3))],
                ["excerpt", "a", "b", "label"])
        return work

    found = docs.select(text_col).mapInArrow(per_slice(make, text_col), "excerpt string, a int, b int, label int").distinct()
    # one pass over the texts
    corpus = materialize(found.withColumn("h", F.xxhash64("excerpt", "a", "b", "label")), "findings")
    size = corpus.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("excerpt")).alias("chars")).first()
    shards = max(math.ceil(size["n"] / SHARD), math.ceil((size["chars"] or 0) / SHARD_CHARS))
    invented = _made_findings(seed, made) + _long_findings(seed, made // 4)
    if shards > 1:
        model = train_shards(corpus, shards, invented, recall, seed=seed)
    else:
        rows = sorted((r["label"], r["h"], r["excerpt"], r["a"], r["b"]) for r in corpus.collect())  # one shard
        model = train([(t, a, b, y) for y, _, t, a, b in rows] + invented, recall, seed=seed, corpus=len(rows))
    discard(corpus)
    return model


def find_spans(texts: list[str], model: dict | None) -> list[list[Span]]:
    """All findings of each text by start, then kind."""
    found = [base_spans(t) for t in texts]
    if model is None:
        return found
    asked = []
    for k, t in enumerate(texts):
        asked += [(k, a, b) for a, b in candidates(t) if not any(s < b and a < e for s, e, _ in found[k])]
    if asked:
        p = probabilities(model, [(texts[k], a, b) for k, a, b in asked])
        for (k, a, b), x in zip(asked, p):
            if x >= model["threshold"]:
                found[k].append((a, b, 3))
        for k in {k for k, _, _ in asked}:
            found[k].sort(key=lambda s: (s[0], s[2]))
    return found


def scan(df: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, findings (array of kind, start, end, value; code points)."""
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "value": t[a:b]} for a, b, k in spans]
                    for t, spans in zip(texts, find_spans(texts, model))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], [id_col, "findings"])
        return work

    schema = f"`{id_col}` {kind}, findings array<struct<kind string, start bigint, end bigint, value string>>"
    return df.select(id_col, text_col).mapInArrow(per_slice(make, text_col), schema)


def mask(text: str, spans: list[Span], put: str) -> str:
    """The text with every stretch of overlapping findings replaced."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: dict | None, text_col: str = "text", put: str = "[secret]") -> DataFrame:
    """All rows and columns, with findings in the text replaced; texts without findings stay as they are."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    place = df.columns.index(text_col)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(place)
            texts = strings(column)
            spans = find_spans(texts, model)
            if any(spans):
                new = [mask(t, s, put) if s else old for t, s, old in zip(texts, spans, column.to_pylist())]
                column = pa.array(new, column.type)
            return pa.RecordBatch.from_arrays([column if k == place else c for k, c in enumerate(batch.columns)], batch.schema.names)
        return work

    return df.mapInArrow(per_slice(make, text_col), fields)
