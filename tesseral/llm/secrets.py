"""Secret scan: fixed patterns plus a linear-chain conditional random field.

Tokens (words between white space) are tagged B, I or O. Emissions come from the
token's shape, the neighbouring words and features of the whole file; the best
tag sequence is found by Viterbi. The field is trained here, by its conditional
likelihood, on a bounded sample of documents whose tags come from the patterns,
and on generated lines with kinds of secrets that the patterns don't know.

Tokens without an ASCII digit, or of fewer than eight characters, are *plain*; they
may be tagged like others. Every token counts in the best sequence, with the weights
as trained. Far from *loud* tokens (those that can switch a feature on, their own or
a neighbour's) all tokens have the same features; where the weights prove that such
a token is O whatever its neighbours are, the runs between are decoded apart, which
gives the same tags. Where they don't, the whole text is decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.plans.workers import lean

KINDS = ("assign", "access", "hex", "crf")
# Patterns fixed by the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_HINTS = ("password", "passwd", "secret", "token", "key")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_SPACE = frozenset(" \t\n\v\f\r")
_KEYWORDS = re.compile(r"(?:pass(?:word|wd)?|secret|token|api_?key|key|bearer|credential|auth|private)s?\W*$", re.I | re.A)
_MARK = re.compile(r"[0-9=:@/+_\"'`-]")
_STEMS = ("pass", "secret", "token", "key", "bearer", "credential", "auth", "private")
_STEM = re.compile("|".join(_STEMS), re.I | re.A)
_REACH = 4  # plain tokens trained on at each side
_AROUND = 1  # short plain words decoded at each end of a run
_TAGS = 3  # O, B, I


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of what the fixed patterns match."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):  # a keyword has to be there for a match
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    at = 0
    while m := _LONG_HEX.search(text, at):  # the maximal run that starts here
        at = _HEX.match(text, m.start()).end()
        out.append((m.start(), 2, at))
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SHAPES = ("plain", "hex", "mixed", "upper_digit", "lower_digit", "numeric", "other")
_LENGTHS = (8, 12, 16, 20, 32, 64)
_N_FEATURES = len(_SHAPES) + len(_LENGTHS) + 1 + 3 + 3 + 1 + 2 + 3 + len(_LENGTHS) - 1


def _shape(word: str) -> int:
    core = word.strip("\"'`,.;:!?()[]{}<>#$%&*|")
    if len(core) < 8 or not _DIGIT.search(core):
        return 0
    if re.fullmatch(r"[0-9a-f]+", core) and re.search(r"[a-f]", core):
        return 1
    lower, upper = re.search(r"[a-z]", core), re.search(r"[A-Z]", core)
    if lower and upper:
        return 2
    return 3 if upper else 4 if lower else 5 if re.fullmatch(r"[0-9.,:/%+-]+", core) else 6


@lru_cache(50_000)
def _word(word: str) -> tuple[int, list[int], list[int], bool, bool]:
    """Shape, features of shape and length, further own features, and whether the
    word is a keyword or ends in an assignment."""
    shape, core = _shape(word), word.strip("\"'`,.;:!?()[]{}<>#$%&*|")
    size = sum(len(core) >= x for x in _LENGTHS[1:])
    form, own, at = [shape], [], len(_SHAPES)
    if shape:
        form.append(at + size)
        form += [at + len(_LENGTHS)] * (len(set(core)) >= 0.4 * min(len(core), 40))
    at = _N_FEATURES - (len(_LENGTHS) - 1) - 3
    own += [at] * bool(re.search(r"[@/]|://", word)) + [at + 1] * bool(re.search(r"[+/=_-]", word)) + [at + 2] * (word[:1] in "\"'`")
    if not shape and size:  # letters only: how many
        own.append(at + 3 + size - 1)
    return shape, form, own, bool(_KEYWORDS.search(word)), word[-1:] in ("=", ":")


_NO_WORD = (0, [], [], False, False)
_ASSIGNED = re.compile(r"(?:pass|secret|token|key|auth|sig)\w*[\"']?[=:]", re.I | re.A)


def token_features(words: list[str], has_keyword: bool, digit_share: float, which: range | None = None) -> list[list[int]]:
    """Numbers of the features that are on, for each token, or for some of them."""
    out = []
    known = [_word(w) for w in words]
    first = len(_SHAPES) + len(_LENGTHS) + 1
    file = [first + 7] * has_keyword + [first + 8] * (digit_share > 0.05)
    for i in range(len(words)) if which is None else which:
        shape, form, own, *_ = known[i]
        on = [*form]
        before, two = known[i - 1] if i else _NO_WORD, known[i - 2] if i > 1 else _NO_WORD
        on += [first] * before[3] + [first + 1] * before[4] + [first + 2] * (not i)
        on += [first + 3] * (two[3] and words[i - 1] in ("=", ":", "is", "=>", ":=")) + [first + 4] * (before[0] > 0)
        on += [first + 5] * bool(("=" in words[i] or ":" in words[i]) and _ASSIGNED.search(words[i]))
        on += [first + 6] * (i + 1 < len(words) and known[i + 1][0] > 0)
        out.append([*on, *file, *own])
    return out


def text_tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _joined(spans) -> list[tuple[int, int]]:
    """Ranges of places (first, last) in order, those that meet made one."""
    out: list = []
    for a, b in spans:
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def loud_runs(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens (first, last) outside of which each token and ``_AROUND`` on
    each side have the features of a short plain word among such words. A token's
    features come from it, two tokens before and one after."""
    hits = [m.start() for m in _MARK.finditer(text)]
    lowered = text.lower()
    if any(h in lowered for h in _STEMS):
        hits += [m.start() for m in _STEM.finditer(text)]
    starts = [a for a, _ in tokens]
    loud = {bisect_right(starts, h) - 1 for h in hits}
    loud.update(i for i, (a, b) in enumerate(tokens) if b - a >= _LENGTHS[1])
    last = len(tokens) - 1
    inner = [(max(0, i - 1 - _AROUND), min(last, i + 2 + _AROUND)) for i in sorted(loud)]
    return _joined([(0, min(last, _AROUND)), *inner, (max(0, last - _AROUND), last)])


def _file_features(text: str) -> tuple[bool, float]:
    lowered = text.lower()
    raw = text.encode("utf-8", "surrogatepass")
    return any(h in lowered for h in _HINTS), (len(raw) - len(raw.translate(None, b"0123456789"))) / max(len(raw), 1)


@dataclass
class SecretField:
    """Weights: ``emit`` (tag, feature), ``move`` (tag, next tag), ``first`` (tag)."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    known: dict = field(default_factory=dict, repr=False, compare=False)  # emissions, by features

    def _emission(self, on: list[int]) -> list[float]:
        key = tuple(on)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self.emit[:, on].sum(axis=1).tolist()
        return self.known[key]

    def decode(self, on: list[list[int]], start: bool = True, end: bool = True) -> list[int]:
        """The best tags of tokens, by Viterbi; ties go to the smaller tag. Without
        ``start`` (``end``) an O stands before (after) them."""
        move, every = self.move.tolist(), range(_TAGS)
        row = self._emission(on[0])
        best, back = [(self.first[t] if start else move[0][t]) + row[t] for t in every], []
        for f in on[1:]:
            row, paths, frm = self._emission(f), [], []
            for t in every:
                a, b, c = best[0] + move[0][t], best[1] + move[1][t], best[2] + move[2][t]
                p, top = (0, a) if a >= b and a >= c else (1, b) if b >= c else (2, c)
                paths.append(top + row[t])
                frm.append(p)
            best = paths
            back.append(frm)
        if not end:
            best = [best[t] + move[t][0] for t in every]
        tags = [best.index(max(best))]
        for frm in reversed(back):
            tags.append(frm[tags[-1]])
        return tags[::-1]

    def quiet(self, has_keyword: bool, digit_share: float) -> bool:
        """Among short plain words, is one with ``_AROUND`` of them on each side O in
        the best sequence, whatever tags stand before and behind these?"""
        e = self._emission(token_features(["a"] * 4, has_keyword, digit_share, range(2, 3))[0])
        step, best = self.move + np.array(e), lambda x, y: (x[:, :, None] + y[None]).max(axis=1)
        before, behind = step, self.move
        for _ in range(_AROUND):
            before, behind = best(before, step), best(step, behind)
        paths = before[:, :, None] + behind[None]  # tag before all, own tag, tag behind all
        return bool((paths[:, 0] > paths[:, 1:].max(axis=1) + 1e-6).all())

    def tags(self, text: str, tokens: list[tuple[int, int]], whole: bool = False) -> dict[int, int]:
        """Tags other than O by the token's place; ``whole`` decodes in one piece."""
        last = len(tokens) - 1
        if last < 0:
            return {}
        file = _file_features(text)
        key = ("quiet", file[0], file[1] > 0.05)
        if key not in self.known:
            self.known[key] = self.quiet(*file)
        found = {}
        for a, b in loud_runs(text, tokens) if self.known[key] and not whole else [(0, last)]:
            lo = max(0, a - 2)
            words = [text[x:y] for x, y in tokens[lo : b + 2]]
            got = self.decode(token_features(words, *file, range(a - lo, b + 1 - lo)), a == 0, b == last)
            found |= {a + k: t for k, t in enumerate(got) if t}
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = text_tokens(text)
        tags = self.tags(text, tokens)
        out = []
        for k, tag in tags.items():
            a, b = tokens[k]
            if tag == 1 or k - 1 not in tags:
                out.append([a, b])
            else:
                out[-1][1] = b
        trimmed = []
        for a, b in out:
            part = text[a:b]
            a += len(part) - len(part.lstrip("\"'`([{<"))
            b -= len(part) - len(part.rstrip("\"'`,.;:!?)]}>#$%&*|"))
            if a < b:
                trimmed.append((a, b))
        return trimmed


def all_spans(text: str, field: SecretField) -> tuple[list, list]:
    """The patterns' spans, and these with the field's spans, whole, of which some
    character lies outside them."""
    base = base_spans(text)
    more = []
    for a, b in field.spans(text):
        at = a  # the first character that no pattern covers
        for x, _, y in base:
            if x <= at < y:
                at = y
        if at < b:
            more.append((a, 3, b))
    return base, sorted(base + more)


def _examples(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """Tokens near those that are not plain or in which a match ends, with tags from
    the patterns: B where a match ends."""
    base, tokens = base_spans(text), text_tokens(text)
    if not base and not _DIGIT.search(text):
        return []
    file, words = _file_features(text), [text[a:b] for a, b in tokens]
    tags = [int(any(a < e <= b or a <= s < b and k > 0 for s, k, e in base)) for a, b in tokens] if base else [0] * len(tokens)
    last = len(tokens) - 1
    near = [(max(0, i - _REACH), min(last, i + _REACH)) for i, w in enumerate(words) if tags[i] or len(w) >= 8 and _DIGIT.search(w)]
    return [(token_features(words, *file, range(a, b + 1)), tags[a : b + 1]) for a, b in _joined(near)]


def _generated(n: int = 240, seed: int = 5) -> list[tuple[list[list[int]], list[int]]]:
    """Lines with secrets, some of several tokens, and lines with harmless numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    alnum, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    out = []
    for i in range(n):
        words, tags = [pick(low, int(rng.integers(2, 9))) for _ in range(int(rng.integers(3, 7)))], []
        tags = [0] * len(words)
        kind = i % 6
        if kind < 3:
            lead = [["key", "="], ["Bearer"], ["secret:"], ["auth", ":"], ["password", "is"]][int(rng.integers(5))]
            body = [pick(alnum, int(rng.integers(20, 44))) + "1" for _ in range(1 if kind < 2 else int(rng.integers(2, 4)))]
            words, tags = words + lead + body, tags + [0] * len(lead) + [1] + [2] * (len(body) - 1)
        else:
            body = [f"{rng.integers(1900, 2030)}-{rng.integers(1, 12):02d}-{rng.integers(1, 28):02d}", f"https://{pick(low, 8)}.example/{pick(low, 4)}{rng.integers(10, 10**6)}", f"{rng.integers(10**6, 10**9)}", f"{pick(low, 7)}{rng.integers(10, 99)}", f"{pick(low, 5)}.{rng.integers(10, 99)}@mail.example", f"+{rng.integers(10, 99)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"][int(rng.integers(6))]
            words, tags = [*words, body], [*tags, 0]
        tail = [pick(low, int(rng.integers(2, 9))) for _ in range(4)]
        text_share = sum(c.isdigit() for w in words for c in w) / sum(map(len, words))
        out.append((token_features(words + tail, kind < 3 or bool(rng.integers(2)), text_share), tags + [0] * 4))
    letters = alnum[:52]
    for i in range(n):  # secrets of letters only, plain words within secrets, and words that are none
        words = [pick(low, int(rng.integers(2, 12))) for _ in range(int(rng.integers(3, 7)))]
        lead = [["key", "="], ["Bearer"], ["secret:"], ["auth", ":"], ["password", "is"]][int(rng.integers(5))]
        kind = i % 6
        if kind < 2:
            body = [pick((letters, low)[kind], int(rng.integers(18, 44)))]
        elif kind == 2:
            body = [pick(alnum, int(rng.integers(20, 44))) + "1", pick(low, int(rng.integers(3, 10))), pick(alnum, int(rng.integers(20, 44))) + "1"]
        else:
            body = [pick(low, int(rng.integers(2, 14)))] if kind < 5 else [pick(low, int(rng.integers(12, 50)))]
            lead = lead if kind < 5 else []
        tail = [pick(low, int(rng.integers(2, 12))) for _ in range(4)]
        tags = [0] * (len(words) + len(lead)) + ([1] + [2] * (len(body) - 1) if kind < 3 else [0]) + [0] * 4
        out.append((token_features(words + lead + body + tail, kind < 5 or bool(rng.integers(2)), 0.0), tags))
    return out


def fit_field(examples: list[tuple[list[list[int]], list[int]]], steps: int = 150, ridge: float = 1e-3) -> SecretField:
    """Maximise the conditional likelihood by gradient steps (Adam), over all
    windows at once, padded to the longest (cut into pieces of 24 tokens)."""
    pieces = [(f[a : a + 24], t[a : a + 24]) for f, t in examples for a in range(0, len(t), 24)]
    pieces = [(f, [1 if y == 2 and k == 0 else y for k, y in enumerate(t)]) for f, t in pieces]
    n, m = len(pieces), max(len(t) for _, t in pieces)
    x = np.zeros((n, m, _N_FEATURES), np.float32)
    y, on = np.zeros((n, m), int), np.zeros((n, m), bool)
    for i, (f, t) in enumerate(pieces):
        for k, fs in enumerate(f):
            x[i, k, fs] = 1
        y[i, : len(t)], on[i, : len(t)] = t, True
    hot = np.eye(_TAGS)[y] * on[:, :, None]
    pairs = np.einsum("nka,nkb->ab", hot[:, :-1], hot[:, 1:])
    parts = [np.zeros((_TAGS, _N_FEATURES)), np.zeros((_TAGS, _TAGS)), np.zeros(_TAGS)]
    parts[1][0, 2] = parts[2][2] = -30.0  # a secret doesn't begin inside
    frozen = [np.zeros_like(p, bool) for p in parts]
    frozen[1][0, 2] = frozen[2][2] = True
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        emit = x @ parts[0].T
        alpha, beta = np.zeros((n, m, _TAGS)), np.zeros((n, m, _TAGS))
        lse = lambda v, axis: (top := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - top).sum(axis=axis))
        alpha[:, 0] = parts[2] + emit[:, 0]
        for k in range(1, m):
            alpha[:, k] = np.where(on[:, k, None], lse(alpha[:, k - 1, :, None] + parts[1], 1) + emit[:, k], alpha[:, k - 1])
        for k in range(m - 2, -1, -1):
            beta[:, k] = np.where(on[:, k + 1, None], lse(parts[1] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        both = alpha[:, :-1, :, None] + parts[1] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        moves = (np.exp(np.minimum(both, 0)) * on[:, 1:, None, None]).sum(axis=(0, 1))
        slopes = [np.einsum("nka,nkf->af", hot - p, x), pairs - moves, (hot[:, 0] - p[:, 0]).sum(axis=0)]
        for q, (w, g) in enumerate(zip(parts, slopes)):
            g = np.where(frozen[q], 0, g / n - ridge * w)
            mean[q], square[q] = 0.9 * mean[q] + 0.1 * g, 0.99 * square[q] + 0.01 * g**2
            w += 0.15 * (mean[q] / (1 - 0.9**step)) / (np.sqrt(square[q] / (1 - 0.99**step)) + 1e-8)
    emit, move, first = parts
    emit -= emit[0]  # relative to O
    return SecretField(emit.round(9), move.round(9), first.round(9))


def learn_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4_000, max_windows: int = 3_000) -> SecretField:
    """Train on about ``max_docs`` documents chosen by a hash of the id, of which at
    most ``max_windows`` windows count, and on the generated lines. Works for an
    empty table, too."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * min(1, max_docs / max(n, 1)))).select("text")

    def run(batches):
        for batch in batches:
            found = [e for t in batch.column(0).to_pylist() for e in _examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([t for _, t in found], pa.list_(pa.int32()))], names=["on", "tags"])

    schema = "on array<array<int>>, tags array<int>"
    sample = rows.mapInArrow(lean(run), schema).orderBy(F.xxhash64(F.to_json(F.struct("on", "tags"))), F.to_json("on")).limit(max_windows)
    return fit_field([(r.on, r.tags) for r in sample.toLocalIterator()] + _generated())  # at most max_windows rows


def scan_secrets(docs: DataFrame, field: SecretField, text_col: str = "text", redacted_col: str | None = None) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and
    ``spans``; with ``redacted_col`` also the text whose spans are replaced by
    ``[SECRET]``. Null texts count as empty (their redacted text stays null). Old
    columns of these names are replaced; one row out for each row in."""
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + [redacted_col] * bool(redacted_col)
    docs = docs.select("*") if redacted_col == text_col else docs
    kept = [c for c in docs.columns if c not in added]
    source = docs.select(*kept, F.col(text_col).alias("__text"))
    at = len(kept)

    def clean(text, spans):
        if text is None:
            return None
        parts, end = [], 0
        for a, _, b in spans:
            if a >= end:
                parts += [text[end:a], "[SECRET]"]
            end = max(end, b)
        return "".join(parts) + text[end:]

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [all_spans(t or "", field) for t in texts]
            cols = [pa.array([sum(k == q for _, k, _ in base) for base, _ in found], pa.int64()) for q in range(3)]
            cols.append(pa.array([sha256(digest(base).encode()).hexdigest() for base, _ in found], pa.string()))
            cols.append(pa.array([digest(spans) for _, spans in found], pa.string()))
            if redacted_col:
                cols.append(pa.array([clean(t, spans) for t, (_, spans) in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *cols], names=[*kept, *added])

    kinds = [T.LongType()] * 3 + [T.StringType()] * (2 + bool(redacted_col))
    schema = T.StructType([*source.select(*kept).schema.fields, *(T.StructField(c, k) for c, k in zip(added, kinds))])
    return source.mapInArrow(lean(run), schema)
