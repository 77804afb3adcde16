"""Secret scanning with a random forest that removes false positives.

Candidates are runs of key-like characters, private-key blocks and what is assigned to key words, found in every whole text. Each has features
of its own characters (length, kinds of characters and the transitions between them, entropy, share of characters
that dictionary words and letter pairs cover), of its path (the document's source or path, and path signs around
it) and of the words before and after. A forest of Gini trees, grown here with numpy, scores it; the labelled
findings it is trained on come from a seeded generator of secrets and of look-alikes in their contexts (`findings`), or
from the caller. Candidates that score `KEEP` or more are secrets.

Edges: null and empty texts have no findings; equal candidates are judged place by place; overlapping candidates are
one; null paths are empty; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_rows, field, mapped, with_own

#: What a candidate may look like.
CANDIDATE = re.compile(
    # Blocks with header lines or without; where the end is missing, as far as their lines go.
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr])*[A-Za-z][A-Za-z\-]*:\x20[^\n\\]*(?:\s|\\[nr])+)*"
    r"(?:[A-Za-z0-9+/=\s\\]*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\s|\\[nr])+=?[A-Za-z0-9+/]+={0,2}(?=\s*(?:\n|$)|\\[nr]|[\"'`]))?)"
    r"|(?<![A-Za-z0-9_\-+/=.])[A-Za-z][A-Za-z0-9_\-]*\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"|(?<![A-Za-z0-9_\-+/])(?=[A-Za-z_\-+/]{0,200}[0-9])[A-Za-z0-9_\-+/]{12,}={0,2}"
)
#: What is assigned to a key word is a candidate whatever its characters.
ASSIGNED = re.compile(
    r"(?:passw(?:or)?d|pwd|secret|token|api[_\-]?key|credentials?|authorization|bearer|(?<![a-z])(?:auth|key|access|private)(?![a-z])|access[_\-]?key|private[_\-]?key)"
    r"[a-z0-9_\-]{0,24}[\"'`\]]{0,2}\s{0,8}(?::=|=>|==?|:|\bis\b)\s{0,8}(?:(?:bearer|basic)\s{1,8})?"
    r"(?:\"(?P<a>[^\"\n]{6,})\"|'(?P<b>[^'\n]{6,})'|`(?P<c>[^`\n]{6,})`|(?P<d>[^\s\"'`]{6,}))",
    re.I,
)
#: Words beside secrets, words beside look-alikes, issuers' prefixes.
KEY_WORDS = frozenset("token secret password passwd pwd apikey api_key key auth authorization bearer credential credentials private access_key secret_key client_secret access".split())
HARMLESS = frozenset("commit sha sha1 sha256 md5 checksum digest hash etag revision uuid guid id build version integrity hex color order invoice isbn phone card account file image data trace request session".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "sk-", "AIza", "eyJ", "SG.", "glpat-", "npm_", "pypi-", "ya29.", "hf_")
TEST_PATH = re.compile(r"test|example|sample|fixture|mock|lock|vendor|docs?/|\.md$|\.min\.", re.I)
#: A small dictionary for the coverage of candidates by words.
WORDS = frozenset(
    "the and for with this that from have not are was you all can has new get set name user users file files path data list item index page view test main "
    "class value values type string number object array function return import export default config server client service manager handler controller model "
    "message request response error event time date message option options table column model state action update create delete remove insert select order "
    "license version home image images style content header footer button title label input output result key token secret password example your api access "
    "public private static final void null true false package module source target build release debug info level base code text link next last first".split()
)
KEEP = 0.5
TREES, DEPTH, SEED = 24, 9, 11
NAMES = ("length", "digits", "lower", "upper", "signs", "transitions", "entropy", "hex_only", "words", "pairs", "longest_letters", "repeats", "prefix", "key_before", "harmless_before", "key_after", "assigned", "quoted", "in_path", "test_path", "placeholder", "groups")


def _kinds(s: str) -> str:
    return "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in s)


def coverage(s: str) -> float:
    """Share of the letters that dictionary words of three letters and more cover, longest first from the left."""
    low, i, hit, letters = s.lower(), 0, 0, sum(c.isalpha() for c in s)
    while i < len(low):
        for n in range(min(10, len(low) - i), 2, -1):
            if low[i : i + n] in WORDS:
                hit, i = hit + n, i + n
                break
        else:
            i += 1
    return hit / max(1, letters)


#: The commonest letter pairs of European languages.
PAIRS = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ie ge un ei el la os do ue ad ta me ic co io ns".split())


def features(text: str, start: int, end: int, path: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    kinds = _kinds(s)
    counts = {c: s.count(c) for c in set(s)}
    low = s.lower()
    letters = re.findall(r"[a-z]+", low)
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    ahead = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*", before)[-4:]]
    behind = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_]*", after)[:2]]
    parts = [p for w in ahead for p in (w, *w.split("_"))]
    pairs = sum(low[i : i + 2] in PAIRS for i in range(n - 1))
    return [
        n, kinds.count("d") / n, kinds.count("l") / n, kinds.count("u") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        float(all(c in "0123456789abcdef" for c in low)),
        coverage(s), pairs / max(1, n - 1), max(map(len, letters), default=0),
        max(counts.values()) / n, float(s.startswith(PREFIXES) or s.startswith("-----BEGIN")),
        float(bool(KEY_WORDS & set(parts))), float(bool(HARMLESS & set(parts))), float(bool(KEY_WORDS & set(behind))),
        float(bool(re.search(r"(?::|=|=>|\bis)\s*[\"'`]?$", before))), float(before[-1:] in "\"'`" and before != "" and after[:1] == before[-1:]),
        float(before[-1:] in "/\\.@#" and before != "" or after[:1] in "/\\@" and after != "" or s.count("/") >= 3 and "+" not in s), float(bool(TEST_PATH.search(path))),
        float(bool(re.search(r"x{6}|example|your|changeme|placeholder|0{8}|1234567|abcdef", low))),
        float(len(re.split(r"[-_/]", s))),
    ]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places of candidates, ascending; those that overlap are one."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    for m in ASSIGNED.finditer(text):
        start, end = m.span(m.lastgroup)
        if m.lastgroup == "d":  # signs that end a clause are not part of the value
            end = max(start + 6, start + len(m["d"].rstrip(",;")))
        found.append((start, end))
    held: list[int] = []
    for start, end in sorted(found):
        if held and start < held[1]:
            held[1] = max(held[1], end)
        else:
            if held:
                yield held[0], held[1]
            held = [start, end]
    if held:
        yield held[0], held[1]


@lru_cache(2)
def findings(n: int = 4000, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of generated findings: half secrets, half look-alikes, in contexts of their kind."""
    r = random.Random(seed)
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    syllables = "an re th er on in es ti le la de ou en st or sch ver keit cion ment able".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    secret = [
        lambda: some(hexa, r.choice((32, 40, 40, 64))), lambda: some(alnum, r.randint(20, 48)), lambda: some(b64, 40),
        lambda: r.choice(("ghp_", "gho_")) + some(alnum, 36), lambda: "AKIA" + some(string.ascii_uppercase + "234567", 16), lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24),
        lambda: "sk_live_" + some(alnum, 24), lambda: "AIza" + some(alnum + "_-", 35), lambda: "eyJ" + some(alnum, 20) + ".eyJ" + some(alnum, 40) + "." + some(alnum + "_-", 43),
        lambda: some(alnum, 8) + r.choice("_-") + some(alnum, 10), lambda: "-----BEGIN RSA PRIVATE KEY-----",
        lambda: f"-----BEGIN {r.choice(('RSA ', 'EC ', '', 'PGP '))}PRIVATE KEY-----\n" + "\n".join(some(b64, 64) for _ in range(r.randint(1, 20))),
        lambda: some(string.ascii_letters, r.randint(16, 40)),
    ]
    #: Passwords that people choose.
    chosen = [
        lambda: word().title() + some(string.digits, r.randint(1, 4)) + r.choice(("!", "?", "#", "")), lambda: word() + some(string.digits, r.randint(1, 3)),
        lambda: word()[:3].title() + some(string.digits, 1) + word()[:3] + some(string.digits, 1) + word()[:3] + r.choice("&!$%@") + some(alnum, 2), lambda: some(alnum + "!$%&*?#", r.randint(8, 14)),
    ]
    names = ["token", "secret", "password", "api_key", "apiKey", "access_key", "client_secret", "Authorization: Bearer", "auth_token", "private_key", "SECRET_KEY", "passwd"]
    fake = [
        lambda: "-".join((some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12))), lambda: some(hexa, r.choice((40, 64, 32))), lambda: some(string.digits, r.randint(12, 19)),
        lambda: "/".join(word() for _ in range(4)) + str(r.randint(1, 999)), lambda: "_".join(word() for _ in range(4)) + str(r.randint(1, 99)), lambda: word().title() + word().title() + word().title() + str(r.randint(1, 9999)),
        lambda: "your_api_key_" + some("x1", 12), lambda: "x" * 16 + "1234567890", lambda: some(b64, r.randint(60, 200)), lambda: word() + "-" + word() + "-" + str(r.randint(2000, 2030)) + "-" + word() + "-" + word(), lambda: "0" * 20 + some(string.digits, 8),
        lambda: some("01", 24), lambda: "+" + some(string.digits, 12), lambda: r.choice(("AKIA", "ghp_")) + "EXAMPLE" * 3 + "1",
    ]
    labels = ["commit", "sha256:", "md5", "checksum =", "uuid:", "id =", "digest:", "order", "file", "image/png;base64,", "see", "version", "etag:", "request id:", "card", "revision", "and", "in"]
    rows, marks = [], []
    for i in range(n):
        good = i % 2 == 0
        value = r.choice(secret if good else fake)()
        if r.random() < 0.2:
            own = r.choice(names)
            if good:
                value = r.choice(chosen)()
                while len(value) < 6:
                    value += r.choice(string.digits)
                lead, q = own + r.choice((" = ", "=", ": ", ":")), r.choice(('"', "'", "", '"'))
            else:
                value = r.choice((word() + word(), "required", "string", "changeme", "your_" + own, f"os.environ[{own}]", f"get_{word()}({word()})", f"${{{own.upper()}}}", "self." + own, f"{word()}.{word()}", f"<{own}>", prose(3) + " " + word()))
                while len(value) < 6:
                    value += word()
                lead, q = own + r.choice((" = ", "=", ": ", " is ")), r.choice(('"', "", "", ""))
        elif good:
            lead = r.choice(("", "", "see ", "file ", "id ")) if value.startswith("-----") else f"{r.choice(names)}{r.choice((' = ', '=', ': ', ' '))}"
            if value.startswith(("ghp_", "AKIA", "xoxb", "sk_live", "AIza", "eyJ")) and r.random() < 0.5:
                lead = r.choice(("", "use ", "key "))
            q = r.choice(('"', "'", "", '"'))
        else:
            lead, q = r.choice(labels) + r.choice((" ", "=", ": ", " = ")) if r.random() < 0.8 else "", r.choice(('"', "", "", ""))
            if re.search(r"your|x{6}|EXAMPLE", value) and r.random() < 0.6:
                lead = f"{r.choice(names)} = "
        head, path = prose(r.randint(0, 8)) + " ", r.choice(("", "", "src/app.py", "test/fixtures/a.json", "package.lock", "src0", "config.env"))
        text = f"{head}{lead}{q}{value}{q} {prose(r.randint(0, 6))}"
        start = len(head) + len(lead) + len(q)
        rows.append(features(text, start, start + len(value), path)), marks.append(float(good))
    return np.array(rows), np.array(marks)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child (right is next), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] > threshold[at]
                at = np.where(inner, left[at] + go, at)
            total += share[at]
        return total / len(self.trees)


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
    best = (np.inf, -1, 0.0)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, hit = x[order, c], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n, left = len(y), cut + 1
        p, q = hit[cut] / left, (hit[-1] - hit[cut]) / (n - left)
        gini = left * p * (1 - p) + (n - left) * q * (1 - q)
        i = int(gini.argmin())
        if gini[i] < best[0]:
            best = (float(gini[i]), int(c), float((v[cut[i]] + v[cut[i] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            at, part, level = todo.pop()
            share = float(y[part].mean())
            nodes[at][3] = share
            if level == depth or len(part) < 8 or share in (0.0, 1.0):
                continue
            _, c, t = _split(x[part], y[part], rng.permutation(x.shape[1])[: max(2, int(x.shape[1] ** 0.5) + 1)])
            if c < 0:
                continue
            nodes[at][:3] = [c, t, len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            go = x[part, c] > t
            todo += [(nodes[at][2], part[~go], level + 1), (nodes[at][2] + 1, part[go], level + 1)]
        a = list(zip(*nodes, strict=True))
        out.append((np.array(a[0]), np.array(a[1]), np.array(a[2]), np.array(a[3])))
    return Forest(out)


@lru_cache(1)
def trained() -> Forest:
    return grow(*findings())


def scan(text: str, path: str = "", forest: Forest | None = None, keep: float = KEEP) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of candidates, and (start, end, score) of the secrets, in code points."""
    spans = list(candidates(text))
    if not spans:
        return 0, []
    scores = (forest or trained()).score(np.array([features(text, a, b, path) for a, b in spans]))
    return len(spans), [(a, b, round(float(p), 6)) for (a, b), p in zip(spans, scores, strict=True) if p >= keep]


MASK = "[SECRET]"
FINDING = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType()))


def scanned_rows(docs: DataFrame, path: str = "source", forest: Forest | None = None, keep: float = KEEP, mask: str = MASK) -> DataFrame:
    """docs as `row` (see `as_rows`) with n_candidates, findings and clean_text, in which secrets are replaced by the mask."""
    rows = as_rows(docs)
    kind = rows.schema["row"].dataType
    text_at, path_at = field(kind, "text"), field(kind, path)
    held = docs.sparkSession.sparkContext.broadcast(forest or trained())  # grown once, on the driver

    def look(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, model = batch.column("row"), held.value
        texts = pa.compute.struct_field(row, [text_at]).to_pylist()
        paths = pa.compute.struct_field(row, [path_at]).to_pylist() if path_at >= 0 else [""] * batch.num_rows
        number, found, clean = [], [], []
        for text, where in zip(texts, paths, strict=True):
            if not text:
                number.append(0), found.append([]), clean.append(text)
                continue
            n, spans = scan(text, str(where or ""), model, keep)
            number.append(n), found.append([{"start": a, "end": b, "score": p} for a, b, p in spans])
            for a, b, _ in reversed(spans):
                text = text[:a] + mask + text[b:]
            clean.append(text)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([row, pa.array(number, pa.int64()), pa.array(found, spans), pa.array(clean, pa.string())], ["row", "n_candidates", "findings", "clean_text"])

    return mapped(rows, look, T.StructType([*rows.schema.fields]).add("n_candidates", T.LongType()).add("findings", FINDING).add("clean_text", T.StringType()))


def scanned(docs: DataFrame, path: str = "source", forest: Forest | None = None, keep: float = KEEP, mask: str = MASK) -> DataFrame:
    """docs with n_candidates, findings and clean_text, in place of columns of these names."""
    return with_own(scanned_rows(docs, path, forest, keep, mask), "n_candidates", "findings", "clean_text")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
