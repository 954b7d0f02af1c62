"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. The field adds what
they miss. Its nodes are the words of a text that hold a digit or an @ (all other words are observed as
outside); neighbouring words share a transition potential, and words that are the same or similar (equal
without case and outer punctuation, equal in what follows a = or :, or equal in seven digits or more) share a potential
with their next occurrence, however far. Loopy belief propagation passes messages over both kinds of edges, for a fixed
number of rounds, so that a word without a telling context takes the label of its other mentions in the document, and
no document depends on those it shares a batch with.

The weights are fitted by pseudo-likelihood on a bounded sample: about ``TRAIN_DOCS`` documents, drawn by hash, and
``TRAIN_WORDS`` of their words at most, labelled by the base spans and, for credentials, by fixed patterns. A word that
matches a pattern shows its label by itself. So that the field learns what a word is worth where the pattern is hidden, every
labelled word, and some of the others, is mentioned once more in training: its bare value, between the words of another
place of the text, joined to the first mention by a skip edge. From these hidden mentions come the weights of
values without a prefix and the potential that carries a label from mention to mention.
Everything else covers all documents.

Spans are code points, end exclusive. Base spans stay; a word of the field is added where it overlaps none and its
belief is at least ``MIN_BELIEF``. Cases: a null or empty text has no spans; equal rows get equal spans; texts
are read whole; an empty table, or one without any candidate word, gives base spans only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")  # the base kinds as listed, then the field's own
LABELS = ("O", *KINDS)
FEATURES = 1 << 12
TRAIN_DOCS = 40_000
TRAIN_WORDS = 20_000
TRAIN_ROUNDS = 60
MIN_BELIEF = 0.9
BP_ROUNDS = 30
MIN_VALUE = 6  # characters from which the same value behind a = or : is the same thing
HIDDEN_OTHERS = 4  # one in so many unlabelled words has a hidden mention
SEED = 7

# The base patterns; a digit run is only entered at its start, which changes no match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Credentials for training.
_SECRET = re.compile(r"""\b(?:AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api_?key)\s*[=:]\s*["']?[^\s"']{8,})""")
_CANDIDATE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LEAD, _TRAIL = "\"'([{<", "\"')]}>.,;:!?"


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind as listed, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _shape(word: str) -> str:
    s = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", word[:64])))
    return re.sub(r"([^\x00-\x7f])[^\x00-\x7f]*", "u", s)[:16]


def _bucket(n: int) -> int:
    return min(n, 4) if n < 5 else 5 if n < 9 else 6 if n < 13 else 7 if n < 20 else 8


def word_features(words: list[str], i: int) -> list[int]:
    """Hashed features of word i: its shape, counts and checks, and the words around it."""
    w = words[i]
    core = w.strip(_LEAD + _TRAIL)
    digits = "".join(c for c in core if c in "0123456789")
    before, after = words[i - 1] if i else "^", words[i + 1] if i + 1 < len(words) else "$"
    parts = core.split(".")
    names = [
        "bias", "shape " + _shape(core), f"length {_bucket(len(core) // 2)}", f"digits {_bucket(len(digits))}",
        f"alpha {_bucket(sum(c.isalpha() for c in core))}", f"mark {w[0]}", f"@ {core.count('@')}", f"= {'=' in core}",
        f"hex {len(core) >= 8 and all(c in '0123456789abcdef' for c in core)}", f"caps {len(core) >= 8 and core.isupper()}",
        f"card {13 <= len(digits) <= 19 and len(digits) == len(core) and luhn(digits)}",
        f"octets {len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        "before " + re.sub("[0-9]+", "9", before.lower())[:16], "shape before " + _shape(before), "shape after " + _shape(after),
        "second before " + (re.sub("[0-9]+", "9", words[i - 2].lower())[:16] if i > 1 else "^"),
    ]
    return [zlib.crc32(n.encode("utf-8")) % FEATURES for n in names]


N_FEATURES = 16


def value_of(word: str) -> str:
    """What a word gives a value to: the part behind its last = or :, without outer punctuation; else the word's core."""
    core = word.strip(_LEAD + _TRAIL)
    return re.split(r"[=:]", core)[-1].strip(_LEAD + _TRAIL) or core


@dataclass
class Graph:
    """Candidate words of a text, with their edges; places are word numbers."""

    spans: list[tuple[int, int]]
    places: list[int]
    features: list[list[int]]
    chain: list[tuple[int, int]]  # neighbouring candidates
    skip: list[tuple[int, int]]  # a candidate and the next similar one


def build_graph(text: str) -> Graph | None:
    if not _CANDIDATE.search(text):
        return None
    matches = list(_WORD.finditer(text))
    words = [m[0] for m in matches]
    places = [i for i, w in enumerate(words) if _CANDIDATE.search(w)]
    chain, skip, last = [], [], {}
    for node, i in enumerate(places):
        if node and places[node - 1] == i - 1:
            chain.append((node - 1, node))
        core = words[i].strip(_LEAD + _TRAIL).lower()
        digits = "".join(c for c in core if c in "0123456789")
        value = value_of(words[i]).lower()
        for key in {("w", core), ("w", value if len(value) >= MIN_VALUE else core), ("d", digits if len(digits) >= 7 else core)}:
            if key in last and places[last[key]] < i - 1:  # neighbours in the text have a chain edge
                skip.append((last[key], node))
            last[key] = node
    return Graph([matches[i].span() for i in places], places, [word_features(words, i) for i in places], chain, sorted(set(skip)))


def train_labels(text: str, graph: Graph) -> list[int]:
    """Label of each candidate: the base or credential span it lies in."""
    known = base_spans(text) + [(4, *m.span()) for m in _SECRET.finditer(text)]
    labels = []
    for a, b in graph.spans:
        core = text[a:b]
        a, b = a + len(core) - len(core.lstrip(_LEAD)), b - len(core) + len(core.rstrip(_TRAIL))
        labels.append(next((k + 1 for k, s, e in known if s < b and a < e), 0))
    return labels


def hide(graph: Graph, words: list[str], labels: list[int], key: int) -> tuple[Graph, list[int]]:
    """The graph with a hidden mention of every labelled word and some of the others: the bare value between the
    neighbours of a place drawn by hash, joined to the word by a skip edge; half of them without features of their own."""
    features, skip, out = list(graph.features), list(graph.skip), list(labels)
    for node, i in enumerate(graph.places):
        draw = zlib.crc32(f"{SEED}:{key}:{node}:hidden".encode())
        if not labels[node] and draw % HIDDEN_OTHERS:
            continue
        at = (draw >> 8) % len(words)
        around = [*words[max(0, at - 2) : at], value_of(words[i]), *words[at : at + 1]]
        skip.append((node, len(features)))
        # every other one shows nothing of itself either: only the edge can tell its label
        blank = [zlib.crc32(b"hidden") % FEATURES] * N_FEATURES
        features.append(blank if draw >> 31 else word_features(around, min(2, at)))
        out.append(labels[node])
    return Graph(graph.spans, graph.places, features, graph.chain, skip), out


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            graph = build_graph(text or "")
            if graph is None:
                continue
            graph, labels = hide(graph, _WORD.findall(text), train_labels(text, graph), key)
            left, right = [0] * len(labels), [0] * len(labels)
            around = np.zeros((len(labels), len(LABELS)), dtype=np.int64)
            for a, b in graph.chain:
                left[b], right[a] = labels[a], labels[b]
            for a, b in graph.skip:
                around[a, labels[b]] += 1
                around[b, labels[a]] += 1
            for i, y in enumerate(labels):
                order = zlib.crc32(f"{SEED}:{key}:{i}".encode())
                rows.append({"order": order, "key": key, "place": i, "x": [y, left[i], right[i], *around[i].tolist(), *graph.features[i]]})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("order", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("x", pa.list_(pa.int64()))]))


@dataclass
class Weights:
    node: np.ndarray  # (FEATURES, labels)
    chain: np.ndarray  # (label, label of the right neighbour)
    skip: np.ndarray  # (label, label), symmetric


def fit(rows: np.ndarray, rounds: int = TRAIN_ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Pseudo-likelihood: each word given its neighbours' labels; full-batch Adagrad with weight decay."""
    n, k = len(LABELS), len(rows)
    w = Weights(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))
    if not k:
        w.node[:, 0] = 1.0
        return w
    y, left, right, around, feats = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3 : 3 + n], rows[:, 3 + n :]
    sums = [np.full(a.shape, 1e-8) for a in (w.node, w.chain, w.skip)]
    flat = feats.ravel()
    for _ in range(rounds):
        score = w.node[feats].sum(axis=1) + w.chain[left] + w.chain[:, right].T + around @ w.skip
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(k), y] -= 1
        node = np.stack([np.bincount(flat, np.repeat(p[:, c], feats.shape[1]), minlength=FEATURES) for c in range(n)], axis=1)
        chain = np.zeros((n, n))
        np.add.at(chain, left, p)
        np.add.at(chain.T, right, p)
        skip = around.T @ p
        for a, g, s in zip((w.node, w.chain, w.skip), (node, chain, skip + skip.T), sums, strict=True):
            g = g / k + decay * a
            s += g * g
            a -= rate * g / np.sqrt(s)
    return w


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS) -> Weights:
    """Weights from a sample of documents: each is drawn by its hash with the chance ``max_docs`` / their number."""
    chance = min(1.0, max_docs / max(1, docs.count()))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    drawn = keyed.where(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(chance * (1 << 32)))
    rows = drawn.mapInArrow(_training_rows, "order bigint, key bigint, place int, x array<bigint>")
    picked = rows.orderBy("order", "key", "place").limit(max_words).select("x").toPandas()["x"]
    width = 3 + len(LABELS) + N_FEATURES
    return fit(np.array([np.asarray(x) for x in picked], dtype=np.int64).reshape(-1, width))


def beliefs(score: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = BP_ROUNDS) -> np.ndarray:
    """Marginals by loopy belief propagation: all messages at once, half damped, in logarithms.

    ``edges`` (e, 2) join nodes a and b with ``potentials[e][label of a, label of b]``.
    """

    def norm(x: np.ndarray) -> np.ndarray:
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    forth = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), score.shape[1]))
    total = score
    for _ in range(rounds if len(edges) else 0):
        out = (total[source] - messages[back])[:, :, None] + forth
        top = out.max(axis=1, keepdims=True)
        new = norm((top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0, :])
        messages = 0.5 * new + 0.5 * messages
        total = score + np.stack([np.bincount(target, messages[:, c], minlength=len(score)) for c in range(score.shape[1])], axis=1)
    return np.exp(norm(total))


def label_graphs(graphs: list[Graph], w: Weights) -> list[np.ndarray]:
    """Beliefs of the words of each graph; the graphs of a batch are one graph of separate parts."""
    starts = np.concatenate([[0], np.cumsum([len(g.places) for g in graphs])]).astype(np.int64)
    score = w.node[np.array([f for g in graphs for f in g.features], dtype=np.int64)].sum(axis=1)
    chain = np.array([(a + s, b + s) for g, s in zip(graphs, starts, strict=False) for a, b in g.chain], dtype=np.int64).reshape(-1, 2)
    skip = np.array([(a + s, b + s) for g, s in zip(graphs, starts, strict=False) for a, b in g.skip], dtype=np.int64).reshape(-1, 2)
    # a word next to one that is no candidate has a neighbour observed as outside
    lone_left, lone_right = np.ones(len(score), dtype=bool), np.ones(len(score), dtype=bool)
    lone_left[chain[:, 1]] = False
    lone_right[chain[:, 0]] = False
    score = score + lone_left[:, None] * w.chain[0] + lone_right[:, None] * w.chain[:, 0]
    potentials = np.concatenate([np.broadcast_to(w.chain, (len(chain), *w.chain.shape)), np.broadcast_to(w.skip, (len(skip), *w.skip.shape))])
    p = beliefs(score, np.concatenate([chain, skip]), potentials)
    return [p[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def added_spans(text: str, graph: Graph, p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of neighbouring words of one label, without outer punctuation and apart from base spans."""
    label, sure = p.argmax(axis=1), p.max(axis=1) >= MIN_BELIEF
    taken = sorted((s, e) for _, s, e in base)
    runs: list[list[int]] = []
    at = 0
    for node, (a, b) in enumerate(graph.spans):
        if not label[node] or not sure[node]:
            continue
        a += len(text[a:b]) - len(text[a:b].lstrip(_LEAD))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_TRAIL))
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= b or (at < len(taken) and taken[at][0] < b):
            continue
        if runs and runs[-1][0] == label[node] - 1 and runs[-1][3] == graph.places[node] - 1:
            runs[-1][2:] = [b, graph.places[node]]
        else:
            runs.append([int(label[node]) - 1, a, b, graph.places[node]])
    return [(k, a, b) for k, a, b, _ in runs]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, weights: Weights) -> DataFrame:
    """``(doc_id, spans)``: spans of every document by kind as listed, then start, with ``base`` for pattern matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spans: list[list[dict]] = [[] for _ in texts]
            graphs = [(i, g) for i, t in enumerate(texts) if (g := build_graph(t))]
            if graphs:
                for (i, g), p in zip(graphs, label_graphs([g for _, g in graphs], weights), strict=True):
                    base = base_spans(texts[i])
                    found = [(*s, True) for s in base] + [(*s, False) for s in added_spans(texts[i], g, p, base)]
                    spans[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in sorted(found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Weights from ``docs`` itself, then the spans of each of its rows."""
    return detect(docs, train(docs))
