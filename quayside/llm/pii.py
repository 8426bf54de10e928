"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans: e-mail addresses, IP addresses, card numbers
and phone numbers.  The field labels every token that has a digit or an ``@``
with one of these kinds or none.  Its potentials are

* per token: a softmax over shape, checks and neighbours' shapes;
* chain: between tokens with only white space between them;
* skip: between consecutive mentions of a similar token anywhere in the
  document (same address, or same digits, however they are grouped by marks
  and white space, also where one mention is the end of the other: six digits
  or more), however distant.

Tokens of base spans are observed; damped loopy message passing then spreads
their labels over chain and skip edges, and tokens whose marginal for a kind
reaches ``threshold`` become added spans (a number given in full once and in
part elsewhere, for example).  All potentials are trained on a bounded sample
of distinct texts (``sample_docs``), labelled by the base spans.

Positions are code points, ends exclusive.  Defined cases: null text counts
as empty and has no spans; of overlapping spans of different kinds each is
reported, and redaction replaces their union once, named by the kind listed
first; repeated rows get equal spans; a corpus without any span gives a model
that adds none; an empty table gives no rows.  ``detect`` reads the id and
text columns only; ``redact`` passes all others through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .tokens import slices

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns; e-mail and IP are walked in parts that
# cannot backtrack, with the same matches
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
CANDIDATE = re.compile(r"[0-9@]")
LEAST, MOST = 6, 19     # digits that tell a number from others; of the longest kind
SPACES = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with the run of name characters before it and a domain
    after it; runs between two ``@`` are walked once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        tail = EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            last = tail.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted digit groups, four at a time from the left."""
    for run in DIGIT_GROUPS.finditer(text):
        groups, at = run.group().split("."), run.start()
        for i in range(0, len(groups) - 3, 4):
            four = groups[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    return [(k, a, b) for k, find in enumerate((emails, ips, cards, phones))
            for a, b in find(text)]


# --- the field -------------------------------------------------------------

class Graph(NamedTuple):
    """Tokens (start, end), their features, edges (i, j, 0 chain or 1 skip)
    and observed labels (0 none, kind + 1, -1 unknown)."""
    tokens: list[tuple[int, int]]
    features: list[list[str]]
    edges: list[tuple[int, int, int]]
    labels: list[int]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or ``@``, without marks at
    their ends other than an opening bracket or a plus."""
    out, done = [], 0
    for m in CANDIDATE.finditer(text):
        if m.start() < done:
            continue
        a = b = m.start()
        while a > done and text[a - 1] not in SPACES:
            a -= 1
        while b < len(text) and text[b] not in SPACES:
            b += 1
        done = b
        while not (text[a].isalnum() or text[a] in "@+("):
            a += 1
        while not (text[b - 1].isalnum() or text[b - 1] in "@)"):
            b -= 1
        out.append((a, b))
    return out


def shape(token: str) -> str:
    """Digits as 9 up to five, then 9+; letter runs as a; marks as they are."""
    out = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", token))
    return re.sub(r"9{6,}", "9+", out)[:40]


def overlapping(digits: list[str], i: int, j: int, size: int) -> Iterator[tuple[int, int]]:
    """Pairs of tokens that share digits of two mentions, which end with the
    tokens i and j and agree in their last ``size`` digits."""
    a, b = len(digits[i]), len(digits[j])
    while True:
        yield i, j
        if min(a, b) >= size:
            return
        left, right = a <= b, b <= a
        if left:
            i -= 1
            a += len(digits[i])
        if right:
            j -= 1
            b += len(digits[j])


def skip_edges(words: list[str], chained: list[bool]) -> list[tuple[int, int]]:
    """Pairs of tokens in consecutive mentions of the same thing: an address,
    or the digits of a run of tokens (``chained``: only white space before).

    A mention of a number ends with any token and has its last LEAST to MOST
    digits, or all digits of a longer token.  Two mentions with the same
    digits are linked if one of them begins where a token begins; of the
    mentions that end with a token, the longest that is known counts.  Longer
    equal runs are linked by the mentions they consist of."""
    digits = ["" if "@" in w else NOT_DIGIT.sub("", w) for w in words]
    found: dict[tuple[int, int], None] = {}     # in order, each once
    addresses: dict[str, int] = {}
    whole: dict[str, int] = {}      # last token of mentions that begin with a token
    ending: dict[str, int] = {}     # and of all mentions
    tail, starts = "", {}           # the run's last digits; token by digits up to the run's end
    for j, (word, own) in enumerate(zip(words, digits)):
        if not own:
            key = word.lower()
            if key in addresses:
                found[addresses[key], j] = None
            addresses[key] = j
            tail, starts = "", {}
            continue
        if not chained[j]:
            tail, starts = "", {}
        starts = {n + len(own): i for n, i in starts.items() if n + len(own) <= MOST}
        starts[len(own)] = j
        tail = (tail + own)[-MOST:]
        mentions = [(n, tail[-n:]) for n in range(len(tail), LEAST - 1, -1)]
        if len(own) > MOST:
            mentions.insert(0, (len(own), own))
        for n, mention in mentions:
            i = (ending if n in starts else whole).get(mention)
            if i is None:
                continue
            first, before = j, len(own)     # the token in which the mention begins
            while before < n:
                first -= 1
                before += len(digits[first])
            if i < first:
                found.update(dict.fromkeys(overlapping(digits, i, j, n)))
                break
        for n, mention in mentions:
            ending[mention] = j
            if n in starts:
                whole[mention] = j
    return list(found)


def features_of(token: str) -> list[str]:
    digits = NOT_DIGIT.sub("", token)
    own = shape(token)
    return [f"shape={own}", f"digits={len(digits)}", f"dots={min(4, token.count('.'))}",
            f"at={'@' in token}", f"plus={token[0] == '+'}", f"bracket={'(' in token}",
            f"plain={token.isdigit()}", f"letters={any(c.isalpha() for c in token)}",
            f"luhn={16 <= len(digits) <= 19 and luhn(digits)}",
            f"ip={any(True for _ in ips(token))}", f"email={any(True for _ in emails(token))}"]


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph:
    tokens = tokens_of(text)
    words = [text[a:b] for a, b in tokens]
    shapes = [shape(w) for w in words]
    features, edges = [features_of(w) for w in words], []
    chained = [i > 0 and not text[tokens[i - 1][1]:a].strip(SPACES)
               for i, (a, _) in enumerate(tokens)]
    for i in range(len(words)):
        if chained[i]:
            edges.append((i - 1, i, 0))
            features[i].append(f"before={shapes[i - 1]}")
            features[i - 1].append(f"after={shapes[i]}")
    edges += [(i, j, 1) for i, j in skip_edges(words, chained)]
    labels = [0] * len(tokens)
    for kind, a, b in reversed(base):   # the kind listed first wins
        i = int(np.searchsorted([t[1] for t in tokens], a, side="right"))
        while i < len(tokens) and tokens[i][0] < b:
            labels[i] = kind + 1
            i += 1
    return Graph(tokens, features, edges, labels)


class Field(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray     # features + intercept by label
    pairs: np.ndarray       # [chain or skip, label, label]


def fit_field(graphs: list[Graph], least: int = 3, rounds: int = 200, l2: float = 1e-3) -> Field:
    """Train the potentials piece by piece: token potentials as a softmax
    regression, edge potentials as smoothed log association of the labels.

    The patterns see few of the mentions that skip edges are there for, so the
    sample cannot say how often the labels of a skip edge agree.  They do
    unless the digits are equal by chance, 10 ** -LEAST; trained is the share
    of each label, with a prior of 4 mentions a label."""
    k = len(KINDS) + 1
    seen: dict[str, int] = {}
    for g in graphs:
        for fs in g.features:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    y = np.array([v for g in graphs for v in g.labels], dtype=np.int64)
    rows = [[index[f] for f in fs if f in index] for g in graphs for fs in g.features]
    weights = np.zeros((len(index) + 1, k))
    counts = np.zeros((2, k, k))
    for g in graphs:
        for i, j, kind in g.edges:
            counts[kind, g.labels[i], g.labels[j]] += 1
    counts += counts.transpose(0, 2, 1)
    counts += 0.5
    counts[1] += 4 * np.eye(k)
    share = counts.sum(axis=2, keepdims=True) / counts.sum(axis=(1, 2), keepdims=True)
    joint = counts / counts.sum(axis=(1, 2), keepdims=True)
    pairs = np.clip(np.log(joint / (share * share.transpose(0, 2, 1))), -4, 4)
    chance = 10.0 ** -LEAST
    pairs[1] = np.log(chance + (1 - chance) * np.eye(k) / share[1])
    if len(y):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([f for r in rows for f in r], dtype=np.int64)
        target = np.eye(k)[y]
        step = 4.0 / (max(map(len, rows)) + 1)
        ahead, momentum = weights.copy(), 1.0
        for _ in range(rounds):
            z = np.stack([np.bincount(row, ahead[col, c], len(rows)) for c in range(k)], axis=1)
            z += ahead[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            gap = (p / p.sum(axis=1, keepdims=True) - target) / len(rows)
            grad = np.zeros_like(weights)
            for c in range(k):
                grad[:-1, c] = np.bincount(col, gap[row, c], len(index))
            grad[-1] = gap.sum(axis=0)
            grad[:-1] += l2 / 10 * ahead[:-1]
            new = ahead - step * grad
            after = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
            ahead = new + (momentum - 1) / after * (new - weights)
            weights, momentum = new, after
    return Field(index, weights, pairs)


def marginals(graph: Graph, field: Field, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
    """Label marginals per token by damped loopy message passing; tokens with
    an observed kind are clamped to it."""
    n, k = len(graph.tokens), len(KINDS) + 1
    node = np.tile(field.weights[-1], (n, 1))
    for i, fs in enumerate(graph.features):
        at = [field.index[f] for f in fs if f in field.index]
        if at:
            node[i] += field.weights[at].sum(axis=0)
        if graph.labels[i] > 0:
            node[i] = np.where(np.arange(k) == graph.labels[i], 0.0, -50.0)
    node -= node.max(axis=1, keepdims=True)
    if graph.edges:
        e = np.array(graph.edges)
        # both directions of every edge; message m goes from src to dst
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
        pair = field.pairs[np.concatenate([e[:, 2], e[:, 2]])]
        message = np.zeros((len(src), k))
        for _ in range(rounds):
            inbox = node.copy()
            np.add.at(inbox, dst, message)
            out = (inbox[src] - message[back])[:, :, None] + pair
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = damping * message + (1 - damping) * new
            moved = np.abs(new - message).max()
            message = new
            if moved < 1e-3:
                break
        np.add.at(node, dst, message)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field,
                threshold: float) -> list[tuple[int, int, int]]:
    """Spans of tokens outside the base spans that the field labels."""
    graph = graph_of(text, base)
    if all(graph.labels):   # also without any token
        return []
    p = marginals(graph, field)
    out: list[list[int]] = []
    close = {(i, j) for i, j, kind in graph.edges if kind == 0}
    before = (-1, 0)
    for i, (a, b) in enumerate(graph.tokens):
        label = int(p[i].argmax())
        if graph.labels[i] or label == 0 or p[i, label] < threshold:
            continue
        if before == (i - 1, label) and (i - 1, i) in close:
            out[-1][2] = b
        else:
            out.append([label - 1, a, b])
        before = (i, label)
    return [tuple(s) for s in out]


def head_of(graph: Graph, size: int) -> Graph:
    """The graph of the first ``size`` tokens."""
    return Graph(graph.tokens[:size], graph.features[:size],
                 [e for e in graph.edges if e[0] < size and e[1] < size], graph.labels[:size])


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = 2000,
          seed: int = 3, sample_tokens: int = 100) -> Field:
    """Fit the field on the first ``sample_tokens`` tokens of each of about
    ``sample_docs`` distinct texts that have candidates; equal texts count
    once, however many they are."""
    rows = docs.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]")).select(
        "t", F.xxhash64("t", F.lit(seed)).alias("h"))
    # the count of distinct texts need not be exact
    n = rows.agg(F.approx_count_distinct("h").alias("n")).collect()[0]["n"]
    if n == 0:
        return fit_field([])
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()      # no more than the sample has
        for batch in batches:
            hashes, found = [], []
            for h, t in zip(batch.column(1).to_pylist(), batch.column(0)):
                if h not in seen:
                    seen.add(h)
                    t = t.as_py()
                    hashes.append(h)
                    found.append(head_of(graph_of(t, base_spans(t)), sample_tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()),
                 pa.array([g.features for g in found], pa.list_(pa.list_(pa.string()))),
                 pa.array([[list(e) for e in g.edges] for g in found],
                          pa.list_(pa.list_(pa.int32()))),
                 pa.array([g.labels for g in found], pa.list_(pa.int32()))],
                names=["h", "features", "edges", "labels"])

    got = rows.where(draw < min(1.0, sample_docs / n)).mapInArrow(
        extract, "h long, features array<array<string>>, edges array<array<int>>, "
                 "labels array<int>").dropDuplicates(["h"]).collect()
    graphs = [Graph([], r["features"], [tuple(e) for e in r["edges"]], r["labels"]) for r in got]
    graphs.sort(key=lambda g: (g.features, g.labels))   # the order of rows does not matter then
    return fit_field(graphs)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                  ("end", pa.int64())]))


def _named(spans) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           sample_docs: int = 2000, threshold: float = 0.9) -> DataFrame:
    """Per row: doc_id, base (the patterns' spans) and spans (all), each an
    array of (kind, start, end) by kind and start."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                found = base_spans(t)
                base.append(_named(found))
                every.append(_named(sorted(
                    found + added_spans(t, found, field.value, threshold))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPAN_ARROW), pa.array(every, _SPAN_ARROW)],
                names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each (union of) spans replaced by its kind in brackets."""
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and a < merged[-1][2]:
            merged[-1] = [min(k, merged[-1][0]), merged[-1][1], max(b, merged[-1][2])]
        else:
            merged.append([k, a, b])
    out, at = [], 0
    for k, a, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = None,
           sample_docs: int = 2000, threshold: float = 0.9) -> DataFrame:
    """``docs`` with every span replaced; ``n_chars_col`` follows the text."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, text_col, sample_docs))
    at = docs.columns.index(text_col)
    counted = docs.columns.index(n_chars_col) if n_chars_col else None

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, sizes = [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                found = base_spans(t) if t else []
                found += added_spans(t, found, field.value, threshold) if t else []
                if found:
                    t = redacted(t, found)
                texts.append(t)
                if counted is not None:
                    sizes.append(len(t) if found else batch.column(counted)[i].as_py())
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if counted is not None:
                columns[counted] = pa.array(sizes, batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    rows = numbered(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
