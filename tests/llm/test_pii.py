import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import random
import re

import numpy as np
import pytest

import helpers
from quayside.llm import pii

# the patterns of the contract, as they are written there
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        odd = [int(d) for d in digits[-1::-2]]
        even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS.items())
            for m in re.finditer(p, text) if passes(kind, m.group())]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    for _ in range(15_000):
        t = "".join(rnd.choice("1234509.@+- ()a_%é\n") for _ in range(rnd.randint(0, 50)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("4111 1111 1111 1111", "a.b@c.d.e", "+1 (017) 555-7713", "255.1.2.3.4.5.6.256",
              "1.2.3", "@x.y", "a@b@c.de", "０１２@x.yz"):
        assert pii.base_spans(t) == plain_spans(t)


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "." + "2" * 300_000) == []
    assert pii.base_spans("x" * 200_000 + "@") == []


def trained():
    rnd = random.Random(2)
    graphs = []
    for _ in range(300):
        phone = f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}"
        number = "".join(rnd.choice("0123456789") for _ in range(16))
        t = f"call {phone} or {rnd.randint(10, 99)} at mail.{rnd.randint(1, 9)}@x.com {number} end"
        t += f" again {phone} and 12.34.56.{rnd.randint(1, 200)}"
        graphs.append(pii.graph_of(t, pii.base_spans(t)))
    return pii.fit_field(graphs)


def test_distant_mentions_share_a_label():
    field = trained()
    text = "Call +1 (555) 555-7713 today. " + "Nothing here. " * 50 + "As said, 555-7713 it is."
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field, 0.9)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "555-7713")]
    lone = "As said, 1234 it is, or 99 and 2024."
    assert pii.added_spans(lone, pii.base_spans(lone), field, 0.9) == []


def linked(text):
    """Pairs of tokens, as written, that a skip edge joins."""
    g = pii.graph_of(text, [])
    word = [text[a:b] for a, b in g.tokens]
    return sorted((word[i], word[j]) for i, j, kind in g.edges if kind == 1)


def test_mentions_written_in_groups_are_linked():
    far = " is it. " + "Nothing here. " * 20 + "Again "
    phone = "+44 20 7946 0958"
    assert linked(phone + far + "20 7946 0958.") == [
        ("0958", "0958"), ("20", "20"), ("7946", "7946")]
    card = "4111 1111 1111 1111"
    assert len(linked(card + far + card + " 2024")) >= 4
    assert linked(card + far + "4111111111111111") == [
        (g, "4111111111111111") for g in sorted(card.split())]
    # a part of a number, in another grouping, before and after the whole
    assert linked("+442079460958" + far + "7946-0958") == [("+442079460958", "7946-0958")]
    assert linked("7946 0958" + far + "+442079460958") == [
        ("0958", "+442079460958"), ("7946", "+442079460958")]
    # neither is a part of the other, too few digits, not one run
    assert linked("91234567" + far + "81234567") == []
    assert linked("call 20 79" + far + "20 79") == []
    assert linked("20 7946" + far + "20 and 7946") == []
    # a mention never overlaps itself, and a long digit token costs little
    assert all(i != j for i, j, _ in pii.graph_of("111111 11 1111 0 0 0 0 0 0 0", []).edges)
    long = "7" * 100_000
    assert linked(long + far + long) == [(long, long)]


def test_distant_mentions_in_groups_share_a_label():
    field = trained()
    text = "Call +44 20 7946 0958 today. " + "Nothing here. " * 50 + "As said, 20 7946 0958 it is."
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, field, 0.9)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("phone", "20 7946 0958")]
    other = text.replace("As said, 20 7946 0958", "As said, 31 8057 1069")
    assert pii.added_spans(other, pii.base_spans(other), field, 0.9) == []


def test_message_passing_is_exact_on_a_tree():
    rnd = np.random.default_rng(3)
    k = len(pii.KINDS) + 1
    field = pii.Field({f"f{i}": i for i in range(4)}, rnd.normal(size=(5, k)),
                      rnd.normal(size=(2, k, k)))
    field.pairs[:] = field.pairs + field.pairs.transpose(0, 2, 1)
    g = pii.Graph([(0, 1)] * 4, [[f"f{i}"] for i in range(4)],
                  [(0, 1, 0), (1, 2, 1), (1, 3, 0)], [0, 0, 0, 3])
    total = np.zeros((4, k))
    node = field.weights[:4] + field.weights[4]
    for labels in np.ndindex(k, k, k, k):
        if labels[3] == 3:
            score = sum(node[i, v] for i, v in enumerate(labels)) - node[3, 3]
            score += sum(field.pairs[e, labels[i], labels[j]] for i, j, e in g.edges)
            for i, v in enumerate(labels):
                total[i, v] += np.exp(score)
    exact = total / total.sum(axis=1, keepdims=True)
    assert np.abs(pii.marginals(g, field, rounds=200) - exact).max() < 5e-3


def test_the_sample_is_bounded(spark, monkeypatch):
    """A text of a third of all rows is drawn once, a long one in part."""
    got = []
    monkeypatch.setattr(pii, "fit_field", lambda graphs: got.extend(graphs))
    rows = [helpers.row(i, f"call 555-{1000 + i} now") for i in range(200)]
    rows += [helpers.row(1000 + i, "the same 99 of all") for i in range(100)]
    rows += [helpers.row(2000, " ".join(map(str, range(5000))))]
    pii.train(helpers.docs(spark, rows).repartition(3))
    assert len(got) == 202 and max(len(g.labels) for g in got) == 100
    assert all(len(g.features) == len(g.labels) for g in got)
    assert all(max(i, j) < 100 for g in got for i, j, _ in g.edges)
    got.clear()
    pii.train(helpers.docs(spark, rows), sample_docs=50)
    assert 20 <= len(got) <= 90


PRIVATE = [helpers.row(50, "mail jo.do@site.example.org, or +44 20 7946 0958\nfrom 10.0.0.1"),
           helpers.row(51, "card 4111-1111-1111-1111 and again 4111 1111 1111 1111."),
           helpers.row(52, "é☂ 漢 x@y.zz")]


def test_detect_on_awkward_rows(spark):
    rows = helpers.awkward() + PRIVATE
    got = pii.detect(helpers.docs(spark, rows)).collect()
    want = sorted(((r[0], [(pii.KINDS[k], a, b) for k, a, b in plain_spans(r[1] or "")])
                   for r in rows), key=repr)
    assert sorted(((r["doc_id"], [tuple(s) for s in r["base"]]) for r in got), key=repr) == want
    for r in got:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_redact_changes_spans_only(spark):
    docs = helpers.docs(spark, helpers.awkward() + PRIVATE)
    out = pii.redact(docs, n_chars_col="n_chars")
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert got[50]["text"] == "mail [EMAIL], or [PHONE]\nfrom [IP]"
    assert got[51]["text"] == "card [CARD] and again [CARD]."
    assert got[51]["n_chars"] == len(got[51]["text"])
    assert got[52]["text"] == "é☂ 漢 [EMAIL]"
    assert got[5]["text"] is None and got[1]["text"] == helpers.PROSE


def test_overlapping_kinds_are_replaced_once():
    text = "see +1 017 555 7713 now"
    assert pii.redacted(text, [(3, 4, 19), (2, 5, 19)]) == "see [CARD] now"


def test_empty_table(spark):
    assert pii.detect(helpers.empty(spark)).collect() == []
    assert pii.redact(helpers.empty(spark)).collect() == []
