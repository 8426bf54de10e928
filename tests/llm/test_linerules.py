import sys, os
sys.path.insert(0, os.path.dirname(__file__))

import random
import re
from collections import Counter

import helpers
from quayside.llm import linerules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def texts():
    rnd = random.Random(3)
    made = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    made += ["\n".join(rnd.choice(["x y", "x y ", "", " ", "#|<"]) for _ in range(9))
             for _ in range(40)]
    return made


def rows():
    return [helpers.row(100 + i, t) for i, t in enumerate(texts())] + helpers.awkward()


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_measures_equal_brute_force(spark):
    got = linerules.judge(helpers.docs(spark, rows())).collect()
    assert Counter((r["doc_id"], *[r[c] for c in COLS]) for r in got) == Counter(
        (r[0], *brute(r[1])) for r in rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10
                                    or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_colliding_hashes_are_counted_exactly(spark, monkeypatch):
    # every word hashes alike, so that all windows collide
    from pyspark.sql import functions as F
    real = F.xxhash64
    monkeypatch.setattr(linerules.F, "xxhash64", lambda *c: real(F.lit(1)) + F.size(
        F.array(*c)) * 0)
    got = linerules.judge(helpers.docs(spark, rows()[:60])).collect()
    monkeypatch.undo()
    assert Counter((r["doc_id"], r["n_repeat_words"]) for r in got) == Counter(
        (r[0], brute(r[1])[4]) for r in rows()[:60])


def test_lines_are_judged_first(spark):
    nav = "Home | About | News | Contact | Help | Login"
    docs = [helpers.row(1, helpers.PROSE + "\n" + nav),
            helpers.row(2, "\n".join(" | ".join(f"{w}{i}" for w in "ABCDEF")
                                       for i in range(6)) + "\nShort text."),
            helpers.row(3, helpers.PROSE + "\nThis site is licensed under the common terms."),
            helpers.row(4, "### $$$ *** %%% &&& ### $$$ @@@ *** %%% &&& <<< >>> ***")]
    got = {r["doc_id"]: r for r in linerules.judge(helpers.docs(spark, docs)).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == helpers.PROSE
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["kept"] and got[3]["clean_text"] == helpers.PROSE
    assert not got[4]["kept"]


MENUS = ["\n".join(["Home", "About us", "Products", "Our team", "News", "Contact", "Login", "Help",
                     "Site map", "Careers", "Press", "Search"]),
         "\n\n \n".join(["Home", "Who we are", "Shop", "Jobs today", "News", "Contact us"]),
         "Home / About us / Products / News / Contact / Login / Help / Site map",
         "Home About Products News Contact Login Help Careers Press Search"]


def test_menus_without_bars(spark):
    docs = [helpers.row(i, m) for i, m in enumerate(MENUS)]
    docs += [helpers.row(10 + i, helpers.PROSE + "\n" + m + "\n" + helpers.PROSE.replace("old", "new"))
             for i, m in enumerate(MENUS)]
    got = {r["doc_id"]: r for r in linerules.judge(helpers.docs(spark, docs)).collect()}
    for i in range(len(MENUS)):
        assert not got[i]["kept"] and got[i]["clean_text"] == ""
        assert got[10 + i]["clean_text"] == helpers.PROSE + "\n" + helpers.PROSE.replace("old", "new")


def test_headings_and_short_lists_pass(spark):
    texts = ["The Harbour at Dawn\n" + helpers.PROSE + "\nThe Market\n" + helpers.PROSE,
             helpers.PROSE + "\nFour Things\nrope\nsalt\nbread\n" + helpers.PROSE,
             "He spoke,\nshe heard;\nit rained.\nWho came?\nNobody did.\n" + helpers.PROSE,
             "ABCDEFGHIJKLMNOPQRSTUVWXYZ " * 3 + "is a code word that nobody\n" + helpers.PROSE,
             "A B C D e F G H I J K L\n" + helpers.PROSE, "A" * 50_000 + " b\n" + helpers.PROSE * 400,
             "On and/or off, at 3/4 of the way / or not, it went on as before and nobody minded."]
    got = {r["doc_id"]: r for r in linerules.judge(
        helpers.docs(spark, [helpers.row(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i]["clean_text"] == t and got[i]["lost_chars"] == 0


def test_very_long_lines_of_capitals(spark):
    docs = [helpers.row(1, "Word " * 100_000 + "\n" + helpers.PROSE),
            helpers.row(2, "Word " * 100_000 + "word\n" + helpers.PROSE * 4000)]
    got = {r["doc_id"]: r for r in linerules.judge(helpers.docs(spark, docs)).collect()}
    assert got[1]["lost_chars"] == 400_000 and got[1]["clean_text"] == helpers.PROSE
    # 40 words and more without a mark are no sentence either
    assert got[2]["lost_chars"] == 400_004


def test_runs_of_any_length(spark):
    # one item fewer than a run, a run, and more, between and beside sentences
    texts = ["\n".join(["One sentence ends."] * a + ["item"] * n + ["Another one ends."] * b)
             for a in (0, 1) for b in (0, 2) for n in (4, 5, 6, 7, 11)]
    got = {r["doc_id"]: r["lost_chars"] for r in linerules.judge(
        helpers.docs(spark, [helpers.row(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        n = t.count("item")
        assert got[i] == (4 * n if n >= 5 else 0)


def test_filter_on_the_verdict_stays_cheap(spark):
    got = linerules.judge(helpers.docs(spark)).where("kept").select("doc_id").collect()
    assert {1, 2, 3} <= {r["doc_id"] for r in got}


def test_empty_table_and_native_plan(spark):
    df = linerules.judge(helpers.empty(spark))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
