"""The ten operators: against brute force, round trips, and with nulls, blanks, ties, repeats, empty tables and clashing columns."""

import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.llm import catalog, components, conversations, language, packing, percentiles, scans, subjects, survivors, tokens, vectors

QUERIES = catalog.QUERIES
needs_tokenizer = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


# 1


def test_percentiles_are_the_ranked_values(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), float(f"{rng.lognormvariate(5, 2):.1f}")) for i in range(3000)]
    bad = [(9000, "a", None), (9001, "a", float("nan")), (9002, "b", -1.0), (9003, "b", float("inf")), (9004, "b", 1e12)]
    df = spark.createDataFrame(rows + rows[:50] + bad, "id int, g string, v double").withColumn("metric", F.lit("clash")).withColumn("value", F.lit(0))
    s = percentiles.summary(df, ["g"], ("v",))
    halves = [percentiles.summary(df.where(c), ["g"], ("v",)) for c in ("id % 2 = 0", "id % 2 = 1")]
    for counts in (s, percentiles.merge(*halves)):
        got = {(r.g, r.quantile): (r.n, r.value) for r in percentiles.percentiles(counts, ["g", "metric"]).collect()}
        for g in ("a", "b", None):
            v = sorted(x for _, k, x in rows if k == g)
            for q in percentiles.QUANTILES:
                n, x = got[g, q]
                want = v[max(1, int(np.ceil(q * len(v) - 1e-9))) - 1]
                assert n == len(v) and abs(x - want) <= max(0.0501, 0.00051 * want)
    assert percentiles.percentiles(s.where("false"), ["g", "metric"]).count() == 0
    ids = spark.createDataFrame([(None, "a", 1.0), (None, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0)], "id int, g string, v double")
    assert percentiles.summary(ids, ["g"], ("v",)).first().n == 3


# 2

SHAPE = "id long, conversation_id string, role string, content string, timestamp double, sources string"


def judged(spark, *messages):
    rows = [(i, c, r, t, ts, None) for i, (c, r, t, ts) in enumerate(messages)]
    turns, dropped = conversations.reassemble(spark.createDataFrame(rows, SHAPE))
    return turns, {r.conversation_id: r.reason for r in dropped.collect()}


def test_conversations(spark):
    turns, dropped = judged(
        spark,
        ("ok", "user", "q1", 1.0), ("OK ", "ai", "a1", 2.0), ("ok", "Human", "q2", 3000.0), ("ok", "bot", "a2", 3001.0), ("ok", "bot", "a2", 3001.5),
        ("late", "assistant", "a", 11.0), ("late", "user", "q", 10.0),
        ("ms", "assistant", "a", 1.7e12 + 5000), ("ms", "user", "q", 1.7e9),
        ("open", "user", "q1", 1.0), ("open", "user", "q2", 2.0), ("open", "assistant", "a", 3.0),
        ("end", "user", "q", 1.0), ("end", "assistant", "HTTP 503", 2.0),
        ("head", "assistant", "hello", 1.0), ("head", "user", "q", 2.0), ("head", "assistant", "a", 3.0),
        ("who", "user", "q", 1.0), ("who", "undefined", "x", 2.0), ("who", "assistant", "a", 3.0),
        ("mute", "user", " ​\n", 1.0), ("mute", "system", "rules", 2.0), ("mute", None, None, 3.0),
        ("ids", "user", "q", None), ("ids", "assistant", "a", 0.5),
        (None, "user", "lost", 1.0), ("  ", "user", "lost", 1.0),
        ("fine", "user", "?", 1.0), ("fine", "tool", "{}", 1.5), ("fine", "assistant", "...", 2.0), ("fine", "assistant", "The error in the table was corrected.", 3.0), ("fine", "assistant", "more", 4.0),
    )
    assert set(dropped) == {"open", "end", "head", "who", "mute"}
    assert dropped["who"] == "unknown speaker" and dropped["mute"] == "nothing said"
    got = {c: [r.content for r in sorted((r for r in turns.collect() if r.conversation_id == c), key=lambda r: r.turn)] for c in ("ok", "late", "ids", "fine")}
    assert got == {"ok": ["q1", "a1", "q2", "a2"], "late": ["q", "a"], "ids": ["q", "a"], "fine": ["?", "The error in the table was corrected.", "more"]}
    empty = spark.createDataFrame([], SHAPE)
    assert [d.count() for d in conversations.reassemble(empty)] == [0, 0]


def test_one_conversation_over_many_partitions(spark):
    rows = [(i, "c", "user" if i % 2 == 0 else "assistant", f"m{i}", float(i + 1), None) for i in range(4000)]
    random.Random(2).shuffle(rows)
    turns, dropped = conversations.reassemble(spark.createDataFrame(rows, SHAPE).repartition(8))
    assert dropped.count() == 0
    assert [r.content for r in turns.orderBy("turn").collect()] == [f"m{i}" for i in range(4000)]
    assert turns.agg(F.max("turn")).first()[0] == 4000


def test_clock_offsets_are_estimated(spark):
    rows = []
    for k in range(6):
        rows += [(2 * k, "skew", "user", f"q{k}", 100.0 * k + 100, None), (2 * k + 1, "skew", "assistant", f"a{k}", 100.0 * k + 100 - 20, None)]
    df = spark.createDataFrame(rows, SHAPE)
    assert {r.conversation_id for r in conversations.reassemble(df)[1].collect()} == {"skew"}
    turns, dropped = conversations.reassemble(df, max_clock_offset_s=60.0)
    assert dropped.count() == 0 and [r.content for r in turns.orderBy("turn").collect()][:4] == ["q0", "a0", "q1", "a1"]


def test_clock_offsets_with_several_replies_to_a_question(spark):
    rng = random.Random(3)
    rows, want, broken = [], {}, set()
    for c in range(60):
        name, off, t, turns = f"c{c:02d}", rng.choice([-40, -20, 0, 20, 40]), 1e9, []
        for k in range(rng.randint(1, 5)):
            t += 100 + rng.random()
            turns.append(("user", f"q{k}", t, t))
            for j in range(rng.randint(1, 3)):
                t += 3 + rng.random()
                turns.append(("assistant", f"a{k}.{j}", t, t + off))
        if c % 10 == 9:  # a question that nobody answers
            turns += [("user", "x", t + 300, t + 300), ("user", "y", t + 600, t + 600)]
            broken.add(name)
        want[name] = [x[1] for x in turns]
        rows += [(1000 * c + i, name, who, text, at, None) for i, (who, text, _, at) in enumerate(turns)]
    sent, dropped = conversations.reassemble(spark.createDataFrame(rows, SHAPE), max_clock_offset_s=60.0)
    assert {r.conversation_id for r in dropped.collect()} == broken
    got = {}
    for r in sent.orderBy("conversation_id", "turn").collect():
        got.setdefault(r.conversation_id, []).append(r)
    for name, turns in got.items():
        assert sorted(r.content for r in turns) == sorted(want[name]) and turns[0].speaker == "user" and turns[-1].speaker == "assistant"
        assert not any(x.speaker == y.speaker == "user" for x, y in zip(turns, turns[1:]))


def test_clocks_of_senders_by_least_squares(spark):
    rng = random.Random(13)
    rows, off = [], {"bot": 25.0, "assistant": 0.0}
    for c in range(200):
        who, t = ("bot" if c % 2 else "assistant"), 1e9 + 1e5 * c
        for k in range(3):
            t += 100 + rng.random()
            rows.append((1000 * c + 2 * k, f"c{c}", "user", f"q{k}", t, None))
            t += 2 + 20 * rng.random()
            rows.append((1000 * c + 2 * k + 1, f"c{c}", who, f"a{k}", t - off[who], None))
    broken = [(10**6 + i, f"b{i}", "user" if i % 2 else "bot", "x", 1e9 + i, None) for i in range(20)]  # questions without reply, and replies alone
    df = spark.createDataFrame(rows + broken, SHAPE)
    got = conversations.sender_offsets(conversations.arrival_constraints(conversations.normalise(df)))
    assert got["assistant"] == 0 and 22 < got["bot"] < 100
    assert conversations.reassemble(df)[1].count() > 100
    turns, dropped = conversations.reassemble(df, set_clocks=True)
    assert {r.conversation_id for r in dropped.collect()} == {f"b{i}" for i in range(20)}
    assert [r.content for r in turns.where("conversation_id = 'c7'").orderBy("turn").collect()] == ["q0", "a0", "q1", "a1", "q2", "a2"]
    # what is broken, but not by the clock, moves none
    bad = [(10 * i + k, f"d{i}", r, f"{r}{k}", 1e9 + 1000 * i + t, None) for i in range(100) for k, (r, t) in enumerate([("user", 0), ("bot", 5), ("user", 50), ("bot", 58)] if i % 5 else [("bot", 3), ("user", 9), ("user", 20)])]
    assert set(conversations.sender_offsets(conversations.arrival_constraints(conversations.normalise(spark.createDataFrame(bad, SHAPE)))).values()) == {0.0}
    assert conversations.sender_offsets(conversations.arrival_constraints(conversations.normalise(df.where("false")))) == {}


# 3


@pytest.fixture(scope="module")
def identifier():
    return language.train([])


@pytest.mark.parametrize(
    "code, text",
    [
        ("en", "The committee will publish its report when all members have read it."), ("fr", "Le comité publiera son rapport quand tous les membres l'auront lu."),
        ("de", "Der Ausschuss wird seinen Bericht veröffentlichen, wenn alle ihn gelesen haben."), ("es", "El comité publicará su informe cuando todos los miembros lo hayan leído."),
        ("it", "Il comitato pubblicherà la sua relazione quando tutti i membri l'avranno letta."), ("pt", "A comissão publicará o seu relatório quando todos os membros o tiverem lido."),
        ("nl", "De commissie zal haar verslag publiceren wanneer alle leden het hebben gelezen."),
    ],
)
def test_languages(identifier, code, text):
    for t in (text, text.upper(), language.plain(text)):
        seg = identifier.segments(t)
        assert [s[2] for s in seg] == [code] and seg[0][3] > 0.9


def test_mixed_text(identifier):
    t = "The report was finished in time and everyone was satisfied. Der Ausschuss wird seinen Bericht morgen veröffentlichen, sobald er fertig ist. It will be sent to all members of the board."
    seg = identifier.segments(t)
    assert [s[2] for s in seg] == ["en", "de", "en"]
    assert t[seg[1][0] : seg[1][1]].startswith("Der Ausschuss")
    assert identifier.segments("") == [] and identifier.segments("12 34 --- !!!") == []


def test_undeclared(spark, identifier):
    en, fr = "The members of the board have read the whole report.", "Les membres du comité ont lu tout le rapport."
    e = spark.createDataFrame([("a", en + " " + fr, "D"), ("a", en + " " + fr, "D"), ("b", fr, "F"), ("c", None, "D"), ("d", "", "D"), ("e", en, None), (None, en, "D")], "chunk_id string, chunk_text string, domain_name string").withColumn("language", F.lit("clash"))
    q = spark.createDataFrame([("q1", en, "en_US"), ("q2", en, "und"), ("q3", fr, "Français"), ("q4", None, "en")], "query_id string, query string, language string")
    d = spark.createDataFrame([("D", "English"), ("F", "fr-FR"), ("F", "fr-FR")], "name string, language string")
    got = {tuple(r) for r in language.undeclared(language.records(e, q, d), identifier).collect()}
    assert got == {("a", "fr"), ("e", "en"), ("q2", "en")}


def test_sample_of_sentences(spark, monkeypatch):
    rng = random.Random(14)
    say = lambda i: f"{chr(65 + i % 26)}{i} " + " ".join(rng.choice(["the", "river", "was", "near", "old", "bridge", "and", "many", "people", "saw", "it"]) for _ in range(12)) + "."
    rows = [(say(i), "en") for i in range(4000)] + [("This notice stands on every page of the whole collection of reports.", "en")] * 500
    rows += [("1 # " + say(0), "en"), (None, "en"), ("", "en"), ("Kein Etikett an diesem Text.", None), ("x" * 100_000, "de")]
    df = spark.createDataFrame(rows, "text string, label string")
    monkeypatch.setattr(language, "SAMPLE_CHARS", 60_000)
    got = [r.piece for r in language.labelled_pieces(df).collect()]
    assert len(got) == len(set(got)) and sum(map(len, got)) < 2.5 * 60_000
    first = {x[0] for x in got if x[0].isalpha()}
    assert len(first) > 20  # of all beginnings, not of the first in the alphabet
    assert language.fit(df.where("false")).limit


def test_kneser_ney_sums_to_one():
    m = language.CharModel.train(Counter("the cat sat on the mat and the rat ate the hat".split()))
    codes, start, size = language._lay(["th"])
    alphabet = sorted(set("thecasonmdr "))
    total = 0.0
    for c in alphabet:
        x = np.array([ord(" "), ord("t"), ord("h"), ord(c)], np.uint64)
        total += float(np.exp(m.log_probs(x, np.arange(4))[3]))
    assert 0.95 < total < 1.05


# 4


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, n, "T", d, c, {}, 1) for i, n, d, c in rows], "id string, name string, type string, description string, source_chunks array<string>, attributes map<string,string>, community_id int")


def test_survivors(spark):
    full = "Alpha Beta Works is described in 2019 as part of the grid. It was revised twice by others."
    n = nodes_of(spark, [
        ("1", "ALPHA BETA WORKS", full, ["c1"]), ("2", "Alpha Beta Works", "Alpha Beta Works is described.", ["c1"]), ("3", "Alpha Beta Works", full, ["c1", "c2", " ", None, "c2"]),
        ("4", "Alpha Beta", "n/a", ["c1", "c2", "c3"]), ("5", "Alhpa Beta Works", full + " " + full, ["c1", "c2", "c3", "c4"]), ("6", "UNKNOWN", "ERROR: model output could not be parsed: {}", ["c9"] * 9),
        ("7", None, None, None), ("8", "n/a", " ", []), ("9", "Gamma Delta Depot", None, ["x"]), ("10", "Gamma Delta Depot", "", ["x"]),
    ])
    g = spark.createDataFrame([(1, str(i)) for i in range(1, 7)] + [(1, "3"), (2, "7"), (2, "8"), (3, "9"), (3, "10"), (4, "none"), (None, "1"), (5, None)], "group_id long, node_id string").withColumn("name", F.lit("clash"))
    got = {(r.group_id, r.field): r.node_id for r in survivors.best_values(g, n).collect()}
    assert got == {(1, "name"): "3", (1, "description"): "3", (3, "name"): "10"}
    s = {r.group_id: r for r in survivors.survivors(g, n).collect()}
    assert set(s) == {1, 2, 3} and s[1].name == "Alpha Beta Works" and s[2].node_id == "7" and s[2].name is None
    assert survivors.best_values(g.where("false"), n).count() == 0
    # equally good and supported: the more recent, where times are known
    x = spark.sql("select 'x' as chunk_id, timestamp'2026-01-02 00:00:00' as extracted_at union all select 'y', timestamp'2026-01-03 00:00:00'")
    two = nodes_of(spark, [("a", "Gamma Delta Depot", None, ["x"]), ("b", "Gamma Delta Depot", None, ["y"]), ("c", "Gamma Delta Depot", None, None)])
    pair = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "group_id long, node_id string")
    assert survivors.best_values(pair, two).first().node_id == "a" and survivors.best_values(pair, two, x).first().node_id == "b"


def test_missing_fields_come_from_further_layers(spark):
    shape = "id string, name string, type string, description string, source_chunks array<string>, attributes map<string,string>, community_id int"
    n = spark.createDataFrame(
        [
            ("a", "Gamma Delta Depot", None, None, ["1", "2", "3"], None, None),
            ("b", "Gamma Delta Depot", "T2", None, ["1", "2"], {}, None),  # second layer
            ("c", "Gamma Delta Depot", "T3", None, ["1"], {"k": "c"}, None),  # third
            ("d", "gamma delta depot", "T4", None, ["1"], {"k": "d"}, None),
            ("e", None, "T5", "Something is said.", ["1"] * 9, {"k": "e"}, 5),
            ("f", "Omega Depot", " ", None, ["1"], {}, None),
        ],
        shape,
    )
    g = spark.createDataFrame([(1, x) for x in "abcde"] + [(2, "f")], "group_id long, node_id string")
    s = {r.group_id: r for r in survivors.survivors(g, n).collect()}
    assert (s[1].node_id, s[1].type, s[1].attributes, s[1].community_id) == ("a", "T2", {"k": "c"}, 5)
    assert (s[2].node_id, s[2].type, s[2].attributes, s[2].community_id) == ("f", " ", {}, None)
    # peeled one after another
    rng = random.Random(5)
    rows = [(1, "f", *(rng.randint(0, 4) for _ in range(5)), f"n{i:03d}") for i in range(120)]
    df = spark.createDataFrame(rows, "group_id int, field string, d1 long, d2 long, d3 long, support long, recency long, node_id string")
    got = {r.node_id: r.layer for r in survivors.layers(df).collect()}
    beats = lambda y, x: all(a >= b for a, b in zip(y, x)) and y != x
    left, k = rows, 0
    while left:
        k += 1
        front = [r for r in left if not any(beats(o[2:7], r[2:7]) for o in left)]
        assert all(got[r[7]] == k for r in front)
        left = [r for r in left if r not in front]


def test_skyline_is_what_nothing_dominates(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), "f", *(rng.randint(0, 5) for _ in range(5)), f"n{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "group_id int, field string, d1 long, d2 long, d3 long, support long, recency long, node_id string")
    got = {(r.group_id, r.d1, r.d2, r.d3, r.support, r.recency) for r in survivors.skyline(df, 4).collect()}
    beats = lambda y, x: all(a >= b for a, b in zip(y, x)) and y != x
    want = {(r[0], *r[2:7]) for r in rows if not any(o[0] == r[0] and beats(o[2:7], r[2:7]) for o in rows)}
    assert got == want
    top = {r.group_id: r.node_id for r in survivors.choose(survivors.skyline(df)).collect()}
    for g in {r[0] for r in rows}:
        assert top[g] == min((r for r in rows if r[0] == g), key=lambda r: (*(-x for x in r[2:7]), r[7]))[7]


# 5


def test_line_keys():
    assert scans.page_value("— 12 —") == 12 and scans.page_value("xiv") == 14 and scans.page_value("Page 3 of 9") == 3 and scans.page_value("s. 7") == 7
    assert scans.page_value("2014.") is None and scans.page_value("iiii") is None and scans.page_value("word") is None
    long = "The Yearly Report " * 12
    assert scans.line_key(long)[0] == scans.line_key(long.upper())[0] != "-"  # however long
    a, b = scans.line_key("Kamali Office — Report   [7]"), scans.line_key("[8]  KAMA1I OFFICE — REPORT")
    assert a[0] == b[0] and a[1] == [7] and b[1] == [8]
    assert scans.line_key("4.2 The heading")[0] == "-" and scans.line_key("The text ends here.")[0] == "-"


def test_scans(spark):
    body = "The working group checked the water supply and the power line with great care."
    rows = []
    for p in range(1, 9):
        bad = "The w0rking group chccked the water supply and the power line with great care." if p == 4 else body
        cut = "The working group checked the water sup-\nply and the power line with great care." if p == 5 else bad
        dash = "A so-\ncalled " + body if p == 6 else cut
        rows.append((f"c{p}", "d", p, f"Kamali Office — Report   {p + 10}\n{dash}", None))
    rows += [(f"x{i}", "e", i, f"{body} This is a so-called state of affairs.", None) for i in range(12)] + [("n", "e", 1, None, None), ("m", "e", 2, "", None), (None, "e", 2, body, None), ("c1", "d", 1, rows[0][3], None)]
    df = spark.createDataFrame(rows, "chunk_id string, document string, page int, chunk_text string, header string")
    got = {tuple(r) for r in scans.defects(df).collect()}
    want = {(f"c{p}", k) for p in range(1, 9) for k in ("header", "page_number")} | {("c4", "misread"), ("c5", "hyphenation")}
    assert got == want
    t = {r.chunk_id: r.text for r in scans.repaired(df).collect()}
    assert t["c4"] == body and t["c5"] == body and t["c6"] == "A so-called " + body and t["m"] == "" and "n" not in t
    assert scans.defects(df.where("false")).count() == 0


def test_glyph_edits(spark):
    assert scans.glyph_edits("eat", "cat") == 1 and scans.glyph_edits("cat", "eat") == -1
    assert scans.glyph_edits("development", "dcvclopmcnt") == 3 and scans.glyph_edits("modern", "rnoclern") == 2 and scans.glyph_edits("is", "1s") == 1
    words = [("development", "dcvclopmcnt"), ("hill", "liill"), ("hell", "bcll"), ("illicit", "1l!icif"), ("summit", "surnrnit")]
    for v, w in words:
        k = spark.createDataFrame([(v, w)], "v string, w string").select(scans.glyph_key(F.col("v")), scans.glyph_key(F.col("w"))).first()
        assert k[0] == k[1]


def test_context_decides_what_is_misread(spark):
    rng = random.Random(12)
    who, what, when = ["people", "children", "workers", "guests"], ["bread", "soup", "fruit", "rice"], ["daily", "often", "together", "slowly"]
    beast, place = ["small", "grey", "sleepy", "old"], ["sofa", "roof", "garden", "barn"]
    rows = [f"{rng.choice(who)} eat {rng.choice(what)} {rng.choice(when)}." for _ in range(120)]
    rows += [f"the {beast[i % 4]} cat sleeps on the {place[i % 4]}." for i in range(8)]
    rows += [f"{who[i]} cat {what[i]} {when[i]}." for i in range(2)]
    df = spark.createDataFrame([(f"c{i:03d}", f"d{i}", 1, t) for i, t in enumerate(rows)], "chunk_id string, document string, page int, chunk_text string")
    bodies = scans.prepare(df)
    assert {(r.chunk_id, r.w, r.correct) for r in scans.misread(bodies).collect()} == {("c128", "cat", "eat"), ("c129", "cat", "eat")}
    t = {r.chunk_id: r.text for r in scans.repaired(df).collect()}
    assert t["c128"].startswith("people eat") and " cat " in t["c120"]
    # without its neighbours a word is decided once for all
    n = spark.createDataFrame([(10, 120, 1, False, 0.0, 0.0)], "n long, nv long, edits int, sure boolean, fit double, own double")
    assert n.select(scans.log_odds(*(F.col(c) for c in n.columns))).first()[0] < 0


def test_scans_without_a_document_are_apart(spark):
    line = "Kamali Office Yearly Report"
    df = spark.createDataFrame([(f"c{i}", None, 1, f"{line}\nThe text of page {i} stands here.") for i in range(6)], "chunk_id string, document string, page int, chunk_text string")
    assert scans.defects(df).count() == 0
    assert scans.defects(df.withColumn("document", F.lit("d"))).where("defect = 'header'").count() == 6


# 6


def test_walk_visits_cells_in_order():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random(7), rng.random(5)
        cells = rng.integers(0, 3, (7, 5))
        got = vectors.walk(a, b, cells.tolist(), int(cells.sum()))
        sums = [a[c // 5] + b[c % 5] for c in got]
        assert sums == sorted(sums) and sum(cells[c // 5][c % 5] for c in got) == cells.sum()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[450:500] = x[:50] + rng.normal(scale=0.05, size=(50, 16))
    x[500:800] = x[500] + rng.normal(scale=0.001, size=(300, 16))  # a third of all in one place
    rows = [("t", f"v{i:04d}", [float(y) for y in v]) for i, v in enumerate(x)]
    odd = [("t", "null", None), ("t", "empty", []), ("t", "zero", [0.0] * 16), ("t", "nan", [float("nan")] * 16), ("t", "short", [1.0] * 3), ("t", None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "space string, id string, embedding array<double>")
    u = vectors.unit_vectors(df)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -1)
    for block in (60, 20_000):
        got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(u, k=1000, candidates=500, block_rows=block).collect()}
        want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
        assert len(want & got) >= 0.99 * len(want) and not got - want
    near, _ = vectors.nearest(u, k=5, candidates=600)
    by = {}
    for r in near.collect():
        by.setdefault(r.id, set()).add(r.other)
    hits = sum(len({f"v{j:04d}" for j in np.argsort(-s[i])[:5]} & by[f"v{i:04d}"]) for i in list(range(500)) + list(range(800, 900)))
    assert hits >= 0.9 * 600 * 5
    assert vectors.similar_pairs(vectors.unit_vectors(df.where("false"))).count() == 0


def test_all_pairs_of_a_dense_region(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(6000, 64))
    x[:3000] = 8 * np.eye(64)[0] + 0.97 * rng.normal(size=(3000, 64))  # half of all around one direction
    for i in range(0, 600, 2):
        d = rng.normal(size=64)
        n = x[i] / np.linalg.norm(x[i])
        d -= n * (n @ d)
        x[i + 1] = 0.92 * n + np.sqrt(1 - 0.92**2) * d / np.linalg.norm(d)
    x[3000:3015] = x[3000] + rng.normal(scale=0.05, size=(15, 64))  # more than ten alike
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(n @ n.T, 1)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(s >= 0.9))}
    rows = [("t", f"v{i:04d}", [float(y) for y in v]) for i, v in enumerate(x)]
    u = vectors.unit_vectors(spark.createDataFrame(rows, "space string, id string, embedding array<double>"))
    for block in (700, 20_000):
        assert {(r.id_a, r.id_b) for r in vectors.similar_pairs(u, block_rows=block).collect()} == want


# 7


def brute_components(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("cell", [3, 40, 10_000])
def test_components(spark, cell):
    rng = random.Random(cell)
    e = [(f"v{rng.randint(0, 400):03d}", f"v{rng.randint(0, 400):03d}") for _ in range(150)] + [("hub", f"w{i}") for i in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)]
    df = spark.createDataFrame(e + e[:20] + [("lone", "lone"), (None, "x"), ("y", None)], "a string, b string").withColumn("component", F.lit("clash"))
    got = {r.v: r.component for r in components.connected_components(df, cell_edges=cell).collect()}
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(v)
    assert {v: min(g) for g in groups.values() for v in g} == brute_components([(a, b) for a, b in e if a != b])
    assert components.connected_components(df.where("false")).count() == 0


def test_node_groups(spark):
    n = spark.createDataFrame(
        [("a", "One", ["two"], []), ("b", " TWO ", None, None), ("c", "One", [], ["gone"]), ("d", "x", ["  ", "q"], []), ("e", " ", ["q"], []), ("f", None, None, ["zz"]), ("g", "y", None, None), ("h", "w", ["w"], None)],
        "id string, name string, aliases array<string>, merged_from array<string>",
    ).withColumn("a", F.lit("clash"))
    m = spark.createDataFrame(
        [("gone", "g", True, 1), ("g", "gone", True, 1), ("d", "e", True, 1), ("e", "d", None, 2), ("f", "f", True, 1), ("zz", "d", False, 5), ("d", "zz", True, 3), (None, "a", True, 1)],
        "node_a string, node_b string, same_entity boolean, decided_at int",
    )
    assert {tuple(r) for r in components.node_groups(n, m).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("g", "c")}
    assert components.node_groups(n.where("false"), m.where("false")).count() == 0


# 8


@needs_tokenizer
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=3), st.sampled_from(["the", " ", "  ", "\n", "'s", "😀", "é", "12", "tion", "\x85", "​"])), max_size=30).map("".join))
def test_tokens_match_the_library(text):
    import tiktoken

    own = tokens.transducer()
    lib = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode(text)
    assert ids == lib.encode_ordinary(text)
    assert "".join(tokens.decode_stream(ids)) == text


@needs_tokenizer
def test_token_columns(spark):
    long = "ab" * 50_000 + "!" * 30_000
    df = spark.createDataFrame([(1, "Hello <|endoftext|>"), (2, ""), (3, None), (4, "  \n"), (5, long), (1, "Hello <|endoftext|>"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode_column(df)
    rows = got.collect()
    assert got.columns == ["doc_id", "ids"] and len(rows) == 7
    by = {r.doc_id: r.ids for r in rows}
    assert by[2] == [] and by[3] == [] and by[4] and 50256 not in by[1]
    back = {r.doc_id: r.text for r in tokens.decode_column(got).collect()}
    assert back[1] == "Hello <|endoftext|>" and back[5] == long
    assert tokens.encode_column(df.where("false")).count() == 0


@given(st.binary(max_size=40))
def test_utf8_machine(data):
    m = tokens.Utf8Machine()
    got = "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end()
    assert got == data.decode("utf-8", "replace")


# 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_packing_of_a_shard(sizes):
    bins = packing.pack_shard(sizes, 100)
    fill = Counter()
    for b, s in zip(bins, sizes):
        fill[b] += s
    assert all(v <= 100 for v in fill.values())
    used = [v for v in fill.values() if v]
    # never twice as many containers as needed: two that are half empty would have been joined
    assert sum(1 for v in used if 2 * v <= 100) <= 1


def test_packing_search_leaves_no_step():
    """No move, exchange or two for one is left between any containers, however many there are and hold."""
    rng = random.Random(1)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 21, 34, 40]) for _ in range(260)]
    bins, fill = [], []
    for i, size in enumerate(sizes):
        at = next((b for b in range(len(bins)) if fill[b] + size <= rng.randint(60, 97)), len(bins))
        if at == len(bins):
            bins.append([])
            fill.append(0)
        bins[at].append(i)
        fill[at] += size
    out = packing.improve(bins, sizes, 100)
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    full = [sum(sizes[i] for i in b) for b in out]
    assert max(full) <= 100
    for a, b in itertools.permutations(range(len(out)), 2):
        one, two = {sizes[i] for i in out[b]}, {sizes[i] + sizes[j] for i, j in itertools.combinations(out[b], 2)}
        gains = {y - x for x in {0, *(sizes[i] for i in out[a])} for y in one} | {y - sizes[i] for i in out[a] for y in two}
        assert not any(0 < g <= 100 - full[a] and full[a] + g > full[b] for g in gains)


def test_packing(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 400) for _ in range(3000)] + [5000, 1000, 2000, 0, 0]
    df = spark.createDataFrame(list(enumerate(sizes)) + [(9000, None), (9001, -5)], "id int, size int").withColumn("shard", F.lit("clash"))
    got = packing.pack(df, 1000, shard_items=500).collect()
    fill, total = Counter(), Counter()
    for r in got:
        fill[r.container_id] += r["size"]
        total[r.id] += r["size"]
    assert max(fill.values()) <= 1000 and all(total[i] == s for i, s in enumerate(sizes)) and 9000 in total and 9001 in total
    assert len({r.container_id for r in got if r.id == 3000}) == 5 and sum(1 for r in got if 0 < sizes[min(r.id, 3004)] <= 1000 and r.id < 3005) == sum(1 for s in sizes if 0 < s <= 1000)
    assert sum(1 for v in fill.values() if v) <= -(-sum(sizes) // 1000) * 1.01 + 2
    assert packing.pack(df.where("false"), 1000).count() == 0
    r = packing.fill_report(packing.pack(df, 1000), 1000).first()
    assert r.fullest <= 1000 and r.tokens == sum(sizes)


# 10


def test_units():
    t = "# Head\n\nFirst sentence. Second one\nwraps here!\n\n| item | n |\n|---|---|\n| ab | 1 |\n| cd | 2 |\n- item one. And two.\n12 34"
    assert [k for k, _ in subjects.units(t)] == ["h", "s", "s", "r", "r", "i", "i"]
    assert subjects.units("") == [] and subjects.units("* * *\n12") == []


def test_subjects(spark):
    rng = random.Random(10)
    words = {"sea": ["harbour", "sailor", "anchor", "lighthouse"], "hill": ["summit", "glacier", "climber", "ridge"]}
    frames = ["The {} was close to the {} all day.", "Nobody knew why the {} had reached the {}."]
    say = lambda s: rng.choice(frames).format(*rng.sample(words[s], 2))
    docs, labels, want = [], [], set()
    for i in range(300):
        main = rng.choice(["sea", "hill"])
        other = "hill" if main == "sea" else "sea"
        kind = i % 3
        body = [say(main) for _ in range(6)] + ([say(other)] if kind == 1 else [say(other) for _ in range(4)] if kind == 2 else [])
        docs.append((i, " ".join(body), "x/y"))
        want.add((i, main))
        if kind == 2:
            want.add((i, other))
        if i % 4 == 0:
            labels.append((i, main, "r"))
    odd = [(900, None, "x"), (901, "", None), (902, "12 34", "x"), (0, docs[0][1], "x/y")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, source string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, "sea", "r"), (1, None, "r")], "doc_id long, subject string, annotator string")
    s = spark.createDataFrame([("sea",), ("hill",), ("hill",)], "subject string")
    m = subjects.fit(d.dropDuplicates(["doc_id"]), lab, s)
    got = {tuple(r) for r in subjects.document_subjects(d, m).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    assert subjects.document_subjects(d.where("false"), m).count() == 0
    assert subjects.document_subjects(d, subjects.fit(d, lab, s.where("false"))).count() == 0
    none = subjects.fit(d.where("false"), lab.where("false"), s)
    assert subjects.document_subjects(d, none).count() == 0


def test_chain_learns_from_labels():
    rng = random.Random(11)
    words = {"sea": ["harbour", "sailor", "anchor", "lighthouse"], "hill": ["summit", "glacier", "climber", "ridge"]}
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    filler = ["".join(rng.choices(syllables, k=3)) for _ in range(4000)]  # too rare to stand for a subject
    texts, votes, mains = [], [], []
    for i in range(240):
        main = rng.choice(["sea", "hill"])
        # one telling term a sentence
        texts.append(" ".join(f"{rng.choice(filler)} {rng.choice(words[main])} {rng.choice(filler)} {rng.choice(filler)}.".capitalize() for _ in range(8)))
        votes.append({main: 1.0} if i % 2 else {})
        mains.append(main)
    m = subjects.train(texts, ["x"] * len(texts), votes, ["hill", "sea"])
    hits = known = 0
    for t, main in zip(texts, mains):
        u = subjects.units(t)
        sc = m.score([x for _, x in u])
        if (sc.max(1) > 0).mean() < subjects.LEAST_SHARE:  # terms without a weight
            continue
        known += 1
        about = m.decode(m.features(sc, [k for k, _ in u], "x", sc.mean(0)))[0].mean(0)
        hits += [n for n, share in zip(m.subjects, about) if share >= subjects.LEAST_SHARE] == [main]
    assert known > 150 and hits >= 0.95 * known


@needs_tokenizer
def test_documents_of_the_smallest_tables_round_trip(spark, data):
    assert QUERIES["p8_round_trip"](spark, data).where("not restored").count() == 0
    n = pq.read_metadata(f"{data}/documents.parquet").num_rows
    assert QUERIES["p8_ids"](spark, data).count() == n
